"""Boosted trees on numbers and categories: ordered target statistics and rounds by levels.

A category becomes the running mean of the outcome over the rows of its level that come before in
a hash order of the keys, so no row is told its own outcome. The order is cut into slices; sums per
slice and level are carried over, and each slice is finished in its own task.

A tree grows by levels: tasks sum rows and residuals per node, feature and bin, and the sums choose
the splits. Up to a bounded number of rows one task runs all rounds, since a job for each of the
levels would cost more than the rows; beyond it every level is a pass over the partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from lotwise.operators import forest
from lotwise.operators.ordering import SLICE, sliced
from lotwise.session import checkpoint, checkpoint_folder

REPLAY = 25  # trees between two checkpoints of the residuals
CHUNK_ROWS = 1 << 15  # summed at a time
HELD_ROWS = 1 << 20  # of a block of residuals
ENTRIES = 1 << 10  # of a table of leaf terms
FAN_IN = 64  # blocks of sums that the driver adds up itself


# --- ordered target statistics ---------------------------------------------------

@dataclass(frozen=True)
class Levels:
    """Outcome sums per text column and level, for rows that the model was not fitted on."""

    sums: DataFrame  # (column, level, total, n)
    prior: float


def level_sums(rows: DataFrame, texts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(i).alias("column"), F.col(c).alias("level")) for i, c in enumerate(texts)))
    return rows.select("label", *by, F.inline(cells)).groupBy("column", "level", *by).agg(F.sum("label").alias("total"), F.count("*").alias("n"))


def ordered_statistics(rows: DataFrame, texts: Sequence[str], key: str) -> tuple[DataFrame, Levels]:
    """``rows`` with ``stats``, one number for each text column, and the sums for other rows.

    A row of a level met for the first time gets the mean outcome, which counts as one row of
    every level.
    """
    prior = float(rows.agg(F.avg("label")).first()[0])
    levels = Levels(checkpoint(level_sums(rows, texts)), prior)
    kept = rows.columns
    order = rows.withColumn("__h", F.xxhash64(F.col(key).cast("string"), F.lit("order"))).withColumn("__tie", F.monotonically_increasing_id())
    parts = sliced(order, [], ["__h", "__tie"])
    before = Window.partitionBy("column", "level").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = level_sums(parts, texts, [SLICE]).select(
        SLICE, "column", "level", F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n")).where("n > 0")
    own = parts.select(
        SLICE, F.lit(1).alias("role"), "__h", "__tie", F.lit(0).alias("column"), F.lit("").alias("level"), F.col("label").alias("total"),
        F.lit(0).cast("long").alias("n"), F.array(*(F.col(c) for c in texts)).alias("levels"), F.struct(*kept).alias("row"))
    lead = carried.select(
        SLICE, F.lit(0).alias("role"), F.lit(0).cast("long").alias("__h"), F.lit(0).cast("long").alias("__tie"), "column", "level", "total", "n",
        F.lit(None).cast("array<string>").alias("levels"), F.lit(None).cast(own.schema["row"].dataType).alias("row"))
    slices = max(1, parts.agg(F.max(SLICE)).first()[0] + 1)
    met = lead.unionByName(own).repartitionById(slices, F.col(SLICE)).sortWithinPartitions("role", "__h", "__tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], tuple[float, int]] = {}
        for b in batches:
            role = b.column(b.schema.get_field_index("role")).to_numpy()
            lead = b.take(pa.array(np.flatnonzero(role == 0)))
            for c, v, t, k in zip(*(lead.column(x).to_pylist() for x in ("column", "level", "total", "n"))):
                held[c, v] = (t, k)
            mine = np.flatnonzero(role == 1)
            if not len(mine):
                continue
            taken = b.take(pa.array(mine))
            y = taken.column("total").to_numpy()
            texts_of = taken.column("levels").to_pylist()
            stats = np.empty((len(mine), len(texts)))
            for c in range(len(texts)):
                code, names = pd.factorize(np.array([v[c] for v in texts_of], object))
                base = np.array([held.get((c, v), (0.0, 0)) for v in names])
                groups = pd.Series(y).groupby(code)
                count, run_total = groups.cumcount().to_numpy(), groups.cumsum().to_numpy() - y
                stats[:, c] = (base[code, 0] + run_total + prior) / (base[code, 1] + count + 1)
                sums, sizes = np.bincount(code, y), np.bincount(code)
                held |= {(c, v): (base[i, 0] + sums[i], int(base[i, 1] + sizes[i])) for i, v in enumerate(names)}
            yield pa.RecordBatch.from_arrays([taken.column("row"), pa.array(stats.tolist(), pa.list_(pa.float64()))], ["row", "stats"])

    done = met.mapInArrow(run, T.StructType([T.StructField("row", own.schema["row"].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))]))
    return done.select(*(F.col("row")[c].alias(c) for c in kept), "stats"), levels


def known_statistics(rows: DataFrame, texts: Sequence[str], levels: Levels) -> DataFrame:
    """``rows`` with ``stats`` from the sums of the fitted rows; a new level gets the mean outcome."""
    found = rows
    for i, c in enumerate(texts):
        own = levels.sums.where(F.col("column") == i).select(
            F.col("level").alias(f"__level{i}"), ((F.col("total") + levels.prior) / (F.col("n") + 1)).alias(f"__stat{i}"))
        found = found.join(own, found[c] == own[f"__level{i}"], "left")
    return found.select(*rows.columns, F.array(*(F.coalesce(f"__stat{i}", F.lit(levels.prior)) for i in range(len(texts)))).cast("array<double>").alias("stats"))


# --- rounds ----------------------------------------------------------------------

@dataclass(frozen=True)
class Boosted:
    """Trees whose values are steps around ``centre``."""

    trees: list[forest.Tree]
    bins: forest.Bins
    centre: float
    error: float
    spread: float

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.centre + sum(t.predict(codes) for t in self.trees)


def columns_of(codes: np.ndarray) -> np.ndarray:
    """(feature, row): the codes of a feature side by side."""
    return np.ascontiguousarray(codes.T)


def node_of(tree: forest.Tree, codes: np.ndarray) -> np.ndarray:
    """The node each row has come to, for codes of (feature, row)."""
    n = codes.shape[1]
    node, own, flat = np.zeros(n, np.intp), np.arange(n), codes.ravel()
    inner = np.maximum(tree.feature, 0) * n
    cut = np.where(tree.feature < 0, 255, tree.cut).astype(np.uint8)  # nothing is above it: rows stay in a leaf
    left = np.where(tree.feature < 0, np.arange(len(tree.feature)), tree.left)
    for _ in range(tree_depth(tree)):
        node = left.take(node) + (flat.take(inner.take(node) + own) > cut.take(node))
    return node


def tree_depth(tree: forest.Tree) -> int:
    deep = np.zeros(len(tree.feature), int)
    for node in np.flatnonzero(tree.feature >= 0):  # children stand behind their parents
        deep[tree.left[node]:tree.left[node] + 2] = deep[node] + 1
    return int(deep.max())


def predicted(tree: forest.Tree, codes: np.ndarray) -> np.ndarray:
    parts = [tree.value.take(node_of(tree, codes[:, at:at + CHUNK_ROWS])) for at in range(0, codes.shape[1], CHUNK_ROWS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def node_sums(rest: np.ndarray, codes: np.ndarray, deep: int, tree: forest.Tree, nodes: list[int]) -> np.ndarray:
    """(node, 2, feature, bin): rows and residuals of the wanted nodes of a tree being grown, for codes of (feature, row)."""
    width, size = len(codes), len(nodes) * deep
    found = np.zeros((2, width, size))
    first = np.full(len(tree.feature), -1)  # of the sums of a node
    first[nodes] = np.arange(len(nodes)) * deep
    for at in range(0, len(rest), CHUNK_ROWS):
        own, own_codes = rest[at:at + CHUNK_ROWS], codes[:, at:at + CHUNK_ROWS]
        start = first.take(node_of(tree, own_codes))
        if len(tree.feature) > 1:
            mine = np.flatnonzero(start >= 0)
            start, own, own_codes = start.take(mine), own.take(mine), own_codes.take(mine, axis=1)
        for f in range(width):
            key = start + own_codes[f]
            found[0, f] += np.bincount(key, minlength=size)
            found[1, f] += np.bincount(key, own, size)
    return found.reshape(2, width, len(nodes), deep).transpose(2, 0, 1, 3)


def grown(sums: Callable[[forest.Tree, list[int]], np.ndarray], depth: int, ridge: float) -> forest.Tree:
    """A tree of the residuals by levels; of two siblings one is summed, the other is the rest."""
    none = np.zeros(1, np.int64)
    first = sums(forest.Tree(none - 1, none, none, none, none, none), [0])[0]
    held = {0: first}
    feature, cut, left, gain, n, s = [-1], [0], [0], [0.0], [first[0][0].sum()], [first[1][0].sum()]
    for level in range(depth):
        split = []
        for node, (count, total) in held.items():
            gains, cuts = forest.best_of_sums(count, total, count, 1)
            f = int(gains.argmax())
            if gains[f] > 1e-9:
                feature[node], cut[node], left[node], gain[node] = f, int(cuts[f]), len(feature), float(gains[f])
                low = [float(x[f, :cuts[f] + 1].sum()) for x in (count, total)]
                for new, x in ((feature, -1), (cut, 0), (left, 0), (gain, 0.0)):
                    new += [x, x]
                n += [low[0], n[node] - low[0]]
                s += [low[1], s[node] - low[1]]
                split.append(node)
        if not split or level == depth - 1:
            break
        parts = [np.array(x) for x in (feature, cut, left, n, n, gain)]
        found = sums(forest.Tree(*parts), [left[p] for p in split])
        held = {left[p] + k: x for p, own in zip(split, found) for k, x in ((0, own), (1, held[p] - own))}
    return forest.Tree(*(np.array(x) for x in (feature, cut, left)), np.array(s) / (np.array(n) + ridge), np.array(n), np.array(gain))


def fit_boosted(
    rows: DataFrame, bins: forest.Bins, iterations: int, rate: float, depth: int, ridge: float, most_rows: int = 1 << 18,
) -> Boosted:
    """Squared-error boosting of the coded ``rows``; leaves are shrunk as by ``ridge`` rows of no error.

    More than ``most_rows`` rows take a pass for each level of a tree; fewer are boosted in one task.
    Both ways sum the same numbers and choose the same splits.
    """
    rows = rows.select("id", "y", "codes")
    size, centre, spread = rows.agg(F.count("*"), F.avg("y"), F.var_pop("y")).first()
    centre, width, deep = float(centre), len(bins.edges), max(len(e) for e in bins.edges) + 1
    fit = boosted_in_task if size <= most_rows else boosted_by_passes
    trees, error = fit(rows, centre, width, deep, iterations, rate, depth, ridge)
    return Boosted(trees, bins, centre, error, float(spread) * size)


def boosted_in_task(rows: DataFrame, centre: float, width: int, deep: int, iterations: int, rate: float, depth: int, ridge: float) -> tuple[list[forest.Tree], float]:
    def boost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rest = np.concatenate([b.column(1).to_numpy() for b in held]) - centre
        codes = columns_of(np.concatenate([forest.codes_of(b.column(2), width) for b in held]))
        kept = []
        for _ in range(iterations):
            tree = grown(lambda t, nodes: node_sums(rest, codes, deep, t, nodes), depth, ridge)
            tree.value *= rate
            rest -= predicted(tree, codes)
            kept.append(tree.packed())
        error = float((rest**2).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(kept)), pa.int32()), pa.array(kept, pa.binary()), pa.array([error] * len(kept))], ["tree", "held", "error"])

    ordered = rows.repartition(1).sortWithinPartitions("id", "y")  # sums do not depend on the order of arrival
    model = sorted(ordered.mapInArrow(boost, "tree int, held binary, error double").collect(), key=lambda r: r.tree)
    return [forest.Tree.unpacked(r.held) for r in model], model[0].error


def boosted_by_passes(rows: DataFrame, centre: float, width: int, deep: int, iterations: int, rate: float, depth: int, ridge: float) -> tuple[list[forest.Tree], float]:
    """A job of one stage for each level of each tree, over blocks of residuals and codes that the executors keep.

    The first job of a tree also takes the tree before off the residuals. Every ``REPLAY`` trees the
    blocks are checkpointed, so that a lost executor has few trees to take off again.
    """
    spark = rows.sparkSession
    checkpoint_folder(spark)
    cores = spark.sparkContext.defaultParallelism

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in itertools.chain(batches, [None]):
            if held and (b is None or sum(len(y) for y, _ in held) >= HELD_ROWS):
                y, codes = (np.concatenate(x) for x in zip(*held))
                yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()), pa.array([columns_of(codes).tobytes()], pa.binary())], ["rest", "codes"])
                held = []
            if b is not None and b.num_rows:
                held.append((b.column(0).to_numpy() - centre, forest.codes_of(b.column(1), width)))

    def opened(row) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row.rest), np.frombuffer(row.codes, np.uint8).reshape(width, -1)

    blocks = rows.select("y", "codes").coalesce(cores).mapInArrow(packed, "rest binary, codes binary").rdd.map(opened)
    now = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    before = None  # blocks that ``now`` is made from, kept until it is there

    def summed(task: Callable) -> np.ndarray:
        """The arrays of all tasks added up, where there are many of them first in groups.

        One task a core and no shuffle: with a job for every level, a second stage is most of its time.
        """
        def run(own: Iterator[tuple]) -> Iterator[np.ndarray]:
            found = [task(rest, codes) for rest, codes in own]
            return iter([sum(found)] if found else [])

        made = now.mapPartitions(run)
        return made.treeReduce(np.add) if cores > FAN_IN else sum(made.collect())

    def sums(tree: forest.Tree, nodes: list[int]) -> np.ndarray:
        nonlocal before
        found = summed(lambda rest, codes: node_sums(rest, codes, deep, tree, nodes))
        if before is not None:
            before.unpersist()
            before = None
        return found

    trees: list[forest.Tree] = []
    for _ in range(iterations):
        tree = grown(sums, depth, ridge)
        tree.value *= rate
        trees.append(tree)
        before = now
        now = before.map(lambda b, tree=tree: (b[0] - predicted(tree, b[1]), b[1])).persist(StorageLevel.MEMORY_AND_DISK)
        if len(trees) % REPLAY == 0:
            now.checkpoint()
    error = float(summed(lambda rest, _: np.array([(rest**2).sum()]))[0])
    for x in (now, before):
        x.unpersist()
    return trees, error


def scored(model: Boosted, rows: DataFrame) -> DataFrame:
    """(y, prediction) of coded rows; the model's size is bounded by its iterations and depth."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.predict(forest.codes_of(b.column(1), len(shared.value.bins.edges))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["y", "prediction"])

    return rows.select("y", "codes").mapInArrow(run, "y double, prediction double")


# --- attributions ----------------------------------------------------------------

@dataclass(frozen=True)
class Leaf:
    """A leaf with its path: per feature the codes let through and the share of rows that had them."""

    value: float
    share: float  # of the training rows of its tree
    tests: dict  # feature -> (lowest code, highest code, product of cover shares)


def leaves_of(trees: Sequence[forest.Tree]) -> list[Leaf]:
    found = []
    for tree in trees:
        pending = [(0, {}, 1.0)]
        while pending:
            node, tests, share = pending.pop()
            f = int(tree.feature[node])
            if f < 0:
                found.append(Leaf(float(tree.value[node]), share, tests))
                continue
            low, high, cover = tests.get(f, (0, 255, 1.0))
            for child, bounds in ((tree.left[node], (low, min(high, tree.cut[node]))), (tree.left[node] + 1, (max(low, tree.cut[node] + 1), high))):
                part = tree.weight[child] / tree.weight[node]
                pending.append((child, {**tests, f: (*bounds, cover * part)}, share * part))
    return found


def add_leaf(total: np.ndarray, codes: np.ndarray, leaf: Leaf) -> None:
    """Shapley terms of one leaf: features on its path, for all rows at once.

    A row's terms depend only on which of the leaf's features let it through, so they are
    worked out once for every such set and looked up by row.
    """
    features = list(leaf.tests)
    cover = [leaf.tests[f][2] for f in features]
    d = len(features)
    sets = np.arange(1 << d)
    met = [(sets >> i & 1).astype(float) for i in range(d)]
    own = np.zeros(len(codes), np.uint8 if d <= 8 else np.int64)
    for i, f in enumerate(features):
        low, high, _ = leaf.tests[f]
        code = codes[:, f]
        through = (code >= low) & (code <= high) if low else code <= high
        own |= through.astype(own.dtype) << own.dtype.type(i)
    for i, f in enumerate(features):
        # coefficients of prod (cover + met * t) over the other features
        terms = [np.ones(len(sets))]
        for j in range(d):
            if j != i:
                terms = [
                    (terms[k] * cover[j] if k < len(terms) else 0.0) + (terms[k - 1] * met[j] if k else 0.0)
                    for k in range(len(terms) + 1)
                ]
        weighted = sum(t * factorial(k) * factorial(d - 1 - k) / factorial(d) for k, t in enumerate(terms))
        total[:, f] += (leaf.value * (met[i] - cover[i]) * weighted).take(own)


@dataclass(frozen=True)
class Terms:
    """The terms of some leaves of a tree as a table: a row's entry is the sum of its codes' steps, a column a feature."""

    steps: dict[int, np.ndarray]  # feature -> step of every code
    table: dict[int, np.ndarray]


def bounds_of(leaves: Sequence[Leaf]) -> dict[int, np.ndarray]:
    """The codes after which something changes, for each feature that the leaves test."""
    met: dict[int, set[int]] = {}
    for leaf in leaves:
        for f, (low, high, _) in leaf.tests.items():
            met.setdefault(f, set()).update(int(x) for x in (low - 1, high) if 0 <= x < 255)
    return {f: np.array(sorted(x)) for f, x in met.items()}


def terms_of(leaves: Sequence[Leaf]) -> list[Terms]:
    """Tables of at most ``ENTRIES`` entries, or of one leaf, for leaves in the order of ``leaves_of``.

    All codes between two bounds have the same terms, so those of one code of each stretch are worked out.
    """
    bounds = bounds_of(leaves)
    shape = [len(b) + 1 for b in bounds.values()]
    size = int(np.prod(shape))
    if size > ENTRIES and len(leaves) > 1:
        half = len(leaves) // 2
        return terms_of(leaves[:half]) + terms_of(leaves[half:])
    places = np.unravel_index(np.arange(size), shape) if bounds else ()
    codes = np.zeros((size, len(bounds)), np.uint8, order="F")
    for i, (b, place) in enumerate(zip(bounds.values(), places)):
        codes[:, i] = np.append(b, 255)[place]
    total, slot = np.zeros(codes.shape, order="F"), {f: i for i, f in enumerate(bounds)}
    for leaf in leaves:
        add_leaf(total, codes, Leaf(leaf.value, leaf.share, {slot[f]: t for f, t in leaf.tests.items()}))
    strides = np.cumprod([1, *shape[:0:-1]])[::-1]
    steps = {f: np.searchsorted(b, np.arange(256), side="left") * int(k) for (f, b), k in zip(bounds.items(), strides)}
    return [Terms(steps, {f: total[:, i].copy() for f, i in slot.items()})]


def attributions(model: Boosted, rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, float]:
    """(key, process_variable, attribution) for (key, codes), long form, and the base value.

    Exact for the tree-path value function: a leaf counts with its cover share for features left
    out. With the base value the contributions of a row sum to its prediction.
    """
    trees = [leaves_of([t]) for t in model.trees]
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # bounded by iterations and depth
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = [t for leaves in shared.value for t in terms_of(leaves)]
        for b in batches:
            codes = np.asfortranarray(forest.codes_of(b.column(1), len(columns)).astype(np.intp))
            total = np.zeros(codes.shape, order="F")
            for t in terms:
                if t.steps:
                    at = sum(step.take(codes[:, f]) for f, step in t.steps.items())
                    for f, values in t.table.items():
                        total[:, f] += values.take(at)
            at = pa.array(np.repeat(np.arange(b.num_rows), len(columns)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(columns * b.num_rows), pa.array(total.ravel())], ["key", "process_variable", "attribution"])

    kinds = T.StructType([rows.schema["key"], T.StructField("process_variable", T.StringType()), T.StructField("attribution", T.DoubleType())])
    base = model.centre + float(sum(x.value * x.share for leaves in trees for x in leaves))
    met = rows.select("key", "codes").coalesce(rows.sparkSession.sparkContext.defaultParallelism)  # a task makes the tables anew
    return met.mapInArrow(run, kinds), base
