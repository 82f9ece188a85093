"""Merkle manifest of a table by time-forward processing: digests up, proof suffixes down.

Rows are leaves of a tree per group, the groups' roots leaves of a last one; every ``fan`` nodes in
a row have one parent. A node's label is (level, index), so children come before parents. A queue
ordered by label delivers the digests: a node takes its children's messages, hashes them and sends
its own to its parent. The reversed sweep sends every node the rest of the proof above it, to which
it adds its siblings; what reaches a leaf is its proof.

The queue is external: messages between blocks of ``fan ** HEIGHT`` consecutive nodes are shuffled
and sorted by label into the task that owns the parent's block; inside a block they wait in a heap.
No task holds more than one block, whatever a group's size.

Rows: a null field is "-"; a null group is a group of its own and comes first; null keys come
first, rows of one key go by leaf digest, and repeated rows are leaves each; a lone leaf is its
group's root, with an empty proof; an empty table gives no rows; texts of any length are hashed
whole by Spark; other columns play no part and may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.operators.ordering import with_row_number
from lotwise.session import checkpoint

FAN = 8
HEIGHT = 4
PROOF = "array<struct<place: int, others: array<string>>>"
_STEP = pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])


def digest(parts: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each as its UTF-8 byte count, a colon and its text, or "-" if null."""
    text = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its proof lead to."""
    part = lambda s, start, n: F.array_join(F.slice(s["others"], start, n), "")
    return F.aggregate(proof, leaf, lambda own, s: F.sha2(
        F.concat(part(s, F.lit(1), s["place"]), own, part(s, s["place"] + 1, F.size(s["others"]))), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf's run to the root's, left to right."""
    return F.flatten(F.transform(proof, lambda s: s["others"]))


def forward(leaves: list[str], levels: int, fan: int = FAN) -> list[list[str]]:
    """Digests of all nodes of a block, level by level."""
    layers = [leaves, *([] for _ in range(levels))]
    queue = [(1, i // fan, i, d) for i, d in enumerate(leaves)] if levels else []  # in order, so a heap
    while queue:
        level, index = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, index):
            run.append(heapq.heappop(queue)[3])
        own = hashlib.sha256("".join(run).encode()).hexdigest()
        layers[level].append(own)
        if level < levels:
            heapq.heappush(queue, (level + 1, index // fan, index, own))
    return layers


def backward(layers: list[list[str]], suffix: list, fan: int = FAN) -> list[list]:
    """Proofs of a block's leaves, as (place, others) from the bottom up; ``suffix`` is the top's."""
    found: list[list] = [suffix] * len(layers[0])
    queue = [(1 - len(layers), 0, suffix)] if len(layers) > 1 else []
    while queue:
        level, index, rest = heapq.heappop(queue)
        level, first = -level - 1, -index * fan
        run = layers[level][first:first + fan]
        for place in range(len(run)):
            own = [(place, run[:place] + run[place + 1:]), *rest]
            if level:
                heapq.heappush(queue, (-level, -(first + place), own))
            else:
                found[first + place] = own
    return found


def proof_array(proofs: list[list]) -> pa.Array:
    steps = [s for p in proofs for s in p]
    digests = [d for s in steps for d in s[1]]
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    others = pa.ListArray.from_arrays(ends(len(s[1]) for s in steps), pa.array(digests, pa.string()))
    inner = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.int32()), others], fields=list(_STEP))
    return pa.ListArray.from_arrays(ends(map(len, proofs)), inner)


def blocks_of(batches: Iterator[pa.RecordBatch], starts) -> Iterator[pa.Table]:
    """The rows of one block after the other; ``starts`` marks the first row of each in a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        for cut in np.flatnonzero(starts(batch)):
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def climbed(nodes: DataFrame, fan: int, height: int) -> DataFrame:
    """(group, levels, at, digest): the tops of the blocks of ``nodes``, which are nodes above."""
    wide = fan**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, lambda b: b.column(2).to_numpy() % wide == 0):
            group, levels, at = (block.column(k)[0].as_py() for k in range(3))
            top = forward(block.column(3).to_pylist(), min(levels, height), fan)[-1]
            yield pa.RecordBatch.from_pydict(
                {"group": [group], "levels": [max(0, levels - height)], "at": [at // wide], "digest": top},
                schema=pa.schema([("group", pa.string()), ("levels", pa.int32()), ("at", pa.int64()), ("digest", pa.string())]))

    rows = nodes.select("group", "levels", "at", "digest").withColumn("block", F.expr(f"at div {wide}"))
    dealt = rows.repartition("group", "block").sortWithinPartitions("group", "block", "at").drop("block")
    return dealt.mapInArrow(run, "group string, levels int, at long, digest string")


def sunk(nodes: DataFrame, above: DataFrame, fan: int, height: int) -> DataFrame:
    """``nodes`` with ``suffix``: its siblings up to the block's top and that one's suffix in ``above``."""
    wide = fan**height
    given = nodes.schema.fields
    # a block's rows come after one row of its top, which alone carries the suffix
    lead = above.select(
        "group", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in given if f.name not in ("group", "at")), "suffix")
    rows = nodes.withColumn("block", F.expr(f"at div {wide}")).withColumn("suffix", F.lit(None).cast(PROOF))
    dealt = lead.unionByName(rows).repartition("group", "block").sortWithinPartitions("group", "block", "at")
    names = [f.name for f in given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, lambda b: b.column(names.index("at")).to_numpy() < 0):
            suffix = [(s["place"], s["others"]) for s in block.column("suffix")[0].as_py()]
            own = block.slice(1).select(names).combine_chunks()
            layers = forward(own.column("digest").to_pylist(), min(own.column("levels")[0].as_py(), height), fan)
            for part in own.append_column("suffix", proof_array(backward(layers, suffix, fan))).to_batches():
                yield part

    return dealt.select(*names, "suffix").mapInArrow(run, T.StructType([*given, lead.schema["suffix"]]))


def tree(leaves: DataFrame, fan: int = FAN, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """All blocks' nodes, level of blocks by level, and the tops: (group, levels, at, digest) per group.

    ``leaves`` are (group, at, digest, ...) with ``at`` from 0 in every group.
    """
    powers = F.array(*(F.lit(p).cast("long") for p in iter_powers(fan)))
    sizes = leaves.groupBy("group").agg((F.max("at") + 1).alias("n")).select(
        F.col("group").alias("of"), F.size(F.filter(powers, lambda p: p < F.col("n"))).alias("levels"))
    nodes = checkpoint(leaves.join(sizes, leaves["group"] == sizes["of"]).drop("of"))
    found = []
    while True:
        found.append(nodes)
        left = nodes.agg(F.max("levels")).first()[0]
        if not left:
            return found, nodes.select("group", "levels", "at", "digest")
        nodes = checkpoint(climbed(nodes, fan, height))


def iter_powers(fan: int) -> list[int]:
    powers = [1]
    while powers[-1] * fan < 1 << 62:
        powers.append(powers[-1] * fan)
    return powers


def proven(found: list[DataFrame], suffixes: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """The lowest nodes with ``suffix``, their proof, from the tops' ``suffixes`` (group, at, suffix)."""
    lowest = len(found) == 1
    for nodes in reversed(found[:-1]):
        suffixes = sunk(nodes, suffixes, fan, height)
    if lowest:
        tops = suffixes.select(F.col("group").alias("of"), "suffix")
        return found[0].join(tops, found[0]["group"] == tops["of"]).drop("of")
    return suffixes


def manifest(
    rows: DataFrame, fields: list[Column], group: Column, key: Column, held: Column | None = None,
    fan: int = FAN, height: int = HEIGHT,
) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, held): a row per row, ``held`` being carried along.

    ``proof`` holds, from the leaf's run up to the root's, the place in the run and the siblings'
    digests; ``folded`` leads from a leaf and its proof to the root.
    """
    named = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))  # no group is null, and null comes first
    given = rows.select(
        named.alias("group"), key.alias("key"), digest(fields).alias("digest"), (F.lit(None).cast("int") if held is None else held).alias("held"),
        F.monotonically_increasing_id().alias("row"))  # splits equal rows, which may change places
    at = lambda frame, order, by: with_row_number(frame, order, by, "nth").withColumn("at", F.col("nth") - 1).drop("nth")
    leaves = at(given, ["key", "digest", "row"], ["group"]).drop("row")
    found, tops = tree(leaves, fan, height)
    subroots = at(tops.select(F.col("group").alias("lang"), "digest"), ["lang"], []).withColumn("group", F.lit(""))
    above, top = tree(subroots, fan, height)
    root = top.select(F.col("digest").alias("root"))
    none = F.array().cast(PROOF)
    proofs = proven(above, top.select("group", "at", none.alias("suffix")), fan, height)
    proofs = checkpoint(proofs.select(F.col("lang").alias("group"), F.lit(0).cast("long").alias("at"), "suffix", F.col("digest").alias("subroot")))
    done = proven(found, proofs.select("group", "at", "suffix"), fan, height)
    names = proofs.select(F.col("group").alias("of"), "subroot")
    first = root.first()
    return done.join(names, done["group"] == names["of"]).select(
        "key", F.when(F.col("group") != "", F.substring("group", 2, 1 << 30)).alias("group"), F.col("digest").alias("leaf"), "subroot",
        F.lit(first[0] if first else None).cast("string").alias("root"), F.col("suffix").alias("proof"), "held")
