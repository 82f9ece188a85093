"""Hard negatives by Kronecker-packed inner products.

Components are integers. Those of several candidates are shifted to be non-negative and laid into
separate fields of one wide integer, a packed candidate per dimension; an anchor's component
multiplies it once, and the sum over the dimensions holds all candidates' inner products in its
fields, wide enough not to run over. Taking off what the shift added gives the exact scores.

The wide integers are doubles, whose 53 bits are whole numbers to a matrix product; where a field
alone needs more, they are Python integers of ``BIG_FIELDS`` fields.

Rows: a null key, a null label, a null vector and one with a null or non-finite component take no
part; repeated rows (equal in key, label and vector) are one row; an anchor's own key is neither
positive nor negative of it; components that a shorter vector lacks are 0; a score beyond a long is
the long's bound; ties go to the smaller key; an anchor without positives, or a positive without
negatives in its range, has no rows; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.vectors import as_longs, block_count, classes, column, matrix, met, quantised, same_width, visits
from lotwise.session import checkpoint

WORD = 53
BIG_FIELDS = 8
FOUND = "aid long, mark long, cid long, score long, least long"


class Packed:
    """Candidates (rows of integers) packed for products with anchors of components up to ``most``."""

    def __init__(self, rows: np.ndarray, most: int) -> None:
        self.count, self.most = len(rows), most
        self.shift = max(0, -int(rows.min(initial=0)))
        high = int(rows.max(initial=0)) + self.shift
        self.bound = max(1, rows.shape[1] * most * high)  # of a field's sum, on either side
        self.width = (2 * self.bound).bit_length()
        self.big = self.width > WORD or rows.dtype == object
        self.fields = BIG_FIELDS if self.big else WORD // self.width
        filled = np.zeros((len(rows) + -len(rows) % self.fields, rows.shape[1]), object if self.big else np.int64)
        filled[:len(rows)] = rows.astype(filled.dtype) + self.shift
        filled = filled.reshape(-1, self.fields, rows.shape[1])
        packed = filled[:, 0]
        for k in range(1, self.fields):
            packed = packed + filled[:, k] * (1 << k * self.width)
        self.packed = packed.T if self.big else np.ascontiguousarray(packed.T, dtype=np.float64)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of all anchors (rows) with all candidates."""
        kind = object if self.big else np.int64
        sums = (anchors.astype(object if self.big else np.float64) @ self.packed).astype(kind)
        sums += sum(self.bound << k * self.width for k in range(self.fields))  # no field below zero
        taken = (self.bound + self.shift * anchors.astype(kind).sum(axis=1))[:, None]
        mask = (1 << self.width) - 1
        out = np.empty((len(anchors), sums.shape[1], self.fields), kind)
        for k in range(self.fields):
            out[:, :, k] = ((sums >> k * self.width) & mask) - taken
        return out.reshape(len(anchors), -1)[:, :self.count]


class Block:
    """A slot's candidates by ``least``; packed anew when an anchor exceeds what they are packed for."""

    def __init__(self, rows: pa.Table) -> None:
        self.cid, self.label, self.least = (column(rows, n).to_numpy() for n in ("cid", "label", "least"))
        self.rows = matrix(column(rows, "q"))
        self.order = np.argsort(self.label, kind="stable")
        self.names, self.starts = np.unique(self.label[self.order], return_index=True)
        self.packed: dict[object, Packed] = {}

    def members(self, label: int) -> np.ndarray:
        at = np.searchsorted(self.names, label)
        if at == len(self.names) or self.names[at] != label:
            return self.order[:0]
        return self.order[self.starts[at]:(self.starts[at + 1] if at + 1 < len(self.names) else None)]

    def scores(self, anchors: np.ndarray, label: int | None = None) -> np.ndarray:
        """Products with all candidates, or with those of one label."""
        anchors, rows = same_width(anchors, self.rows)
        most = int(np.abs(anchors).max(initial=0))
        held = self.packed.get(label)
        if held is None or held.most < most or held.packed.shape[0] != anchors.shape[1]:
            held = self.packed[label] = Packed(rows if label is None else rows[self.members(label)], 1 << most.bit_length())
        return as_longs(held.scores(anchors))


def rows_of(aids, marks, block: Block, cols: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(aids), pa.array(marks, pa.int64()), pa.array(block.cid[cols]), pa.array(scores), pa.array(block.least[cols])],
        ["aid", "mark", "cid", "score", "least"])


def best_alike(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """A block's ``first`` classes of an anchor's own label, by score and least key."""
    for block, part in visits(batches, Block):
        aids, labels, anchors = column(part, "cid").to_numpy(), column(part, "label").to_numpy(), matrix(column(part, "q"))
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            own = block.members(label)
            if not len(own):
                continue
            found = block.scores(anchors[mine], int(label))
            n = min(first, len(own))
            # members stand in the order of their least key: one number ranks score, then key
            high = max(abs(int(found.max())), abs(int(found.min())))
            ranked = -(found.astype(object if high * len(own) >= 1 << 62 else np.int64) * len(own)) + np.arange(len(own))
            at = np.argpartition(ranked, n - 1, axis=1)[:, :n]
            scores = np.take_along_axis(found, at, axis=1).ravel()
            yield rows_of(np.repeat(aids[mine], n), np.zeros(len(mine) * n, np.int64), block, own[at.ravel()], scores)


def best_unlike(batches: Iterator[pa.RecordBatch], first: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """A block's ``first`` classes of other labels in the range of each of an anchor's positive scores."""
    for block, part in visits(batches, Block):
        aids, labels, marks = column(part, "cid").to_numpy(), column(part, "label").to_numpy(), column(part, "marks").to_pylist()
        scores = block.scores(matrix(column(part, "q")))
        deep = max(map(len, marks))
        marks = [m + m[-1:] * (deep - len(m)) for m in marks]  # the last one repeated
        # of whole scores; no product leaves the range of a long
        floor, roof = np.array([[-(-low * v // high) for v in m] for m in marks], np.int64), np.array(marks, np.int64)
        row, col = np.nonzero((scores >= floor.min(axis=1)[:, None]) & (scores <= roof.max(axis=1)[:, None]) & (block.label[None, :] != labels[:, None]))
        value = scores[row, col]
        order = np.lexsort((col, -value, row))
        row, col, value = row[order], col[order], value[order]
        for t in range(deep):
            fits = (value >= floor[row, t]) & (value <= roof[row, t]) & ((t == 0) | (roof[:, t] != roof[:, t - 1]))[row]
            r, c, v = row[fits], col[fits], value[fits]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            keep = nth < first
            yield rows_of(aids[r[keep]], roof[r[keep], t], block, c[keep], v[keep])


def merged(found: DataFrame, by: list[str], rows: DataFrame, keep: int, name: str) -> DataFrame:
    """(*by, name): the first ``keep`` keys of the blocks' findings as sorted (turned score, key) structs."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "least"))
    first = found.withColumn("nth", nth).where(F.col("nth") <= keep).drop("least").join(rows.select("cid", "keys"), "cid")
    each = F.flatten(F.collect_list(F.transform("keys", lambda v: F.struct((-F.col("score")).alias("turned"), v.alias("key")))))
    return first.groupBy(*by).agg(F.slice(F.array_distinct(F.sort_array(each)), 1, keep).alias(name))


def mined(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    scale: float = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose key is divisible by ``every``. An anchor's positives are its best
    other rows of its label; for each the best rows of other labels with
    ``low * positive_score <= high * negative_score <= high * positive_score`` are its negatives.
    """
    session = rows.sparkSession
    held = checkpoint(quantised(rows, rows[key], rows[vector], scale, rows[label]))
    # an anchor's own key may be one of the found, on either side
    keep = max(positives, negatives) + 1
    distinct = classes(held, ["label", "q"], keep)
    one = distinct.withColumn("list", F.lit(0))
    asking = held.where(F.col("key") % every == 0).join(distinct.select("cid", "label", "q"), ["label", "q"])
    asking = checkpoint(asking.select(F.col("key").alias("anchor_id"), F.col("cid").alias("aid")))
    blocks = block_count(distinct.count(), session.sparkContext.defaultParallelism)
    anchors = one.join(asking.select(F.col("aid").alias("cid")).distinct(), "cid", "left_semi")
    alike = met(one, anchors.withColumn("marks", F.lit(None).cast("array<long>")), blocks).mapInArrow(lambda b: best_alike(b, positives + 1), FOUND)
    best = merged(alike, ["aid"], distinct, positives + 1, "alike")
    mine = asking.join(best, "aid")
    others = F.slice(F.filter("alike", lambda f: f["key"] != F.col("anchor_id")), 1, positives)
    pairs = checkpoint(mine.select("anchor_id", "aid", F.explode(others).alias("one")).select(
        "anchor_id", "aid", F.col("one.key").alias("positive_id"), (-F.col("one.turned")).alias("positive_score")))
    # an anchor class has few scores: of its rows' first positives
    marks = pairs.groupBy("aid").agg(F.sort_array(F.collect_set("positive_score")).alias("marks"))
    asked = anchors.join(marks, anchors["cid"] == marks["aid"])
    unlike = met(one, asked, blocks).mapInArrow(lambda b: best_unlike(b, negatives + 1, low, high), FOUND)
    hard = merged(unlike, ["aid", "mark"], distinct, negatives + 1, "unlike").withColumnRenamed("aid", "theirs")
    both = pairs.join(hard, (pairs["aid"] == hard["theirs"]) & (pairs["positive_score"] == hard["mark"]))
    others = F.slice(F.filter("unlike", lambda f: f["key"] != F.col("anchor_id")), 1, negatives)
    return both.select("anchor_id", "positive_id", "positive_score", F.posexplode(others).alias("at", "one")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.key").alias("negative_id"),
        "positive_score", (-F.col("one.turned")).alias("negative_score"))
