"""Exact top-k inner products by a three-phase uniform threshold over lists of dimensions.

The dimensions are dealt into ``lists``; a list scores every vector by its own dimensions only, so
a score is the sum of a vector's entries in all lists.

1. Every list gives the first entries of each query. The scores of the vectors met are resolved,
   and the k-th best of them, t, is a cutoff that k vectors reach.
2. A sum of at least t has an entry of at least t / lists. With that cutoff every list gives all
   entries that reach it; no other vector can be among the first k, whatever the signs.
3. Entries are added up. A vector with an entry from every list is known, and the known ones may
   raise the cutoff; of the others, what could still reach it is resolved exactly.

Scores are integers: components become floor(scale * x). Equal vectors are one class.

Rows: a null key, a null vector and one with a null or non-finite component take no part; repeated
rows (equal in key and vector) are one row; a query's own key is no result of it, also where
further rows have that key; components that a shorter vector lacks are 0; a score beyond a long is
the long's bound; ties go to the smaller key; an empty table gives no rows; other columns play no
part. Vectors of any length are read in whole; a task holds one block of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.vectors import (
    INTEGER, SMALL, as_longs, block_count, classes, column, encoded, matrix, met, quantised, same_width, visits,
)
from lotwise.session import checkpoint

LISTS = 2
ENTRY = "list int, qid long, cid long, entry long"
SURE = 1 << 61  # an entry beyond it may be cut to a long, so its vector is resolved
PAIRS_AT_ONCE = 1 << 14


def dealt(held: bytes, lists: int) -> list[bytes]:
    """The parts of an encoded vector: every ``lists``-th dimension."""
    if held[0] in (SMALL, INTEGER):
        all_of = np.frombuffer(held, "<i2" if held[0] == SMALL else "<i4", offset=1)
        return [held[:1] + all_of[n::lists].tobytes() for n in range(lists)]
    all_of = held[1:].split(b",")
    return [encoded(np.array([float(v) for v in all_of[n::lists]])) for n in range(lists)]


def in_lists(rows: DataFrame, lists: int) -> DataFrame:
    """Rows (cid, least, marks, q) once for every list, with that list's part of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [dealt(v, lists) for v in batch.column(3).to_pylist()]
            for n in range(lists):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([p[n] for p in parts], pa.binary()), pa.array([n] * len(parts), pa.int32())],
                    ["cid", "least", "marks", "q", "list"])

    split = rows.select("cid", "least", "marks", "q").mapInArrow(run, "cid long, least long, marks array<long>, q binary, list int")
    return split.withColumn("label", F.lit(0).cast("long"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two sets of integer rows, exactly."""
    a, b = same_width(a, b)
    if a.dtype == object or b.dtype == object:
        return a.astype(object) @ b.astype(object).T
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:  # every partial sum is a whole double
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if most < 1 << 63 else a.astype(object) @ b.astype(object).T


def entries(batches: Iterator[pa.RecordBatch], first: int | None, lists: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """A list's entries: the ``first`` of each query, or all that reach the query's cutoff."""

    def build(rows: pa.Table):
        return column(rows, "cid").to_numpy(), matrix(column(rows, "q"))

    for (cids, vectors), queries in visits(batches, build):
        scores = products(matrix(column(queries, "q")), vectors)
        qids = column(queries, "cid").to_numpy()
        if first is not None:
            n = min(first, scores.shape[1])
            at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
            row, col = np.repeat(np.arange(len(qids)), n), at.ravel()
        else:
            cut = np.array([m[0] if m else None for m in column(queries, "marks").to_pylist()], object)
            open_ = np.array([c is None for c in cut])
            least = np.array([0 if c is None else -(-c // lists) for c in cut], np.int64)
            row, col = np.nonzero((scores >= least[:, None]) | open_[:, None])
        own = np.full(len(row), queries.column(0)[0].as_py() // blocks, np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(qids[row]), pa.array(cids[col]), pa.array(as_longs(scores[row, col]))], ["list", "qid", "cid", "entry"])


def resolved(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, cid, score): the whole inner product of pairs of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(at, PAIRS_AT_ONCE)
                a, b = same_width(matrix(part.column(2)), matrix(part.column(3)))
                most = max(1, a.shape[1]) * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
                if most >= 1 << 63:
                    a, b = a.astype(object), b.astype(object)
                found = as_longs((a * b).sum(axis=1)) if a.shape[1] else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], ["qid", "cid", "score"])

    theirs = rows.select(F.col("cid").alias("own"), F.col("q").alias("vector"))
    asked = rows.select(F.col("cid").alias("asked"), F.col("q").alias("query"))
    both = pairs.join(theirs, pairs["cid"] == theirs["own"]).join(asked, F.col("qid") == F.col("asked"))
    return both.select("qid", "cid", "query", "vector").mapInArrow(run, "qid long, cid long, score long")


def kth_best(scored: DataFrame, k: int) -> DataFrame:
    """(asked, cutoff): the k-th best score of queries that have k."""
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    return scored.withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") == k).select(F.col("qid").alias("asked"), F.col("score").alias("cutoff"))


def top_classes(rows: DataFrame, asked: DataFrame, k: int, lists: int) -> DataFrame:
    """(qid, cid, score): the first ``k`` of the classes ``rows`` for the classes ``asked`` (cid)."""
    session = rows.sparkSession
    blocks = block_count(rows.count(), session.sparkContext.defaultParallelism)
    none = F.lit(None).cast("array<long>")
    theirs = in_lists(rows.withColumn("marks", none), lists)
    queries = rows.join(asked, "cid", "left_semi")
    ours = in_lists(queries.withColumn("marks", none), lists)
    # 1: the lists' first entries, and a cutoff from their scores
    listed = met(theirs, ours, blocks, lists).mapInArrow(lambda b: entries(b, k, lists, blocks), ENTRY)
    best = F.row_number().over(Window.partitionBy("qid", "list").orderBy(F.desc("entry")))
    gathered = listed.withColumn("nth", best).where(F.col("nth") <= k).select("qid", "cid").distinct()
    cutoff = checkpoint(kth_best(resolved(gathered, rows), k))
    # 2: all entries that reach the cutoff's share
    marked = queries.join(cutoff, queries["cid"] == cutoff["asked"], "left").withColumn(
        "marks", F.when(F.col("cutoff").isNotNull(), F.array("cutoff")))
    found = met(theirs, in_lists(marked, lists), blocks, lists).mapInArrow(lambda b: entries(b, None, lists, blocks), ENTRY)
    # 3: sums of entries; what is not known from all lists and can reach the cutoff is resolved
    sure = F.abs("entry") < SURE
    sums = checkpoint(found.groupBy("qid", "cid").agg(
        F.coalesce(F.sum(F.when(sure, F.col("entry"))), F.lit(0)).alias("score"), F.count_if(sure).alias("held"), F.max(~sure).alias("wide")))
    known = sums.where(F.col("held") == lists).select("qid", "cid", "score")
    raised = kth_best(known, k).select(F.col("asked").alias("again"), F.col("cutoff").alias("better"))
    rest = sums.where(F.col("held") < lists).join(cutoff, F.col("qid") == F.col("asked"), "left").join(raised, F.col("qid") == F.col("again"), "left")
    below = F.expr(f"(cutoff - 1 - pmod(cutoff - 1, {lists})) div {lists}")  # the highest entry under the cutoff's share
    reach = F.try_add("score", F.try_multiply(lists - F.col("held"), below))
    rest = rest.where(F.col("wide") | F.coalesce(reach >= F.greatest("cutoff", "better"), F.lit(True))).select("qid", "cid")
    return known.unionByName(resolved(rest, rows))


def top_k(
    rows: DataFrame, every: int = 50, k: int = 5, lists: int = LISTS, scale: float = 256, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest inner product for every query.

    Queries are the rows whose key is divisible by ``every``; all other rows are candidates of each.
    """
    held = checkpoint(quantised(rows, rows[key], rows[vector], scale))
    distinct = classes(held, ["q"], k + 1)
    asking = held.where(F.col("key") % every == 0)
    asking = checkpoint(asking.join(distinct.select("cid", "q"), "q").select(F.col("key").alias("query_id"), "cid"))
    scored = top_classes(distinct, asking.select("cid").distinct(), k + 1, lists)
    # of the first k + 1 classes by (score, least key) come the first k + 1 keys, the query's own among them
    scored = scored.join(distinct.select("cid", "least"), "cid")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "least"))
    first = scored.withColumn("nth", nth).where(F.col("nth") <= k + 1).join(distinct.select("cid", "keys"), "cid")
    each = F.flatten(F.collect_list(F.transform("keys", lambda v: F.struct((-F.col("score")).alias("turned"), v.alias("key")))))
    lists_of = first.groupBy("qid").agg(F.sort_array(each).alias("found"))
    own = asking.join(lists_of, asking["cid"] == lists_of["qid"])
    others = F.slice(F.array_distinct(F.filter("found", lambda f: f["key"] != F.col("query_id"))), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.key").alias("vec_id"), (-F.col("one.turned")).alias("score"))
