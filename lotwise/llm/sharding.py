"""Shards of near equal bytes along a Hilbert curve over the documents' metadata.

Language, source and size are quantised to ``BITS`` bits each; documents are ordered by the
index of their cell on the Hilbert curve, and the order is cut into runs of equal bytes. Files
written per shard then cover small boxes of all three, so a filter on any of them skips files.

Languages and sources are quantised by the share of rows before them in sorted order, sizes
by their logarithm. Sorted orders are range partitions with running sums; the driver sees one
row per partition and at most one row per cut.
Documents of equal text take the language and source of their first copy, hence lie side by
side. A cut that falls inside a run of equal texts moves to its nearer end if the run is within
``TOLERANCE`` of a shard, and stays inside it otherwise, so sizes are near equal in any case.

Rows: a null text has no bytes and counts as size 1; null languages and sources are values of
their own; repeated rows each take a slot; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.frames import small_or_not
from lotwise.session import checkpoint

BITS = 6
TOLERANCE = 0.01


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of integer coordinates below ``2 ** bits``.

    Level by level the bits of the coordinates are turned into the frame of the current
    subcube (Skilling, 2004): flip or exchange the lower bits, Gray decode, interleave.
    """
    x = axes.astype(np.int64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for k in range(n):
            on = (x[:, k] & bit) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, k]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, k] ^= swap
    for k in range(1, n):
        x[:, k] ^= x[:, k - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    index = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            index = (index << 1) | ((x[:, k] >> level) & 1)
    return index


def running(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``row_no`` and ``before``: rows and the sum of ``value`` ahead in the order."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(sizes)
            added = [np.full(len(sizes), part), np.arange(row, row + len(sizes)), ends - sizes]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, added)], [*b.schema.names, "part", "row_no", "before"])
            row, total = row + len(sizes), int(ends[-1]) if len(ends) else total

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    counted = checkpoint(placed.mapInArrow(count, f"{kinds}, part long, row_no long, before long"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = counted.groupBy("part").agg(F.count("*").alias("n"), F.sum(value).alias("s")).select(
        "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_ahead"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("sum_ahead")
    )
    return counted.join(F.broadcast(parts), "part").withColumn("row_no", F.col("row_no") + F.col("rows_ahead")).withColumn(
        "before", F.col("before") + F.col("sum_ahead")
    ).drop("part", "rows_ahead", "sum_ahead")


def shares(rows: DataFrame, column: str) -> DataFrame:
    """(value, step): the step of each value of ``column``, by the share of rows ahead of it."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    found = running(counts, ["value"], "n")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    return found.select("value", F.floor(F.col("before") * (1 << BITS) / total).cast("int").alias("step"))


def shards(docs: DataFrame, count: int = 16, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, size, text_crc32, curve, shard, slot): every row of ``docs`` with its place."""
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = checkpoint(docs.select(
        docs[key].cast("long").alias("key"), docs[lang].cast("string").alias("lang"), docs[source].cast("string").alias("source"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("same"),
    ))
    place = F.struct("key", "lang", "source")
    copies = checkpoint(rows.groupBy("same", "size").agg(F.min(place).alias("first"), F.min(F.struct("lang", "source")).alias("a"), F.max(F.struct("lang", "source")).alias("b")).where(
        "a <> b").select(F.col("same").alias("of"), F.col("size").alias("of_size"), F.col("first.lang").alias("own_lang"), F.col("first.source").alias("own_source"), F.lit(True).alias("has")))
    rows = rows.join(small_or_not(copies), (F.col("same") == F.col("of")) & (F.col("size") == F.col("of_size")), "left")
    rows = rows.withColumn("at_lang", F.when(F.col("has"), F.col("own_lang")).otherwise(F.col("lang"))).withColumn(
        "at_source", F.when(F.col("has"), F.col("own_source")).otherwise(F.col("source")))
    langs, sources = checkpoint(shares(rows, "at_lang")), checkpoint(shares(rows, "at_source"))
    rows = rows.join(small_or_not(langs.select(F.col("value").alias("l"), F.col("step").alias("x"))), F.col("at_lang").eqNullSafe(F.col("l")))
    rows = rows.join(small_or_not(sources.select(F.col("value").alias("s"), F.col("step").alias("y"))), F.col("at_source").eqNullSafe(F.col("s")))

    @F.pandas_udf("long")
    def curve(x, y, z):
        import pandas as pd

        return pd.Series(hilbert(np.stack([x, y, z], axis=1), BITS))

    level = F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.col("size")) * 3)).cast("int")
    ordered = running(
        rows.select("key", "size", "text_crc32", "same", curve("x", "y", level).alias("curve")),
        ["curve", "size", "same", "key"], "size",
    )
    ordered = checkpoint(ordered)
    cuts = cut_rows(ordered, count)
    ends = F.array(*(F.lit(c).cast("long") for c in [0, *cuts]))
    return ordered.withColumn("shard", (F.size(F.filter(ends, lambda c: c <= F.col("row_no"))) - 1).cast("int")).select(
        "key", "size", "text_crc32", "curve", "shard", (F.col("row_no") - F.get(ends, F.col("shard"))).alias("slot")
    )


def cut_rows(ordered: DataFrame, count: int) -> list[int]:
    """Row numbers at which shards 1, 2, ... start; the driver gets a row per cut."""
    total, n = ordered.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n:
        return [0] * (count - 1)
    step = total / count
    after = F.col("before") + F.col("size")

    def whole_shards(c: str) -> Column:
        return F.expr(f"CAST({c} AS DECIMAL(20, 0)) * {count} DIV {total}")  # whole numbers, so no cut is lost by rounding

    crossing = ordered.where(whole_shards("before") < whole_shards("before + size")).select("row_no", "before", "size", "same", "curve").collect()
    runs = {}
    if crossing:
        wanted = ordered.sparkSession.createDataFrame(list({(r.same, r.size, r.curve) for r in crossing}), "w_same long, w_size long, w_curve long")
        near = ordered.join(F.broadcast(wanted), (F.col("same") == F.col("w_same")) & (F.col("size") == F.col("w_size")) & (F.col("curve") == F.col("w_curve")))
        for r in near.groupBy("same", "size", "curve").agg(F.min("row_no").alias("lo"), F.max("row_no").alias("hi"), F.min("before").alias("start"), F.max(after).alias("end")).collect():
            runs[r.same, r.size, r.curve] = r
    cuts = []
    for k in range(1, count):
        target = step * k
        row = next(r for r in crossing if r.before * count < total * k <= (r.before + r.size) * count)
        run = runs[row.same, row.size, row.curve]
        lo, hi, start, end = run.lo, run.hi, run.start, run.end
        if end - start > TOLERANCE * step:  # a long run is cut inside
            lo, hi, start, end = row.row_no, row.row_no, row.before, row.before + row.size
        cuts.append(lo if target - start < end - target else hi + 1)
    return cuts
