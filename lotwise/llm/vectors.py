"""Integer vectors: quantised rows, classes of equal vectors, blocks that meet streams of queries.

A block holds a bounded number of classes; every query class is sent to every block and passes
through it in a stream, so a task holds one block and a few queries, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import checkpoint

BLOCK_ROWS = 1 << 15
QUERIES_AT_ONCE = 64
SMALL, INTEGER, DECIMAL = 0, 1, 2  # kinds of encoded vectors: 16 bits, 32 bits, decimal text
LONG = (1 << 63) - 1


def encoded(values: np.ndarray) -> bytes:
    """A vector of whole doubles as bytes: equal vectors have equal bytes."""
    most = np.abs(values).max(initial=0)
    if most < 1 << 15:
        return bytes([SMALL]) + values.astype("<i2").tobytes()
    if most < 1 << 31:
        return bytes([INTEGER]) + values.astype("<i4").tobytes()
    return bytes([DECIMAL]) + ",".join(str(int(v)) for v in values).encode()


def decoded(held: bytes) -> list[int] | np.ndarray:
    if held[0] == DECIMAL:
        return [int(v) for v in held[1:].split(b",")]
    return np.frombuffer(held, "<i2" if held[0] == SMALL else "<i4", offset=1)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of integers, shorter vectors filled up with zeros; an object array where one is beyond 32 bits."""
    rows = column.to_pylist()
    if rows and len(rows[0]) > 1 and rows[0][0] == SMALL and len({(r[0], len(r)) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)[:, 1:].copy().view("<i2").astype(np.int64)
    found = [decoded(r) for r in rows]
    wide = any(r[0] == DECIMAL for r in rows)
    out = np.zeros((len(rows), max(map(len, found), default=0)), object if wide else np.int64)
    for i, r in enumerate(found):
        out[i, :len(r)] = r
    return out


def quantised(rows: DataFrame, key: Column, vector: Column, scale: float, label: Column | None = None) -> DataFrame:
    """(key, [label,] q): floor(scale * x) of every component, encoded; equal rows once.

    Rows without a key or label, and vectors that are null or hold a null or a component whose
    product with ``scale`` is not finite, are left out.
    """
    x = lambda v: v.cast("double") * F.lit(float(scale))
    whole = F.forall(vector, lambda v: F.coalesce(F.abs(x(v)) < F.lit(float("inf")), F.lit(False)))
    chosen = [key.cast("long").alias("key"), *([label.cast("long").alias("label")] if label is not None else [])]
    names = ["key", "label"][:len(chosen)]
    given = rows.select(*chosen, F.when(whole, F.transform(vector, x)).alias("v"))
    given = given.where(F.col("v").isNotNull()).dropna(subset=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            ends = held.offsets.to_numpy()
            flat = np.floor(held.flatten().to_numpy(zero_copy_only=False)) + 0.0
            found = [encoded(flat[i:j]) for i, j in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*names, "q"])

    return given.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", q binary").distinct()


def classes(rows: DataFrame, by: list[str], keep: int) -> DataFrame:
    """(cid, *by, least, keys): a row per class of rows equal in ``by``, with its ``keep`` smallest keys.

    Of a class no other key can be among the first ``keep`` results, as its rows score alike and ties
    go by key. The window's limit works before the shuffle, so a class of any size sends few rows.
    """
    own = Window.partitionBy(*by).orderBy("key")
    few = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= keep)
    found = few.groupBy(*by).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    # numbered, then fixed by the checkpoint
    return checkpoint(found.select(F.monotonically_increasing_id().alias("cid"), *by, F.col("keys")[0].alias("least"), "keys"))


def block_count(rows: int, cores: int) -> int:
    """Blocks of at most ``BLOCK_ROWS`` rows on average, and enough of them to keep the cores busy."""
    return max(1, -(-rows // BLOCK_ROWS), min(cores, rows // 1024))


def met(candidates: DataFrame, queries: DataFrame, blocks: int, lists: int = 1) -> DataFrame:
    """Both sides dealt to the slots (list, block): a slot's candidates by ``least``, then all queries.

    ``candidates`` (cid, list, label, least, q) and ``queries`` (cid, list, label, marks, q); ``marks``
    is an array of longs that a query brings along.
    """
    block = F.pmod(F.xxhash64("cid"), F.lit(blocks))
    none = F.lit(None).cast("array<long>")
    slot = (F.col("list") * blocks + F.col("block")).cast("int").alias("slot")
    own = candidates.withColumn("block", block).select(slot, F.lit(0).alias("role"), "cid", "label", "least", none.alias("marks"), "q")
    every = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        slot, F.lit(1).alias("role"), "cid", "label", F.lit(0).cast("long").alias("least"), "marks", "q")
    return own.unionByName(every).repartitionById(blocks * lists, F.col("slot")).sortWithinPartitions("slot", "role", "least", "cid")


def visits(batches: Iterator[pa.RecordBatch], build: Callable[[pa.Table], object]) -> Iterator[tuple[object, pa.RecordBatch]]:
    """(block, queries): for every slot the built block with each of its short batches of queries."""
    slot, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        slots, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((slots[1:] != slots[:-1]) | (roles[1:] != roles[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, len(slots)]):
            if slots[i] != slot:
                slot, held, block = slots[i], [], None
            if roles[i] == 0:
                held.append(batch.slice(i, j - i))
                continue
            if block is None and held:
                block, held = build(pa.Table.from_batches(held)), []
            if block is not None:
                for at in range(i, j, QUERIES_AT_ONCE):
                    yield block, batch.slice(at, min(QUERIES_AT_ONCE, j - at))


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    found = table.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.hstack([x, np.zeros((len(x), width - x.shape[1]), x.dtype)]) if x.shape[1] < width else x for x in (a, b))


def as_longs(scores: np.ndarray) -> np.ndarray:
    """Scores in the range of a long; beyond it they are its bounds."""
    return scores if scores.dtype == np.int64 else np.clip(scores, -LONG, LONG).astype(np.int64)
