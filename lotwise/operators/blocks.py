"""Sums of matrices over a table: one block of bytes per task, added up in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "part string, block binary"
FAN_IN = 64


def block_rows(totals: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": list(totals), "block": [np.ascontiguousarray(t, np.float64).tobytes() for t in totals.values()]},
        schema=pa.schema([("part", pa.string()), ("block", pa.binary())]))


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block per part from the blocks of a task; one other block is held at a time."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, block in zip(batch.column(0), batch.column(1)):
            own = np.frombuffer(block.as_buffer(), np.float64)
            name = part.as_py()
            if name in totals:
                totals[name] += own
            else:
                totals[name] = own.copy()
    if totals:
        yield block_rows(totals)


def summed_blocks(rows: DataFrame, sums) -> dict[str, np.ndarray]:
    """Run the task function ``sums`` over ``rows`` and add its blocks by part.

    There is a block per core, however many splits the input has; with many cores
    blocks are first added in groups. The driver gets one block per part.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = rows.coalesce(cores).mapInArrow(sums, SCHEMA)
    if cores > FAN_IN:
        groups = blocks.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(-(-cores // FAN_IN))))
        blocks = groups.repartition("part", "g").select("part", "block").mapInArrow(add_blocks, SCHEMA)
    done = blocks.repartition("part").mapInArrow(add_blocks, SCHEMA)
    return {r.part: np.frombuffer(r.block, np.float64) for r in done.collect()}
