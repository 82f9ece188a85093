"""Small helpers on DataFrames that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.session import checkpoint, checkpoint_folder

BROADCAST_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_or_not(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only for a frame counted to be small. ``frame`` must be cheap to read twice."""
    few = frame.limit(most + 1).count() <= most
    return F.broadcast(frame) if few else frame


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b), root being the smallest node reachable.

    Alternating large-star and small-star rounds: each replaces a node's links by links to
    its smallest neighbour, so the links end as one star per component. A round is two
    aggregations and two joins on the links; its result is checkpointed.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")
        )
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = (
            large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b")
        )
        edges = checkpoint(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written as Parquet to the shared folder and read again: its lineage ends there."""
    path = f"{checkpoint_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
