"""Row numbers and trailing windows over series of any length.

A plain ordered window sorts a whole series in one task. Here rows are range
partitioned on (series, order), so one long series, or one order value shared by
many rows, spreads over many slices; slices are then stitched together with small
per-slice tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lotwise.session import checkpoint

SLICE = "__slice"


def sliced(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition on series and order and record the slice of every row.

    The slice numbers must not change between the branches that use them, so
    the result is checkpointed to reliable storage.
    """
    parts = df.repartitionByRange(*by, *order).withColumn(SLICE, F.spark_partition_id())
    return checkpoint(parts)


def with_row_number(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "row_number",
) -> DataFrame:
    """Exact row number (from 1) within each series; ``order`` must be unique."""
    by = list(by)
    rows = sliced(df, by, order)
    # at most one row per series and slice it touches
    sizes = rows.groupBy(*by, SLICE).agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*by or [F.lit(0)]).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, SLICE, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*by, SLICE).orderBy(*order)
    numbered = rows.withColumn(name, F.row_number().over(inside))
    return numbered.join(offsets, [*by, SLICE]).withColumn(
        name, F.col(name) + F.col("__before")
    ).drop(SLICE, "__before")


def value_at(df: DataFrame, column: str, rank: int) -> tuple[object, int]:
    """The value at ``rank`` (from 1) of the sorted column, and how many rows have a smaller one.

    Rows are counted by value before they are range partitioned, and only the
    slice that holds the rank is sorted.
    """
    counts = sliced(df.groupBy(column).agg(F.count("*").alias("__n")), [], [column])
    below = 0
    # a row per slice
    for size in counts.groupBy(SLICE).agg(F.sum("__n").alias("n")).orderBy(SLICE).collect():
        if below + size.n >= rank:
            break
        below += size.n
    running = Window.partitionBy(SLICE).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.filter(F.col(SLICE) == size[SLICE]).withColumn("__upto", F.sum("__n").over(running))
    found = upto.filter(F.col("__upto") >= rank - below).orderBy("__upto").first()
    return found[column], below + found["__upto"] - found["__n"]


def moving_average(
    df: DataFrame, value: str, order: Sequence[str], window: int = 7, by: Sequence[str] = (),
    name: str = "moving_average",
) -> DataFrame:
    """Mean over the current and the ``window - 1`` earlier rows of the series."""
    by, order = list(by), list(order)
    rows = sliced(df, by, order)
    if window > 1:
        rows = rows.withColumn("__own", F.lit(True)).unionByName(_lent_rows(rows, by, order, window))
    else:
        rows = rows.withColumn("__own", F.lit(True))
    trailing = Window.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(-(window - 1), 0)
    return rows.withColumn(name, F.avg(value).over(trailing)).filter("__own").drop("__own", SLICE)


def _lent_rows(rows: DataFrame, by: list[str], order: list[str], window: int) -> DataFrame:
    """The last rows before each slice, copied into it.

    A slice of a series usually borrows from the slice just before it. Slices
    shorter than the window pass on what they borrowed, which is why the last
    ``window - 1`` slices are looked at instead of one.
    """
    series = Window.partitionBy(*by or [F.lit(0)]).orderBy(SLICE)
    touched = rows.groupBy(*by, SLICE).agg(F.count("*").alias("__n"))
    # slices of one series, numbered without gaps: bounded by the partition count
    numbered = touched.select(*by, SLICE, F.row_number().over(series).alias("__s"))
    newest = Window.partitionBy(*by, SLICE).orderBy(*[F.desc(c) for c in order])
    tails = rows.withColumn("__nr", F.row_number().over(newest)).filter(F.col("__nr") < window)
    placed = tails.drop("__nr").join(numbered, [*by, SLICE])
    offered = placed.withColumn(
        "__to", F.explode(F.sequence(F.col("__s") + 1, F.col("__s") + F.lit(window - 1)))
    ).drop(SLICE, "__s")
    target = numbered.withColumnRenamed("__s", "__to")
    nearest = Window.partitionBy(*by, SLICE).orderBy(*[F.desc(c) for c in order])
    return (
        offered.join(target, [*by, "__to"]).withColumn("__nr", F.row_number().over(nearest))
        .filter(F.col("__nr") < window).select(*rows.columns, F.lit(False).alias("__own"))
    )
