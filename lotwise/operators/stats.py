"""Column statistics shared by profiling, audit, limits and models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ByteType, DoubleType, IntegerType, LongType, NumericType, ShortType

from lotwise.operators.blocks import block_rows, summed_blocks
from lotwise.operators.reshape import field_type, number_column, to_long
from lotwise.session import checkpoint

# Wider tables switch from one wide aggregate to the long form, because very
# wide aggregates outgrow a generated method and fall back to interpretation.
WIDE_LIMIT = 60
# Values are counted in one of these types, see ``value_frequencies``.
CELL_KINDS = ["bigint", "double", "string"]
# Where bounds are enough, values are counted by this many buckets of their hash.
BUCKETS = 256


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(field_type(df, column), NumericType)


def column_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable, row_count, count, missing_count, mean, std, var, min, max``.

    ``count`` and the moments are about plain numbers, ``missing_count`` about
    rows without one. One pass, one small exchange.
    """
    def facts(v: Column) -> list[Column]:
        return [
            F.count("*").alias("row_count"), F.count(v).alias("count"),
            (F.count("*") - F.count(v)).alias("missing_count"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var"),
            F.min(v).alias("min"), F.max(v).alias("max"),
        ]

    if len(columns) > WIDE_LIMIT:
        found = to_long(df, columns).groupBy("variable").agg(*facts(F.col("value")))
        names = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
        counts = ["row_count", "count", "missing_count"]
        return names.join(F.broadcast(found), "variable", "left").fillna(0, counts).select(found.columns)
    cells = [
        F.struct(F.lit(c).alias("variable"), *facts(number_column(df, c))) for c in columns
    ]
    return df.agg(F.array(*cells).alias("facts")).select(F.inline("facts"))


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable, row_count, missing_count`` with NULL as the only missing mark."""
    cells = [
        F.struct(
            F.lit(c).alias("variable"), F.count("*").alias("row_count"),
            F.count_if(F.col(c).isNull()).alias("missing_count"),
        )
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("facts")).select(F.inline("facts"))


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable, value, n`` of every non-NULL value, combined before the shuffle.

    The shuffle key is the variable and the value in its own type, so neither a
    long column nor a frequent value ends up in one task, and only distinct
    values are turned into text.
    """
    kinds = {c: _cell_kind(df, c) for c in columns}
    cells = [
        F.struct(F.lit(c).alias("variable"), *[
            (_plain_cell(df, c) if kinds[c] == k else F.lit(None)).cast(k).alias(k) for k in CELL_KINDS
        ])
        for c in columns
    ]
    text = F.coalesce(*[F.col(k).cast("string") for k in CELL_KINDS])
    return (
        df.select(F.inline(F.array(*cells))).dropna("all", subset=CELL_KINDS)
        .groupBy("variable", *CELL_KINDS).agg(F.count("*").alias("n"))
        .select("variable", text.alias("value"), "n")
    )


def _cell_kind(df: DataFrame, column: str) -> str:
    """The type that holds a column's values and gives them the column's own text."""
    dtype = field_type(df, column)
    if isinstance(dtype, (ByteType, ShortType, IntegerType, LongType)):
        return "bigint"
    return "double" if isinstance(dtype, DoubleType) else "string"


def _plain_cell(df: DataFrame, column: str) -> Column:
    """-0.0 and 0.0 are one value, so adding zero makes both the same."""
    return F.col(column) + 0 if is_numeric(df, column) else F.col(column)


def value_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable, non_missing, at_least, top_at_most`` without a shuffle of values.

    Rows are counted by (column, hash bucket), ``BUCKETS`` rows a column at most
    from each task. A bucket in use holds one value or, if its hashes differ, two
    or more: their sum is a lower bound of the distinct values. The fullest
    bucket is an upper bound of the most frequent value's rows. Both bounds are
    certain; columns they leave open are for ``distinct_facts``.
    """
    cells = [
        F.struct(F.lit(c).alias("variable"), F.when(
            F.col(c).isNotNull(), F.xxhash64(_plain_cell(df, c))).alias("hash"))
        for c in columns
    ]
    found = _bounds(df.select(F.inline(F.array(*cells))).filter(F.col("hash").isNotNull()))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    return names.join(F.broadcast(found), "variable", "left").fillna(0)  # a row per column


def _bounds(hashes: DataFrame) -> DataFrame:
    """The bounds from rows ``variable, hash``."""
    buckets = hashes.groupBy("variable", F.pmod("hash", F.lit(BUCKETS)).alias("bucket")).agg(
        F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high")
    )
    return buckets.groupBy("variable").agg(
        F.sum("n").alias("non_missing"), F.sum(F.when(F.col("low") < F.col("high"), 2).otherwise(1)).alias("at_least"),
        F.max("n").alias("top_at_most"),
    )


def varied(rows: DataFrame, least: int) -> DataFrame:
    """``variable`` of long rows ``variable, value`` with ``least`` or more distinct numbers.

    Bounds by hash buckets decide at once for columns of many values; only the
    variables below ``least`` buckets, which hold few values, are counted exactly.
    """
    value = F.col("value") + 0
    bounds = _bounds(rows.filter(F.col("value").isNotNull()).select("variable", F.xxhash64(value).alias("hash")))
    bounds = checkpoint(bounds.select("variable", "at_least"))  # a row per variable, read twice
    open_ones = bounds.filter(F.col("at_least") < least).select("variable")
    counted = (
        rows.filter(F.col("value").isNotNull()).join(F.broadcast(open_ones), "variable", "left_semi")
        .groupBy("variable", value.alias("value")).agg(F.lit(1).alias("one"))
        .groupBy("variable").agg(F.count("*").alias("distinct_values"))
    )
    return bounds.filter(F.col("at_least") >= least).select("variable").unionByName(
        counted.filter(F.col("distinct_values") >= least).select("variable"))


def distinct_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable, non_missing, unique_count, top_value, top_count``.

    Equally frequent values: the smallest text is the top value.
    """
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "variable string, non_missing bigint, unique_count bigint, top_value string, top_count bigint")
    seen = (
        value_frequencies(df, columns).groupBy("variable")
        .agg(
            F.sum("n").alias("non_missing"), F.count("*").alias("unique_count"),
            F.max("n").alias("top_count"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
        )
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    return names.join(F.broadcast(seen), "variable", "left").select(
        "variable", F.coalesce("non_missing", F.lit(0)).alias("non_missing"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "top_value", F.coalesce("top_count", F.lit(0)).alias("top_count"),
    )


def level_facts(df: DataFrame, columns: Sequence[str], bounds: DataFrame | None = None) -> DataFrame:
    """``distinct_facts`` of the columns that can be categorical or binary.

    Numbers of three or more values are left out by their bounds, so no
    continuous column is shuffled by value.
    """
    numeric = [c for c in columns if is_numeric(df, c)]
    few: set[str] = set()
    if numeric:
        bounds = bounds if bounds is not None else value_bounds(df, numeric)
        few = {r.variable for r in bounds.filter(F.col("at_least") <= 2).select("variable").collect()}
    return distinct_facts(df, [c for c in columns if c not in numeric or c in few])


# --------------------------------------------------------------------------
# Pairs of columns
# --------------------------------------------------------------------------

PAIR_SCHEMA = "first string, second string, n bigint, correlation double"


def _pair_sums(size: int, centre: np.ndarray):
    """Task function: pairwise-complete sums of products of one task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, size, size))
        for batch in batches:
            block = np.column_stack([
                batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(size)
            ]) - centre
            seen = ~np.isnan(block)
            block = np.where(seen, block, 0.0)
            mask = seen.astype(float)
            total[0] += mask.T @ mask
            total[1] += block.T @ mask              # sum of i where j is present
            total[2] += (block * block).T @ mask    # squares of i where j is present
            total[3] += block.T @ block
        yield block_rows({"all": total})

    return sums


def _all_correlations(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and Pearson r of all pairs through matrix products, in one pass."""
    columns = list(columns)
    size = len(columns)
    means = {r.variable: r.mean for r in column_facts(df, columns).select("variable", "mean").collect()}
    centre = np.array([means[c] if means[c] is not None else 0.0 for c in columns])
    numbers = df.select(*[number_column(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    found = summed_blocks(numbers, _pair_sums(size, centre))
    n, one, square, product = found.get("all", np.zeros(4 * size * size)).reshape(4, size, size)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = product - one * one.T / n
        spread = square - one * one / n
        # what is left of the squares after centring must exceed rounding noise
        safe = (spread > 1e-12 * square) & (spread.T > 1e-12 * square.T)
        r = np.where(safe, cov / np.sqrt(spread * spread.T), np.nan)
    return n.astype(np.int64), r


def pair_correlations(
    df: DataFrame, columns: Sequence[str], others: Sequence[str] | None = None,
) -> DataFrame:
    """Pearson r of column pairs on their pairwise complete rows.

    All unordered pairs of ``columns``, or every column with every one of
    ``others``. Rows ``first, second, n, correlation``, bounded by the schema.
    """
    if others is None:
        pairs = list(combinations(columns, 2))
    else:
        pairs = [(a, b) for a in columns for b in others]
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    names = list(dict.fromkeys([*columns, *(others or [])]))
    place = {c: i for i, c in enumerate(names)}
    n, r = _all_correlations(df, names)
    rows = [
        (a, b, int(n[place[a], place[b]]), None if np.isnan(r[place[a], place[b]]) else float(r[place[a], place[b]]))
        for a, b in pairs
    ]
    return df.sparkSession.createDataFrame(rows, PAIR_SCHEMA)


def three_values(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> set[tuple[str, str]]:
    """Pairs whose second column has three distinct values where the first is present.

    A third value exists when something lies strictly between the extremes, so
    two small aggregates are enough and no value is shuffled.
    """
    if not pairs:
        return set()

    def present(pair: tuple[str, str]) -> Column:
        return F.when(number_column(df, pair[0]).isNotNull(), number_column(df, pair[1]))

    ends = df.agg(*[
        agg(present(p)).alias(f"{name}{i}")
        for i, p in enumerate(pairs) for name, agg in (("lo", F.min), ("hi", F.max))
    ]).first()
    between = df.agg(*[
        F.count_if((present(p) > F.lit(ends[f"lo{i}"])) & (present(p) < F.lit(ends[f"hi{i}"]))).alias(f"b{i}")
        for i, p in enumerate(pairs)
    ]).first()
    return {p for i, p in enumerate(pairs) if between[f"b{i}"]}


# --------------------------------------------------------------------------
# Outcome tables
# --------------------------------------------------------------------------

def outcome_statistics(df: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Count, missing share, mean, standard deviation, extremes, exact median."""
    from lotwise.operators.quantiles import column_quantiles

    medians = column_quantiles(df, outcomes, [0.5]).select("variable", F.col("quantiles")[0].alias("median"))
    return column_facts(df, outcomes).join(F.broadcast(medians), "variable", "left").select(
        F.col("variable").alias("outcome"), "count", "missing_count",
        F.coalesce(F.try_divide(100.0 * F.col("missing_count"), F.col("row_count")), F.lit(0.0)).alias("missing_percent"),
        "mean", "std", "min", "median", "max",
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins with the last one closed; empty bins are listed too."""
    value = number_column(df, column)
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    schema = "bin bigint, bin_start double, bin_end double, row_count bigint"
    if ends.lo is None:
        return df.sparkSession.createDataFrame([], schema)
    lo, hi = (ends.lo, ends.hi) if ends.hi > ends.lo else (ends.lo - 0.5, ends.hi + 0.5)
    width = (hi - lo) / bins
    number = F.least(F.floor((value - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)).cast("bigint")
    counted = df.filter(value.isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("row_count"))
    return df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin")).join(
        counted, "bin", "left"
    ).select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_end"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )


def distinct_levels(df: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """Sorted distinct levels per column: ``variable, position, level``.

    All levels, or ``most`` per variable; that limit reaches the rows before
    they are shuffled for the ranking.
    """
    levels = value_frequencies(df, columns).select("variable", F.col("value").alias("level"))
    order = Window.partitionBy("variable").orderBy("level")
    return levels.withColumn("position", F.row_number().over(order)).filter(
        F.lit(True) if most is None else F.col("position") <= most
    ).select("variable", F.col("position").cast("bigint").alias("position"), "level")
