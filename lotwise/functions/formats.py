"""Small scalar expressions: safe ratios, labels and number texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NumericType, ShortType


def percent(part: Column, whole: Column) -> Column:
    """Percentage, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def number_text(c: Column, pattern: str = "%.3f") -> Column:
    return F.when(c.isNotNull(), F.format_string(pattern, c.cast("double"))).otherwise("n/a")


def cell_text(df: DataFrame, column: str) -> Column:
    """A table cell: whole numbers in groups of three digits, other numbers with three decimals, nothing for NULL."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        text = F.format_number(c, 0)
    elif isinstance(kind, NumericType):
        text = F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.format_string("%.3f", c.cast("double")))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def range_number_text(c: Column) -> Column:
    """Compact end point of a range: one decimal from 10 up, else three digits."""
    size = F.abs(c)
    decimals = F.greatest(F.lit(0), F.lit(2) - F.floor(F.log10(size)).cast("int"))
    small = F.format_string("%.3f", c)
    for places in (4, 5, 6):
        small = F.when(decimals >= places, F.format_string(f"%.{places}f", c)).otherwise(small)
    text = (
        F.when(size >= 10, F.format_string("%.1f", c))
        .when(size >= 1, F.format_string("%.2f", c))
        .when(size == 0, F.lit("0"))
        .when(size < 1e-4, F.format_string("%.2e", c))
        .otherwise(small)
    )
    return F.when(
        F.contains(text, F.lit(".")) & ~F.contains(text, F.lit("e")),
        F.regexp_replace(text, r"\.?0+$", ""),
    ).otherwise(text)


def correlation_direction(r: Column) -> Column:
    return (
        F.when(r.isNull(), "not_available")
        .when(r >= 0.25, "positive_linear_association")
        .when(r <= -0.25, "negative_linear_association")
        .otherwise("weak_or_non_linear_linear_signal")
    )


def score_text(score: Column) -> Column:
    label = F.when(score >= 0.50, "strong").when(score >= 0.20, "moderate").otherwise("weak/exploratory")
    return F.concat(label, F.lit(" ("), number_text(score), F.lit(")"))


def share_of_max(c: Column, partition: Sequence[str] = ()) -> Column:
    """Score between 0 and 1 relative to the largest value of its partition.

    Meant for result tables with one row per variable, where the window is
    bounded by the number of columns.
    """
    floor = F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    top = F.max(floor).over(Window.partitionBy(*[F.col(p) for p in partition] or [F.lit(0)]))
    return F.coalesce(F.try_divide(floor, top), F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson r on complete pairs; NULL for a constant column."""
    both = x.isNotNull() & y.isNotNull()
    cx, cy = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(cx, cy), F.stddev_samp(cx) * F.stddev_samp(cy))


def rounded(df, digits: int = 3):
    """Display projection: round every double column."""
    return df.select(
        [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
