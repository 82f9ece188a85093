"""Tables behind the usual charts; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from lotwise.operators.audit import DATE_FORMATS
from lotwise.operators.limits import limit_zone, measured_rows
from lotwise.operators.ordering import moving_average
from lotwise.operators.quantiles import exact_quantiles
from lotwise.operators.reshape import field_type, number_column

ORDER_SHARE = 0.80


def order_value(df: DataFrame, column: str, dates_need_share: bool = True) -> Column:
    """Sortable number of an order column: time stamp, number, or date text.

    Text columns start one aggregate that decides how to read them.
    """
    dtype = field_type(df, column)
    if isinstance(dtype, (TimestampType, DateType, TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    number = number_column(df, column)
    if isinstance(dtype, NumericType):
        return number
    text = F.col(column).cast("string")
    date = F.unix_micros(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])).cast("double")
    n, numbers, dates = df.agg(F.count("*"), F.count(number), F.count(date)).first()
    if n and numbers / n >= ORDER_SHARE:
        return number
    if n and (dates / n >= ORDER_SHARE or not dates_need_share):
        return date
    return F.lit(None).cast("double")


def ordered_outcome(
    df: DataFrame, outcome: str, order_by: str, key: str = "batch_id", keep: Sequence[str] = (),
) -> DataFrame:
    """``key, order_value, outcome_value`` of rows that have both, and the columns ``keep``, e.g. a colour."""
    return df.select(
        key, order_value(df, order_by, dates_need_share=False).alias("order_value"),
        number_column(df, outcome).alias("outcome_value"), *keep,
    ).dropna(subset=["order_value", "outcome_value"])


def trend(rows: DataFrame, key: str = "batch_id", window: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Ordered outcome with its trailing mean; equal order values go by key."""
    return moving_average(rows, "outcome_value", ["order_value", key], window, by)


def control_limits(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and three-sigma limits per series; combined before the shuffle."""
    std = F.stddev_samp("outcome_value")
    return rows.groupBy(*by).agg(
        F.count("outcome_value").alias("row_count"), F.avg("outcome_value").alias("mean"),
        (F.avg("outcome_value") - 3.0 * std).alias("lower_control_limit"),
        (F.avg("outcome_value") + 3.0 * std).alias("upper_control_limit"),
    )


def control_chart(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row next to the limits of its series, with its status.

    The join on the series keys is left to the optimizer, which broadcasts few
    series and splits a hot one.
    """
    limits = control_limits(rows, by).drop("row_count")
    value = F.col("outcome_value")
    outside = (value > F.col("upper_control_limit")) | (value < F.col("lower_control_limit"))
    return rows.join(limits, list(by)).withColumn(
        "status", F.when(outside, "Outside 3 sigma").otherwise("Inside limits")
    )


def control_violations(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return control_chart(rows, by).filter(F.col("status") == "Outside 3 sigma")


def variable_with_zone(
    df: DataFrame, limits: DataFrame, variables: Sequence[str], outcome: str, key: str = "batch_id",
) -> DataFrame:
    """Outcome against each variable with its chart zone, one row per point."""
    data = df.withColumn("__y", number_column(df, outcome))
    rows = measured_rows(data, limits, variables, keep=[key, "__y"])
    return rows.filter(F.col("value").isNotNull() & F.col("__y").isNotNull()).select(
        key, "variable", "value", F.col("__y").alias("outcome_value"), limit_zone(F.col("value")).alias("zone")
    )


def margin_bars(summary: DataFrame, top: int | None = None) -> DataFrame:
    """Limits rows by their share outside, the largest first; all, or a chart of ``top`` bars."""
    rows = summary.select(
        "variable", "role", "percent_outside", "percent_close_to_limit", "classification"
    ).orderBy(F.desc("percent_outside"), "variable")
    return rows if top is None else rows.limit(top)


def distribution_lines(df: DataFrame, column: str, limits: DataFrame | None = None) -> DataFrame:
    """Reference lines of a histogram: ``line, value`` for mean, median and limits."""
    value = number_column(df, column)
    mean = df.agg(F.avg(value).alias("value")).select(F.lit("mean").alias("line"), "value")
    median = exact_quantiles(df.select(value.alias("v")), [], "v", [0.5]).select(
        F.lit("median").alias("line"), F.col("quantiles")[0].alias("value"))
    lines = mean.unionByName(median)
    if limits is not None:
        cells = F.array(*[
            F.struct(F.lit(c).alias("line"), F.col(c).alias("value"))
            for c in ("target", "lower_limit", "upper_limit")
        ])
        lines = lines.unionByName(
            limits.filter(F.col("variable") == column).select(F.inline(cells)))
    return lines.filter(F.col("value").isNotNull())


def top_loadings(loadings: DataFrame, top: int | None = None) -> DataFrame:
    """Features farthest from the origin on the first two components."""
    wide = loadings.groupBy("feature", "process_variable").pivot("component", ["PC1", "PC2"]).agg(F.first("loading"))
    distance = F.hypot(F.coalesce("PC1", F.lit(0.0)), F.coalesce("PC2", F.lit(0.0)))
    rows = wide.withColumn("distance", distance).orderBy(F.desc("distance"), "feature")
    return rows if top is None else rows.limit(top)


def stacked_scores(ranked: DataFrame) -> DataFrame:
    """Ranking in long form: ``outcome, rank, process_variable, method, score``."""
    return ranked.unpivot(
        ["outcome", "rank", "process_variable"], ["pca_score", "pls_score", "rf_score"], "method", "score"
    )


def overview(ranked: DataFrame) -> DataFrame:
    """Counts of high and medium drivers per outcome."""
    level = F.col("confidence")
    return ranked.groupBy("outcome").agg(
        F.count("*").alias("driver_count"), F.count_if(level == "high").alias("high_count"),
        F.count_if(level == "medium").alias("medium_count"),
        F.max_by("process_variable", -F.col("rank")).alias("top_driver"),
    )


def colour_candidates(types: DataFrame, most: int = 20) -> DataFrame:
    return types.filter(
        F.col("type").isin("categorical", "binary") & (F.col("unique_count") <= most)
    ).select("column")
