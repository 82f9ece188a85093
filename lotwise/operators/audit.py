"""Checks that show how a historical table can mislead; nothing is removed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from lotwise.functions import names
from lotwise.functions.formats import percent
from lotwise.operators.quantiles import column_quantiles
from lotwise.operators.reshape import field_type, to_long
from lotwise.operators.stats import is_numeric, level_facts, pair_correlations, three_values
from lotwise.session import checkpoint, stored

LEAKAGE_CORRELATION = 0.95
COLLINEAR_CORRELATION = 0.85
MANY_LEVELS = 20
MANY_LEVELS_SHARE = 0.20
MINIMUM_PAIRS = 8
DATE_SHARE = 0.80

# Date notations tried one after the other; extend per site if needed.
DATE_FORMATS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MMM-yyyy",
]


@dataclass(frozen=True)
class Audit:
    guidance: DataFrame
    leakage_names: DataFrame
    leakage_correlations: DataFrame
    drift_columns: DataFrame
    many_levels: DataFrame
    confounding: DataFrame
    row_missing: DataFrame
    outliers: DataFrame
    collinear: DataFrame
    warnings: DataFrame


def sample_size_guidance(df: DataFrame) -> DataFrame:
    n = F.col("batch_count")
    return df.agg(F.count("*").alias("batch_count")).select(
        "batch_count",
        F.when(n < 10, "under_10").when(n < 30, "under_30").when(n < 80, "under_80")
        .otherwise("80_or_more").alias("guidance"),
    )


def leakage_names(spark, columns: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Columns whose names hint at post-release information; schema only."""
    tokens = [w for w in names.outcome_words(outcomes) if len(w) >= 4]
    found = {
        c: sorted({*names.matching_words(c, names.LEAKAGE_WORDS), *names.matching_words(c, tokens)})
        for c in columns
    }
    return spark.createDataFrame(
        [(c, ", ".join(w)) for c, w in found.items() if w], "column string, matched_terms string"
    )


def leakage_correlations(df: DataFrame, columns: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Process columns that nearly equal an outcome on their complete pairs."""
    strong = pair_correlations(df, columns, outcomes).filter(
        (F.col("n") >= MINIMUM_PAIRS) & (F.abs("correlation") >= LEAKAGE_CORRELATION)
    )
    hits = [tuple(r) for r in strong.select("first", "second", "n", "correlation").collect()]
    pairs = [h[:2] for h in hits]
    # the feature must vary on the whole column, the outcome on the pair rows
    varied = three_values(df, [(c, c) for c in dict.fromkeys(p[0] for p in pairs)])
    enough = {p for p in three_values(df, pairs) if (p[0], p[0]) in varied}
    return df.sparkSession.createDataFrame(
        [h for h in hits if h[:2] in enough],
        "process_column string, outcome string, n bigint, correlation double",
    ).withColumn("absolute_correlation", F.abs("correlation"))


def parses_as_date(c: Column) -> Column:
    text = c.cast("string")
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries).isNotNull()


def drift_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that hold time or running order, by name or by content."""
    def kind(c: str) -> str:
        dtype = field_type(df, c)
        if isinstance(dtype, (TimestampType, TimestampNTZType, DateType)):
            return "date"
        return "number" if isinstance(dtype, NumericType) else "text"

    def share(c: str) -> Column:
        if kind(c) == "date":
            return F.when(F.count(c) > 0, 1.0).otherwise(0.0)
        if kind(c) == "number":
            return F.lit(0.0)
        hit = F.count_if(F.col(c).isNotNull() & parses_as_date(F.col(c)))
        return F.coalesce(F.try_divide(hit, F.count(c)), F.lit(0.0))

    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(", ".join(names.matching_words(c, names.DRIFT_WORDS))).alias("terms"),
            share(c).alias("parseable_date_fraction"),
        )
        for c in columns
    ]
    found = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return found.filter(
        (F.col("terms") != "") | (F.col("parseable_date_fraction") >= DATE_SHARE)
    ).select(
        "column",
        F.when(F.col("terms") == "", "date-like values").otherwise(F.col("terms")).alias("matched_terms"),
        "parseable_date_fraction",
    )


def _level_columns(df: DataFrame, columns: Sequence[str]) -> Column:
    """Categorical or binary, as the type table decides."""
    numeric = [c for c in columns if is_numeric(df, c)]
    return (F.col("unique_count") <= 2) | ~F.col("variable").isin(numeric)


def many_levels(df: DataFrame, columns: Sequence[str], facts: DataFrame | None = None) -> DataFrame:
    facts = facts if facts is not None else level_facts(df, columns)
    rows = df.agg(F.count("*").alias("row_count"))
    share = F.col("unique_count") / F.greatest(F.col("row_count"), F.lit(1))
    single = facts.withColumn("one", F.lit(1)).join(
        F.broadcast(rows.withColumn("one", F.lit(1))), "one"  # row count of the table, one row
    )
    return single.filter(_level_columns(df, columns)).select(
        F.col("variable").alias("column"), "unique_count", share.alias("unique_ratio")
    ).filter((F.col("unique_count") >= MANY_LEVELS) | (F.col("unique_ratio") >= MANY_LEVELS_SHARE))


def confounding(df: DataFrame, columns: Sequence[str], facts: DataFrame | None = None) -> DataFrame:
    """Lot, staff or equipment columns with their level count and top level."""
    terms = {c: ", ".join(names.matching_words(c, names.CONFOUNDING_WORDS)) for c in columns}
    named = [c for c, t in terms.items() if t]
    if not named:
        return df.sparkSession.createDataFrame(
            [], "column string, matched_terms string, unique_count bigint, "
                "most_common_level string, most_common_level_percent double",
        )
    facts = facts if facts is not None else level_facts(df, named)
    term = F.create_map(*[F.lit(x) for c in named for x in (c, terms[c])])
    return facts.filter(F.col("variable").isin(named) & _level_columns(df, columns)).select(
        F.col("variable").alias("column"), term[F.col("variable")].alias("matched_terms"), "unique_count",
        F.coalesce("top_value", F.lit("")).alias("most_common_level"),
        percent(F.col("top_count"), F.col("non_missing")).alias("most_common_level_percent"),
    )


def row_missing(df: DataFrame, columns: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Rows with a missing cell: in any, in a process, in an outcome column."""
    def any_null(cs: Sequence[str]) -> Column:
        return F.exists(F.array(*[F.col(c).isNull() for c in cs]), lambda x: x) if cs else F.lit(False)

    groups = [
        ("rows_with_any_missing_selected_field", [*columns, *outcomes]),
        ("rows_with_missing_process_field", columns),
        ("rows_with_missing_outcome_field", outcomes),
    ]
    cells = [
        F.struct(
            F.lit(name).alias("metric"), F.count_if(any_null(cs)).alias("count"),
            percent(F.count_if(any_null(cs)), F.count("*")).alias("percent"),
        )
        for name, cs in groups
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values beyond 1.5 interquartile ranges per column; exact quartiles.

    The four-distinct-values rule needs no distinct count: three inner values
    between the extremes differ exactly when two inner extremes differ.
    """
    q = F.col("quantiles")
    iqr = q[1] - q[0]
    fences = column_quantiles(df, columns, [0.25, 0.75, 0.0, 1.0]).filter(iqr > 0).select(
        "variable", "n", (q[0] - 1.5 * iqr).alias("low"), (q[1] + 1.5 * iqr).alias("high"),
        q[2].alias("least"), q[3].alias("most"),
    )
    value = F.col("value")
    inner = F.when((value > F.col("least")) & (value < F.col("most")), value)
    flagged = to_long(df, columns).join(F.broadcast(fences), "variable").groupBy(
        F.col("variable").alias("column"), "n", "low", "high"
    ).agg(
        F.count_if((value < F.col("low")) | (value > F.col("high"))).alias("outlier_count"),
        F.min(inner).alias("inner_low"), F.max(inner).alias("inner_high"),
    )
    return flagged.filter((F.col("outlier_count") > 0) & (F.col("inner_low") < F.col("inner_high"))).select(
        "column", "outlier_count", percent(F.col("outlier_count"), F.col("n")).alias("outlier_percent"),
        F.col("low").alias("lower_flag_limit"), F.col("high").alias("upper_flag_limit"),
    )


def collinear_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric process column pairs with a high correlation."""
    numeric = [c for c in columns if is_numeric(df, c)]
    strong = pair_correlations(df, numeric).filter(
        (F.col("n") >= MINIMUM_PAIRS) & (F.abs("correlation") >= COLLINEAR_CORRELATION)
    )
    hits = [tuple(r) for r in strong.select("first", "second", "n", "correlation").collect()]
    used = list(dict.fromkeys(c for h in hits for c in h[:2]))
    varied = {c for c, _ in three_values(df, [(c, c) for c in used])}
    return df.sparkSession.createDataFrame(
        [h for h in hits if h[0] in varied and h[1] in varied],
        "first_column string, second_column string, n bigint, correlation double",
    ).withColumn("absolute_correlation", F.abs("correlation"))


def audit_warnings(
    guidance: DataFrame, counted: Sequence[tuple[str, DataFrame, str]], missing: DataFrame,
) -> DataFrame:
    """Warning rows ``seq, code, message`` from the tables of the audit."""
    n = F.col("batch_count")
    size = guidance.filter(n < 80).select(
        F.lit(0).alias("seq"), F.lit("sample_size").alias("code"),
        F.when(n < 30, "Fewer than 30 batches: results are exploratory.")
        .otherwise("Fewer than 80 batches: advanced models may overfit.").alias("message"),
    )
    share = F.col("percent")
    gaps = missing.filter(
        (F.col("metric") == "rows_with_any_missing_selected_field") & (share > 20)
    ).select(
        F.lit(6).alias("seq"), F.lit("row_missing").alias("code"),
        F.format_string("%.1f%% of rows miss at least one selected field.", share).alias("message"),
    )
    rows = size.unionByName(gaps)
    for seq, (code, table, text) in enumerate(counted, start=1):
        hits = table.agg(F.count("*").alias("hits")).filter(F.col("hits") > 0)
        rows = rows.unionByName(hits.select(
            F.lit(seq + (seq > 5)).alias("seq"), F.lit(code).alias("code"),
            F.concat(F.format_string("%d ", F.col("hits")), F.lit(text)).alias("message"),
        ))
    return rows


def run_audit(df: DataFrame, columns: Sequence[str], outcomes: Sequence[str]) -> Audit:
    """All audit tables; frequencies of level columns are shared, quantiles and pairs are one pass each.

    The selected columns are written once, since the tables read them a dozen times and ``df`` may be a join.
    """
    df = df.sparkSession.read.parquet(stored(df.select(*dict.fromkeys([*columns, *outcomes]))))
    facts = checkpoint(level_facts(df, columns))  # a row per level column, read by two tables
    guidance = sample_size_guidance(df)
    by_name = leakage_names(df.sparkSession, columns, outcomes)
    by_value = leakage_correlations(df, columns, outcomes)
    drift = drift_columns(df, columns)
    levels = many_levels(df, columns, facts)
    grouped = confounding(df, columns, facts)
    missing = row_missing(df, columns, outcomes)
    extreme = outliers(df, [*columns, *outcomes])
    pairs = collinear_pairs(df, columns)
    warnings = audit_warnings(guidance, [
        ("leakage_names", by_name, "process column name(s) hint at post-release information."),
        ("leakage_correlations", by_value, "feature and outcome pair(s) are nearly identical."),
        ("drift", drift, "column(s) may encode time, sequence or campaign."),
        ("many_levels", levels, "categorical column(s) have many levels."),
        ("confounding", grouped, "categorical column(s) may be confounded with time or practice."),
        ("outliers", extreme, "numeric column(s) hold outliers; review, do not drop."),
        ("collinear", pairs, "process variable pair(s) are highly correlated."),
    ], missing)
    return Audit(
        guidance, by_name, by_value, drift, levels, grouped, missing, extreme, pairs, warnings
    )


def audit_summary(audit: Audit) -> DataFrame:
    """``metric, value``: how many rows each table of the audit has."""
    tables = {
        "leakage_name_count": audit.leakage_names, "leakage_correlation_count": audit.leakage_correlations,
        "drift_column_count": audit.drift_columns, "many_level_count": audit.many_levels,
        "confounding_count": audit.confounding, "outlier_column_count": audit.outliers,
        "collinear_pair_count": audit.collinear, "warning_count": audit.warnings,
    }
    parts = [
        t.agg(F.count("*").alias("value")).select(F.lit(m).alias("metric"), "value") for m, t in tables.items()
    ]
    parts.append(audit.guidance.select(F.lit("batch_count").alias("metric"), F.col("batch_count").alias("value")))
    parts.append(audit.row_missing.filter(F.col("metric") != "rows_with_missing_process_field").select(
        "metric", F.col("count").alias("value")
    ))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result
