"""Two-phase retyping of text columns whose cells are mostly numbers.

Phase one is a single aggregate that decides per column; phase two is a pure
projection. The decision can be kept and replayed on other files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from lotwise.functions import clean, names
from lotwise.operators.reshape import to_long

REPORT_SCHEMA = (
    "column string, non_missing_values bigint, parsed_values bigint, "
    "parsed_fraction double, qualifier_count bigint"
)


@dataclass(frozen=True)
class Retyped:
    data: DataFrame
    report: DataFrame
    numeric_columns: list[str]
    renamed: dict[str, str]


def rename_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    fresh, renamed = names.unique_names(df.columns)
    return df.toDF(*fresh), renamed


def candidate_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Text columns that may hold numbers, judged by type and name only."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, StringType) and f.name not in exclude
        and not names.looks_like_identifier(f.name)
    ]


def parse_report(
    df: DataFrame, exclude: Sequence[str] = (), min_fraction: float = 0.75,
) -> DataFrame:
    """Columns worth converting, with their parse counts; one pass over the data.

    A column qualifies when at least half of its non-missing cells contain a
    digit group and at least ``min_fraction`` of them parse.
    """
    columns = candidate_columns(df, exclude)
    if not columns:
        return df.sparkSession.createDataFrame([], REPORT_SCHEMA)

    def counts(c: str) -> Column:
        cell = F.col(c)
        seen = ~clean.is_missing_text(cell)
        return F.struct(
            F.lit(c).alias("column"),
            F.count_if(seen).alias("non_missing_values"),
            F.count_if(seen & clean.has_digit_group(cell)).alias("with_digits"),
            F.count(clean.parsed_number(cell)).alias("parsed_values"),
            F.count(clean.parsed_qualifier(cell)).alias("qualifier_count"),
        )

    found = df.agg(F.array(*map(counts, columns)).alias("c")).select(F.inline("c"))
    share = F.try_divide(F.col("parsed_values"), F.col("non_missing_values"))
    digits = F.try_divide(F.col("with_digits"), F.col("non_missing_values"))
    return found.filter((digits >= 0.50) & (share >= min_fraction)).select(
        "column", "non_missing_values", "parsed_values", share.alias("parsed_fraction"), "qualifier_count",
    )


def parse_examples(df: DataFrame, columns: Sequence[str], most: int = 4) -> DataFrame:
    """A few distinct non-missing cells per column, the smallest texts."""
    cells = to_long(df, columns, as_text=True).filter(~clean.is_missing_text(F.col("value"))).distinct()
    order = Window.partitionBy("variable").orderBy("value")
    return (
        cells.withColumn("nr", F.row_number().over(order)).filter(F.col("nr") <= most)
        .groupBy(F.col("variable").alias("column"))
        .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("examples"))
    )


def apply_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace the given text columns by their parsed numbers."""
    return df.withColumns({c: clean.parsed_number(F.col(c)) for c in columns})


def retype(
    df: DataFrame, exclude: Sequence[str] = (), min_fraction: float = 0.75,
    numeric_columns: Sequence[str] | None = None,
) -> Retyped:
    """Rename columns, convert numeric-like text columns, turn NaN into NULL.

    Pass ``numeric_columns`` from an earlier decision to skip the look-ahead job.
    """
    df, renamed = rename_columns(df)
    df = df.withColumns({
        f.name: clean.nan_to_null(F.col(f.name))
        for f in df.schema.fields if f.dataType.typeName() in ("double", "float")
    })
    if numeric_columns is None:
        report = parse_report(df, exclude, min_fraction)
        rows = report.collect()  # one row per column
        numeric_columns = [r["column"] for r in rows]
        report = df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)
        if numeric_columns:
            report = report.join(parse_examples(df, numeric_columns), "column", "left")
        else:
            report = report.withColumn("examples", F.lit(None).cast("string"))
    else:
        report = df.sparkSession.createDataFrame([], REPORT_SCHEMA + ", examples string")
    return Retyped(apply_numeric(df, numeric_columns), report, list(numeric_columns), renamed)
