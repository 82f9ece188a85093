"""Wide to long, duplicates per key, long to wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from lotwise.errors import InputError
from lotwise.functions import clean
from lotwise.operators.quantiles import exact_quantiles

KEEP = {"keep_first", "keep_last"}
SUMMARISE = {"mean", "median"}
STRATEGIES = {"error"} | KEEP | SUMMARISE


def field_type(df: DataFrame, column: str):
    return df.schema[column].dataType


def number_column(df: DataFrame, column: str) -> Column:
    """Column as double, NULL where it is not a plain number."""
    return clean.to_number(F.col(column), field_type(df, column))


def to_long(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str | Column] = (),
    as_text: bool = False, variable: str = "variable", value: str = "value",
) -> DataFrame:
    """One row per (row, column). A generator, so nothing is shuffled."""
    def cell(c: str) -> Column:
        if not as_text:
            return number_column(df, c)
        # -0.0 and 0.0 are one value, so adding zero gives both the same text
        numeric = isinstance(field_type(df, c), NumericType)
        return (F.col(c) + 0 if numeric else F.col(c)).cast("string")

    cells = F.array(*[F.struct(F.lit(c).alias(variable), cell(c).alias(value)) for c in columns])
    return df.select(*keep, F.inline(cells))


def normalised_key(df: DataFrame, key: str) -> Column:
    return clean.normalise_key(F.col(key), field_type(df, key))


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per normalised key, NULL keys included."""
    return df.groupBy(normalised_key(df, key).alias("batch_key")).agg(F.count("*").alias("row_count"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Normalised keys that occur more than once."""
    return key_counts(df, key).filter(F.when(F.col("batch_key").isNotNull(), F.col("row_count")) > 1)


def duplicate_key_count(df: DataFrame, key: str) -> DataFrame:
    return duplicate_keys(df, key).agg(F.count("*").alias("duplicate_batch_count"))


def keep_one_row(df: DataFrame, key: str, order_by: Sequence[str], last: bool = False) -> DataFrame:
    """First or last row per normalised key.

    ``min_by`` / ``max_by`` combine before the shuffle, so a key that holds a
    third of all rows still sends one row per input partition.
    """
    pick = F.max_by if last else F.min_by
    chosen = pick(F.struct(*df.columns), F.struct(*order_by)).alias("row")
    return df.groupBy(normalised_key(df, key).alias("__key")).agg(chosen).select("row.*")


def summarise_duplicates(
    df: DataFrame, key: str, order_by: Sequence[str], strategy: str = "mean",
) -> DataFrame:
    """One row per normalised key: numbers are summarised, texts keep the first.

    Within a group a column counts as numeric when at least half of its rows
    (and at least one) hold a number. Text columns stay text.
    """
    grouped_key = normalised_key(df, key).alias("__key")
    data = df.withColumn("__key", grouped_key)
    measured = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name != key
    ]
    texts = [c for c in df.columns if c not in measured]
    order = F.struct(*order_by)

    def first_value(c: str) -> Column:
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order))

    def enough(c: str) -> Column:
        needed = F.greatest(F.lit(1), F.floor(F.count("*") / 2))
        return F.count(number_column(df, c)) >= needed

    firsts = [first_value(c).alias(c) for c in texts]
    if strategy == "mean":
        means = [
            F.when(enough(c), F.avg(number_column(df, c))).otherwise(first_value(c).cast("double")).alias(c)
            for c in measured
        ]
        return data.groupBy("__key").agg(*firsts, *means).select(*df.columns)

    fallback = [
        F.when(~enough(c), first_value(c).cast("double")).alias(c) for c in measured
    ]
    base = data.groupBy("__key").agg(*firsts, *fallback)
    if not measured:
        return base.select(*df.columns)
    # "<=>" below: the NULL key is one group too, so give it a stand-in text.
    stand_in = F.coalesce("__key", F.lit("\0"))
    long = to_long(data, measured, keep=[stand_in.alias("__key")])
    medians = (
        exact_quantiles(long, ["__key", "variable"], "value", [0.5])
        .groupBy("__key").pivot("variable", measured).agg(F.first(F.col("quantiles")[0]))
        .select("__key", *[F.col(f"`{c}`").alias(f"__median_{i}") for i, c in enumerate(measured)])
    )
    joined = base.withColumn("__key", stand_in).join(medians, "__key", "left")
    picked = {c: F.coalesce(F.col(c), F.col(f"__median_{i}")).alias(c) for i, c in enumerate(measured)}
    return joined.select(*[picked.get(c, F.col(c)) for c in df.columns])


def resolve_duplicates(
    df: DataFrame, key: str, strategy: str, order_by: Sequence[str], label: str = "table",
) -> DataFrame:
    """Apply the chosen duplicate rule; a table without duplicates is unchanged."""
    if key not in df.columns:
        raise InputError(f"{label}: key column {key} is missing")
    if strategy not in STRATEGIES:
        raise InputError(f"{label}: unknown duplicate rule {strategy}")
    examples = [r[0] for r in duplicate_keys(df, key).select("batch_key").orderBy("batch_key").take(5)]
    if not examples:
        return df
    if strategy == "error":
        raise InputError(f"{label}: duplicate batch keys remain, for example {', '.join(examples)}")
    if strategy in KEEP:
        return keep_one_row(df, key, order_by, last=strategy == "keep_last")
    return summarise_duplicates(df, key, order_by, strategy)


def duplicate_log(df: DataFrame, key: str, strategy: str, label: str) -> DataFrame:
    """One row: how many keys repeat, and the row counts before and after."""
    counts = key_counts(df, key)
    repeated = F.count_if(F.col("batch_key").isNotNull() & (F.col("row_count") > 1))
    after = F.count("*") if strategy != "error" else F.sum("row_count")
    return counts.agg(
        repeated.alias("duplicate_batch_count"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_before"),
        # without a repeated key the rule does nothing, so NULL keys stay apart
        F.when(repeated > 0, after).otherwise(F.coalesce(F.sum("row_count"), F.lit(0))).alias("rows_after"),
    ).select(F.lit(label).alias("table_label"), F.lit(strategy).alias("strategy"), "*")


def names_in(df: DataFrame, name: str, limit: int = 10_000) -> list[str]:
    """Distinct names of a long table, sorted; they become column names."""
    rows = df.select(clean.trim_all(F.col(name).cast("string")).alias("n")).distinct().na.drop()
    found = sorted(r.n for r in rows.limit(limit + 1).collect())
    if len(found) > limit:
        raise InputError(f"more than {limit} different names in {name}: not a long table of tests")
    return found


def value_is_numeric(df: DataFrame, value: str) -> bool:
    """True when enough values parse: at least 60 % of the non-NULL ones."""
    if isinstance(field_type(df, value), NumericType):
        return True
    seen, parsed = df.agg(
        F.count(value), F.count(clean.parsed_number(F.col(value)))
    ).first()
    return parsed >= max(1, int(0.60 * seen))


def long_to_wide(
    df: DataFrame, batch: str, name: str, value: str, how: str = "first",
    order_by: Sequence[str] = (), names: Sequence[str] | None = None,
    numeric: bool | None = None, normalise: bool = False,
) -> DataFrame:
    """One row per batch, one column per test name.

    ``names`` and ``numeric`` can be given from an earlier run, which saves the
    two look-ahead jobs. Batches group by their raw text unless ``normalise``.
    """
    if how not in {"first", "mean", "median"}:
        raise InputError(f"unknown pivot aggregate {how}")
    if how == "first" and not order_by:
        raise InputError("the first value per batch needs an order")
    names = list(names) if names is not None else names_in(df, name)
    numeric = value_is_numeric(df, value) if numeric is None else numeric
    if how != "first" and not numeric:
        raise InputError(f"{value} is not numeric, so {how} cannot be used")

    typed = isinstance(field_type(df, value), NumericType)
    cell = F.col(value).cast("double") if typed else (
        clean.parsed_number(F.col(value)) if numeric else F.col(value)
    )
    group = normalised_key(df, batch) if normalise else F.col(batch)
    tests = df.select(
        group.alias(batch), clean.trim_all(F.col(name).cast("string")).alias("__name"),
        cell.alias("__value"), F.struct(*order_by or [F.lit(0)]).alias("__order"),
    ).filter(F.col(batch).isNotNull() & F.col("__name").isin(names))

    value_of = F.col("__value")
    if how == "median":
        tests = exact_quantiles(tests, [batch, "__name"], "__value", [0.5])
        aggregate = F.first(F.col("quantiles")[0])
    elif how == "mean":
        aggregate = F.avg(value_of)
    else:
        aggregate = F.min_by(value_of, F.when(value_of.isNotNull(), F.col("__order")))
    wide = tests.groupBy(batch).pivot("__name", names).agg(aggregate)
    return wide


# Name parts that suggest the role of a column in a long table.
BATCH_PARTS = ["batch", "lot_id", "run_id"]
NAME_PARTS = ["test", "parameter", "attribute", "analyte", "tag", "name"]
VALUE_PARTS = ["result", "value", "reading", "measurement"]


def long_format_candidates(df: DataFrame) -> DataFrame:
    """Columns that may be the batch, the name and the value of a long table.

    Rows ``(column, candidate_for, position, likely_long_format)``.
    """
    plain = {c: c.lower().replace(" ", "_") for c in df.columns}

    def with_part(parts: Sequence[str], taken: Sequence[str]) -> list[str]:
        return [c for c in df.columns if c not in taken and any(p in plain[c] for p in parts)]

    batches = with_part(BATCH_PARTS, ())
    named = with_part(NAME_PARTS, batches)
    dated = [c for c in df.columns if "date" in plain[c]]
    values = with_part(VALUE_PARTS, [*batches, *named, *dated])
    others = [c for c in df.columns if c not in {*batches, *named, *values, *dated}]

    numeric = [c for c in others if isinstance(field_type(df, c), NumericType)]
    texts = [c for c in others if c not in numeric]
    likely = bool(batches and named)
    wanted = [F.count("*").alias("n")]
    wanted += [F.count(c).alias(f"seen_{i}") for i, c in enumerate(texts)]
    wanted += [F.count(clean.parsed_number(F.col(c))).alias(f"parsed_{i}") for i, c in enumerate(texts)]
    facts = df.agg(*wanted).first()
    for i, c in enumerate(texts):
        if facts[f"seen_{i}"] and facts[f"parsed_{i}"] / facts[f"seen_{i}"] >= 0.80:
            numeric.append(c)
    values += [c for c in others if c in numeric]
    if likely and values:
        # one shuffle of distinct values each, without collecting them
        batch_count = df.select(batches[0]).na.drop().distinct().count()
        name_count = df.select(named[0]).na.drop().distinct().limit(2).count()
        likely = batch_count < facts["n"] and name_count >= 2
    rows = [
        (c, role, position, bool(likely and values))
        for role, group in (("batch", batches), ("name", named), ("value", values))
        for position, c in enumerate(group, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, candidate_for string, position bigint, likely_long_format boolean"
    )
