"""Feature preparation: fit once on the driver-sized facts, apply as a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from lotwise.errors import InputError
from lotwise.operators.charts import order_value
from lotwise.operators.ordering import value_at
from lotwise.operators.quantiles import column_quantiles
from lotwise.operators.reshape import field_type, number_column
from lotwise.operators.stats import distinct_facts, is_numeric, value_frequencies
from lotwise.session import stored

MOST_FEATURES = 4000  # the driver holds matrices of this width
MISSING_LEVEL = "Missing"
TEST = "__test"


@dataclass(frozen=True)
class FeatureState:
    """Fitted medians, modes and levels; small, and free of row data."""

    columns: list[str]
    medians: dict[str, float]
    modes: dict[str, str]
    levels: dict[str, list[str]]
    names: list[str] = field(default_factory=list)
    variable_of: list[str] = field(default_factory=list)

    def groups(self) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {c: [] for c in self.columns}
        for i, v in enumerate(self.variable_of):
            found[v].append(i)
        return found

    def shifts(self) -> list[float]:
        """Rough centre of every feature, to keep sums of squares accurate."""
        return [self.medians.get(n, 0.0) for n in self.names]


def _numeric(df: DataFrame, c: str) -> bool:
    return is_numeric(df, c) or isinstance(field_type(df, c), BooleanType)


def _number(df: DataFrame, c: str) -> Column:
    return F.col(c).cast("double") if isinstance(field_type(df, c), BooleanType) else number_column(df, c)


def check_width(width: int, most: int) -> None:
    if width > most:
        raise InputError(
            f"{width} encoded features are more than {most}, whose matrices the driver holds; "
            "leave out columns of many levels or raise most_features"
        )


def stored_rows(df: DataFrame, columns: Sequence[str | None]) -> DataFrame:
    """The named columns (``None`` is skipped), written once, so that later passes do not run the plan behind ``df``."""
    wanted = [c for c in dict.fromkeys(columns) if c is not None]
    return df.sparkSession.read.parquet(stored(df.select(*wanted)))


def model_rows(df: DataFrame, key: str, columns: Sequence[str], outcomes: Sequence[str], order_by: str | None) -> DataFrame:
    """What models read, written once."""
    return stored_rows(df, [key, *columns, *outcomes, order_by if order_by in df.columns else None])


def fit_features(df: DataFrame, columns: Sequence[str], most_features: int = MOST_FEATURES) -> FeatureState:
    """Exact medians, modes and all levels; three passes over ``df`` whatever the column count."""
    if not columns:
        raise InputError("at least one process column is needed")
    check_width(sum(_numeric(df, c) for c in columns), most_features)
    medians, texts = number_medians(df, columns)
    modes, levels = {c: MISSING_LEVEL for c in texts}, {c: [] for c in texts}
    if texts:
        counts = value_frequencies(df, texts).limit(most_features - len(medians) + 1).collect()
        if len(medians) + len(counts) > most_features:
            width = distinct_facts(df, texts).agg(F.sum("unique_count")).first()[0]
            check_width(len(medians) + width, most_features)
        for r in sorted(counts, key=lambda r: (-r.n, r.value), reverse=True):  # the mode comes last
            levels[r.variable].append(r.value)
            modes[r.variable] = r.value
        for c in texts:
            levels[c] = sorted(levels[c]) or [MISSING_LEVEL]
    names = [*medians, *[f"{c}={v}" for c in texts for v in levels[c]]]
    variable_of = [*medians, *[c for c in texts for _ in levels[c]]]
    return FeatureState(list(columns), medians, modes, levels, names, variable_of)


def impute(df: DataFrame, state: FeatureState) -> DataFrame:
    """Fill numbers with the median, texts with the mode."""
    filled = {c: F.coalesce(_number(df, c), F.lit(m)) for c, m in state.medians.items()}
    for c, mode in state.modes.items():
        filled[c] = F.coalesce(F.col(c).cast("string"), F.lit(mode))
    return df.withColumns(filled)


def encode(df: DataFrame, state: FeatureState, output: str = "features") -> DataFrame:
    """Add a vector of imputed numbers and one-hot levels; unknown levels are all zero."""
    data = impute(df, state)
    texts = list(state.levels)
    parts = list(state.medians)
    temporary = []
    if texts:
        codes, hot = [f"__code_{i}" for i in range(len(texts))], [f"__hot_{i}" for i in range(len(texts))]
        data = _with_codes(data, dict(zip(texts, codes)), state.levels)
        # the last slot stands for unknown levels and is the one dropped
        data = OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True).fit(data).transform(data)
        parts += hot
        temporary = codes + hot
    assembled = VectorAssembler(inputCols=parts, outputCol=output).transform(data)
    return df_with(df, assembled, output).drop(*temporary)


def _with_codes(data: DataFrame, codes: dict[str, str], levels: dict[str, list[str]]) -> DataFrame:
    """Level numbers per text column; an unknown level gets the number after the last."""
    for column, code in codes.items():
        data = StringIndexerModel.from_labels(
            levels[column], inputCol=column, outputCol=code, handleInvalid="keep").transform(data)
    return data


def df_with(df: DataFrame, assembled: DataFrame, *added: str) -> DataFrame:
    """Only the original columns and the named new ones."""
    return assembled.select(*df.columns, *added)


def number_medians(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, float], list[str]]:
    """Exact medians of the numeric columns, and the text columns."""
    numeric = [c for c in columns if _numeric(df, c)]
    medians = {c: 0.0 for c in numeric}
    if numeric:
        numbers = df.select(*[_number(df, c).alias(c) for c in numeric])
        medians |= {r.variable: r.quantiles[0] for r in column_quantiles(numbers, numeric, [0.5]).collect()}
    return medians, [c for c in columns if c not in numeric]


def filled(df: DataFrame, medians: dict[str, float], texts: Sequence[str]) -> DataFrame:
    """Numbers filled with their medians; a missing text is a level of its own."""
    numbers = {c: F.coalesce(_number(df, c), F.lit(m)) for c, m in medians.items()}
    return df.withColumns({**numbers, **{c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL)) for c in texts}})


def modelling_rows(df: DataFrame, outcome: str, output: str = "label") -> DataFrame:
    """Rows with a numeric outcome, which is added as ``label``."""
    return df.withColumn(output, number_column(df, outcome)).filter(F.col(output).isNotNull())


def enough_rows(df: DataFrame, outcome: str, least: int = 3) -> DataFrame:
    """Modelling rows, of which a model needs at least three."""
    rows = modelling_rows(df, outcome)
    if rows.limit(least).count() < least:
        raise InputError(f"{outcome}: fewer than {least} rows with a numeric value")
    return rows


def fold_of(key: str, folds: int, seed: int = 42) -> Column:
    """Fold number from the key alone, so it does not depend on partitioning."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(folds)).cast("int")


@dataclass(frozen=True)
class TimeSplit:
    available: bool
    reason: str
    train: DataFrame | None = None
    test: DataFrame | None = None
    summary: DataFrame | None = None
    rows: DataFrame | None = None  # of both parts, with ``TEST``


def test_size(n: int, share: float = 0.20, least: int = 8) -> int:
    return min(max(least, round(n * share)), n - 10)


def time_split(
    df: DataFrame, outcome: str, order_by: str | None, key: str = "batch_id", share: float = 0.20,
) -> TimeSplit:
    """Older rows for training, newer rows for testing; equal times go by key.

    Only times and keys are ranked. Both parts are filters on ``df``, which is
    better stored if they are read often. Rows equal in both stay together.
    """
    if not order_by or order_by not in df.columns:
        return TimeSplit(False, "no order column for a time-ordered validation")
    usable = modelling_rows(df, outcome).withColumn("__order", order_value(df, order_by)).filter(
        F.col("__order").isNotNull())
    ranks = stored_rows(usable, ["__order", key])
    n = ranks.count()
    size = test_size(n, share)
    if n < 20 or size < 3:
        return TimeSplit(False, "too few rows with an outcome and an order value")
    first = n - size + 1
    at, older = value_at(ranks, "__order", first)
    tied, before = value_at(ranks.filter(F.col("__order") == F.lit(at)), key, first - older)
    if older + before == 0:
        return TimeSplit(False, "no row is older than the test rows")
    start = F.struct(F.lit(at).alias("__order"), F.lit(tied).cast(field_type(df, key)).alias(key))
    is_test = F.struct("__order", key) >= start
    summary = usable.agg(
        F.count_if(~is_test).alias("train_rows"), F.count_if(is_test).alias("test_rows"),
        F.min(F.when(is_test, F.col("__order"))).alias("test_start"),
        F.max("__order").alias("test_end"),
    )
    rows = usable.withColumn(TEST, is_test).drop("__order", "label")
    return TimeSplit(
        True, "", rows.filter(~F.col(TEST)).drop(TEST), rows.filter(TEST).drop(TEST), summary, rows
    )


@dataclass(frozen=True)
class Prepared:
    """What all models of one outcome share: feature state and time split."""

    state: FeatureState
    split: TimeSplit
    split_state: FeatureState | None


def prepare(
    df: DataFrame, columns: Sequence[str], outcome: str, order_by: str | None = None, key: str = "batch_id",
) -> Prepared:
    state = fit_features(modelling_rows(df, outcome), columns)
    split = time_split(df, outcome, order_by, key)
    return Prepared(state, split, fit_features(split.train, columns) if split.available else None)
