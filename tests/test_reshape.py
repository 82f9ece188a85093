import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.errors import InputError
from lotwise.operators import reshape

LONG = [
    ("B-001", "yield", "81,2 %", 1), ("B-001", "moisture", "18.5%", 2), ("B002", "yield", "79.0%", 3),
    ("B002", "moisture", "<20 %", 4), ("B002", "moisture", "22", 5),
]


def long_table(spark):
    return spark.createDataFrame(LONG, "`Batch Identifier` string, `Test Name` string, Result string, line int")


def test_pivot(spark):
    wide = reshape.long_to_wide(long_table(spark), "Batch Identifier", "Test Name", "Result", "first", ["line"])
    rows = {r["Batch Identifier"]: r for r in wide.collect()}
    assert rows["B-001"]["yield"] == 81.2 and rows["B002"]["moisture"] == 20.0
    wide = reshape.long_to_wide(long_table(spark), "Batch Identifier", "Test Name", "Result", "median", normalise=True)
    assert {r["Batch Identifier"]: r["moisture"] for r in wide.collect()} == {"B001": 18.5, "B002": 21.0}


def test_long_format_is_seen(spark):
    rows = {(r["column"], r.candidate_for) for r in reshape.long_format_candidates(long_table(spark)).collect()
            if r.likely_long_format}
    assert {("Batch Identifier", "batch"), ("Test Name", "name"), ("Result", "value")} <= rows


def test_mean_of_duplicates(spark):
    df = spark.createDataFrame([("B-001", 99.0, "x", 1), ("B001", 101.0, "y", 2), ("B2", 5.0, None, 3)],
                               "key string, v double, t string, line int")
    got = {r.key: (r.v, r.t) for r in reshape.resolve_duplicates(df, "key", "mean", ["line"]).collect()}
    assert got == {"B-001": (100.0, "x"), "B2": (5.0, None)}
    log = reshape.duplicate_log(df, "key", "mean", "QC").first()
    assert (log.duplicate_batch_count, log.rows_before, log.rows_after) == (1, 3, 2)
    with pytest.raises(InputError):
        reshape.resolve_duplicates(df, "key", "error", ["line"])
    with pytest.raises(InputError):
        reshape.resolve_duplicates(df, "key", "biggest", ["line"])


def test_without_duplicates_nothing_changes(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "key string, line int")
    assert reshape.resolve_duplicates(df, "key", "keep_first", ["line"]).count() == 3


def test_null_keys_collapse_once_a_key_repeats(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("A", 3.0, 2), (None, 5.0, 3), (None, 9.0, 4)], "key string, v double, line int")
    first = reshape.resolve_duplicates(df, "key", "keep_first", ["line"])
    last = reshape.resolve_duplicates(df, "key", "keep_last", ["line"])
    assert sorted(r.v for r in first.collect()) == [1.0, 5.0]
    assert sorted(r.v for r in last.collect()) == [3.0, 9.0]
    assert sorted(r.v for r in reshape.resolve_duplicates(df, "key", "median", ["line"]).collect()) == [2.0, 7.0]


def test_few_numbers_keep_the_first_value(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", None, 3), ("a", 8.0, 4)], "key string, v double, line int")
    # one of four is less than half, so the group is not summarised
    assert reshape.summarise_duplicates(df, "key", ["line"], "mean").first().v == 8.0


def test_hot_key(spark):
    """A third of all rows on one key, against a brute-force answer."""
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("key"),
        F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double").alias("v"), F.col("id").alias("line"))
    local = df.toPandas()
    local["key"] = local["key"].str.upper()
    for rule, expected in (("mean", local.groupby("key")["v"].mean()), ("median", local.groupby("key")["v"].median())):
        got = {r.key.upper(): r.v for r in reshape.summarise_duplicates(df, "key", ["line"], rule).collect()}
        assert len(got) == len(expected)
        assert all(np.isclose(got[k], v) for k, v in expected.items())
    kept = reshape.keep_one_row(df, "key", ["line"], last=True)
    assert {r.key.upper(): r.line for r in kept.collect()} == local.groupby("key")["line"].max().to_dict()
