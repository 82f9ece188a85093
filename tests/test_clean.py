import pytest
from pyspark.sql import functions as F

from lotwise.functions import clean, names
from lotwise.functions.formats import range_number_text
from lotwise.operators import retype

NUMBERS = [
    ("100,3 g", 100.3, None), ("<99,1 g", 99.1, "<"), ("7.85 h", 7.85, None), ("approx. 5", 5.0, "approx."),
    ("About 12", 12.0, "About"), (">= 3", 3.0, ">="), ("1,234", 1.234, None), ("1,234,567", 1234.567, None),
    ("1.234,5", 1234.5, None), ("1,234.5", 1234.5, None), ("1.2.3", None, None), (".5", 5.0, None),
    ("1e3", 1.0, None), ("2026-02-01", 2026.0, None), ("1 234", 1234.0, None), ("<LOD", None, "<"),
    ("n/a", None, None), (" Not Tested ", None, None), ("-4,5", -4.5, None), ("", None, None), (None, None, None),
    ("12 %", 12.0, None), ("1\t2", None, None),
]


def test_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NUMBERS)], "i int, t string")
    got = {r.i: (r.p.value, r.p.qualifier) for r in df.select("i", clean.parse_number(F.col("t")).alias("p")).collect()}
    for i, (text, value, qualifier) in enumerate(NUMBERS):
        assert got[i] == (value, qualifier), text


@pytest.mark.parametrize("raw, key", [
    (" B-001 ", "B001"), ("B 001", "B001"), ("b_001", "B001"), ("12.0", "12"), (None, None), ("nd", None), (" - ", None),
    ("- -", ""), ("b​ 1", "B1"), ("a b", "AB"),
])
def test_keys(spark, raw, key):
    df = spark.createDataFrame([(raw,)], "k string")
    assert df.select(clean.normalise_key(F.col("k")).alias("k")).first().k == key


def test_double_keys_have_no_exponent(spark):
    df = spark.createDataFrame([(1e7,), (12.5,)], "k double")
    t = df.schema["k"].dataType
    assert [r.k for r in df.select(clean.normalise_key(F.col("k"), t).alias("k")).collect()] == ["10000000", "12.5"]


def test_strict_numbers_reject_java_forms(spark):
    df = spark.createDataFrame([("5d",), ("Infinity",), ("1e3",), (" 7 ",), ("1,5",)], "t string")
    assert [r.v for r in df.select(clean.to_number(F.col("t")).alias("v")).collect()] == [None, None, 1000.0, 7.0, None]


def test_unique_names():
    fresh, renamed = names.unique_names([" a ", "a", "", "Unnamed: 3", "b​"])
    assert fresh == ["a", "a__2", "unnamed_column_3", "unnamed_column_4", "b"]
    assert renamed["a"] == "a__2" and renamed["column_3"] == "unnamed_column_3"


def test_name_rules():
    assert names.outcome_objective("yield_loss") == "minimize"
    assert names.outcome_objective("yield_percent") == "maximize"
    assert names.outcome_objective("weight") == "unknown"
    assert names.default_key_column(["x", "Batch ID"]) == "Batch ID"
    assert names.outcome_words(["yield_g_L", "Purity percent"]) == ["purity", "yield"]


def test_retype_leaves_identifiers_alone(spark):
    df = spark.createDataFrame(
        [("07", "100 g", "x"), ("08", "<95,5 g", "y"), ("09", "n/a", "z")], "operator_id string, amount string, note string")
    result = retype.retype(df)
    assert [r.amount for r in result.data.orderBy("operator_id").collect()] == [100.0, 95.5, None]
    assert dict(result.data.dtypes)["operator_id"] == "string"
    row = result.report.collect()[0]
    assert (row["column"], row.non_missing_values, row.parsed_values, row.qualifier_count) == ("amount", 2, 2, 1)
    assert row.examples == "100 g, <95,5 g"


def test_retype_replays_a_decision(spark):
    df = spark.createDataFrame([("1,5",)], "amount string")
    assert retype.retype(df, numeric_columns=["amount"]).data.first().amount == 1.5


def test_range_numbers(spark):
    df = spark.createDataFrame([(100.0,), (7.25,), (0.0,), (0.0512,), (233.46,), (-12.0,), (1e-10,)], "v double")
    got = [r.t for r in df.select(range_number_text(F.col("v")).alias("t")).collect()]
    assert got == ["100", "7.25", "0", "0.0512", "233.5", "-12", "1.00e-10"]
