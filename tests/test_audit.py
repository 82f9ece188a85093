import pytest
from pyspark.sql import functions as F

from lotwise.operators import audit, profile

OUTCOMES = ["yield_g_L"]


@pytest.fixture(scope="module")
def known(spark):
    """Forty rows, each planted problem once."""
    rows = []
    for i in range(40):
        temperature = 100.0 if i == 0 else 36.0 + 0.1 * (i % 9)
        y = 4.0 + 0.05 * (i % 11)
        rows.append((
            f"B{i:03d}", temperature, temperature * 1.01, i % 2, f"S{i % 3}", "Day" if i % 2 else "Night", i + 1, y,
            1 if i == 7 else 0, None if i < 12 else float(i), y))
    return spark.createDataFrame(
        rows, "batch_id string, temperature_C double, temperature_copy_C double, deviation_reported int, "
              "supplier_lot string, operator_shift string, batch_sequence_number int, "
              "yield_estimate_after_release double, near_constant_flag int, mostly_missing_sensor double, yield_g_L double")


def test_profile(known):
    p = profile.build_profile(known, OUTCOMES)
    types = {r["column"]: r["type"] for r in p.types.collect()}
    assert types["temperature_C"] == "continuous" and types["supplier_lot"] == "categorical"
    assert types["operator_shift"] == "binary" and types["deviation_reported"] == "binary"
    assert [r["column"] for r in p.near_constant.collect()] == ["near_constant_flag"]
    assert [r["column"] for r in p.missingness.filter("flag").collect()] == ["mostly_missing_sensor"]
    assert {r.code for r in p.warnings.collect()} == {"high_missing", "near_constant"}


def test_audit_flags_every_problem(known):
    columns = [c for c in known.columns if c not in ("batch_id", "yield_g_L")]
    a = audit.run_audit(known, columns, OUTCOMES)

    def names(df):
        return {r[0] for r in df.collect()}

    assert {"yield_estimate_after_release", "deviation_reported"} <= names(a.leakage_names)
    assert ("yield_estimate_after_release", "yield_g_L") in {tuple(r)[:2] for r in a.leakage_correlations.collect()}
    assert "batch_sequence_number" in names(a.drift_columns)
    assert {"supplier_lot", "operator_shift"} <= names(a.confounding)
    assert {"temperature_C", "temperature_copy_C"} <= names(a.outliers)
    assert ("temperature_C", "temperature_copy_C") in {tuple(r)[:2] for r in a.collinear.collect()}
    missing = {r.metric: r["count"] for r in a.row_missing.collect()}
    assert missing["rows_with_any_missing_selected_field"] == 12
    assert a.warnings.count() >= 5
    summary = {r.metric: r.value for r in audit.audit_summary(a).collect()}
    assert summary["batch_count"] == 40


def test_two_valued_columns_are_not_leakage(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2)) for i in range(20)], "x double, y double")
    assert audit.leakage_correlations(df, ["x"], ["y"]).count() == 0


def test_dates_in_text(spark):
    df = spark.createDataFrame([("2024-01-05", "x"), ("2024-02-06", "y")], "made string, other string")
    assert [tuple(r) for r in audit.drift_columns(df, ["made", "other"]).collect()] == [("made", "date-like values", 1.0)]


def test_many_levels(spark):
    df = spark.createDataFrame([(f"L{i}", "a") for i in range(25)], "lot string, kind string")
    assert [r["column"] for r in audit.many_levels(df, ["lot", "kind"]).collect()] == ["lot"]


def test_the_audit_reads_its_table_once(spark, known):
    """The tables of the audit come from one written copy, not from the plan behind the input."""
    found = audit.run_audit(known.withColumn("nothing", F.lit(None)), ["temperature_C", "supplier_lot", "nothing"], OUTCOMES)
    for table in (found.row_missing, found.outliers, found.drift_columns, found.guidance):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in plan and "LogicalRDD" not in plan.replace("[variable", "")
