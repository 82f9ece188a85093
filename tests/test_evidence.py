import numpy as np
import pandas as pd

from lotwise.operators import charts, evidence, findings, rank


def test_parabola_gives_a_middle_band(spark):
    x = np.linspace(76, 124, 96)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "yield_percent": 82 - 0.035 * (x - 101) ** 2}))
    r = evidence.window_hints(df, ["x"], "yield_percent").first()
    assert r.pattern_type == "middle_sweet_spot" and r.objective == "maximize"
    assert 88 <= r.range_min <= 101 <= r.range_max <= 113
    assert r.refined_pattern_type == "middle_best_bin" and abs((r.refined_range_min + r.refined_range_max) / 2 - 101) < 6


def test_minimised_outcome_takes_the_low_band(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(400.0), "moisture": np.arange(400.0)}))
    r = evidence.window_hints(df, ["x"], "moisture").first()
    assert (r.pattern_type, r.range_min, r.refined_pattern_type) == ("lower_band", 0.0, "lower_edge_best_bin")
    assert r.directional_lift_vs_outside > 0


def test_unknown_objective_or_flat_outcome_has_no_band(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(100.0), "weight": np.arange(100.0), "yield_": np.ones(100)}))
    assert evidence.window_hints(df, ["x"], "weight").count() == 0
    assert evidence.window_hints(df, ["x"], "yield_").count() == 0


def test_quartiles_match_pandas(spark):
    rng = np.random.default_rng(1)
    local = pd.DataFrame({"x": rng.integers(0, 9, 400).astype(float), "yield_": rng.normal(size=400)})
    cut = pd.qcut(local["x"], 4, duplicates="drop")
    expected = local.groupby(cut, observed=True)["yield_"].agg(["count", "mean"]).to_numpy()
    rows = evidence.quartile_table(spark.createDataFrame(local), ["x"], "yield_").orderBy("bin").collect()
    np.testing.assert_allclose([[r["count"], r.outcome_mean] for r in rows], expected)


def test_interaction_and_levels(spark):
    rng = np.random.default_rng(2)
    n = 600
    local = pd.DataFrame({"t": rng.normal(37, 0.4, n), "d": rng.normal(166, 9, n), "lot": rng.choice(list("ABC"), n)})
    local["hcp_ppm"] = 125 + 310 * ((local.t > 37.2) & (local.d > 170)) + rng.normal(0, 10, n) + 50 * (local.lot == "B")
    df = spark.createDataFrame(local)
    r = evidence.interactions(df, ["t", "d"], "hcp_ppm").first()
    assert r.delta_high_high_vs_other > 200
    top = evidence.level_effects(df, ["lot"], "hcp_ppm").orderBy("position").first()
    assert top.level_label == "lot=B" and top.delta_from_overall_mean > 20


def test_ranking_rules(spark):
    pca = spark.createDataFrame([("a", 1.0), ("b", 0.2), ("c", 0.6)], "process_variable string, pca_score double")
    pls = spark.createDataFrame([("y", "a", 0.9), ("y", "b", 1.0)], "outcome string, process_variable string, pls_score double")
    forest = spark.createDataFrame([("y", "a", 0.6), ("y", "b", 0.1)], "outcome string, process_variable string, rf_score double")
    rows = rank.combine_rankings(pca, pls, forest).orderBy("rank").collect()
    assert [(r.process_variable, r.confidence, r.evidence_methods) for r in rows] == [
        ("a", "high", "PCA, PLS, Random Forest"), ("b", "medium", "PLS"), ("c", "exploratory", "PCA")]
    assert abs(rows[0].combined_score - (0.05 + 0.35 * 0.9 + 0.6 * 0.6)) < 1e-12


def test_findings_and_confidence(spark):
    ranked = spark.createDataFrame(
        [("y", 1, "a", 0.7, "high", "PLS", 0.1, 0.9, 0.3)],
        "outcome string, rank long, process_variable string, combined_score double, confidence string, "
        "evidence_methods string, pca_score double, pls_score double, rf_score double")
    quality = spark.createDataFrame([("y", 2, 0.05, 0.5, None, None, 0.9, 0.4, 90)], findings.QUALITY_SCHEMA)
    missing = spark.createDataFrame([("a", 4, 10.0, False)], "column string, missing_count long, missing_percent double, flag boolean")
    size = spark.createDataFrame([(40, "moderate")], "batch_count long, guidance string")
    drift = spark.createDataFrame([("a",)], "column string")
    texts = {r.component: r.assessment for r in findings.confidence_breakdown(
        ranked, quality, missing, size, drift=drift).collect()}
    assert texts["PLS signal"] == "strong (0.900)" and texts["Sample size"] == "moderate (40 batches)"
    assert texts["Missingness"] == "some missingness (10.0%)" and texts["Audit cautions"] == "date or drift"
    assert "n/a" in texts["Model validation"]
    weak = findings.validation_findings(quality).collect()
    assert len(weak) == 1 and "PLS Q2 0.050" in weak[0].finding
    assert findings.validation_findings(quality.fillna({"rf_oob_r2": 0.5})).count() == 0


def test_control_chart(spark):
    rows = spark.createDataFrame([("s", i, 1.0 if i % 2 else 0.0) for i in range(40)] + [("s", 99, 50.0)],
                                 "outcome string, batch_id int, outcome_value double")
    assert [r.batch_id for r in charts.control_violations(rows, ["outcome"]).collect()] == [99]


def test_order_values(spark):
    df = spark.createDataFrame([("2024-01-02", "3", "x"), ("2024-01-01", "1", "y")], "d string, n string, t string")
    got = [r for r in df.select(*[charts.order_value(df, c).alias(c) for c in df.columns]).collect()]
    assert got[0].d > got[1].d and (got[0].n, got[1].n) == (3.0, 1.0) and got[0].t is None
