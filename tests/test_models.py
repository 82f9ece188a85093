import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.errors import InputError
from lotwise.operators import features, latent, trees
from lotwise.plans import model_queries, views, workflow

SMALL = trees.ForestSettings(trees=20, repeats=2)


def batches(n=400, seed=11):
    """Planted rules: feed and temperature drive yield, one supplier lowers it."""
    rng = np.random.default_rng(seed)
    local = pd.DataFrame({
        "batch_id": [f"B{i:04d}" for i in range(n)], "feed": rng.normal(38, 5.5, n), "temperature": rng.normal(36.9, 0.35, n),
        "rpm": rng.normal(122, 12, n), "supplier": rng.choice(["S_A", "S_B", "S_C"], n), "sequence": np.arange(n) + 1,
    })
    local["yield_g"] = (4.6 + 0.105 * (local.feed - 38) + 0.95 * (local.temperature - 36.9)
                        - 0.4 * (local.supplier == "S_B") + rng.normal(0, 0.2, n))
    local.loc[::23, "rpm"] = np.nan
    local.loc[5, "supplier"] = None
    return local


def frame(spark, local):
    return spark.createDataFrame(local.astype(object).where(local.notna(), None), schema=(
        "batch_id string, feed double, temperature double, rpm double, supplier string, sequence long, yield_g double"))


COLUMNS = ["feed", "temperature", "rpm", "supplier"]


@pytest.fixture(scope="module")
def data(spark):
    return frame(spark, batches()).persist()


def matrix(local):
    x = local[["feed", "temperature", "rpm"]].fillna(local[["feed", "temperature", "rpm"]].median())
    s = local["supplier"].fillna(local["supplier"].mode().iloc[0])
    return np.column_stack([x, *[(s == v).astype(float) for v in ("S_A", "S_B", "S_C")]])


def row_pls(x, y, components):
    """Plain row-wise algorithm for one outcome."""
    x, y = x - x.mean(0), y - y.mean()
    weights, loads, q = [], [], []
    for _ in range(components):
        w = x.T @ y
        w /= np.linalg.norm(w)
        t = x @ w
        p = x.T @ t / (t @ t)
        q.append(y @ t / (t @ t))
        x = x - np.outer(t, p)
        weights.append(w), loads.append(p)
    w, p = np.column_stack(weights), np.column_stack(loads)
    return w @ np.linalg.solve(p.T @ w, np.array(q))


def test_encoding(data):
    state = features.fit_features(data, COLUMNS)
    assert state.names == ["feed", "temperature", "rpm", "supplier=S_A", "supplier=S_B", "supplier=S_C"]
    rows = features.encode(data, state).orderBy("batch_id").select("features").collect()
    np.testing.assert_allclose(np.array([r.features.toArray() for r in rows]), matrix(batches()))
    odd = data.limit(1).withColumn("supplier", F.lit("S_X"))
    assert features.encode(odd, state).first().features.toArray()[3:].sum() == 0


def test_too_many_levels_are_refused_with_their_number(data):
    assert len(features.fit_features(data, COLUMNS, most_features=6).names) == 6
    with pytest.raises(InputError, match="^6 encoded"):
        features.fit_features(data, COLUMNS, most_features=5)


def test_latent_fit_equals_row_algorithm(data):
    x, y = matrix(batches()), batches()["yield_g"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    model = latent.partial_least_squares(data, COLUMNS, "yield_g")
    expected = row_pls(z, y, model.components)
    got = {r.feature: r.coefficient for r in model.coefficients.collect()}
    state = features.fit_features(data, COLUMNS)
    np.testing.assert_allclose([got[n] for n in state.names], expected, rtol=1e-8, atol=1e-10)
    assert model.q2 < model.training_r2 < 1 and model.q2 > 0.7
    fitted = z @ expected + y.mean()
    assert abs(model.training_r2 - (1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_components_equal_numpy(data):
    found = latent.principal_components(data, COLUMNS)
    x = matrix(batches())
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    got = [r.explained_variance_ratio for r in found.variance.orderBy("number").collect()]
    np.testing.assert_allclose(got, values / values.sum(), atol=1e-10)
    scores = found.scores(data).toPandas()
    np.testing.assert_allclose(scores[["PC1", "PC2"]].var().to_numpy(), values[:2], rtol=1e-8)
    np.testing.assert_allclose(scores[["PC1", "PC2"]].mean().to_numpy(), 0, atol=1e-9)


def test_feature_state_uses_training_rows_only(data):
    split = features.time_split(data, "yield_g", "sequence")
    assert split.train.count() == 320 and split.test.count() == 80
    assert split.test.agg(F.min("sequence")).first()[0] == 321
    assert not features.time_split(data, "yield_g", None).available
    assert not features.time_split(data.limit(15), "yield_g", "sequence").available


@pytest.mark.parametrize("n, size", [(400, 80), (20, 8), (43, 9), (21, 8)])
def test_split_sizes(n, size):
    assert features.test_size(n) == size


def test_ranking_recovers_planted_drivers(data):
    ranking = workflow.rank_drivers(data, [*COLUMNS, "sequence"], ["yield_g"], order_by="sequence", settings=SMALL)
    order = [r.process_variable for r in ranking.ranked.orderBy("rank").collect()]
    assert order[0] == "feed" and order[1] == "temperature" and "sequence" not in order
    q = ranking.quality.first()
    assert 0 < q.rf_oob_r2 < q.rf_training_r2 and q.pls_test_r2 > 0.6


def test_noise_has_no_out_of_bag_score(spark):
    local = batches()
    local["yield_g"] = np.random.default_rng(0).normal(size=len(local))
    model = trees.random_forest(frame(spark, local), COLUMNS, "yield_g", SMALL)
    assert model.oob_r2 < 0.15 < 0.5 < model.training_r2


def test_default_forest_finds_the_planted_drivers(data):
    model = trees.random_forest(data, COLUMNS, "yield_g", order_by="sequence")
    by = {r.process_variable: r for r in model.variables.collect()}
    order = sorted(by, key=lambda v: -by[v].rf_score)
    assert order[0] in ("feed", "temperature") and "feed" in order[:2] and "temperature" in order[:3]
    assert 0.7 < model.oob_r2 < model.training_r2 and model.time_ordered["test_r2"] > 0.6
    assert abs(sum(r.model_importance for r in by.values()) - 1) < 1e-9
    assert by["rpm"].group_permutation_importance < 0.1 * by["feed"].group_permutation_importance


def test_attributions_add_up(data):
    model = trees.boosted_trees(data, COLUMNS, "yield_g", order_by="sequence")
    fitted, binned, *_ = trees.fitted_boost(features.enough_rows(data, "yield_g"), COLUMNS, trees.BoostSettings(), "batch_id")
    plain = {r.key: fitted.predict(np.array([list(r.codes)]))[0] for r in binned.collect()}
    sums = model.attributions.groupBy("batch_id").agg((F.sum("attribution") + model.base_value).alias("s")).collect()
    assert len(sums) == 400 and max(abs(r.s - plain[r.batch_id]) for r in sums) < 1e-8
    order = [r.process_variable for r in model.variables.orderBy(F.desc("boosted_score")).collect()]
    assert order[:2] == ["feed", "temperature"] and model.training_r2 > 0.9 and model.time_ordered["test_r2"] > 0.6
    assert not trees.boosted_trees(data.limit(10), COLUMNS, "yield_g").available


def test_a_category_of_noise_has_no_importance(spark):
    local = batches()
    local["supplier"] = [f"L{i}" for i in np.random.default_rng(2).integers(0, 150, len(local))]
    model = trees.boosted_trees(frame(spark, local), COLUMNS, "yield_g")
    by = {r.process_variable: r for r in model.variables.collect()}
    assert by["supplier"].model_importance < 0.1 and by["supplier"].mean_abs_attribution < 0.15 * by["feed"].mean_abs_attribution
    told = trees.boosted_trees(frame(spark, batches()), COLUMNS, "yield_g").variables.collect()
    assert {r.process_variable: r for r in told}["supplier"].mean_abs_attribution > by["supplier"].mean_abs_attribution


def counted(spark, df):
    """``df`` behind a step that counts the rows it is run for."""
    seen = spark.sparkContext.accumulator(0)

    def step(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(step, df.schema), seen


def test_models_run_the_plan_behind_their_rows_once(spark):
    plain = frame(spark, batches()).withColumn("made", F.date_format(F.date_add(F.lit("2024-01-01"), F.expr("int(sequence div 3)")), "yyyy-MM-dd"))
    data, seen = counted(spark, plain)
    model = latent.partial_least_squares(data, COLUMNS, "yield_g", order_by="made")
    assert seen.value == 400 and model.time_ordered["train_rows"] == 320 and model.time_ordered["test_rows"] == 80
    assert model.time_ordered["test_r2"] > 0.6
    data, seen = counted(spark, plain)
    latent.principal_components(data, COLUMNS).variables.collect()
    assert seen.value == 400


@pytest.mark.parametrize("name", ["fea_encode", "fea_impute"])
def test_prepared_features_join_their_tables_once(spark, monkeypatch, name):
    merged, seen = counted(spark, views.merged(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(views, "merged", lambda *_: merged)
    rows = getattr(model_queries, name)(spark, "").collect()
    assert len(rows) > 1000 and seen.value == len(rows)


def test_time_split_ranks_equal_times_by_key(spark):
    rows = [(f"B{i:03d}", 1.0 if i < 90 else 0.0, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "batch_id string, day double, y double").repartition(7)
    split = features.time_split(df, "y", "day")
    assert sorted(r.batch_id for r in split.test.collect()) == [f"B{i:03d}" for i in range(70, 90)]
    assert split.train.count() == 80 and split.train.columns == split.test.columns == df.columns
    facts = split.summary.first()
    assert (facts.train_rows, facts.test_rows, facts.test_start, facts.test_end) == (80, 20, 1.0, 1.0)
    same = df.withColumns({"batch_id": F.lit("B"), "day": F.lit(0.0)})
    assert not features.time_split(same, "y", "day").available  # a key comes once; nothing older is left


def test_products_take_unknown_levels_as_zero(data):
    state = features.fit_features(data, COLUMNS)
    odd = data.withColumn("supplier", F.when(F.col("batch_id") < "B0010", "S_X").otherwise(F.col("supplier")))
    got = latent.total_of(list(latent.moments(odd, state, [], features.fold_of("batch_id", 3)).values()))
    x = matrix(batches())
    x[:10, 3:] = 0
    x = np.column_stack([np.ones(len(x)), x - state.shifts()])
    np.testing.assert_allclose(got.products, x.T @ x, rtol=1e-9, atol=1e-6)
