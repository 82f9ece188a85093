"""Feature preparation, latent-variable and tree models, ranking and findings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lotwise.functions.formats import cell_text, rounded, share_of_max
from lotwise.operators import audit, features, findings, latent, limits, profile, rank, stats, trees
from lotwise.operators.limits import LIMIT_SCHEMA
from lotwise.plans import views, workflow
from lotwise.plans.registry import query
from lotwise.plans.views import MEASURES_SQL, MERGED_SQL
from lotwise.session import checkpoint

PREPARED = ["order_status", "balance_reading", "priority_rank"]
PLANTED = ["line_count", "sum_quantity", "avg_tax"]
MIXED = ["order_status", "supplier_segment", "balance_reading", "line_count", "sum_quantity", "avg_tax"]


def process_and_measures(spark, folder):
    """Order attributes next to line measures, one row per order with lines."""
    left = views.process(spark, folder)
    key = F.regexp_extract("Batch ID", "([0-9]+)", 1).cast("bigint")
    measured = views.measures(spark, folder)
    return left.withColumn("__k", key).join(
        measured.withColumn("__k", F.col("batch_id").cast("bigint")), "__k"
    ).drop("__k", "Batch ID")


@query(f"""WITH {MERGED_SQL}, m AS (SELECT median(balance_reading) AS b, median(priority_rank) AS p FROM merged)
SELECT "Batch ID" AS batch_id, coalesce(balance_reading, b) AS balance_reading, coalesce(priority_rank, p) AS priority_rank,
       coalesce(order_status, 'none') AS order_status FROM merged, m""")
def fea_impute(spark, folder):
    data = features.stored_rows(views.merged(spark, folder), ["batch_id", *PREPARED])
    state = features.fit_features(data, PREPARED)
    return features.impute(data, state).select("batch_id", *PREPARED)


@query(f"""WITH {MERGED_SQL}, m AS (SELECT median(balance_reading) AS b FROM merged)
SELECT "Batch ID" AS batch_id, coalesce(balance_reading, b) AS balance_reading, priority_rank,
       CAST(order_status = 'F' AS DOUBLE) AS status_f, CAST(order_status = 'O' AS DOUBLE) AS status_o,
       CAST(order_status = 'P' AS DOUBLE) AS status_p FROM merged, m""")
def fea_encode(spark, folder):
    data = features.stored_rows(views.merged(spark, folder), ["batch_id", *PREPARED])
    state = features.fit_features(data, PREPARED)
    vector = vector_to_array("features")
    names = ["balance_reading", "priority_rank", "status_f", "status_o", "status_p"]
    return features.encode(data, state).select("batch_id", *[vector[i].alias(n) for i, n in enumerate(names)])


@query(f"""WITH {MERGED_SQL}
SELECT "Batch ID" AS batch_id, coalesce(printf('%.3f', balance_reading), '') AS balance_reading, coalesce(order_status, '') AS order_status,
       format('{{:,}}', CAST(round(account_balance * 100) AS BIGINT)) AS balance_cents FROM merged""")
def scl_cell_text(spark, folder):
    data = views.merged(spark, folder).withColumn("balance_cents", F.round(F.col("account_balance") * 100).cast("bigint"))
    return data.select("batch_id", *[cell_text(data, c).alias(c) for c in ("balance_reading", "order_status", "balance_cents")])


@query(f"""WITH {MEASURES_SQL}, s AS (
  SELECT avg(sum_quantity) AS m, stddev_pop(sum_quantity) AS d, avg(line_count) AS lm, stddev_pop(line_count) AS ld FROM measures)
SELECT batch_id, round((sum_quantity - m) / d, 6) AS sum_quantity, round((line_count - lm) / ld, 6) AS line_count FROM measures, s""")
def fea_standardise(spark, folder):
    """Population scaling read from the Gram pass."""
    columns = ["sum_quantity", "line_count"]
    data = features.stored_rows(views.measures(spark, folder), ["batch_id", *columns])
    state = features.fit_features(data, columns)
    shift = state.shifts()
    sums = latent.total_of(list(latent.moments(data, state, []).values()))
    centre, scale = latent.population_scale(sums, len(columns))
    return rounded(data.select("batch_id", *[
        ((F.col(c) - float(centre[i] + shift[i])) / float(scale[i])).alias(c) for i, c in enumerate(columns)]), 6)


@query(f"""WITH {MEASURES_SQL}, r AS (SELECT abs(corr(sum_quantity, line_count)) AS r FROM measures)
SELECT CAST(1 AS INTEGER) AS number, 'PC1' AS component, round((1 + r) / 2, 6) AS explained_variance_ratio,
       round((1 + r) / 2, 6) AS cumulative_variance_ratio FROM r
UNION ALL SELECT 2, 'PC2', round((1 - r) / 2, 6), 1.0::DOUBLE FROM r""")
def mod_pca_variance(spark, folder):
    """Two variables, where the shares follow from their correlation."""
    found = latent.principal_components(views.measures(spark, folder), ["sum_quantity", "line_count"])
    return rounded(found.variance, 6)


@query(f"""WITH {MEASURES_SQL}, s AS (
  SELECT avg(sum_quantity) AS m, stddev_pop(sum_quantity) AS d, avg(line_count) AS lm, stddev_pop(line_count) AS ld FROM measures)
SELECT batch_id, round(abs((sum_quantity - m) / d + (line_count - lm) / ld) / sqrt(2), 6) AS first_size,
       round(abs((sum_quantity - m) / d - (line_count - lm) / ld) / sqrt(2), 6) AS second_size FROM measures, s""")
def mod_pca_scores(spark, folder):
    data = views.measures(spark, folder)
    scores = latent.principal_components(data, ["sum_quantity", "line_count"]).scores(data)
    return rounded(scores.select(
        "batch_id", F.abs("PC1").alias("first_size"), F.abs("PC2").alias("second_size")), 6)


@query(f"""WITH {MEASURES_SQL}, s AS (
  SELECT avg(sum_quantity) AS m, stddev_pop(sum_quantity) AS d, avg(line_count) AS lm, stddev_pop(line_count) AS ld FROM measures)
SELECT batch_id, round(abs((sum_quantity - m) / d + (line_count - lm) / ld) / sqrt(2), 6) AS first_size,
       round(yield_amount, 6) AS outcome_value FROM measures, s""")
def cht_scores_outcome(spark, folder):
    """Component scores beside an outcome."""
    data = views.measures(spark, folder)
    scores = latent.principal_components(data, ["sum_quantity", "line_count"]).scores(data, outcome="yield_amount")
    return rounded(scores.select("batch_id", F.abs("PC1").alias("first_size"), "outcome_value"), 6)


def _pls_sql() -> str:
    z = {c: f"({c} - avg_{c}) / dev_{c}" for c in PLANTED}
    facts = ", ".join(f"avg({c}) AS avg_{c}, stddev_pop({c}) AS dev_{c}" for c in PLANTED)
    cov = ", ".join(f"covar_pop(z_{c}, y) AS c_{c}" for c in PLANTED)
    size = " + ".join(f"c_{c} * c_{c}" for c in PLANTED)
    score = " + ".join(f"z_{c} * c_{c}" for c in PLANTED)
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS process_variable, round(b * c_{c} / len, 4) AS coefficient FROM w, fit" for c in PLANTED)
    return f"""WITH {MEASURES_SQL}, f AS (SELECT {facts} FROM measures),
z AS (SELECT yield_amount AS y, {", ".join(f"{e} AS z_{c}" for c, e in z.items())} FROM measures, f),
w AS (SELECT *, sqrt({size}) AS len FROM (SELECT {cov} FROM z)),
t AS (SELECT y, ({score}) / len AS t FROM z, w),
fit AS (SELECT covar_pop(t, y) / var_pop(t) AS b FROM t) {rows}"""


@query(_pls_sql())
def mod_pls1_one_component(spark, folder):
    """One component, whose weights are plain covariances."""
    model = latent.partial_least_squares(views.measures(spark, folder), PLANTED, "yield_amount", most=1)
    return rounded(model.coefficients.select("process_variable", "coefficient"), 4)


SCORES_SQL = f"""{MEASURES_SQL}, r AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS v, abs(corr({c}, yield_amount)) AS r, stddev_samp({c}) / avg({c}) AS s FROM measures"
    for c in ["line_count", "sum_quantity", "avg_quantity", "avg_tax"]) + """), sc AS (
  SELECT v, s / max(s) OVER () AS pca, r / max(r) OVER () AS pls, r * r / max(r * r) OVER () AS rf FROM r
), c AS (
  SELECT *, 0.05e0 * pca + 0.35e0 * pls + 0.6e0 * rf AS total, CAST(pca >= 0.55 AS INT) + CAST(pls >= 0.55 AS INT) + CAST(rf >= 0.55 AS INT) AS k FROM sc
), ranked AS (
  SELECT 'yield_amount' AS outcome, row_number() OVER (ORDER BY total DESC, v) AS rank, v AS process_variable, total AS combined_score,
       CASE WHEN total >= 0.55 AND k >= 2 THEN 'high' WHEN total >= 0.3 AND k >= 1 THEN 'medium' ELSE 'exploratory' END AS confidence,
       CASE WHEN k = 0 THEN 'none' ELSE concat_ws(', ', CASE WHEN pca >= 0.55 THEN 'PCA' END, CASE WHEN pls >= 0.55 THEN 'PLS' END,
            CASE WHEN rf >= 0.55 THEN 'Random Forest' END) END AS evidence_methods,
       pca AS pca_score, pls AS pls_score, rf AS rf_score FROM c
)"""


def _ranked(spark, folder):
    """Ranking on scores that SQL can form too: spread, r and r squared."""
    data = views.measures(spark, folder)
    columns = ["line_count", "sum_quantity", "avg_quantity", "avg_tax"]
    spread = stats.column_facts(data, columns).select(
        F.col("variable").alias("process_variable"), share_of_max(F.col("std") / F.col("mean")).alias("pca_score"))
    r = stats.pair_correlations(data, columns, ["yield_amount"]).select(
        F.col("second").alias("outcome"), F.col("first").alias("process_variable"), F.abs("correlation").alias("r"))
    pls = r.select("outcome", "process_variable", share_of_max(F.col("r")).alias("pls_score"))
    forest = r.select("outcome", "process_variable", share_of_max(F.col("r") * F.col("r")).alias("rf_score"))
    return rank.combine_rankings(spread, pls, forest)


ROUND_SCORES = "round(combined_score, 6) AS combined_score, confidence, evidence_methods, round(pca_score, 6) AS pca_score, round(pls_score, 6) AS pls_score, round(rf_score, 6) AS rf_score"


@query(f"WITH {SCORES_SQL} SELECT outcome, rank, process_variable, {ROUND_SCORES} FROM ranked")
def mod_rank_combine(spark, folder):
    return rounded(_ranked(spark, folder), 6)


@query(f"WITH {SCORES_SQL} SELECT outcome, rank, process_variable, {ROUND_SCORES} FROM ranked WHERE rank <= 2")
def win_rank(spark, folder):
    return rounded(rank.top_drivers(_ranked(spark, folder), 2), 6)


@query(f"WITH {SCORES_SQL} SELECT outcome, rank, process_variable, {ROUND_SCORES} FROM ranked")
def srt_appendix(spark, folder):
    return rounded(rank.appendix(_ranked(spark, folder)), 6)


@query(f"""WITH {SCORES_SQL}, long AS (
  SELECT outcome, process_variable, 'pca_score' AS method, pca_score AS score FROM ranked
  UNION ALL SELECT outcome, process_variable, 'pls_score', pls_score FROM ranked
  UNION ALL SELECT outcome, process_variable, 'rf_score', rf_score FROM ranked)
SELECT outcome, method, CAST(row_number() OVER (PARTITION BY outcome, method ORDER BY score DESC, process_variable) AS INTEGER) AS position,
       process_variable, round(score, 6) AS score FROM long""")
def evd_method_tops(spark, folder):
    return rounded(workflow.method_tops(_ranked(spark, folder)), 6)


@query(f"""WITH {MEASURES_SQL}, r AS (SELECT abs(corr(sum_quantity, line_count)) AS r, count(*) / (count(*) - 1) AS s FROM measures)
SELECT feature, feature AS process_variable, round(sqrt(s * (1 + r) / 2), 6) AS first_size, round(sqrt(s * (1 - r) / 2), 6) AS second_size,
       round(sqrt(s), 6) AS distance
FROM r, (VALUES ('sum_quantity'), ('line_count')) AS f(feature)""")
def srt_top_loadings(spark, folder):
    """Two correlated variables load alike on both components."""
    from lotwise.operators.charts import top_loadings

    found = top_loadings(latent.principal_components(views.measures(spark, folder), ["sum_quantity", "line_count"]).loadings)
    return rounded(found.select("feature", "process_variable", F.abs("PC1").alias("first_size"), F.abs("PC2").alias("second_size"), "distance"), 6)


@query(f"""WITH {SCORES_SQL}
SELECT outcome, rank, process_variable, 'pca_score' AS method, round(pca_score, 6) AS score FROM ranked
UNION ALL SELECT outcome, rank, process_variable, 'pls_score', round(pls_score, 6) FROM ranked
UNION ALL SELECT outcome, rank, process_variable, 'rf_score', round(rf_score, 6) FROM ranked""")
def set_stacked_scores(spark, folder):
    from lotwise.operators.charts import stacked_scores

    return rounded(stacked_scores(_ranked(spark, folder)), 6)


@query(f"""WITH {SCORES_SQL}
SELECT outcome, count(*) AS driver_count, count(*) FILTER (confidence = 'high') AS high_count,
       count(*) FILTER (confidence = 'medium') AS medium_count, arg_min(process_variable, rank) AS top_driver FROM ranked GROUP BY 1""")
def cht_overview(spark, folder):
    from lotwise.operators.charts import overview

    return overview(_ranked(spark, folder))


@query(f"""WITH {MEASURES_SQL}, p AS (
  SELECT yield_amount AS y, avg(yield_amount) OVER (PARTITION BY line_count) AS p, discount_residual > 0.05 AS part FROM measures)
SELECT part, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS row_count FROM p GROUP BY part""")
def mod_r2(spark, folder):
    """R2 per part of predictions that are means per line count."""
    data = views.measures(spark, folder)
    means = data.groupBy("line_count").agg(F.avg("yield_amount").alias("prediction"))
    rows = data.join(means, "line_count").withColumn("part", F.col("discount_residual") > 0.05)
    return rounded(trees.score_r2(rows, label="yield_amount", by=["part"]), 6)


# --- models without a SQL form: planted-pattern tests check them ----------------

@query()
def mod_pls(spark, folder):
    return latent.partial_least_squares(process_and_measures(spark, folder), MIXED, "yield_amount").variables


@query()
def mod_pls_validation(spark, folder):
    model = latent.partial_least_squares(
        process_and_measures(spark, folder), MIXED, "yield_amount", order_by="order_date")
    return spark.createDataFrame(
        [(k, float(v)) for k, v in model.cross_validation] + [(0, model.time_ordered["test_r2"])],
        "components int, r2 double")


@query()
def mod_pca(spark, folder):
    return latent.principal_components(process_and_measures(spark, folder), MIXED).variables


@query()
def mod_forest(spark, folder):
    return trees.random_forest(
        process_and_measures(spark, folder), MIXED, "yield_amount").variables


@query()
def mod_oob(spark, folder):
    """Out-of-bag score of the default forest beside its training score."""
    model = trees.random_forest(process_and_measures(spark, folder), MIXED, "yield_amount", exchanged=False)
    return spark.createDataFrame([(model.oob_r2, model.training_r2, model.rows)], "oob_r2 double, training_r2 double, row_count long")


@query()
def mod_boosted(spark, folder):
    return trees.boosted_trees(process_and_measures(spark, folder), MIXED, "yield_amount").variables


@query()
def mod_attribution(spark, folder):
    return trees.boosted_trees(process_and_measures(spark, folder), MIXED, "yield_amount").attributions


@query()
def mod_ranked_drivers(spark, folder):
    return workflow.rank_drivers(
        process_and_measures(spark, folder), MIXED, ["yield_amount", "discount_residual"]).ranked


GATHERED: dict[tuple[str, str], workflow.Evidence] = {}


def _evidence(spark, folder):
    """The analysis behind three queries, gathered once in a session."""
    at = spark.sparkContext.applicationId, folder
    if at not in GATHERED:
        GATHERED[at] = _gathered(spark, folder)
    return GATHERED[at]


def _gathered(spark, folder):
    data = process_and_measures(spark, folder).select(
        "batch_id", "order_date", *MIXED, "yield_amount", "discount_residual")
    data = checkpoint(data)
    outcomes = ["yield_amount", "discount_residual"]
    prof = profile.build_profile(data, outcomes)
    checks = audit.run_audit(data, prof.process_columns, outcomes)
    order_by = workflow.choose_order_column(checks.drift_columns, prof.process_columns)
    ranking = workflow.rank_drivers(data, prof.process_columns, outcomes, order_by=order_by)
    window = spark.createDataFrame([
        ("sum_quantity", "process", 100.0, 20.0, 250.0, "pcs", "high", ""),
        ("yield_amount", "qc", None, 5000.0, None, "USD", "high", ""),
    ], LIMIT_SCHEMA)
    windows = limits.check_limits(data, window, prof.process_columns, outcomes, ranking.ranked)
    return workflow.gather_evidence(data, outcomes, ranking, prof, checks, windows)


@query()
def kfd_findings(spark, folder):
    return _evidence(spark, folder).findings


@query()
def cnf_breakdown(spark, folder):
    return _evidence(spark, folder).confidence


@query()
def evd_report_pack(spark, folder):
    return _evidence(spark, folder).pack
