"""Level effects, bands, interactions, ordered and control charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.formats import rounded
from lotwise.operators import charts, evidence, features, stats
from lotwise.plans import views
from lotwise.plans.registry import query
from lotwise.plans.views import MEASURES_SQL, MERGED_SQL

LEVEL_VARIABLES = ["order_status", "order_priority", "supplier_segment", "site_nation"]
BAND_VARIABLES = ["sum_quantity", "line_count"]
OUTCOME = "yield_amount"


@query(f"""WITH {MERGED_SQL}, o AS (SELECT avg(yield_amount) AS m FROM merged), g AS (
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS level, count(*) AS count, avg(yield_amount) AS mean FROM merged GROUP BY {c}"
    for c in LEVEL_VARIABLES) + """), d AS (
  SELECT *, mean - m AS delta, row_number() OVER (PARTITION BY variable ORDER BY abs(mean - m) DESC, level) AS position FROM g, o)
SELECT 'yield_amount' AS outcome, variable, variable || '=' || level AS level_label, position, count, round(mean, 6) AS mean,
       round(delta, 6) AS delta_from_overall_mean FROM d WHERE position <= 4""")
def evd_level_effects(spark, folder):
    return rounded(evidence.level_effects(views.merged(spark, folder), LEVEL_VARIABLES, OUTCOME, top=4), 6)


def _bins(variable: str) -> str:
    return f"""SELECT '{variable}' AS variable, {variable} AS value, yield_amount AS y,
  CASE WHEN {variable} <= q[2] OR q[2] = q[1] AND false THEN 0 WHEN {variable} <= q[3] THEN 1
       WHEN {variable} <= q[4] THEN 2 ELSE 3 END AS bin
  FROM measures, (SELECT quantile_cont({variable}, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM measures)"""


# bins are renumbered so that merged (equal) edges leave no gap
QUARTILES_SQL = f"""{MEASURES_SQL}, binned AS ({" UNION ALL ".join(map(_bins, BAND_VARIABLES))}), quart AS (
  SELECT variable, dense_rank() OVER (PARTITION BY variable ORDER BY bin) - 1 AS bin, count(y) AS count,
         min(value) AS variable_min, max(value) AS variable_max, avg(y) AS outcome_mean
  FROM binned GROUP BY variable, binned.bin
)"""


@query(f"""WITH {QUARTILES_SQL}
SELECT 'yield_amount' AS outcome, variable, bin, count, variable_min, variable_max, round(outcome_mean, 6) AS outcome_mean
FROM quart""")
def evd_quartiles(spark, folder):
    table = evidence.quartile_table(views.measures(spark, folder), BAND_VARIABLES, OUTCOME)
    return rounded(table, 6)


@query(f"""WITH {MEASURES_SQL}, r AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, corr({c}, yield_amount) AS r FROM measures" for c in [*BAND_VARIABLES, "avg_tax"]) + """)
SELECT 'yield_amount' AS outcome, variable, round(r, 6) AS pearson_correlation,
       CASE WHEN r >= 0.25 THEN 'positive_linear_association' WHEN r <= -0.25 THEN 'negative_linear_association'
            ELSE 'weak_or_non_linear_linear_signal' END AS direction_hint FROM r""")
def evd_driver_patterns(spark, folder):
    return rounded(evidence.driver_patterns(
        views.measures(spark, folder), [*BAND_VARIABLES, "avg_tax"], OUTCOME), 6)


BAND_SQL = f"""{QUARTILES_SQL}, q1 AS (
  SELECT *, max(outcome_mean) OVER p AS best, max(outcome_mean) OVER p - min(outcome_mean) OVER p AS spread,
         count(*) OVER p AS bins FROM quart WINDOW p AS (PARTITION BY variable)
), q2 AS (SELECT *, outcome_mean >= best - greatest(0.1e0 * spread, 1e-9) AS fits FROM q1 WHERE bins >= 3 AND spread > 0),
top AS (SELECT variable, min(bin) AS top_bin FROM q2 WHERE outcome_mean = best GROUP BY variable),
q3 AS (
  SELECT q2.*, NOT EXISTS (SELECT 1 FROM q2 z WHERE z.variable = q2.variable AND NOT z.fits
           AND z.bin BETWEEN least(q2.bin, top_bin) AND greatest(q2.bin, top_bin)) AS inside
  FROM q2 JOIN top USING (variable)
), band AS (
  SELECT variable, any_value(bins) AS bins, min(variable_min) FILTER (inside) AS range_min,
         max(variable_max) FILTER (inside) AS range_max,
         sum(outcome_mean * count) FILTER (inside) / sum(count) FILTER (inside) AS mean_in_range,
         sum(outcome_mean * count) FILTER (NOT inside) / sum(count) FILTER (NOT inside) AS mean_outside_range,
         any_value(best) AS best_bin_mean, count(*) FILTER (inside) AS selected_bin_count,
         min(bin) FILTER (inside) AS first_bin, max(bin) FILTER (inside) AS last_bin FROM q3 GROUP BY variable
)"""


@query(f"""WITH {BAND_SQL}
SELECT 'yield_amount' AS outcome, variable AS process_variable, 'maximize' AS objective,
       regexp_replace(printf('%.1f', range_min), '\\.0$', '') || ' to ' || regexp_replace(printf('%.1f', range_max), '\\.0$', '') AS range_label,
       range_min, range_max, round(mean_in_range, 6) AS mean_in_range, round(mean_outside_range, 6) AS mean_outside_range,
       round(mean_in_range - mean_outside_range, 6) AS directional_lift_vs_outside, round(best_bin_mean, 6) AS best_bin_mean,
       selected_bin_count, CASE WHEN first_bin > 0 AND last_bin < bins - 1 THEN 'middle_sweet_spot'
         WHEN first_bin = 0 AND last_bin < bins - 1 THEN 'lower_band' WHEN first_bin > 0 THEN 'upper_band'
         ELSE 'broad_or_edge_band' END AS pattern_type
FROM band WHERE selected_bin_count < bins AND mean_in_range > mean_outside_range AND variable = 'sum_quantity'""")
def evd_response_band(spark, folder):
    table = evidence.quartile_table(views.measures(spark, folder), ["sum_quantity"], OUTCOME)
    return rounded(evidence.response_bands(table, OUTCOME), 6)


@query(f"""WITH {BAND_SQL}, inner_rows AS (
  SELECT sum_quantity AS value, yield_amount AS y FROM measures, band
  WHERE variable = 'sum_quantity' AND sum_quantity BETWEEN range_min AND range_max
), k AS (SELECT CAST(least(10, greatest(4, count(*) // 15)) AS INTEGER) AS k FROM inner_rows),
sorted_values AS (SELECT list_sort(list(value)) AS v, count(*) - 1 AS last FROM inner_rows),
edges AS (SELECT list_distinct(list(v[CAST(floor(last * i / k.k) AS INT) + 1]
    + (v[CAST(ceil(last * i / k.k) AS INT) + 1] - v[CAST(floor(last * i / k.k) AS INT) + 1]) * (last * i / k.k - floor(last * i / k.k)))) AS e
  FROM sorted_values, k, range(0, 11) r(i) WHERE i <= k.k),
numbered AS (
  SELECT value, y, len(list_filter(list_sort(e)[2:], lambda x: x < value)) AS bin FROM inner_rows, edges
), bins AS (
  SELECT dense_rank() OVER (ORDER BY bin) - 1 AS position, count(y) AS n, min(value) AS lo, max(value) AS hi, avg(y) AS m
  FROM numbered GROUP BY bin
), best AS (SELECT * FROM bins ORDER BY m DESC, position LIMIT 1),
other AS (SELECT sum(m * n) / sum(n) AS m FROM bins WHERE position <> (SELECT position FROM best))
SELECT 'yield_amount' AS outcome, 'sum_quantity' AS process_variable,
       regexp_replace(printf('%.1f', lo), '\\.0$', '') || ' to ' || regexp_replace(printf('%.1f', hi), '\\.0$', '') AS refined_range_label,
       lo AS refined_range_min, hi AS refined_range_max, round(best.m, 6) AS refined_mean, n AS refined_count,
       (SELECT count(*) FROM bins) AS refined_bin_count, round(best.m - other.m, 6) AS refined_directional_lift_vs_other_bins,
       CASE WHEN position = 0 THEN 'lower_edge_best_bin' WHEN position = (SELECT count(*) FROM bins) - 1 THEN 'upper_edge_best_bin'
            ELSE 'middle_best_bin' END AS refined_pattern_type
FROM best, other WHERE best.m > other.m""")
def evd_refined_bin(spark, folder):
    data = views.measures(spark, folder)
    bands = evidence.response_bands(evidence.quartile_table(data, ["sum_quantity"], OUTCOME), OUTCOME)
    return rounded(evidence.refined_bins(data, bands, ["sum_quantity"], OUTCOME), 6)


@query()
def evd_window_hints(spark, folder):
    return evidence.window_hints(views.measures(spark, folder), BAND_VARIABLES, OUTCOME)


PAIRS = [("sum_quantity", "line_count"), ("sum_quantity", "avg_quantity"), ("line_count", "avg_quantity")]
INTERACTIONS_SQL = f"""WITH {MEASURES_SQL}, pairs AS (""" + " UNION ALL ".join(
    f"""SELECT '{a}' AS first_variable, '{b}' AS second_variable, ta AS first_high_threshold, tb AS second_high_threshold,
  count(*) FILTER ({a} >= ta AND {b} >= tb) AS high_high_count, avg(yield_amount) FILTER ({a} >= ta AND {b} >= tb) AS hh,
  avg(yield_amount) FILTER (NOT ({a} >= ta AND {b} >= tb)) AS other
  FROM measures, (SELECT quantile_cont({a}, 0.75) AS ta, quantile_cont({b}, 0.75) AS tb FROM measures) GROUP BY ta, tb"""
    for a, b in PAIRS) + """)
SELECT 'yield_amount' AS outcome, first_variable, second_variable, round(first_high_threshold, 6) AS first_high_threshold,
       round(second_high_threshold, 6) AS second_high_threshold, high_high_count, round(hh, 6) AS high_high_outcome_mean,
       round(other, 6) AS other_outcome_mean, round(hh - other, 6) AS delta_high_high_vs_other FROM pairs"""


@query(INTERACTIONS_SQL)
def evd_interactions(spark, folder):
    return rounded(evidence.interactions(
        views.measures(spark, folder), ["sum_quantity", "line_count", "avg_quantity"], OUTCOME, top=4), 6)


@query(f"""WITH {MERGED_SQL}, l AS (""" + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS variable, {c} AS level FROM merged" for c in LEVEL_VARIABLES) + """), n AS (
  SELECT variable, row_number() OVER (PARTITION BY variable ORDER BY level) AS position, level FROM l)
SELECT * FROM n WHERE position <= 30""")
def evd_levels(spark, folder):
    return stats.distinct_levels(views.merged(spark, folder), LEVEL_VARIABLES, most=30)


# --- ordered series ---------------------------------------------------------------

def _series(spark, folder):
    """Event values in time order, one series per event type."""
    return views.table(spark, folder, "events").select(
        F.col("event_type").alias("outcome"), F.col("event_id").alias("batch_id"), "ts", "value")


@query("""SELECT event_type AS outcome, event_id AS batch_id, CAST(epoch_us(ts) AS DOUBLE) AS order_value, value AS outcome_value,
       round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_average
FROM events""")
def win_moving_average(spark, folder):
    rows = _series(spark, folder)
    ordered = rows.select(
        "outcome", "batch_id", charts.order_value(rows, "ts").alias("order_value"), F.col("value").alias("outcome_value"))
    return ordered.transform(lambda d: rounded(charts.trend(d, "batch_id", 7, ["outcome"]), 6))


CONTROL_SQL = """lim AS (
  SELECT event_type, avg(value) AS mean, avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi,
         count(value) AS n FROM events GROUP BY 1)"""


@query(f"""WITH {CONTROL_SQL}
SELECT event_type AS outcome, n AS row_count, round(mean, 6) AS mean, round(lo, 6) AS lower_control_limit,
       round(hi, 6) AS upper_control_limit FROM lim""")
def win_control_limits(spark, folder):
    rows = _series(spark, folder).withColumnRenamed("value", "outcome_value")
    return rounded(charts.control_limits(rows, ["outcome"]), 6)


@query(f"""WITH {CONTROL_SQL}
SELECT event_type AS outcome, event_id AS batch_id, value AS outcome_value, round(mean, 6) AS mean,
       round(lo, 6) AS lower_control_limit, round(hi, 6) AS upper_control_limit, 'Outside 3 sigma' AS status
FROM events JOIN lim USING (event_type) WHERE value > hi OR value < lo""")
def win_control_chart(spark, folder):
    rows = _series(spark, folder).select("outcome", "batch_id", F.col("value").alias("outcome_value"))
    return rounded(charts.control_violations(rows, ["outcome"]), 6)


@query(f"""WITH {MERGED_SQL}
SELECT "Batch ID" AS batch_id, CAST(epoch_us(CAST(order_date AS TIMESTAMP)) AS DOUBLE) AS order_value,
       yield_amount AS outcome_value FROM merged""")
def cht_ordered_outcome(spark, folder):
    return charts.ordered_outcome(views.merged(spark, folder), "yield_amount", "order_date")


@query(f"""WITH {MERGED_SQL}
SELECT "Batch ID" AS batch_id, CAST(epoch_us(CAST(order_date AS TIMESTAMP)) AS DOUBLE) AS order_value,
       yield_amount AS outcome_value, order_status FROM merged""")
def cht_coloured_outcome(spark, folder):
    return charts.ordered_outcome(views.merged(spark, folder), "yield_amount", "order_date", keep=["order_status"])


@query(f"""WITH {MERGED_SQL}, r AS (
  SELECT *, row_number() OVER (ORDER BY order_date, "Batch ID") AS nr, count(*) OVER () AS n FROM merged),
s AS (SELECT *, nr > n - least(greatest(8, round_even(n * 0.2, 0)), n - 10) AS is_test FROM r)
SELECT "Batch ID" AS batch_id, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part FROM s""")
def win_time_split(spark, folder):
    split = features.time_split(views.merged(spark, folder), "yield_amount", "order_date")
    return split.train.select("batch_id", F.lit("train").alias("part")).unionByName(
        split.test.select("batch_id", F.lit("test").alias("part")))
