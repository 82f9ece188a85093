"""Limits and operating windows over order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.formats import rounded
from lotwise.operators import charts, limits
from lotwise.plans import views
from lotwise.plans.registry import query
from lotwise.plans.views import LIMITS_SQL, LINE_COLUMNS, LINE_OUTCOMES, ZONES_SQL

MEASURED = [*LINE_COLUMNS, *LINE_OUTCOMES]


def _limits(spark):
    return limits.infer_roles(limits.normalise_limits(views.line_limits(spark)), LINE_COLUMNS, LINE_OUTCOMES)


def _check(spark, folder):
    return limits.check_limits(
        views.lines(spark, folder), views.line_limits(spark), LINE_COLUMNS, LINE_OUTCOMES)


@query(f"WITH {ZONES_SQL} SELECT batch_id, variable, value, zone FROM zoned WHERE zone <> 'inside'")
def spc_zones(spark, folder):
    rows = limits.zoned_rows(views.lines(spark, folder), _limits(spark), MEASURED, keep=["batch_id"])
    return rows.filter(F.col("zone") != "inside").select("batch_id", "variable", "value", "zone")


SUMMARY_SQL = f"""{ZONES_SQL}, margins AS (
  SELECT *, CASE WHEN lower_limit IS NULL THEN upper_limit - value WHEN upper_limit IS NULL THEN value - lower_limit
                 ELSE least(value - lower_limit, upper_limit - value) END AS margin FROM zoned
), s AS (
  SELECT variable, any_value(role) AS role, any_value(unit) AS unit, any_value(criticality) AS criticality,
         any_value(notes) AS notes, any_value(target) AS target, any_value(lower_limit) AS lower_limit,
         any_value(upper_limit) AS upper_limit, count(value) AS count, count(*) - count(value) AS missing_count,
         avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
         count(*) FILTER (value < lower_limit) AS below_limit_count, count(*) FILTER (value > upper_limit) AS above_limit_count,
         count(*) FILTER (zone LIKE 'near%') AS near_count, median(margin) AS median_nearest_limit_margin,
         min(margin) AS worst_limit_margin FROM margins GROUP BY variable
), p AS (
  SELECT *, 100.0::DOUBLE * (below_limit_count + above_limit_count) / count AS percent_outside,
         100.0::DOUBLE * (count - below_limit_count - above_limit_count) / count AS percent_inside,
         100.0::DOUBLE * near_count / count AS percent_close_to_limit,
         CASE WHEN upper_limit > lower_limit THEN (max - min) / (upper_limit - lower_limit) END AS used_range_ratio,
         CASE WHEN upper_limit > lower_limit THEN (upper_limit - lower_limit) / (6 * std) END AS cp,
         CASE WHEN upper_limit > lower_limit THEN least(upper_limit - mean, mean - lower_limit) / (3 * std) END AS cpk,
         CASE WHEN lower_limit IS NOT NULL AND upper_limit IS NOT NULL THEN 'two_sided'
              WHEN lower_limit IS NOT NULL THEN 'lower_only' WHEN upper_limit IS NOT NULL THEN 'upper_only'
              WHEN target IS NOT NULL THEN 'target_only' ELSE 'no_limits' END AS limit_kind FROM s
), labelled AS (
  SELECT *, CASE WHEN limit_kind = 'no_limits' THEN 'Reference only' WHEN count < 20 THEN 'Insufficient data'
    WHEN role = 'qc' AND (percent_outside > 0 OR percent_close_to_limit >= 20) THEN 'High failure risk'
    WHEN role = 'qc' THEN 'Looks reasonable'
    WHEN used_range_ratio < 0.35 AND percent_outside = 0 THEN 'Insufficient data'
    WHEN percent_close_to_limit >= 15 OR percent_outside > 0 THEN 'Insufficient data'
    WHEN abs(mean - target) > 0.2 * (upper_limit - lower_limit) THEN 'Target may be off-center'
    ELSE 'Looks reasonable' END AS classification FROM p
)"""


@query(f"""WITH {SUMMARY_SQL}
SELECT variable, role, unit, criticality, round(target, 6) AS target, round(lower_limit, 6) AS lower_limit,
       round(upper_limit, 6) AS upper_limit, limit_kind, count, missing_count, round(mean, 6) AS mean, round(std, 6) AS std,
       round(min, 6) AS min, round(max, 6) AS max, round(percent_inside, 6) AS percent_inside,
       round(percent_outside, 6) AS percent_outside, below_limit_count, above_limit_count,
       round(percent_close_to_limit, 6) AS percent_close_to_limit, round(used_range_ratio, 6) AS used_range_ratio,
       round(median_nearest_limit_margin, 6) AS median_nearest_limit_margin,
       round(worst_limit_margin, 6) AS worst_limit_margin, round(cp, 6) AS cp, round(cpk, 6) AS cpk,
       CAST(NULL AS DOUBLE) AS max_driver_score, false AS confounding_flag, classification, notes FROM labelled""")
def spc_summary(spark, folder):
    return rounded(_check(spark, folder).summary.drop("reason", "priority"), 6)


@query(f"""WITH {SUMMARY_SQL} SELECT classification, count(*) AS variable_count FROM labelled GROUP BY 1""")
def agg_label_counts(spark, folder):
    return limits.label_counts(_check(spark, folder).summary)


@query(f"""WITH {SUMMARY_SQL}, scores AS (
  SELECT variable, CASE WHEN corr(value, y) >= 0 THEN 0.9e0 ELSE 0.1e0 END AS score FROM zoned
  WHERE variable <> 'l_extendedprice' GROUP BY variable
), near AS (SELECT p.*, score, percent_close_to_limit >= 15 OR percent_outside > 0 AS close_or_out FROM p LEFT JOIN scores USING (variable))
SELECT variable, round(score, 6) AS max_driver_score, CASE
    WHEN limit_kind = 'no_limits' THEN 'Reference only' WHEN count < 20 THEN 'Insufficient data'
    WHEN role = 'qc' AND (percent_outside > 0 OR percent_close_to_limit >= 20) THEN 'High failure risk'
    WHEN role = 'qc' THEN 'Looks reasonable'
    WHEN variable = 'l_tax' THEN 'Confounded - review manually'
    WHEN used_range_ratio < 0.35 AND percent_outside = 0 THEN 'Insufficient data'
    WHEN score IS NULL AND close_or_out THEN 'Insufficient data'
    WHEN abs(mean - target) > 0.2 * (upper_limit - lower_limit) THEN 'Target may be off-center'
    WHEN score >= 0.55 AND close_or_out THEN 'Possibly too wide'
    WHEN score < 0.2 AND (percent_close_to_limit >= 30 OR percent_outside >= 5) THEN 'Possibly too narrow'
    ELSE 'Looks reasonable' END AS classification,
  CAST(CASE WHEN limit_kind = 'no_limits' THEN 7 WHEN count < 20 THEN 6
    WHEN role = 'qc' AND (percent_outside > 0 OR percent_close_to_limit >= 20) THEN 1
    WHEN role = 'qc' THEN 5 WHEN variable = 'l_tax' THEN 2
    WHEN used_range_ratio < 0.35 AND percent_outside = 0 THEN 6
    WHEN score IS NULL AND close_or_out THEN 6
    WHEN abs(mean - target) > 0.2 * (upper_limit - lower_limit) THEN 4
    WHEN score >= 0.55 AND close_or_out THEN 3
    WHEN score < 0.2 AND (percent_close_to_limit >= 30 OR percent_outside >= 5) THEN 4 ELSE 5 END AS INTEGER) AS priority
FROM near""")
def spc_labels(spark, folder):
    """Labels with driver scores (here the sign of a correlation) and one confounded column."""
    from lotwise.operators.stats import pair_correlations

    data = views.lines(spark, folder)
    ranked = pair_correlations(data, LINE_COLUMNS, LINE_OUTCOMES).select(
        F.col("first").alias("process_variable"),
        F.when(F.col("correlation") >= 0, 0.9).otherwise(0.1).alias("combined_score"))
    summary = limits.limit_summary(data, _limits(spark), MEASURED, LINE_OUTCOMES, ranked, ["l_tax"])
    return rounded(summary.select("variable", "max_driver_score", "classification", "priority"), 6)


@query(f"""WITH {ZONES_SQL}
SELECT batch_id, variable, role, value, CASE WHEN value > upper_limit THEN 'above_upper_limit' ELSE 'below_lower_limit' END AS status,
       lower_limit, upper_limit, unit FROM zoned WHERE value > upper_limit OR value < lower_limit""")
def spc_out_of_spec(spark, folder):
    return limits.out_of_limit_rows(views.lines(spark, folder), _limits(spark), MEASURED, LINE_OUTCOMES)


@query(f"""WITH {ZONES_SQL}
SELECT variable, 'l_extendedprice' AS outcome, zone, count(y) AS count, round(avg(y), 6) AS mean
FROM zoned WHERE role = 'process' GROUP BY variable, zone""")
def spc_zone_means(spark, folder):
    return rounded(limits.zone_means(views.lines(spark, folder), _limits(spark), MEASURED, LINE_OUTCOMES), 6)


@query(f"""WITH {SUMMARY_SQL}
SELECT variable, count, round(cp, 6) AS cp, round(cpk, 6) AS cpk FROM p""")
def spc_capability(spark, folder):
    return rounded(limits.capability(views.lines(spark, folder), _limits(spark), MEASURED), 6)


@query(f"""WITH {LIMITS_SQL}
SELECT l.variable, 'unmatched' AS state FROM limits l
WHERE l.variable NOT IN (SELECT variable FROM long_lines UNION SELECT 'l_extendedprice')
UNION ALL SELECT variable, 'matched' FROM limits
WHERE variable IN (SELECT variable FROM long_lines UNION SELECT 'l_extendedprice')""")
def spc_unmatched(spark, folder):
    data = views.lines(spark, folder)
    found, lost = limits.split_limits(data, _limits(spark))
    measured = limits.measured_rows(data, found, MEASURED).select("variable").distinct()
    return measured.withColumn("state", F.lit("matched")).unionByName(
        lost.select("variable", F.lit("unmatched").alias("state")))


@query(f"""WITH {ZONES_SQL}
SELECT batch_id, variable, value, y AS outcome_value, CASE
  WHEN value > upper_limit THEN 'above_spec' WHEN value < lower_limit THEN 'below_spec'
  WHEN value >= upper_limit - 0.1e0 * (upper_limit - lower_limit) THEN 'near_upper_edge'
  WHEN value <= lower_limit + 0.1e0 * (upper_limit - lower_limit) THEN 'near_lower_edge' ELSE 'inside' END AS zone
FROM zoned WHERE variable IN ('l_quantity', 'l_tax')""")
def cht_variable_zone(spark, folder):
    return charts.variable_with_zone(
        views.lines(spark, folder), _limits(spark), ["l_quantity", "l_tax"], "l_extendedprice")


@query(f"""WITH {SUMMARY_SQL}
SELECT variable, role, round(percent_outside, 6) AS percent_outside, round(percent_close_to_limit, 6) AS percent_close_to_limit,
       classification FROM labelled ORDER BY percent_outside DESC, variable LIMIT 3""")
def cht_margin_bars(spark, folder):
    return rounded(charts.margin_bars(_check(spark, folder).summary, 3), 6)


@query(f"""WITH {LIMITS_SQL}
SELECT 'mean' AS line, round(avg(l_quantity), 6) AS value FROM lines
UNION ALL SELECT 'median', round(median(l_quantity), 6) FROM lines
UNION ALL SELECT 'target', round(target, 6) FROM limits WHERE variable = 'l_quantity'
UNION ALL SELECT 'lower_limit', round(lower_limit, 6) FROM limits WHERE variable = 'l_quantity'
UNION ALL SELECT 'upper_limit', round(upper_limit, 6) FROM limits WHERE variable = 'l_quantity'""")
def cht_distribution_lines(spark, folder):
    return rounded(charts.distribution_lines(views.lines(spark, folder), "l_quantity", _limits(spark)), 6)
