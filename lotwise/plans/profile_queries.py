"""Profile and audit tables over the joined process and QC tables."""

from __future__ import annotations

from lotwise.functions import names
from lotwise.functions.formats import rounded
from lotwise.operators import audit, profile, stats
from lotwise.plans import views
from lotwise.plans.registry import ORACLES, query
from lotwise.plans.views import MEASURES, MEASURES_SQL, MERGED_SQL, OUTCOMES, PROCESS_COLUMNS

TEXTS = ["order_status", "order_priority", "supplier_segment", "site_nation", "order_date", "site_flag"]
NUMBERS = ["account_balance", "balance_reading", "priority_rank"]


def _union(template: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(template.format(c=c) for c in columns)


LONG_VALUES = "values_long AS (" + _union(
    "SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value FROM merged", TEXTS + NUMBERS) + ")"
FACTS_SQL = f"""{MERGED_SQL}, {LONG_VALUES}, freq AS (
  SELECT variable, value, count(*) AS n FROM values_long WHERE value IS NOT NULL GROUP BY 1, 2
), facts AS (
  SELECT variable, CAST(sum(n) AS BIGINT) AS non_missing, count(*) AS unique_count, max(n) AS top_count,
         first(value ORDER BY n DESC, value) AS top_value FROM freq GROUP BY 1
)"""
NUMERIC = ", ".join(f"'{c}'" for c in NUMBERS)


@query(f"""WITH {FACTS_SQL}
SELECT variable AS "column", CASE WHEN unique_count <= 2 THEN 'binary' WHEN variable IN ({NUMERIC}) THEN 'continuous'
       ELSE 'categorical' END AS type, non_missing, unique_count FROM facts""")
def prf_types(spark, folder):
    return profile.variable_types(views.merged(spark, folder), PROCESS_COLUMNS)


@query(f"""WITH {FACTS_SQL}, t AS (
  SELECT variable, non_missing, unique_count, CASE WHEN unique_count <= 2 THEN 'binary' WHEN variable IN ({NUMERIC})
         THEN 'continuous' ELSE 'categorical' END AS type FROM facts)
SELECT variable AS "column", type, non_missing, CASE WHEN type <> 'continuous' THEN unique_count END AS level_count FROM t""")
def prf_estimated_types(spark, folder):
    """Types without a shuffle of continuous values; the estimates themselves are left out of the comparison."""
    types = profile.estimated_types(views.merged(spark, folder), PROCESS_COLUMNS)
    return types.selectExpr("column", "type", "non_missing", "IF(type <> 'continuous', unique_count, NULL) AS level_count")


@query(f"""WITH {FACTS_SQL} SELECT * FROM freq WHERE variable IN ('order_status', 'order_priority', 'supplier_segment', 'site_nation')""")
def agg_value_frequencies(spark, folder):
    return stats.value_frequencies(
        views.merged(spark, folder), ["order_status", "order_priority", "supplier_segment", "site_nation"])


@query(f"WITH {MERGED_SQL} " + _union(
    """SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
       round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 6) AS missing_percent,
       100.0::DOUBLE * (count(*) - count({c})) / count(*) > 20 AS flag FROM merged""",
    PROCESS_COLUMNS + OUTCOMES))
def prf_missingness(spark, folder):
    return rounded(profile.missingness(views.merged(spark, folder), PROCESS_COLUMNS + OUTCOMES), 6)


@query(f"""WITH {FACTS_SQL}
SELECT variable AS "column", CASE WHEN unique_count = 1 THEN 'constant' ELSE 'near-constant' END AS reason, unique_count,
       top_value, round(100.0::DOUBLE * top_count / non_missing, 6) AS top_value_percent
FROM facts WHERE unique_count = 1 OR 100.0::DOUBLE * top_count / non_missing >= 95""")
def prf_near_constant(spark, folder):
    return rounded(profile.near_constant(views.merged(spark, folder), PROCESS_COLUMNS), 6)


@query(f"WITH {MERGED_SQL} " + _union(
    """SELECT '{c}' AS outcome, count({c}) AS count, count(*) - count({c}) AS missing_count,
       round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 6) AS missing_percent, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.5), 6) AS median, max({c}) AS max
       FROM merged""", OUTCOMES).replace("min(", "round(min(").replace(") AS min", "), 6) AS min").replace(
           " max(", " round(max(").replace(") AS max", "), 6) AS max"))
def prf_outcome_stats(spark, folder):
    return rounded(stats.outcome_statistics(views.merged(spark, folder), OUTCOMES), 6)


@query(f"""WITH {FACTS_SQL}, t AS (
  SELECT CASE WHEN unique_count <= 2 THEN 'binary' WHEN variable IN ({NUMERIC}) THEN 'continuous' ELSE 'categorical' END AS type
  FROM facts)
SELECT count(*) FILTER (type = 'continuous') AS continuous_count, count(*) FILTER (type = 'categorical') AS categorical_count,
       count(*) FILTER (type = 'binary') AS binary_count FROM t""")
def prf_type_counts(spark, folder):
    return profile.type_counts(profile.variable_types(views.merged(spark, folder), PROCESS_COLUMNS))


@query(f"""WITH {FACTS_SQL}
SELECT CAST(1 AS INTEGER) AS seq, 'high_missing' AS code, count(*) || ' column(s) miss more than 20% of their values.' AS message
FROM facts WHERE 100.0 * ((SELECT count(*) FROM merged) - non_missing) / (SELECT count(*) FROM merged) > 20 HAVING count(*) > 0
UNION ALL SELECT 2, 'near_constant', count(*) || ' process variable(s) are constant or nearly so.'
FROM facts WHERE unique_count = 1 OR 100.0 * top_count / non_missing >= 95 HAVING count(*) > 0""")
def prf_warnings(spark, folder):
    return profile.build_profile(views.merged(spark, folder), OUTCOMES).warnings


@query(f"""WITH {MERGED_SQL}, e AS (SELECT min(yield_amount) AS lo, max(yield_amount) AS hi FROM merged),
c AS (SELECT least(CAST(floor((yield_amount - lo) / ((hi - lo) / 20)) AS BIGINT) + 1, 20) AS bin, count(*) AS n FROM merged, e GROUP BY 1)
SELECT b.bin, round(lo + (b.bin - 1) * ((hi - lo) / 20), 6) AS bin_start, round(lo + b.bin * ((hi - lo) / 20), 6) AS bin_end,
       coalesce(n, 0) AS row_count FROM range(1, 21) b(bin) LEFT JOIN c ON c.bin = b.bin, e""")
def agg_histogram(spark, folder):
    return rounded(stats.histogram(views.merged(spark, folder), "yield_amount", 20), 6)


# --- audit ------------------------------------------------------------------

@query(f"""WITH {MERGED_SQL}
SELECT count(*) AS batch_count, CASE WHEN count(*) < 10 THEN 'under_10' WHEN count(*) < 30 THEN 'under_30'
       WHEN count(*) < 80 THEN 'under_80' ELSE '80_or_more' END AS guidance FROM merged""")
def aud_sample_size(spark, folder):
    return audit.sample_size_guidance(views.merged(spark, folder))


@query(f"WITH {MEASURES_SQL}, r AS (" + _union(
    "SELECT '{c}' AS process_column, 'yield_amount' AS outcome, count(*) AS n, corr({c}, yield_amount) AS c FROM measures",
    MEASURES) + """)
SELECT process_column, outcome, n, round(c, 6) AS correlation, round(abs(c), 6) AS absolute_correlation
FROM r WHERE n >= 8 AND abs(c) >= 0.95""")
def aud_leakage_corr(spark, folder):
    return rounded(audit.leakage_correlations(views.measures(spark, folder), MEASURES, ["yield_amount"]), 6)


COLLINEAR = " UNION ALL ".join(
    f"SELECT '{a}' AS first_column, '{b}' AS second_column, count(*) AS n, corr({a}, {b}) AS c FROM measures"
    for i, a in enumerate(MEASURES) for b in MEASURES[i + 1:]
)


@query(f"""WITH {MEASURES_SQL}, r AS ({COLLINEAR})
SELECT first_column, second_column, n, round(c, 6) AS correlation, round(abs(c), 6) AS absolute_correlation
FROM r WHERE n >= 8 AND abs(c) >= 0.85""")
def aud_collinear(spark, folder):
    return rounded(audit.collinear_pairs(views.measures(spark, folder), MEASURES), 6)


@query(f"""WITH {MEASURES_SQL}, r AS ({COLLINEAR})
SELECT first_column AS "first", second_column AS "second", n, round(c, 6) AS correlation FROM r""")
def agg_correlations(spark, folder):
    """The matrix form, which wide tables use, on the same pairs."""
    return rounded(stats.pair_correlations(views.measures(spark, folder), MEASURES), 6)


@query(f"""WITH {MERGED_SQL}
SELECT 'order_status' AS "column", 'order' AS matched_terms, CAST(0 AS DOUBLE) AS parseable_date_fraction
UNION ALL SELECT 'order_priority', 'order', CAST(0 AS DOUBLE)
UNION ALL SELECT 'order_date', 'date, order', count(try_strptime(order_date, '%Y-%m-%d')) / count(order_date) FROM merged""")
def aud_date_fraction(spark, folder):
    return audit.drift_columns(views.merged(spark, folder), PROCESS_COLUMNS)


@query(f"""WITH {FACTS_SQL}
SELECT variable AS "column", unique_count, round(unique_count / (SELECT count(*) FROM merged), 6) AS unique_ratio
FROM facts WHERE (unique_count <= 2 OR variable NOT IN ({NUMERIC}))
  AND (unique_count >= 20 OR unique_count / (SELECT count(*) FROM merged) >= 0.2)""")
def aud_cardinality(spark, folder):
    return rounded(audit.many_levels(views.merged(spark, folder), PROCESS_COLUMNS), 6)


@query(f"""WITH {FACTS_SQL}
SELECT variable AS "column", CASE WHEN variable = 'supplier_segment' THEN 'supplier' ELSE 'site' END AS matched_terms,
       unique_count, top_value AS most_common_level, round(100.0::DOUBLE * top_count / non_missing, 6) AS most_common_level_percent
FROM facts WHERE variable IN ('supplier_segment', 'site_nation', 'site_flag')""")
def aud_confounding(spark, folder):
    return rounded(audit.confounding(views.merged(spark, folder), PROCESS_COLUMNS), 6)


@query(f"""WITH {MERGED_SQL}, n AS (
  SELECT count(*) AS total, count(*) FILTER (balance_reading IS NULL) AS gaps FROM merged)
SELECT m.metric, CASE WHEN m.metric = 'rows_with_missing_outcome_field' THEN 0 ELSE gaps END AS count,
       round(CASE WHEN m.metric = 'rows_with_missing_outcome_field' THEN 0 ELSE 100.0::DOUBLE * gaps / total END, 6) AS percent
FROM n, (VALUES ('rows_with_any_missing_selected_field'), ('rows_with_missing_process_field'),
                ('rows_with_missing_outcome_field')) AS m(metric)""")
def aud_row_missing(spark, folder):
    return rounded(audit.row_missing(views.merged(spark, folder), PROCESS_COLUMNS, OUTCOMES), 6)


OUTLIER_COLUMNS = ["account_balance", "priority_rank", *OUTCOMES]


def _outliers_sql(columns: list[str]) -> str:
    return f"WITH {MERGED_SQL}, v AS (" + _union(
        "SELECT '{c}' AS variable, {c} AS value FROM merged", columns) + """), q AS (
  SELECT variable, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(DISTINCT value) AS d,
         count(value) AS n FROM v GROUP BY 1
), f AS (SELECT variable, n, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q WHERE b > a AND d >= 4)
SELECT variable AS "column", count(*) AS outlier_count, round(100.0::DOUBLE * count(*) / any_value(n), 6) AS outlier_percent,
       round(any_value(lo), 6) AS lower_flag_limit, round(any_value(hi), 6) AS upper_flag_limit
FROM v JOIN f USING (variable) WHERE value < lo OR value > hi GROUP BY 1"""


@query(_outliers_sql(OUTLIER_COLUMNS))
def aud_outliers(spark, folder):
    return rounded(audit.outliers(views.merged(spark, folder), OUTLIER_COLUMNS), 6)


def _strong_pairs(pairs: list[tuple[str, str]], least: float) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS c FROM merged" for a, b in pairs
    ) + f") WHERE n >= 8 AND abs(c) >= {least}"


_WORDS = ", ".join(f"('{w}')" for w in names.LEAKAGE_WORDS)
_COLUMNS = ", ".join(f"('{c}')" for c in PROCESS_COLUMNS)
HITS_SQL = f"""WITH {MERGED_SQL}, hits AS (
  SELECT 1 AS seq, 'leakage_names' AS code, 'leakage_name_count' AS metric, count(*) AS n,
         'process column name(s) hint at post-release information.' AS text
  FROM (VALUES {_COLUMNS}) c(name) WHERE EXISTS (SELECT 1 FROM (VALUES {_WORDS}) w(word) WHERE contains(name, word))
  UNION ALL SELECT 2, 'leakage_correlations', 'leakage_correlation_count', count(*), 'feature and outcome pair(s) are nearly identical.'
  FROM ({_strong_pairs([(a, b) for a in NUMBERS for b in OUTCOMES], 0.95)})
  UNION ALL SELECT 3, 'drift', 'drift_column_count', count(*), 'column(s) may encode time, sequence or campaign.' FROM ({ORACLES["aud_date_fraction"]})
  UNION ALL SELECT 4, 'many_levels', 'many_level_count', count(*), 'categorical column(s) have many levels.' FROM ({ORACLES["aud_cardinality"]})
  UNION ALL SELECT 5, 'confounding', 'confounding_count', count(*), 'categorical column(s) may be confounded with time or practice.'
  FROM ({ORACLES["aud_confounding"]})
  UNION ALL SELECT 7, 'outliers', 'outlier_column_count', count(*), 'numeric column(s) hold outliers; review, do not drop.'
  FROM ({_outliers_sql(NUMBERS + list(OUTCOMES))})
  UNION ALL SELECT 8, 'collinear', 'collinear_pair_count', count(*), 'process variable pair(s) are highly correlated.'
  FROM ({_strong_pairs([(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]], 0.85)})
), gaps AS ({ORACLES["aud_row_missing"]}), warned AS (
  SELECT CAST(seq AS INTEGER) AS seq, code, n || ' ' || text AS message FROM hits WHERE n > 0
  UNION ALL SELECT 6, 'row_missing', printf('%.1f%% of rows miss at least one selected field.', percent) FROM gaps
  WHERE metric = 'rows_with_any_missing_selected_field' AND percent > 20
  UNION ALL SELECT 0, 'sample_size', CASE WHEN count(*) < 30 THEN 'Fewer than 30 batches: results are exploratory.'
    ELSE 'Fewer than 80 batches: advanced models may overfit.' END FROM merged HAVING count(*) < 80
)"""


@query(f"{HITS_SQL} SELECT * FROM warned")
def aud_warnings(spark, folder):
    return audit.run_audit(views.merged(spark, folder), PROCESS_COLUMNS, OUTCOMES).warnings


@query(f"""{HITS_SQL} SELECT metric, n AS value FROM hits
UNION ALL SELECT 'warning_count', count(*) FROM warned UNION ALL SELECT 'batch_count', count(*) FROM merged
UNION ALL SELECT metric, count FROM gaps WHERE metric <> 'rows_with_missing_process_field'""")
def aud_summary(spark, folder):
    return audit.audit_summary(audit.run_audit(views.merged(spark, folder), PROCESS_COLUMNS, OUTCOMES))
