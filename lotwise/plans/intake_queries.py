"""Cleaning, reshaping, matching and readiness over the derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotwise.functions import clean
from lotwise.functions.formats import rounded
from lotwise.operators import match, reshape, retype
from lotwise.plans import views
from lotwise.plans.registry import query
from lotwise.plans.views import LONG_SQL, MERGED_SQL, OUTCOMES, PROCESS_SQL, QC_SQL
from lotwise.session import checkpoint_folder
from lotwise.sources import delimited, sinks

KEY, QC_KEY = "Batch ID", "Batch Identifier"
DUPLICATES = [QC_KEY, "Test Name", "event_id", "value"]


@query(f"""WITH {PROCESS_SQL}
SELECT "Batch ID" AS raw_key, upper(regexp_replace(trim("Batch ID"), '[ _-]+', '', 'g')) AS batch_key FROM process""")
def scl_key_normalise(spark, folder):
    rows = views.process(spark, folder)
    return rows.select(F.col(KEY).alias("raw_key"), reshape.normalised_key(rows, KEY).alias("batch_key"))


@query(f"""WITH {LONG_SQL} SELECT event_id, "Result" AS raw, number, qualifier FROM parsed""")
def scl_parse_number(spark, folder):
    cell = F.col("Result")
    return views.long_results(spark, folder).select(
        "event_id", cell.alias("raw"), clean.parsed_number(cell).alias("number"),
        clean.parsed_qualifier(cell).alias("qualifier"),
    )


@query(f"""WITH {LONG_SQL}
SELECT 'Result' AS "column", count(number) AS non_missing_values, count(number) AS parsed_values,
       CAST(1.0 AS DOUBLE) AS parsed_fraction, count(qualifier) AS qualifier_count,
       (SELECT string_agg(r, ', ' ORDER BY r) FROM
         (SELECT DISTINCT "Result" AS r FROM parsed WHERE number IS NOT NULL ORDER BY r LIMIT 4)) AS examples
FROM parsed""")
def nrm_parse_report(spark, folder):
    return retype.retype(views.long_results(spark, folder)).report


@query(f"""WITH {LONG_SQL} SELECT event_id, "Batch Identifier", "Test Name", number AS "Result" FROM parsed""")
def nrm_retype(spark, folder):
    return retype.retype(views.long_results(spark, folder)).data.select("event_id", QC_KEY, "Test Name", "Result")


@query(f"""WITH {LONG_SQL}
SELECT count(*) AS duplicate_batch_count FROM (SELECT batch_key FROM parsed GROUP BY 1 HAVING count(*) > 1)""")
def agg_duplicate_count(spark, folder):
    return reshape.duplicate_key_count(views.long_results(spark, folder), QC_KEY)


@query(f"""WITH {LONG_SQL}, k AS (SELECT batch_key, count(*) AS n FROM parsed GROUP BY 1)
SELECT 'QC' AS table_label, 'mean' AS strategy, count(*) FILTER (n > 1) AS duplicate_batch_count,
       CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after FROM k""")
def agg_duplicate_log(spark, folder):
    return reshape.duplicate_log(views.long_results(spark, folder), QC_KEY, "mean", "QC")


def _kept(order: str) -> str:
    return f"""WITH {LONG_SQL}
SELECT event_id, "Batch Identifier", "Test Name", "Result" FROM parsed
QUALIFY row_number() OVER (PARTITION BY batch_key ORDER BY event_id {order}) = 1"""


@query(_kept("ASC"))
def agg_keep_first(spark, folder):
    rows = views.long_results(spark, folder).select("event_id", QC_KEY, "Test Name", "Result")
    return reshape.resolve_duplicates(rows, QC_KEY, "keep_first", ["event_id"])


@query(_kept("DESC"))
def agg_keep_last(spark, folder):
    rows = views.long_results(spark, folder).select("event_id", QC_KEY, "Test Name", "Result")
    return reshape.resolve_duplicates(rows, QC_KEY, "keep_last", ["event_id"])


def _summary(fn: str) -> str:
    return f"""WITH {LONG_SQL}
SELECT arg_min("Batch Identifier", event_id) AS "Batch Identifier", arg_min("Test Name", event_id) AS "Test Name",
       round({fn}(event_id), 6) AS event_id, round({fn}(value), 6) AS value
FROM parsed GROUP BY batch_key"""


@query(_summary("avg"))
def agg_mean(spark, folder):
    rows = views.long_results(spark, folder).select(*DUPLICATES)
    return rounded(reshape.summarise_duplicates(rows, QC_KEY, ["event_id"], "mean"), 6)


@query(_summary("median"))
def agg_median(spark, folder):
    rows = views.long_results(spark, folder).select(*DUPLICATES)
    return rounded(reshape.summarise_duplicates(rows, QC_KEY, ["event_id"], "median"), 6)


def _pivot(expression: str) -> str:
    columns = ", ".join(
        f"""round({expression.format(test=f"'{t}'")}, 6) AS "{t}" """
        for t in ("click", "error", "purchase", "signup", "view")
    )
    return f'WITH {LONG_SQL} SELECT "Batch Identifier", {columns} FROM parsed GROUP BY 1'


@query(_pivot("""arg_min(number, event_id) FILTER ("Test Name" = {test} AND number IS NOT NULL)"""))
def agg_pivot_first(spark, folder):
    return rounded(reshape.long_to_wide(
        views.long_results(spark, folder), QC_KEY, "Test Name", "Result", "first", ["event_id"]), 6)


@query(_pivot("""avg(number) FILTER ("Test Name" = {test})"""))
def agg_pivot_mean(spark, folder):
    return rounded(reshape.long_to_wide(
        views.long_results(spark, folder), QC_KEY, "Test Name", "Result", "mean"), 6)


@query(_pivot("""median(number) FILTER ("Test Name" = {test})"""))
def agg_pivot_median(spark, folder):
    return rounded(reshape.long_to_wide(
        views.long_results(spark, folder), QC_KEY, "Test Name", "Result", "median"), 6)


@query(f"""WITH {LONG_SQL}, f AS (
  SELECT count(DISTINCT "Batch Identifier") < count(*) AND count(DISTINCT "Test Name") >= 2 AS likely FROM parsed)
SELECT c."column", c.candidate_for, CAST(c.position AS BIGINT) AS position, f.likely AS likely_long_format
FROM f, (VALUES ('Batch Identifier', 'batch', 1), ('Test Name', 'name', 1), ('Result', 'value', 1),
                ('value', 'value', 2), ('event_id', 'value', 3), ('user_id', 'value', 4))
     AS c("column", candidate_for, position)""")
def agg_long_format(spark, folder):
    rows = views.long_results(spark, folder).select(
        "event_id", "user_id", QC_KEY, "Test Name", "Result", "value")
    return reshape.long_format_candidates(rows)


# --- match ------------------------------------------------------------------

@query(f"""WITH {MERGED_SQL} SELECT "Batch ID" AS batch_id, * EXCLUDE ("Batch ID") FROM merged""")
def jon_merge(spark, folder):
    return match.match_tables(
        views.process(spark, folder), views.qc(spark, folder), KEY, QC_KEY, OUTCOMES).data


@query(f"""WITH {PROCESS_SQL}, {QC_SQL}
SELECT CASE WHEN q.batch_key IS NULL THEN 'process' ELSE 'qc' END AS side,
       coalesce(p.batch_key, q.batch_key) AS batch_key
FROM process p FULL JOIN qc q ON p.batch_key = q.batch_key
WHERE p.batch_key IS NULL OR q.batch_key IS NULL""")
def jon_unmatched(spark, folder):
    return match.unmatched_keys(views.process(spark, folder), views.qc(spark, folder), KEY, QC_KEY)


FRACTIONS_SQL = f"""{PROCESS_SQL}, {QC_SQL}, counts AS (
  SELECT (SELECT count(*) FROM process) AS process_batches, (SELECT count(*) FROM qc) AS qc_batches,
         (SELECT count(*) FROM process JOIN qc USING (batch_key)) AS matched_batches)"""


@query(f"""WITH {FRACTIONS_SQL}
SELECT *, matched_batches / process_batches AS process_match_fraction,
       matched_batches / qc_batches AS qc_match_fraction FROM counts""")
def set_match_fractions(spark, folder):
    return match.match_counts(views.process(spark, folder), views.qc(spark, folder), KEY, QC_KEY)


@query(f"""WITH {LONG_SQL}
SELECT count(*) FILTER (number IS NULL) AS missing_keys FROM parsed""")
def prj_missing_keys(spark, folder):
    return match.missing_key_count(views.long_results(spark, folder), "Result")


READINESS_SQL = f"""{PROCESS_SQL}, {LONG_SQL}, users AS (
  SELECT batch_key, count(*) AS n FROM parsed GROUP BY 1
), facts AS (
  SELECT (SELECT count(*) FROM users WHERE n > 1) AS repeated, (SELECT count(*) FROM users) AS qc_batches,
         (SELECT count(*) FROM process) AS process_batches,
         (SELECT count(*) FROM users u JOIN process p ON replace(p.batch_key, 'ORD', 'U') = u.batch_key) AS matched,
         (SELECT count(number) / count(*) FROM parsed) AS numeric_share, (SELECT count(number) FROM parsed) AS numbers,
         (SELECT count(qualifier) FROM parsed) AS marks
), messages AS (
  SELECT 'warning' AS severity, 'qc_duplicates' AS code, 'The qc table repeats ' || repeated ||
         ' batch key(s). They are resolved before the join.' AS message FROM facts WHERE repeated > 0
  UNION ALL SELECT 'blocker', 'no_overlap', 'No batch key is found on both sides.' FROM facts WHERE matched = 0
  UNION ALL SELECT 'warning', 'low_overlap', 'Only ' || matched || ' batch key(s) are found on both sides.'
    FROM facts WHERE matched > 0 AND least(matched / process_batches, matched / qc_batches) < 0.7
  UNION ALL SELECT 'info', 'overlap', matched || ' batch key(s) are found on both sides.'
    FROM facts WHERE matched > 0 AND least(matched / process_batches, matched / qc_batches) >= 0.7
  UNION ALL SELECT 'blocker', 'outcome_not_numeric', 'Result holds no number.' FROM facts WHERE numbers = 0
  UNION ALL SELECT 'warning', 'outcome_missing', 'Result is missing or not numeric in ' ||
         printf('%.0f', 100 * (1 - numeric_share)) || ' % of rows.' FROM facts WHERE numbers > 0 AND 1 - numeric_share > 0.2
  UNION ALL SELECT 'info', 'qc_converted', 'The qc table has 1 converted text column(s), such as Result.' FROM facts
  UNION ALL SELECT 'warning', 'qc_qualifiers', 'The qc table has ' || marks ||
         ' value(s) with a mark such as < or >; read them with care.' FROM facts WHERE marks > 0
)"""


def _readiness(spark, folder):
    process = views.process(spark, folder).withColumn(KEY, F.regexp_replace(KEY, "(?i)ord", "U"))
    qc = retype.retype(views.long_results(spark, folder))
    return match.readiness_messages(
        process, qc.data, KEY, QC_KEY, ["Result"], qc_rule="mean", qc_report=qc.report)


@query(f"WITH {READINESS_SQL} SELECT * FROM messages")
def rdy_messages(spark, folder):
    return _readiness(spark, folder)


@query(f"""WITH {READINESS_SQL}, n AS (
  SELECT count(*) FILTER (severity = 'blocker') AS blocker_count, count(*) FILTER (severity = 'warning') AS warning_count,
         count(*) FILTER (severity = 'info') AS info_count FROM messages)
SELECT greatest(0, 100 - 35 * blocker_count - 8 * warning_count - least(5, info_count)) AS score, * FROM n""")
def rdy_score(spark, folder):
    return match.readiness_score(_readiness(spark, folder))


# --- sources: one small export per order ------------------------------------

EXPORT_SQL = """
rows AS (
  SELECT l_orderkey, l_linenumber, printf('%.2f', l_quantity) AS q, l_returnflag AS f,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nr
  FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem)
)"""


def _exports(spark, folder):
    """(file, content): title line, blank line, header, then the lines of an order.

    Orders have few lines, so a content is short; the lines are combined per
    order before they are joined to a text.
    """
    line = F.concat_ws(",", F.col("l_linenumber").cast("string"), F.concat(
        F.lit('"'), F.replace(F.format_string("%.2f", "l_quantity"), F.lit("."), F.lit(",")), F.lit(' pcs"')), "l_returnflag")
    body = F.array_join(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t"))))["t"], "\n")
    return views.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(body.alias("body")).select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("file"),
        F.concat(F.lit("Export of order "), F.col("l_orderkey").cast("string"),
                 F.lit("\n\nLine ID,Quantity value,Test result\n"), F.col("body")).alias("content"),
    )


@query(f"""SELECT 'order-' || l_orderkey AS file, CAST(1 AS BIGINT) AS header_row,
       'Line ID,Quantity value,Test result' AS line FROM lineitem GROUP BY l_orderkey""")
def src_header_rows(spark, folder):
    return delimited.text_headers(_exports(spark, folder), "file", "content").select("file", "header_row", "line")


@query("""SELECT 'order-' || l_orderkey AS _file, CAST(l_linenumber AS VARCHAR) AS "Line ID",
       replace(printf('%.2f', l_quantity), '.', ',') || ' pcs' AS "Quantity value", l_returnflag AS "Test result"
FROM lineitem""")
def src_load_rows(spark, folder):
    lines = delimited.with_headers(_exports(spark, folder), "file", "content")
    return delimited.load(lines, None, keep_file=True).drop("_line")


@query("""SELECT 'order-' || l_orderkey AS file, 'title' AS kind, CAST(0 AS BIGINT) AS "row", 'Export of order ' || l_orderkey AS line
FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'order-' || l_orderkey, 'header', 1, 'Line ID,Quantity value,Test result' FROM lineitem GROUP BY l_orderkey""")
def src_preview(spark, folder):
    lines = delimited.split_records(_exports(spark, folder), "file", "content")
    kind = F.when(F.col("row") == 0, "title").otherwise("header")
    return delimited.preview(lines, 2).select("file", kind.alias("kind"), "row", "line")


@query(f"""WITH {PROCESS_SQL}
SELECT trim("Batch ID") AS batch_id, order_status, NULL::VARCHAR AS site_nation, printf('%.2f', account_balance) AS account_balance FROM process WHERE order_status = 'F'
UNION ALL SELECT trim("Batch ID"), NULL, site_nation, printf('%.2f', account_balance) FROM process WHERE order_status <> 'F'""")
def src_read_delimited(spark, folder):
    """Files of two layouts, written from the process table (the writer trims cells) and read in one scan."""
    rows = views.process(spark, folder).select(
        F.col("Batch ID").alias("batch_id"), "order_status", "site_nation", F.format_string("%.2f", "account_balance").alias("account_balance"))
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    sinks.write_table(rows.where("order_status = 'F'").select("batch_id", "order_status", "account_balance"), f"{path}/first", "csv")
    sinks.write_table(rows.where("order_status <> 'F'").select("account_balance", "site_nation", "batch_id"), f"{path}/second", "csv")
    found = delimited.read_delimited(spark, [f"{path}/first", f"{path}/second"])
    return found.select("batch_id", "order_status", "site_nation", "account_balance")
