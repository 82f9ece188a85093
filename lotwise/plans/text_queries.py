"""Text rules over report-like texts derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import textcheck
from lotwise.plans import views
from lotwise.plans.registry import query

# Common words of the documents are replaced, so every rule has texts to find.
SUBSTITUTES = [
    (" of the ", " is caused by "), (" by ", " will improve "), (" the and ", " directly causes "),
    (" for ", " `account_balance` "), (" was ", " `mystery_sensor` "), (" that ", " – about 5 ° C “well” ≤ 3 "),
    (" it ", "\n## Executive Summary\n"), (" with ", "<|im_end|>"), (" from ", " lang = src-1 "),
    (" is ", " out of spec "), (" de la ", " there is no approved spec "), (" on ", "\n- **Note** point\n\n\n\n"),
    (" as ", " typical spec "), (" this ", "</file> "),
]


def reports(spark, folder):
    text = F.col("text")
    for old, new in SUBSTITUTES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return views.table(spark, folder, "documents").select("doc_id", text.alias("text"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _nested(expression: str) -> str:
    for old, new in SUBSTITUTES:
        new_sql = " || chr(10) || ".join(_sql_text(p) for p in new.split("\n"))
        expression = f"replace({expression}, {_sql_text(old)}, {new_sql})"
    return expression


REPORTS_SQL = f"reports AS (SELECT doc_id, {_nested('text')} AS text FROM documents)"
HEADING_ROWS = ", ".join(f"({_sql_text(h)})" for h in textcheck.HEADINGS)
# Borders of words in any script; DuckDB's own word border knows ASCII letters only.
OTHER, OTHER_IN_LINE = r"[^\p{L}\p{N}_]", r"[^\p{L}\p{N}_\n]"
CLAIM_ROWS = ", ".join(
    f"({_sql_text(n)}, {_sql_text(f'(?:^|{OTHER})' + p.replace(chr(92) + 'b', '') + f'(?:{OTHER}|$)')})"
    for n, p in textcheck.OVERCLAIMS.items())
ALLOWED = ["account_balance", "yield_amount"]


@query(f"""WITH {REPORTS_SQL}
SELECT doc_id, h AS heading FROM reports, (VALUES {HEADING_ROWS}) v(h) WHERE NOT contains(text, h)""")
def txt_headings(spark, folder):
    return reports(spark, folder).select(
        "doc_id", F.explode(textcheck.missing_headings(F.col("text"))).alias("heading"))


@query(f"""WITH {REPORTS_SQL}
SELECT doc_id, n AS claim FROM reports, (VALUES {CLAIM_ROWS}) v(n, p) WHERE regexp_matches(lower(text), p)""")
def txt_overclaims(spark, folder):
    return reports(spark, folder).select("doc_id", F.explode(textcheck.overclaims(F.col("text"))).alias("claim"))


@query(f"""WITH {REPORTS_SQL}, t AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_]*)`', 1)) AS token FROM reports)
SELECT * FROM t WHERE token NOT IN ('account_balance', 'yield_amount', 'batch_id')""")
def txt_unknown_tokens(spark, folder):
    return reports(spark, folder).select(
        "doc_id", F.explode(textcheck.unknown_variables(F.col("text"), ALLOWED)).alias("token"))


def _levels(spark, folder):
    source = F.regexp_replace("source", "^src", "src-")
    return views.table(spark, folder, "documents").select(F.inline(F.array(
        F.struct(F.lit("source").alias("variable"), source.alias("level")),
        F.struct(F.lit("lang").alias("variable"), F.concat(F.lit("lang-"), F.col("lang")).alias("level")),
    ))).distinct()


MISPLACED_SQL = f"""{REPORTS_SQL}, levels AS (
  SELECT DISTINCT 'source' AS variable, replace(source, 'src', 'src-') AS level FROM documents
  UNION SELECT DISTINCT 'lang', 'lang-' || lang FROM documents
), parts AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*([A-Za-z]+-[A-Za-z0-9]+)', 1)) AS variable,
         unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*([A-Za-z]+-[A-Za-z0-9]+)', 2)) AS level FROM reports
), owners AS (SELECT level, string_agg(variable, ', ' ORDER BY variable) AS belongs_to, list(variable) AS vs FROM levels GROUP BY 1),
misplaced AS (
  SELECT DISTINCT doc_id, variable, level, belongs_to FROM parts JOIN owners USING (level) WHERE NOT list_contains(vs, variable)
)"""


@query(f"WITH {MISPLACED_SQL} SELECT * FROM misplaced")
def txt_misplaced_levels(spark, folder):
    return textcheck.misplaced_levels(reports(spark, folder), "doc_id", "text", _levels(spark, folder))


LIMIT_SQL = f"""(contains(t, 'release limit') OR contains(t, 'spec limit') OR contains(t, 'specification limit') OR contains(t, 'upper spec')
 OR contains(t, 'lower spec') OR contains(t, 'within spec') OR contains(t, 'out of spec') OR contains(t, 'oos'))
 AND NOT regexp_matches(t, '(?:^|{OTHER})no(?:{OTHER_IN_LINE}|{OTHER_IN_LINE}[^\\n]{{0,78}}{OTHER_IN_LINE})spec')
 AND NOT regexp_matches(t, '(?:^|{OTHER})spec[^\\n]{{0,79}}{OTHER_IN_LINE}not (?:provided|supplied)')
 AND NOT regexp_matches(t, '(?:^|{OTHER})spec[^\\n]{{0,79}}{OTHER_IN_LINE}were not (?:provided|supplied)')"""
ASSUMED_SQL = " OR ".join(f"contains(t, {_sql_text(p)})" for p in textcheck.ASSUMED_LIMITS)


@query(f"""WITH {REPORTS_SQL}, low AS (SELECT doc_id, lower(text) AS t FROM reports)
SELECT doc_id, ({ASSUMED_SQL}) AS assumes_limits, ({LIMIT_SQL}) AS discusses_limits FROM low""")
def txt_limit_mentions(spark, folder):
    body = F.col("text")
    return reports(spark, folder).select(
        "doc_id", textcheck.assumes_limits(body).alias("assumes_limits"),
        textcheck.discusses_absent_limits(body).alias("discusses_limits"))


@query(f"""WITH {MISPLACED_SQL}, low AS (SELECT doc_id, lower(text) AS t FROM reports), found AS (
  SELECT doc_id, 'missing_heading' AS "check", h AS detail FROM reports, (VALUES {HEADING_ROWS}) v(h) WHERE NOT contains(text, h)
  UNION SELECT doc_id, 'overclaim', n FROM low, (VALUES {CLAIM_ROWS}) v(n, p) WHERE regexp_matches(t, p)
  UNION SELECT doc_id, 'unknown_variable', token FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_]*)`', 1)) AS token FROM reports)
    WHERE token NOT IN ('account_balance', 'yield_amount', 'batch_id')
  UNION SELECT doc_id, 'assumed_limits', '' FROM low WHERE {ASSUMED_SQL}
  UNION SELECT doc_id, 'absent_limits', '' FROM low WHERE {LIMIT_SQL}
  UNION SELECT doc_id, 'misplaced_level', variable || '=' || level || ' belongs to ' || belongs_to FROM misplaced)
SELECT * FROM found""")
def txt_checks(spark, folder):
    return textcheck.check_texts(reports(spark, folder), "doc_id", "text", ALLOWED, _levels(spark, folder))


MARK_ROWS = ", ".join(f"({_sql_text(m.lower())})" for m in textcheck.STOP_MARKS)


@query(f"""WITH {REPORTS_SQL}, cut AS (
  SELECT doc_id, min(instr(lower(text), m)) AS cut_at FROM reports, (VALUES {MARK_ROWS}) v(m) WHERE contains(lower(text), m) GROUP BY 1)
SELECT r.doc_id, CASE WHEN cut_at IS NULL THEN text ELSE left(text, cut_at - 1) END AS text FROM reports r LEFT JOIN cut USING (doc_id)""")
def txt_stop_marker(spark, folder):
    return reports(spark, folder).select("doc_id", textcheck.cut_at_stop_mark(F.col("text")).alias("text"))


def _plain(expression: str) -> str:
    for old, new in textcheck.PLAIN_SPELLING.items():
        expression = f"replace({expression}, {_sql_text(old)}, {_sql_text(new)})"
    expression = f"regexp_replace({expression}, '\\s+deg\\s+C', ' deg C', 'g')"
    return f"regexp_replace({expression}, '[ \\t]{{2,}}', ' ', 'g')"


@query(f"WITH {REPORTS_SQL} SELECT doc_id, {_plain('text')} AS text FROM reports")
def txt_ascii(spark, folder):
    return reports(spark, folder).select("doc_id", textcheck.plain_spelling(F.col("text")).alias("text"))


@query(f"""WITH {REPORTS_SQL}, cut AS (
  SELECT doc_id, min(instr(lower(text), m)) AS cut_at FROM reports, (VALUES {MARK_ROWS}) v(m) WHERE contains(lower(text), m) GROUP BY 1
), kept AS (SELECT r.doc_id, CASE WHEN cut_at IS NULL THEN text ELSE left(text, cut_at - 1) END AS t FROM reports r LEFT JOIN cut USING (doc_id)),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '<\\|[^>]{{1,80}}\\|>', '', 'g'), '</?think>', '', 'gi') AS t FROM kept),
b AS (SELECT doc_id, regexp_replace(regexp_replace({_plain('t')}, '</?file(?:\\s+[^>]*)?>', '', 'gi'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM a)
SELECT doc_id, regexp_replace({_plain('t')}, '^\\s+|\\s+$', '', 'g') AS text FROM b""")
def txt_clean(spark, folder):
    return reports(spark, folder).select("doc_id", textcheck.clean_report(F.col("text")).alias("text"))


def _escaped(expression: str) -> str:
    for old, new in [("–", "-"), ("—", "-"), ("→", "->"), ("²", "2"), ("°", " deg "),
                     ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        expression = f"replace({expression}, {_sql_text(old)}, {_sql_text(new)})"
    return f"regexp_replace({expression}, '\\*\\*(.*?)\\*\\*', '<b>\\1</b>', 'g')"


@query(f"""WITH {REPORTS_SQL}, raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM reports
), lines AS (
  SELECT doc_id, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS position
  FROM raw WHERE regexp_replace(l, '^\\s+|\\s+$', '', 'g') <> ''
), blocks AS (
  SELECT doc_id, position, CASE WHEN l LIKE '##%' THEN trim(regexp_replace(l, '^#+', ''))
           WHEN l LIKE '- %' THEN '- ' || trim(l[3:]) ELSE l END AS block,
         CASE WHEN l LIKE '##%' THEN 'subheading' WHEN l LIKE '- %' OR regexp_matches(l, '^[0-9]+\\.\\s+') THEN 'bullet'
              ELSE 'body' END AS style FROM lines
)
SELECT doc_id, position, {_escaped('block')} AS block, style FROM blocks""")
def txt_blocks(spark, folder):
    return textcheck.report_blocks(reports(spark, folder), "doc_id", "text")


@query("""SELECT conv_id, turn, regexp_replace(text, '[ \\t]{2,}', ' ', 'g') AS text FROM conversations""")
def txt_plain_turns(spark, folder):
    return views.table(spark, folder, "conversations").select(
        "conv_id", "turn", textcheck.plain_spelling(F.col("text")).alias("text"))
