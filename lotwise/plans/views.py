"""Process, QC, long and limits tables derived from the star-schema tables.

Every view has a Spark form and the same view in SQL for the oracle. Sums are
formed in decimals on both sides, so measured values agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lotwise.operators import match
from lotwise.operators.limits import LIMIT_SCHEMA

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- process: one row per order, with a messy key --------------------------

PROCESS_COLUMNS = [
    "order_status", "order_priority", "supplier_segment", "site_nation", "account_balance",
    "balance_reading", "order_date", "site_flag", "priority_rank",
]


def process(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    key = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" ord-"), F.col("o_orderkey").cast("string")))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.otherwise(F.concat(F.lit("ORD "), F.col("o_orderkey").cast("string"))).alias("Batch ID"),
            F.col("o_orderstatus").alias("order_status"), F.col("o_orderpriority").alias("order_priority"),
            F.col("c_mktsegment").alias("supplier_segment"), F.col("n_name").alias("site_nation"),
            F.col("c_acctbal").alias("account_balance"),
            F.when(F.col("o_orderkey") % 4 != 0, F.col("c_acctbal")).alias("balance_reading"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
            F.lit("A").alias("site_flag"),
            F.substring("o_orderpriority", 1, 1).cast("double").alias("priority_rank"),
        )
    )


PROCESS_SQL = """
process AS (
  SELECT CASE WHEN o_orderkey % 5 = 0 THEN ' ord-' || o_orderkey ELSE 'ORD ' || o_orderkey END AS "Batch ID",
         'ORD' || o_orderkey AS batch_key,
         o_orderstatus AS order_status, o_orderpriority AS order_priority,
         c_mktsegment AS supplier_segment, n_name AS site_nation, c_acctbal AS account_balance,
         CASE WHEN o_orderkey % 4 <> 0 THEN c_acctbal END AS balance_reading,
         strftime(o_orderdate, '%Y-%m-%d') AS order_date, 'A' AS site_flag,
         CAST(o_orderpriority[1] AS DOUBLE) AS priority_rank
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

# --- QC: one row per order with lines --------------------------------------

OUTCOMES = ["yield_amount", "discount_residual", "returned_percent"]


def qc(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    returned = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum(price * (1 - discount)).cast("double").alias("yield_amount"),
        (F.sum(discount).cast("double") / F.count("*")).alias("discount_residual"),
        (100.0 * returned / F.count("*")).alias("returned_percent"),
    ).select(F.concat(F.lit("ORD_"), F.col("l_orderkey").cast("string")).alias("Batch Identifier"), *OUTCOMES)


QC_SQL = """
qc AS (
  SELECT 'ORD_' || l_orderkey AS "Batch Identifier", 'ORD' || l_orderkey AS batch_key,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS yield_amount,
         CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) AS discount_residual,
         CAST(100.0 AS DOUBLE) * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*) AS returned_percent
  FROM lineitem GROUP BY l_orderkey
)"""


def merged(spark: SparkSession, folder: str) -> DataFrame:
    return match.join_tables(
        process(spark, folder), qc(spark, folder), "Batch ID", "Batch Identifier", OUTCOMES
    )


MERGED_SQL = f"""{PROCESS_SQL}, {QC_SQL},
merged AS (
  SELECT process.* EXCLUDE (batch_key), qc.* EXCLUDE ("Batch Identifier", batch_key)
  FROM process JOIN qc USING (batch_key)
)"""

# --- measures: numeric process variables per order -------------------------

MEASURES = ["line_count", "sum_quantity", "avg_quantity", "avg_tax", "gross_amount"]


def measures(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    quantity, tax = F.col("l_quantity").cast("decimal(8,2)"), F.col("l_tax").cast("decimal(4,2)")
    n = F.count("*")
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(
        n.cast("double").alias("line_count"), F.sum(quantity).cast("double").alias("sum_quantity"),
        (F.sum(quantity).cast("double") / n).alias("avg_quantity"),
        (F.sum(tax).cast("double") / n).alias("avg_tax"), F.sum(price).cast("double").alias("gross_amount"),
        F.sum(price * (1 - discount)).cast("double").alias("yield_amount"),
        (F.sum(discount).cast("double") / n).alias("discount_residual"),
    )


MEASURES_SQL = """
measures AS (
  SELECT l_orderkey AS batch_id, CAST(count(*) AS DOUBLE) AS line_count,
         CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DOUBLE) AS sum_quantity,
         CAST(sum(CAST(l_quantity AS DECIMAL(8,2))) AS DOUBLE) / count(*) AS avg_quantity,
         CAST(sum(CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) / count(*) AS avg_tax,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS gross_amount,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS yield_amount,
         CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) AS discount_residual
  FROM lineitem GROUP BY l_orderkey
)"""

# --- long: messy test results per user -------------------------------------


def long_results(spark: SparkSession, folder: str) -> DataFrame:
    """(Batch Identifier, Test Name, Result) with commas, marks and units."""
    plain = F.format_string("%.2f", F.col("value"))
    comma = F.when(F.col("event_id") % 3 == 0, F.replace(plain, F.lit("."), F.lit(","))).otherwise(plain)
    mark = F.when(F.col("event_id") % 13 == 0, "<").otherwise("")
    unit = F.when(F.col("event_id") % 2 == 0, " %").otherwise("")
    user = F.col("user_id").cast("string")
    batch = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("u_"), user)).otherwise(F.concat(F.lit("U-"), user))
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", batch.alias("Batch Identifier"), F.col("event_type").alias("Test Name"),
        F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.concat(mark, comma, unit)).alias("Result"),
        "value",
    )


LONG_SQL = """
raw AS (
  SELECT *, CASE WHEN event_id % 3 = 0 THEN replace(printf('%.2f', value), '.', ',')
                 ELSE printf('%.2f', value) END AS txt
  FROM events
), long AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 4 = 0 THEN 'u_' || user_id ELSE 'U-' || user_id END AS "Batch Identifier",
         event_type AS "Test Name",
         CASE WHEN event_id % 17 = 0 THEN 'n/a'
              ELSE (CASE WHEN event_id % 13 = 0 THEN '<' ELSE '' END) || txt
                   || (CASE WHEN event_id % 2 = 0 THEN ' %' ELSE '' END) END AS "Result",
         value
  FROM raw
), parsed AS (
  SELECT *, 'U' || user_id AS batch_key,
         CASE WHEN "Result" <> 'n/a'
              THEN CAST(replace(regexp_extract("Result", '[0-9]+[.,][0-9]+'), ',', '.') AS DOUBLE) END AS number,
         CASE WHEN "Result" LIKE '<%' THEN '<' END AS qualifier
  FROM long
)"""

# --- limits -----------------------------------------------------------------

LINE_LIMITS = [
    ("l_quantity", "process", 25.0, 3.0, 48.0, "pcs", "high", ""),
    ("l_discount", "cpp", 0.05, None, 0.09, "", "low", "one-sided"),
    ("l_tax", "", 0.04, 0.01, None, "", "low", "one-sided"),
    ("l_extendedprice", "quality", None, 1000.0, 100000.0, "USD", "high", ""),
    ("l_linenumber", "process", 3.0, None, None, "", "", "target only"),
    ("l_weight", "process", 1.0, 0.5, 2.0, "kg", "", "not measured"),
]
LINE_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
LINE_OUTCOMES = ["l_extendedprice"]


def line_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LINE_LIMITS, LIMIT_SCHEMA)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    batch = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return table(spark, folder, "lineitem").select(
        batch.alias("batch_id"), F.col("l_linenumber").cast("double").alias("l_linenumber"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
    )


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    return f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"


LIMITS_SQL = """
limits(variable, role_text, target, lower_limit, upper_limit, unit, criticality, notes) AS (VALUES
  %s
), lines AS (
  SELECT l_orderkey || '-' || l_linenumber AS batch_id, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
         l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem
), long_lines AS (
  SELECT batch_id, l_extendedprice AS y, variable, value
  FROM (SELECT *, l_extendedprice AS l_extendedprice_y FROM lines)
  UNPIVOT (value FOR variable IN (l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice_y))
)""" % ",\n  ".join("(" + ", ".join(map(_sql_value, row)) + ")" for row in LINE_LIMITS)

ZONES_SQL = LIMITS_SQL.replace("SELECT batch_id, l_extendedprice AS y, variable, value", """
  SELECT batch_id, l_extendedprice AS y, replace(variable, '_y', '') AS variable, value""") + """,
roles AS (
  SELECT *, CASE WHEN variable = 'l_extendedprice' THEN 'qc' ELSE 'process' END AS role FROM limits
), ranges AS (
  SELECT variable, max(value) - min(value) AS span FROM long_lines GROUP BY variable
), zoned AS (
  SELECT batch_id, y, l.variable, value, role, target, lower_limit, upper_limit, unit, notes, criticality,
         CASE WHEN value > upper_limit THEN 'above_spec' WHEN value < lower_limit THEN 'below_spec'
              WHEN value >= upper_limit - coalesce(0.1e0 * (upper_limit - lower_limit), 0.1e0 * span) THEN 'near_upper_edge'
              WHEN value <= lower_limit + coalesce(0.1e0 * (upper_limit - lower_limit), 0.1e0 * span) THEN 'near_lower_edge'
              ELSE 'inside' END AS zone
  FROM long_lines l JOIN roles USING (variable) JOIN ranges USING (variable)
)"""
