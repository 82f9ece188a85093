"""Run every query (or those named) and print its time and oracle result."""

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

import __spark_entry__ as e
import oracle

folder = sys.argv[1]
wanted = sys.argv[2:]
scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").config("spark.local.dir", scratch)
    .config("spark.sql.session.timeZone", "UTC").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
con, queries, sql = oracle.connect(folder), e.queries(), e.oracle_sql()
for name, run in queries.items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    start = time.time()
    try:
        if name in sql:
            frame = run(spark, folder)
            message = oracle.compare(frame, con, sql[name]) or f"ok {frame.count()}"
        else:
            message = f"rows {len(run(spark, folder).collect())}"
    except Exception as error:  # noqa: BLE001
        message = f"FAILED {type(error).__name__} {str(error)[:700]}"
    print(f"@@ {name} {time.time() - start:.1f}s {message}", flush=True)
spark.stop()
