"""Schemas of the tables users hand in, with one example row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lotwise.operators.limits import LIMIT_SCHEMA


def _schema(texts: list[str], numbers: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in texts] + [StructField(c, DoubleType()) for c in numbers])


CONTRACTS = {
    "process": _schema(["batch_id", "reactor_id", "operator_shift"], ["temperature_C", "duration_hours"]),
    "qc_wide": _schema(["batch_id"], ["yield_percent", "purity_percent"]),
    "qc_long": _schema(["batch_id", "test_name", "result"], []),
    "limits": LIMIT_SCHEMA,
}

EXAMPLES = {
    "process": ("B001", "R-1", "Day", 36.9, 166.0),
    "qc_wide": ("B001", 81.2, 97.5),
    "qc_long": ("B001", "yield_percent", "81,2 %"),
    "limits": ("temperature_C", "process", 37.0, 36.0, 38.0, "C", "high", ""),
}


def template(spark: SparkSession, contract: str) -> DataFrame:
    return spark.createDataFrame([EXAMPLES[contract]], CONTRACTS[contract])
