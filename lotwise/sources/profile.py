"""Import profile: how two exports were read, stored as JSON and replayed."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lotwise.operators import match, reshape, retype
from lotwise.sources.delimited import read_delimited


@dataclass
class TableImport:
    path: str
    key: str
    header_row: int | None = 0
    delimiter: str = ","
    duplicate_rule: str = "error"
    numeric_columns: list[str] | None = None
    long_name: str | None = None
    long_value: str | None = None
    long_aggregate: str = "mean"


@dataclass
class ImportProfile:
    process: TableImport
    qc: TableImport
    outcomes: list[str]
    version: int = 1
    notes: dict = field(default_factory=dict)


def save_profile(spark: SparkSession, profile: ImportProfile, path: str) -> None:
    text = json.dumps(asdict(profile), ensure_ascii=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_profile(spark: SparkSession, path: str) -> ImportProfile:
    raw = json.loads(spark.read.text(path, wholetext=True).first().value)
    return ImportProfile(
        TableImport(**raw["process"]), TableImport(**raw["qc"]), raw["outcomes"], raw["version"], raw["notes"]
    )


def read_table(spark: SparkSession, source: TableImport, path: str | Sequence[str] | None = None) -> DataFrame:
    """Read, retype, pivot and resolve duplicates as the profile says."""
    raw = read_delimited(spark, path or source.path, source.header_row, source.delimiter, keep_file=True)
    if source.long_name:
        wide = reshape.long_to_wide(
            raw, source.key, source.long_name, source.long_value, source.long_aggregate,
            order_by=["_file", "_line"], normalise=True,
        )
        return wide
    typed = retype.retype(raw, exclude=[source.key, "_file"], numeric_columns=source.numeric_columns).data
    return reshape.resolve_duplicates(
        typed, source.key, source.duplicate_rule, ["_file", "_line"], source.path
    ).drop("_file", "_line")


def replay(
    spark: SparkSession, profile: ImportProfile, process_path: str | None = None, qc_path: str | None = None,
) -> match.Match:
    """Import two (possibly new) sets of files with a stored profile and join them."""
    return match.match_tables(
        read_table(spark, profile.process, process_path), read_table(spark, profile.qc, qc_path),
        profile.process.key, profile.qc.key, profile.outcomes,
    )
