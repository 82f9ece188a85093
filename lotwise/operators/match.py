"""Link process rows to QC rows on the normalised key; readiness before that."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.errors import InputError
from lotwise.functions import names
from lotwise.functions.formats import number_text
from lotwise.operators.reshape import duplicate_keys, key_counts, normalised_key, number_column

MESSAGE_SCHEMA = "severity string, code string, message string"


@dataclass(frozen=True)
class Match:
    """Joined table with its key accounting; all frames are lazy."""

    data: DataFrame
    counts: DataFrame
    unmatched: DataFrame


def missing_key_count(df: DataFrame, key: str) -> DataFrame:
    text = normalised_key(df, key)
    return df.agg(F.count_if(text.isNull() | (text == "")).alias("missing_keys"))


def check_keys(df: DataFrame, key: str, label: str) -> None:
    """Reject empty tables, missing and repeated keys; one pass when all is well."""
    blank = F.col("batch_key").isNull() | (F.col("batch_key") == "")
    facts = key_counts(df, key).agg(
        F.count("*").alias("keys"), F.sum(F.when(blank, F.col("row_count"))).alias("missing"),
        F.count_if(F.col("row_count") > 1).alias("repeated"),
    ).first()
    if not facts.keys:
        raise InputError(f"{label} is empty")
    if facts.missing:
        raise InputError(f"{label}: {facts.missing} row(s) have no batch key")
    if facts.repeated:
        repeated = duplicate_keys(df, key).select("batch_key").orderBy("batch_key").limit(6).collect()
        shown = ", ".join(r.batch_key for r in repeated[:5])
        more = f" and {facts.repeated - 5} more" if facts.repeated > 5 else ""
        raise InputError(f"{label}: repeated batch keys {shown}{more}")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    counted = df.groupBy(normalised_key(df, key).alias("batch_key")).agg(F.count("*").alias("n"))
    # tied to the count, so the key is not computed a second time below the grouping
    return counted.filter(F.when(F.col("batch_key") != "", F.col("n")) > 0).select("batch_key")


def unmatched_keys(process: DataFrame, qc: DataFrame, process_key: str, qc_key: str) -> DataFrame:
    """Keys found on one side only: ``side, batch_key``; sort on write if needed."""
    p, q = distinct_keys(process, process_key), distinct_keys(qc, qc_key)
    both = p.withColumn("p", F.lit(1)).join(q.withColumn("q", F.lit(1)), "batch_key", "full")
    return both.filter(F.col("p").isNull() | F.col("q").isNull()).select(
        F.when(F.col("q").isNull(), "process").otherwise("qc").alias("side"), "batch_key"
    )


def match_counts(process: DataFrame, qc: DataFrame, process_key: str, qc_key: str) -> DataFrame:
    """One row: distinct keys per side, matches, and the matched fractions."""
    p, q = distinct_keys(process, process_key), distinct_keys(qc, qc_key)
    both = p.withColumn("p", F.lit(1)).join(q.withColumn("q", F.lit(1)), "batch_key", "full")
    matched = F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull())
    return both.agg(
        F.count("p").alias("process_batches"), F.count("q").alias("qc_batches"),
        matched.alias("matched_batches"),
    ).withColumns({
        "process_match_fraction": F.coalesce(F.try_divide("matched_batches", "process_batches"), F.lit(0.0)),
        "qc_match_fraction": F.coalesce(F.try_divide("matched_batches", "qc_batches"), F.lit(0.0)),
    })


def join_tables(
    process: DataFrame, qc: DataFrame, process_key: str, qc_key: str, outcomes: Sequence[str],
) -> DataFrame:
    """Inner join on the normalised key; the shown key keeps its process form.

    Keys are unique on both sides by then, so the join cannot fan out and no
    key is hot. The physical join is left to the optimizer.
    """
    def present(df: DataFrame, key: str, side: str) -> Column:
        """Key that is never NULL; a missing one gets a text the other side cannot have.

        A nullable join key would make the optimizer add a filter that computes
        the key again for every row of the source.
        """
        return F.coalesce(F.nullif(normalised_key(df, key), F.lit("")), F.lit(f"\0{side}"))

    left = process.withColumn("__key", present(process, process_key, "process"))
    right = qc.select(present(qc, qc_key, "qc").alias("__key"), *outcomes)
    joined = left.join(right, "__key", "inner").drop("__key")
    if process_key != "batch_id" and "batch_id" not in joined.columns:
        joined = joined.withColumnRenamed(process_key, "batch_id")
    return joined


def match_tables(
    process: DataFrame, qc: DataFrame, process_key: str, qc_key: str, outcomes: Sequence[str],
    check: bool = True,
) -> Match:
    """Validate both sides, then join them. ``check`` starts two small jobs a side."""
    process = process.toDF(*[c.strip() for c in process.columns])
    qc = qc.toDF(*[c.strip() for c in qc.columns])
    names.require_columns(process.columns, [process_key], "process table")
    names.require_columns(qc.columns, [qc_key, *outcomes], "QC table")
    if not outcomes:
        raise InputError("select at least one outcome column")
    names.forbid_name_collisions(process.columns, outcomes, process_key)
    if check:
        for df, key, label in ((process, process_key, "process table"), (qc, qc_key, "QC table")):
            check_keys(df, key, label)
    data = join_tables(process, qc, process_key, qc_key, outcomes)
    if check and data.isEmpty():
        raise InputError("no batch key is found on both sides")
    return Match(
        data,
        match_counts(process, qc, process_key, qc_key),
        unmatched_keys(process, qc, process_key, qc_key),
    )


# --------------------------------------------------------------------------
# Readiness
# --------------------------------------------------------------------------

def _note(severity: str, code: str, when: Column, *message: Column | str) -> Column:
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    row = F.struct(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("message")
    )
    return F.when(when, row)


def readiness_messages(
    process: DataFrame, qc: DataFrame, process_key: str, qc_key: str, outcomes: Sequence[str],
    process_rule: str = "error", qc_rule: str = "error",
    process_report: DataFrame | None = None, qc_report: DataFrame | None = None,
) -> DataFrame:
    """Blockers, warnings and notes as rows ``severity, code, message``."""
    spark = process.sparkSession
    early = []
    if process_key not in process.columns:
        early.append(("blocker", "process_key_column", f"The process table has no key column {process_key}."))
    if qc_key not in qc.columns:
        early.append(("blocker", "qc_key_column", f"The QC table has no key column {qc_key}."))
    absent = [o for o in outcomes if o not in qc.columns]
    if absent:
        early.append(("blocker", "outcome_columns", f"Outcome columns are missing: {', '.join(absent)}."))
    if early:
        return spark.createDataFrame(early, MESSAGE_SCHEMA)

    def side(df: DataFrame, key: str, label: str, rule: str, report: DataFrame | None) -> DataFrame:
        per_key = df.groupBy(normalised_key(df, key).alias("k")).agg(F.count("*").alias("n"))
        blank = F.col("k").isNull() | (F.col("k") == "")
        facts = per_key.agg(
            F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("missing"),
            F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("repeated"),
        )
        missing, repeated = F.col("missing"), F.col("repeated")
        severity = "blocker" if rule == "error" else "warning"
        advice = "Choose a duplicate rule." if rule == "error" else "They are resolved before the join."
        notes = [
            _note("blocker", f"{label}_missing_keys", missing > 0,
                  f"The {label} key column has ", missing.cast("string"), " missing value(s)."),
            _note(severity, f"{label}_duplicates", repeated > 0,
                  f"The {label} table repeats ", repeated.cast("string"), f" batch key(s). {advice}"),
        ]
        rows = _note_rows(facts, notes)
        if report is not None:
            first = F.array_join(F.slice(F.array_sort(F.collect_list("column")), 1, 4), ", ")
            parsed = report.agg(
                F.count("*").alias("columns"), F.coalesce(F.sum("qualifier_count"), F.lit(0)).alias("marks"),
                first.alias("first"),
            )
            rows = rows.unionByName(_note_rows(parsed, [
                _note("info", f"{label}_converted", F.col("columns") > 0, f"The {label} table has ",
                      F.col("columns").cast("string"), " converted text column(s), such as ", F.col("first"), "."),
                _note("warning", f"{label}_qualifiers", F.col("marks") > 0, f"The {label} table has ",
                      F.col("marks").cast("string"), " value(s) with a mark such as < or >; read them with care."),
            ]))
        return rows

    matched = F.col("matched_batches")
    low = F.least("process_match_fraction", "qc_match_fraction") < 0.70
    overlap = _note_rows(match_counts(process, qc, process_key, qc_key), [
        _note("blocker", "no_overlap", matched == 0, "No batch key is found on both sides."),
        _note("warning", "low_overlap", (matched > 0) & low,
              "Only ", matched.cast("string"), " batch key(s) are found on both sides."),
        _note("info", "overlap", (matched > 0) & ~low,
              matched.cast("string"), " batch key(s) are found on both sides."),
    ])

    values = {o: number_column(qc, o) for o in outcomes}
    numeric = qc.agg(
        F.count("*").alias("rows"), *[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())]
    )
    notes = []
    for i, o in enumerate(values):
        lost = 1 - F.coalesce(F.try_divide(F.col(f"n{i}"), F.col("rows")), F.lit(0.0))
        notes += [
            _note("blocker", "outcome_not_numeric", F.col(f"n{i}") == 0, f"{o} holds no number."),
            _note("warning", "outcome_missing", (F.col(f"n{i}") > 0) & (lost > 0.20),
                  f"{o} is missing or not numeric in ", number_text(100 * lost, "%.0f"), " % of rows."),
        ]
    result = (
        side(process, process_key, "process", process_rule, process_report)
        .unionByName(side(qc, qc_key, "qc", qc_rule, qc_report))
        .unionByName(overlap).unionByName(_note_rows(numeric, notes))
    )
    unnamed = [c for c in [*process.columns, *qc.columns] if c.lower().startswith("unnamed_column")]
    if unnamed:
        result = result.unionByName(spark.createDataFrame(
            [("warning", "unnamed_columns", f"Columns without a name were renamed: {', '.join(unnamed[:6])}.")],
            MESSAGE_SCHEMA,
        ))
    return result


def _note_rows(facts: DataFrame, notes: Sequence[Column]) -> DataFrame:
    return facts.select(F.inline(F.array_compact(F.array(*notes))))


def readiness_score(messages: DataFrame) -> DataFrame:
    """Score from 0 to 100 with the counts behind it."""
    counts = messages.agg(*[
        F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("blocker", "warning", "info")
    ])
    lost = 35 * F.col("blocker_count") + 8 * F.col("warning_count") + F.least(F.lit(5), F.col("info_count"))
    return counts.select(
        F.greatest(F.lit(0), F.lit(100) - lost).cast("bigint").alias("score"),
        "blocker_count", "warning_count", "info_count",
    )
