"""Bounded samples of labelled documents to fit small models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.frames import held_out
from lotwise.session import checkpoint

MAX_TRAIN_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y): at most ``most`` labelled documents that are not held out.

    Ids are chosen by the order of their hashes. A document labelled twice counts once, as 1 if
    any label says so. Rows without id, label or text are no examples. The chosen labels are
    broadcast: ``most`` rows of two numbers; the texts of the sample are checkpointed.
    """
    ids = labels.select(labels[key].cast("long").alias("l_key"), labels[label].cast("int").alias("y")).where(
        "l_key IS NOT NULL AND y IS NOT NULL"
    ).where(~held_out(F.col("l_key"))).groupBy("l_key").agg(F.max("y").alias("y"))
    chosen = checkpoint(ids.orderBy(F.xxhash64("l_key"), "l_key").limit(most))
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text")).where("text IS NOT NULL")
    return checkpoint(rows.join(F.broadcast(chosen), F.col("key") == F.col("l_key")).select("key", "text", "y"))
