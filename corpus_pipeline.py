"""Corpus cleaning in five stages, from raw documents to packed training sequences.

Each stage takes all that the one before kept and returns the documents' columns, the last one
the packed pieces. ``run`` writes the result of every stage as Parquet to the shared folder.

Rows: stages follow the rules of their operators. Null texts are documents without words, which
the quality rules reject; null ids go through all stages, but a near duplicate without an id is
not recognised as one; repeated rows are one document; an empty table gives an empty result;
further columns pass through unchanged up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import decontaminate, packing, rules, simhash, substrings
from lotwise.llm.frames import small_or_not, stored, table
from lotwise.llm.queries import vocabulary
from lotwise.session import checkpoint

# Five-word shingles, 128 bits: documents of similarity 0.8 differ in 19.4 bits on average,
# unrelated ones in 64.
NEAR = {"shingle": 5, "width": 2, "radius": 24, "recall": 0.95, "similarity": 0.8}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return simhash.one_of_each(docs, **NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; ``n_chars`` follows."""
    cut = substrings.removed(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor the rest of one that a cut passage was a part of.

    So the texts as read are searched too. A document goes if one of its id holds an item, it has
    been cut from that one (shorter, and no word besides) and three words in a row of the item stay.
    """
    items = table(spark, sf_dir, "benchmark")
    read = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("read_id"), F.col("text").cast("string").alias("read_text"))
    spans = checkpoint(
        decontaminate.matches(read, items, "read_id", "read_text").where("key IS NOT NULL")
        .select(F.col("key").alias("held_id"), F.col("start").alias("held_start"), F.col("stop").alias("held_stop")).distinct()
    )
    ids = small_or_not(spans.select(F.col("held_id").alias("id")).distinct())
    words = lambda c: F.array_remove(F.split(F.lower(c), r"[\s.?]+"), "")
    stretch = words(F.substring("read_text", F.col("held_start") + 1, F.col("held_stop") - F.col("held_start")))
    held = read.join(spans, F.col("read_id") == F.col("held_id")).select(
        "read_id", "read_text", stretch.alias("stretch")
    ).distinct()
    own, text = docs["doc_id"].cast("long"), docs["text"]  # further columns of docs may have any names
    now = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(held["stretch"]) - 2, F.lit(1))), lambda i: F.array_join(F.slice(held["stretch"], i, 3), " ")
    )
    rest = (
        (own == held["read_id"]) & (F.length(text) < F.length(held["read_text"]))
        & (F.size(F.array_except(words(text), words(held["read_text"]))) == 0)
        & F.exists(grams, lambda g: F.contains(now, F.concat(F.lit(" "), g, F.lit(" "))))
    )
    doubtful = docs.join(ids, own == ids["id"], "left_semi").join(held, rest, "left_anti")
    return decontaminate.clean(docs.join(ids, own == ids["id"], "left_anti").unionByName(doubtful), items)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json")).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("best-fit packing", packing_plan),
]
ORACLE_SQL = None  # fingerprints, edit distances and tokens are beyond SQL; the tests hold a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
