"""Repeated passages: sentences and lines hashed, grouped over the corpus, the earliest kept.

A unit is a sentence, a run of text up to a full stop or question mark, of at least ``UNIT_WORDS``
words, or a whole line of any length. It is normalised (lower case, one space between words) and
hashed to 128 bits; sentences are compared with sentences and lines with lines. Of equal units
the one of the smallest (rank, key, place) is kept. Adjacent repeated sentences form a passage,
with the short ones between them, and so do adjacent repeated lines; every passage is removed,
unless a higher ``least_words`` is asked for. Offsets are code points of the original text.

Texts are read twice. The first pass counts half digests alone, 8 bytes a unit; of the second one
only the units whose half digest was counted more than once are kept, grouped and placed.

Rows: a null text has no units; ties go by key (nulls last) and place; rows equal in key and
text count as one document, so each keeps what the document keeps; an empty table gives an empty
result; very long texts are read in whole, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lotwise.llm.arrays import slices
from lotwise.llm.frames import small_or_not
from lotwise.session import checkpoint

UNIT_WORDS = 4
LEAST_WORDS = UNIT_WORDS  # every repeated unit; ask for more to keep phrases or licence lines
UNIT = r"[^\n.?]+[.?]*|[.?]+"
LINE = r"[^\n]+"
SENTENCES, LINES = 0, 1
RULES = {SENTENCES: (UNIT, UNIT_WORDS), LINES: (LINE, 1)}  # what a unit is, and its least words
BROADCAST_ROWS = 1 << 19  # of two longs


def units_of(text: str, kinds: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(kind, place, start, stop, n_words, digest) of the units long enough; places count within a kind."""
    for kind in kinds:
        pattern, least = RULES[kind]
        place = 0
        for m in re.finditer(pattern, text):
            words = m.group().lower().split()
            if len(words) >= least:
                yield kind, place, m.start(), m.end(), len(words), xxhash.xxh3_128_intdigest(" ".join(words), seed=kind)
                place += 1


def halves(digest: int) -> tuple[int, int]:
    return (digest >> 64) - (1 << 63), (digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, copy, text); ``copy`` is a hash of the text, so that different rows of one key stay apart."""
    body = docs[text].cast("string")
    return docs.select(docs[key].cast("long").alias("key"), F.xxhash64(body).alias("copy"), body.alias("text"))


def repeated_halves(docs: DataFrame, kinds: list[int], key: str, text: str) -> DataFrame:
    """(d0): first halves of the digests that stand more than once in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [halves(u[5])[0] for t in part.column(0).to_pylist() for u in units_of(t or "", kinds)]
            d0, n = np.unique(np.array(found, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(d0), pa.array(n.astype(np.int64))], ["d0", "n"])

    counted = texts_of(docs, key, text).select("text").mapInArrow(run, "d0 long, n long").groupBy("d0").agg(F.sum("n").alias("n"))
    return checkpoint(counted.where("n > 1").select("d0"))


def units(docs: DataFrame, kinds: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, copy, kind, place, start, stop, n_words, d0, d1): the units of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [
                (k, own, *u[:5], *halves(u[5]))
                for k, own, t in zip(*(c.to_pylist() for c in part.columns)) for u in units_of(t or "", kinds)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    names = ["key", "copy", "kind", "place", "start", "stop", "n_words", "d0", "d1"]
    return texts_of(docs, key, text).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def passages(
    docs: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text", kinds: list[int] | None = None,
) -> DataFrame:
    """(key, copy, kind, start, stop, n_words, n_units, kept_key, kept_start): the passages to remove.

    ``kept_key`` and ``kept_start`` tell where the first unit of the passage stays. Keys order
    the documents; pass a rank as ``key`` for another order. ``kinds`` tells which units are
    compared, sentences alone if it is not given; lines have no ``least_words`` unless it is raised.
    """
    kinds = [SENTENCES] if kinds is None else kinds
    again = repeated_halves(docs, kinds, key, text).withColumnRenamed("d0", "half")
    # few units stand more than once; these alone are kept with their places
    found = units(docs, kinds, key, text).join(again, F.col("d0") == F.col("half"), "left_semi")
    found = checkpoint(found)
    at = F.struct(F.col("key").isNull().alias("none"), "key", "copy", "place")
    first = found.groupBy("d0", "d1").agg(
        F.min(F.struct(at.alias("at"), F.col("start").alias("start"))).alias("first"), F.count("*").alias("n")
    ).where("n > 1").select(F.col("d0").alias("e0"), F.col("d1").alias("e1"), "first")
    met = found.join(first, (F.col("d0") == F.col("e0")) & (F.col("d1") == F.col("e1"))).where(at != F.col("first.at"))
    order = Window.partitionBy("key", "copy", "kind").orderBy("place")
    # repeated rows are equal in key and copy: one of each place is enough
    own = met.dropDuplicates(["key", "copy", "kind", "place"]).withColumn("run", F.col("place") - F.row_number().over(order))
    runs = own.groupBy("key", "copy", "kind", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").alias("n_words"),
        F.count("*").alias("n_units"), F.min(F.struct("place", "first")).alias("lead"),
    )
    least = F.when(F.col("kind") == LINES, least_words if least_words > LEAST_WORDS else 1).otherwise(least_words)
    return runs.where(F.col("n_words") >= least).select(
        "key", "copy", "kind", "start", "stop", "n_words", "n_units",
        F.col("lead.first.at.key").alias("kept_key"), F.col("lead.first.start").alias("kept_start"),
    )


def removed(docs: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with passages and later copies of whole lines cut out of ``text``; all rows and columns stay.

    With a ``least_words`` of more than ``LEAST_WORDS``, shorter lines stay as well.
    """
    names = docs.columns
    spans = passages(docs, least_words, key, text, [SENTENCES, LINES]).select("key", "copy", "start", "stop").distinct()
    cuts = spans.groupBy("key", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    cuts = checkpoint(cuts)
    def cut(t: str | None, spans: list[dict] | None) -> str | None:
        if not spans:
            return t
        kept, at = [], 0
        for s in spans:
            kept.append(t[at:s["start"]])  # nothing where spans overlap
            at = max(at, s["stop"])
        return "".join([*kept, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [cut(t, s) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["row", "text"])

    body = docs[text].cast("string")
    packed = docs.select(
        F.struct(*(docs[c] for c in names)).alias("row"), docs[key].cast("long").alias("row_key"),
        F.xxhash64(body).alias("row_copy"), body.alias("text"),
    )
    same = F.col("row_key").eqNullSafe(F.col("key")) & (F.col("row_copy") == F.col("copy"))
    kinds = StructType([StructField("row", packed.schema["row"].dataType), StructField("text", StringType())])
    columns = [F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    # only rows that have cuts are shuffled, if these are few enough to be told by a broadcast
    touched = small_or_not(cuts.select("key", "copy"), BROADCAST_ROWS)
    whole = packed.join(touched, same, "left_anti")
    met = packed.join(touched, same, "left_semi").join(cuts, same)
    done = met.select("row", "text", "cuts").mapInArrow(run, kinds)
    return whole.select(columns).unionByName(done.select(columns))
