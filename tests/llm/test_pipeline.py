"""The pipeline's stages on planted cases, against brute force where SQL has no words for them."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotwise.llm import substrings
from lotwise.llm.queries import vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `key` string, component long, `row` string"


def prose(n, seed):
    draw = random.Random(seed)
    out = ["".join(draw.choice(["ba", "ke", "lo", "mi", "tu", "ran", "vel"]) for _ in range(3)) for _ in range(n)]
    for k in range(9, n, 11):
        out[k] += "."
    return " ".join(out)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    item, passage = prose(30, 1), prose(70, 2) + "."
    docs = {k: prose(150, 100 + k) + "." for k in range(80)}
    docs[200] = docs[3]                                              # exact copy
    near = docs[4].split()
    near[70] = "changed"
    docs[201] = " ".join(near)                                       # near copy
    for k in (205, 206, 207):
        docs[k] = f"{prose(120, 300 + k)}. {passage} {prose(44, 400 + k)}."  # shared passage
    docs[210] = f"{prose(100, 500)}. {item} {prose(60, 501)}."       # benchmark passage
    edited = item.split()
    edited[10] = "other"
    docs[211] = f"{prose(100, 502)}. {' '.join(edited)} {prose(60, 503)}."
    docs[220] = " ".join(w + "###" for w in prose(100, 504).split())  # junk
    docs[221] = "same words here again now " * 40
    docs[222], docs[223] = "", None
    rows = [(k, t, "en", f"s{k % 2}", len(t or ""), "k", 7, "r") for k, t in docs.items()]
    rows += [rows[5], (None, prose(90, 505), None, None, 1, "k", 7, "r")]  # a repeated row, a row without id
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, passage


def test_stages(spark, planted):
    folder, docs, passage = planted
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near duplicates", "repeated passages", "decontamination", "best-fit packing"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    names = now.columns

    def after(name):
        nonlocal now
        now = stages[name](spark, now, folder)
        if name != "best-fit packing":
            assert now.columns == names
            now = spark.createDataFrame(now.collect(), now.schema)
            return {r["doc_id"]: r["text"] for r in now.collect()}

    kept = after("quality rules")
    assert set(kept) == (set(docs) - {220, 221, 222, 223}) | {None}
    one = after("near duplicates")
    ids = sorted(k for k in kept if k is not None)
    sets = {k: shingles(kept[k]) for k in ids}
    copies = {b for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert copies == {200, 201} and set(one) == set(kept) - copies and now.count() == len(one)
    cut = after("repeated passages")
    assert set(cut) == set(one) and passage in cut[205] and passage not in cut[206] and passage not in cut[207]
    seen = set()
    for k in sorted(x for x in one if x is not None):
        units = [" ".join(m.group().lower().split()) for m in re.finditer(substrings.UNIT, one[k])]
        own = [u for u in units if len(u.split()) >= substrings.UNIT_WORDS]
        assert (cut[k] == one[k]) == (sum(len(u.split()) for u in own if u in seen) < substrings.LEAST_WORDS)
        seen |= set(own)
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
    clean = after("decontamination")
    assert set(cut) - set(clean) == {210, 211}
    after("best-fit packing")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    lengths = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in clean.items()}
    pieces = now.collect()
    assert {r["doc_id"]: r["length"] for r in pieces} == lengths
    places = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
    rooms = []  # best-fit decreasing, a document at a time
    for n in sorted(lengths.values(), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 2048) - n)
    assert len(places) == len(rooms)


def test_run_and_empty_tables(spark, planted, tmp_path):
    folder, docs, _ = planted
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == len(docs) - 8 + 1
    empty = str(tmp_path / "none")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_take_documents_with_any_further_columns(spark, planted):
    """Columns named like those the stages make on the way; the same rows stay."""
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clashing = docs
    for name in ["stretch", "read_text", "read_id", "held_id", "key", "copy", "row", "cuts", "d0", "kind", "component", "gone", "word", "lim"]:
        clashing = clashing.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        own = stage(spark, clashing, folder)
        assert own.columns == clashing.columns, name
        ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
        assert ids(own) == ids(stage(spark, docs, folder)), name
