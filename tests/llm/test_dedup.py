"""SimHash, repeated passages and benchmark passages against brute force and on odd rows."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lotwise.llm import decontaminate, simhash, substrings
from lotwise.llm.arrays import utf8

SCHEMA = "doc_id long, text string, lang string, source string, start string, component long, key string, gone long"


def words(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["ba", "ke", "lo", "mi", "tu", "ran"]) for _ in range(3)) for _ in range(n))


def frame(spark, texts):
    rows = [(i, t, "en", "s", "x", 5, "k", 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def fingerprint(text, shingle=4):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    base = words(60, 1)
    texts = [(0, base), (1, base.replace("ba", "BA")), (2, base + " end"), (3, None), (4, ""), (5, " \t\n"), (6, "one two"),
             (7, base + " end stop"), (8, words(50, 2)), (9, words(3000, 3)), (10, words(3000, 3) + " x")]
    texts += [(20 + k, words(40, 4) + f" tail{k}") for k in range(30)] + [(0, base)]
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    prints = {i: fingerprint(t) for i, t in texts}
    for r in got:
        assert r["f0"] % (1 << 64) == prints[r["key"]]
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4 and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r["key"]: r["component"] for r in got} == {i: root(i) for i in prints}


def test_crowded_cells_are_cut_into_blocks(spark):
    draw = np.random.default_rng(1)
    values = {int(draw.integers(1 << 62)) for _ in range(150)}
    values |= {v ^ (1 << int(draw.integers(60))) for v in list(values)[:80]}
    rows = spark.createDataFrame([(v, v) for v in values], "fid long, f0 long")
    masks = simhash.grid(len(values), 4, 1)
    whole = {tuple(sorted(r)) for r in simhash.links(rows, 4, 1, masks).collect()}
    cut = {tuple(sorted(r)) for r in simhash.links(rows, 4, 1, masks, cell=2).collect()}
    near = {p for p in itertools.combinations(sorted(values), 2) if (p[0] ^ p[1]).bit_count() <= 4}
    assert whole == near and cut == near


def test_manhattan_distance_is_a_lower_bound():
    draw = np.random.default_rng(2)
    x, y = draw.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    counts = lambda v: np.stack([np.bitwise_count(v >> np.uint64(2 * k) & np.uint64(3)) for k in range(32)])
    manhattan = np.abs(counts(x).astype(int) - counts(y).astype(int)).sum(axis=0)
    assert (np.bitwise_count(simhash.thermometer(x) ^ simhash.thermometer(y)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(x ^ y)).all()


def test_forest_joins_what_pairs_join():
    draw = np.random.default_rng(3)
    rows = draw.integers(0, 1 << 8, (300, 1), dtype=np.uint64) * np.uint64(0x101)
    links = simhash.forest(rows, 2)
    joined = list(range(300))

    def root(i):
        while joined[i] != i:
            i = joined[i]
        return i

    for a, b in links:
        assert np.bitwise_count(rows[a] ^ rows[b]).sum() <= 2 and root(a) != root(b)
        joined[root(a)] = root(b)
    for a, b in itertools.combinations(range(300), 2):
        if np.bitwise_count(rows[a] ^ rows[b]).sum() <= 2:
            assert root(a) == root(b)


def test_one_of_each_keeps_columns_and_odd_rows(spark):
    base = words(200, 5)
    near = base.split()
    near[100] = "changed"
    docs = frame(spark, [(1, base), (2, " ".join(near)), (3, words(200, 6)), (3, words(200, 6)), (None, base), (4, None), (5, "")])
    kept = simhash.one_of_each(docs, shingle=5, width=2, radius=24, recall=0.95)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_rows_of_one_key_are_judged_by_their_own_text(spark):
    one, two = words(200, 801), words(200, 802).split()
    first = " ".join(two)
    two[90] = "changed"
    texts = [(1, one), (3, one), (3, words(200, 803)), (3, words(200, 804)), (3, None), (8, first), (8, " ".join(two)), (9, words(200, 803))]
    kept = simhash.one_of_each(frame(spark, texts), shingle=5, width=2, radius=24, recall=0.95).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 3, 3, 8]
    assert {r["text"] for r in kept if r["doc_id"] == 3} == {words(200, 803), words(200, 804), None}


def passages_by_hand(texts):
    seen, out = {}, []
    units = []
    for i, t in sorted(texts):
        place = 0
        for m in re.finditer(substrings.UNIT, t or ""):
            w = m.group().lower().split()
            if len(w) >= substrings.UNIT_WORDS:
                units.append((i, place, m.start(), m.end(), len(w), " ".join(w)))
                place += 1
    run = None
    for i, place, a, b, n, u in units:
        repeated = u in seen
        seen.setdefault(u, i)
        if repeated and run and run[0] == i and run[4] == place - 1:
            run[2], run[3], run[4] = b, run[3] + n, place
        elif repeated:
            run and run[3] >= substrings.LEAST_WORDS and out.append(tuple(run[:4]))
            run = [i, a, b, n, place]
        if not repeated and run:
            run[3] >= substrings.LEAST_WORDS and out.append(tuple(run[:4]))
            run = None
    run and run[3] >= substrings.LEAST_WORDS and out.append(tuple(run[:4]))
    return sorted(out)


def test_passages_equal_brute_force(spark):
    common, line = words(30, 7) + ". " + words(25, 8) + ".", words(9, 9) + "\n"
    texts = [(k, f"{words(20, 30 + k)}. {common} {line * 2}{words(15, 60 + k)}? Ja. {words(6, 8)}") for k in range(6)]
    texts += [(10, None), (11, ""), (12, "short. short. short."), (13, common), (14, words(5000, 10)), (15, words(5000, 10).upper())]
    docs = frame(spark, texts)
    got = sorted((r["key"], r["start"], r["stop"], r["n_words"]) for r in substrings.passages(docs).collect())
    assert got == passages_by_hand(texts) and got
    cut = {r["doc_id"]: r for r in substrings.removed(docs).collect()}
    assert cut[0]["text"].count(common) == 1 and all(common not in cut[k]["text"] for k in range(1, 6))
    assert cut[10]["text"] is None and cut[13]["text"] == "" and cut[12]["text"] == texts[8][1] and cut[3]["gone"] == 1
    assert substrings.passages(docs.limit(0)).count() == 0


def test_repeated_rows_keep_what_the_document_keeps(spark):
    docs = frame(spark, [(1, words(30, 11)), (1, words(30, 11)), (None, words(30, 12)), (2, words(30, 12))])
    got = {r["key"]: r["n_words"] for r in substrings.passages(docs).collect()}
    assert got == {None: 30}


def test_later_copies_of_lines_go_whatever_their_length(spark):
    nine, five, made = words(9, 21), words(5, 22), "Ba ke. Lo mi. Tu ran."
    texts = [(k, f"{words(12, 700 + k)} x\n{nine}\n{five}\nall rights\n{words(12, 720 + k)} y\nEnd\n{made}") for k in range(3)]
    texts += [(5, f"Lo mi. {words(12, 740)}"), (6, f"{words(12, 741)}. Ba ke.")]
    docs = frame(spark, texts)
    got = sorted((r["key"], r["n_words"]) for r in substrings.passages(docs).collect())
    assert got == [(1, 14), (2, 14)]
    cut = {r["doc_id"]: r["text"] for r in substrings.removed(docs).collect()}
    assert cut[0] == texts[0][1] and cut[5] == texts[3][1] and cut[6] == texts[4][1]  # lines are copied, not short sentences
    for k in (1, 2):
        assert [x for x in cut[k].split("\n") if x] == [words(12, 700 + k) + " x", words(12, 720 + k) + " y"]
    kept = {r["doc_id"]: r["text"] for r in substrings.removed(docs, least_words=20).collect()}
    assert kept == dict(texts)  # phrases and licence lines stay where that is asked for


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        diagonal, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, diagonal + (x != y))
    return row[-1]


def test_least_distance_equals_all_stretches():
    draw = np.random.default_rng(4)
    for _ in range(30):
        item, region = draw.integers(0, 4, 6).astype(np.uint64), draw.integers(0, 4, 12).astype(np.uint64)
        d, s, e = decontaminate.least_distance(item, region)
        best = min(edit_distance(item, region[i:j]) for i in range(13) for j in range(i, 13))
        assert d == best == edit_distance(item, region[s:e])


def test_edited_passages_are_found_with_the_recall_told():
    draw = random.Random(6)
    items = [(k, words(draw.randrange(6, 60), 100 + k)) for k in range(200)]
    index, found = decontaminate.Index(items), 0
    for k, text in items:
        w = text.split()
        for _ in range(len(w) - -(-len(w) * 4 // 5)):
            p, kind = draw.randrange(len(w)), draw.randrange(3)
            if kind == 0:
                w[p] = "zz"
            elif kind == 1:
                del w[p]
            else:
                w.insert(p, "yy")
        hits = index.find(*utf8(pa.array([words(80, 500 + k) + " " + " ".join(w) + ", " + words(80, 800 + k)])))
        found += any(index.ids[h[1]] == k for h in hits)
    assert found >= 198


def test_decontamination_leaves_clean_rows_and_finds_spans(spark):
    item = words(20, 13)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too few"), (None, words(12, 14)), (1, item)], "item_id long, text string")
    docs = frame(spark, [(1, f"Ünder {item.upper()}! end"), (2, words(300, 15)), (3, None), (4, ""), (None, words(12, 14)), (2, words(20, 16))])
    got = decontaminate.matches(docs, bench).collect()
    assert {(r["key"], r["item_id"]) for r in got} == {(1, 1), (None, None)}
    one = next(r for r in got if r["key"] == 1)
    assert f"Ünder {item.upper()}! end"[one["start"]:one["stop"]] == item.upper()
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 3, 4]
    assert decontaminate.clean(docs, bench.limit(0)).count() == 6 and decontaminate.matches(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [1, 3])
def test_benchmark_in_blocks(spark, block, monkeypatch):
    items = [(k, words(15, 200 + k)) for k in range(7)]
    monkeypatch.setattr(decontaminate, "blocks", lambda b, f=decontaminate.blocks: f(b, block=block))
    docs = frame(spark, [(k, "a b c " + t) for k, t in items])
    got = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["key"], r["item_id"], r["distance"]) for r in got) == [(k, k, 0) for k in range(7)]
