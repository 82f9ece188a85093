"""Packing, shards, rules, chat, pages and scores on small and odd rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotwise.llm import chat, htmltext, packing, quality, rules, sharding, toxicity, training
from lotwise.llm.arrays import utf8
from lotwise.llm.queries import ORACLES, QUERIES, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, `row` string, size long"


def frame(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, 1, "r", 2) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    found.encode_special_tokens = True
    return found


ODD = ["O'Brien's don't 'tis #!... été ÉTÉ. İstanbul ΣΑΣ Ⅷ x2 ½ a--b <|endoftext|>", "a b\tc\r\nd\x1ce ''' l'été", "日本語。ß ﬁ", "", " \n",
       "a.'s !'s x'.d 5.s é.a ….b", "é H̱ ẖ É", "a" * 3000, "The the THE. (the) the, ***the%%%"]


def test_ids_equal_the_tokenizer(tokenizer):
    encoder = packing.Encoder(vocabulary("word_bpe_49k.json"))
    for _ in range(2):  # the second time from memory
        flat, begins = encoder.encode(*utf8(pa.array(ODD)))
        for k, t in enumerate(ODD):
            assert flat[begins[k]:begins[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_a_full_table_forgets_and_stays_right(tokenizer):
    encoder = packing.Encoder(vocabulary("word_bpe_49k.json"))
    encoder.table = packing.WordTable(bits=4)
    for at in range(0, 400, 20):
        texts = [f"word{k} Word alpha{chr(97 + k % 26)} beta." for k in range(at, at + 20)]
        flat, begins = encoder.encode(*utf8(pa.array(texts)))
        for k, t in enumerate(texts):
            assert flat[begins[k]:begins[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_plan_places_every_rank_without_gaps():
    draw = np.random.default_rng(1)
    for _ in range(40):
        histogram = {int(k): int(n) for k, n in zip(draw.integers(1, 65, 12), draw.integers(1, 300, 12))}
        filled = collections.defaultdict(list)
        for length, lo, hi, first, per, base in packing.plan(histogram, 64):
            for r in range(lo, hi):
                filled[first + (r - lo) // per].append((base + (r - lo) % per * length, length))
        assert sum(map(len, filled.values())) == sum(histogram.values())
        for places in filled.values():
            places.sort()
            assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 64


def test_packing_round_trip(spark, tokenizer):
    texts = [(1, "alpha beta gamma " * 40), (2, None), (3, ""), (None, "x"), (1, "alpha beta gamma " * 40), (4, "one two three")]
    got = packing.packed(frame(spark, texts), vocabulary("word_bpe_49k.json"), most=64, ids=True).collect()
    for i, t in texts:
        own = sorted((r for r in got if r["key"] == i), key=lambda r: (r["piece"], r["sequence_id"]))
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        copies = texts.count((i, t))
        assert [r["length"] for r in own][::copies] == [len(ids[k:k + 64]) for k in range(0, len(ids), 64)]
        assert b"".join(bytes(r["ids"]) for r in own[::copies]) == np.array(ids, "<u4").tobytes()
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in own)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 64) + 1
    assert packing.packed(frame(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_hilbert_neighbours_are_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    index = sharding.hilbert(cells, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_copies_stay_together(spark):
    texts = [(k, "t" * (k % 37) + str(k // 3)) for k in range(3000)] + [(None, None), (5, None), (7, "é" * 40)]
    docs = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("lang")))
    got = sharding.shards(docs).collect()
    assert len(got) == len(texts)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    totals = [sum(r["size"] for r in rows) for rows in by.values()]
    assert sorted(by) == list(range(16)) and max(totals) < 1.06 * min(totals)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    places = collections.defaultdict(set)
    for r in got:
        places[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in places.values())
    one = [(k, "same") for k in range(400)]
    sizes = collections.Counter(r["shard"] for r in sharding.shards(frame(spark, one)).collect())
    assert set(sizes.values()) == {25}
    assert sharding.shards(frame(spark, [])).count() == 0


@pytest.mark.parametrize("sizes", [[1] * 18, [3, 1, 1, 5, 2, 2, 1, 3], [7]])
def test_cuts_of_any_count(spark, sizes):
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    rows = [(k, b, s, k, k) for k, (b, s) in enumerate(zip(before, sizes))]
    ordered = spark.createDataFrame(rows, "row_no long, before long, size long, same long, curve long").cache()
    total = sum(sizes)
    for count in (1, 2, 7, 14, 18, 31):
        expected = []
        for k in range(1, count):
            row = next(r for r in rows if r[1] * count < total * k <= (r[1] + r[2]) * count)
            if row[2] * count > sharding.TOLERANCE * total:  # a long row: its nearer side
                left, right = total * k - row[1] * count, (row[1] + row[2]) * count - total * k
                expected.append({row[0]} if left < right else {row[0] + 1} if left > right else {row[0], row[0] + 1})
        got = sharding.cut_rows(ordered, count)
        assert len(got) == count - 1 and all(g in e for g, e in zip(got, expected))
    ordered.unpersist()


def counts_by_hand(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    c = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    held = {j for k in range(len(w) - 4) if c[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), again, len(held), len(w) < 10 or 100 * len(held) > 20 * len(w)


def test_rule_counts_equal_brute_force(spark):
    texts = [None, "", " \x0b\n", "one", "a b c d e a b c d e", "l\nl\n\nl \n l", "é ü " * 9, "x " * 5000, "a b c d e f g h i j k l # * | <é>",
             " ".join(f"w{k % 400}" for k in range(4000)), "a\xa0b c d"]
    got = {r["row"]["doc_id"]: r for r in rules.judged(frame(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts_by_hand(t), t


def test_limits_follow_the_group(spark):
    plain = [(k, " ".join(f"word{k * 31 + j}" for j in range(40))) for k in range(200)]
    marked = [(1000 + k, " ".join(f"word{k * 17 + j}##" for j in range(40))) for k in range(5)]
    docs = frame(spark, plain + marked).union(frame(spark, [(2000, plain[0][1])], None, None)).union(frame(spark, [(2001, None)], "de", "t"))
    kept = rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in plain} | {2000}
    assert rules.kept_documents(docs.limit(0)).count() == 0


def test_chat_reads_back(spark):
    said = [(1, 0, "user", "a \\- </turn> <part/> ### x"), (1, 1, "user", ""), (1, 2, "assistant", "<</turn>\n\\"), (1, 3, "assistant", None),
            (1, 3, "assistant", "tie"), (2, None, None, "null turn"), (2, 0, "role:\n", "<part/"), (None, 1, "assistant", "</turn"), (1, 4, "user", "end")]
    turns = spark.createDataFrame([(*r, "x") for r in said], "conv_id long, turn long, role string, text string, segments string")
    found = chat.formatted(turns)
    back = {r["conv_id"]: r for r in found.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.trained_text(F.col("segments")).alias("loss")).collect()}
    for conv, r in back.items():
        own = sorted((x for x in said if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [tuple(t) for t in r["t"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert back[1]["formatted"].count("### ") == 3  # adjacent turns of one role share a message
    assert chat.formatted(turns.limit(0)).count() == 0


@pytest.mark.parametrize("role", ["user", "#", "###"])
def test_no_control_string_is_left(spark, role):
    said = ["#" * n + " Assistant: x" for n in range(1, 10)] + ["</turn></turn>", "<</turn>/turn>", "<part/<part/>>", "#\\-#", "\\#\\##\\###", "###</turn>\n### user:\n"]
    turns = spark.createDataFrame([(i, 0, role, t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    found = chat.formatted(turns).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t")).collect()
    for r in found:
        assert [tuple(t) for t in r["t"]] == [(role, said[r["conv_id"]])]
        own = r["formatted"]
        assert own.startswith("### ") and "##" not in own[3:] and own.count("</turn>") == 1 and own.endswith("</turn>\n") and "<part/>" not in own


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><a href=x>Home</a></header>
<div id="cookie-notice"><p>We use cookies, and more of them, to make your visit pleasant. Accept them all, please.</p></div>
<div class="wrap"><div class="sidebar"><p>Sidebar text which is rather long, with commas, and stops. Really long.</p></div>
<div class="post-body"><h2>Short  title</h2><p>Main <b>te</b>xt is here &amp; goes on,
with enough words to be seen as content. Another sentence.<p>OK.<ul><li>one<li>two</ul><div class="ad">Buy now, buy cheap!</div>
<p>Last paragraph, with words enough to count as content, and a stop.</p><script>var x = "<p>no</p>";</script></div>
<section class="comments"><p>I like this article very much, it is a good one. Thanks, all of you.</p></section></div>
<form><label>Name</label></form><footer>&copy; 2020</footer></body></html>"""


def test_pages(spark):
    article = ("Short title Main text is here & goes on, with enough words to be seen as content. Another sentence. OK. one two "
               "Last paragraph, with words enough to count as content, and a stop.")
    pages = [(1, "u", PAGE), (2, None, None), (3, "", ""), (None, "u", "plain"), (4, "u", "<p>a<p>b <!-- c"), (5, "u", "<nav>menu</nav>"),
             (6, "u", "<p>" + "word, " * 50_000 + "</p>"), (1, "u", PAGE)]
    got = htmltext.extracted(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")).collect()
    texts = [r["text"] for r in got]
    assert texts == [article, "", "", "plain", "a b", "", ("word, " * 50_000).strip(), article]


def labelled(spark, n=1200):
    draw = np.random.default_rng(7)
    common = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu") for b in ("ran", "sel", "tor", "vin")]
    texts, labels = [], []
    for k in range(n):
        w = [common[j] for j in draw.integers(0, len(common), 60)]
        bad, junk = k % 5 == 1, k % 4 == 2
        if bad:
            w[30] = "zyxqu" + w[30]
        if junk:
            w = [x + "%%%" for x in w]
        texts.append((k, " ".join(w)))
        labels.append((k, int(not junk), int(bad)))
    return frame(spark, texts + [(5000, None), (5001, ""), (None, "ba ke")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_learn_from_rows_not_held_out(spark):
    docs, labels = labelled(spark)
    sample = training.labelled_sample(docs, labels, "toxic").cache()
    assert all(zlib.crc32(str(r["key"]).encode()) % 5 for r in sample.collect())
    got = {r["key"]: r["score"] for r in toxicity.scored(docs, *toxicity.model(sample)).collect()}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == (k % 5 == 1) for k in held]) > 0.99 and got[5000] < 0.5 and got[5001] < 0.5
    weights = quality.fit(training.labelled_sample(docs, labels, "quality"))
    got = {r["key"]: r["score"] for r in quality.scored(docs, weights).collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 4 != 2) for k in held]) > 0.99 and 0 <= got[5000] <= 1
    sample.unpersist()
    none = training.labelled_sample(docs, labels.limit(0), "quality")
    assert {r["score"] for r in quality.scored(docs, quality.fit(none)).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), *toxicity.model(none)).count() == 0


def test_grammar_tells_clauses_apart():
    lexicon, w = toxicity.Lexicon({}), toxicity.starting_weights()

    def kinds(text):
        x = toxicity.clause_features(*utf8(pa.array([text])), lexicon)[0]
        return {toxicity.KINDS[k] for k in np.flatnonzero(x)}, float(w[0] + x @ w[1:])

    assert kinds("You are an idiot.")[0] == {"insult@"}
    assert kinds("He is not stupid. You know.")[0] == {"insult-@"}
    assert kinds("Somebody said idiot, then left")[0] == {"insult'"}
    assert kinds("I will kill you")[0] == {"threat@"}
    assert kinds("a calm text about you")[0] == set()
    assert kinds("you idiot")[1] > kinds("not an idiot")[1] > kinds("")[1]
    for text, kind in [
        ("She said, you are an idiot", "insult'@"), ("She said: you are an idiot", "insult'@"),
        ('She said: "You are an idiot."', "insult'@"), ("You are an idiot, he wrote", "insult'@"),
        ("'You idiot,' he said", "insult'@"), ('"You idiot!" he said.', "insult'@"), ('"I will kill you," wrote the man', "threat'@"),
        ("You are not, in any way, an idiot", "insult-@"), ("He said you are not, in any way, an idiot", "insult-'@"),
        ("No, you are an idiot", "insult@"), ("I do not like this, you idiot", "insult@"),
        ("She said hello. You are an idiot", "insult@"), ("You idiot! He said that it rains all day long", "insult@"),
        ("You idiot, I told all of my friends about what was done", "insult@"),
        ("She said hello\nYou are an idiot", "insult@"),
    ]:
        assert kinds(text)[0] == {kind}, text
    apart = toxicity.clause_features(*utf8(pa.array(["he said,", "you idiot", ", he said", "", None])), lexicon)
    assert {toxicity.KINDS[k] for k in np.flatnonzero(apart.sum(axis=0))} == {"insult@"}  # rows do not touch
    assert kinds("you idiot, you scum")[1] > kinds("you idiot")[1]


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    oracle = pytest.importorskip("oracle")
    assert oracle.compare(QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), ORACLES[name]) == ""


def test_chat_digest_by_hand(spark):
    rows = {r["conv_id"]: r for r in QUERIES["op7_chat"](spark, FOLDER).collect()}
    text = "\\### Assistant: </turn> ok"
    r = rows[-7]
    assert r["n_turns"] == 2 and r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
