"""Top-k search and hard negatives against brute force, with copies, ties, odd and huge vectors."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import negatives, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, cid long, q string, keys string, score string"


def whole(v, scale=256):
    if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def product(a, b):
    return max(-vectors.LONG, min(vectors.LONG, sum(x * y for x, y in zip(a, b))))


def brute_top(rows, every, k):
    held = sorted({(i, tuple(w)) for i, v, _ in rows if i is not None and (w := whole(v)) is not None})
    out = []
    for i, v in held:
        if i % every == 0:
            best = sorted({(-product(v, w), j) for j, w in held if j != i})[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def brute_negatives(rows, every, p=5, n=5):
    held = sorted({(i, label, tuple(w)) for i, v, label in rows if None not in (i, label) and (w := whole(v)) is not None})
    out = []
    for i, own, v in held:
        if i % every:
            continue
        alike = sorted({(-product(v, w), j) for j, label, w in held if j != i and label == own})[:p]
        for s, j in alike:
            hard = sorted({(-t, m) for m, label, w in held if m != i and label != own and 80 * -s <= 100 * (t := product(v, w)) <= 100 * -s})[:n]
            out += [(i, j, r + 1, m, -s, -t) for r, (t, m) in enumerate(hard)]
    return sorted(out)


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(i, v, c, 5, "x", "y", "z") for i, v, c in rows], SCHEMA).repartition(parts)


def planted(n=700, width=9, seed=3):
    """Clusters with noise; a third of the rows copies of one vector, and rows that take no part."""
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    common = [draw.gauss(0, 1) for _ in range(width)]
    rows = []
    for i in range(n):
        c = draw.randrange(6)
        v = common if draw.random() < 1 / 3 else [x + draw.gauss(0, 0.4) for x in centres[c]]
        rows.append((i, v, c))
    rows += [(n, None, 1), (n + 50, [None] * width, 1), (n + 100, [math.nan] * width, 1), (n + 150, [math.inf, *common[1:]], 1), (None, common, 1)]
    rows += [(1000, [], 2), (1050, common[:4], 3), (1100, [0.0] * width, 3), (1150, common, None), (-100, centres[0], 0), (7, centres[1], 1)]
    return rows + rows[:40]


def rows_of(found, names):
    return sorted(tuple(r[n] for n in names) for r in found.collect())


TOP = ["query_id", "rank", "vec_id", "score"]
HARD = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_topk_equals_brute_force(spark, lists, monkeypatch):
    monkeypatch.setattr(topk, "block_count", lambda rows, cores: 3)
    rows = planted()
    assert rows_of(topk.top_k(frame(spark, rows), lists=lists), TOP) == brute_top(rows, 50, 5)


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "block_count", lambda rows, cores: 3)
    rows = planted(900, seed=5)
    got = rows_of(negatives.mined(frame(spark, rows), every=50), HARD)
    assert got == brute_negatives(rows, 50) and len(got) > 100


def test_huge_components_are_exact(spark):
    draw = random.Random(8)
    rows = [(i, [draw.choice([1, -1]) * draw.random() * 10 ** draw.choice([0, 3, 6, 12]) for _ in range(5)], i % 3) for i in range(0, 400, 10)]
    rows += [(3000, [1e300, 1.0], 1), (3001, [1e300, -1.0], 2), (3100, [-1e300, 2.0], 1), (3200, [1e307, 2.0], 1)]
    assert rows_of(topk.top_k(frame(spark, rows)), TOP) == brute_top(rows, 50, 5)
    assert rows_of(negatives.mined(frame(spark, rows), every=50), HARD) == brute_negatives(rows, 50)


def test_few_rows_and_none(spark):
    few = [(0, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (4, [1.0, 1.9], 2)]
    assert rows_of(topk.top_k(frame(spark, few)), TOP) == brute_top(few, 50, 5)
    assert rows_of(negatives.mined(frame(spark, few)), HARD) == brute_negatives(few, 100)
    none = frame(spark, few).where("vec_id < 0")
    assert topk.top_k(none).count() == 0 and negatives.mined(none).count() == 0


@pytest.mark.parametrize("size", [3, 300, 1 << 30, 1 << 60])
def test_packed_products_are_exact(size):
    draw = random.Random(size)
    rows = np.array([[draw.randint(-size, size // 2) for _ in range(11)] for _ in range(29)], object if size > 1 << 31 else np.int64)
    anchors = np.array([[draw.randint(-size, size) for _ in range(11)] for _ in range(6)], rows.dtype)
    held = negatives.Packed(rows, size)
    assert held.fields > 1 or size == 1 << 30
    assert (held.scores(anchors) == anchors.astype(object) @ rows.astype(object).T).all()


def test_equal_vectors_have_equal_bytes():
    for v in [[], [1.0, -0.0], [40000.0, 2.0], [1e20, -3.0]]:
        held = vectors.encoded(np.array(v) + 0.0)
        assert [int(x) for x in vectors.matrix(pa.array([held], pa.binary()))[0]] == [int(x) for x in v]
    mixed = [vectors.encoded(np.array(v)) for v in ([1.0, 2.0, 3.0], [70000.0], [1e12, 5.0])]
    assert vectors.matrix(pa.array(mixed, pa.binary())).tolist() == [[1, 2, 3], [70000, 0, 0], [10**12, 5, 0]]


def test_threshold_drops_most_vectors(spark, monkeypatch):
    """The second phase collects a small part of all pairs, and the third resolves no more than that."""
    sizes = []
    plain = topk.resolved

    def counted(pairs, rows):
        sizes.append(pairs.count())
        return plain(pairs, rows)

    monkeypatch.setattr(topk, "resolved", counted)
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=32).tolist(), 0) for i in range(2000)]
    assert rows_of(topk.top_k(frame(spark, rows)), TOP) == brute_top(rows, 50, 5)
    assert sizes[0] <= 40 * 12 and sizes[1] < 40 * 2000 / 15
