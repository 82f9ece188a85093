"""Ordered statistics, rounds of several tasks and leaf terms against plain versions."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lotwise.operators import boosting, forest


def test_ordered_statistics_equal_a_loop(spark):
    draw = np.random.default_rng(3)
    local = [(f"k{i}", float(draw.normal()), str(draw.choice(["a", "a", "a", "b", "c"])), f"L{draw.integers(0, 40)}") for i in range(500)]
    rows = spark.createDataFrame(local, "k string, label double, one string, many string").repartition(6)
    found, levels = boosting.ordered_statistics(rows, ["one", "many"], "k")
    got = {r.k: list(r.stats) for r in found.collect()}
    hashes = {r.k: r.h for r in rows.select("k", F.xxhash64("k", F.lit("order")).alias("h")).collect()}
    prior = np.mean([r[1] for r in local])
    assert found.columns == [*rows.columns, "stats"] and len(got) == 500
    for c in (2, 3):
        met = {}
        for r in sorted(local, key=lambda r: hashes[r[0]]):
            total, n = met.get(r[c], (0.0, 0))
            assert abs(got[r[0]][c - 2] - (total + prior) / (n + 1)) < 1e-9
            met[r[c]] = total + r[1], n + 1
    new = spark.createDataFrame([("x", 0.0, "a", "unheard")], rows.schema)
    stats = boosting.known_statistics(new, ["one", "many"], levels).first().stats
    own = [r[1] for r in local if r[2] == "a"]
    assert abs(stats[0] - (sum(own) + prior) / (len(own) + 1)) < 1e-9 and abs(stats[1] - prior) < 1e-12


def plain_boost(codes, y, iterations, rate, depth, ridge):
    """Residual trees, one node at a time."""
    def values(codes, rest, depth):
        best, test = 1e-9, None
        for f in range(codes.shape[1]) if depth else ():
            for c in np.unique(codes[:, f])[:-1]:
                low = codes[:, f] <= c
                a, b = rest[low], rest[~low]
                gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - rest.sum() ** 2 / len(rest)
                if gain > best + 1e-9:
                    best, test = gain, (f, c)
        if test is None:
            return np.full(len(rest), rest.sum() / (len(rest) + ridge))
        low = codes[:, test[0]] <= test[1]
        out = np.empty(len(rest))
        out[low], out[~low] = values(codes[low], rest[low], depth - 1), values(codes[~low], rest[~low], depth - 1)
        return out

    rest = y - y.mean()
    for _ in range(iterations):
        rest = rest - rate * values(codes, rest, depth)
    return y - rest


@pytest.mark.parametrize("most_rows", [1 << 18, 100])
def test_rounds_equal_plain_boosting(spark, most_rows, monkeypatch):
    monkeypatch.setattr(boosting, "REPLAY", 5)
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 3)).round(1)
    y = x[:, 0] * x[:, 1] + draw.normal(size=300) * 0.1
    made = [(f"k{i}", float(y[i]), x[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(made, "k string, label double, x array<double>").withColumn("features", array_to_vector("x"))
    bins = forest.fit_bins(df, 3, 32)
    coded = forest.coded(df, bins, "k")
    model = boosting.fit_boosted(coded, bins, 12, 0.2, 3, 3.0, most_rows)
    held = coded.collect()
    codes, own = np.array([list(r.codes) for r in held]), np.array([r.y for r in held])
    expected = plain_boost(codes, own, 12, 0.2, 3, 3.0)
    np.testing.assert_allclose(model.predict(codes), expected, atol=1e-9)
    assert len(model.trees) == 12 and abs(model.error - ((own - expected) ** 2).sum()) < 1e-8
    found = boosting.scored(model, coded).agg(F.sum(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    assert abs(found - model.error) < 1e-8


def test_leaf_terms_equal_all_orders():
    """One leaf with three features against the average over all feature orders."""
    leaf = boosting.Leaf(5.0, 0.1, {0: (0, 1, 0.5), 1: (3, 255, 0.3), 2: (0, 1, 0.8)})
    codes = np.array([[0, 3, 1], [2, 3, 2]], np.uint8)
    total = np.zeros(codes.shape)
    boosting.add_leaf(total, codes, leaf)
    met, cover = np.array([[1, 1, 1], [0, 1, 0]], float), np.array([0.5, 0.3, 0.8])
    expected = np.zeros(codes.shape)
    for order in permutations(range(3)):
        known = np.tile(cover, (2, 1))
        for f in order:
            before = known.prod(1)
            known[:, f] = met[:, f]
            expected[:, f] += 5.0 * (known.prod(1) - before) / 6
    np.testing.assert_allclose(total, expected)


def test_paths_merge_the_tests_of_a_feature():
    one = np.array
    tree = forest.Tree(one([0, -1, 0, -1, -1]), one([4, 0, 9, 0, 0]), one([1, 0, 3, 0, 0]), one([0.0, 1.0, 0.0, 2.0, 3.0]),
                       one([10.0, 4.0, 6.0, 3.0, 3.0]), one([1.0, 0, 1.0, 0, 0]))
    found = sorted((x.value, x.share, x.tests[0][:2]) for x in boosting.leaves_of([tree]))
    assert found == [(1.0, 0.4, (0, 4)), (2.0, 0.3, (5, 9)), (3.0, 0.3, (10, 255))]


def test_a_level_of_many_rows_is_a_job_of_one_stage(spark, monkeypatch):
    made = [(f"k{i}", float(i % 13), [float(i % 5), float(i % 3)]) for i in range(200)]
    df = spark.createDataFrame(made, "k string, label double, x array<double>").withColumn("features", array_to_vector("x"))
    bins = forest.fit_bins(df, 2, 16)
    coded = forest.coded(df, bins, "k")
    spark.sparkContext.setJobGroup("rounds", "rounds of boosting")
    boosting.fit_boosted(coded, bins, 3, 0.2, 3, 3.0, most_rows=50)
    tracker = spark.sparkContext.statusTracker()
    stages = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("rounds")]
    assert sum(n == 1 for n in stages) >= 9  # three levels of three trees


def test_terms_of_sets_equal_terms_of_rows():
    """Paths of one to nine features, where rows are looked up by the set that lets them through."""
    draw = np.random.default_rng(8)
    for d in (1, 4, 9):
        tests = {f: (int(draw.integers(0, 2)), int(draw.integers(2, 5)), float(draw.uniform(0.1, 0.9))) for f in range(d)}
        codes = draw.integers(0, 6, (60, d)).astype(np.uint8)
        total, one = np.zeros((60, d), order="F"), np.zeros((1, d))
        boosting.add_leaf(total, np.asfortranarray(codes), boosting.Leaf(2.0, 0.2, tests))
        met = np.array([[lo <= c <= hi for c, (lo, hi, _) in zip(r, tests.values())] for r in codes])
        cover = np.prod([t[2] for t in tests.values()])
        np.testing.assert_allclose(total.sum(1), 2.0 * (met.all(1) - cover))  # terms add up to the leaf's share
        boosting.add_leaf(one, codes[7:8], boosting.Leaf(2.0, 0.2, tests))
        np.testing.assert_allclose(one[0], total[7])


def test_tables_of_terms_equal_terms_leaf_by_leaf(spark):
    """Attributions by tables over stretches of codes, whole trees in one table or cut in halves."""
    draw = np.random.default_rng(9)
    codes = draw.integers(0, 64, (400, 3)).astype(np.uint8)
    y = codes[:, 0] * 0.1 + (codes[:, 1] > 30) * codes[:, 2] * 0.2 + draw.normal(size=400)
    rest, trees = y - y.mean(), []
    across = boosting.columns_of(codes)
    for _ in range(6):
        tree = boosting.grown(lambda t, nodes: boosting.node_sums(rest, across, 64, t, nodes), 5, 3.0)
        np.testing.assert_array_equal(boosting.predicted(tree, across), tree.predict(codes))
        trees.append(tree)
        rest = rest - 0.3 * tree.predict(codes)
    expected = np.zeros(codes.shape, order="F")
    for leaf in boosting.leaves_of(trees):
        boosting.add_leaf(expected, np.asfortranarray(codes), leaf)
    for entries in (1 << 10, 40):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(boosting, "ENTRIES", entries)
            terms = [t for tree in trees for t in boosting.terms_of(boosting.leaves_of([tree]))]
        assert len(terms) < sum((t.feature < 0).sum() for t in trees)  # not a look-up for every leaf
        total = np.zeros(codes.shape)
        for t in terms:
            for f, values in t.table.items():
                total[:, f] += values[sum(step[codes[:, g]] for g, step in t.steps.items())]
        np.testing.assert_allclose(total, expected, atol=1e-9)
    model = boosting.Boosted(trees, forest.Bins([np.arange(63.0)] * 3), 1.0, 0.0, 1.0)
    rows = spark.createDataFrame([(i, bytes(c)) for i, c in enumerate(codes)], "key long, codes binary").repartition(5)
    found, base = boosting.attributions(model, rows, ["a", "b", "c"])
    sums = {r.key: r.s for r in found.groupBy("key").agg(F.sum("attribution").alias("s")).collect()}
    np.testing.assert_allclose([base + sums[i] for i in range(400)], model.predict(codes), atol=1e-9)


def test_levels_of_many_rows_read_the_blocks_that_executors_keep(spark, monkeypatch):
    """Blocks that executors keep give the trees of one task, and none is left behind."""
    monkeypatch.setattr(boosting, "HELD_ROWS", 64)  # several blocks to a task
    monkeypatch.setattr(boosting, "REPLAY", 4)
    noise, kept, plain = np.random.default_rng(6).normal(size=2000), [], boosting.grown
    held = spark.sparkContext._jsc.sc().getPersistentRDDs
    earlier = held().size()

    def grown(*given):
        tree = plain(*given)
        kept.append(held().size() - earlier)
        return tree

    monkeypatch.setattr(boosting, "grown", grown)
    made = [(f"k{i}", float(i % 5 + noise[i]), [float(i % 5), float(i % 31)]) for i in range(2000)]
    df = spark.createDataFrame(made, "k string, label double, x array<double>").withColumn("features", array_to_vector("x"))
    bins = forest.fit_bins(df, 2, 32)
    coded = forest.coded(df, bins, "k")
    passes = boosting.fit_boosted(coded, bins, 10, 0.2, 3, 3.0, 100)
    assert kept == [1] * 10  # the blocks of this tree; those of the one before are gone
    monkeypatch.setattr(boosting, "grown", plain)
    whole = boosting.fit_boosted(coded, bins, 10, 0.2, 3, 3.0, 1 << 18)
    assert abs(whole.error - passes.error) < 1e-8 * whole.error
    for a, b in zip(whole.trees, passes.trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all()
        np.testing.assert_allclose(a.value, b.value, atol=1e-9)
    assert held().size() == earlier
