import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.operators import blocks, ordering, quantiles, stats

MARKS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("small_group", [20_000, 0])
@pytest.mark.parametrize("shape", ["even", "ties", "heavy", "constant"])
def test_exact_quantiles(spark, monkeypatch, shape, small_group):
    """Both the short path and the bracket path give numpy's linear quantiles."""
    monkeypatch.setattr(quantiles, "SMALL_GROUP", small_group)
    n, rng = 30_000, np.random.default_rng(7)
    values = {
        "even": rng.normal(size=n), "ties": rng.integers(0, 7, n).astype(float),
        "heavy": np.exp(rng.normal(size=n) * 6), "constant": np.full(n, 2.5),
    }[shape]
    groups = np.where(np.arange(n) % 3 == 0, "hot", np.char.add("g", (np.arange(n) % 5).astype(str)))
    local = pd.DataFrame({"g": groups, "v": values})
    df = spark.createDataFrame(local)
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", MARKS).collect()}
    for g, part in local.groupby("g"):
        assert got[g].n == len(part)
        np.testing.assert_allclose(got[g].quantiles, np.quantile(part["v"], MARKS), rtol=1e-12)


def test_whole_column(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact_quantiles(df, [], "v", [0.25, 0.5]).first().quantiles == [25.0, 50.0]


def test_bins_match_quantile_cut(spark):
    values = [1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    edges = list(dict.fromkeys(np.quantile(values, [0, 0.25, 0.5, 0.75, 1])))
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("e", F.array(*map(F.lit, map(float, edges))))
    got = [r.b for r in df.select(quantiles.quantile_bin(F.col("v"), F.col("e"), 4).alias("b")).collect()]
    assert got == pd.qcut(values, 4, labels=False, duplicates="drop").tolist()


def test_moving_average_across_slices(spark):
    """One long series, one short one, and one order value shared by many rows."""
    n, rng = 20_000, np.random.default_rng(3)
    order = np.where(np.arange(n) % 3 == 0, 500.0, rng.integers(0, 1000, n).astype(float))
    series = np.where(np.arange(n) < n - 5, "long", "short")
    local = pd.DataFrame({"s": series, "o": order, "k": np.arange(n), "v": rng.normal(size=n)})
    result = ordering.moving_average(spark.createDataFrame(local), "v", ["o", "k"], 7, ["s"]).toPandas()
    assert len(result) == n
    expected = local.sort_values(["s", "o", "k"])
    expected["m"] = expected.groupby("s")["v"].transform(lambda x: x.rolling(7, min_periods=1).mean())
    both = result.merge(expected[["k", "m"]], on="k")
    np.testing.assert_allclose(both["moving_average"], both["m"], atol=1e-9)


def test_row_numbers(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("o"), "id")
    got = ordering.with_row_number(df, ["o", "id"]).orderBy("row_number").toPandas()
    assert got["row_number"].tolist() == list(range(1, 5001))
    assert got.equals(got.sort_values(["o", "id"]).reset_index(drop=True))


@pytest.mark.parametrize("width", [5, 10])  # 10 and 45 pairs
def test_correlations_equal_pandas(spark, width):
    rng = np.random.default_rng(5)
    names = list("abcdfghij")[:width - 1]
    local = pd.DataFrame(rng.normal(size=(500, width - 1)) + 1e6, columns=names)
    local["b"] += local["a"]
    local.loc[::7, "b"] = np.nan
    local["e"] = 3.0
    rows = local.astype(object).where(local.notna(), None)
    rows.loc[3, "a"] = float("inf")  # counts as missing
    local.loc[3, "a"] = np.nan
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in local))
    columns = list(local)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    got = {(r[0], r[1]): (r[2], r[3]) for r in stats.pair_correlations(df, columns).collect()}
    expected = local.corr()
    assert set(got) == set(pairs)
    for a, b in pairs:
        n, r = got[a, b]
        assert n == local[[a, b]].dropna().shape[0]
        assert r is None if "e" in (a, b) else abs(r - expected.loc[a, b]) < 1e-7
    turned = stats.pair_correlations(df, ["b"], ["a", "c"]).collect()
    assert [(r[0], r[1]) for r in turned] == [("b", "a"), ("b", "c")]
    assert {(r[2], r[3]) for r in stats.pair_correlations(df.limit(0), columns).collect()} == {(0, None)}


@pytest.mark.parametrize("width", [60, 61])
def test_facts_have_a_row_for_every_column(spark, width):
    names = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame([tuple(float(i) for i in range(width))], ", ".join(f"{c} double" for c in names))
    got = {r.variable: (r.row_count, r["count"], r.missing_count, r["mean"]) for r in stats.column_facts(df, names).collect()}
    assert got == {c: (1, 1, 0, float(i)) for i, c in enumerate(names)}
    empty = stats.column_facts(df.limit(0), names).collect()
    assert {(r.row_count, r["count"], r.missing_count, r["mean"]) for r in empty} == {(0, 0, 0, None)} and len(empty) == width


def test_blocks_are_added_by_part(spark):
    def ones(batches):
        n = sum(b.num_rows for b in batches)
        yield blocks.block_rows({"a": np.full(3, n), "b": np.full(2, 2.0 * n)})

    got = blocks.summed_blocks(spark.range(0, 1000, 1, 40).toDF("id"), ones)
    assert got["a"].tolist() == [1000.0] * 3 and got["b"].tolist() == [2000.0] * 2


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.0,)], "v double")
    rows = stats.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r.row_count for r in rows] == [1, 0, 0, 0, 2]


def test_value_at_a_rank(spark):
    values = [None, None] + [float(v) for v in np.random.default_rng(3).integers(0, 60, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(6)
    ordered = sorted(values, key=lambda v: (v is not None, v or 0.0))
    for rank in (1, 3, 250, 502):
        value, below = ordering.value_at(df, "v", rank)
        assert value == ordered[rank - 1] and below == ordered.index(value)
