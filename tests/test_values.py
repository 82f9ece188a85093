"""Distinct values and top values: bounds by hash buckets against plain counting."""

import random
from collections import Counter

import pytest

from lotwise.operators import audit, profile, stats

SCHEMA = "flat double, few int, wide double, zeros double, empty double, text string, lot string, flag boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def rows(n):
    draw = random.Random(n)
    return [
        (
            1.5 if draw.random() < 0.97 else draw.random(), draw.choice([1, 2, None]), draw.random(),
            draw.choice([0.0, -0.0]), None, draw.choice(["a", "b", None]), f"L{i % 40}", draw.random() < 0.5,
        )
        for i in range(n)
    ]


def counts(data, place):
    return Counter(r[place] for r in data if r[place] is not None)


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_bounds_and_exact_facts(spark, n):
    data = rows(n)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    bounds = {r.variable: r for r in stats.value_bounds(df, COLUMNS).collect()}
    facts = {r.variable: r for r in stats.distinct_facts(df, COLUMNS).collect()}
    for place, c in enumerate(COLUMNS):
        true = counts(data, place)
        assert bounds[c].non_missing == facts[c].non_missing == sum(true.values())
        assert min(len(true), 2) <= bounds[c].at_least <= len(true)
        assert bounds[c].top_at_most >= max(true.values(), default=0)
        assert facts[c].unique_count == len(true) and facts[c].top_count == max(true.values(), default=0)
    if n == 3000:
        assert bounds["wide"].at_least > 256 and bounds["wide"].top_at_most < 60
        assert facts["zeros"].top_value == "0.0" and facts["flat"].top_value == "1.5"


def test_near_constant_counts_only_suspects(spark):
    data = rows(3000)
    df = spark.createDataFrame(data, SCHEMA)
    found = {r["column"]: r for r in profile.near_constant(df, COLUMNS).collect()}
    exact = {r["column"]: r for r in profile.near_constant(df, COLUMNS, stats.distinct_facts(df, COLUMNS)).collect()}
    assert found == exact
    assert {c: r.reason for c, r in found.items()} == {
        "flat": "near-constant", "zeros": "constant", "empty": "all values missing"}
    assert found["flat"].unique_count == len(counts(data, 0))


def test_no_spread_with_many_values(spark):
    df = spark.createDataFrame([(i * 1e-9,) for i in range(100)], "x double")
    row = profile.near_constant(df, ["x"]).first()
    assert (row.reason, row.unique_count) == ("near-zero variance", 100)


@pytest.mark.parametrize("share", [94, 95])
def test_share_at_the_limit(spark, share):
    df = spark.createDataFrame([(1.0 if i < share else float(i),) for i in range(100)], "x double")
    assert profile.near_constant(df, ["x"]).count() == (share >= 95)


def test_estimated_types(spark):
    df = spark.createDataFrame(rows(3000), SCHEMA)
    exact = {r["column"]: r for r in profile.variable_types(df, COLUMNS).collect()}
    found = {r["column"]: r for r in profile.estimated_types(df, COLUMNS).collect()}
    assert {c: (r.type, r.non_missing) for c, r in found.items()} == {c: (r.type, r.non_missing) for c, r in exact.items()}
    assert all(found[c].unique_count == r.unique_count for c, r in exact.items() if r.type != "continuous")
    assert abs(found["wide"].unique_count / 3000 - 1) < 0.1


def test_profile_with_estimates(spark):
    df = spark.createDataFrame(rows(500), SCHEMA).selectExpr("*", "wide * 2 AS yield_g")
    one, two = (profile.build_profile(df, ["yield_g"], "lot", exact_counts=e) for e in (True, False))
    assert {tuple(r) for r in one.near_constant.collect()} == {tuple(r) for r in two.near_constant.collect()}
    assert {r.message for r in one.warnings.collect()} == {r.message for r in two.warnings.collect()}


def test_levels_leave_continuous_columns_out(spark):
    df = spark.createDataFrame(rows(200), SCHEMA)
    assert {r.variable for r in stats.level_facts(df, COLUMNS).collect()} == {"few", "zeros", "empty", "text", "lot", "flag"}
    assert [r["column"] for r in audit.many_levels(df, COLUMNS).collect()] == ["lot"]
    assert [(r["column"], r.unique_count) for r in audit.confounding(df, COLUMNS).collect()] == [("lot", 40)]


@pytest.mark.parametrize("least", [1, 4, 8])
def test_varied_is_exact(spark, least):
    sizes = {f"v{k}": k for k in (1, 3, 4, 7, 8, 9, 300)}
    data = [(v, float(i % k)) for v, k in sizes.items() for i in range(600)] + [("none", None), ("zero", 0.0), ("zero", -0.0)]
    df = spark.createDataFrame(data, "variable string, value double").repartition(3)
    found = sorted(r.variable for r in stats.varied(df, least).collect())
    assert found == sorted([v for v, k in sizes.items() if k >= least] + ["zero"] * (least == 1))


def test_varied_when_values_share_buckets(spark, monkeypatch):
    """With one bucket the bound is 2 at most, so every answer comes from the recount."""
    monkeypatch.setattr(stats, "BUCKETS", 1)
    df = spark.createDataFrame([(f"v{k}", float(i % k)) for k in (2, 5, 6) for i in range(30)], "variable string, value double")
    assert sorted(r.variable for r in stats.varied(df, 6).collect()) == ["v6"]
