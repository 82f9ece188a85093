import pytest

from lotwise.errors import InputError
from lotwise.operators import match


def tables(spark):
    p = spark.createDataFrame([("B-001", 1.0), ("B-002", 2.0), ("B-009", 3.0)], "`Batch ID` string, temp double")
    q = spark.createDataFrame([("B001", 80.0), ("b 002", 81.0), ("X1", 1.0)], "batch string, yield_percent double")
    return p, q


def test_join_keeps_the_process_key(spark):
    p, q = tables(spark)
    m = match.match_tables(p, q, "Batch ID", "batch", ["yield_percent"])
    assert sorted(tuple(r) for r in m.data.select("batch_id", "yield_percent").collect()) == [("B-001", 80.0), ("B-002", 81.0)]
    assert {tuple(r) for r in m.unmatched.collect()} == {("process", "B009"), ("qc", "X1")}
    assert m.counts.first().matched_batches == 2


@pytest.mark.parametrize("rows", [[("B-1", 1.0), ("b1", 2.0)], [("B1", 1.0), (None, 2.0)], []])
def test_unusable_keys(spark, rows):
    p, q = tables(spark)
    bad = spark.createDataFrame(rows, "batch string, yield_percent double")
    with pytest.raises(InputError):
        match.match_tables(p, bad, "Batch ID", "batch", ["yield_percent"])


def test_name_collision(spark):
    p, q = tables(spark)
    with pytest.raises(InputError):
        match.match_tables(p.withColumnRenamed("temp", "yield_percent"), q, "Batch ID", "batch", ["yield_percent"])


def test_readiness(spark):
    p, q = tables(spark)
    rows = match.readiness_messages(p, q, "Batch ID", "batch", ["yield_percent"])
    assert {(r.severity, r.code) for r in rows.collect()} == {("warning", "low_overlap")}
    assert match.readiness_score(rows).first().score == 92
    early = match.readiness_messages(p, q, "nope", "batch", ["gone"])
    assert match.readiness_score(early).first().score == 30
    twice = match.readiness_messages(p.union(p), q, "Batch ID", "batch", ["yield_percent"])
    assert ("blocker", "process_duplicates") in {(r.severity, r.code) for r in twice.collect()}
