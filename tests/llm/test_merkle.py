"""The manifest against a plain tree, with small blocks, odd rows and tampering."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from lotwise.llm import merkle

SCHEMA = "doc_id long, text string, lang string, n int, levels string, suffix string, block string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fan):
    """Root, and for each leaf its siblings run by run."""
    proofs, spots, layer = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(layer) > 1:
        for k, s in enumerate(spots):
            run = range(s // fan * fan, min(len(layer), s // fan * fan + fan))
            proofs[k] += [layer[i] for i in run if i != s]
            spots[k] = s // fan
        layer = [sha(*layer[i:i + fan]) for i in range(0, len(layer), fan)]
    return layer[0], proofs


def plain(rows, fan):
    order = lambda v: (v is not None, v if v is not None else 0)
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (order(r[0]), leaf_of(r[:3])))
        trees[g] = own, *plain_tree([leaf_of(r[:3]) for r in own], fan)
    root, above = plain_tree([trees[g][1] for g in groups], fan)
    out = []
    for g, rest in zip(groups, above):
        own, subroot, proofs = trees[g]
        out += [(order(r[0]), leaf_of(r[:3]), subroot, root, tuple(p + rest)) for r, p in zip(own, proofs)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r[:3], 1, "l", "s", "b") for r in rows], SCHEMA).repartition(5)


def manifest(spark, rows, **options):
    df = frame(spark, rows)
    fields = [df["doc_id"], df["text"], df["lang"]]
    held = F.when(df["doc_id"] % 3 == 0, merkle.digest([df["doc_id"], F.lower(df["text"]), df["lang"]]))
    return merkle.manifest(df, fields, df["lang"], df["doc_id"], held=held, **options)


def check(spark, rows, fan, height):
    found = manifest(spark, rows, fan=fan, height=height).select(
        "*", merkle.siblings(F.col("proof")).alias("flat"), merkle.folded(F.col("leaf"), F.col("proof")).alias("back"),
        merkle.folded(F.coalesce("held", "leaf"), F.col("proof")).alias("tampered")).collect()
    order = lambda v: (v is not None, v if v is not None else 0)
    assert sorted((order(r["key"]), r["leaf"], r["subroot"], r["root"], tuple(r["flat"])) for r in found) == plain(rows, fan)
    assert all(r["back"] == r["root"] for r in found)
    for r in found:
        assert (r["tampered"] == r["root"]) == (r["held"] is None or r["held"] == r["leaf"])
    return found


@pytest.mark.parametrize("fan, height", [(2, 2), (3, 1), (8, 4)])
def test_manifest_equals_a_plain_tree(spark, fan, height):
    rows = [(i, f"Text {i}" * (i % 5), "abcde"[i * i % 5]) for i in range(150)]
    rows += [(i, "lower", "big") for i in range(500, 573)]  # 73: a last run of one node on several levels
    rows += [(None, "x", "a"), (None, "y", "a"), (3, None, None), (4, "", None), (9, "Lone", "z"), (11, "é\n" * 40, ""), (12, "É", "=")]
    rows += [(20, "same", "copies")] * 60 + [(20, "Other", "copies"), (21, "X" * 200_000, "copies")]
    found = check(spark, rows, fan, height)
    assert {r["key"] for r in found if r["group"] is None} == {3, 4}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_around_full_runs(spark, n):
    check(spark, [(i, f"T{i}", "en") for i in range(n)], 8, 1)


def test_every_row_its_own_group(spark):
    check(spark, [(i, "T", f"g{i:03}") for i in range(70)], 4, 1)


def test_no_rows(spark):
    assert manifest(spark, [(1, "a", "b")]).where("false").count() == 0
    df = frame(spark, [(1, "a", "b")]).where("doc_id > 5")
    assert merkle.manifest(df, [df["text"]], df["lang"], df["doc_id"]).count() == 0


def test_sweeps_of_one_block():
    leaves = [sha(str(i)) for i in range(23)]
    layers = merkle.forward(leaves, 3, 4)
    assert [len(x) for x in layers] == [23, 6, 2, 1]
    for i, proof in enumerate(merkle.backward(layers, [(9, ["top"])], 4)):
        own = leaves[i]
        for place, others in proof[:-1]:
            own = sha(*others[:place], own, *others[place:])
        assert own == layers[-1][0] and proof[-1] == (9, ["top"])
    assert list(itertools.chain(*merkle.backward([["a"]], [], 4))) == []
