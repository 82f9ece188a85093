"""Near duplicates by SimHash: segment bit counts, a grid join on them, exact verification.

A fingerprint is cut into segments of two bits. Its embedding is the vector of the segments'
bit counts; the Manhattan distance of two vectors never exceeds the number of differing bits.
The counts are kept as thermometer codes (00, 01, 11), so that this distance is the number of
differing code bits. The grid: segments are dealt into groups; two vectors within the radius
agree in all but ``radius`` groups, so rows meet in the cells of every choice of the others.
Within a cell the Manhattan distance is tested first, then the fingerprints' bits.

Rows: a null text counts as empty; a text of fewer words than a shingle is one shingle; a text
of no words has fingerprint zero. Equal texts share one fingerprint, and cells hold distinct
fingerprints only. A cell of more than ``CELL`` fingerprints is cut into blocks, and every
pair of blocks is looked at by a task of its own. From a cell only a spanning forest leaves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.arrays import mixed, slices
from lotwise.llm.frames import components, small_or_not
from lotwise.session import checkpoint

CELL = 4096
MATRIX = 1024
SHINGLES_AT_ONCE = 1 << 15
SEED = 42


def bits_of(text: bytes, shingle: int, width: int) -> list[int]:
    """Majority bits over the XXH64 of all shingles, as unsigned 64-bit words.

    Words beyond the first come from a mix of the same hash with the word's number.
    """
    words = text.lower().split()
    if not words:
        return [0] * width
    flat, n = b" ".join(words), max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts, stops = (ends - lengths)[:n].tolist(), (ends - 1)[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((width, 64), np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        h = np.array([digest(flat[i:j], SEED) for i, j in zip(starts[at:at + SHINGLES_AT_ONCE], stops[at:at + SHINGLES_AT_ONCE])], np.uint64)
        for k in range(width):
            own = h if k == 0 else mixed(h + np.uint64(k))
            ones[k] += np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > n, axis=1)
    return [int.from_bytes(packed[k].tobytes(), "big") for k in range(width)]


def fingerprints(docs: DataFrame, shingle: int = 4, width: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, copy, f0, f1, ...): one row per row of ``docs``, fingerprint words as signed longs.

    ``copy`` is a hash of the text, so that different rows of one key stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [bits_of((t or "").encode(), shingle, width) for t in part.column(2).to_pylist()]
            words = np.array(found, np.uint64).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(words[:, k].copy()) for k in range(width))], names)

    names = ["key", "copy", *(f"f{k}" for k in range(width))]
    body = docs[text].cast("string")
    rows = docs.select(docs[key].cast("long").alias("key"), F.xxhash64(body).alias("copy"), body.alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def thermometer(x: np.ndarray) -> np.ndarray:
    """Counts of the two-bit segments of unsigned words, as 00, 01 or 11."""
    low = np.uint64(0x5555555555555555)
    a, b = x & low, (x >> np.uint64(1)) & low
    return (a | b) | ((a & b) << np.uint64(1))


def grid(rows: int, radius: int, width: int, recall: float | None = None, similarity: float = 0.8) -> list[list[int]]:
    """Masks over the thermometer code, one list of ``width`` words for each table.

    Without ``recall`` the tables are complete: any two fingerprints within ``radius`` share
    the cell of a table. There are groups enough that unrelated fingerprints rarely meet.
    With ``recall`` a table is a fixed random choice of segments, as many tables as find a pair
    of documents of that ``similarity`` (Jaccard) with that probability.
    """
    segments = 32 * width
    bits = math.log2(16 / 6)  # of information in the count of a random segment
    wanted = max(1.0, math.log2(max(rows, 2) / (8 if recall is None else 128)))
    if recall is None:
        groups = next((g for g in range(radius + 1, radius + 5) if bits * segments * (g - radius) / g >= wanted), radius + 4)
        members = [range(segments)[g::groups] for g in range(groups)]
        chosen = [[s for g in c for s in members[g]] for c in itertools.combinations(range(groups), groups - radius)]
    else:
        cosine = 2 * similarity / (1 + similarity)
        same = 1 - math.acos(cosine) / math.pi
        equal = same**2 + (1 - same) ** 2 / 2
        size = min(segments, math.ceil(wanted / bits))
        count = math.ceil(math.log(1 - recall) / math.log(1 - equal**size))
        draw = np.random.default_rng(20)
        chosen = [sorted(draw.choice(segments, size, replace=False).tolist()) for _ in range(count)]
    masks = []
    for table in chosen:
        words = [0] * width
        for s in table:
            words[s // 32] |= 3 << (2 * (s % 32))
        masks.append(words)
    return masks


def forest(found: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (row numbers) of a spanning forest of the rows within ``radius``, for a cell.

    Rows not yet reached are compared with one reached row at a time, so a dense cell costs
    few comparisons: its first row reaches most others.
    """
    codes = thermometer(found)
    left = np.arange(len(found))
    links: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            near = np.bitwise_count(codes[left] ^ codes[p]).sum(axis=1) <= radius
            if near.any():
                maybe = np.flatnonzero(near)
                real = np.bitwise_count(found[left[maybe]] ^ found[p]).sum(axis=1) <= radius
                reached = left[maybe[real]]
                links += [(p, q) for q in reached.tolist()]
                queue += reached.tolist()
                keep = np.ones(len(left), bool)
                keep[maybe[real]] = False
                left = left[keep]
    return links


def cell_pairs(words: np.ndarray, codes: np.ndarray, radius: int) -> np.ndarray:
    """Links of one cell: all of them while they are few, else a spanning forest."""
    n = len(words)
    if n <= MATRIX:
        near = sum(np.bitwise_count(codes[:, None, k] ^ codes[None, :, k]).astype(np.uint8) for k in range(codes.shape[1]))
        a, b = np.nonzero(np.triu(near <= radius, 1))
        if len(a) <= 8 * n:
            real = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= radius
            return np.stack([a[real], b[real]], axis=1)
    return np.array(forest(words, radius), np.int64).reshape(-1, 2)


def cell_links(batches: Iterator[pa.RecordBatch], radius: int, width: int) -> Iterator[pa.RecordBatch]:
    """Links of all cells of a sorted partition (cell, part, fid, words); a cell may span batches."""
    kept: list[np.ndarray] | None = None

    def solve(columns: list[np.ndarray]) -> pa.RecordBatch:
        cell, part, fid, words = columns
        cut = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(cell))
        codes, a, b = thermometer(words), [], []
        sizes = ends - starts
        for n in range(2, 9):  # small cells of one size at once
            rows = starts[sizes == n]
            for i, j in itertools.combinations(range(n), 2) if len(rows) else ():
                near = rows[np.bitwise_count(codes[rows + i] ^ codes[rows + j]).sum(axis=1) <= radius]
                near = near[np.bitwise_count(words[near + i] ^ words[near + j]).sum(axis=1) <= radius]
                a.append(fid[near + i])
                b.append(fid[near + j])
        for k in np.flatnonzero(sizes > 8):
            pairs = cell_pairs(words[starts[k]:ends[k]], codes[starts[k]:ends[k]], radius) + starts[k]
            a.append(fid[pairs[:, 0]])
            b.append(fid[pairs[:, 1]])
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        words = np.stack([batch.column(3 + k).to_numpy(zero_copy_only=False) for k in range(width)], axis=1).view(np.uint64)
        now.append(words)
        kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
        cell, part = kept[0], kept[1]
        change = np.flatnonzero((cell != cell[-1]) | (part != part[-1]))
        if len(change):
            done = change[-1] + 1
            yield solve([x[:done] for x in kept])
            kept = [x[done:] for x in kept]
    if kept is not None:
        yield solve(kept)


def links(distinct: DataFrame, radius: int, width: int, masks: list[list[int]], cell: int = CELL) -> DataFrame:
    """Links (a, b) between the ``fid`` of distinct fingerprints, enough to join all that are near."""
    low = F.lit(0x5555555555555555)
    codes = []
    for k in range(width):
        even, odd = F.col(f"f{k}").bitwiseAND(low), F.shiftrightunsigned(F.col(f"f{k}"), 1).bitwiseAND(low)
        codes.append(even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1)).alias(f"c{k}"))
    coded = distinct.select("fid", *(f"f{k}" for k in range(width)), *codes)
    signed = [[w - (1 << 64) if w >> 63 else w for w in m] for m in masks]
    cells = F.array(*(
        F.xxhash64(F.lit(n), *(F.col(f"c{k}").bitwiseAND(F.lit(w)) for k, w in enumerate(m))) for n, m in enumerate(signed)
    ))
    rows = coded.select(F.explode(cells).alias("cell"), "fid", *(f"f{k}" for k in range(width)))
    crowded = checkpoint(rows.groupBy("cell").count().where(F.col("count") > cell))
    if crowded.isEmpty():
        dealt = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        blocks = F.ceil(F.coalesce("count", F.lit(0)) / cell).cast("long")
        own = F.when(blocks > 1, F.pmod(F.xxhash64("fid"), blocks)).otherwise(F.lit(0).cast("long"))
        dealt = rows.join(small_or_not(crowded), "cell", "left").withColumn("own", own).withColumn("blocks", F.greatest(blocks, F.lit(1))).withColumn(
            "part", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(o, F.col("own")) * 1_000_003 + F.greatest(o, F.col("own"))))
        )
    ready = dealt.select("cell", "part", "fid", *(f"f{k}" for k in range(width))).repartition("cell", "part").sortWithinPartitions("cell", "part", "fid")
    return ready.mapInArrow(lambda batches: cell_links(batches, radius, width), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, width: int = 1, recall: float | None = None,
    similarity: float = 0.8, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, copy, f0.., root, component): ``component`` is the smallest key reachable over links.

    ``root`` names the class; two classes have one component where rows of one key differ.

    ``radius`` is the most bits of ``64 * width`` that linked fingerprints differ in. See
    ``grid`` for ``recall``. Rows with a null key have a fingerprint and take part, but a null
    key is never the smallest unless its component has no other.
    """
    words = [f"f{k}" for k in range(width)]
    marked = checkpoint(fingerprints(docs, shingle, width, key, text))
    distinct = marked.groupBy(*words).agg(F.min("key").alias("first"))
    distinct = checkpoint(distinct.select("first", *words, (F.col("f0") if width == 1 else F.xxhash64(*words)).alias("fid")))
    masks = grid(distinct.count(), radius, width, recall, similarity)
    roots = components(links(distinct, radius, width, masks))
    joined = distinct.join(roots, distinct["fid"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fid"))
    # held on its own, so that the join on a large component's root can be split
    smallest = checkpoint(joined.where("node IS NOT NULL").groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least")))
    classes = joined.join(small_or_not(smallest), F.col("root") == F.col("r"), "left").select(
        *words, "root", F.coalesce("least", "first").alias("component")
    )
    return marked.join(classes, words)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class of near duplicates: that of the smallest key.

    Rows without a key stay. Rows equal in key and text are one document, and one of them stays.
    Rows of one key with other texts are other documents, each judged by its own class; of those
    in one class the one of the smallest text hash stays.
    """
    marked = checkpoint(near_duplicates(docs, key=key, text=text, **options).select("key", "copy", "root", "component"))
    first = marked.where("key = component").select("root", "key", "copy").distinct()
    least = first.groupBy(F.col("root").alias("r")).agg(F.min("copy").alias("least"), F.count("*").alias("n")).where("n > 1")
    more = first.join(small_or_not(checkpoint(least)), F.col("root") == F.col("r")).where("copy <> least")
    gone = marked.where("key <> component").select("key", "copy").union(more.select("key", "copy"))
    gone = checkpoint(gone.select(F.col("key").alias("gone"), F.col("copy").alias("gone_copy")).distinct())
    repeated = checkpoint(marked.groupBy("key").count().where("key IS NOT NULL AND count > 1").select(F.col("key").alias("again")))
    gone = small_or_not(gone)
    own = (docs[key].cast("long") == gone["gone"]) & (F.xxhash64(docs[text].cast("string")) == gone["gone_copy"])
    kept = docs.join(gone, own, "left_anti")
    if repeated.isEmpty():
        return kept
    few = small_or_not(repeated)
    twice = kept[key].cast("long") == few["again"]
    return kept.join(few, twice, "left_anti").unionByName(kept.join(few, twice, "left_semi").dropDuplicates([key, text]))
