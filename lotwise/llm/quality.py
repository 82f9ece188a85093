"""Document quality by logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features are single words and pairs of neighbours, of the words themselves and of their shapes
(lower, capitalised, upper, digits, symbols, long), a pair of equal words being one feature of
its own, and the number of words on a log scale. They are hashed into ``2 ** BITS`` places; a
place's value is its share among the document's n-grams of its kind, so a score is a sparse dot
product that does not grow with length.

Training: a bounded sample of labelled documents is dealt over ``PARTS`` tasks by a hash of the
id; each runs ``EPOCHS`` passes of follow-the-regularised-leader updates (McMahan et al. 2013)
and returns its weights, which are averaged. Scoring reads whole texts, in place.

Rows: null and empty texts score as a document of no words; repeated rows each get a score; an
empty table gives an empty result; without labels every weight is zero and scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.arrays import Spans, byte_classes, mixed, slices, tokens, utf8

BITS = 18
PARTS = 4
EPOCHS = 4
SCALE = 16.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
_CLASSES = byte_classes(symbols=True)
_PLACE = np.uint64(64 - BITS)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A small number for each token: 0 lower, 1 capitalised, 2 upper, 3 with digits, 4 symbols; 8 more if long."""
    def counted(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[ends] - sums[starts]

    upper, digits = counted((data >= 65) & (data <= 90)), counted((data >= 48) & (data <= 57))
    lower = counted((data >= 97) & (data <= 122))
    shape = np.where(kinds == 2, 4, np.where(digits > 0, 3, np.where((upper > 1) & (lower == 0), 2, np.where(upper > 0, 1, 0))))
    return (shape + 8 * (ends - starts > 14)).astype(np.uint64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value), several entries of a place adding up."""
    starts, ends, kinds, rows = tokens(data, offsets, _CLASSES)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    size = np.floor(np.log2(n + 1)).astype(np.uint64)
    all_rows = np.arange(len(n))
    parts = [(all_rows, mixed(size + np.uint64(0x1001)), np.full(len(n), 1 / SCALE))]
    if len(rows):
        words, shape = Spans(data).hash(starts, ends), mixed(shapes(data, starts, ends, kinds) + np.uint64(0x2001))
        inner = rows[1:] == rows[:-1]
        share, pair_share = 1 / n[rows], 1 / n[rows[1:][inner]]
        for k, h in enumerate((words, shape)):
            left, right = h[:-1][inner], h[1:][inner]
            pair = mixed(left * np.uint64(0x9E3779B97F4A7C15) + right + np.uint64(0x3001 + k))
            if k == 0:
                pair = np.where(left == right, np.uint64(0x4001 << 40), pair)
            parts += [(rows, h, share), (rows[1:][inner], pair, pair_share)]
    row, h, value = (np.concatenate(x) for x in zip(*parts))
    return row, (h >> _PLACE).astype(np.int64), value * SCALE


def follow_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, size: int = 1 << BITS) -> np.ndarray:
    """Weights after FTRL-proximal updates over (places, values, label); the last place is the constant."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(5)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at, x, y = examples[k]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(size + 1))


def fit(sample: DataFrame, parts: int = PARTS) -> np.ndarray:
    """Averaged weights of FTRL over ``parts`` parts of a bounded sample (key, text, y)."""
    constant = 1 << BITS

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column(0))
            row, place, value = features(data, offsets)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(1, part.num_rows))
            for own, y in zip(np.split(order, cuts), part.column(1).to_pylist()):
                at, back = np.unique(place[own], return_inverse=True)
                x = np.bincount(back, weights=value[own])
                examples.append((np.append(at, constant), np.append(x, 1.0), y))
        if examples:
            w = follow_leader(examples).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([len(examples)], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["n", "w"])

    dealt = sample.repartition(parts, F.xxhash64("key")).sortWithinPartitions("key").select("text", "y")
    found = dealt.mapInArrow(train, "n long, w binary").collect()  # a row per part
    total = sum(r["n"] for r in found)
    mean = np.zeros(constant + 1)
    for r in found:
        mean += np.frombuffer(r["w"], np.float32) * (r["n"] / total)
    return mean.astype(np.float32)


def scored(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): the probability of label 1 for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for part in slices(batches, "text"):
            row, place, value = features(*utf8(part.column(1)))
            dot = np.bincount(row, weights=w[place] * value, minlength=part.num_rows) + w[-1]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], ["key", "score"])

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, score double")
