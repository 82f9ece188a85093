"""Benchmark passages inside documents, edited ones included: CGK embedding, bit sampling, exact check.

Words are runs of letters and digits in lower case. An item of n words is held by a document if
a stretch of the document is within ``n - ceil(similarity * n)`` word edits of it.

1. Windows. By the q-gram lemma such a stretch shares at least ``n - 2 - 3 * edits`` three-word
   grams with the item, at starts within ``edits`` of each other's place. Item-sized windows are
   laid at every start near places where that many grams meet; no other start can hold the item.
2. Embedding. CGK (Chakraborty, Goldenberg, Koucky 2016): a walk over the window outputs its
   current word ``3 n`` times and moves on by a random bit of (step, word), so that few edits
   become few differing outputs. ``TABLES`` walks are independent.
3. Bit sampling. Each table compares ``SAMPLED`` outputs of its walk; a window goes on if it
   agrees with the item in any table. With these numbers stretches at the limit are found with
   a probability above 0.99 (measured in the tests), others with more.
4. Verification. The least word edit distance of the item to any stretch near the window.

The benchmark is read in blocks of ``BLOCK`` items, each block is sent to all tasks, and the
documents are read once per block without a shuffle; the number of items has no other bound.

Rows: null texts hold nothing; items of fewer than ``LEAST_WORDS`` words are not searched for, as
they occur by chance; repeated items and rows are each reported; null ids stay null; an empty
benchmark or table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.arrays import Spans, byte_classes, lowered, mixed, slices, tokens, utf8

SIMILARITY = 0.8
LEAST_WORDS = 6
GRAM = 3
TABLES = 48
SAMPLED = 3
BLOCK = 5_000
FILTER_BITS = 22
_CLASSES = byte_classes(symbols=False)


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Hash, first byte, last byte and row of every word."""
    small = lowered(data)
    # spaces and dashes of general punctuation and Latin-1 signs divide words as well
    small = small.copy()
    if len(small) > 1:
        sign = np.flatnonzero((small[:-1] == 0xC2) & (small[1:] < 0xC0))
        small[sign] = small[sign + 1] = 32
    if len(small) > 2:
        mark = np.flatnonzero((small[:-2] == 0xE2) & (small[1:-1] <= 0x81) & (small[1:-1] >= 0x80))
        small[mark] = small[mark + 1] = small[mark + 2] = 32
    starts, ends, _, rows = tokens(small, offsets, _CLASSES)
    return Spans(small).hash(starts, ends), starts, ends, rows


def grams_of(words: np.ndarray) -> np.ndarray:
    a, b, c = words[:-2], words[1:-1], words[2:]
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + mixed(b + np.uint64(7)) * np.uint64(31) + mixed(c + np.uint64(11)) * np.uint64(961))


class Walks:
    """``TABLES`` CGK walks and the outputs that each table samples, for windows of one length."""

    def __init__(self, n: int) -> None:
        draw = np.random.default_rng([7, n])
        self.n, self.steps = n, 3 * n
        self.seeds = draw.integers(1, 1 << 63, (self.steps, TABLES), dtype=np.uint64)
        # outputs beyond the words themselves are padding; sample where walks still are inside
        self.sampled = np.stack([np.sort(draw.choice(2 * n, SAMPLED, replace=False)) for _ in range(TABLES)])

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows, TABLES) keys of the sampled outputs; ``windows`` is padded with zeros."""
        m = len(windows)
        padded = np.concatenate([windows, np.zeros((m, 1), np.uint64)], axis=1)
        at = np.zeros((m, TABLES), np.int64)
        rows = np.arange(m)[:, None]
        keys = np.zeros((m, TABLES), np.uint64)
        for j in range(int(self.sampled.max()) + 1):
            out = padded[rows, at]
            now = (self.sampled == j).any(axis=1)
            if now.any():
                keys[:, now] = mixed(keys[:, now] * np.uint64(31) + out[:, now])
            at = np.minimum(at + (mixed(out ^ self.seeds[j]) >> np.uint64(63)).astype(np.int64), self.n)
        return keys


def least_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Word edit distance of ``item`` to its nearest stretch of ``region``, and the stretch."""
    m = len(region)
    steps = np.arange(m + 1)
    row, begin = np.zeros(m + 1, np.int64), steps.copy()
    for i, w in enumerate(item):
        kept = np.concatenate([[i + 1], row[:-1] + (region != w)])
        up = row + 1
        best = np.minimum(kept, up)
        from_up = up < kept
        start = np.where(from_up, begin, np.concatenate([[0], begin[:-1]]))
        reach = np.minimum.accumulate(best - steps)
        # where skipping words of the region is cheaper, the stretch begins where that path began
        source = np.maximum.accumulate(np.where(best - steps == reach, steps, 0))
        row, begin = reach + steps, start[source]
    stop = int(np.argmin(row))
    return int(row[stop]), int(begin[stop]), stop


class Index:
    """A block of items: their words, grams, walks and table keys."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float = SIMILARITY) -> None:
        self.ids, self.words, self.edits = [], [], []
        for item_id, text in items:
            column = pa.array([text or ""], pa.string())
            w = words_of(*utf8(column))[0]
            if len(w) >= LEAST_WORDS:
                self.ids.append(item_id)
                self.words.append(w)
                self.edits.append(len(w) - math.ceil(similarity * len(w) - 1e-9))
        lengths = [len(w) for w in self.words]
        self.lengths, self.edits = np.array(lengths, np.int64), np.array(self.edits, np.int64)
        self.walks = {n: Walks(n) for n in set(lengths)}
        self.keys = [self.walks[len(w)].keys(w[None, :])[0] for w in self.words]
        none = np.zeros(0, np.uint64)
        grams = np.concatenate([none, *(grams_of(w) for w in self.words)])
        item = np.concatenate([np.zeros(0, np.int64), *(np.full(n - 2, i) for i, n in enumerate(lengths))])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(n - 2) for n in lengths)])
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], item[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.grams >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, first byte, last byte, distance, words) of every item held, row by row."""
        words, starts, ends, rows = words_of(data, offsets)
        if len(words) < GRAM or not len(self.grams):
            return []
        grams = grams_of(words)
        maybe = np.flatnonzero(self.filter[grams >> np.uint64(64 - FILTER_BITS)] & (rows[:-2] == rows[2:]))
        lo, hi = np.searchsorted(self.grams, grams[maybe], "left"), np.searchsorted(self.grams, grams[maybe], "right")
        counts = hi - lo
        at = np.repeat(maybe, counts)
        if not len(at):
            return []
        entry = np.repeat(lo, counts) + np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        item, start = self.item[entry], at - self.place[entry]
        row = rows[at]
        order = np.lexsort((start, row, item))
        item, start, row = item[order], start[order], row[order]
        span = 1 << 40
        _, group = np.unique(item * (int(rows[-1]) + 1) + row, return_inverse=True)
        line = group.astype(np.int64) * span + start + (1 << 20)
        edits = self.edits[item]
        enough = self.lengths[item] - 2 - GRAM * edits
        many = np.searchsorted(line, line + 2 * edits, "right") - np.arange(len(line)) >= enough
        hits = np.flatnonzero(many)
        if not len(hits):
            return []
        cut = np.flatnonzero((group[hits][1:] != group[hits][:-1]) | (start[hits][1:] - start[hits][:-1] > self.lengths[item[hits]][1:])) + 1
        row_first, row_last = np.searchsorted(rows, np.arange(len(offsets) - 1), "left"), np.searchsorted(rows, np.arange(len(offsets) - 1), "right")
        found = []
        for part in np.split(hits, cut):
            i, r = int(item[part[0]]), int(row[part[0]])
            n, k = int(self.lengths[i]), int(self.edits[i])
            first, last = int(row_first[r]), int(row_last[r])
            lo_start, hi_start = max(first, int(start[part[0]]) - k), min(last - 1, int(start[part[-1]]) + 2 * k)
            places = np.arange(lo_start, max(hi_start, lo_start) + 1)
            inside = places[:, None] + np.arange(n)
            windows = np.where(inside < last, words[np.minimum(inside, last - 1)], np.uint64(0))
            if not (self.walks[n].keys(windows) == self.keys[i]).any():
                continue
            a, b = max(first, lo_start - k), min(last, hi_start + n + 2 * k)
            distance, s, e = least_distance(self.words[i], words[a:b])
            if distance <= k and e > s:
                found.append((r, i, int(starts[a + s]), int(ends[a + e - 1]), distance, n))
        return found


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block: int = BLOCK) -> Iterator[Index]:
    """The benchmark in blocks of about ``block`` items."""
    rows = benchmark.select(benchmark[item_id].cast("long").alias("id"), benchmark[text].cast("string").alias("text"))
    count = max(1, -(-rows.count() // block))
    for b in range(count):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == b)
        yield Index([(r["id"], r["text"]) for r in own.collect()])  # a block at a time


def code_points(data: np.ndarray, start: int, stop: int) -> int:
    return int(np.count_nonzero((data[start:stop] & 0xC0) != 0x80))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, start, stop, distance, n_words): the stretches, in code points of the text."""
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))

    def search(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                data, offsets = utf8(part.column(1))
                keys, out = part.column(0), []
                for r, i, start, stop, distance, n in index.find(data, offsets):
                    begin = code_points(data, offsets[r], start)
                    out.append((keys[r].as_py(), index.ids[i], begin, begin + code_points(data, start, stop), distance, n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

        return run

    names = ["key", "item_id", "start", "stop", "distance", "n_words"]
    found = None
    for index in blocks(benchmark):
        one = rows.mapInArrow(search(index), ", ".join(f"{c} long" for c in names))
        found = one if found is None else found.union(one)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; no shuffle."""

    def keep(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                column = part.column(part.schema.get_field_index(text))
                good = np.ones(part.num_rows, bool)
                good[[f[0] for f in index.find(*utf8(column))]] = False
                yield part.filter(pa.array(good))

        return run

    for index in blocks(benchmark):
        docs = docs.mapInArrow(keep(index), docs.schema)
    return docs
