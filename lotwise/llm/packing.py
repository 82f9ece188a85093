"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Documents are encoded once, where they lie; only pieces of (document, start, length, checksum)
move on. The histogram has a row per length, at most the sequence length. Best-fit decreasing
runs over its counts: bins with equal room are one range, and equal pieces go into whole ranges,
so the plan has few rows however many documents there are. Every piece then takes its slot by
its rank among the pieces of its length: ranks are counted per (length, bucket) and shifted by
the counts of the buckets before, so a length that many documents share is many small groups.

Rows: a null text is an empty text, which is the end id alone; repeated rows are packed each;
null keys stay null; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.arrays import Spans, slices, utf8
from lotwise.session import checkpoint

PROBES = 8
LEARNED_AT_ONCE = 4096  # a call of the tokenizer takes a few hundred bytes a word
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_KINDS = np.full(256, 3, np.uint8)  # 0 white space, 1 ASCII letters, 2 ASCII marks, 3 all else
_KINDS[[10, 32]] = 0
_KINDS[65:91] = _KINDS[97:123] = 1
_KINDS[list(MARKS.encode())] = 2
BUCKET_ROWS = 50_000
_encoders: dict[str, "Encoder"] = {}


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte and row of the parts of texts that are encoded on their own.

    Texts are parted at spaces and line feeds, and between an ASCII letter and an ASCII mark other
    than the apostrophe: no token of a vocabulary that parts words from marks reaches across.
    """
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    kinds = _KINDS[data]
    cut = np.empty(len(data), bool)
    cut[0] = True
    left, right = kinds[:-1], kinds[1:]
    np.logical_or((left == 0) != (right == 0), (left + right == 3) & (left != 0) & (right != 0), out=cut[1:])
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(data))
    real = kinds[at] > 0
    starts, ends = at[real], ends[real]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class WordTable:
    """Ids of words by 64-bit hash and length, in a table of bounded size that is emptied when full."""

    def __init__(self, bits: int = 21) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.most = (1 << bits) * 6 // 10
        self.clear()

    def clear(self) -> None:
        n = self.mask + 1
        self.keys, self.sizes = np.zeros(n, np.uint64), np.zeros(n, np.int32)
        self.first, self.count = np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.pool, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 for those not held."""
        slot = np.full(len(keys), -1)
        left, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        for _ in range(PROBES):
            same = (self.keys[at] == keys[left]) & (self.sizes[at] == sizes[left])
            slot[left[same]] = at[same]
            open_ = ~same & (self.sizes[at] > 0)  # a free slot ends the search
            left, at = left[open_], (at[open_] + 1) & self.mask
            if not len(left):
                break
        return slot

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Hold new words; ``ids`` are theirs one after another. A word without a free slot is not held."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.uint32)])
        self.pool[self.used:self.used + len(ids)] = ids
        first = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        left, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        for _ in range(PROBES):
            free = np.flatnonzero(self.sizes[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            put, word = at[free[one]], left[free[one]]
            self.keys[put], self.sizes[put] = keys[word], sizes[word]
            self.first[put], self.count[put] = first[word], counts[word]
            self.held += len(put)
            keep = np.ones(len(left), bool)
            keep[free[one]] = False
            left, at = left[keep], (at[keep] + 1) & self.mask
            if not len(left):
                break


class Encoder:
    """Ids of texts, word by word with a bounded memory of words.

    For vocabularies that compose, lower case and drop white space, and mark the ends of words.
    New words of letters, with or without marks after them, are encoded by one call and their ids
    parted at the ends of words; others, with digits or apostrophes, are encoded one by one.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # control strings inside texts are ordinary text
        tokens = self.tokenizer.get_vocab()
        self.last = np.zeros(max(tokens.values()) + 1, bool)
        self.last[[i for t, i in tokens.items() if t.endswith("</w>")]] = True
        self.table = WordTable()

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after another, and how many each has."""
        parts = np.array([1 if w.isalpha() else 2 if w.rstrip(MARKS).isalpha() else 0 for w in words], np.int64)
        easy, hard = np.flatnonzero(parts), np.flatnonzero(parts == 0)
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        if len(easy):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words[k] for k in easy)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == parts.sum():
                stops = ends[np.cumsum(parts[easy]) - 1].tolist()
                for k, i, j in zip(easy.tolist(), [0, *stops], stops):
                    found[k] = ids[i:j]
            else:
                hard = np.arange(len(words))
        for k, e in zip(hard.tolist(), self.tokenizer.encode_batch_fast([words[k] for k in hard], add_special_tokens=False)):
            found[k] = np.array(e.ids, np.uint32)
        return np.concatenate(found), np.array([len(f) for f in found], np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and where each row's begin."""
        if not ((data == 0xCC) | (data == 0xCD)).any():  # letters with marks of their own are composed first
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        starts, ends, rows = cut_words(data, offsets)
        keys, sizes = Spans(data).hash(starts, ends), (ends - starts).astype(np.int32)
        slot = self.table.find(keys, sizes)
        new = np.flatnonzero(slot < 0)
        extra_first, extra_count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        pool = self.table.pool
        if len(new):
            if self.table.held + len(new) > self.table.most:
                self.table.clear()
                new = np.arange(len(keys))
            _, one, back = np.unique(keys[new], return_index=True, return_inverse=True)
            chosen = new[one]
            raw = data.tobytes()
            found = [
                self.learn([raw[i:j].decode() for i, j in zip(starts[part].tolist(), ends[part].tolist())])
                for part in np.split(chosen, range(LEARNED_AT_ONCE, len(chosen), LEARNED_AT_ONCE))
            ]
            ids, counts = (np.concatenate(x) for x in zip(*found))
            self.table.add(keys[chosen], sizes[chosen], ids, counts)
            pool = np.concatenate([ids, self.table.pool[:self.table.used]])
            extra_first, extra_count = (np.cumsum(counts) - counts)[back], counts[back]
        old = np.ones(len(keys), bool)
        old[new] = False
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        shift = len(pool) - self.table.used if len(new) else 0
        first[old], count[old] = self.table.first[slot[old]] + shift, self.table.count[slot[old]]
        first[new], count[new] = extra_first, extra_count
        ends_at = np.cumsum(count)
        flat = pool[np.repeat(first - (ends_at - count), count) + np.arange(int(ends_at[-1]) if len(ends_at) else 0)]
        per_row = np.bincount(rows, weights=count, minlength=len(offsets) - 1).astype(np.int64)
        return flat, np.concatenate([[0], np.cumsum(per_row)])


def pieces(docs: DataFrame, vocabulary: str, most: int, end_id: int = 0, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): documents longer than ``most`` ids are cut."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        for part in slices(batches, "text"):
            rows: list[tuple] = []
            found, begins = _encoders[vocabulary].encode(*utf8(part.column(1)))
            flat, begins = found.astype("<u4").tobytes(), (4 * begins).tolist()
            for k, i, j in zip(part.column(0).to_pylist(), begins, begins[1:]):
                whole = flat[i:j] + end
                for n, at in enumerate(range(0, len(whole), 4 * most)):
                    cut = whole[at:at + 4 * most]
                    rows.append((k, n, at // 4, len(cut) // 4, zlib.crc32(cut), cut))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:5 + ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["key", "piece", "start", "length", "ids_crc32", "ids"][:5 + ids]
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def plan(histogram: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, rank_from, rank_to, first_sequence, per_sequence, offset).

    Rank r of a length, counted from rank_from as j, goes to first_sequence + j // per_sequence
    at offset + (j % per_sequence) * length.
    """
    rooms: list[int] = []  # sorted rooms that open ranges have
    ranges: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    rows, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, n = most, opened, -(-left // (most // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, most - room))
                put(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if left and n:  # fewer than a sequence takes are left
                rows.append((length, rank, rank + left, first, each, most - room))
                put(room - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return rows


def packed(docs: DataFrame, vocabulary: str, most: int = 2048, **options) -> DataFrame:
    """Pieces of ``docs`` with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = checkpoint(pieces(docs, vocabulary, most, **options))
    buckets = max(8, min(4096, cut.count() // BUCKET_ROWS))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)))
    cells = checkpoint(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = spark.createDataFrame(
        plan(histogram, most), "p_length long, rank_from long, rank_to long, first_sequence long, per_sequence long, base long"
    )
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = cells.select(F.col("length").alias("c_length"), F.col("bucket").alias("c_bucket"), ahead.alias("shift"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key", "piece")) - 1
    ranked = cut.withColumn("own", own).join(
        F.broadcast(shifts) if buckets * most <= 100_000 else shifts, (F.col("length") == F.col("c_length")) & (F.col("bucket") == F.col("c_bucket"))
    ).withColumn("rank", F.col("own") + F.col("shift"))
    # the plan is bounded by the lengths, not by the documents
    placed = ranked.join(F.broadcast(planned), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    place = F.col("rank") - F.col("rank_from")
    return placed.withColumn("sequence_id", F.col("first_sequence") + F.floor(place / F.col("per_sequence"))).withColumn(
        "offset", F.col("base") + (place % F.col("per_sequence")) * F.col("length")
    ).drop("bucket", "own", "c_length", "c_bucket", "shift", "rank", "p_length", "rank_from", "rank_to", "first_sequence", "per_sequence", "base")
