"""Toxicity by a weighted finite-state grammar over the clauses of a text.

Words are read as classes: insult, threat, target, negation, reported speech. Marks end a
sentence, or a clause within it (comma, colon). Three transducers are composed into one table:
negation marks insults and threats that follow it in its clause, and reaches over an aside
("not, in any way, an ..."); reported speech marks them up to the sentence's end, so over commas,
colons and quotes ("she said: ..."); the clause transducer turns what it has read into one clause
kind at the clause's end (insult or threat; negated, reported; aimed at a target or not). A short
clause of report after a clause ("..., he wrote", "...!' he said") is read from right to left
first: the end before it becomes a reported end, which marks the clause it closes. A document's features are the weights of its matched clauses by kind, and a logistic
model over the kinds gives the score; a word outside any matched clause adds nothing.

Learning, from a bounded sample of labelled documents: insult words and stems (leading bytes of
words) are those whose presence tells the label, with their log odds as weight, counted by a
Spark aggregation; then the kinds' weights are fitted, starting from the values below.

Rows: null and empty texts have no clause and score low; repeated rows each get a score; an empty
table gives an empty result; without labels the fixed words and starting weights are used.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.arrays import Spans, byte_classes, lowered, mixed, slices, tokens, utf8

# Words of the closed classes in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting clown imbecile bastard pig idiotin trottel dumm abschaum connard crétin imbécile idiota estúpido basura".split()
THREATS = "kill hurt murder destroy shoot stab strangle smash beat töten umbringen schlagen erschießen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself u he she they them those these people du dich dir euch ihr sie tu toi te vous ils elles tú ti usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never none neither nor nicht kein keine keinen nie ne pas jamais aucun aucune nunca jamás nadie ningún".split()
REPORTS = "said says told wrote called claimed quoted sagte sagt schrieb nannte dit disait écrit selon dijo dice escribió según".split()

SYMBOLS = ["other", "insult", "threat", "target", "negation", "report", "end", "end'", "pause", "pause'", "aside"]
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, END_REPORTED, PAUSE, PAUSE_REPORTED, ASIDE = range(len(SYMBOLS))
TRAILING_WORDS = 5  # a clause of report after speech is this long at most
STEMS = (4, 5, 6, 8, 12)
LEAST_SHARE, LEAST_DOCS, PRECISION = 0.01, 4, 0.9
_CLASSES = byte_classes(symbols=True)
_CLASSES[10] = 2  # a line feed ends a clause
_ENDS, _PAUSES, _QUOTES = np.zeros((3, 256), bool)
_ENDS[[10, *b".!?;"]] = True
_PAUSES[[*b",:"]] = True
_QUOTES[[*b"\"'"]] = True


class Transducer:
    """Deterministic: (state, symbol) -> (state, output); what is not listed stays and passes through."""

    def __init__(self, start, arcs: dict) -> None:
        self.start, self.arcs = start, arcs

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def marking(trigger: str, mark: str, marks: list[str], stops: list[str], asides: bool = False) -> Transducer:
    """Adds ``mark`` to the symbols ``marks`` between ``trigger`` and one of ``stops``; asides are stepped over."""
    arcs = {("out", trigger): ("in", trigger)} | {(s, x): ("out", x) for s in ("in", "over") for x in stops}
    if asides:
        arcs |= {("in", "aside"): ("over", "other"), ("over", "pause"): ("in", "other")}
    return Transducer("out", arcs | {("in", m): ("in", m + mark) for m in marks})


def clause(hits: list[str]) -> Transducer:
    """Keeps the plainest hit of a clause and whether a target was named; tells the kind at the end."""
    arcs = {}
    for held, aimed in itertools.product(["", *hits], [False, True]):
        arcs[(held, aimed), "target"] = ((held, True), "target")
        for end in ("end", "pause", "end'", "pause'"):
            report = "'" if end.endswith("'") and not held.endswith("'") else ""
            arcs[(held, aimed), end] = (("", False), held + report + "@" * aimed if held else end)
        for h in hits:
            arcs[(held, aimed), h] = ((min([x for x in (held, h) if x], key=lambda x: (len(x), x)), aimed), h)
    return Transducer(("", False), arcs)


def composed() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The three transducers as one: next state and output kind by (state, class), and the kinds."""
    plain = ["insult", "threat"]
    negated = plain + [p + "-" for p in plain]
    hits = negated + [p + "'" for p in negated]
    ends = ["end", "end'"]
    chain = [
        marking("negation", "-", plain, [*ends, "pause", "pause'"], asides=True),
        marking("report", "'", negated, ends), clause(hits),
    ]
    kinds = [h + a for h in hits for a in ("", "@")]
    first = tuple(t.start for t in chain)
    states, table = [first], {}
    for state in states:
        for c, name in enumerate(SYMBOLS):
            out, after = name, []
            for t, s in zip(chain, state):
                s, out = t.step(s, out)
                after.append(s)
            table[state, c] = (tuple(after), kinds.index(out) if out in kinds else -1)
            if tuple(after) not in states:
                states.append(tuple(after))
    number = {s: k for k, s in enumerate(states)}
    follow = np.array([[number[table[s, c][0]] for c in range(len(SYMBOLS))] for s in states])
    output = np.array([[table[s, c][1] for c in range(len(SYMBOLS))] for s in states])
    return follow, output, kinds


FOLLOW, OUTPUT, KINDS = composed()
_FOLLOW, _OUTPUT = FOLLOW.tolist(), OUTPUT.tolist()


def starting_weights() -> np.ndarray:
    """Constant, then a weight for every kind: less if negated or reported, more if aimed."""
    per = [4.0 * (0.4 if "-" in k else 1) * (0.6 if "'" in k else 1) * (1.2 if "@" in k else 1) for k in KINDS]
    return np.array([-2.5, *per])


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Spans(data).hash(np.array([0]), np.array([len(data)]))[0])


def stem_hashes(spans: Spans, starts: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words longer than ``k`` bytes, and hashes of their first ``k`` bytes told apart from words."""
    long = np.flatnonzero(ends - starts > k)
    return long, mixed(spans.hash(starts[long], starts[long] + k) + np.uint64(k))


class Lexicon:
    """Weights of insults by hash of word or stem, and the closed classes."""

    def __init__(self, learned: dict[int, float]) -> None:
        words = {word_hash(w): 1.0 for w in INSULTS} | learned
        self.hashes = np.array(sorted(words), np.uint64)
        self.weights = np.array([words[int(h)] for h in self.hashes])
        closed = {word_hash(w): c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.closed = np.array(sorted(closed), np.uint64)
        self.classes = np.array([closed[int(h)] for h in self.closed], np.int64)

    def insult(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.weights[at], 0.0)

    def classify(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.closed, h), len(self.closed) - 1)
        return np.where(self.closed[at] == h, self.classes[at], OTHER)


def with_ends(
    small: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, word: np.ndarray, classes: np.ndarray,
) -> np.ndarray:
    """The symbols with the marks read as ends, pauses and asides, and with reported ends."""
    def holds(table: np.ndarray) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(table[small])])
        return ~word & (seen[ends] > seen[starts])

    classes = classes.copy()
    classes[holds(_PAUSES)] = PAUSE
    classes[holds(_ENDS)] = END
    closes = classes >= END
    fresh = np.concatenate([[True], closes[:-1] | (rows[1:] != rows[:-1])])  # first token of a clause
    # a pause right after a negation opens an aside, unless the negation is all of its clause ("no, ...")
    if len(rows) > 2:
        aside = (classes[2:] == PAUSE) & (classes[1:-1] == NEGATION) & ~fresh[2:] & ~fresh[1:-1]
        classes[2:][aside] = ASIDE
    number = np.cumsum(fresh) - 1
    hit = (classes == INSULT) | (classes == THREAT)
    words, hits, reports = (np.bincount(number, weights=x, minlength=number[-1] + 1) for x in (word, hit, classes == REPORT))
    trailing = (reports > 0) & (hits == 0) & (words <= TRAILING_WORDS)
    last = np.flatnonzero(np.concatenate([fresh[1:], [False]]))  # last token of every clause but the last
    before = trailing[1:] & (rows[last] == rows[last + 1])
    quoted = holds(_QUOTES)
    paused, ended = last[before & (classes[last] == PAUSE)], last[before & (classes[last] == END) & quoted[last]]
    classes[paused], classes[ended] = PAUSE_REPORTED, END_REPORTED
    return classes


def clause_features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(rows, kinds): for each kind, log(1 + summed weights of the clauses of that kind)."""
    found = np.zeros((len(offsets) - 1, len(KINDS)))
    small = lowered(data)
    starts, ends, kinds, rows = tokens(small, offsets, _CLASSES)
    if not len(rows):
        return found
    spans = Spans(small)
    h = spans.hash(starts, ends)
    weight = lexicon.insult(h)
    for k in STEMS:
        long, stems = stem_hashes(spans, starts, ends, k)
        weight[long] = np.maximum(weight[long], lexicon.insult(stems))
    word = kinds == 1
    classes = np.where(word, lexicon.classify(h), OTHER)
    classes[word & (weight > 0)] = INSULT
    classes = with_ends(small, starts, ends, rows, word, classes)
    closes = (classes == END) | (classes == END_REPORTED)
    hit = (classes == INSULT) | (classes == THREAT)
    # sentences are numbered by ends and rows; only those with a hit are read
    number = np.cumsum(np.concatenate([[0], closes[:-1] | (rows[1:] != rows[:-1])]))
    read = np.zeros(int(number[-1]) + 1, bool)
    read[number[hit]] = True
    chosen = np.flatnonzero(read[number] & (classes != OTHER))
    state, total = 0, 0.0
    names = number[chosen].tolist()
    for c, w, own, row, after in zip(classes[chosen].tolist(), weight[chosen].tolist(), names, rows[chosen].tolist(), [*names[1:], -1]):
        total += w if c == INSULT else 1.0 if c == THREAT else 0.0
        for symbol in (c,) if after == own else (c, END):  # a text may end without a mark
            kind, state = _OUTPUT[state][symbol], _FOLLOW[state][symbol]
            if symbol >= END and kind >= 0:  # hits pass through and are told at the end
                found[row, kind] += total
                total = 0.0
    return np.log1p(found)


def learned_insults(sample: DataFrame) -> dict[int, float]:
    """Words and stems whose presence tells label 1 in a bounded sample (key, text, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column(1))
            y = part.column(2).to_numpy(zero_copy_only=False)
            small = lowered(data)
            starts, ends, kinds, rows = tokens(small, offsets, _CLASSES)
            starts, ends, rows = starts[kinds == 1], ends[kinds == 1], rows[kinds == 1]
            spans = Spans(small)
            all_h, all_rows = [spans.hash(starts, ends)], [rows]
            for k in STEMS:
                long, stems = stem_hashes(spans, starts, ends, k)
                all_h.append(stems)
                all_rows.append(rows[long])
            h, r = np.concatenate(all_h), np.concatenate(all_rows)
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r = h[fresh], r[fresh]
            own, at = np.unique(h, return_inverse=True)
            toxic = np.bincount(at, weights=y[r], minlength=len(own)).astype(np.int64)
            n = np.bincount(at, minlength=len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n), pa.array(toxic)], ["h", "n", "toxic"])

    rows, positives = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not positives:
        return {}
    need = max(LEAST_DOCS, int(LEAST_SHARE * positives))
    counted = sample.mapInArrow(count, "h long, n long, toxic long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    # few: each of them is in a hundredth of the positive texts
    kept = counted.where((F.col("toxic") >= need) & (F.col("toxic") >= PRECISION * F.col("n"))).collect()
    clean = max(1, rows - positives)
    odds = {r["h"] % (1 << 64): np.log((r["toxic"] + 0.5) / (positives + 1)) - np.log((r["n"] - r["toxic"] + 0.5) / (clean + 1)) for r in kept}
    return {h: float(np.clip(o / 4, 0.1, 1.5)) for h, o in odds.items()}


def fit_kinds(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, prior: float = 0.01) -> np.ndarray:
    """Logistic weights by gradient steps from the starting weights, held near them where data are few."""
    start = starting_weights()
    w, n = start.copy(), len(y)
    if not n:
        return w
    ones = np.concatenate([np.ones((n, 1)), x], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ones @ w, -35, 35)))
        w -= rate * (ones.T @ (p - y) / n + prior * (w - start) / len(w))
    return w


def model(sample: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and kind weights from a bounded sample (key, text, y); its features are a few numbers a row."""
    lexicon = Lexicon(learned_insults(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = clause_features(*utf8(part.column(1)), lexicon).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array([row.tobytes() for row in x], pa.binary())], ["y", "x"])

    rows = sample.mapInArrow(run, "y int, x binary").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float).reshape(-1, len(KINDS))
    return lexicon, fit_kinds(x, np.array([r["y"] for r in rows], float))


def scored(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, clauses): probability of label 1, and how many kinds of clause were matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = clause_features(*utf8(part.column(1)), lexicon)
            score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((x > 0).sum(axis=1))], ["key", "score", "clauses"])

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, score double, clauses long")
