"""Quality rules whose limits follow the corpus: quantile sketches per language and source.

Counts are taken from the whole text, words being runs without ASCII white space. The limits
come from one pass that merges a Greenwald-Khanna sketch per (language, source) and measure;
a second pass counts again and compares, so no text is stored or shuffled in between.

Measures: symbols per word character, characters per word, repeated lines per line, words in
repeated windows per word, and the share of capitals. A measure is out of bounds beyond the
upper quartile plus three times the spread of the quartiles; the spread has a floor, so that a
source whose documents are all alike does not reject on small differences, and a ceiling, so
that a source that is largely junk cannot widen its own limits. Groups of fewer than
``LEAST_ROWS`` documents use the limits of their language, and small languages those of all.

Rows: a null text has no words and fails the base rule; null languages and sources are groups
of their own; repeated rows each get a verdict; an empty table gives an empty result.
Everything is built from Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.frames import small_or_not
from lotwise.session import checkpoint

LEAST_ROWS = 50
ACCURACY = 10_000
FENCE = 3.0
WINDOW = 5
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
# measure: (floor, ceiling) of the quartiles' spread
SPREADS = {"symbol_share": (0.02, 0.03), "chars_per_word": (0.8, 1.5), "dup_line_share": (0.2, 0.2), "capital_share": (0.1, 0.1)}
# the upper quartile counts for no more than this
HIGHEST = {"symbol_share": 0.05, "chars_per_word": 12.0, "dup_line_share": 0.1, "capital_share": 0.2}


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that the text holds twice or more, first included."""
    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
        )

    def places(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.transform(
            F.filter(
                F.transform(s, lambda x, i: F.struct(
                    x["i"].alias("i"),
                    (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("twice"),
                )),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        ))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x,
        )

    def counted(w: Column) -> Column:
        covering = let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.array_sort(places(h)), covered)
        ))
        return F.when(F.size(w) > WINDOW, covering).otherwise(F.lit(0))

    # the words are bound once: a filter on the result may be pushed below the split that makes them
    return let(words, counted).cast("long")


def measured(docs: DataFrame, repeats: bool) -> DataFrame:
    """``docs`` as struct ``row`` with the base counts and measures of its text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    spaces = " \t\n\x0b\x0c\r"
    bare = text
    for c in spaces:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    first = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text.alias("text"), bare.alias("bare"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    words = F.filter(F.split("text", SPACE), lambda x: x != "")
    counts = first.select(
        "row", words.alias("words"), lines.alias("lines"),
        F.length("bare").cast("long").alias("word_chars"),
        F.regexp_count("bare", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("bare", F.lit("[A-Z]")).alias("capitals"),
    )
    return counts.select(
        "row", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "capitals",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"), *([repeated_words(F.col("words")).alias("n_repeat_words")] if repeats else []),
    )


def measures() -> list[Column]:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return [
        (F.col("n_symbols") / chars).alias("symbol_share"), (F.col("word_chars") / words).alias("chars_per_word"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("capitals") / chars).alias("capital_share"),
    ]


def limits(docs: DataFrame) -> DataFrame:
    """(lang, source, <measure>_limit): the upper limits of every group, a few numbers a group."""
    rows = measured(docs, repeats=False).select(F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *measures())
    sketches = checkpoint(
        rows.rollup("lang", "source").agg(
            F.grouping_id().alias("level"), F.count("*").alias("n"),
            *(F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), ACCURACY).alias(m) for m in SPREADS),
        )
    )
    own, per_lang = sketches.where("level = 0"), sketches.where("level = 1").drop("source")
    every = sketches.where("level = 3")
    joined = (
        own.alias("o").join(small_or_not(per_lang).alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")))
        .join(F.broadcast(every).alias("e"), F.col("e.level") > F.col("o.level"))  # one row
    )
    found = []
    for m, (least, most) in SPREADS.items():
        q = F.when(F.col("o.n") >= LEAST_ROWS, F.col(f"o.{m}")).when(F.col("l.n") >= LEAST_ROWS, F.col(f"l.{m}")).otherwise(F.col(f"e.{m}"))
        spread = F.least(F.greatest(q[1] - q[0], F.lit(least)), F.lit(most))
        found.append((F.least(q[1], F.lit(HIGHEST[m])) + FENCE * spread).alias(f"{m}_limit"))
    return joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), *found)


def judged(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as ``row``, with its counts, ``base_failed``, ``reasons`` and ``kept``."""
    bounds = checkpoint(limits(docs)).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(f"{m}_limit" for m in SPREADS))
    counted = measured(docs, repeats=True)
    rows = counted.select("*", *measures())
    met = rows.join(small_or_not(bounds), F.col("row.lang").eqNullSafe(F.col("g_lang")) & F.col("row.source").eqNullSafe(F.col("g_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    reasons = F.array_compact(F.array(*(F.when(F.col(m) > F.col(f"{m}_limit"), F.lit(m)) for m in SPREADS)))
    return met.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), reasons.alias("reasons"), (~failed & (F.size(reasons) == 0)).alias("kept"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return judged(docs).where("kept").select("row.*")
