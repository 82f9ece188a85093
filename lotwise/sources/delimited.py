"""Delimited text files whose header may stand below title rows.

Files stay splittable: lines are read by many tasks, and only the first lines of
the first block of a file are looked at to find its header.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lotwise.errors import InputError
from lotwise.functions.clean import bind, trim_all
from lotwise.functions.names import unique_names

PREVIEW_ROWS = 20

# Words that make a line look like a header.
HEADER_WORDS = ["batch", "lot", "id", "result", "value", "test", "temp", "ph"]

# What a float parser takes, after a decimal comma became a dot.
FLOAT_TEXT = r"(?i)^[+-]?(\d[\d_]*\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity|nan)$"

# One record: runs outside quotes, or quoted runs that may hold line breaks.
RECORD = r'((?:[^"\r\n]++|"(?:[^"]++|"")*+")++)'


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], multiline: bool = False, check_quotes: bool = True,
) -> DataFrame:
    """Non-blank lines as ``file, later_block, position, line``.

    ``position`` grows within the first block of a file, which is all that the
    header search needs. ``multiline`` reads each file whole, for exports with
    line breaks inside quotes; use it for small files only. Otherwise a line with
    an open quote, which a line break inside quotes leaves, stops the job; pass
    ``check_quotes=False`` where quotes are plain characters, such as inch marks.
    """
    if multiline:
        texts = spark.read.text(paths, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
        return split_records(texts, "file", "content")
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") > 0).alias("later_block"),
        F.monotonically_increasing_id().alias("position"), F.regexp_replace("value", r"^﻿|\r$", "").alias("line"),
    )
    if check_quotes:
        bare = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
        message = F.concat(F.lit("a quote stays open in a line of "), "file", F.lit(": read it with multiline=True"))
        lines = lines.withColumn("line", F.when(bare % 2 == 0, F.col("line")).otherwise(F.raise_error(message)))
    return lines.filter(trim_all(F.col("line")) != "")


def split_records(texts: DataFrame, file: str, content: str) -> DataFrame:
    """The same rows from whole texts held in a column, with ``row``, the number of a non-blank line from 0.

    A text holds all lines of its file, so ``row`` is known without a shuffle, and so are headers of whole texts
    (``with_headers``). ``texts`` has one row for each file.
    """
    return text_lines(texts.select(F.col(file).alias("file"), _records(F.col(content)).alias("records")))


def text_lines(records: DataFrame) -> DataFrame:
    """Rows of lines from ``file, records`` and any further columns, which every line gets."""
    more = [c for c in records.columns if c not in ("file", "records")]
    return records.select("file", *more, F.posexplode("records").alias("__row", "r")).select(
        "file", F.lit(False).alias("later_block"), F.col("r.position").alias("position"), F.col("r.line").alias("line"),
        F.col("__row").cast("bigint").alias("row"), *more)


def _records(content: Column) -> Column:
    """Non-blank records of a text with their positions."""
    found = F.regexp_extract_all(F.regexp_replace(content, r"^﻿", ""), F.lit(RECORD), F.lit(1))
    placed = F.transform(found, lambda line, i: F.struct(i.cast("bigint").alias("position"), line.alias("line")))
    return F.filter(placed, lambda r: trim_all(r["line"]) != "")


def with_headers(texts: DataFrame, file: str, content: str, delimiter: str = ",", search_rows: int = PREVIEW_ROWS) -> DataFrame:
    """``split_records`` whose lines carry ``header``, the best header of their own text, so that nothing is shuffled."""
    records = texts.select(F.col(file).alias("file"), _records(F.col(content)).alias("records"))
    return text_lines(records.withColumn("header", best_header(F.slice("records", 1, search_rows), delimiter)))


def text_headers(texts: DataFrame, file: str, content: str, delimiter: str = ",", search_rows: int = PREVIEW_ROWS) -> DataFrame:
    """``suggest_headers`` of whole texts, each looked at by itself."""
    found = texts.select(F.col(file).alias("file"), F.slice(_records(F.col(content)), 1, search_rows).alias("records"))
    best = found.where(F.size("records") > 0).select("file", best_header(F.col("records"), delimiter).alias("b"))
    return best.select("file", *(F.col("b")[c].alias(c) for c in ("header_row", "score", "position", "line")))


def best_header(records: Column, delimiter: str) -> Column:
    """The record that scores highest, the earliest of equal ones."""
    scored = F.transform(records, lambda r, i: F.struct(
        header_score(cells_of(r["line"], delimiter)).alias("score"), (-i).cast("bigint").alias("before"), r["position"].alias("position"), r["line"].alias("line")))
    return bind(F.array_max(scored), lambda b: F.struct(
        (-b["before"]).alias("header_row"), b["score"].alias("score"), b["position"].alias("position"), b["line"].alias("line")))


def cells_of(line: Column, delimiter: str = ",") -> Column:
    """Cells of one record as an array, quotes resolved.

    The record is first cut at delimiters that have an even number of quotes
    before them.
    """
    q = r"\Q" + delimiter + r"\E"
    parts = F.split(line, q + r'(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda p: F.replace(
        F.regexp_replace(p, r'(?s)^\s*"(.*)"\s*$', "$1"), F.lit('""'), F.lit('"')))


def preview(lines: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """First non-blank lines of every file: ``file, row, position, line``."""
    first = lines.filter(~F.col("later_block"))
    if "row" not in lines.columns:
        order = Window.partitionBy("file").orderBy("position")
        first = first.withColumn("row", F.row_number().over(order).cast("bigint") - 1)
    return first.filter(F.col("row") < rows).select("file", "row", "position", "line")


def looks_numeric(text: Column) -> Column:
    return F.replace(trim_all(text), F.lit(","), F.lit(".")).rlike(FLOAT_TEXT)


def header_score(cells: Column) -> Column:
    """How much a row looks like column names; -1 for an empty row."""
    return bind(F.filter(F.transform(cells, lambda c: trim_all(c)), lambda c: c != ""), _score_of_used)


def _score_of_used(used: Column) -> Column:
    n = F.size(used)

    def words(text: Column) -> Column:
        return sum((F.when(F.contains(text, F.lit(word)), 0.25).otherwise(0.0) for word in HEADER_WORDS), F.lit(0.0))

    unique = F.size(F.array_distinct(used)) / n
    texts = F.size(F.filter(used, lambda c: ~looks_numeric(c))) / n
    return F.when(n == 0, F.lit(-1.0)).otherwise(n + 2.0 * unique + texts + bind(F.lower(F.array_join(used, " ")), words))


def suggest_headers(lines: DataFrame, delimiter: str = ",", search_rows: int = PREVIEW_ROWS) -> DataFrame:
    """Best of the first ``search_rows`` rows per file; of equal scores the earliest row wins."""
    scored = preview(lines, search_rows).withColumn("score", header_score(cells_of(F.col("line"), delimiter)))
    best = F.max_by(F.struct("row", "position", "line", "score"), F.struct(F.col("score"), -F.col("row")))
    return scored.groupBy("file").agg(best.alias("b")).select(
        "file", F.col("b.row").alias("header_row"), F.col("b.score").alias("score"),
        F.col("b.position").alias("position"), F.col("b.line").alias("line"),
    )


def fixed_headers(lines: DataFrame, header_row: int) -> DataFrame:
    """The given row (from 0, blank lines not counted) as header of every file."""
    return preview(lines, header_row + 1).filter(F.col("row") == header_row).select(
        "file", F.col("row").alias("header_row"), "position", "line"
    )


def load(
    lines: DataFrame, headers: DataFrame | None, delimiter: str = ",", keep_file: bool = False, most_layouts: int = 100_000,
) -> DataFrame:
    """All data rows below the headers, every column as text.

    Columns of one name are one column, whatever their place in a file. A line is parsed once, into as many
    cells as the widest header has, and a file's header tells which cell goes where, so any number
    of layouts is one scan. The driver holds the different headers, hence ``most_layouts``. Lines that
    carry their file's header (``with_headers``) need no ``headers`` and no join by file.
    """
    own = headers is None
    named = lines.where("row = 0").select("header.line") if own else headers.select("line")
    layouts = sorted(r.line for r in named.distinct().limit(most_layouts + 1).collect())
    if not layouts:
        raise InputError("no header row was found")
    if len(layouts) > most_layouts:
        raise InputError(f"more than {most_layouts} different headers: check the header row or raise most_layouts")
    fresh = {line: unique_names(next(csv.reader([line], delimiter=delimiter)))[0] for line in layouts}
    columns = list(dict.fromkeys(c for found in fresh.values() for c in found))
    # from 1; a header without the column has no place for it
    places = [(line, [found.index(c) + 1 if c in found else None for c in columns]) for line, found in fresh.items()]
    # a row for each layout, as many as the driver holds; all files may have the same one
    known = lines.sparkSession.createDataFrame(places, "__layout string, __places array<int>")
    if own:
        below = lines.filter(F.col("position") > F.col("header.position"))
        body = below.join(F.broadcast(known), below["header.line"] == known["__layout"])
    else:
        heads = headers.join(F.broadcast(known), headers["line"] == known["__layout"]).select("file", F.col("position").alias("__from"), "__places")
        body = lines.join(heads, "file").filter(F.col("later_block") | (F.col("position") > F.col("__from")))
    width = max(map(len, fresh.values()))
    row = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)), {"sep": delimiter, "mode": "PERMISSIVE", "escape": '"'})
    parsed = body.select(row.alias("r"), "__places", F.col("file").alias("_file"), F.col("position").alias("_line"))
    cells = parsed.withColumn("__cells", F.array(*(F.col(f"r.c{i}") for i in range(width))))
    placed = cells.select(F.transform("__places", lambda p: F.get("__cells", p - 1)).alias("__own"), "_file", "_line")
    result = placed.select(*(F.get("__own", F.lit(i)).alias(c) for i, c in enumerate(columns)), "_file", "_line")
    return result if keep_file else result.drop("_file", "_line")


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], header_row: int | None = 0,
    delimiter: str = ",", multiline: bool = False, keep_file: bool = False, search_rows: int = PREVIEW_ROWS,
    check_quotes: bool = True,
) -> DataFrame:
    """Read exports; ``header_row=None`` finds the header of each file in its first ``search_rows`` rows."""
    lines = read_lines(spark, paths, multiline, check_quotes)
    headers = suggest_headers(lines, delimiter, search_rows) if header_row is None else fixed_headers(lines, header_row)
    return load(lines, headers, delimiter, keep_file)
