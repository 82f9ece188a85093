"""Expressions that clean messy cell text: missing marks, keys and numbers.

Everything is a built-in column expression, so it stays in generated JVM code
and works the same in a projection, a filter or an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, NumericType, StringType

# Cell texts that mean "no value".
MISSING_MARKS = [
    "", "-", "--", "na", "n/a", "nan", "none", "null", "not available",
    "not tested", "not done", "nd", "n.d.", "missing",
]

# Fixed patterns: invisible characters, comparison marks and digit groups.
HIDDEN_CHARACTERS = "\u00a0\u200b\u200c\u200d\ufeff"
QUALIFIER = r"(?i)^(<=|>=|<|>|~|approx\.?|about)\s*"
DIGIT_GROUP = r"[-+]?\d+(?:[\s.,]\d+)*"

# Every white-space character; plain functions and classes are faster than
# Unicode-aware patterns, and Spark's own trim only knows the blank.
SPACES = (
    " \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A column used in several branches of a CASE is otherwise computed in each.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def drop_hidden(c: Column) -> Column:
    return F.translate(c, HIDDEN_CHARACTERS, "")


def is_missing_text(c: Column) -> Column:
    """True for NULL and for every text that stands for a missing value."""
    text = drop_hidden(F.lower(trim_all(c.cast("string"))))
    return F.coalesce(text.isin(MISSING_MARKS), F.lit(True))


def key_text(c: Column, dtype: DataType | None = None) -> Column:
    """Text of a key column; whole-number doubles print without an exponent."""
    if isinstance(dtype, (DoubleType, FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def normalise_key(c: Column, dtype: DataType | None = None, drop_separators: bool = True) -> Column:
    """Canonical batch key; NULL when the text is a missing mark.

    The result may be the empty text (a key made of separators only), which
    callers count as missing.
    """
    text = drop_hidden(key_text(c, dtype))
    text = F.upper(trim_all(F.regexp_replace(text, f"[{SPACES}]+", " ")))
    separators = f"[{SPACES}_-]+"

    def known(t: Column) -> Column:
        whole = F.regexp_replace(t, r"^(\d+)\.0$", "$1")
        return F.when(~F.lower(t).isin(MISSING_MARKS), F.regexp_replace(whole, separators, "") if drop_separators else whole)

    return bind(text, known)


def resolve_decimal_mark(digits: Column) -> Column:
    """Turn one digit group into a text that casts to double.

    With comma and dot the later one is the decimal mark; a lone comma is
    decimal; of several commas without a dot only the last one is.
    """
    return bind(F.replace(digits, F.lit(" "), F.lit("")), _resolved)


def _resolved(text: Column) -> Column:
    has_comma = F.contains(text, F.lit(","))
    has_dot = F.contains(text, F.lit("."))
    backwards = F.reverse(text)
    comma_last = F.instr(backwards, ",") < F.instr(backwards, ".")
    last_comma_decimal = F.replace(
        F.regexp_replace(text, r",([^,]*)$", r".$1"), F.lit(","), F.lit("")
    )
    return (
        F.when(
            has_comma & has_dot & comma_last,
            F.translate(F.replace(text, F.lit("."), F.lit("")), ",", "."),
        )
        .when(has_comma & has_dot, F.replace(text, F.lit(","), F.lit("")))
        .when(has_comma, last_comma_decimal)
        .otherwise(text)
    )


def _without_mark(text: Column) -> Column:
    """Rest of a text after its leading comparison mark."""
    mark = F.regexp_extract(text, QUALIFIER, 0)
    return F.substring(text, F.length(mark) + 1, F.length(text))


def parsed_number(c: Column) -> Column:
    """Number held in a messy text, else NULL."""
    text = trim_all(drop_hidden(c.cast("string")))
    digits = F.regexp_extract(bind(text, _without_mark), DIGIT_GROUP, 0)
    return F.when(~is_missing_text(c), resolve_decimal_mark(digits).try_cast("double"))


def parsed_qualifier(c: Column) -> Column:
    """Leading comparison mark of a messy text, also when no number follows."""
    mark = F.regexp_extract(trim_all(drop_hidden(c.cast("string"))), QUALIFIER, 1)
    return F.when(~is_missing_text(c) & (mark != ""), mark)


def parse_number(c: Column) -> Column:
    """``struct<value: double, qualifier: string>`` of a messy text."""
    return F.struct(parsed_number(c).alias("value"), parsed_qualifier(c).alias("qualifier"))


def has_digit_group(c: Column) -> Column:
    return F.coalesce(c.cast("string").rlike(DIGIT_GROUP), F.lit(False))


# Java's parser accepts forms such as "5d"; plain decimal notation only.
PLAIN_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def to_number(c: Column, dtype: DataType | None = None) -> Column:
    """Strict numeric coercion; anything that is not a plain finite number is NULL."""
    if dtype is not None and not isinstance(dtype, (NumericType, StringType)):
        return c.try_cast("double")
    value = c.cast("double") if isinstance(dtype, NumericType) else F.when(
        c.cast("string").rlike(PLAIN_NUMBER), c.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)  # NaN is above infinity here


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
