"""Conversations as training text: turns sorted, merged by role, marked and escaped, by Spark expressions.

A message is ``### role:``, a line feed, its texts, ``</turn>`` and a line feed. Texts of adjacent
turns of one role share a message and are divided by ``<part/>``. Inside texts and roles a
backslash is doubled and ``\\-`` is put into every control string, and between any two number signs,
so that none remains and the turns can be read back exactly.

Rows: null roles and texts count as empty; turns sort by turn (nulls first), role and text, so
ties and repeated rows have one order; a null conversation id is a conversation of its own; an
empty table gives an empty result; very long texts are formatted whole; columns of other names
play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END, PART, HEAD = "</turn>\n", "<part/>", "### "


def escape(text: Column, role: bool = False) -> Column:
    """Double backslashes, then break every control string with ``\\-``; no two number signs stay together."""
    controls = [("</turn>", "<\\-/turn>"), ("<part/>", "<\\-part/>")] + ([(":\n", ":\\-\n")] if role else [])
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, broken in controls:
        out = F.replace(out, F.lit(control), F.lit(broken))
    return F.regexp_replace(out, "#(?=#)", "#\\\\-")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)|\\-", "$1")


def messages(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, messages): one row per conversation; a message has a role and its parts, escaped."""
    own = turns.select(
        turns[conv_id].alias("conv_id"),
        F.struct(
            turns[turn].alias("turn"), F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
            F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    # sort_array puts null turns first
    sorted_turns = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
    )
    cut = sorted_turns.select("conv_id", "turns", starts.alias("starts"))
    merged = F.transform("starts", lambda at, k: F.struct(
        F.get("turns", at)["role"].alias("role"),
        F.transform(
            F.slice("turns", at + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - at),
            lambda t: escape(t["text"]),
        ).alias("parts"),
    ))
    return cut.select("conv_id", merged.alias("messages"))


def formatted(turns: DataFrame, trained: str = "assistant", **columns: str) -> DataFrame:
    """(conv_id, formatted, segments): the text of each conversation, and the loss mask.

    ``segments`` are the messages in order, their ``text`` joining to ``formatted``; ``loss`` of a
    message is its part of the mask, an array of (start, length) in code points of that message,
    one for each text of the role ``trained``, over the text alone and never its marks.
    """
    found = messages(turns, **columns)

    def segment(m: Column) -> Column:
        head = F.concat(F.lit(HEAD), escape(m["role"], role=True), F.lit(":\n"))
        spans = F.aggregate(
            m["parts"],
            F.struct(F.length(head).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
            lambda a, p: F.struct(
                (a["at"] + F.length(p) + len(PART)).alias("at"),
                F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(p).alias("length")))).alias("spans"),
            ),
        )["spans"]
        return F.struct(
            F.concat(head, F.array_join(m["parts"], PART), F.lit(TURN_END)).alias("text"),
            F.when(m["role"] == trained, spans).otherwise(F.array().cast("array<struct<start:int,length:int>>")).alias("loss"),
        )

    cut = found.select("conv_id", F.transform("messages", segment).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda m: m["text"]), "").alias("formatted"), "segments")


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, read from the messages' texts and unescaped."""
    return F.array_join(F.transform(segments, lambda m: F.array_join(
        F.transform(m["loss"], lambda s: unescape(F.substring(m["text"], s["start"] + 1, s["length"]))), "")), "")


def read_back(formatted_text: Column) -> Column:
    """Array of (role, text) of the original turns, from a formatted text."""
    blocks = F.filter(F.split(formatted_text, TURN_END), lambda b: b != "")

    def turns(block: Column) -> Column:
        at = F.locate(":\n", block)
        role = unescape(block.substr(F.lit(len(HEAD) + 1), at - F.lit(len(HEAD) + 1)))
        return F.transform(F.split(block.substr(at + 2, F.length(block)), PART), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))
