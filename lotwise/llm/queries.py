"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import (
    chat, decontaminate, htmltext, merkle, negatives, packing, quality, rules, sharding, simhash, substrings, topk, toxicity, training,
)
from lotwise.llm.frames import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents: 64-bit fingerprints of four-word shingles within 4 bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted, and what is read back from the text and its loss mask."""
    turns = table(spark, folder, "conversations")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    found = chat.formatted(turns.select("conv_id", "turn", "role", "text").union(probe))
    back = found.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), chat.read_back(F.col("formatted")).alias("turns"),
        chat.trained_text(F.col("segments")).alias("trained"),
    )
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars",
    )


def _escaped(text: str, role: bool = False) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for control in ["</turn>", "<part/>"]:
        out = f"replace({out}, '{control}', '{control[0]}\\-{control[1:]}')"
    # two rounds part all neighbours in a run: first and second of each pair, then what the pairs left together
    out = f"replace(replace({out}, '##', '#\\-#'), '##', '#\\-#')"
    return f"replace({out}, ':' || chr(10), ':\\-' || chr(10))" if role else out


ORACLES["op7_chat"] = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS head FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped('text')}) + CASE WHEN head THEN 14 + length({_escaped('role', True)}) ELSE 7 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document and the verdict of the limits of its language and source."""
    found = rules.judged(table(spark, folder, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")


@query
def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes along the Hilbert curve."""
    found = sharding.shards(table(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.packed(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json")).withColumnRenamed("key", "doc_id")


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of a document within a fifth of the words' edits of a benchmark item."""
    found = decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnRenamed("key", "doc_id")


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences and lines that stand in an earlier document or place, as spans of the original texts."""
    found = substrings.passages(table(spark, folder, "documents"), kinds=[substrings.SENTENCES, substrings.LINES])
    return found.select(
        F.col("key").alias("doc_id"), F.when(F.col("kind") == substrings.LINES, "line").otherwise("sentence").alias("unit"),
        "start", "stop", "n_words", "n_units", F.col("kept_key").alias("kept_doc_id"), "kept_start",
    )


ORACLES["op2_substring_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, unit_kind, unnest(found) AS unit, generate_subscripts(found, 1) AS no
  FROM (
    SELECT doc_id, 'sentence' AS unit_kind, regexp_extract_all(text, '[^
.?]+[.?]*|[.?]+|
') AS found FROM documents WHERE text IS NOT NULL
    UNION ALL
    SELECT doc_id, 'line', regexp_extract_all(text, '[^
]+|
') FROM documents WHERE text IS NOT NULL
  )
), placed AS (
  SELECT doc_id, unit_kind, unit, sum(length(unit)) OVER (PARTITION BY doc_id, unit_kind ORDER BY no) - length(unit) AS start,
    [w FOR w IN regexp_split_to_array(lower(unit), '\s+') IF w <> ''] AS words
  FROM cut
), units AS (
  SELECT doc_id, unit_kind, start, start + length(unit) AS stop, len(words) AS n_words, array_to_string(words, ' ') AS unit,
    row_number() OVER (PARTITION BY doc_id, unit_kind ORDER BY start) AS place
  FROM placed WHERE len(words) >= CASE unit_kind WHEN 'line' THEN 1 ELSE 4 END
), met AS (
  SELECT *, first_value(doc_id) OVER own AS kept_doc_id, first_value(start) OVER own AS kept_start, row_number() OVER own AS nth
  FROM units WINDOW own AS (PARTITION BY unit_kind, unit ORDER BY doc_id, place)
), runs AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id, unit_kind ORDER BY place) AS run FROM met WHERE nth > 1
)
SELECT doc_id, unit_kind AS unit, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop, sum(n_words)::BIGINT AS n_words, count(*) AS n_units,
  arg_min(kept_doc_id, place) AS kept_doc_id, arg_min(kept_start, place)::BIGINT AS kept_start
FROM runs GROUP BY doc_id, unit_kind, run
"""


@query
def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = htmltext.extracted(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by clauses, learned from labelled documents that are not held out."""
    docs = table(spark, folder, "documents")
    sample = training.labelled_sample(docs, table(spark, folder, "labels"), "toxic")
    found = toxicity.scored(docs, *toxicity.model(sample))
    return found.select(
        F.col("key").alias("doc_id"), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses",
    )


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from labelled documents that are not held out."""
    docs = table(spark, folder, "documents")
    sample = training.labelled_sample(docs, table(spark, folder, "labels"), "quality")
    found = quality.scored(docs, quality.fit(sample))
    return found.select(
        F.col("key").alias("doc_id"), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every positive of every hundredth vector."""
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(rows.withColumn("label", label))


ORACLES["op11_hard_negatives"] = """
WITH held AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM held a JOIN held b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER own)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT alike
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW own AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER own <= 5
"""


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Merkle manifest of all documents by language, and what tampering with some texts does to the root."""
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ["doc_id", "source", "lang", "n_chars"]]
    upper = string.ascii_uppercase
    changed = merkle.digest([*fields, F.translate("text", upper, upper.lower())])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, changed)
    found = merkle.manifest(docs, [*fields, F.col("text")], F.col("lang"), F.col("doc_id"), held=tampered)
    back = merkle.folded(F.coalesce("held", "leaf"), F.col("proof"))
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join(merkle.siblings(F.col("proof")), ""), 256).alias("proof_sha256"),
        back.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


_BITS = "list_reduce(list_concat([xor({0}, {1})], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
_CRC = f"xor(list_reduce(list_concat([4294967295], [ascii(c) FOR c IN string_split(doc_id::VARCHAR, '')]), lambda a, b: {_BITS.format('a', 'b')}), 4294967295)"

ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_leaf('text')} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (ORDER BY lang, doc_id, leaf) AS id
  FROM hashed
), nodes(lang, level, pos, digest, n) AS (
  SELECT lang, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), above(level, pos, digest, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM above WHERE n > 1 GROUP BY level, pos // 8, n
), others AS (
  SELECT id, 0 AS part, level, o.pos, digest FROM leaves l JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.n > 1
    AND o.pos // 8 = l.pos // (8 ** (level + 1))::BIGINT AND o.pos <> l.pos // (8 ** level)::BIGINT
  UNION ALL
  SELECT id, 1, level, o.pos, digest FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN above o ON o.n > 1
    AND o.pos // 8 = s.pos // (8 ** (level + 1))::BIGINT AND o.pos <> s.pos // (8 ** level)::BIGINT
), proofs AS (
  SELECT id, sha256(string_agg(digest, '' ORDER BY part, level, pos)) AS proof_sha256 FROM others GROUP BY id
), low(id, lang, level, pos, own) AS (
  SELECT id, lang, 0, pos, coalesce(tampered, leaf) FROM leaves
  UNION ALL
  SELECT id, f.lang, f.level + 1, f.pos // 8, sha256(string_agg(CASE WHEN o.pos = f.pos THEN own ELSE digest END, '' ORDER BY o.pos))
  FROM low f JOIN nodes o ON o.lang IS NOT DISTINCT FROM f.lang AND o.level = f.level AND o.n > 1 AND o.pos // 8 = f.pos // 8
  GROUP BY id, f.lang, f.level, f.pos
), high(id, level, pos, own) AS (
  SELECT id, 0, s.pos, arg_max(own, level) FROM low f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang GROUP BY id, s.pos
  UNION ALL
  SELECT id, f.level + 1, f.pos // 8, sha256(string_agg(CASE WHEN o.pos = f.pos THEN own ELSE digest END, '' ORDER BY o.pos))
  FROM high f JOIN above o ON o.level = f.level AND o.n > 1 AND o.pos // 8 = f.pos // 8 GROUP BY id, f.level, f.pos
), back AS (SELECT id, arg_max(own, level) AS folded_root FROM high GROUP BY id)
SELECT doc_id, leaf, subroot, a.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = a.digest AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN back USING (id) LEFT JOIN proofs USING (id)
JOIN above a ON a.n = 1
"""


@query
def op13_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors of highest inner product for every fiftieth vector."""
    return topk.top_k(table(spark, folder, "embeddings"))


ORACLES["op13_topk_search"] = """
WITH held AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)
SELECT q.vec_id AS query_id, (row_number() OVER own)::INT AS rank, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
FROM held q JOIN held c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
WINDOW own AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id)
QUALIFY row_number() OVER own <= 5
"""
