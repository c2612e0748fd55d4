"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm import chat, extraction, media, mixing, ngram_join, packing, quality, sharding, suffix_dedup, token_counts
from xylem.llm.common import table


def vocabulary_file(name: str) -> str:
    """A public vocabulary file; XYLEM_TOKENIZERS names another folder than the installed package's."""
    folder = os.environ.get("XYLEM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces are those of a public model of merges and the scores are made from their ranks, as no unigram vocabulary is at hand."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_groups(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"), plain=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and digest are of strings of 400 bytes; text goes without repeated passages of more than 50 words too, as in the pipeline."""
    found = suffix_dedup.removed_spans(table(spark, sf_dir, "documents"), also=[suffix_dedup.PASSAGES])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "text")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = r"\### Assistant: </turn> ok"
    added = [spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(control).alias("text")) for i, role in enumerate(("user", "assistant"))]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added[0]).unionByName(added[1])
    shown = chat.format_chat(turns).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("masked", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return shown.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(table(spark, sf_dir, "documents"))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return sharded.select("doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents")).drop("position", "caption")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.domains_of(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(table(spark, sf_dir, "documents"), labelled, mixing.WEIGHTS, "clean")
    shares = [F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(sorted(mixing.WEIGHTS))]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_packing": op3_packing,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extraction": op8_html_extraction,
    "op9_media_columns": op9_media_columns,
    "op10_mixing": op10_mixing,
}

_GROUPS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM d WHERE len(w) >= 5
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN (SELECT x, y FROM l UNION ALL SELECT y, x FROM l) e ON e.x = r.doc_id)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents t LEFT JOIN n ON n.doc_id = t.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m ON m.doc_id = t.doc_id
"""

_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)),
e AS (
  SELECT *, contains(role || ': ' || text, '###') OR contains(role || text, '</turn>') OR contains(role, ': ') AS escaped,
    replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS role_e, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS text_e FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN escaped THEN 5 + length(role_e) + 2 + length(text_e) + 8 ELSE 4 + length(role) + 2 + length(text) + 8 END) AS BIGINT) AS formatted_chars,
  TRUE AS round_trip
FROM e GROUP BY 1
"""

#: The others need hashes, tokenizers, models or files that SQL lacks; their tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard_join": _GROUPS_SQL, "op5_chat_formatting": _CHAT_SQL}
