"""The corpus pipeline: five stages over ``documents``, each stage's result written and read again as the next one's input.

All stages but the last return the columns of documents, with any further columns that docs has. Rows stand for themselves: rows of
one doc_id with different texts are different documents, and what is left out is told by doc_id and text. Null texts are empty, and
the first stage rejects them; rows without an id are never labelled, and leave as near duplicates only of rows without an id that
are equal in text. An empty table stays empty.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm import mixing, ngram_join, packing, quality, queries, suffix_dedup
from xylem.llm.common import Staging, table, told_apart


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and look more like trusted documents than like what the corpus has too much of."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), carry=True)
    return judged.filter("kept").select("record.*").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: one of the least id, and of those the one with the least text."""
    return ngram_join.without_near_copies(docs)


#: Strings of the dedup stage: all of more than 50 words, whatever their bytes, and those of operator 4. Two batches are enough for
#: documents that are all there at once.
PASSAGES = suffix_dedup.PASSAGES
STRINGS = replace(suffix_dedup.BYTES, batches=2)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long strings that occur elsewhere; n_chars is that of the text left."""
    left = suffix_dedup.without_repeats(docs, PASSAGES, STRINGS)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at rates up to 1 that bring the domains' tokens to the target weights; those most likely clean all stay. Rows equal
    in id and text are treated alike."""
    labelled = mixing.domains_of(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labelled, mixing.WEIGHTS, "clean", replace(mixing.Mixing(), most=1.0, anchored=1.0))
    gone = mixed.filter("copies = 0").select("doc_id", "digest").distinct().withColumn("__gone", F.lit(True))
    told, others = told_apart(docs, Staging(spark, "left-out").save(gone, "rows"), "doc_id", "text")
    return told.filter("__gone is null").select(*docs.columns).unionAll(others)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    pieces = packing.pack_documents(docs, queries.vocabulary_file("word_bpe_49k.json"), plain=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing to target weights", mixing_to_weights),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = staging.save(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
