"""From raw documents to token ids: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
documents. run() writes each stage's result as Parquet into the shared folder and reads it again.

Nulls, empty texts, repeated rows, empty tables and further columns are handled as the operators'
docstrings say; what a stage does with the operator's answer is in its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, langid, linededup, neardup
from millrace.llm.common import cut, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that have a language; those of undetermined language (null or no letter) go, a missing language is filled in."""
    small_batches(spark)
    judged = langid.predict(docs.select(COLUMNS), langid.fit(docs)).where(F.col("lang_pred") != langid.UNDETERMINED)
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so does a document of which nothing but blank lines remains."""
    small_batches(spark)
    clean = linededup.dedup(docs.select(COLUMNS)).where((F.size("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    return clean.withColumn("n_chars", F.when(F.size("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, once: that of the smallest doc_id, and of its texts one.

    A group without any doc_id keeps one row as well. Rows without words are in no group and stay.
    """
    small_batches(spark)
    whole = docs.select(*COLUMNS, neardup.row_key().alias("_h"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_spoken"))
    kept = cut(neardup.kept_rows(docs).select(F.col("doc_id").alias("_kept"), F.col("h").alias("_h")), "kept")
    rows = whole.where("_spoken").join(kept.hint("shuffle_hash"), (whole["_h"] == kept["_h"]) & F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    same = Window.partitionBy("doc_id", "_h").orderBy("doc_id")
    once = rows.withColumn("_copy", F.row_number().over(same)).where("_copy = 1")
    return once.select(COLUMNS).unionByName(whole.where("not _spoken").select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontam.with_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text decoded from them."""
    small_batches(spark)
    coded = bpe.with_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_text")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", encoding)]

#: Suffix ranks, sketches, alignments and BPE merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
