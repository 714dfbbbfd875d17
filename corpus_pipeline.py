"""Corpus pipeline: language ID, MinHash near-dedup, benchmark decontamination, PII, BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; ``run`` writes each result as
Parquet in the shared folder and reads it back for the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import op1_bpe, op4_decontaminate, op6_pii, op7_minhash, op8_langid
from quillgraph.shared import free_name, shared_path

#: Documents go if no language fits: no letters, or a best score below this.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go (null and empty texts too); a missing lang is filled in. Each row is judged by
    its own text: null or equal ids and repeated rows make no difference, and no column's name clashes."""
    model = op8_langid.train(docs.select("doc_id", "text", "lang"))
    if model is None:  # nothing to learn from: nothing can be rejected
        return docs
    found = free_name(docs, "found")
    known = op8_langid.predicted(docs, model, found).where((F.col(f"{found}.lang_pred") != op8_langid.UND) & (F.col(f"{found}.score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", F.col(f"{found}.lang_pred"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least id. Rows are told apart by id and text, so
    unrelated texts under one id all stay; of rows with the same id and text one stays, the least by their other columns; rows
    with a null id or text are in no class and all stay."""
    h, other, i, n, one_row = (free_name(docs, name) for name in ("h", "other_h", "i", "n", "one_row"))
    marked = docs.withColumn(h, op7_minhash.text_key(F.col("text")))
    classes = op7_minhash.text_classes(docs)
    # of documents that are alone, and have one row, nothing travels but what looks them up
    flags = classes.where("not kept or n > 1").select(F.col("doc_id").alias(i), F.col("h").alias(other), F.when(F.col("kept"), F.col("n")).otherwise(0).alias(n))
    marked = marked.join(flags, (F.col("doc_id") == F.col(i)) & (F.col(h) == F.col(other)), "left").withColumn(n, F.coalesce(n, F.lit(1)))
    stay = marked.where(F.col(n) == 1).select(*docs.columns)
    if not classes.where("kept and n > 1").head(1):
        return stay
    row = F.struct(*docs.columns)
    return stay.unionByName(marked.where(F.col(n) > 1).groupBy("doc_id", h).agg(F.min(row).alias(one_row)).select(f"{one_row}.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Each row is judged by its own text, whatever its id; null texts stay."""
    return op4_decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and the terms that still reveal it, are replaced by their kind; n_chars follows the text. All rows stay,
    null ids, null texts and repeated rows too."""
    out = op6_pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian u32) of each document that is left, with digests of the ids and of the decoded text. Every row
    gives one row, also with a null id or text (no tokens)."""
    out = op1_bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("remove_pii", remove_pii),
    ("bpe", bpe),
]

#: SQL cannot express the near-dedup, decontamination and tokenizer stages; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
