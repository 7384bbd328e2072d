"""The training-data pipeline: documents in, packed sequences out.

Every stage calls one operator of ``webdiag.llm`` on all that its predecessor
kept; all but the last return the columns of ``documents``. Rows that share a
doc_id count as one document; further columns are passed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdiag.llm import ngram_join, packing, pii, substring_dedup, toxicity
from webdiag.llm.common import cut, free_names, shared_dir, table, whole_text

TOXIC = 0.5
BROADCAST_ROWS = 1_000_000


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and its length where there is a column for it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; null and empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, = free_names(docs, "__toxicity")
    return toxicity.score(docs, model, score_col=score).filter(F.col(score) < TOXIC).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies.

    Repeated rows of a document that stays become one. Rows without a doc_id
    stay unless they are linked with a document that has one."""
    found = cut(ngram_join.join(docs).groupBy("id", "mark").agg(F.min("component").alias("component"), F.count("*").alias("rows")))
    id_, mark = free_names(docs, "__id", "__mark")
    key = [F.col("id").alias(id_), F.col("mark").alias(mark)]
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(whole_text(docs["text"])) == F.col(mark))
    gone = found.filter("component IS NOT NULL AND NOT (component <=> id)").select(*key)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, same, "left_anti")
    twice = found.filter("rows > 1 AND id IS NOT NULL").select(*key)
    if twice.isEmpty():
        return kept
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates())


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has, too."""
    return _with_text(substring_dedup.dedup(docs).select(*docs.columns), F.col("text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets."""
    model = pii.fit(docs)
    found, = free_names(docs, "__pii_found")
    spanned = docs.withColumn(found, pii.spans(whole_text(F.col("text")), model))
    return _with_text(spanned, pii.redact(F.col("text"), F.col(found))).drop(found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences."""
    import public_tokenizers

    return packing.pack_texts(docs, "doc_id", "text",
                              public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("pii", redact_personal_data),
    ("packing", pack),
]

# Toxicity scores and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is written
    to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
