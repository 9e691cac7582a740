"""The training-data pipeline over `documents`: filter, deduplicate, redact, mix, encode."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normweave.llm import bpe, mixing, quality, secrets, simhash
from normweave.llm.runtime import remove, shared_dir, table

#: SQL can't express the classifier, the mixing or the encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good stay; it learns from the labelled ones of docs."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    scored = quality.score(docs, model)
    return scored.where("predicted = 1").select(*columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, a similarity of 0.8 or more) stays, the one of the smallest doc_id."""
    return simhash.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span is replaced in the text; no document goes."""
    columns = docs.columns
    found = secrets.scan(docs, ["redacted"])
    kept = {"text": F.col("redacted"), "n_chars": F.when(F.col("redacted").isNotNull(), F.length("redacted").cast("bigint")).otherwise(F.col("n_chars"))}
    return found.select(*[kept.get(c, F.col(c)).alias(c) for c in columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair mixture of their sources; the files written are in that order."""
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and the digest of what they decode to."""
    file, pattern = bpe.vocabulary()
    return bpe.code(docs, file, pattern, ["n_tokens", "ids", "decoded_sha256"]).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [("quality_classifier", good_quality), ("simhash_near_dedup", deduplicate), ("secret_scan", redact), ("mix_sources", mix), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's rows go when the next has been written."""
    docs = table(spark, sf_dir, "documents")
    at, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
