"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

* ``quality``: documents that the classifier scores under its threshold go.
* ``near_dedup``: of each group of documents that are alike (five-word shingles, similarity 0.8 or more) the one with the
  smallest id stays; candidates come from fuzzy Golay keys of fingerprints, and for what these can't reach from a complete prefix filter
  on shingles.
* ``secrets``: spans of secrets are masked in the texts; n_chars follows.
* ``mixing``: documents are sampled to the calibrated weights of their source, language and topic.
* ``bpe``: the ids of each text, whose decoded bytes are checked against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixing, quality, secret_scan, similar_sets
from ledgerloom.llm.common import materialise

#: Share of the tokens that the mix takes.
MIX_RATE = 0.8


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep(docs, labels)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar_sets.keep_similar_first(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, rate=MIX_RATE)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(docs))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    checked = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids don't decode to their text")).cast("array<int>"))
    return coded.withColumn("ids", checked).withColumn("n_tokens", F.size("ids").cast("long")).drop("decoded")


STAGES = [("quality", _quality), ("near_dedup", _near_dedup), ("secrets", _secrets), ("mixing", _mixing), ("bpe", _bpe)]

#: SQL can't express a trained classifier; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
