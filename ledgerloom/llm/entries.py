"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, dedup_index, delta_lloyd, fertility, hyperminhash, lattice, media, mixing, quality, secret_scan, simhash, token_store


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprint_index": lambda s, d: dedup_index.documents(_documents(s, d)),
        "op2_subword_lattice": lambda s, d: lattice.scores(_documents(s, d)),
        "op3_token_store": lambda s, d: token_store.documents(_documents(s, d)),
        "op4_weight_mixing": lambda s, d: mixing.plan(_documents(s, d, "doc_id", "text", "source", "lang")),
        "op5_quality_ftrl": lambda s, d: quality.scores(_documents(s, d), _table(s, d, "labels", "doc_id", "quality")),
        "op6_golay_simhash": lambda s, d: simhash.components(_documents(s, d)),
        "op7_tree_bpe": lambda s, d: bpe.digests(_documents(s, d)),
        "op8_media_columns": lambda s, d: media.documents(_documents(s, d)),
        "op9_secret_scan": lambda s, d: secret_scan.scan(_documents(s, d)),
        "op10_fertility_rules": lambda s, d: fertility.rules(_documents(s, d, "doc_id", "text", "lang")),
        "op11_hyperminhash": lambda s, d: hyperminhash.components(_documents(s, d)),
        "op12_suffix_transducer": lambda s, d: alignment.documents(_documents(s, d)),
        "op13_delta_lloyd": lambda s, d: delta_lloyd.clusters(_table(s, d, "embeddings", "vec_id", "embedding")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_weight_mixing": mixing.oracle_sql(), "op9_secret_scan": secret_scan.oracle_sql(), "op13_delta_lloyd": delta_lloyd.oracle_sql()}
