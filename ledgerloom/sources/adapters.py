"""The driver's tables as journals and code graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a journal: a user is a file, fifty events make a commit, each fifth is pending."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("file_path"),
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("c"), F.floor(F.col("event_id") / 50).cast("string"))).alias("commit_hash"),
        F.when(F.col("event_type").isin("click", "view"), "agent").when(F.col("event_type") == "purchase", "llm").otherwise("fallback").alias("source"),
        F.col("event_type").alias("summary"),
        F.coalesce("props", F.lit("")).alias("reason"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("recorded_at"),
    )


CHANGES_SQL = """(SELECT event_id AS id, 'u/' || user_id AS file_path, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'c' || (event_id // 50) END AS commit_hash,
  CASE WHEN event_type IN ('click', 'view') THEN 'agent' WHEN event_type = 'purchase' THEN 'llm' ELSE 'fallback' END AS source,
  event_type AS summary, coalesce(props, '') AS reason, epoch_us(ts) // 1000000 AS recorded_at FROM events)"""

HREF = r'href="([^"]+)"'


def page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of ``pages`` as imports: a page's url is the file, each href an import key."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("url").alias("file_path"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("imported_path"))


IMPORTS_SQL = f"""(SELECT url AS file_path, unnest(regexp_extract_all(html, '{HREF}', 1)) AS imported_path FROM pages)"""


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as symbols: a brand is a file, a part's name a symbol."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "func").otherwise("type").alias("kind"), F.col("p_brand").alias("file_path"),
        F.col("p_partkey").cast("int").alias("line_start"), (F.col("p_partkey") + F.col("p_size")).cast("int").alias("line_end"), F.col("p_type").alias("signature"),
    )


SYMBOLS_SQL = """(SELECT p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'func' ELSE 'type' END AS kind, p_brand AS file_path,
  p_partkey::INT AS line_start, (p_partkey + p_size)::INT AS line_end, p_type AS signature FROM part)"""
