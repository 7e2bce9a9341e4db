"""Queries over a journal of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import is_pending

HISTORY_LIMIT = 20
CHANGELOG_LIMIT = 100
MOST_ROWS = 500


def newest():
    return [F.col("recorded_at").desc(), F.col("id").desc()]


def clamp(n: int | None, default: int, most: int = MOST_ROWS) -> int:
    """A usable limit: the default for none or less than one, never over the most."""
    return default if not n or n <= 0 else min(n, most)


def file_history(changes: DataFrame, path: str, limit: int = HISTORY_LIMIT) -> DataFrame:
    return changes.where(F.col("file_path") == path).orderBy(*newest()).limit(limit)


def recent(changes: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    return changes.orderBy(*newest()).limit(limit)


def in_range(changes: DataFrame, since: int, until: int, path: str | None = None, limit: int = 50) -> DataFrame:
    """Rows recorded from since to until, both included."""
    found = changes.where(F.col("recorded_at").between(since, until))
    return (found if path is None else found.where(F.col("file_path") == path)).orderBy(*newest()).limit(limit)


def of_commit(changes: DataFrame, commit: str) -> DataFrame:
    return changes.where(F.col("commit_hash") == commit).orderBy("id")


def all_changes(changes: DataFrame) -> DataFrame:
    return changes.orderBy("id")


def agent_rows(changes: DataFrame, path: str, commit: str) -> DataFrame:
    return changes.where((F.col("file_path") == path) & (F.col("commit_hash") == commit) & (F.col("source") == "agent"))


def files_with_agent_rows(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of (file_path, commit_hash) pairs those that an agent row explains."""
    return pairs.join(changes.where(F.col("source") == "agent"), ["file_path", "commit_hash"], "left_semi")


def files_with_pending_rows(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Of (file_path) those with a pending agent row."""
    return files.join(changes.where((F.col("source") == "agent") & is_pending()), "file_path", "left_semi")


def last_hmac(changes: DataFrame) -> DataFrame:
    """One row: the hmac of the newest row, '' for an empty journal."""
    return changes.agg(F.coalesce(F.max_by("hmac", "id"), F.lit("")).alias("hmac"))


def files_with_history(changes: DataFrame) -> DataFrame:
    return changes.select("file_path").distinct().orderBy("file_path")


def status(changes: DataFrame) -> DataFrame:
    """One row: all rows, pending ones of any source, files, newest time."""
    return changes.agg(
        F.count(F.lit(1)).alias("n_changes"), F.count_if(is_pending()).alias("n_pending"), F.countDistinct("file_path").alias("n_files"),
        F.coalesce(F.max("recorded_at"), F.lit(0)).alias("last_recorded_at"),
    )


def pending_by_file(changes: DataFrame) -> DataFrame:
    return changes.where(is_pending()).groupBy("file_path").agg(F.count(F.lit(1)).alias("n_pending"))


def top_per_file(changes: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The newest rows of each file, ranked; one query instead of one per file."""
    return changes.withColumn("rank", F.row_number().over(W.partitionBy("file_path").orderBy(*newest()))).where(F.col("rank") <= limit)


def latest_per_key(pairs: DataFrame) -> DataFrame:
    """(key, value) of a log of upserts (key, value, seq)."""
    return pairs.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
