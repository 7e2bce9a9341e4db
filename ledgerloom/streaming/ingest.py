"""Structured Streaming: journal ingest, skew flags along one order and by key, sessions with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import integrity
from ..operators.integrity import SKEW_SECONDS
from ..schemas import struct
from ..sources.commit_log import CommitLog, Conflict, Folder
from ..sources.journal_store import Journal


def ingest(stream: DataFrame, journal: Journal, checkpoint: str, quarantine: str | None = None, **trigger) -> StreamingQuery:
    """Record a stream of input rows batch by batch, in order; any number of streams per journal. Refused rows go to a folder.

    A batch is known to the journal by the query's id, which its checkpoint holds, and by its number. So one that was recorded before its
    checkpoint was written is recognised and not recorded again, and another stream's batches are its own; refused rows
    lie in a folder of their batch and are written over."""
    folder = Folder(journal.spark, checkpoint)

    def batch(rows: DataFrame, number: int) -> None:
        query = query_id(folder)
        bad = journal.record(rows, batch=(query, number))
        if quarantine:
            bad.write.mode("overwrite").parquet(f"{quarantine}/query={query}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def query_id(folder: Folder) -> str:
    """The id that a stream keeps in its checkpoint, whatever it is stopped and started."""
    return json.loads(folder.read("metadata"))["id"]


FLAGS = struct("id long, recorded_at long, skewed boolean")


def flag_skew(stream: DataFrame, path: str, checkpoint: str, id_col: str = "id", at_col: str = "recorded_at", ranges: int = 64, **trigger) -> StreamingQuery:
    """Skew flags of a stream along one order (by batch, then by id), as runs of a table in numbered versions; see ``skew_flags_so_far``.

    A batch is judged range by range of its ids, with a row per range carried across; what goes from batch to batch is one
    number, the newest time so far, which the version holds that also holds the batch's flags. So a batch has as
    many tasks as ranges, and one that is replayed after a kill is recognised. Late rows are flagged, never dropped."""
    spark = stream.sparkSession
    log, folder = CommitLog(spark, path), Folder(spark, checkpoint)

    def batch(rows: DataFrame, number: int) -> None:
        name = query_id(folder)
        plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(at_col).cast("long").alias("recorded_at"))
        while (base := log.snapshot()).seen.get(name, -1) < number:
            most = base.state.get("most", 0)
            run = log.write(integrity.skew_flags(plain, ranges=ranges, before=most).select(*FLAGS.names), "flags")
            now = log.read([run], FLAGS).agg(F.max("recorded_at")).first()[0] or 0
            try:
                log.commit(base, {"flags": [run]}, seen=(name, number), state={"most": max(most, now)})
            except Conflict:  # another stream's batch came first
                log.drop([run])

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def skew_flags_so_far(spark: SparkSession, path: str) -> DataFrame:
    """(id, recorded_at, skewed) of all batches that are committed."""
    log = CommitLog(spark, path)
    return log.read(log.snapshot().of("flags"), FLAGS)


def skew_stream(stream: DataFrame, id_col: str = "id", at_col: str = "recorded_at", key_col: str | None = None) -> DataFrame:
    """(key, id, recorded_at, skewed) with the newest time so far of each key as state. Without a key there is one state and
    one task; ``flag_skew`` is the way for one order over all. Late rows are flagged, never dropped, so there is no watermark."""
    keyed = stream.select((F.col(key_col).cast("string") if key_col else F.lit("")).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(at_col).cast("long").alias("recorded_at"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("id")
        before = rows["recorded_at"].cummax().shift(1, fill_value=0).clip(lower=most)
        at = rows["recorded_at"]
        rows["skewed"] = (at != 0) & (before != 0) & (at < before - SKEW_SECONDS)
        state.update((max(most, int(at.max())),))
        yield rows[["key", "id", "recorded_at", "skewed"]]

    return keyed.groupBy("key").applyInPandasWithState(step, "key string, id long, recorded_at long, skewed boolean", "most long", "append", GroupStateTimeout.NoTimeout)


def session_stream(calls: DataFrame, session: str = "session", tool: str = "tool") -> DataFrame:
    """(session, tools): the tools that each session has used so far, updated as calls arrive."""
    return calls.groupBy(session).agg(F.sort_array(F.collect_set(tool)).alias("tools"))
