"""Tamper evidence: signed chains, clock checks, Merkle roots."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crypto import SIGNED, hmac_sha256, signed_payload
from .ordered import look_back

SKEW_SECONDS = 5
MERKLE_BLOCK = 1 << 12
FINDING = "array<struct<kind:string,detail:string>>"


def findings(changes: DataFrame, key: bytes, payload: Column | None = None, ranges: int = 64) -> DataFrame:
    """(id, kind, detail): up to three per row. A row without hmac has one, and the next row must then have no
    predecessor's; else the link to the row before, the row's own hmac and its clock are judged, each for itself."""
    seen = look_back(changes, "id", {"_hmac": F.coalesce("hmac", F.lit("")), "_at": F.col("recorded_at")}, ranges=ranges)
    expected = hmac_sha256(signed_payload() if payload is None else payload, key)
    own, prev = F.coalesce("hmac", F.lit("")), F.coalesce("prev_hmac", F.lit(""))
    when = lambda cond, kind, detail: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(detail).alias("detail")))
    missing = F.array(when(own == "", "unsigned", "row has no HMAC"))
    judged = F.array(
        when(F.col("_hmac").isNotNull() & (prev != F.col("_hmac")), "link", "previous HMAC differs"),
        when(own != expected, "content", "HMAC differs from content"),
        when(F.col("recorded_at") < F.col("_at"), "clock", "recorded time goes backwards"),
    )
    rows = seen.withColumn("_f", F.array_compact(F.when(own == "", missing).otherwise(judged)))
    return rows.select("id", F.inline("_f"))


def skew_flags(changes: DataFrame, order: str = "id", at: str = "recorded_at", tolerance: int = SKEW_SECONDS, ranges: int = 64, before: int = 0) -> DataFrame:
    """The input with ``skewed``: recorded over five seconds before the newest time of any earlier row, or of ``before``, the newest
    time of all that came earlier."""
    seen = look_back(changes, order, {}, {"_most": F.col(at)}, ranges=ranges)
    most = F.greatest(F.col("_most"), F.lit(before)) if before else F.col("_most")
    return seen.withColumn("skewed", F.coalesce((F.col(at) != 0) & (most != 0) & (F.col(at) < most - tolerance), F.lit(False))).drop("_most")


def merkle_root(leaves: DataFrame, order: str, leaf: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, root) by pairwise reduction in order; an odd node is carried up as it is. ``leaf``: hex digests.

    Without groups, blocks of ``MERKLE_BLOCK`` dense positions are folded where they are, so a round leaves a row per
    block: three rounds for 10^10 rows. Blocks are aligned, so this is the tree that level by level would give. With groups,
    each group's leaves are folded where they are (groups are meant to be small: rows of a commit)."""
    if groups:
        return _folded(leaves, groups, order, leaf)
    level = dense_positions(leaves, order).select(F.col("_pos").alias("i"), F.col(leaf).alias("h"))
    n = leaves.count()
    while n > 1:
        level = _folded(level.withColumn("block", F.floor(F.col("i") / MERKLE_BLOCK)), ("block",), "i", "h", MERKLE_BLOCK).select(F.col("block").alias("i"), F.col("root").alias("h"))
        n = -(-n // MERKLE_BLOCK)
        if n > 1 and leaves.sparkSession.sparkContext.getCheckpointDir():
            level = level.checkpoint()
    return level.select(F.col("h").alias("root"))


def _folded(leaves: DataFrame, groups: tuple[str, ...], order: str, leaf: str, most: int | None = None) -> DataFrame:
    """(groups, root) of each group's leaves in order; ``most``: how many a group can have, if that is known."""
    pair = lambda xs: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / 2).cast("int")),
        lambda i: F.when(2 * i + 1 < F.size(xs), F.sha2(F.concat(F.unhex(F.get(xs, 2 * i)), F.unhex(F.get(xs, 2 * i + 1))), 256)).otherwise(F.get(xs, 2 * i)),
    )
    sorted_leaves = F.transform(F.array_sort(F.collect_list(F.struct(order, leaf))), lambda s: s[leaf])
    out = leaves.groupBy(*groups).agg(sorted_leaves.alias("_xs"))
    levels = most or out.agg(F.max(F.size("_xs"))).first()[0] or 1
    for _ in range(max(0, (levels - 1).bit_length())):
        out = out.withColumn("_xs", F.when(F.size("_xs") > 1, pair(F.col("_xs"))).otherwise(F.col("_xs")))
    return out.select(*groups, F.get("_xs", F.lit(0)).alias("root"))


def dense_positions(df: DataFrame, order: str, ranges: int = 64) -> DataFrame:
    """The input with ``_pos``: 0, 1, 2, ... by ``order`` (unique), counted range by range."""
    from pyspark.sql import Window as W

    cuts = sorted(set(df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first()["q"] or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    cut = df.withColumn("_part", part)
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row per range
    return cut.withColumn("_r", F.row_number().over(W.partitionBy("_part").orderBy(order))).join(F.broadcast(starts), "_part").withColumn("_pos", F.col("_base") + F.col("_r") - 1).drop("_part", "_r", "_base")


def python_payload(row: dict) -> str:
    """The payload of ``signed_payload`` for one row, for folds that can't be columns."""
    text = json.dumps({k: (row[k] or 0) if k == "recorded_at" else (row[k] or "") for k in SIGNED}, ensure_ascii=False, separators=(",", ":"))
    for ch in "<>&\u2028\u2029":
        text = text.replace(ch, f"\\u{ord(ch):04x}")
    return text


def sign(changes: DataFrame, key: bytes, previous: str = "") -> DataFrame:
    """Rows with ``hmac`` and ``prev_hmac`` set along the ids. A chain is one after the other by definition: one writer,
    one task, streamed in order; a journal is signed as it grows, so this sees a batch at a time."""
    names = changes.columns

    def run(batches):
        last = previous
        for pdf in batches:
            prevs, own = [], []
            for row in pdf.to_dict("records"):
                row = {k: None if isinstance(v, float) and pd.isna(v) else v for k, v in row.items()} | {"prev_hmac": last}
                prevs.append(last)
                last = _hmac.new(key, python_payload(row).encode(), hashlib.sha256).hexdigest()
                own.append(last)
            pdf["prev_hmac"], pdf["hmac"] = prevs, own
            yield pdf[names]

    return changes.orderBy("id").coalesce(1).sortWithinPartitions("id").mapInPandas(run, T.StructType(changes.schema.fields))


def rotate(changes: DataFrame, old_key: bytes, new_key: bytes, force: bool = False) -> DataFrame:
    """The whole journal signed anew; refused if the old chain has findings, unless forced."""
    if not force and findings(changes, old_key).limit(1).count():
        raise ValueError("the chain doesn't verify; nothing was signed")
    return sign(changes, new_key)
