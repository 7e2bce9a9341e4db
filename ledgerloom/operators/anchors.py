"""Anchors: signed states of a journal's prefix, from which verification goes on.

An anchor says of the first n rows: the last id, its HMAC, and the peaks of their Merkle tree, that is the roots of its perfect
subtrees, largest first; it is signed with the journal's key. New rows extend the peaks without the old ones being read, and the root
of all follows from the peaks. Kept elsewhere (a note of a commit), an anchor shows that rows are missing at the end,
which a chain of signatures alone can't.
"""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import integrity

FIELDS = ("id", "hmac", "n", "peaks")


def _node(a: str, b: str) -> str:
    return hashlib.sha256(bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()


def pushed(peaks: list[list], height: int, node: str) -> list[list]:
    """The peaks [[height, hash], ...] with the next perfect subtree; heights fall from left to right."""
    peaks = [*peaks]
    while peaks and peaks[-1][0] == height:
        node = _node(peaks.pop()[1], node)
        height += 1
    return [*peaks, [height, node]]


def root(peaks: list[list]) -> str:
    """The root that pairing level by level gives, where an odd node is carried up."""
    out = ""
    for _, node in reversed(peaks):
        out = _node(node, out) if out else node
    return out


def peaks(rows: DataFrame, before: int = 0, known: list[list] | None = None) -> list[list]:
    """The peaks after rows (id, hmac) that follow ``before`` others in order of their ids. Aligned blocks of 4,096 are folded by
    Spark; what comes to the driver is a row per block, and the rows of the two ends that fill none."""
    block, size = integrity.MERKLE_BLOCK, integrity.MERKLE_BLOCK.bit_length() - 1
    n = rows.count()
    leaves = integrity.dense_positions(rows, "id").select((F.col("_pos") + before).alias("i"), F.when(F.col("hmac") == "", F.sha2(F.lit(""), 256)).otherwise(F.col("hmac")).alias("h"))
    low, high = -(-before // block) * block, (before + n) // block * block
    if high <= low:
        low = high = before + n
    leaves = leaves.cache() if low < before + n and n else leaves
    out = [*(known or [])]
    ends = leaves.where((F.col("i") < low) | (F.col("i") >= high)).orderBy("i").collect()  # fewer than two blocks
    for r in ends:
        if r["i"] < low:
            out = pushed(out, 0, r["h"])
    if low < high:
        whole = leaves.where((F.col("i") >= low) & (F.col("i") < high)).withColumn("b", F.floor(F.col("i") / block))
        for r in integrity.merkle_root(whole, "i", "h", ("b",)).orderBy("b").toLocalIterator():  # a row per block
            out = pushed(out, size, r["root"])
    for r in ends:
        if r["i"] >= low:
            out = pushed(out, 0, r["h"])
    leaves.unpersist()
    return out


def _text(anchor: dict) -> bytes:
    return json.dumps([anchor[k] for k in FIELDS], separators=(",", ":")).encode()


def signed(anchor: dict, key: bytes) -> dict:
    return {k: anchor[k] for k in FIELDS} | {"root": root(anchor["peaks"]), "signature": hmac.new(key, b"anchor:" + _text(anchor), hashlib.sha256).hexdigest()}


def holds(anchor: dict, key: bytes) -> bool:
    """Whether an anchor was signed with this key and not changed since."""
    try:
        return hmac.compare_digest(signed(anchor, key)["signature"], anchor["signature"])
    except (KeyError, TypeError):
        return False


def findings_after(rows: DataFrame, anchor: dict, key: bytes) -> DataFrame:
    """Findings of the rows after an anchor; rows: those from its last one on, at least."""
    if not holds(anchor, key):
        raise ValueError("the anchor isn't signed with this key")
    spark, at = rows.sparkSession, anchor["id"]
    tail = rows.where(F.col("id") >= at)
    last = tail.where(F.col("id") == at).select("hmac").first() if at else None
    kind = None
    if at and last is None:
        kind = f"rows up to {at} were signed and the last isn't there"
    elif at and last["hmac"] != anchor["hmac"]:
        kind = "the last signed row has another HMAC"
    cut = spark.createDataFrame([(at, "cut", kind)] if kind else [], "id long, kind string, detail string")
    return cut.union(integrity.findings(tail, key).where(F.col("id") > at))
