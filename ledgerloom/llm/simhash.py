"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, a majority vote of the XXH64 values of word shingles. Two fingerprints link if they differ in
2 bits at most. Cut into three segments (22, 21, 21 bits), two such fingerprints agree in at least one segment, and in
each of the others differ in 2 bits at most. The perfect binary Golay code (23, 12) turns that into equality: a segment,
filled up with zeros, and each word one bit away from it decode to a handful of codewords (six at most); two segments
that differ in 2 bits have a word between them, so they share a codeword. A key is (which segment agrees, that segment,
a codeword of the next one): 33 or more bits, up to 18 keys a fingerprint, and every link shares one.

Only distinct fingerprints take part, so exact copies cost one row. Keys held by few are joined and verified pair by
pair. Keys held by more than ``CROWD`` fingerprints aren't: each of their fingerprints names itself and its 64
neighbours one bit away; those that name the same word differ in 2 bits at most by construction, there are 65 of them
at most, and linking each to the smallest links all. So no crowd makes pairs, and none is cut off.

Components: rounds of large-star and small-star steps over the links, each written to the shared folder; every node
ends up with the smallest id that it can reach. Joins on a node's id spread heavy nodes over ``SALTS`` parts.

Defined cases: a null or empty text has fingerprint zero, linked like any other; a text of any length is one fingerprint; ids are integers (others are refused with a ValueError); rows with equal ids are one node, which
links whatever any of them links; a null id takes no part in links and has component null unless others share its
fingerprint's component; repeated rows keep a row each; an empty table gives an empty table; other columns are ignored
by ``components`` and kept, whatever their names, by ``keep_first``. Similar documents are in ``similar_sets``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_files, free_name, integer_id, materialise, slices, text_bytes

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CROWD = 64
SALTS = 8
GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long. One pass, no shuffle."""

    def run(batches):
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# the Golay code


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of each byte of a word, and the error of at most 3 bits for each remainder."""
    by_byte = np.array([[_remainder((b << s) & 0x7FFFFF) for b in range(256)] for s in (0, 8, 16)], np.int32)
    error = np.zeros(2048, np.int32)
    one = [1 << i for i in range(23)]
    for v in [*one, *(a | b for a in one for b in one if a < b), *(a | b | c for a in one for b in one for c in one if a < b < c)]:
        error[_remainder(v)] = v
    return by_byte, error


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words: the 12 leading bits of the one codeword within 3 bits."""
    by_byte, error = _tables()
    syndrome = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    return (words ^ error[syndrome]) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each key of each fingerprint; fp: unsigned."""
    segment = [(fp >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, found = [], []
    for i in range(3):
        j = (i + 1) % 3
        flips = np.array([0, *(1 << b for b in range(SEGMENTS[j][1]))], np.int64)
        index = np.sort(codeword_index(segment[j][:, None] ^ flips[None, :]), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(new)
        rows.append(row)
        found.append((i << 36) | (segment[i][row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                row, key = keys(part.column("fp").to_numpy().view(np.uint64))
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column("fp").take(taken), part.column("node").take(taken)], ["key", "fp", "node"])

    return nodes.select("fp", "node").mapInArrow(run, "key long, fp long, node long")


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Linked nodes as distinct (u, v), u > v; nodes: distinct fp with their node. All components stay connected."""
    keyed = materialise(_keyed(nodes), "simhash-keys")
    held = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialise(held, "simhash-held")
    few = keyed.join(held.where(F.col("n") <= crowd), "key", "left_semi")
    a, b = few.toDF("key", "fp", "node"), few.toDF("key", "fp2", "node2")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= DISTANCE
    pairs = a.join(b, (a["key"] == b["key"]) & (a["fp"] < b["fp2"]) & near).select("node", "node2")
    many = keyed.join(held.where(F.col("n") > crowd), "key", "left_semi").select("fp", "node").distinct()
    around = F.array(*(F.lit(x) for x in [0, *(1 << b for b in range(63)), -1 << 63])).cast("array<long>")
    named = many.select("node", F.explode(F.transform(around, lambda x: F.col("fp").bitwiseXOR(x))).alias("word"))
    stars = named.withColumn("node2", F.min("node").over(W.partitionBy("word"))).where("node != node2").select("node", "node2")
    both = pairs.union(stars).where("node != node2")
    return both.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct()


def _least(edges: DataFrame, salts: int) -> DataFrame:
    """(u, v, m): each edge with the smallest neighbour of u; heavy nodes are spread by salt."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return edges.withColumn("_s", F.pmod(F.hash("v"), F.lit(salts))).join(least, ["u", "_s"]).drop("_s")


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node above another has a second edge: then each component is a star around its smallest id."""
    ends = edges.select(F.col("u").alias("node"), F.lit(True).alias("above")).union(edges.select("v", F.lit(False)))
    held = ends.groupBy("node").agg(F.bool_or("above").alias("above"), F.count(F.lit(1)).alias("n"))
    return held.agg(F.count_if(F.col("above") & (F.col("n") > 1))).first()[0] == 0


def star_components(edges: DataFrame, salts: int = SALTS) -> DataFrame:
    """(u, v): v is the smallest id that u reaches, for each u that isn't itself the smallest. Edges: (u, v), u > v."""
    now = materialise(edges.select("u", "v"), "edges")
    while not _are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, salts).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = materialise(large, "edges")
        small = _least(large, salts).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = materialise(small.union(large.groupBy("u").agg(F.min("v").alias("v"))).distinct(), "edges")
        drop_files(now)
        drop_files(large)
        now = step
    return now


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """Per document: fingerprint (16 hex digits) and the smallest doc_id that its links reach."""
    found = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    known = nodes.where("node is not null")
    # rows of one id are one node: each of their fingerprints links to it
    many = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("doc_id")
    same = found.join(many, "doc_id", "left_semi").join(known, "fp").where("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    reach = star_components(links(known, crowd).union(same).distinct())
    named = nodes.join(reach, nodes["node"] == reach["u"], "left").select("fp", F.coalesce("v", "node").alias("component_id"))
    named = materialise(named, "simhash-components")  # both sides of the join are dealt anew, so Spark splits a hot fingerprint
    return found.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One document of each component stays, that of the smallest id; columns as they are."""
    own = free_name(docs.columns, "gone")
    gone = components(docs, id_col, text_col, shingle).where("doc_id != component_id").select(F.col("doc_id").alias(own)).distinct()
    gone = materialise(gone, "simhash-gone")
    return docs.join(gone, docs[id_col] == gone[own], "left_anti")
