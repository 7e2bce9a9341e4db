"""HyperMinHash near-duplicates: documents whose sets of two-word shingles have a Jaccard similarity of 0.8 or more.

*Registers.* A set's hashes are dealt to ``BUCKETS`` buckets by their leading bits. A bucket keeps, of its smallest hash, the
number of leading zeros and the ``MANTISSA`` bits after the first one: 16 bits instead of 64. An empty bucket takes
the register of the first bucket that isn't empty in a fixed order of its own, so small sets fill all registers, and two registers
of the same place agree with a probability close to the similarity of the sets, whatever their sizes.

*Bands.* ``ROWS`` registers in a row are a key; two sets of similarity 0.8 share none of ``BANDS`` keys with probability
(1 - 0.8^4)^32 < 5e-8. Nodes are distinct shingle sets, so exact copies, and texts that differ only in order or repeats of shingles,
cost one.

*Estimate.* Of a candidate pair the registers that agree are counted, less those that are expected to agree by chance (two
different smallest hashes can have the same zeros and mantissa; how often follows from the sizes of the sets, which are
known), and put in relation to all. A pair is verified on its whole sets if the estimate is no further than
``MARGIN`` = 0.175 below 0.8: seven standard deviations of a count over 256 registers at that similarity.

*Tables.* Texts are dealt once, by row; sketches are made there, so texts and registers of the rows that take part in pairs are
found without being shuffled again.

*Crowds.* Each node is verified against one head among its keys first, the head of a key being the one whose number's hash is smallest; what links is one component. Then, under keys of at
most ``CROWD`` nodes, all pairs across components are candidates. Nodes of larger keys that still hold several components go
through the exact search of ``similar_sets``, a prefix filter, which makes no pairs of a crowd that isn't similar. No pair is
left out but those that are linked already.

Defined cases: null and empty texts and those without words have no set, link with nothing, are their own component and are kept; a single word is one
shingle; a text of any length is one set; rows of equal ids are linked with each other by their id (each row that has a set); ids that aren't
integers are refused; a row without an id takes part, and has the smallest id that it reaches, or null, and then is kept; repeated rows keep a
row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bucketed, drop_files, integer_id, materialise, slices, text_bytes, total_bytes
from .similar_sets import linked_nodes, shared_keys, shingle_set, verified
from .simhash import star_components

SHINGLE = 2
SIMILARITY = 0.8
BUCKETS = 256
MANTISSA = 10
ROWS = 4
BANDS = 32
MARGIN = 0.175
#: Text bytes of a file of the table of sketches, about.
FILE_BYTES = 16 << 20
CROWD = 32
REST_BITS = 48  # of a hash, after the bits of its bucket, that count


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern in any bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def probes() -> np.ndarray:
    """For each bucket, all buckets in an order of its own."""
    b = np.arange(BUCKETS, dtype=np.uint64)
    return np.argsort(mixed(b[:, None] * np.uint64(BUCKETS) + b[None, :] + np.uint64(1)), axis=1).astype(np.int16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes (at least one)."""
    h = np.sort(mixed(hashes))
    bucket = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = (h[first] & np.uint64((1 << 56) - 1)) >> np.uint64(56 - REST_BITS)
    zeros = REST_BITS - np.frexp(rest.astype(np.float64))[1]  # rest is exact in a double
    shifted = rest << zeros.astype(np.uint64)
    tail = (shifted >> np.uint64(REST_BITS - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(BUCKETS, np.uint16)
    out[bucket[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | tail).astype(np.uint16)
    filled = np.zeros(BUCKETS, bool)
    filled[bucket[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = probes()[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A key per band, a row per set."""
    wide = regs[:, : ROWS * BANDS].astype(np.uint64).reshape(len(regs), BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(7)), wide.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key ^ wide[:, :, r])
    return key.view(np.int64)


def chance_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of disjoint sets of n and m hashes agree.

    The smallest of a hashes of a bucket, as shares of its range, has the density a (1 - x)^(a - 1); a is how
    many a bucket has that isn't empty. Cells at z leading zeros are 2^-(z + 1 + MANTISSA) wide, so both fall into one cell there with the
    width times the integral of the product of both densities."""
    a, b = (k / BUCKETS / -np.expm1(-k / BUCKETS) for k in (n, m))
    power = (a + b - 1)[:, None]
    z = np.arange(REST_BITS)
    upper, width = 2.0**-z, 2.0 ** -(z + 1.0 + MANTISSA)
    return (width * (a * b)[:, None] / power * ((1 - upper / 2) ** power - (1 - upper) ** power)).sum(1)


def estimates(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (a row per pair) and the sizes of the sets: C of K agree, of the others' K - K J a share by chance."""
    agree, rate = (x == y).mean(1), chance_rate(n, m)
    return (agree - rate) / (1 - rate)


SKETCH = "row long, doc_id long, text string, set_id binary, n int, regs binary"


def _sketch(batches):
    """(row, doc_id, text, set_id, n, regs); n = 0 and an empty set_id without words."""
    for batch in slices(batches, "text", 1 << 20):
        sets = [shingle_set(t, SHINGLE) for t in text_bytes(batch.column("text"))]
        ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets]
        regs = [registers(s).tobytes() if len(s) else b"" for s in sets]
        own = [pa.array(ids, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(regs, pa.binary())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "text")), *own], ["row", "doc_id", "text", "set_id", "n", "regs"])


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _band_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, n) for each band of each node."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                taken = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(_regs(part.column("regs"))).ravel()), part.column("node").take(taken), part.column("n").take(taken)], ["key", "node", "n"])

    return nodes.select("node", "n", "regs").mapInArrow(run, "key long, node long, n int")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of (u, v) those whose estimate isn't too far below the similarity."""
    pairs = materialise(pairs, "band-pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sketch = materialise(nodes.select("node", "n", "regs").join(wanted, "node", "left_semi"), "band-sketches")
    both = pairs.join(sketch.toDF("u", "n", "x"), "u").join(sketch.toDF("v", "m", "y"), "v").select("u", "v", "n", "m", "x", "y")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(c).to_numpy().astype(np.float64) for c in ("n", "m"))
                chosen = pa.array(estimates(_regs(batch.column("x")), _regs(batch.column("y")), n, m) >= SIMILARITY - MARGIN)
                yield pa.RecordBatch.from_arrays([batch.column("u").filter(chosen), batch.column("v").filter(chosen)], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _sizes_fit(n: str, m: str) -> F.Column:
    return (5 * F.col(n) >= 4 * F.col(m)) & (5 * F.col(m) >= 4 * F.col(n))


def linked_sets(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, v) of ``star_components`` over all similar pairs of (node, text, n, regs), a table dealt by node."""
    shared = shared_keys(_band_keys(nodes), "bands")
    by = F.xxhash64("node")
    heads = materialise(shared.groupBy("key").agg(F.min_by(F.struct("node", "n"), by).alias("head")), "band-heads")
    # one head for each node: the same one in most of its keys
    near = shared.join(heads, "key").where((F.col("node") != F.col("head.node")) & (5 * F.col("n") >= 4 * F.col("head.n")) & (5 * F.col("head.n") >= 4 * F.col("n")))
    first = near.groupBy("node").agg(F.min_by("head.node", F.xxhash64("head.node")).alias("other")).select(*_pair("node", "other")).distinct()
    stars = star_components(verified(_likely(first, nodes), nodes, SHINGLE))
    group = materialise(shared.join(stars.toDF("node", "c"), "node", "left").select("key", "node", "n", F.coalesce("c", "node").alias("c")), "band-components")
    size = group.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("held")).where("lo <> hi")
    open_keys = materialise(size.select("key", "held"), "band-open")
    few = materialise(group.join(open_keys.where(F.col("held") <= crowd), "key").select("key", "node", "n", "c"), "band-few")
    a, b = few, few.toDF("key", "node2", "m", "c2")
    pairs = a.join(b, (a["key"] == b["key"]) & (a["node"] > b["node2"]) & (a["c"] != b["c2"]) & _sizes_fit("n", "m")).select(*_pair("node", "node2")).distinct()
    found = verified(_likely(pairs, nodes), nodes, SHINGLE)
    stars = star_components(stars.union(found))
    many = group.join(open_keys.where(F.col("held") > crowd), "key").select("key", "node").join(stars.toDF("node", "c"), "node", "left")
    still = many.groupBy("key").agg(F.min(F.coalesce("c", "node")).alias("lo"), F.max(F.coalesce("c", "node")).alias("hi")).where("lo <> hi").select("key")
    rest = materialise(many.join(still, "key", "left_semi").select("node").distinct(), "band-rest")
    if not rest.isEmpty():
        some = materialise(nodes.select("node", "text").join(rest, "node", "left_semi"), "band-texts")
        stars = linked_nodes(some, SHINGLE, stars)
        drop_files(some)
    for t in (shared, heads, group, open_keys, few, rest):
        drop_files(t)
    return stars


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Per document: size of its set, the smallest doc_id that its links reach, whether it is that document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = Bucketed(rows, "row", max(1, -(-total_bytes(docs, text_col) // FILE_BYTES)), "sketches", _sketch, SKETCH)
    found = table.rows
    # a set's node is one of its rows
    sets = materialise(found.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("node")), "set-nodes")
    nodes = found.withColumnRenamed("row", "node").join(sets.select("node"), "node", "left_semi")
    reach = linked_sets(nodes, crowd)
    named = sets
    # rows of one id are linked by it: an edge from each of their sets to the smallest
    own = found.where("n > 0 and doc_id is not null").select("doc_id", "set_id")
    many = own.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a <> b").select("doc_id")
    held = materialise(own.join(many, "doc_id", "left_semi").join(named, "set_id").select("doc_id", "node"), "set-ids")
    if not held.isEmpty():
        least = held.groupBy("doc_id").agg(F.min("node").alias("v"))
        same = held.join(least, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
        reach = star_components(reach.union(same))
    named = named.join(reach.toDF("node", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    named = materialise(named, "set-components")
    least = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    named_sets = materialise(named.join(least, "c").select("set_id", "component_id"), "set-names")
    out = found.select("doc_id", "n", "set_id").join(named_sets, "set_id", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
    out = materialise(out, "near-duplicates")
    for t in (sets, held, named, named_sets, reach):
        drop_files(t)
    table.drop()
    return out
