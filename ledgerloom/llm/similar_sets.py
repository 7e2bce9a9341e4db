"""Documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, all of them.

*Golay codes.* For whole texts, ``simhash`` comes first: fingerprints that differ in 2 bits at most meet under its fuzzy Golay keys, and
so do equal ones; those pairs that the exact check confirms are linked. The fingerprint reaches a part of the similar pairs only, so the keys
below find the others; what the codes have linked already isn't paired again.

*Keys.* Of two such sets in one common order, the first n - ceil(0.8 n) + 1 shingles of each have one in common, so these
are the keys (prefix filter): whatever the order, no similar pair is without a shared key. Nodes are distinct texts, so
exact copies cost one.

*Order.* All shingles of all nodes are counted, exactly; those that more than ``CROWD_KEYS`` nodes hold come last, by their
number of holders, the others by value. So lines that many texts have in common are keys only where a text has little else. There may be any number of common
shingles: each worker holds them, sorted, up to ``HELD_KEYS`` (a checked bound); beyond it they are joined to the shingles. Keys are
made once, in this order, so what is shuffled grows with the texts and not with how many of them meet under common lines.

*Places.* Say the key is the first that two sets have in common in the order, at places i and j (from 1) of n and m. What
lies before isn't in common, so 1 + min(n - i, m - j) is the most that can be; similar sets need 0.8 / 1.8 of n + m. A
pair that is similar passes this at its first common key, which lies in both prefixes, so whatever doesn't pass at a key
needn't be looked at there. The shorter set of a pair then has the key in its first ninth. That takes apart crowds of
near copies with so many words of their own that no two are similar.

*Crowds.* Where more than ``CROWD_KEYS`` hold a key all the same (many near copies), a head is verified
against all under its key that aren't in its component yet, then leaves it; after ``ROUNDS`` rounds all pairs across
components that are left are verified. So no pair is skipped unless its two are linked already.

*Verification* compares sorted arrays of shingle hashes (64 bits). They are larger than the texts and a join carries them for each
pair, so bitmaps of them go first: a bit that only one of two has is an element that the other lacks, and pairs that lack too many are
left out (a proven bound, no similar pair is). Sets are made for the nodes of the pairs that remain.

Defined cases: an empty text and one without words are equal to each other only as texts; fewer words than a shingle has are one shingle;
a text of any length is one set; ids are integers (others are refused with a ValueError); rows without an id take no
part and stay; a row goes only if its own text is a copy, whatever other rows of its id hold; an empty table gives an empty table;
other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bucketed, drop_files, free_name, freed_shuffles, integer_id, materialise, slices, sorted_table, stored_at, text_bytes, total_bytes
from .dedup_index import P1, rolled
from .simhash import SEED, fingerprints, links, star_components

SHINGLE = 5
SIMILARITY = 0.8
CROWD_KEYS = 32
ROUNDS = 1
HELD_KEYS = 4_000_000
#: Text bytes whose shingles meet in one group, about, and hashes that a task gathers before it hands them on.
GROUP_BYTES = 16 << 20
GATHERED = 2 << 20
#: Text bytes of a file of the table of texts, about.
FILE_BYTES = 16 << 20
#: Bits of a bitmap for each element of its set, at least.
BITMAP_BITS = 4


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles' hashes, sorted; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    known = {w: digest(w, SEED) for w in set(words)}
    return np.unique(rolled(np.fromiter((known[w] for w in words), np.uint64, len(words)), shingle, P1).view(np.int64))


def prefix_size(n):
    return n - (4 * n + 4) // 5 + 1


def prefix(hashes: np.ndarray, common: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of n different hashes, by the weight of their upper halves (none: 0), then by value."""
    n = len(hashes)
    if not n:
        return hashes
    if not len(common):
        return np.sort(hashes)[: prefix_size(n)]
    upper = hashes >> 32
    at = np.minimum(np.searchsorted(common, upper), len(common) - 1)
    return hashes[np.lexsort((hashes, np.where(common[at] == upper, weight[at], 0)))[: prefix_size(n)]]


KEYED = "key long, node long, n long, pos int"


def _each_key(batches, shingle: int, common: str | None, whole: bool = False):
    """Arrays of (key, node, n, pos) for slices of the texts, as ``_keys`` has them, and whether each key is among the common ones."""
    order = sorted_table(common, ("key", "held")) if common else (np.zeros(0, np.int64),) * 2
    for batch in slices(batches, "text", 1 << 20):
        found = [shingle_set(t, shingle) for t in text_bytes(batch.column("text"))]
        n = np.array([len(x) for x in found], np.int64)
        found = found if whole else [prefix(x, *order) for x in found]
        taken = np.array([len(x) for x in found], np.int64)
        key = np.concatenate(found)
        pos = np.arange(len(key)) - np.repeat(np.cumsum(taken) - taken, taken) + 1
        known = np.isin(key >> 32, order[0]) if common else np.zeros(len(key), bool)
        yield key, np.repeat(batch.column("node").to_numpy(), taken), np.repeat(n, taken), pos.astype(np.int32), known


def _keys(nodes: DataFrame, shingle: int, common: str | None = None, whole: bool = False) -> DataFrame:
    """Of (node, text): (key, node, n, pos), the shingles of the prefix, or all; n counts all, pos is the key's place in the
    order, from 1. ``common``: the stored table of those that come last; only keys that are in it are returned then."""

    def run(batches):
        for *columns, known in _each_key(batches, shingle, common, whole):
            yield pa.RecordBatch.from_arrays([pa.array(x[known] if common else x) for x in columns], ["key", "node", "n", "pos"])

    return nodes.select("node", "text").mapInArrow(run, KEYED)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, all first bytes, then all second ones and so on, compressed: bytes that hardly vary take no room."""
    return pa.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, kind, n: int) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(pa.decompress(raw, n * kind.itemsize, "zstd", asbytes=True), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _gathered(parts, groups: int, bits: int, n_of):
    """Dealt and packed: of arrays (sorted unsigned numbers first) one row per group, groups being ranges of the numbers."""
    for first, *more in parts:
        group = ((first >> first.dtype.type(bits - 32)).astype(np.uint64) * np.uint64(groups)) >> np.uint64(32)
        cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
        rows = [(int(group[a]), b - a, packed(np.diff(first[a:b], prepend=first.dtype.type(0))), *(packed(x[a:b]) for x in more)) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(first)])] if len(first) else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["group", "rows", *n_of])


def _ungathered(table: pa.Table, kinds: dict) -> list[np.ndarray]:
    """The arrays of a group, sorted by the first one."""
    counts = table.column("rows").to_pylist()
    found = [[unpacked(raw, kind, n) for raw, n in zip(table.column(c).to_pylist(), counts)] for c, kind in kinds.items()]
    first = np.concatenate([np.cumsum(x, dtype=x.dtype) for x in found[0]])
    order = np.argsort(first, kind="stable")
    return [first[order], *(np.concatenate(x)[order] for x in found[1:])]


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each stretch of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _common(nodes: DataFrame, shingle: int, crowd: int, groups: int) -> DataFrame:
    """(key, held): half hashes of shingles that more than ``crowd`` hold, with their number. Each task sorts and counts what it has;
    counts meet in groups of the half hashes' range, packed, so neither rows nor hash tables of single shingles are made."""

    def counts(batches):
        held, n = [], 0
        for batch in slices(batches, "text", 1 << 20):
            for text in text_bytes(batch.column("text")):
                held.append((shingle_set(text, shingle).view(np.uint64) >> np.uint64(32)).astype(np.uint32))
                n += len(held[-1])
            if n >= GATHERED:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, n = [], 0
        if n:
            yield np.unique(np.concatenate(held), return_counts=True)

    def run(batches):
        yield from _gathered(((v, c.astype(np.uint32)) for v, c in counts(batches)), groups, 32, ["half", "held"])

    def summed(table: pa.Table) -> pa.Table:
        half, held = _ungathered(table, {"half": np.uint32, "held": np.uint32})
        first = _runs(half)
        total = np.add.reduceat(held.astype(np.int64), first)
        often = total > crowd
        return pa.table({"key": half[first[often]].view(np.int32), "held": total[often]})

    dealt = nodes.select("node", "text").mapInArrow(run, "group long, rows long, half binary, held binary")
    return dealt.groupBy("group").applyInArrow(summed, "key int, held long")


def _met_keys(nodes: DataFrame, shingle: int, common: str | None, groups: int) -> DataFrame:
    """The keys of ``_keys`` that aren't common and that several nodes have, with their number: (key, node, n, pos, held). As few
    hold any of them, they meet packed, in groups of the keys' range."""

    def sorted_parts(batches):
        held, n = [], 0

        def part():
            key, node, size, pos = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key.view(np.uint64))
            return key.view(np.uint64)[order], node[order], size.astype(np.int32)[order], pos[order]

        for *columns, known in _each_key(batches, shingle, common):
            held.append([x[~known] for x in columns])
            n += len(held[-1][0])
            if n >= GATHERED // 4:
                yield part()
                held, n = [], 0
        if n:
            yield part()

    def run(batches):
        yield from _gathered(sorted_parts(batches), groups, 64, ["key", "node", "n", "pos"])

    def shared(table: pa.Table) -> pa.Table:
        key, *columns = _ungathered(table, {"key": np.uint64, "node": np.int64, "n": np.int32, "pos": np.int32})
        first = _runs(key)
        held = np.diff(np.concatenate([first, [len(key)]]))
        held = np.repeat(held, held)
        key, node, n, pos, held = (x[held > 1] for x in (key.view(np.int64), *columns, held))
        return pa.table({"key": key, "node": node, "n": n.astype(np.int64), "pos": pos, "held": held})

    dealt = nodes.select("node", "text").mapInArrow(run, "group long, rows long, key binary, node binary, n binary, pos binary")
    return dealt.groupBy("group").applyInArrow(shared, f"{KEYED}, held long")


def _ordered_by_join(nodes: DataFrame, shingle: int, common: DataFrame) -> DataFrame:
    """``_keys`` where the common shingles are too many to be held."""
    each = _keys(nodes, shingle, whole=True).select("key", "node", "n", half("key").alias("half")).join(common.toDF("half", "held"), "half", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0).cast("long")).alias("held"), "key")))
    taken = F.slice("_o", F.lit(1), (F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1).cast("int"))
    sets = each.groupBy("node", "n").agg(order.alias("_o")).select("node", "n", F.posexplode(taken))
    return sets.select(F.col("col.key").alias("key"), "node", "n", (F.col("pos") + 1).alias("pos"))


def half(key: str) -> F.Column:
    """The upper 32 bits of a hash."""
    return F.shiftright(key, 32).cast("int")


def shared_keys(keyed: DataFrame, label: str) -> DataFrame:
    """The rows whose key others hold too, with the number of holders; both sides are dealt anew, so Spark splits a hot key."""
    held = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), f"{label}-held")
    shared = materialise(keyed.join(held, "key"), label)
    drop_files(held)
    return shared


def _prefix_keys(nodes: DataFrame, shingle: int, crowd: int, most: int) -> DataFrame:
    """The keys that nodes share, in the order that puts common shingles last, with the number of holders."""
    # by half a hash, which halves what is shuffled: shingles that share one are put last together, and any order is right
    groups = max(1, -(-total_bytes(nodes, "text") // GROUP_BYTES))
    common = materialise(_common(nodes, shingle, crowd, groups), "shingle-common")
    n = common.count()
    found = [] if n > most else [materialise(_met_keys(nodes, shingle, stored_at(common) if n else None, groups), "shingle-met")]
    if n:
        # common ones may be anyone's: as rows, so that Spark splits a hot one
        keyed = materialise(_ordered_by_join(nodes, shingle, common) if n > most else _keys(nodes, shingle, stored_at(common)), "shingle-keys")
        found.append(shared_keys(keyed, "shingle-shared"))
        drop_files(keyed)
    drop_files(common)
    return found[0] if len(found) == 1 else found[0].select(*found[1].columns).union(found[1])


def may_be_similar(n: F.Column, i: F.Column, m: F.Column, j: F.Column) -> F.Column:
    """Whether sets of n and m elements can be similar whose first common one lies at the places i and j."""
    most = F.least(n - i, m - j) + 1
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * most >= 4 * (n + m))


def key_pairs(held: DataFrame) -> DataFrame:
    """All pairs (u, v) of the nodes under each key of (key, node, n, pos, c) that may be similar and whose c differ."""
    names = ["key", "node", "n", "pos", "c"]
    # of two sets the shorter has the key in its first ninth, so only such rows are one side of the join
    short = held.where(9 * (F.col("n") - F.col("pos") + 1) >= 8 * F.col("n"))
    a, b = held.select(*names), short.select(*names).toDF("key", "node2", "m", "pos2", "c2")
    longer = (a["n"] > b["m"]) | (a["n"] == b["m"]) & (a["node"] != b["node2"])
    both = a.join(b, (a["key"] == b["key"]) & longer & (a["c"] != b["c2"]) & may_be_similar(F.col("n"), F.col("pos"), F.col("m"), F.col("pos2")))
    return both.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Of two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for the lower bits of each hash, of a power of two of bits, ``BITMAP_BITS`` for each hash at least."""
    size = max(64, 1 << (BITMAP_BITS * len(hashes) - 1).bit_length())
    marks = np.zeros(size, bool)
    marks[hashes & (size - 1)] = True
    return np.packbits(marks).tobytes()


def bitmaps_may_be_similar(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether sets of n and m elements with these bitmaps can be similar: each bit that only one has is an element, at least, that
    the other lacks."""
    size = min(len(a), len(b))
    x, y = (int.from_bytes(np.bitwise_or.reduce(np.frombuffer(c, np.uint8).reshape(-1, size), axis=0).tobytes(), "little") for c in (a, b))
    most = min(n - (x & ~y).bit_count(), m - (y & ~x).bit_count())
    return 9 * most >= 4 * (n + m)


def _sets_similar(n: int, a: bytes, m: int, b: bytes) -> bool:
    return similar(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))


def _chosen(pairs: DataFrame, nodes: DataFrame, shingle: int, made_of, takes, label: str, out: str) -> DataFrame:
    """Of (u, v) those that ``takes`` takes, by the sizes of both shingle sets and what ``made_of`` makes of each, once for a node."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    def make(batches):
        for batch in slices(batches, "text", 1 << 20):
            found = [shingle_set(t, shingle) for t in text_bytes(batch.column("text"))]
            columns = [batch.column("node"), pa.array([len(x) for x in found], pa.int64()), pa.array([made_of(x) for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "made"])

    some = nodes.select("node", "text").join(wanted, "node", "left_semi").mapInArrow(make, "node long, n long, made binary")
    some = materialise(some, label)
    full = pairs.join(some.toDF("u", "n", "a"), "u").join(some.toDF("v", "m", "b"), "v")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = zip(*(part.column(c).to_pylist() for c in ("n", "a", "m", "b")))
                taken = pa.array([takes(*x) for x in both], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("u").filter(taken), part.column("v").filter(taken)], ["u", "v"])

    chosen = materialise(full.select("u", "v", "n", "a", "m", "b").mapInArrow(run, "u long, v long"), out)
    drop_files(some)
    return chosen


def verified(pairs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Of (u, v) those whose shingle sets are similar; nodes: (node, text)."""
    pairs = materialise(pairs, "similar-pairs")
    likely = _chosen(pairs, nodes, shingle, bitmap, bitmaps_may_be_similar, "similar-bitmaps", "similar-likely")
    drop_files(pairs)
    edges = _chosen(likely, nodes, shingle, np.ndarray.tobytes, _sets_similar, "similar-sets", "similar-edges")
    drop_files(likely)
    return edges


def _reach(rest: DataFrame, edges: DataFrame, nodes: DataFrame, shingle: int, rounds: int) -> DataFrame:
    """(u, v) of ``star_components``, of the edges and of more for the crowded keys of (key, node, n, pos), until none has an
    unverified pair across components."""
    for i in range(rounds + 1):
        reach = star_components(edges)
        group = rest.join(reach.toDF("node", "c"), "node", "left").select("key", "node", "n", "pos", F.coalesce("c", "node").alias("c"))
        group = materialise(group, "crowd-components")
        by = F.struct("pos", F.xxhash64("node"))  # the one with the fewest shingles of its own is like most others
        head = F.min_by(F.struct("node", "n", "pos", "c"), by).alias("head")
        some = group.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), head).where("lo <> hi")
        some = materialise(group.join(materialise(some.select("key", "head"), "crowd-open"), "key"), "crowd-group")
        drop_files(group)
        if some.isEmpty():
            return reach
        if i == rounds:
            return star_components(reach.union(verified(key_pairs(some), nodes, shingle)))
        apart = (F.col("c") != F.col("head.c")) & may_be_similar(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos"))
        pairs = some.where(apart).select(F.greatest("node", "head.node").alias("u"), F.least("node", "head.node").alias("v")).distinct()
        edges = reach.union(verified(pairs, nodes, shingle))  # its stars hold what the edges before linked
        rest = materialise(some.where("node <> head.node").select("key", "node", "n", "pos"), "crowd-rest")


def linked_nodes(nodes: DataFrame, shingle: int = SHINGLE, edges: DataFrame | None = None, crowd: int = CROWD_KEYS, rounds: int = ROUNDS, most: int = HELD_KEYS) -> DataFrame:
    """(u, v) of ``star_components`` over all similar pairs of (node, text) and the edges given; pairs that these link
    already aren't looked at."""
    shared = _prefix_keys(nodes, shingle, crowd, most)
    if edges is None:
        shared = shared.withColumn("c", F.col("node"))
    else:
        before = shared
        shared = materialise(shared.join(edges.toDF("node", "c"), "node", "left").withColumn("c", F.coalesce("c", "node")), "shingle-shared")
        drop_files(before)
    found = verified(key_pairs(shared.where(F.col("held") <= crowd)), nodes, shingle)
    return _reach(shared.where(F.col("held") > crowd).select("key", "node", "n", "pos"), found if edges is None else found.union(edges), nodes, shingle, rounds)


def golay_links(nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(u, v) of ``star_components`` over the pairs of (node, text) that meet under a fuzzy Golay key and are similar."""
    worded = nodes.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # texts without words are alike only as texts
    found = materialise(fingerprints(worded, "node").select(F.col("doc_id").alias("node"), "fp"), "golay-prints")
    first = materialise(found.groupBy("fp").agg(F.min("node").alias("head")), "golay-nodes")
    same = found.join(first, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    near = links(first.select("fp", F.col("head").alias("node")))
    linked = star_components(verified(near.union(same), nodes, shingle))
    drop_files(found)
    drop_files(first)
    return linked


def text_id(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _with_text_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.where(F.col(id_col).isNotNull()).select(integer_id(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.withColumn("text_id", text_id(F.col("text")))


def _similar_texts(base: DataFrame, **how) -> DataFrame:
    """(text_id, component_id) of (doc_id, text, text_id): the smallest doc_id of the texts that each text reaches."""
    with freed_shuffles(base.sparkSession):
        texts = base.groupBy("text_id").agg(F.min("doc_id").alias("first_id"), F.first("text").alias("text"))
        numbered = materialise(texts.withColumn("node", F.monotonically_increasing_id()), "text-nodes")
        # texts are dealt once by their number, so those that are wanted later are found without being shuffled again
        # (fewer files than a shuffle's partitions would be shuffled all the same, for parallelism)
        size, parts = total_bytes(numbered, "text"), int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        table = Bucketed(numbered, "node", max(1, -(-size // FILE_BYTES), min(parts, 4 * size // FILE_BYTES)), "text-table")
        drop_files(numbered)
        nodes = table.rows
        reach = linked_nodes(nodes, edges=golay_links(nodes, how.get("shingle", SHINGLE)), **how)
        named = nodes.select("node", "text_id", "first_id").join(reach.toDF("node", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        named = materialise(named, "similar-named")
        table.drop()
        least = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
        return materialise(named.join(least, "c").select("text_id", "component_id"), "similar-components")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, component_id) of the documents that are similar to one with a smaller id, directly or by others."""
    base = _with_text_id(docs, id_col, text_col)
    found = base.select("doc_id", "text_id").join(_similar_texts(base, **how), "text_id").where("doc_id <> component_id")
    return found.select("doc_id", "component_id").distinct()


def keep_similar_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of similar ones stays, that of the smallest id; columns as they are."""
    base = _with_text_id(docs, id_col, text_col)
    # without distinct, so that Spark may split the join at a text that very many rows hold
    gone = base.join(_similar_texts(base), "text_id").where("doc_id <> component_id").select("doc_id", "text_id")
    own, text = free_name(docs.columns, "gone_id"), free_name(docs.columns, "gone_text")
    gone = materialise(gone, "similar-gone").toDF(own, text)
    same = (docs[id_col].cast("long") == gone[own]) & (text_id(docs[text_col]) == gone[text])
    return docs.join(gone, same, "left_anti")
