"""An inverted index that grows by batches and answers the queries of ``operators.search``.

A run holds the postings of one batch: (token, key, column, positions), in folders by a bucket that the token's first two
letters give, sorted by token, so a word or a prefix of two letters reads one bucket, and of its files the row groups that may
hold it. Beside them lie the batch's document frequencies, bucketed alike. Runs of a level become one of the next when there are
``FANOUT`` of them.

A query becomes a tree. The words that every match must have are looked up in order of their frequency, rarest first;
each narrows the keys that are left by a semi-join. The postings of all words of the query, of those keys only, are put
together per key, and the tree is evaluated on positions: a phrase is a merge of positions, NEAR a comparison of them. Keys are
broadcast while the rarest word has no more than ``FEW`` (a checked bound), else joined.

A key stands for one row; a key that is added twice is found by what either batch had.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import search
from .commit_log import FANOUT, CommitLog, Conflict, Snapshot

BUCKETS = 64
FEW = 100_000
#: Postings of a file, about.
FILE_ROWS = 2_000_000
STATS = T.StructType([T.StructField("token", T.StringType()), T.StructField("df", T.LongType()), T.StructField("bucket", T.IntegerType())])


def bucket(token: Column | str, buckets: int = BUCKETS) -> Column:
    token = F.col(token) if isinstance(token, str) else token
    return (F.crc32(F.substring(token, 1, 2).cast("binary")) % buckets).cast("int")


def grouped(t: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.ListArray]:
    """Of rows' tokens: for each row and each different token of it, the row's number, the token and its places in the row, in order."""
    ends = np.concatenate([[0], np.cumsum(t.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    coded = t.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(t)), np.diff(ends))
    place = np.arange(len(code)) - ends[row]
    both = row * max(1, len(coded.dictionary)) + code
    order = np.argsort(both, kind="stable")
    first = np.flatnonzero(np.diff(both[order], prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    return pa.array(row[order][first]), coded.dictionary.take(pa.array(code[order][first])), lists


def positions(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(token, key, column, positions) of each token of each row. A row's own tokens are sorted within the row, so nothing is shuffled
    and the work grows with the text, not with its words times its different words."""
    listed = F.array(*(F.struct(F.lit(c).alias("column"), search.tokens(c).alias("t")) for c in columns))
    each = rows.select(F.col(key).alias("key"), F.explode(listed).alias("c")).select("key", "c.column", F.col("c.t").alias("t"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, token, places = grouped(part.column("t"))
                yield pa.RecordBatch.from_arrays([token.cast(pa.string()), part.column("key").take(row), part.column("column").take(row), places], ["token", "key", "column", "positions"])

    return each.mapInArrow(run, f"token string, key {each.schema['key'].dataType.simpleString()}, column string, positions array<int>")


def needed(tree: tuple) -> set[tuple[str, bool]]:
    """The words (and whether they are prefixes) that every match has."""
    kind = tree[0]
    if kind in ("term", "near"):
        return {w for words, prefix in ([tree[1:3]] if kind == "term" else tree[1]) for w in _words(words, prefix)}
    left, right = needed(tree[1]), needed(tree[2])
    return left | right if kind == "and" else left & right if kind == "or" else left


def _words(words: list[str], prefix: bool) -> list[tuple[str, bool]]:
    return [(w, prefix and i == len(words) - 1) for i, w in enumerate(words)]


def every(tree: tuple) -> set[tuple[str, bool]]:
    kind = tree[0]
    return needed(tree) if kind in ("term", "near") else every(tree[1]) | every(tree[2])


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, key_type: str = "long", columns: tuple[str, ...] = search.COLUMNS, buckets: int = BUCKETS):
        self.spark, self.log, self.columns, self.buckets = spark, CommitLog(spark, path), tuple(columns), buckets
        self.schema = T.StructType.fromDDL(f"token string, key {key_type}, column string, positions array<int>, bucket int")

    def add(self, rows: DataFrame, key: str, upto: int | None = None) -> Snapshot:
        """Index a batch. ``upto``: how far the source has been indexed with it, kept in the log (``state["upto"]``)."""
        # written once as they come: what deals them by ranges reads them twice
        loose = self.log.write(positions(rows, key, self.columns).withColumn("bucket", bucket("token", self.buckets)), "loose")
        found = self.log.read([loose], self.schema)
        runs = self._written(found, max(1, -(-found.count() // FILE_ROWS)))
        self.log.drop([loose])
        while True:
            try:
                return self.log.commit(self.log.snapshot(), runs, state={} if upto is None else {"upto": upto})
            except Conflict:
                continue  # runs of other batches don't touch these

    def _written(self, found: DataFrame, parts: int, level: int = 0) -> dict[str, list[dict]]:
        # a token that very many rows have is cut by key
        dealt = found.repartitionByRange(parts, "bucket", "token", F.xxhash64("key")).sortWithinPartitions("bucket", "token")
        run = self.log.write(dealt, "postings", ("bucket",), level=level)
        stats = self.log.read([run], self.schema).groupBy("bucket", "token").agg(F.countDistinct("key").alias("df"))
        stats = stats.repartitionByRange(max(1, parts // 8), "bucket", "token").sortWithinPartitions("bucket", "token")
        return {"postings": [run], "stats": [self.log.write(stats.select("token", "df", "bucket"), "stats", ("bucket",), level=level)]}

    def merge(self, fanout: int = FANOUT) -> int:
        """Make one run of each level that has ``fanout`` of them, until none has."""
        merged = 0
        while due := self.log.full_levels(base := self.log.snapshot(), "postings", fanout):
            stats = self.log.full_levels(base, "stats", fanout)
            rows = self.log.read(due, self.schema)
            runs = self._written(rows, max(1, -(-rows.count() // FILE_ROWS)), due[0]["level"] + 1)
            try:
                self.log.commit(base, runs, {r["path"] for r in [*due, *stats]})
                merged += len(due)
            except Conflict:
                self.log.drop([r for rs in runs.values() for r in rs])
        return merged

    def _holds(self, word: str, prefix: bool) -> Column:
        """The condition on token and bucket under which a word's postings lie."""
        hit = F.col("token").startswith(word) if prefix else F.col("token") == word
        if prefix and len(word) < 2:
            return hit
        import zlib

        return (F.col("bucket") == zlib.crc32(word[:2].encode()) % self.buckets) & hit

    def frequencies(self, words: set[tuple[str, bool]], at: Snapshot) -> dict[tuple[str, bool], int]:
        """How many rows have each word; for a prefix, the sum over its tokens."""
        stats = self.log.read(at.of("stats"), STATS)
        listed = sorted(words)
        sums = stats.where(_any([self._holds(*w) for w in listed])).agg(*(F.sum(F.when(self._holds(*w), F.col("df"))).alias(f"w{i}") for i, w in enumerate(listed))).first()
        return {w: sums[f"w{i}"] or 0 for i, w in enumerate(listed)}

    def keys(self, query: str, few: int = FEW) -> DataFrame:
        """(key) of the rows that a query meets, the rows that ``search.matches`` would find."""
        at, tree = self.log.snapshot(), search.parse(query, self.columns)
        words, must = sorted(every(tree)), needed(tree)
        postings = self.log.read(at.of("postings"), self.schema)
        if not words or not at.of("postings"):
            return postings.select("key").limit(0)
        found = postings.where(_any([self._holds(*w) for w in words]))
        if must:
            count = self.frequencies(must, at)
            order = sorted(must, key=lambda w: (count[w], w))
            small = (lambda df: F.broadcast(df)) if count[order[0]] <= few else (lambda df: df)
            left = postings.where(self._holds(*order[0])).select("key").distinct()
            for w in order[1:]:
                left = postings.where(self._holds(*w)).select("key").join(small(left), "key", "left_semi").distinct()
            found = found.join(small(left), "key", "left_semi")
        place = {(c, w): f"p{i}_{k}" for i, c in enumerate(self.columns) for k, w in enumerate(words)}
        of = lambda w: F.col("token").startswith(w[0]) if w[1] else F.col("token") == w[0]
        # a row's postings of the query's words meet in one place: as many positions as the row has such words
        whole = found.groupBy("key").agg(*(F.array_sort(F.flatten(F.collect_list(F.when((F.col("column") == c) & of(w), F.col("positions"))))).alias(n) for (c, w), n in place.items()))

        def starts(c: str, group: list[str], prefix: bool) -> Column:
            first, *rest = (F.col(place[c, w]) for w in _words(group, prefix))
            if not rest:
                return first
            return F.filter(first, lambda p: _all([F.array_contains(x, (p + k + 1).cast("int")) for k, x in enumerate(rest)]))

        test = search.evaluated(
            tree,
            lambda group, prefix, cols: _any([F.size(starts(c, group, prefix)) > 0 for c in cols]),
            lambda groups, distance, cols: _any([search.within([(starts(c, w, p), len(w)) for w, p in groups], distance) for c in cols]),
        )
        return whole.where(test).select("key")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def journal_search(index: SearchIndex, changes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The newest rows of a journal that a query meets: indexed rows by the index, rows since by a scan."""
    upto = index.log.snapshot().state.get("upto", 0)
    old = changes.where(F.col("id") <= upto).join(index.keys(query).withColumnRenamed("key", "id"), "id", "left_semi")
    new = changes.where((F.col("id") > upto) & search.matches(query))
    return old.unionByName(new).orderBy(F.col("recorded_at").desc(), F.col("id").desc()).limit(limit)
