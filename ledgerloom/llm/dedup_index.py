"""Substring dedup with a log-structured fingerprint index.

A window is 20 consecutive words of one document. Its fingerprint is the least hash among its 5-word grams (the
leftmost, where several are least): equal windows have equal fingerprints, and neighbouring windows mostly share theirs.
Windows of one document that share the place of their fingerprint form a *stretch*, of 16 windows at most; a text has
about a seventh as many stretches as words.

*Log.* The texts of a batch are written once, in files that never change. Everything later goes by file and row, so
neither the input nor texts that nothing points to are read again, and no text is ever shuffled.

*Runs.* A batch gives one immutable run, bucketed and sorted by fingerprint: (fingerprint, digest of the stretch's window
hashes, doc_id, start, file, row). Older runs are merge-joined with it by fingerprint, bucket by bucket. When ``fanout``
runs of a level have gathered they are merged into one of the next level, and their files go. A manifest, of which each
version is a new file, says what counts; ``FingerprintIndex(spark, path)`` opens an index again in another job.

*Verification.* Stretches with equal digests are settled by their places alone. Only stretches that share a fingerprint
with a *different* stretch are looked at window by window: their words, of the new batch and of the old ones, are read
from the log at the places that the run names, and windows are compared by a hash over all 20 words whose word hashes
have another seed than the fingerprint's. Of equal windows the first stays, the others mark their words.

*Hot keys.* A file's stretches are settled among each other before they are shuffled, and so are its windows, so a
passage of a third of all documents costs a row per slice of a file. A line of under 20 words in many documents makes as
many different stretches under one fingerprint; its bucket is sorted with spilling, its windows are dealt by their own
hashes.

What lies in older batches counts as earlier. ``dedup`` adds a table in batches of ascending doc_id, so earlier means
a smaller doc_id, or an earlier start in the same document.

Defined cases: a null or empty text has no words; texts of under 20 words lose none; a text of any length is one row of
the log and is read in one piece; ids are integers (others are refused with a ValueError); a null doc_id comes before
all others, at the place of the least long; rows with equal doc_id and start are the same place, so repeated rows (and a
batch added twice) lose the same words and none to each other; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, delete_path, fresh_path, integer_id, materialise, slices, text_bytes

WINDOW = 20
GRAM = 5
BATCHES = 2
FANOUT = 4
#: Stretches, and windows, that a task settles among each other at a time.
SETTLED_TOGETHER = 1 << 19
ROW_GROUP = 16 << 20
NO_ID = -(1 << 63)
SEED_GRAM, SEED_WINDOW = 0, 1
P1, P2, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)

RUN = "fp long, sd long, doc_id long, start int, n int, file int, row int, settled boolean"
MARK = ("file", "row", "start", "n")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(29))


def hashed_words(texts: list[bytes], *seeds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of every word of a batch, in order: its hash for each seed, and its document."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(split)), np.int64, int(counts.sum()))
    digest = xxhash.xxh64_intdigest
    return [np.fromiter((digest(w, s) for w in number), np.uint64, len(number))[flat] for s in seeds], np.repeat(np.arange(len(texts)), counts)


def rolled(h: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = len(h) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(length if n > 0 else 0):
        out = out * base + h[j : j + n]
    return _mixed(out)


def fingerprints(h: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, fingerprint, place of the fingerprint's gram) of each window that lies in one document."""
    n = len(h) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = rolled(h, gram, P1)
    place = np.arange(len(least))
    width, need = 1, window - gram + 1
    while width < need:
        step = min(width, need - width)
        lower = least[step:] < least[:-step]
        least, place = np.where(lower, least[step:], least[:-step]), np.where(lower, place[step:], place[:-step])
        width += step
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return start, least[start], place[start]


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(fp, sd, document, start in it, number of windows) of a batch of texts."""
    (a, b), doc = hashed_words(texts, SEED_GRAM, SEED_WINDOW)
    start, value, place = fingerprints(a, doc)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[start[1:]] != doc[start[:-1]])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(start)))
    # the place of the gram gives each window its place in the stretch, so a sum says all
    sd = _mixed(np.add.reduceat(rolled(b, WINDOW, P2)[start], head) + n.astype(np.uint64))
    owner = doc[start[head]]
    first = np.searchsorted(doc, np.arange(len(texts)))
    return value[head].view(np.int64), sd.view(np.int64), owner, (start[head] - first[owner]).astype(np.int32), n.astype(np.int32)


def _leading(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys and place, and for each row in it whether no row of its keys has a smaller place."""
    order = np.lexsort([*reversed(place), *reversed(keys)])
    same_key, same_place = np.ones((2, max(0, len(order) - 1)), bool)
    for k in keys:
        same_key &= k[order][1:] == k[order][:-1]
    for p in place:
        same_place &= p[order][1:] == p[order][:-1]
    group = np.cumsum(np.append(True, ~same_key)) if len(order) else np.zeros(0, np.int64)
    step = np.cumsum(np.append(True, ~(same_key & same_place))) if len(order) else group
    return order, step == step[np.searchsorted(group, group)] if len(order) else np.zeros(0, bool)


def _read(path: str, wanted: np.ndarray | None = None) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number of its first row, rows) of a file of the log, some at a time; row groups without a wanted row are left out."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        file, at = pq.ParquetFile(f), 0
        for g in range(file.num_row_groups):
            end = at + file.metadata.row_group(g).num_rows
            if wanted is None or np.diff(np.searchsorted(wanted, [at, end]))[0]:
                here = at
                for batch in file.iter_batches(256, row_groups=[g], columns=["doc_id", "text"]):
                    for part in slices([batch], "text"):
                        yield here, part
                        here += part.num_rows
            at = end


def _by_file(batches) -> Iterator[tuple[int, str, pa.Table]]:
    """(file, its path, its rows) of rows sorted by file and row; a file's first row has row -1 and its path."""
    held: list[pa.RecordBatch] = []

    def whole():
        table = pa.Table.from_batches(held)
        return table.column("file")[0].as_py(), table.column("path")[0].as_py(), table.slice(1)

    for batch in batches:
        file = batch.column("file").to_numpy()
        cuts = [0, *np.flatnonzero(batch.column("row").to_numpy() < 0).tolist(), len(file)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                if held and batch.column("row")[a].as_py() < 0:
                    yield whole()
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield whole()


def _keys(batches) -> Iterator[pa.RecordBatch]:
    """Of (file, path): the rows of a run; what a slice settles within itself comes as spans of windows."""
    names = [c.split()[0] for c in RUN.split(", ")]

    def settled(parts, file):
        fp, sd, doc_id, row, start, n = (np.concatenate(x) for x in zip(*parts))
        order, leads = _leading([fp, sd], [doc_id, start])
        some, rest = order[leads], order[~leads]
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (fp, sd, doc_id, start, n)] + [pa.array(np.full(len(some), file, np.int32)), pa.array(row[some]), pa.array(np.zeros(len(some), bool))], names)
        if not len(rest):
            return
        rest = rest[np.lexsort((start[rest], row[rest]))]
        row, start, n, doc_id = row[rest], start[rest], n[rest], doc_id[rest]
        new = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1]))
        head = np.flatnonzero(new)
        total = np.add.reduceat(n, head).astype(np.int32)
        spread = _mixed(row[head].astype(np.uint64) + np.uint64(file + 1 << 32)).view(np.int64)  # spans have no key of their own
        yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(spread), pa.array(doc_id[head]), pa.array(start[head]), pa.array(total), pa.array(np.full(len(head), file, np.int32)), pa.array(row[head]), pa.array(np.ones(len(head), bool))], names)

    for batch in batches:
        for file, path in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist()):
            parts, count = [], 0
            for at, rows in _read(path):
                fp, sd, owner, start, n = stretches(text_bytes(rows.column("text")))
                ids = rows.column("doc_id").fill_null(NO_ID).to_numpy()
                parts.append((fp, sd, ids[owner], (owner + at).astype(np.int32), start, n))
                count += len(fp)
                if count >= SETTLED_TOGETHER:
                    yield from settled(parts, file)
                    parts, count = [], 0
            if parts:
                yield from settled(parts, file)


WINDOWS = "fp long, h long, is_new boolean, doc_id long, start int, file int, row int, settled boolean"


def _windows(batches) -> Iterator[pa.RecordBatch]:
    """Of stretches by file: their windows, each with a hash over its words; what a file settles within itself is so marked."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    digest = xxhash.xxh64_intdigest

    def settled(parts, file):
        fp, h, is_new, doc_id, start, row = (np.concatenate(x) for x in zip(*parts))
        order, leads = _leading([fp, h], [is_new, doc_id, start])
        some = order[leads | is_new[order]]
        done = ~leads[leads | is_new[order]]
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (fp, h, is_new, doc_id, start)] + [pa.array(np.full(len(some), file, np.int32)), pa.array(row[some]), pa.array(done)], names)

    for file, path, table in _by_file(batches):
        fp, is_new, doc_id, row, start, n = (table.column(c).to_numpy() for c in ("fp", "is_new", "doc_id", "row", "start", "n"))
        parts, count = [], 0
        for at, rows in _read(path, row):
            texts = rows.column("text")
            a, b = np.searchsorted(row, [at, at + rows.num_rows])
            last, words = -1, []
            for k in range(a, b):
                if row[k] != last:
                    last = int(row[k])
                    words = texts[last - at].as_buffer().to_pybytes().split()
                some = words[start[k] : start[k] + n[k] + WINDOW - 1]
                h = rolled(np.fromiter((digest(w, SEED_WINDOW) for w in some), np.uint64, len(some)), WINDOW, P2).view(np.int64)
                m = len(h)
                parts.append((np.full(m, fp[k]), h, np.full(m, is_new[k]), np.full(m, doc_id[k]), start[k] + np.arange(m, dtype=np.int32), np.full(m, row[k])))
                count += m
                if count >= SETTLED_TOGETHER:
                    yield from settled(parts, file)
                    parts, count = [], 0
        if parts:
            yield from settled(parts, file)


def _stripped(batches) -> Iterator[pa.RecordBatch]:
    """Of marks by file: every document of the file without the words that its marks cover."""
    for _, path, table in _by_file(batches):
        row, start, n = (table.column(c).to_numpy() for c in ("row", "start", "n"))
        for at, rows in _read(path):
            cuts = np.searchsorted(row, np.arange(at, at + rows.num_rows + 1))
            total, removed, kept, digest = [], [], [], []
            for k, text in enumerate(text_bytes(rows.column("text"))):
                words = text.split()
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start[a:b], 1)
                    np.add.at(edge, start[a:b] + n[a:b] + (WINDOW - 1), -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    left = b" ".join([w for w, s in zip(words, stays.tolist()) if s])
                    removed.append(len(words) - int(stays.sum()))
                    kept.append(left)
                else:
                    left = b" ".join(words)
                    removed.append(0)
                    kept.append(None)
                total.append(len(words))
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


class FingerprintIndex:
    """Runs of stretches and the log of texts below a folder that all machines share. One writer."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path or fresh_path(spark, "fingerprints"), fanout
        state, self.version = self._manifest()
        self.buckets = state["buckets"] if state else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[dict] = state["runs"] if state else []  # of name and level
        self.logs: list[dict] = state["logs"] if state else []  # of path and the number of the first file

    # the manifest

    def _at(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifest(self) -> tuple[dict | None, int]:
        store, folder = self._at("manifest")
        if not store.exists(folder):
            return None, 0
        last = max(s.getPath().getName() for s in store.listStatus(folder))
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifest/{last}").collect())
        return json.loads(text), int(last.partition(".")[0])

    def _commit(self, runs: list[dict], logs: list[dict]) -> None:
        """A new version of the manifest; two writers can't make the same one."""
        store, path = self._at("manifest", f"{self.version + 1:08d}.json")
        out = store.create(path, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": runs, "logs": logs}).encode()))
        out.close()
        self.runs, self.logs, self.version = runs, logs, self.version + 1

    # runs

    def _written(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp", "sd").option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({RUN.replace(' long', ' bigint')}) USING parquet CLUSTERED BY (fp) SORTED BY (fp, sd) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _dropped(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, f"{self.path}/{name}")

    def compact(self, level: int | None = None) -> None:
        """Merge the runs of a level (None: all) into one of the next; of equal stretches the first stays. The old ones' files go."""
        old = [r for r in self.runs if level is None or r["level"] == level]
        if len(old) < 2:
            return
        rows = None
        for r in old:
            run = self._run(r["name"]).where("not settled")
            rows = run if rows is None else rows.union(run)
        first = F.row_number().over(W.partitionBy("fp", "sd").orderBy("doc_id", "start", "file", "row"))
        merged = self._written(rows.repartition(self.buckets, "fp").withColumn("_first", first).where("_first = 1").drop("_first"))
        self._commit([*(r for r in self.runs if r not in old), {"name": merged, "level": max(r["level"] for r in old) + 1}], self.logs)
        for r in old:
            self._dropped(r["name"])

    def drop_runs(self) -> None:
        """The log stays, so that answers can still be read; nothing can be added any more."""
        for r in self.runs:
            self._dropped(r["name"])
        self.runs = []

    def drop(self) -> None:
        self.drop_runs()
        delete_path(self.spark, self.path)

    # batches

    def _files(self, logs: list[dict]) -> list[tuple[int, str]]:
        return [(log["first"] + i, f) for log in logs for i, f in enumerate(sorted(self.spark.read.parquet(log["path"]).inputFiles()))]

    def _with_files(self, rows: DataFrame, files: list[tuple[int, str]], fn: Callable, schema: str) -> DataFrame:
        """Rows that name a file and a row, taken to a task per file, with the file."""
        blank = self.spark.createDataFrame(files, "file int, path string")
        heads = blank.select(*(F.col(c) if c in ("file", "path") else F.lit(-1 if c == "row" else None).cast(rows.schema[c].dataType).alias(c) for c in [*rows.columns, "path"]))
        both = rows.withColumn("path", F.lit(None).cast("string")).union(heads)
        return both.repartition(max(1, len(files)), "file").sortWithinPartitions("file", "row", "start").mapInArrow(fn, schema)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Take in a batch; returns its documents (doc_id, n_words, n_removed, kept_sha256, kept), judged against all that the
        index held before and among each other. kept is null where nothing was removed."""
        spark, scratch = self.spark, Scratch(self.spark)
        log = {"path": f"{self.path}/log-{uuid.uuid4().hex}", "first": sum(1 for _ in self._files(self.logs))}
        texts = docs.select(integer_id(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        texts.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(log["path"])
        files = self._files([log])
        listed = spark.createDataFrame(files, "file int, path string").repartition(max(1, len(files)))
        name = self._written(listed.mapInArrow(_keys, RUN))
        new = self._run(name)
        older = [self._run(r["name"]).where("not settled") for r in self.runs]

        # of equal stretches of the batch the first is left; what shares its fingerprint with nothing else is done
        place = F.struct("doc_id", "start")
        by_print, by_stretch = W.partitionBy("fp"), W.partitionBy("fp", "sd")
        seen = new.where("not settled").withColumn("first", F.min(place).over(by_stretch)).withColumn("varied", F.min("sd").over(by_print) != F.max("sd").over(by_print))
        for i, old in enumerate(older):
            seen = seen.join(old.select("fp").distinct().withColumn(f"old{i}", F.lit(True)), "fp", "left")
        known = F.lit(False)
        for i in range(len(older)):
            known = known | F.col(f"old{i}").isNotNull()
        seen = seen.withColumn("later", place != F.col("first")).where(F.col("later") | F.col("varied") | known)
        seen = scratch.save(seen.select("fp", "sd", "doc_id", "start", "n", "file", "row", "later"), "seen")
        cols = ["fp", "sd", "doc_id", "start", "n", "file", "row"]
        pool = seen.where("not later").select(*cols, F.lit(True).alias("is_new"))
        wanted = pool.select("fp").distinct()
        for old in older:
            pool = pool.union(old.join(wanted, "fp", "left_semi").select(*cols, F.lit(False).alias("is_new")))
        # and now with the older batches; dealt by stretch, as many different stretches can share a fingerprint
        first = F.min(F.struct("is_new", "doc_id", "start")).over(by_stretch)
        pool = pool.withColumn("first", first).withColumn("later", (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.start") != F.col("start")))
        pool = scratch.save(pool.where("is_new or not later").drop("first"), "pool")
        kinds = pool.where("not later").groupBy("fp").agg(F.min("sd").alias("a"), F.max("sd").alias("b"), F.max("is_new").alias("some"))
        kinds = scratch.save(kinds.where("some and a <> b").select("fp"), "kinds")
        opened = pool.where("not later").join(kinds, "fp", "left_semi")
        windows = self._with_files(opened.select("file", "row", "start", "n", "fp", "is_new", "doc_id"), self._files([*self.logs, log]), _windows, WINDOWS)
        windows = scratch.save(windows, "windows")
        least = F.min(F.struct("is_new", "doc_id", "start")).over(W.partitionBy("fp", "h"))
        ranked = windows.where("not settled").withColumn("first", least).where("is_new and (first.doc_id <> doc_id or first.start <> start)")

        marks = new.where("settled").select(*MARK).union(seen.where("later").select(*MARK)).union(pool.where("later").select(*MARK))
        one = ["file", "row", "start", F.lit(1).alias("n")]
        marks = materialise(marks.union(windows.where("settled").select(*one)).union(ranked.select(*one)), "marks")
        scratch.drop()
        self._commit([*self.runs, {"name": name, "level": 0}], [*self.logs, log])
        for level in sorted({r["level"] for r in self.runs}):
            if sum(r["level"] == level for r in self.runs) >= self.fanout:
                self.compact(level)
        return self._with_files(marks, files, _stripped, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Per document: n_words, n_removed, kept_sha256, kept (the kept words, joined by blanks; null where nothing was removed)."""
    spark = docs.sparkSession
    base = docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set((base.agg(F.percentile_approx("doc_id", shares, 10_000).alias("q")).first()["q"] or []) if shares else []))
    index = FingerprintIndex(spark, fanout=fanout)
    found = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        fresh = F.lit(True) if low is None else F.col("doc_id") > low
        fresh = fresh if high is None else fresh & (F.col("doc_id") <= high)
        fresh = fresh if low is not None else F.col("doc_id").isNull() | fresh
        answer = index.add(base.where(fresh))
        found = answer if found is None else found.union(answer)
    index.drop_runs()
    found = materialise(found, "deduplicated")
    index.drop()
    return found


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return dedup(docs, id_col, text_col).select("doc_id", "n_words", "n_removed", "kept_sha256")
