"""Token ids as Arrow stream files of equal-length sequences.

The table is dealt by ranges of doc_id, so file k holds the documents before those of file k + 1. Each task encodes its
documents in order, packs their ids without gaps into sequences of ``seq_len`` and writes them as record batches in
Arrow's stream format: ``ids`` is a fixed-size list of unsigned integers (16 bits where the vocabulary allows),
``mask`` a fixed-size list of booleans, false on the padding of a file's last sequence. Both are plain fixed-width
buffers, so a reader maps the file and takes sequence i as ``ids.values[i * seq_len:(i + 1) * seq_len]`` without
copying. A sibling stream ``*.index.arrow`` says where each document starts.

A file counts once it is in the manifest, which Spark's own commit writes: a task that is run twice leaves a file that
nobody reads. Nothing is gathered on the driver but one line per file.

Defined cases: a null or empty text is the end id alone; a text of any length is encoded whole; ids are integers (others
are refused with a ValueError); rows of equal doc_id lie next to each other, in the order of
their texts, and keep a row each; a null doc_id comes first; an empty table gives no rows. Columns besides id and text
aren't stored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, integer_id, slices, text_bytes, tokenizer_file, total_bytes

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SEQ_LEN = 1024
#: Text bytes that a file is made from, about; sequences are written in batches of so many.
FILE_BYTES = 32 << 20
BATCH_SEQUENCES = 256
REMEMBERED = 600_000
MARK = "\x01"
LINE_WORDS = 64
#: ASCII marks, and what is before them in a word that is cut there: ASCII letters and digits, or the letters of À to ÿ (their second bytes).
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STEM_ASCII = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
STEM_LATIN = frozenset(range(0x80, 0xC0)) - {0x97, 0xB7}

MANIFEST = T.StructType([T.StructField("part", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def stem_of(word: bytes) -> bytes:
    """What a word holds before the ASCII marks at its end, if it has both and a letter or digit before them; else nothing."""
    stem = word.rstrip(MARKS)
    if not stem or len(stem) == len(word):
        return b""
    return stem if stem[-1] in STEM_ASCII or stem[-2:-1] == b"\xc3" and stem[-1] in STEM_LATIN else b""


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's splitter never lets a token reach over white space and its normalizer acts within words, so each
    word between ASCII blanks is encoded once and remembered as the bytes of its ids (a bounded number; words that were used last
    stay). Its splitter also parts a letter or digit from a mark behind it, so a word that ends in ASCII marks is put together from
    what is before them and the marks. What is new goes to the library in lines
    of many, with a control character between them that is a token by itself and tells where a word ends; words that
    hold that character go alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # the strings of special tokens in a text are ordinary text, as the description of the public vocabularies asks for
        self.tokenizer.encode_special_tokens = True
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.mark = self.ids([MARK])[0]
        if len(self.mark) != 1:
            raise ValueError("the vocabulary has no token for the mark between words")
        self.parted = self.splits_off_marks()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def splits_off_marks(self) -> bool:
        """Whether the vocabulary takes each letter and digit of ``stem_of`` apart from each mark behind it, as a blank does."""
        ends = [bytes([c]).decode() for c in sorted(STEM_ASCII)] + [bytes([0xC3, c]).decode() for c in sorted(STEM_LATIN)]
        cases = [(e, m) for e in ends for m in MARKS.decode()]
        return self.ids([e + m for e, m in cases]) == self.ids([f"{e} {m}" for e, m in cases])

    def from_library(self, words: list[bytes]) -> None:
        size = np.dtype(self.kind).itemsize
        marked = [w for w in words if b"\x01" in w]
        self.known.update((w, np.array(x, self.kind).tobytes()) for w, x in zip(marked, self.ids([w.decode() for w in marked])))
        plain = [w for w in words if b"\x01" not in w]
        lines = [plain[at : at + LINE_WORDS] for at in range(0, len(plain), LINE_WORDS)]
        for at in range(0, len(lines), 64):
            some = lines[at : at + 64]
            for line, ids in zip(some, self.ids([f" {MARK} ".join(w.decode() for w in line) for line in some])):
                found = np.array(ids, self.kind)
                cuts = (np.flatnonzero(found == self.mark[0]) * size).tolist()
                raw = found.tobytes()
                self.known.update((w, raw[a:b]) for w, a, b in zip(line, [0, *(c + size for c in cuts)], [*cuts, len(raw)]))

    def learn(self, words: Iterable[bytes]) -> None:
        """Remember the ids of words."""
        known, before = self.known, self.before
        whole, parts = [], []
        for w in words:
            if (found := before.get(w)) is not None:
                known[w] = found
            elif self.parted and (stem := stem_of(w)):
                parts.append((w, stem, w[len(stem) :]))
            else:
                whole.append(w)
        wanted = dict.fromkeys(chain(whole, *((s, m) for _, s, m in parts)))
        for w in [w for w in wanted if w in before]:
            known[w] = before[w]
        self.from_library([w for w in wanted if w not in known])
        known.update((w, known[s] + known[m]) for w, s, m in parts)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, list[int]]:
        """All ids in one array, each text's followed by the end id, and how many each text has."""
        split = [t.lower().split() for t in texts]  # the vocabulary lowers all letters; here it saves words
        if len(self.known) > REMEMBERED // 2:
            self.before, self.known = self.known, {}
        self.learn(set(chain.from_iterable(split)).difference(self.known))
        end, ids_of = self.kind(end_id).tobytes(), self.known.__getitem__
        rows = [b"".join(map(ids_of, words)) + end for words in split]
        return np.frombuffer(b"".join(rows), self.kind), [len(r) // len(end) for r in rows]


@lru_cache(2)
def encoder(vocabulary: str) -> WordEncoder:
    return WordEncoder(tokenizer_file(vocabulary))


def schema_of(kind, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


def _sequences(flat: np.ndarray, seq_len: int, schema: pa.Schema) -> pa.RecordBatch:
    rows = -(-len(flat) // seq_len)
    ids, mask = np.zeros(rows * seq_len, flat.dtype), np.zeros(rows * seq_len, bool)
    ids[: len(flat)], mask[: len(flat)] = flat, True
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), seq_len) for x in (ids, mask)], schema=schema)


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the store below ``path`` (a URI in a folder that all machines share); returns its manifest, a row per file."""
    spark = df.sparkSession
    rows = df.select(integer_id(df, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    files = max(1, -(-total_bytes(rows, "text") // file_bytes))
    # many rows of one id are dealt by their texts
    dealt = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        enc = encoder(vocabulary)
        schema = schema_of(enc.kind, seq_len)
        store, top = fs.FileSystem.from_uri(path)
        part = TaskContext.get().partitionId()
        name = f"{top}/{part:06d}-{uuid.uuid4().hex}"
        docs = tokens = 0
        rest = np.zeros(0, enc.kind)
        out = index = None
        for batch in slices(batches, "text"):
            if out is None:
                store.create_dir(top, recursive=True)
                files_open = [store.open_output_stream(name + end) for end in (".arrow", ".index.arrow")]
                out = pa.ipc.new_stream(files_open[0], schema)
                index = pa.ipc.new_stream(files_open[1], index_schema())
            flat, lengths = enc.encode(text_bytes(batch.column("text")), end_id)
            starts = np.fromiter(accumulate(lengths, initial=tokens), np.int64, len(lengths) + 1)
            index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts[:-1]), pa.array(lengths, pa.int64())], schema=index_schema()))
            docs, tokens = docs + len(lengths), int(starts[-1])
            rest = np.concatenate([rest, flat])
            whole = len(rest) // seq_len
            for a in range(0, whole, BATCH_SEQUENCES):
                out.write_batch(_sequences(rest[a * seq_len : min(whole, a + BATCH_SEQUENCES) * seq_len], seq_len, schema))
            rest = rest[whole * seq_len :]
        if out is None:
            return
        if len(rest):
            out.write_batch(_sequences(rest, seq_len, schema))
        for x in (out, index, *files_open):
            x.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [docs], "n_tokens": [tokens]}, pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    manifest = f"{path}/manifest"
    dealt.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def index_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Store:
    """Random access to one file of the store: local files are mapped, so the arrays are views of the file."""

    def __init__(self, name: str, store: fs.FileSystem | None = None):
        store = store or fs.LocalFileSystem()
        local = isinstance(store, fs.LocalFileSystem)
        opened = (lambda n: pa.memory_map(n)) if local else store.open_input_file
        with pa.ipc.open_stream(opened(name + ".arrow")) as r:
            self.batches = list(r)
        with pa.ipc.open_stream(opened(name + ".index.arrow")) as r:
            self.index = r.read_all()
        self.first = np.cumsum([0, *(b.num_rows for b in self.batches)])
        self.seq_len = self.batches[0].column("ids").type.list_size if self.batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence i."""
        k = int(np.searchsorted(self.first, i, "right")) - 1
        at = (i - int(self.first[k])) * self.seq_len
        b = self.batches[k]
        return b.column("ids").values.to_numpy()[at : at + self.seq_len], b.column("mask").values.slice(at, self.seq_len)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids [start, start + n) of this file's stream; a view where they lie in one batch."""
        parts, end = [], start + n
        while start < end:
            k = int(np.searchsorted(self.first, start // self.seq_len, "right")) - 1
            base, stop = int(self.first[k]) * self.seq_len, min(end, int(self.first[k + 1]) * self.seq_len)
            parts.append(self.batches[k].column("ids").values.to_numpy()[start - base : stop - base])
            start = stop
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def read(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Documents of a store: doc_id, start (in the whole stream), n_tokens, ids. One task per file, one document at a time."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if manifest is None else manifest
    files = sorted(manifest.collect(), key=lambda r: r["part"])  # a line per file
    starts = accumulate((r["n_tokens"] for r in files), initial=0)
    plan = [(r["path"], s) for r, s in zip(files, starts)]
    listed = spark.createDataFrame(plan, "path string, base long").repartition(max(1, len(plan)))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_le32", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                file = Store(name, fs.FileSystem.from_uri(path)[0])
                for part in file.index.to_batches(1024):
                    start, n = part.column("start").to_pylist(), part.column("n_tokens").to_pylist()
                    ids = [file.tokens(a, k).astype("<u4").tobytes() for a, k in zip(start, n)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([base + a for a in start], pa.int64()), part.column("n_tokens"), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids_le32"])

    return listed.mapInArrow(run, out)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write a store of the documents into the shared folder and read it back: place, length and checksum of each."""
    path = fresh_path(docs.sparkSession, "tokens")
    manifest = write(docs, path, id_col, text_col, **options)
    return read(docs.sparkSession, path, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids_le32").cast("long").alias("ids_crc32"))
