"""Byte-level BPE as a tree reduction over a monoid.

A text is cut in halves until the parts are leaves of at most ``LEAF_CHARS`` characters, each leaf is encoded alone by the
tiktoken library, and neighbours are joined: a window of text around the cut is encoded again and widened until both its rims provably stay. Three
kinds of rim do:

* *Blanks.* A blank before another character than white space starts a piece of the pattern in any context. Most joins
  end here, after a few words.
* *Pieces.* Where a window meets no such blank, two segmentations are joined: pieces of the left part that could have
  looked beyond the cut are dropped and matched again until a match ends where a piece of the right part ends; from
  then on both agree, as a match depends only on what follows its start.
* *Tokens.* A piece longer than a leaf is cut in turn, and a window of tokens around the cut is merged again and
  widened: a list of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs, so
  once both rims of the window hold, nothing outside can change.

Decoding is the monoid's homomorphism: bytes are concatenated up the tree, and as concatenation is associative any tree
gives the same, so all leaves are laid out in one buffer at once.

Defined cases: a null or empty text has no ids; a text is never cut off; ids without a token can't be decoded and are
refused; repeated rows and ids give equal rows; other
columns pass through, but columns named like an output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, replace_columns, slices, tokenizer_file

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the public vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 256
LEAF_BYTES = 64
NEVER = 1 << 60


class TreeBpe:
    """Encoder and decoder for a table of merge ranks; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        # Rust's white space lacks the four separators that Python's has
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.leaf_chars, self.leaf_bytes = max(8, leaf_chars), max(1, leaf_bytes)
        self.leaf = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.rim = re.compile(r" (?=\S)")  # Python's white space has more characters, so this finds fewer blanks, never wrong ones
        self.stable = lru_cache(1 << 17)(lambda a, b: self.merged(self.bytes_of[a] + self.bytes_of[b]) == (a, b))

    # tokens of one piece

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Merges by rank, leftmost first among equals."""
        if len(data) > 64:
            return self._merged_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pair = [ranks.get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pair and (least := min(pair)) < NEVER:
            i = pair.index(least)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        return tuple(map(ranks.__getitem__, parts))

    def _merged_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list, so that long windows stay cheap."""
        ranks, n = self.ranks, len(data)
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here, and the part before it
        rank_at = [ranks.get(data[i : i + 2]) for i in range(n - 1)] + [None]
        heap = [(r, i) for i, r in enumerate(rank_at) if r is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank_at[i] != r:
                continue
            j = end[i]
            alive[j] = 0
            end[i] = k = end[j]
            if k < n:
                back[k] = i
            rank_at[i] = ranks.get(data[i : end[k]]) if k < n else None
            if rank_at[i] is not None:
                heapq.heappush(heap, (rank_at[i], i))
            if (p := back[i]) >= 0:
                rank_at[p] = ranks.get(data[p:k])
                if rank_at[p] is not None:
                    heapq.heappush(heap, (rank_at[p], p))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def joined(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.stable(left[i - 1], window[0])) and (j == len(right) or self.stable(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2

    def span(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= self.leaf_bytes:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.span(data[:half]), self.span(data[half:]))

    def piece(self, data: bytes) -> tuple[int, ...]:
        """A whole piece that is a token stays one, also where no merges lead to it."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.span(data)

    # pieces of one text

    def pieces(self, text: str) -> list[str]:
        if len(text) <= self.leaf_chars:
            return self.pattern.findall(text)
        half = len(text) // 2
        left, right = self.pieces(text[:half]), self.pieces(text[half:])
        at = half
        while left and at > half - 3:  # contractions look two characters ahead, white space to its own end
            at -= len(left.pop())
        ends, k = half, 0  # the start of the right part's piece k
        while at < len(text):
            while k < len(right) and ends < at:
                ends += len(right[k])
                k += 1
            if ends == at:
                return left + right[k:]
            found = self.pattern.match(text, at)
            left.append(found.group())
            at = found.end()
        return left

    # whole texts

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        left, right, width = self.encode(text[:half]), self.encode(text[half:]), 64
        while width < 2 * half:
            low, high = max(0, half - width), min(len(text), half + width)
            found = [m.start() for m in self.rim.finditer(text, low, half)]  # both characters lie in the left part
            start = found[-1] if found else 0 if low == 0 else None
            end = m.start() if (m := self.rim.search(text, half, high)) else len(text) if high == len(text) else None
            if start is not None and end is not None and end - start <= self.leaf_chars:
                gone = len(text[start:half].encode())
                while gone:
                    gone -= len(self.bytes_of[left.pop()])
                k, gone = 0, len(text[half:end].encode())
                while gone:
                    gone -= len(self.bytes_of[right[k]])
                    k += 1
                return left + self.leaf(text[start:end]) + right[k:]
            width *= 4
        return list(chain.from_iterable(self.piece(p.encode()) for p in self.pieces(text)))

    def decode(self, ids) -> bytes:
        """Concatenation up the tree."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(4)
def load(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> TreeBpe:
    with open(tokenizer_file(vocabulary), "rb") as f:
        return TreeBpe({base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}, pattern)


def encode(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The input with ``ids``: array<int>, the ids of each whole text. One pass, no shuffle."""
    df = replace_columns(df, "ids")
    names = df.columns

    def run(batches):
        bpe = load(vocabulary, pattern)
        for batch in slices(batches, text_col, 2 << 20):
            rows = [bpe.encode(t or "") for t in batch.column(text_col).to_pylist()]
            lengths = [len(r) for r in rows]
            flat = np.fromiter(chain.from_iterable(rows), np.int32, sum(lengths))
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(flat, lengths, pa.int32())], [*names, "ids"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The input with ``decoded``: binary, the bytes of each list of ids (null: none)."""
    df = replace_columns(df, "decoded")
    names = df.columns

    def run(batches):
        bpe = load(vocabulary)
        leaves = pa.array([bpe.bytes_of.get(i) for i in range(max(bpe.bytes_of) + 1)], pa.large_binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(ids_col)
                flat = ids.flatten()
                taken = leaves.take(flat) if not len(flat) or pc.max(flat).as_py() is None or pc.max(flat).as_py() < len(leaves) else None  # its buffer is the concatenation of all rows
                if taken is None or taken.null_count:
                    raise ValueError("an id has no token")
                ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
                cuts = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[cuts].copy()), taken.buffers()[2]])
                yield pa.RecordBatch.from_arrays([*part.columns, rows.cast(pa.binary())], [*names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per document its number of ids and the digests of ids and of the bytes that they decode to."""
    coded = decode(encode(docs.select(id_col, text_col), text_col, vocabulary).drop(text_col), "ids", vocabulary)
    return coded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
