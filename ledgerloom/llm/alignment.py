"""Alignment of two tokenizers' tokens by a dangling-suffix transducer, and how often their tokens meet.

The transducer reads tokens of both sides and always takes the next one from the side that lags. Its state is which side leads
and the bytes by which it does (the residual); a token moves it to the residual that is left, with the same side in front
if the token ends within it, with the other one if it goes beyond. Transitions depend on residual and token alone and are
remembered; residuals are ends of tokens, so there are no more of them than the vocabularies have. An empty residual
closes a group. A token that is read against a residual overlaps with the token that left it, and with no other that came
before, so each step but the first of a group is one link.

Where a word starts after a blank, between a Latin letter and a punctuation mark, and on both sides of a line feed between words, both vocabularies start a token (checked
when they are loaded), so groups never reach over such a place. Texts are cut there, each different part runs through the
transducer once (many in a row, as lines) and is remembered as a whole (a bounded number), and a document is the sequence
of its parts.

A link's count is how many documents hold its pair of ids linked. Each document gives its distinct pairs once; tasks count
what they have before anything is shuffled, so a pair that every document has is a row per task. Counts go back to the
documents' pairs by a sorted table that each worker holds, if it has no more than ``HELD_PAIRS`` rows (its size is checked
and bounded by that), by a join on the pair beyond that; both give the same.

Defined cases: null, empty and undecodable texts (the joined bytes of either side aren't the text's) have no tokens: zeros, ``groups_sha256`` is
empty; a text of any length is aligned whole; strings of special tokens are ordinary text; repeated rows and ids
are documents of their own and count each; ids that aren't integers are refused, null ids stay; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_files, integer_id, list_array, materialise, slices, sorted_table, stored_at, text_bytes, tokenizer_file

SIDE_A = "byte_bpe_50k.json"
SIDE_B = "piece_bpe_32k.model"
REMEMBERED = 200_000
LINE_PARTS = 64
LONG_PART = 256
TRANSITIONS = 2_000_000
HELD_PAIRS = 2_000_000
#: The character that stands for a blank in pieces, and how pieces name single bytes.
BLANK, BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
#: Punctuation that no piece has after a Latin letter.
MARKS, LETTER = ".,;:!?()-", "[A-Za-zÀ-ÖØ-öø-ɏ]"
CUT = re.compile(rf"(?<=[^ ▁])(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<={LETTER})(?=[{re.escape(MARKS)}])")
AFTER_LETTER = re.compile(rf"{LETTER}[{re.escape(MARKS)}]")
SPLIT = re.compile(rf"(?<={LETTER})(?=[{re.escape(MARKS)}])")
#: White space that ``cut`` can't take by plain replacing: other characters, runs, and what would mark the cuts.
ODD = re.compile(r"[^\S\n ]|[ \n][ \n]|[▁\x00]")
#: What a line of parts starts with: a word, so that all that follows stands where it would in a text.
GUARD = " a"
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def byte_alphabet() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokens of a byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        letters = byte_alphabet()
        self.bytes_of = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        self.size_of = np.array(list(map(len, self.bytes_of)))

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokens of a sentencepiece vocabulary, which puts a blank before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) or "\n" in p or AFTER_LETTER.search(p) for p in pieces):
            raise ValueError("the vocabulary has pieces that reach over a blank, a line feed or from a letter to a mark")
        self.bytes_of = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace(BLANK, " ").encode() for p in pieces]
        self.size_of = np.array(list(map(len, self.bytes_of)))

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Of texts that start with a blank, which the library is to add."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class Transducer:
    """States are numbers: 0 is the empty residual, in which side A counts as lagging."""

    A, B = 0, 1

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes], most: int = TRANSITIONS):
        self.bytes_of, self.width, self.most = (bytes_a, bytes_b), max(len(bytes_a), len(bytes_b)) + 1, most
        self._forget()

    def _forget(self) -> None:
        self.residuals = [(self.B, b"")]  # who leads, and by which bytes
        self.leads = [self.B]
        self.number = {self.residuals[0]: 0}
        self.steps: dict[int, int] = {}

    def _step(self, state: int, token: int) -> int:
        """The state after the lagging side's next token; -1 if the bytes differ."""
        lead, rest = self.residuals[state]
        data = self.bytes_of[1 - lead][token]
        if rest.startswith(data):
            after = (lead, rest[len(data) :])
        elif data.startswith(rest):
            after = (1 - lead, data[len(rest) :])
        else:
            return -1
        if not after[1]:
            return 0
        if after not in self.number:
            self.number[after] = len(self.residuals)
            self.residuals.append(after)
            self.leads.append(after[0])
        return self.number[after]

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """(groups, links): where each group ends in a and in b, and the linked ids (a << 32 | b) in order; None if the bytes differ."""
        if len(self.steps) > self.most:
            self._forget()
        steps, leads, width = self.steps, self.leads, self.width
        groups, links = [], []
        i = j = state = 0
        n, m = len(a), len(b)
        while state or i < n or j < m:
            if leads[state] == self.B:
                if i == n:
                    return None
                token = a[i]
                i += 1
                if state:
                    links.append(token << 32 | b[j - 1])
            else:
                if j == m:
                    return None
                token = b[j]
                j += 1
                links.append(a[i - 1] << 32 | token)
            key = state * width + token
            after = steps.get(key)
            if after is None:
                after = steps[key] = self._step(state, token)
            if after < 0:
                return None
            if not after:
                groups.append((i, j))
            state = after
        return groups, links


def cut(text: str) -> list[str]:
    """A text, with its blank in front, as parts."""
    if ODD.search(text) or text[-1:].isspace():
        return CUT.split(text)
    return SPLIT.sub("\0", text.replace("\n", "\0\n\0").replace(" ", "\0 ")).split("\0")[1:]


def written(a: list[int], b: list[int], groups: list[tuple[int, int]]) -> list[str]:
    """Each group as a1,a2|b1."""
    out, p, q = [], 0, 0
    for i, j in groups:
        if i - p == 1 == j - q:
            out.append(f"{a[p]}|{b[q]}")
        else:
            out.append(f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
        p, q = i, j
    return out


class Aligner:
    """Whole texts, part by part."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.transducer = Transducer(self.a.bytes_of, self.b.bytes_of)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts = array("q")  # of each part: tokens of a and of b, groups (-1: the bytes differ)
        self.groups: list[bytes] = []
        self.starts, self.pairs = array("q", [0]), array("q")
        self.names: list[str] = []
        self.used = array("q")  # texts that had the part

    def _shrink(self) -> None:
        """Keep the half that texts had most."""
        counts, starts, pairs, used = (np.array(x, np.int64) for x in (self.counts, self.starts, self.pairs, self.used))
        used[[len(n) > LONG_PART for n in self.names]] = 0
        stay = np.sort(np.argpartition(-used, min(len(used), REMEMBERED // 2) - 1)[: REMEMBERED // 2])
        stay = stay[used[stay] > 0]
        names, groups, used = [self.names[i] for i in stay], [self.groups[i] for i in stay], used[stay] // 2
        size = starts[stay + 1] - starts[stay]
        place = np.repeat(starts[stay] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        self._forget()
        self.known = {n: i for i, n in enumerate(names)}
        self.names, self.groups = names, groups
        self.counts, self.used = array("q", counts.reshape(-1, 3)[stay].tobytes()), array("q", used.tobytes())
        self.starts, self.pairs = array("q", np.concatenate([[0], np.cumsum(size)]).tobytes()), array("q", pairs[place].tobytes())

    def _add(self, part: str, n_a: int, n_b: int, groups: list[str] | None, links: list[int]) -> None:
        self.known[part] = len(self.groups)
        self.names.append(part)
        self.used.append(0)
        self.counts.extend((n_a, n_b, -1 if groups is None else len(groups)))
        self.groups.append(";".join(groups or ()).encode())
        self.pairs.extend(links)
        self.starts.append(len(self.pairs))

    def _alone(self, part: str) -> None:
        """A part by itself, whatever it is."""
        if part[0] == " ":
            a, b = self.a.ids([part])[0], self.b.ids([part])[0]
        elif part[0].isspace():
            a, b = self.a.ids([part])[0], self.b.ids([" " + part])[0][1:]
        else:  # after a line feed, a token of its own on both sides; a blank could be taken into the part's first token
            a, b = self.a.ids(["\n" + part])[0][1:], self.b.ids([" \n" + part])[0][2:]
        whole = b"".join(map(self.a.bytes_of.__getitem__, a)) == part.encode()
        found = self.transducer.align(a, b) if whole else None
        if found is None:
            self._add(part, 0, 0, None, [])
        else:
            self._add(part, len(a), len(b), written(a, b, found[0]), found[1])

    def _learn_line(self, parts: list[str], data: bytes, a: list[int], b: list[int]) -> bool:
        """Remember parts by the tokens of their line; False if these don't end where a part does."""
        found = self.transducer.align(a, b)
        if found is None or b"".join(map(self.a.bytes_of.__getitem__, a)) != data:
            return False
        groups, links = found
        low, high, at = [], [], len(GUARD)
        for p in parts:
            at += p[0] != " "
            low.append(at)
            at += len(p.encode())
            high.append(at)
        edges = []
        for ids, size in ((a, self.a.size_of), (b, self.b.size_of)):
            ends = np.concatenate([[0], np.cumsum(size[ids])])
            edges += [np.searchsorted(ends, low), np.searchsorted(ends, high)]
            if (ends[edges[-2]] != low).any() or (ends[edges[-1]] != high).any():
                return False
        first = [i for i, _ in groups]
        names = written(a, b, groups)
        a0, a1, b0, b1 = edges
        for p, i0, i1, j0, j1, g0, g1 in zip(parts, *(x.tolist() for x in (a0, a1, b0, b1, np.searchsorted(first, a0, "right"), np.searchsorted(first, a1, "right")))):
            # every step but the first of a group is a link
            self._add(p, i1 - i0, j1 - j0, names[g0:g1], links[i0 + j0 - g0 : i1 + j1 - g1])
        return True

    def _learn(self, parts: list[str]) -> None:
        odd = [p for p in parts if BLANK in p or p[0] != " " and p[0].isspace() or len(p) > LONG_PART]
        left = set(odd)
        plain = [p for p in parts if p not in left]
        lines = [plain[at : at + LINE_PARTS] for at in range(0, len(plain), LINE_PARTS)]
        texts = [GUARD + "".join(p if p[0] == " " else "\n" + p for p in line) for line in lines]
        for line, text, a, b in zip(lines, texts, self.a.ids(texts), self.b.ids(texts)):
            if not self._learn_line(line, text.encode(), a, b):
                odd += line
        for p in odd:
            self._alone(p)

    def texts(self, texts: list[bytes]):
        """Of each text: n_a, n_b, n_groups, n_links, digest of the groups, its different pairs (a << 32 | b) and how often it has each."""
        if len(self.known) > REMEMBERED or len(self.pairs) > 16 * REMEMBERED:
            self._shrink()
        split = [cut(" " + t.decode()) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(split)) if p not in self.known]
        for at in range(0, len(new), 1 << 14):
            self._learn(new[at : at + (1 << 14)])
        counts, starts, pairs = (np.frombuffer(x, np.int64) for x in (self.counts, self.starts, self.pairs))  # views; they end before the arrays grow
        counts, used = counts.reshape(-1, 3), np.frombuffer(self.used, np.int64)
        none = np.zeros(0, np.int64)  # no view: an array that has views left can't grow, and the caller keeps what it gets
        nothing = (0, 0, 0, 0, "", none, none)
        for parts in split:
            at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
            of = counts[at]
            if not len(at) or (of[:, 2] < 0).any():
                yield nothing
                continue
            n_a, n_b, n_groups = map(int, of.sum(0))
            digest = hashlib.sha256(b";".join(map(self.groups.__getitem__, at.tolist()))).hexdigest()
            part, often = np.unique(at, return_counts=True)
            used[part] += 1
            size = starts[part + 1] - starts[part]
            place = np.repeat(starts[part] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            own, where = np.unique(pairs[place], return_inverse=True)
            times = np.bincount(where, weights=np.repeat(often, size), minlength=len(own)).astype(np.int64)
            yield n_a, n_b, n_groups, int(times.sum()), digest, own, times
        for part in [p for p in new if len(p) > LONG_PART]:  # their numbers stay, their texts go
            del self.known[part]


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """Per document: its counts, the digest of its groups, its linked pairs and how often it has each. One pass, no shuffle."""
    names = [f.split()[0] for f in ALIGNED.split(", ")]

    def run(batches):
        tool = aligner(tokenizer_file(side_a), tokenizer_file(side_b))
        for batch in slices(batches, "text", 1 << 20):
            n_a, n_b, n_groups, n_links, digest, pairs, times = zip(*tool.texts(text_bytes(batch.column("text"))))
            longs = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
            lists = [list_array(np.concatenate(x), [len(y) for y in x], pa.int64()) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *longs, pa.array(digest), *lists], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents have each pair, and whether that is the most of its A id (1 or 0)."""

    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            pair, n = np.unique(batch.column("pairs").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            for p, k in zip(pair.tolist(), n.tolist()):
                total[p] = total.get(p, 0) + k
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["pair", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["pair", "n"])

    counted = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # an A id has one row per B id at most, which the vocabulary bounds
    return counted.withColumn("best", (F.col("n") == F.max("n").over(W.partitionBy(F.shiftright("pair", 32)))).cast("long"))


def with_counts(aligned: DataFrame, counts: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """The aligned documents with n_best and count_sum. Both are tables of the shared folder."""
    names = [c for c in aligned.columns if c not in ("pairs", "times")]
    if counts.count() <= held:
        path = stored_at(counts)

        def run(batches):
            pair, n, best = sorted_table(path, ("pair", "n", "best"))
            for batch in batches:
                own, times = (batch.column(c) for c in ("pairs", "times"))
                ends = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))])
                at, times = np.searchsorted(pair, own.flatten().to_numpy(zero_copy_only=False)), times.flatten().to_numpy(zero_copy_only=False)
                sums = [np.concatenate([[0], np.cumsum(times * x[at])])[ends] for x in (best, n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(np.diff(s)) for s in sums)], [*names, "n_best", "count_sum"])

        kinds = ", ".join(f.name + " " + f.dataType.simpleString() for f in aligned.schema.fields if f.name in names)
        return aligned.mapInArrow(run, f"{kinds}, n_best long, count_sum long")
    each = aligned.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("t"))))
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.col("t") * F.col("best")).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    found = aligned.select(*names).join(sums, "row", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = HELD_PAIRS, **sides) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links by their A id's most common pair, counts summed, groups' digest."""
    aligned = materialise(align(docs, id_col, text_col, **sides), "aligned")
    counts = materialise(pair_counts(aligned), "pair-counts")
    out = with_counts(aligned, counts, held).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    out = materialise(out, "alignment")
    drop_files(aligned)
    drop_files(counts)
    return out
