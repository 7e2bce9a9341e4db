"""LM scoring: subword lattice likelihood.

The model is a unigram model over the pieces of a public vocabulary. Its scores are learnt from the training fold: the
vocabulary's own encoder cuts each distinct training word, the pieces' counts (weighted by the word's) are smoothed and
become log probabilities; the end of a text is a piece, too. A text's probability sums over *all* ways to cut it into
pieces: a forward recursion in log space over the lattice of pieces. As the word mark starts every word and no piece
holds it elsewhere, the sum over a text is the product of the sums over its words, each of which is computed once.

Words, their counts and their scores reach the documents by blocks: documents are dealt into blocks of about
``BLOCK_BYTES`` by a hash of their id; each block lists its distinct words once, the list is joined to the word table
and comes back to the block. So a frequent word costs a row per block, not per document, and no task holds more than a
block and its words. The driver sees sums and one number per piece.

Defined cases: a null or empty text is one end token; a null doc_id hashes like the empty text; documents with equal ids
keep a row each; without training documents all counts are 0 and every piece is as likely as another; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, split_of, text_bytes, tokenizer_file, total_bytes

VOCABULARY = "piece_bpe_32k.model"
BLOCK_BYTES = 16 << 20
HELD_OUT = 1
ALPHA = 0.1  # added to each piece's count
MARK = "▁"
LOG10 = math.log(10)


class Lattice:
    """Pieces with scores; natural logarithms."""

    def __init__(self, path: str, scores: np.ndarray | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.end = self.model.eos_id()
        self.scores = np.full(self.size, -math.log(self.size)) if scores is None else scores
        m = self.model
        plain = [i for i in range(self.size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.pieces = {m.id_to_piece(i): float(self.scores[i]) for i in plain}
        self.longest = max(map(len, self.pieces))
        # what a piece can start with, so that the recursion leaves a place early
        self.starts = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        self.bytes = [float(self.scores[m.piece_to_id(f"<0x{b:02X}>")]) for b in range(256)]

    def word(self, word: str) -> float:
        """The log probability of a word: all its segmentations. Characters without a piece are spelt in bytes."""
        text = MARK + word
        n, pieces, starts, log1p, exp = len(text), self.pieces, self.starts, math.log1p, math.exp
        forward: list[float | None] = [None] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i]
            if here is None:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                part = text[i:j]
                if part not in starts:
                    break
                if (score := pieces.get(part)) is not None:
                    new, old = here + score, forward[j]
                    if old is None:
                        forward[j] = new
                    else:
                        forward[j] = new + log1p(exp(old - new)) if new > old else old + log1p(exp(new - old))
            if text[i] not in pieces:
                new = here + sum(self.bytes[b] for b in text[i].encode())
                old = forward[i + 1]
                forward[i + 1] = new if old is None else max(old, new) + log1p(exp(-abs(old - new)))
        return forward[n]


@lru_cache(2)
def _encoder(vocabulary: str) -> Lattice:
    return Lattice(tokenizer_file(vocabulary))


def _block_words(pieces: DataFrame) -> DataFrame:
    """(block, word, n): the distinct words of each block and how often training documents have them."""

    def run(table: pa.Table) -> pa.Table:
        counts: Counter = Counter()
        held = table.column("held_out").to_pylist()
        rest: set[bytes] = set()
        for text, out in zip(table.column("text").combine_chunks().cast(pa.large_binary()).to_pylist(), held):
            words = (text or b"").lower().split()
            if out:
                rest.update(words)
            else:
                counts.update(words)
        words = [*counts, *(rest - counts.keys())]
        n = [*counts.values(), *[0] * (len(words) - len(counts))]
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(words), pa.int32()), "word": pa.array(words, pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64())})

    return pieces.groupBy("block").applyInArrow(run, "block int, word string, n long")


def piece_scores(words: DataFrame, n_texts: int, vocabulary: str = VOCABULARY, alpha: float = ALPHA) -> np.ndarray:
    """Log probabilities of all pieces from (word, c): one number per piece reaches the driver."""
    path = tokenizer_file(vocabulary)

    def run(batches):
        lattice = _encoder(vocabulary)
        total = np.zeros(lattice.size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                ids = lattice.model.encode(part.column("word").to_pylist(), num_threads=1)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                total += np.bincount(np.fromiter((i for x in ids for i in x), np.int64, int(size.sum())), np.repeat(part.column("c").to_numpy(), size), lattice.size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    found = words.where("c > 0").select("word", "c").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    lattice = Lattice(path)
    counts = np.zeros(lattice.size)
    for r in found:
        counts[r["id"]] = r["n"]
    counts[lattice.end] += n_texts
    return np.log((counts + alpha) / (counts.sum() + alpha * lattice.size))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: fold, token counts, the base score by words and the model's log10 probability."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (split_of(id_col) == HELD_OUT).alias("held_out"))
    blocks = max(1, -(-total_bytes(rows, "text") // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))
    listed = materialise(_block_words(dealt), "block-words")
    words = materialise(listed.groupBy("word").agg(F.sum("n").alias("c")), "words")
    n_texts = rows.where(~F.col("held_out")).count()
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = (sums["n"] or 0) + n_texts, sums["v"] + (1 if n_texts else 0)  # the end is a token
    model = piece_scores(words, n_texts, vocabulary)
    shared = spark.sparkContext.broadcast(model)  # a number per piece
    end_score, end_count = float(model[Lattice(tokenizer_file(vocabulary)).end]), n_texts

    def score_words(batches):
        lattice = Lattice(tokenizer_file(vocabulary), shared.value)
        for batch in batches:
            found = [lattice.word(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(found, pa.float64())], ["word", "c", "lp"])

    scored = materialise(words.mapInArrow(score_words, "word string, c long, lp double"), "scored-words")
    back = listed.select("block", "word").join(scored, "word")

    def base(c):
        return np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))

    def run(texts: pa.Table, table: pa.Table) -> pa.Table:
        names = table.column("word").combine_chunks().cast(pa.binary()).to_pylist() if table.num_rows else []
        number = dict(zip(names, range(len(names))))
        c = table.column("c").to_numpy() if names else np.zeros(0, np.int64)
        known, by_word, by_piece = c > 0, base(c), table.column("lp").to_numpy() / LOG10 if names else np.zeros(0)
        n_tokens, n_known, base_score, score = [], [], [], []
        for text in texts.column("text").combine_chunks().cast(pa.large_binary()).to_pylist() if texts.num_rows else []:
            at = np.array([number[w] for w in (text or b"").lower().split()], np.int64)
            n_tokens.append(len(at) + 1)
            n_known.append(int(known[at].sum()) + (end_count > 0))
            base_score.append(float(by_word[at].sum() + base(end_count)))
            score.append(float(by_piece[at].sum() + end_score / LOG10))
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([total] * len(n_tokens), pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(score, pa.float64()),
        })

    out = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, out)
