"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader (proximal) updates.

Words are normalised before they are hashed: letters in lower case, a mark for words in capitals, a mark for each kind
of trailing sign, a mark for a word that repeats the one before. Unigrams and bigrams of these marks and words are
hashed into 2**18 weights; a feature's value is the root of its share of the text, so every text has length one. The
score is a sparse dot product behind a logistic function. Nothing but the text enters it.

Training: labelled rows outside the held-out fold, at most ``MAX_LABELLED`` of them by the order of a hash of their ids
(a documented bound on the fit, not on what is scored). They are turned into sparse rows where the texts are, and one
task walks over them in order; its weights, of fixed size, go to every scoring task.

Defined cases: a null or empty text has no features and gets the score of the intercept; a text of any length is scored
whole; a document with several labels counts with the lowest; null labels are left out; without any label every text
scores ``NO_MODEL``; repeated rows keep a row each; other columns, whatever their names, are ignored by ``scores`` and
kept by ``keep``.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, replace_columns, slices, split_of, text_bytes

BITS = 18
MAX_LABELLED = 12_000
#: Passes over the rows: at least so many, more over few rows, until so many updates are made.
EPOCHS, UPDATES, MOST_EPOCHS = 4, 40_000, 40
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-5
THRESHOLD = 0.3
HELD_OUT = 0
NO_MODEL = 1.0
REMEMBERED = 100_000
SLICE_BYTES = 1 << 20  # of text at a time; the arrays of features take about forty times as much
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def marks(word: bytes) -> tuple[int, ...]:
    """Hashes of what a word is normalised to."""
    text = word.decode()
    core = text.strip("".join({c for c in text if not c.isalnum()}))
    out = []
    if core:
        out.append(core.lower())
        if len(core) > 1 and core.isupper():
            out.append("<upper>")
    signs = text[len(text.rstrip("".join({c for c in text if not c.isalnum()}))) :] if core else text
    out += [f"<{c}>" if signs.count(c) < 2 else f"<{c}{c}>" for c in dict.fromkeys(signs)]
    return tuple(xxhash.xxh64_intdigest(x) for x in out)


@lru_cache(1)
def _known() -> dict[bytes, tuple[int, ...]]:
    return {}


SAME = np.full(1, xxhash.xxh64_intdigest("<same>"), np.uint64) * M2


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of a batch, sorted by document and feature."""
    known = _known()
    if len(known) > REMEMBERED:
        known.clear()
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(split)), np.int64, int(counts.sum()))
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    doc = np.repeat(np.arange(len(texts)), counts)
    for w in number:
        if w not in known:
            known[w] = marks(w)
    each = [known[w] for w in number]
    size = np.fromiter(map(len, each), np.int64, len(each))
    hashes = np.fromiter(chain.from_iterable(each), np.uint64, int(size.sum()))
    first, per = np.cumsum(size) - size, size[flat]
    token = hashes[np.repeat(first[flat] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))]
    token_doc = np.repeat(doc, per)
    again = doc[1:][(flat[1:] == flat[:-1]) & (doc[1:] == doc[:-1])]
    pair = (token[:-1] * M1 ^ token[1:]) * M2
    inside = token_doc[1:] == token_doc[:-1]
    where = np.concatenate([token_doc, token_doc[1:][inside], again])
    what = np.concatenate([token * M2, pair[inside], SAME.repeat(len(again))]) >> np.uint64(64 - BITS)
    key, often = np.unique((where << BITS) | what.astype(np.int64), return_counts=True)
    at = key >> BITS
    total = np.bincount(at, often, minlength=len(texts))
    return at, key & ((1 << BITS) - 1), np.sqrt(often / total[at])


class Ftrl:
    """Logistic regression with per-coordinate follow-the-regularised-leader (proximal) updates; the last weight is the intercept."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        i, x = np.append(i, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        root = np.sqrt(self.n[i])
        self.z[i] += g - (np.sqrt(root**2 + g * g) - root) / ALPHA * w
        self.n[i] += g * g


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> np.ndarray | None:
    """Weights from labelled rows outside the held-out fold; None without any."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (split_of(id_col) != HELD_OUT))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    order = F.xxhash64("_id")
    chosen = known.orderBy(order, "_id").limit(max_labelled)  # so few ids that every task can hold them
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")

    def sparse(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            at, index, value = features(text_bytes(batch.column("text")))
            cuts = np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (index.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), *lists], ["_id", "_y", "i", "x"])

    def train(batches):
        seen = []
        for b in batches:
            i, x = b.column("i"), b.column("x")
            seen += [(i[k].values.to_numpy(), x[k].values.to_numpy().astype(float), y) for k, y in enumerate(b.column("_y").to_pylist())]
        if not seen:
            return
        model = Ftrl()
        for _ in range(min(MOST_EPOCHS, max(EPOCHS, UPDATES // len(seen)))):
            for i, x, y in seen:
                model.learn(i, x, y)
        w = model.weights(np.arange(len(model.z)))
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(w[some])], ["i", "w"])

    kind = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_y", T.IntegerType()), T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])
    ordered = rows.mapInArrow(sparse, kind).repartition(1).sortWithinPartitions(order, "_id", F.xxhash64("i"))
    found = ordered.mapInArrow(train, "i long, w double").toPandas()  # of fixed size: at most a line per weight
    if not len(found):
        return None
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[found["i"].to_numpy()] = found["w"].to_numpy()
    return weights


def predict(df: DataFrame, weights: np.ndarray | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """The input with ``out``: how likely label 1 is."""
    df = replace_columns(df, out)
    if weights is None:
        return df.withColumn(out, F.lit(NO_MODEL))
    shared = df.sparkSession.sparkContext.broadcast(weights)  # 1 MB, whatever the data
    names = df.columns

    def run(batches):
        w = shared.value
        for batch in slices(batches, text_col, SLICE_BYTES):
            at, index, value = features(text_bytes(batch.column(text_col)))
            total = np.bincount(at, w[index] * value, minlength=batch.num_rows) + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())], [*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: fold, score, prediction."""
    weights = fit(docs, labels, id_col, text_col)
    scored = predict(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), weights)
    return scored.select("doc_id", (split_of("doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier doesn't reject, columns as they are."""
    own = free_name(docs.columns, "score")
    return predict(docs, fit(docs, labels, id_col, text_col), text_col, own).where(F.col(own) >= THRESHOLD).drop(own)
