"""Media columns of interleaved document sequences.

* ``parse`` turns HTML into an ordered list of items: runs of text, and references to media with their digest, caption
  and alternative text. Positions count items from 0, so order and captions survive every later join. A figure's caption
  goes to all media of the figure, wherever it stands in it; one that is never closed ends at its first block. Content is
  that of a reader without scripts: ``noscript`` counts, ``script``, ``style`` and ``template`` don't. References come from
  ``src``, else ``data-src``, else the first entry of ``srcset`` or ``data-srcset``; a video's poster is an image before it.
* ``pack`` stores a payload losslessly as the samples of a picture (binary PPM: 8 bits, three channels, 64 pixels a
  row, so 192 bytes a row; a padded payload is whole rows). ``unpack`` reads the samples back from the stored bytes.
* ``resolve`` joins references to a media table by digest. The table holds each digest once, and only the columns that
  the caller selects travel, so a join for derived features doesn't move payloads.

Stored media are content-addressed: the digest is SHA-256 of the stored bytes, equal payloads have one entry.

Defined cases: a null or empty text is a payload of 192 blanks; a text of any length is one payload; a null HTML has no
items; references whose digest no entry has keep null media columns; repeated rows keep a row each; an empty table gives
an empty table; columns named like an output, in whatever case, are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, replace_columns, slices, text_bytes

ROW = 192
WIDTH = 64
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}
SKIPPED_TAGS = {"script", "style", "template"}
BLOCK_TAGS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "article", "section", "figure", "header", "footer", "main", "body", "title", "blockquote", "pre"}
#: Blocks that can't lie in a caption, so an open one ends there.
SECTION_TAGS = {"figure", "article", "section", "header", "footer", "main", "body", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th"}
ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("alt", T.StringType())])


def _one_line(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class _Items(HTMLParser):
    """Collects items in document order. Open figures are a stack of the media seen in them and the runs of their caption."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.skipped = 0
        self.figures: list[dict] = []
        self.in_caption = False

    def flush(self):
        """The text so far becomes an item; inside a caption, one of its runs."""
        if text := _one_line(self.run):
            if self.in_caption:
                self.figures[-1]["caption"].append(text)
            else:
                self.items.append({"kind": "text", "text": text})
        self.run = []

    def end_caption(self, whole: bool):
        """Only the first run belongs to a caption that isn't closed; the others are text."""
        self.flush()
        self.in_caption = False
        runs = self.figures[-1]["caption"]
        if not whole:
            self.items += [{"kind": "text", "text": t} for t in runs[1:]]
            del runs[1:]

    def end_figure(self, whole: bool = True):
        if self.in_caption:
            self.end_caption(whole)
        figure = self.figures.pop()
        text = " ".join(figure["caption"])
        for item in figure["media"]:
            item.setdefault("caption", text or None)
        if text and not figure["media"]:
            self.items.append({"kind": "text", "text": text})

    def media(self, kind: str, ref: str, alt: str | None):
        if not self.in_caption:
            self.flush()
        item = {"kind": kind, "ref": ref, "alt": alt}
        self.items.append(item)
        if self.figures:
            self.figures[-1]["media"].append(item)

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED_TAGS:
            self.skipped += 1
        if self.skipped:
            return
        if tag in MEDIA_TAGS:
            have = dict(attrs)
            if have.get("poster"):
                self.media("image", have["poster"], have.get("alt"))
            sets = (have.get(n, "") or "" for n in ("srcset", "data-srcset"))
            ref = next((r for r in (have.get("src"), have.get("data-src"), *(x.split(",")[0].strip().split(" ")[0] for x in sets)) if r), None)
            if ref:
                self.media(MEDIA_TAGS[tag], ref, have.get("alt"))
        elif tag == "figcaption" and self.figures:
            if self.in_caption:
                self.end_caption(False)
            self.flush()
            self.in_caption = True
        elif tag in BLOCK_TAGS:
            if self.in_caption and tag in SECTION_TAGS:
                self.end_caption(False)
            self.flush()
            if tag == "figure":
                self.figures.append({"media": [], "caption": []})

    def handle_endtag(self, tag):
        if tag in SKIPPED_TAGS:
            self.skipped = max(0, self.skipped - 1)
        if self.skipped:
            return
        if tag == "figcaption" and self.in_caption:
            self.end_caption(True)
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure" and self.figures:
                self.end_figure()
            elif tag in SECTION_TAGS and self.in_caption:
                self.end_caption(False)

    def handle_data(self, data):
        if not self.skipped:
            self.run.append(data)

    def finish(self):
        self.close()
        while self.figures:
            self.end_figure(False)
        self.flush()


def items_of(html: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(html or "")
    parser.finish()
    return [{n: x.get(n) for n in ITEM.names} | {"position": i} for i, x in enumerate(parser.items)]


def parse(df: DataFrame, html_col: str = "html") -> DataFrame:
    """The input with ``items``: array of (position, kind, text, ref, caption, alt), in document order."""
    df = replace_columns(df, "items")
    names = df.columns
    kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ITEM.names[1:])]))

    def run(batches):
        for batch in slices(batches, html_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(items_of, batch.column(html_col).to_pylist()), kind)], [*names, "items"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("items", T.ArrayType(ITEM))]))


def sequence(df: DataFrame, *keys: str) -> DataFrame:
    """Items as rows, with the keys of their documents."""
    return df.select(*keys, F.inline("items"))


def pack(data: bytes) -> bytes:
    """A padded payload as a PPM picture."""
    payload = data + b" " * (-len(data) % ROW or (ROW if not data else 0))
    return b"P6\n%d %d\n255\n" % (WIDTH, len(payload) // ROW) + payload


def unpack(stored: bytes) -> bytes:
    """The samples of a stored picture, checked against its header."""
    magic, size, depth, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P6" or depth != b"255" or len(samples) != 3 * width * height:
        raise ValueError("not a whole 8-bit PPM picture")
    return samples


def feature_of(payload: bytes) -> str:
    """Mean of each channel, and a hash of how brightness changes along a grid of 8 by 9 cells."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3).astype(np.int64)
    means = grid.sum(axis=(0, 1)) // (grid.shape[0] * WIDTH)
    light = grid.sum(axis=2)
    rows = np.linspace(0, light.shape[0], 9).astype(int)
    cols = np.linspace(0, WIDTH, 10).astype(int)
    cum = np.zeros((light.shape[0] + 1, WIDTH + 1), np.int64)
    cum[1:, 1:] = light.cumsum(0).cumsum(1)
    total = cum[rows[1:]][:, cols[1:]] - cum[rows[:-1]][:, cols[1:]] - cum[rows[1:]][:, cols[:-1]] + cum[rows[:-1]][:, cols[:-1]]
    area = np.maximum(1, np.diff(rows)[:, None] * np.diff(cols)[None, :])
    bits = (np.diff(total * 1000 // area, axis=1) > 0).ravel()
    return f"{grid.shape[0]}x{WIDTH}:{means[0]}.{means[1]}.{means[2]}:{np.packbits(bits).tobytes().hex()}"


def store(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with ``media`` (stored bytes), ``digest`` and ``n_bytes`` instead of the text."""
    rest = replace_columns(df, "media", "digest", "n_bytes")
    names = [c for c in rest.columns if c != text_col]

    def run(batches):
        for batch in slices(batches, text_col):
            texts = text_bytes(batch.column(text_col))
            media = [pack(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(media, pa.binary())],
                [*names, "n_bytes", "digest", "media"],
            )

    schema = T.StructType([*(rest.schema[n] for n in names), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("media", T.BinaryType())])
    return rest.mapInArrow(run, schema)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """From stored media (digest, media): what the bytes read back say."""

    def run(batches):
        for batch in slices(batches, "media"):
            stored = batch.column("media").to_pylist()
            samples = [unpack(m) for m in stored]
            columns = [
                batch.column("digest"),
                pa.array([len(s) for s in samples], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in samples]),
                pa.array([zlib.crc32(s[-16:]) for s in samples], pa.int64()),
                pa.array([len(m) for m in stored], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                pa.array([feature_of(s) for s in samples]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["digest", *(f.split()[0] for f in FEATURES.split(", "))])

    return media.select("digest", "media").mapInArrow(run, "digest string, " + FEATURES)


def resolve(refs: DataFrame, media: DataFrame, ref: Column | str = "digest") -> DataFrame:
    """References joined to media rows by digest; media: one row per digest. Unmatched references stay."""
    key = F.col(ref) if isinstance(ref, str) else ref
    right = media.withColumnRenamed("digest", "_digest")
    return refs.withColumn("_ref", key).join(right, F.col("_ref") == F.col("_digest"), "left").drop("_ref", "_digest")


def interleaved(data: bytes, digest: str) -> str:
    """A document's page: the first half of its text by lines, its picture with a caption, the rest."""
    text = data.decode(errors="replace")
    lines = text.split("\n")
    half = (len(lines) + 1) // 2
    caption = f"{len(data)} bytes: {' '.join(text.split(None, 5)[:5])}"
    part = lambda xs: "".join(f"<p>{escape(x)}</p>" for x in xs)
    return f'<article>{part(lines[:half])}<figure><img src="sha256:{digest}" alt="payload"><figcaption>{escape(caption)}</figcaption></figure>{part(lines[half:])}</article>'


def pages(kept: DataFrame) -> DataFrame:
    """Of stored media (doc_id, n_bytes, digest, media): (doc_id, n_bytes, html), the page of each, from the stored bytes."""
    kind = kept.schema["doc_id"]

    def run(batches):
        for batch in slices(batches, "media"):
            sizes, digests = batch.column("n_bytes").to_pylist(), batch.column("digest").to_pylist()
            html = [interleaved(unpack(m)[:n], d) for m, n, d in zip(batch.column("media").to_pylist(), sizes, digests)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(html, pa.string())], ["doc_id", "n_bytes", "html"])

    return kept.select("doc_id", "n_bytes", "digest", "media").mapInArrow(run, T.StructType([kind, T.StructField("n_bytes", T.LongType()), T.StructField("html", T.StringType())]))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as an interleaved document: its own lines around a picture that holds it whole. The picture is stored, found
    again in the parsed page, joined by digest and described. Only what the picture's bytes say travels through the join:
    payloads of a digest are read where they are stored."""
    scratch = Scratch(docs.sparkSession)
    kept = scratch.save(store(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "media")
    parsed = parse(pages(kept)).drop("html")
    items = parsed.select("doc_id", "n_bytes", F.size("items").alias("n_items"), F.filter("items", lambda x: x["kind"] == "text").alias("texts"), F.inline("items"))
    refs = items.where(F.col("ref").startswith("sha256:")).select(
        "doc_id", "n_bytes", "position", "n_items", F.sha2(F.array_join(F.transform("texts", lambda x: x["text"]), "\n"), 256).alias("texts_sha256"), "caption", F.expr("substring(ref, 8)").alias("digest")
    )
    # one row per digest: partial aggregates first, so a text in many copies isn't gathered; written, so that both sides
    # of the join are dealt anew and Spark can split the references of a digest that many documents share
    seen = [f.split()[0] for f in FEATURES.split(", ")]
    media = scratch.save(describe(kept).groupBy("digest").agg(*(F.min(c).alias(c) for c in seen)), "media-features")
    return scratch.finish(resolve(refs, media).select("doc_id", "n_bytes", *seen, "position", "n_items", "caption", "texts_sha256"), "media-documents")
