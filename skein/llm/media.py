"""Interleaved document sequences: HTML to ordered texts and media references, resolved against a store by digest."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices

#: A digest with at least this part of all references is hot: there are at most as many as its inverse, so they are broadcast.
HOT = 1e-3
#: Samples in a row of the stored image; payloads are padded with zero bytes to a multiple of it.
WIDTH = 64
#: Elements whose content is left out, once they are closed: one that never is may hold the rest of the page, which stays.
_SKIP = {"noscript", "template", "nav"}
#: Elements of raw text that is never content.
_RAW = {"script", "style", "title"}
#: What may stand in a head; any other tag or text ends a head that was not closed.
_HEAD = {"head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
_BLOCK = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "table", "blockquote", "pre", "figure", "figcaption", "body", "main", "footer", "header"}
_FIGURE = re.compile(r"<(/?)(figcaption|figure)\b", re.IGNORECASE)

ITEM = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("caption", T.StringType())])


def _unclosed(html: str) -> list[bool]:
    """For each figcaption, whether neither it nor its figure is closed before the next one begins."""
    marks = [(m[1], m[2].lower()) for m in _FIGURE.finditer(html)]
    return [(marks[k + 1][0] if k + 1 < len(marks) else "") != "/" for k, m in enumerate(marks) if m == ("", "figcaption")]


class _Sequence(HTMLParser):
    """Texts by block and media references in document order; a figure's caption belongs to its media, before or after it."""

    def __init__(self, unclosed: list[bool]):
        super().__init__(convert_charrefs=True)
        self.unclosed = iter(unclosed)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.raw = 0
        self.head = False
        self.skipped: list[tuple[str, int]] = []  # open elements that are left out when they close, and where they began
        self.figure: list[dict] | None = None  # media of the open figure
        self.caption: list[str] | None = None  # the open figcaption
        self.open_ended = False
        self.said = ""  # the figure's caption

    def flush(self):
        if text := " ".join("".join(self.words).split()):
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.words = []

    def end_caption(self):
        if self.caption is not None:
            self.said, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.figure or ():
                item["caption"] = self.said or item["caption"]

    def end_figure(self):
        self.end_caption()
        if self.figure is not None and not self.figure and self.said:  # a caption of nothing is text
            self.words.append(self.said)
            self.flush()
        self.figure, self.said = None, ""

    def handle_starttag(self, tag, attrs):
        if self.head and tag not in _HEAD:
            self.head = False
        if tag == "head":
            self.head = True
        if tag in _RAW:
            self.raw += 1
        if self.raw:
            return
        if self.caption is not None and self.open_ended and tag in _BLOCK:
            self.end_figure()
        if tag in _SKIP:
            self.flush()
            self.skipped.append((tag, len(self.items)))
        if tag in _BLOCK and self.caption is None:
            self.flush()
        if tag == "figure":
            self.end_figure()
            self.figure = []
        elif tag == "figcaption":
            self.open_ended = next(self.unclosed, False)
            if self.figure is not None:
                self.end_caption()
                self.caption = []
        elif tag in _MEDIA and (ref := dict(attrs).get("src")):
            self.flush()
            item = {"kind": "media", "text": None, "ref": ref, "caption": (self.said if self.figure is not None else "") or dict(attrs).get("alt") or None}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_endtag(self, tag):
        if tag in _RAW:
            self.raw = max(0, self.raw - 1)
        elif tag == "head":
            self.head = False
        elif tag in _SKIP:
            if tag in (names := [t for t, _ in self.skipped]):
                at = len(names) - 1 - names[::-1].index(tag)
                del self.items[self.skipped[at][1] :], self.skipped[at:]
                self.words = []
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        if tag in _BLOCK and self.caption is None and not self.raw:
            self.flush()

    def handle_data(self, data):
        if self.raw:
            return
        if self.head:
            if not data.strip():
                return
            self.head = False
        (self.words if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    """The items of one page, positions from 0; broken HTML gives what can be read of it.

    Tags that may be left out are not needed: a head ends where content begins. An element that is left out and never
    closed keeps its content; an unclosed figcaption ends at the next block; a caption without media is text.
    """
    parser = _Sequence(_unclosed(html or ""))
    parser.feed(html or "")
    parser.close()
    parser.end_figure()
    parser.flush()
    return [{"pos": k, **item} for k, item in enumerate(parser.items)]


def interleave(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, items): for each row the ordered array of (pos, kind, text, ref, caption). Null or empty HTML: an empty array."""
    source = pages.select(F.col(key).alias("key"), F.col(html).cast("string").alias("html"))
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("items", T.ArrayType(ITEM))])
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                items = [sequence_of(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(items, kind)], names=schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_media(payload: bytes) -> bytes:
    """A binary greymap: one 8-bit sample for each byte, WIDTH to a row."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> bytes:
    kind, size, _, data = media.split(b"\n", 3)
    columns, rows = map(int, size.split())
    if kind != b"P5" or len(data) != columns * rows:
        raise ValueError("not a whole greymap")
    return data


def store(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Write (key, n_bytes, digest, media) of each row to the shared folder: its payload as a media file, lossless.

    ``payload`` is a binary column; null is empty. The digest is SHA-256 of the padded payload.
    """
    source = rows.select(F.col(key).alias("key"), F.coalesce(F.col(payload), F.lit(b"")).alias("payload"))
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "payload"):
                raw = part.column("payload").to_pylist()
                full = [padded(x) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(map(len, raw), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in full], pa.string()), pa.array([to_media(x) for x in full], pa.binary())], names=schema.names
                )

    return cut(source.mapInArrow(run, schema), compression="zstd").withColumnRenamed("key", key)


def feature_of(samples: np.ndarray) -> str:
    """Shape, mean, range, level changes and quarters of the level histogram, in whole numbers: equal bytes, equal text."""
    quarter = np.bincount(samples >> 6, minlength=4)
    change = int(np.abs(np.diff(samples.astype(np.int16))).sum()) if len(samples) > 1 else 0
    return f"{WIDTH}x{len(samples) // WIDTH};mean={int(samples.sum(dtype=np.int64)) // len(samples)};min={samples.min()};max={samples.max()};change={change // len(samples)};hist=" + "-".join(map(str, quarter.tolist()))


def read_features(stored: DataFrame) -> DataFrame:
    """One row for each digest of a store, from the bytes read back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Features are computed where the media are read, so only they are shuffled; copies of one payload meet as one row.
    """
    schema = T.StructType.fromDDL("digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                out = []
                for digest, media in zip(part.column("digest").to_pylist(), part.column("media").to_pylist(), strict=True):
                    data = from_media(media)
                    out.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(np.frombuffer(data, np.uint8))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    return stored.select("digest", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def resolve(sequences: DataFrame, key: str, stored: DataFrame, scheme: str = "sha256:") -> DataFrame:
    """(key, items) with each media reference ``sha256:<digest>`` joined to what the store holds for it.

    Items keep their positions and captions; ``media`` is null for texts and for references that the store lacks. The
    references to a hot digest are dealt to several copies of what the store holds for it.
    """
    item = sequences.select(F.col(key).alias("key"), F.posexplode_outer("items").alias("at", "item"))
    item = item.withColumn("digest", F.when(F.col("item.ref").startswith(scheme), F.substring(F.col("item.ref"), len(scheme) + 1, 64)))
    item = cut(item)
    total = item.where("digest is not null").count()
    hot = item.where("digest is not null").groupBy("digest").count().where(F.col("count") >= max(64.0, HOT * total))
    hot = hot.select("digest", F.ceil(F.col("count") / max(64.0, HOT * total)).alias("shares"))
    shares = F.coalesce("shares", F.lit(1))
    features = read_features(stored)
    features = features.select(F.col("digest"), F.struct(*[c for c in features.columns if c != "digest"]).alias("media"))
    features = features.join(F.broadcast(hot), "digest", "left").select("digest", "media", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("salt"))
    found = item.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("key", "at"), shares)).drop("shares").join(features, ["digest", "salt"], "left")
    whole = F.struct(F.col("item.pos").alias("pos"), F.col("item.kind").alias("kind"), F.col("item.text").alias("text"), F.col("item.ref").alias("ref"), F.col("item.caption").alias("caption"), "media")
    return found.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), whole))).alias("items"))


def document_media(docs: DataFrame) -> DataFrame:
    """Each row's whole text as a stored media file: written, referenced from a page, resolved by digest, read back.

    One row for each row of ``docs``: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, pos, caption. A null text is empty (64 zero bytes); texts may be of any length up to what a
    row can hold. Null or repeated doc_ids are rows like any other; a null source gives an empty caption. Extra columns
    are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), (F.col("source") if "source" in docs.columns else F.lit(None)).cast("string").alias("source")).alias("key"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    stored = store(rows, "key", "payload")
    caption = F.coalesce(F.regexp_replace(F.regexp_replace("key.source", "&", "&amp;"), "<", "&lt;"), F.lit(""))
    pages = stored.select("key", "n_bytes", F.concat(F.lit('<figure><img src="sha256:'), "digest", F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>")).alias("html"))
    sequences = interleave(pages.select(F.struct("key", "n_bytes").alias("page"), "html"), "page")
    item = resolve(sequences, "page", stored).select("page", F.inline("items")).where("kind = 'media'")
    return item.select(F.col("page.key.doc_id").alias("doc_id"), F.col("page.n_bytes").alias("n_bytes"), "media.*", "pos", "caption")
