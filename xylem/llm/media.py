"""Media columns: documents as ordered sequences of text and media references, with payloads resolved by digest.

``interleave`` parses HTML into a sequence of items in page order; an item is a run of text or a media reference with its
caption. ``store`` keeps payloads under the SHA-256 of their stored form. ``resolve`` looks references up in the store: the joined
rows carry the item's position and caption, so what was beside a picture in the page still is. Payloads never travel through a
join: features are computed where a payload is stored, once per stored copy, and the join by digest carries features only.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import Staging

#: Samples in a row of the stored picture, and how a reference names a digest.
ROW, SCHEME = 64, "media:"
ITEM = "position int, kind string, text string, ref string, caption string"


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, then bytes 0 up to a positive multiple of ROW."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def to_picture(payload: bytes) -> bytes:
    """A binary grey map with ROW samples of 8 bits in a row; nothing is lost."""
    return b"P5 %d %d 255\n" % (ROW, len(payload) // ROW) + payload


def samples_of(picture: bytes) -> bytes:
    """The samples of a binary grey map, as its header describes them."""
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", picture)
    if not head or len(picture) - head.end() != int(head[1]) * int(head[2]):
        raise ValueError("not a grey map of 8-bit samples")
    return picture[head.end() :]


def feature_of(samples: bytes) -> str:
    """Shape, sum, spread and a coarse histogram of the samples, in whole numbers."""
    x = np.frombuffer(samples, np.uint8)
    histogram = np.bincount(x >> 5, minlength=8)
    values = x.astype(np.int64)
    return f"{ROW}x{len(x) // ROW} sum={values.sum()} squares={(values * values).sum()} hist={','.join(map(str, histogram))}"


class _Items(HTMLParser):
    """Text runs and media references in page order. A figure's caption belongs to all its media."""

    MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "source"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.run, self.caption, self.figure, self.hidden = [], [], None, None, 0

    def end_run(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append([len(self.items), "text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.MEDIA:
            found = dict(attrs)
            if found.get("src"):
                self.end_run()
                self.items.append([len(self.items), self.MEDIA[tag], None, found["src"], found.get("alt")])
                if self.figure is not None:
                    self.figure.append(self.items[-1])
        elif tag == "figure":
            self.end_run()
            self.figure = []
        elif tag == "figcaption" and self.figure is not None:
            self.end_run()
            self.caption = []
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "td", "tr"):
            self.end_run()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            for item in self.figure or ():
                item[4] = " ".join("".join(self.caption).split())
            self.caption = None
        elif tag == "figure":
            self.figure = None
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "td", "tr"):
            self.end_run()

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def items_of(html: str | None) -> list[list]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser.end_run()
    return parser.items


def interleave(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """key and items (array of struct(position, kind, text, ref, caption)) of every row; null and empty pages have no items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["position", "kind", "text", "ref", "caption"]
        kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in names[1:])]))
        for batch in batches:
            rows = [[dict(zip(names, i, strict=True)) for i in items_of(h.as_py())] for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], [key, "items"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).alias("html")).mapInArrow(run, f"`{key}` {kind}, items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")


def to_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document as a page that shows its text's bytes as a picture: key, html, digest and picture. The alternative text is
    the number of bytes, the caption is the key, and the page itself says both in front of the picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, digests, pictures = [], [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = value.as_py()
                picture = to_picture(payload_of(value))
                digest = hashlib.sha256(picture).hexdigest()
                caption = f"{len((value or '').encode())} bytes of {'' if name is None else escape(str(name))}"
                pages.append(f'<article><p>Document {caption}</p><figure><img src="{SCHEME}{digest}"><figcaption>{caption}</figcaption></figure></article>')
                digests.append(digest)
                pictures.append(picture)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages), pa.array(digests), pa.array(pictures, pa.binary())], ["key", "html", "digest", "picture"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, html string, digest string, picture binary")


def features(stored: DataFrame) -> DataFrame:
    """digest and what is read back from its picture; one row per distinct digest.

    Rows are features, not payloads, when they meet by digest; partial aggregation leaves one of them per task and digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, picture in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                picture = picture.as_py()
                samples = samples_of(picture)
                out.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(picture), hashlib.sha256(picture).hexdigest(), feature_of(samples)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    made = stored.select("digest", "picture").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return made.dropDuplicates(["digest", "payload_sha256"])


def resolve(sequences: DataFrame, media: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each item: key, its position, kind, text, ref and caption, and the media columns of the digest it refers to.

    Text items and references to unknown digests keep their rows, with null media columns.
    """
    items = sequences.select(key, F.explode("items").alias("i")).select(key, "i.*")
    return items.withColumn("digest", F.when(F.startswith("ref", F.lit(SCHEME)), F.substr("ref", F.lit(len(SCHEME) + 1)))).join(media, "digest", "left")


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's picture, read back: key, n_bytes, position, caption and the features of the stored form.

    Null and empty texts are one row of zeros. Equal texts share a digest and so all values; repeated rows and null keys are kept,
    each with its own page. Other columns of docs are not read, whatever their names. An empty input has no rows. A very long text
    and its picture are in the memory of a task as a whole.
    """
    staging = Staging(docs.sparkSession, "media")
    pages = staging.save(to_pages(docs, key, text), "pages")
    shown = resolve(interleave(pages, "key"), features(pages), "key").filter("kind = 'image'")
    n_bytes = F.regexp_extract("caption", r"^(\d+) bytes", 1).cast("long")
    return shown.select(F.col("key").alias(key), n_bytes.alias("n_bytes"), "position", "caption", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
