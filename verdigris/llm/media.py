"""Media columns as interleaved document sequences.

HTML is parsed into an ordered array of structs, text items and media references in the order of the page.  A reference carries the digest of its
payload and the caption that the page gives it; payloads live once in a store keyed by digest, and a join on the digest resolves them.  Position
and caption stay in the sequence, so resolved items go back to their places whatever order the join returns.

Payloads are 8-bit mono PCM in WAV containers: ``pack`` pads bytes with zeros to a positive multiple of 64 and writes them as samples,
``unpack`` reads the samples of the stored form back.

Edge cases: null or empty text is a payload of 64 zero bytes; null HTML gives an empty sequence; a reference without payload in the store keeps its
place with null features; equal payloads of a batch are stored once, and described once; repeated rows give repeated rows; extra columns pass through ``sequences`` untouched, and
columns with the name of the added one are replaced; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, written

RATE = 8000
UNIT = 64
#: Elements whose text is not part of a page's reading order.
SILENT = {"script", "style", "template", "noscript", "title"}
#: Elements that a head may hold; any other one ends it, whether its end tag is there or not.
IN_HEAD = {"html", "head", "base", "link", "meta"} | SILENT
#: Elements that end a run of text.
BLOCK = {"p", "div", "article", "section", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "nav", "header", "footer", "main", "blockquote", "pre", "body"}
MEDIA = {"img", "audio", "video", "source", "embed"}

ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pack(data: bytes) -> bytes:
    """The stored form: WAV, 8-bit unsigned mono, zero bytes after the data up to a positive multiple of 64."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    head = b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", size)
    return head + data + bytes(size - len(data))


def unpack(stored: bytes) -> bytes:
    """The samples of a stored form, found by walking its chunks; ValueError for anything else."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, bits = 12, 0
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        if name == b"fmt ":
            bits = int.from_bytes(stored[at + 22 : at + 24], "little")
        if name == b"data":
            if bits != 8 or at + 8 + size > len(stored):
                raise ValueError("not whole 8-bit samples")
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def feature(samples: bytes) -> str:
    """Seconds, peak, root mean square, crossings of the middle, and shares of eight amplitude ranges, as one string."""
    x = np.frombuffer(samples, np.uint8)
    shares = np.bincount(x >> 5, minlength=8)
    centred = x.astype(np.int16) - 128
    crossings = int(np.count_nonzero(np.diff(x >> 7)))
    energy = int(np.dot(centred.astype(np.int64), centred))
    return f"{len(x) / RATE:.6f}|{int(np.abs(centred).max(initial=0))}|{(energy / max(1, len(x))) ** 0.5:.6f}|{crossings}|" + ",".join(map(str, shares))


class _Page(HTMLParser):
    """Collects (kind, text, digest, caption) in page order; no text of a page is lost but that of silent elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.silent: list[str] = []
        self.in_head = False
        self.caption: list[str] | None = None
        self.figure: list[list] | None = None

    def end_run(self) -> None:
        text = "".join(self.run).strip()
        self.run.clear()
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        """The caption goes to the media of its figure, or to the one just before; without any it is text."""
        if self.caption is None:
            return
        text, self.caption = "".join(self.caption).strip(), None
        if not text:
            return
        held = self.figure if self.figure is not None else self.items[-1:]
        media = [x for x in held if x[0] == "media"]
        for item in media:
            item[3] = text
        if not media:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.in_head and tag not in IN_HEAD:
            self.in_head = False
        if tag == "head":
            self.in_head = True
        if tag in SILENT:
            self.silent.append(tag)
            return
        if tag in ("figure", "figcaption", "body", "article", "section", "main"):
            self.end_caption()  # a caption doesn't reach over these
        if tag in BLOCK or tag in MEDIA:
            self.end_run()
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.end_run()
            self.caption = []
        if tag in MEDIA and not self.silent:
            found = dict(attrs)
            src = found.get("src") or found.get("href") or ""
            item = ["media", None, src.removeprefix("media:sha256:"), found.get("alt") or found.get("title")]
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in SILENT:  # one that closes itself holds nothing
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            if tag in self.silent:  # what was left open inside it ends with it
                del self.silent[self.silent.index(tag) :]
            return
        if tag == "head":
            self.in_head = False
        if tag in ("figcaption", "figure", "body", "html"):
            self.end_caption()
        if tag in BLOCK:
            self.end_run()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if self.silent or (self.in_head and not data.strip()):
            return
        self.in_head = False  # text ends a head too
        (self.run if self.caption is None else self.caption).append(data)

    def finish(self) -> None:
        self.close()
        self.end_caption()
        self.end_run()


def parse(page: str | None) -> list[dict]:
    """The page as ordered items; broken markup gives what the parser can make of it."""
    if not page:
        return []
    parser = _Page()
    parser.feed(page)
    parser.finish()
    return [{"position": i, "kind": k, "text": t, "digest": d, "caption": c} for i, (k, t, d, c) in enumerate(parser.items)]


def sequences(pages: DataFrame, html_column: str = "html", into: str = "items") -> DataFrame:
    """Pages with an array of their text and media items in order, in place of the HTML."""
    pages = pages.drop(into) if into in pages.columns and into != html_column else pages
    keep = [f for f in pages.schema.fields if f.name != html_column]
    schema = T.StructType([*keep, T.StructField(into, T._parse_datatype_string(ITEM))])
    names = [f.name for f in keep]
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            items = pa.array([parse(x) for x in batch.column(batch.schema.get_field_index(html_column)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], items], [*names, into])

    return pages.select(*names, html_column).mapInArrow(run, schema)


def page_of(data: bytes, text: str) -> str:
    """A page that shows a document: its whole text, then a figure with its payload by digest, captioned by length."""
    digest = hashlib.sha256(pack(data)).hexdigest()
    return f'<article><p>{html.escape(text, quote=False)}</p><figure><img src="media:sha256:{digest}"><figcaption>{len(data)} bytes</figcaption></figure></article>'


def documents_as_pages(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, digest of the one reference, position, caption) of each document's page, parsed from its HTML."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            found = [[x for x in parse(page_of((t or "").encode(), t or "")) if x["kind"] == "media"][-1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x["digest"] for x in found], pa.string()), pa.array([x["position"] for x in found], pa.int32()), pa.array([x["caption"] for x in found], pa.string())], ["id", "digest", "position", "caption"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(run, f"id {kind}, digest string, position int, caption string")


def digest_of(text: Column) -> Column:
    """The digest that the store has a text's payload under, as a column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.sha256(pack((t or "").encode())).hexdigest())

    return F.pandas_udf(run, "string")(F.coalesce(text, F.lit("")))


def store(docs: DataFrame) -> DataFrame:
    """digest, media: the stored form of every text, equal ones of a batch once; readers keep one row a digest, so no payload is shuffled to find copies."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            media = list({(m := pack((t or "").encode())): hashlib.sha256(m).hexdigest() for t in batch.column(0).to_pylist()}.items())
            yield pa.RecordBatch.from_arrays([pa.array([d for _, d in media], pa.string()), pa.array([m for m, _ in media], pa.binary())], ["digest", "media"])

    return docs.select("text").mapInArrow(run, "digest string, media binary")


def described(media: DataFrame) -> DataFrame:
    """digest -> what is computed from the samples that the stored form holds, read back; one row for each digest.

    The features are computed beside the stored bytes and before the shuffle, so no payload moves.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            rows = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples = unpack(stored)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").dropDuplicates(["digest"])


def resolved(items: DataFrame, media: DataFrame) -> DataFrame:
    """Items (id, digest, position, caption) with what the store has for their digests; items without payload stay."""
    return items.join(media, "digest", "left")


def interleaved(pages: DataFrame, media: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, items): each page's sequence in order, every media item with the columns that the store has for its digest, null where it has none.

    Items meet the store by digest and go back to their places by position, so the order of the join doesn't matter; texts stay out of the join.  Pages without items have an empty array.
    """
    parsed = written(sequences(pages.select(F.monotonically_increasing_id().alias("page"), F.col(id_column).alias("id"), F.col(html_column).alias("html"))), "page-sequences")
    columns = [c for c in media.columns if c != "digest"]
    refs = parsed.select("page", F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("x")).select("page", F.col("x.position").alias("position"), F.col("x.digest").alias("digest"))
    # a digest that many pages share is looked up once
    described_once = media.dropDuplicates(["digest"]).select("digest", F.struct(*columns).alias("media"))
    known = refs.select("digest").distinct().join(described_once, "digest", "left")
    found = refs.join(known, "digest", "left").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("position", "media"))).alias("of"))  # a page's items
    whole = parsed.join(found, "page", "left")
    return whole.select(F.col("id").alias(id_column), F.transform("items", lambda x: x.withField("media", F.try_element_at("of", x["position"]))).alias("items"))


def document_media(docs: DataFrame) -> DataFrame:
    """Each document's payload by its page: the store is written and read back, parsed references meet it by digest, features come from the samples read."""
    stored = written(store(docs), "media-store", "zstd")
    found = resolved(documents_as_pages(docs), described(stored))
    return found.select(F.col("id").alias("doc_id"), F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")
