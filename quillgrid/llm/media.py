"""Media columns: interleaved sequences of text and media references, with payloads behind digests.

A page's HTML is parsed into an ordered array of parts: text runs and media references (digest, caption), each with its
position. Payloads live once in a media table keyed by the SHA-256 of the payload; a join on the digest resolves the
references. Position and caption stay with the reference, so a sequence is whole again by sorting on position.

Payloads of bytes are stored losslessly as 8-bit greyscale PNG rows of 576 samples.
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
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm.common import bounded_batches, materialize

WIDTH = 576
PAD = b"\xff"
_PNG = b"\x89PNG\r\n\x1a\n"

PART = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType())])

_MEDIA_TAGS = {"img", "audio", "video", "source", "embed"}
_SILENT = {"script", "style", "template", "noscript"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "table", "tr", "td", "th", "article", "section", "header", "footer", "nav", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "title", "body", "head", "html"}


class _Parts(HTMLParser):
    """Collects parts in the order of the page. A figcaption replaces the caption of the figure's media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if run := "".join(self.text).strip(" \t\r\n\f"):
            self.parts.append(["text", run, None, None])
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS or tag in _MEDIA_TAGS:
            self.flush()
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA_TAGS:
            has = dict(attrs)
            source = has.get("data-digest") or has.get("src") or ""
            self.figure.append(len(self.parts))
            self.parts.append(["media", None, source.removeprefix("sha256:"), has.get("alt") or has.get("title")])

    def handle_endtag(self, tag: str) -> None:
        if tag == "figcaption" and self.caption is not None:
            said = "".join(self.caption).strip()
            for k in self.figure:
                self.parts[k][3] = said
            self.caption = None
        elif tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.text.append(data)


def parse_parts(page: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    parser = _Parts()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return [(i, *part) for i, part in enumerate(parser.parts)]


@F.pandas_udf(T.ArrayType(PART))
def parts_of(pages: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(PART.names, part, strict=True)) for part in parse_parts(page)] for page in pages], dtype=object)


def interleave(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, parts): a row for each row of ``pages``; null or empty HTML gives an empty sequence."""
    return bounded_batches(pages).select(F.col(key).alias("key"), parts_of(F.col(page)).alias("parts"))


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """(key, position, caption, digest, and the columns of ``media``): a row for each media reference.

    ``media`` has one row a digest; a reference whose digest it lacks keeps its row with nulls."""
    references = sequences.select("key", F.size("parts").alias("n_parts"), F.explode("parts").alias("part")).where("part.kind = 'media'")
    return references.select("key", "n_parts", "part.position", "part.caption", "part.digest").join(media, "digest", "left")


def png_encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A greyscale 8-bit PNG of rows of ``width`` samples, no row filter; the payload must fill whole rows."""
    height = len(payload) // width
    if not payload or height * width != len(payload):
        raise ValueError(f"payload of {len(payload)} bytes doesn't fill rows of {width}")
    rows = np.zeros((height, width + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, width)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def png_decode(stored: bytes) -> bytes:
    """The samples of such a PNG, checksums verified; other filters, depths or palettes are refused."""
    if not stored.startswith(_PNG):
        raise ValueError("not a PNG")
    at, data, shape = len(_PNG), [], None
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit greyscale without interlace")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(shape)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows")
    return rows[:, 1:].tobytes()


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """Bytes 255 up to a positive multiple of ``width``."""
    return data + PAD * ((-len(data)) % width if data else width)


def feature(payload: bytes) -> str:
    """Mean and deviation in thousandths and an average hash over an 8 by 8 grid of the samples, as text."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    n = len(samples)
    total, square = int(samples.sum(dtype=np.int64)), int(np.dot(samples.astype(np.int64), samples.astype(np.int64)))
    edges = np.arange(65) * n // 64
    sums = np.add.reduceat(samples, edges[:-1], dtype=np.int64)
    above = (sums * n > total * np.diff(edges)).astype(np.uint8)
    return f"{total * 1000 // n};{square * 1000 // n};{np.packbits(above).tobytes().hex()}"


MEDIA = "digest string, n_bytes long, media binary"


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows, seen = [], set()
            for text in batch["text"].iloc[at : at + 256]:
                data = (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass")
                payload = pad(data)
                digest = hashlib.sha256(payload).hexdigest()
                if (digest, len(data)) not in seen:
                    seen.add((digest, len(data)))
                    rows.append((digest, len(data), png_encode(payload)))
            yield pd.DataFrame(rows, columns=["digest", "n_bytes", "media"])


READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for digest, stored in zip(batch["digest"], batch["media"], strict=True):
            payload = png_decode(stored)
            sha = hashlib.sha256(payload).hexdigest()
            if sha != digest:
                raise ValueError(f"payload {digest} was not read back as stored")
            rows.append((digest, len(payload), sha, zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
        yield pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


@F.pandas_udf(T.StringType())
def page_of(texts: pd.Series) -> pd.Series:
    """An HTML page of a text: its lines as paragraphs, then a figure that refers to the text's payload by digest."""
    pages = []
    for text in texts:
        text = text if isinstance(text, str) else ""
        data = text.encode("utf-8", "surrogatepass")
        lines = "".join(f"<p>{html.escape(line)}</p>" for line in text.split("\n"))
        pages.append(f'<article>{lines}<figure><img src="sha256:{hashlib.sha256(pad(data)).hexdigest()}"><figcaption>{len(data)} bytes</figcaption></figure></article>')
    return pd.Series(pages)


def media_store(texts: DataFrame, text: str) -> DataFrame:
    """The written media table (digest, n_bytes, media) of the texts' payloads. A payload may stand in it more than once, from different tasks."""
    return materialize(bounded_batches(texts).select(F.col(text).alias("text")).mapInPandas(_store, MEDIA), "media")


def read_back(media: DataFrame) -> DataFrame:
    """What the stored bytes say, one row a digest; written, so that a join with many references to one digest can split them."""
    read = media.select("digest", "media").mapInPandas(_read, READ)
    return materialize(read.groupBy("digest").agg(*[F.min(c).alias(c) for c in read.columns if c != "digest"]), "media-read")


def documents_as_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its text as an interleaved page whose figure is the text's payload, read back.

    doc_id, n_bytes, payload and media columns, feature, and the reference's position, caption and number of parts.
    Null text counts as empty: a payload of 576 bytes 255. Repeated rows repeat; equal texts share a payload. No rows: none."""
    sequences = interleave(docs.select(F.col(doc_id).alias("key"), page_of(F.col(text)).alias("page")), "key", "page")
    found = resolve(sequences, read_back(media_store(docs, text)))
    n_bytes: Column = F.split_part("caption", F.lit(" "), F.lit(1)).cast("long")
    return found.select(F.col("key").alias("doc_id"), n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("position").alias("media_position"), "caption", "n_parts")
