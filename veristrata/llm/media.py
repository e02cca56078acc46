"""Media columns: documents as ordered sequences of text and media references, with payloads in a digest-keyed store."""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

UNIT = 64
SCHEME = "media:sha256/"
SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
_BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "figure", "figcaption", "br", "blockquote", "pre", "header", "footer", "nav", "main", "title", "body", "html", "head"}
_MEDIA = {"img", "audio", "video", "source", "embed"}


# ---------------------------------------------------------------- stored form


def pad(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of UNIT."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data + bytes(size - len(data))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """A RIFF/WAVE file of one channel of unsigned 8-bit samples: the payload's bytes."""
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def from_wav(media: bytes) -> bytes:
    """The samples of such a file; chunks of other kinds are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        kind, (size,) = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])
        if kind == b"fmt ":
            fmt = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
        elif kind == b"data":
            if fmt is None or fmt[0] != 1 or fmt[5] != 8:
                raise ValueError("not 8-bit PCM")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def features(samples: bytes) -> str:
    """Exact integers of the waveform about 128: frames, sum, energy, sign changes, and sixteen amplitude bins."""
    x = np.frombuffer(samples, dtype=np.uint8)
    c = x.astype(np.int64) - 128
    bins = np.bincount(x >> 4, minlength=16)
    changes = int(np.count_nonzero((c[1:] < 0) != (c[:-1] < 0)))
    return f"frames={len(x)};sum={int(c.sum())};energy={int((c * c).sum())};crossings={changes};bins={','.join(map(str, bins))}"


# ---------------------------------------------------------------- HTML to sequences


class _Sequence(HTMLParser):
    """Text runs and media elements in document order; a figure's caption goes to its media elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None
        self.told = ""
        self.skip = 0

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.end_figure()
            self.figure = []
        elif tag == "figcaption":
            self.end_caption()
            self.caption = []
        elif tag in _MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt") or a.get("title")})

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        if tag in _BLOCKS:
            self.flush()

    def end_caption(self):
        """A caption is held until its figure ends, as media may follow it; without a figure it is text."""
        if self.caption is None:
            return
        text = " ".join("".join(self.caption).split())
        self.caption = None
        if self.figure is None:
            self.run.append(text)
            self.flush()
        else:
            self.told = " ".join(x for x in (self.told, text) if x)

    def end_figure(self):
        """The caption goes to all media of the figure; in a figure without media it is text."""
        self.end_caption()
        if self.told and self.figure:
            for k in self.figure:
                self.items[k]["caption"] = self.told
        elif self.told:
            self.flush()
            self.items.append({"kind": "text", "text": self.told, "ref": None, "caption": None})
        self.figure, self.told = None, ""

    def handle_data(self, data):
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.end_figure()
    p.flush()
    return [{"pos": k} | x for k, x in enumerate(p.items)]


def interleave(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, sequence): for each row the ordered structs (pos, kind text or media, text, ref, caption).

    Null, empty and broken HTML give what can be read of it, at least an empty array; scripts and styles are
    skipped; rows repeat as in pages. A figcaption before or after its media is their caption (several are joined by a
    space); in a figure without media, or outside one, it is text.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse_html(x) for x in b.column(1).to_pylist()], kind)], names=["k", "sequence"])

    src = pages.select(F.col(key).alias("k"), F.col(html).alias("h"))
    return map_batches(src, run, f"k {src.schema['k'].dataType.simpleString()}, sequence {SEQUENCE}").withColumnRenamed("k", key)


def media_items(sequences: DataFrame, key: str) -> DataFrame:
    """(key, pos, caption, digest) for each media reference; digest is null if the reference is not of the store."""
    x = sequences.select(F.col(key), F.explode("sequence").alias("m")).where("m.kind = 'media'")
    digest = F.when(F.startswith(F.col("m.ref"), F.lit(SCHEME)), F.substring("m.ref", len(SCHEME) + 1, 64))
    return x.select(key, F.col("m.pos").alias("pos"), F.col("m.caption").alias("caption"), digest.alias("digest"))


# ---------------------------------------------------------------- store


def store(texts: DataFrame, text: str = "text") -> DataFrame:
    """(digest, media): the stored form of each distinct payload, once; digest is that of the stored form.

    Copies meet in a partial aggregate before the shuffle, so a text that fills a third of the table crosses
    the network once per task at most. Null texts are empty ones: one payload of UNIT zero bytes. Very long texts are
    one payload each. An empty table gives an empty store; other columns are not read.
    """

    def run(batches):
        for b in batches:
            media = [to_wav(pad((x or "").encode())) for x in b.column(0).to_pylist()]
            digest = [hashlib.sha256(m).hexdigest() for m in media]
            yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(media, pa.binary())], names=["digest", "media"])

    return map_batches(texts.select(F.col(text)), run, "digest string, media binary").groupBy("digest").agg(F.first("media").alias("media"))


def describe(stored: DataFrame) -> DataFrame:
    """What is read back from each stored item: payload size and digests, checksum of its tail, features.

    Items that repeat are described each; media that is null or not of the stored form is an error, as the store holds none. An empty store gives an empty table.
    """

    def run(batches):
        for b in batches:
            rows = []
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                payload = from_wav(media)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_DESCRIBED)

    return map_batches(stored.select("digest", "media"), run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_DESCRIBED = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def resolve(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """items (with digest) and the columns that `resolved` has by digest; unknown and null digests keep their place with nulls.

    Items that repeat a digest each get its columns. A column of resolved whose name items has comes with underscores after it.
    """
    for c in resolved.columns:
        if c != "digest" and c.lower() in (x.lower() for x in items.columns):
            new = c + "_"
            while new.lower() in {x.lower() for x in (*items.columns, *resolved.columns)}:
                new += "_"
            resolved = resolved.withColumnRenamed(c, new)
    return items.join(resolved, "digest", "left")


def page_sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, text_sha256, ref, caption, digest): every item of every page in document order.

    digest is that of a reference to the store, else null. A page without items, as a null or empty one, has no row; rows repeat as in pages.
    """
    x = interleave(pages, key, html).select(F.col(key), F.explode("sequence").alias("m"))
    digest = F.when(F.startswith(F.col("m.ref"), F.lit(SCHEME)), F.substring("m.ref", len(SCHEME) + 1, 64))
    return x.select(key, F.col("m.pos").alias("pos"), F.col("m.kind").alias("kind"), F.sha2("m.text", 256).alias("text_sha256"), F.col("m.ref").alias("ref"), F.col("m.caption").alias("caption"), digest.alias("digest"))


def documents_as_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, html): each document as a page that holds one figure, whose media is the whole text.

    Null texts are empty; null keys stay; rows repeat as in docs; an empty table gives an empty one.
    """

    def run(batches):
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            raw = [(x or "").encode() for x in texts]
            html = [
                f'<article><h1>document {k}</h1><figure><img src="{SCHEME}{hashlib.sha256(to_wav(pad(r))).hexdigest()}" alt="text"><figcaption>{len(r)} bytes of document {k}</figcaption></figure></article>'
                for k, r in zip(keys, raw)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(html)], names=["k", "n_bytes", "html"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return map_batches(src, run, f"k {src.schema['k'].dataType.simpleString()}, n_bytes long, html string").withColumnRenamed("k", key)
