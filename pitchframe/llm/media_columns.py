"""Media columns: interleaved sequences of text and media whose payloads a digest join resolves.

A page is parsed into an ordered array of structs (kind, text, digest, url, caption): runs of text and references to
media, by digest or by another URL, whose digest is null. Payloads live once each in a store keyed by their digest, as 8-bit grey PNG images 64 samples wide, which is
lossless. References are joined to the store by digest; what is asked of a payload (its bytes, or features of what the
stored form decodes to) is computed once a stored payload, so that a picture that a third of all pages show is read back
once. Positions and captions stay with their references.

Defined results: null texts count as empty; an empty text is a payload of 64 zero bytes; a reference without a stored
payload stays in its sequence with a null payload; a page without markup is one run of text; null pages have empty
sequences; rows that repeat each keep their sequence; further columns of pages survive in `sequences`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.llm.common import documents, text_batches, text_of

WIDTH = 64
LEVEL = 1  # of deflate: the stored form moves between machines, but time counts more than its last tenth
# The first bytes of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,url:string,caption:string>>"
STORED = "digest string, n_bytes long, media binary"
READ_BACK = (
    "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, feature string"
)


def padded(text: bytes) -> bytes:
    """With zero bytes up to a positive multiple of WIDTH."""
    return text + bytes(max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunks = [
        (b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)),
        (b"IDAT", zlib.compress(rows.tobytes(), LEVEL)),
        (b"IEND", b""),
    ]
    return SIGNATURE + b"".join(
        struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data)) for kind, data in chunks
    )


def from_png(media: bytes) -> np.ndarray:
    """The samples of a stored image, as rows."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a stored image")
    at, packed, height = 8, [], 0
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            height = struct.unpack(">I", data[4:8])[0]
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)[:, 1:]


def features(samples: np.ndarray) -> str:
    """Mean, deviation and share of zeros of the samples, and how much neighbours differ, in fixed decimals."""
    flat = samples.reshape(-1).astype(np.int64)
    n = len(flat)
    mean = flat.sum() / n
    spread = max(0.0, (flat * flat).sum() / n - mean * mean) ** 0.5
    step = np.abs(np.diff(flat)).sum() / max(1, n - 1)
    return f"{samples.shape[0]}x{WIDTH};{mean:.4f};{spread:.4f};{(flat == 0).sum() / n:.4f};{step:.4f}"


def media_store(texts: DataFrame) -> DataFrame:
    """texts(text) to the store: digest, n_bytes and the stored form of each different text once.

    Copies meet before the shuffle within a task and after it by digest."""

    text_batches(texts.sparkSession)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, tuple[int, bytes]] = {}
            for text in batch.column(0):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                payload = padded(raw)
                digest = hashlib.sha256(raw).hexdigest()
                if digest not in seen:
                    seen[digest] = (len(raw), to_png(payload))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(seen), pa.string()),
                    pa.array([x[0] for x in seen.values()], pa.int64()),
                    pa.array([x[1] for x in seen.values()], pa.binary()),
                ],
                names=["digest", "n_bytes", "media"],
            )

    return texts.mapInArrow(stored, STORED).dropDuplicates(["digest"])


def read_back(store: DataFrame) -> DataFrame:
    """The store to what its stored bytes decode to, once a payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n, media in zip(*(batch.column(i).to_pylist() for i in range(3))):
                samples = from_png(media)
                payload = samples.tobytes()
                rows.append(
                    {
                        "digest": digest,
                        "n_bytes": n,
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-WIDTH:]),
                        "media_bytes": len(media),
                        "media_sha256": hashlib.sha256(media).hexdigest(),
                        "feature": features(samples),
                    }
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return store.mapInArrow(run, READ_BACK)


class _Sequence(HTMLParser):
    """Collects runs of text and media references in their order."""

    HIDDEN = {"script", "style", "template"}
    IN_HEAD = {"title"}  # the rest of a head has no text of its own, so a head that nobody closes hides nothing

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "url": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        if tag in self.HIDDEN or tag in self.IN_HEAD:
            self.hidden += 1
        elif tag in ("img", "audio", "video", "source") and own.get("src"):
            self.flush()
            digest = own["src"][7:] if own["src"].startswith("sha256:") else None
            self.items.append({"kind": "media", "text": None, "digest": digest, "url": own["src"], "caption": own.get("alt")})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("p", "div", "h1", "h2", "h3", "li", "br", "tr", "figure", "article", "section"):
            self.run.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN or tag in self.IN_HEAD:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            last = next((x for x in reversed(self.items) if x["kind"] == "media"), None)
            if last is not None:
                last["caption"] = text
            elif text:
                self.items.append({"kind": "text", "text": text, "digest": None, "url": None, "caption": None})
        elif tag in ("p", "div", "h1", "h2", "h3", "li", "tr", "figure", "article", "section"):
            self.flush()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section isn't HTML: it is a comment up to the next >, as in a browser."""
        return self.parse_bogus_comment(i, 0)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def parsed(html: str | None) -> list[dict]:
    page = _Sequence()
    page.feed(html or "")
    page.close()
    page.flush()
    return [{"position": i, **x} for i, x in enumerate(page.items)]


def sequences(pages: DataFrame, html_col: str | Column = "html", out: str = "sequence") -> DataFrame:
    """pages with the ordered sequence of each."""

    @F.pandas_udf(SEQUENCE)
    def sequence_of(html: pd.Series) -> pd.Series:
        return html.map(parsed)

    return pages.withColumn(out, sequence_of(F.col(html_col) if isinstance(html_col, str) else html_col))


def resolved(pages: DataFrame, store: DataFrame, sequence_col: str = "sequence", key: str = "doc_id") -> DataFrame:
    """A row for each element of each sequence, with the columns of store for its digest (null without a payload)."""
    items = pages.select(key, F.explode(sequence_col).alias("x")).select(key, "x.*")
    return items.join(store.withColumnRenamed("digest", "stored"), F.col("digest") == F.col("stored"), "left").drop("stored")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page that shows its payload: the features of what the stored payload reads back as.

    The text itself is the payload; its page names it by digest, between a heading and a caption."""
    docs = documents(spark, sf_dir)
    text = text_of("text")
    page = F.concat(
        F.lit("<article><h1>document "),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.lit('</h1><figure><img src="sha256:'),
        F.sha2(text, 256),
        F.lit('"><figcaption>'),
        F.coalesce(F.length(text).cast("string"), F.lit("0")),
        F.lit(" characters</figcaption></figure></article>"),
    )
    pages = sequences(docs.select(F.col("doc_id").cast("long").alias("doc_id"), page.alias("html")))
    store = read_back(media_store(docs.select(text.alias("text"))))
    shown = resolved(pages, store).filter("kind = 'media'")
    return shown.select("doc_id", *[c.split()[0] for c in READ_BACK.split(",")[1:]], "position", "caption")
