"""Interleaved documents: ordered text and media references from HTML, payloads joined by digest.

Payloads live in a table keyed by the SHA-256 of their bytes, stored losslessly as 8-bit grey PNG images of
ROW samples a row. A page's HTML is parsed into an ordered sequence of text and media structs; references are
digests, and a join resolves them while positions and captions stay with their places in the sequence.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drivespan.llm.shared import slices, written

ROW = 576
PAD = 255
SCHEME = "digest:"
PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes of texts or images that a task holds at once; a longer single one is taken whole.
SLICE = 8 << 20
SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


def padded(data: bytes) -> bytes:
    """data with PAD bytes up to a positive multiple of ROW."""
    return data + bytes([PAD]) * (-len(data) % ROW if data else ROW)


def png(samples: bytes) -> bytes:
    """A grey 8-bit PNG of ROW samples a row."""
    height = len(samples) // ROW
    raw = np.zeros((height, ROW + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, ROW)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of an image that png() made; checksums are verified."""
    if image[:8] != PNG:
        raise ValueError("not a PNG")
    at, body, size = 8, b"", (0, 0)
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            body += data
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], size[0] + 1)[:, 1:].tobytes()


class _Sequence(HTMLParser):
    """Collects text runs and media references in order. An image inside a figure takes the figure's caption, else its alt text.

    What stands in scripts, styles, the head and navigation is left out. Tags that are never closed don't swallow the rest of a page: the head ends at the first
    tag or text that may not stand in it; navigation ends with its parent, and counts as content if nothing closes it before the body does; a caption ends with its figure, and
    where nothing closes it only its first run is the caption.
    """

    MEDIA = {"img", "video", "audio", "source"}
    VOID = {"img", "source", "br", "hr", "meta", "link", "base", "input", "wbr", "area", "col", "embed", "track", "param"}
    IN_HEAD = {"head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
    BLOCKS = {"p", "div", "article", "section", "main", "header", "footer", "aside", "nav", "form", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "table", "tr", "figure", "figcaption", "body", "html"}
    #: End tags of these close what is open inside them.
    HOLDERS = {"div", "article", "section", "main", "header", "footer", "aside", "nav", "form", "ul", "ol", "table", "figure"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.open: list[str] = []
        self.raw = self.head = False
        self.nav: tuple[int, int] | None = None  # what was open, and how many items there were, where it began
        self.figure: int | None = None
        self.caption: int | None = None

    def _flush(self) -> None:
        run = " ".join("".join(self.text).split())
        self.text = []
        if run:
            self.items.append({"kind": "text", "text": run, "ref": None, "caption": None})

    def _close_caption(self, whole: bool) -> None:
        """The text since the caption began goes to the figure's media; if it was not closed, only the first run of it does."""
        if self.caption is None:
            return
        self._flush()
        runs = [x for x in self.items[self.caption :] if x["kind"] == "text"]
        runs, start = runs if whole else runs[:1], self.figure if self.figure is not None else self.caption
        said = " ".join(x["text"] for x in runs)
        self.items = [x for x in self.items if not any(x is r for r in runs)]
        for x in self.items[start:]:
            if x["kind"] == "media" and said:
                x["caption"] = said
        self.caption = None

    def _close_nav(self) -> None:
        self._flush()
        del self.items[self.nav[1] :]
        self.nav = None

    def handle_starttag(self, tag, attrs):
        if self.head and tag not in self.IN_HEAD:
            self.head = False
        if tag in ("script", "style"):
            self.raw = True
        if tag == "head":
            self.head = True
        if tag in self.BLOCKS or tag in self.MEDIA:
            self._flush()
        if tag not in self.VOID:
            self.open.append(tag)
        if tag == "nav" and self.nav is None:
            self.nav = len(self.open) - 1, len(self.items)
        if tag == "figure":
            self._close_caption(whole=True)
            self.figure = len(self.items)
        if tag == "figcaption":
            self._close_caption(whole=True)
            self.caption = len(self.items)
        own = dict(attrs)
        if tag in self.MEDIA and own.get("src") and not self.raw and not self.head:
            self.items.append({"kind": "media", "text": None, "ref": own["src"], "caption": own.get("alt")})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID and self.open and tag not in ("script", "style", "nav", "head", "figure", "figcaption"):
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.raw = False
        if tag == "head":
            self.head = False
        if tag in ("figcaption", "figure"):
            self._close_caption(whole=True)
        if tag == "figure":
            self.figure = None
        if tag in self.BLOCKS:
            self._flush()
        last = next((i for i in reversed(range(len(self.open))) if self.open[i] == tag), None)
        if last is not None and (tag in self.HOLDERS or self.nav is None or last > self.nav[0]):
            del self.open[last:]
            if self.nav and len(self.open) <= self.nav[0] and tag in self.HOLDERS:
                self._close_nav()

    def handle_data(self, data):
        if self.head and data.strip() and "title" not in self.open[-1:] and not self.raw:
            self.head = False
        if not self.raw and not self.head:
            self.text.append(data)

    def sequence(self) -> list[dict]:
        self._close_caption(whole=False)
        self._flush()
        return [{"pos": i, **x} for i, x in enumerate(self.items)]


def parse(html: str | None) -> list[dict]:
    """The ordered items of a page: struct(pos, kind, text, ref, caption); nothing for null or empty HTML."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    return p.sequence()


def sequences(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """(id_col, items): the sequence of each page, rows with the same id apart. Null HTML has an empty sequence; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([parse(h) for h in batch.column(html_col).to_pylist()], kind)], [id_col, "items"])

    own = pages.select(id_col, F.col(html_col).cast("string").alias(html_col))
    return own.mapInArrow(run, own.select(id_col).withColumn("items", F.lit(None).cast(SEQUENCE)).schema)


def store(docs: DataFrame) -> DataFrame:
    """(row, doc_id, caption, digest, n_bytes, image): each whole text as a padded payload in a PNG, keyed by the payload's SHA-256. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data = [(t or "").encode() for t in part.column("text").to_pylist()]
                full = [padded(x) for x in data]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("caption"), pa.array([hashlib.sha256(x).hexdigest() for x in full], pa.string()), pa.array([len(x) for x in data], pa.int64()), pa.array([png(x) for x in full], pa.binary())],
                    ["row", "doc_id", "caption", "digest", "n_bytes", "image"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.substring(F.substring_index(text, "\n", 1), 1, 60).alias("caption"), text.alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, caption string, digest string, n_bytes long, image binary")


def features(media: DataFrame) -> DataFrame:
    """(digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row a digest, from the stored images.

    feature: rows, mean and deviation of the samples, and the share of each eighth of their range. A task gives a digest's
    row once, and Spark keeps one of the tasks'; they are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # digests of the task's images; a hot one's features are computed once
        for part in (p for batch in batches for p in slices(batch, "image", SLICE)):
            out = []
            for digest, n, image in zip(*(part.column(c).to_pylist() for c in ("digest", "n_bytes", "image")), strict=True):
                if (key := bytes.fromhex(digest)) in seen:
                    continue
                seen.add(key)
                data = samples(image)
                x = np.frombuffer(data, np.uint8)
                hist = np.bincount(x >> 5, minlength=8)
                mean = x.mean()
                feature = f"{len(x) // ROW}x{ROW};mean={mean:.4f};std={x.std():.4f};hist=" + ",".join(map(str, hist.tolist()))
                out.append((digest, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = media.select("digest", "n_bytes", "image").mapInArrow(run, schema)
    # UTF-8 never holds the padding's byte, so different texts have different payloads
    return rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")))


def interleaved(items: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """(id_col, sequence): each page's items in order, text and media alike, with what found (digest, ...) knows of a media item's payload as `payload`.

    References of the digest scheme meet found in a join; others, and digests that nothing has, have a null payload. Positions and captions are those of the page. found must be
    a written table, so that a digest that very many pages show meets it straight from a shuffle. Pages without items have an empty sequence; rows of one id are one page.
    """
    flat = items.select(id_col, F.inline("items")).withColumn("digest", F.when((F.col("kind") == "media") & F.col("ref").startswith(SCHEME), F.expr(f"substring(ref, {len(SCHEME) + 1})")))
    known = found.select("digest", F.struct(*(c for c in found.columns if c != "digest")).alias("payload"))
    media = flat.filter("digest is not null").join(known.hint("merge"), "digest", "left")
    rows = media.unionByName(flat.filter("digest is null").withColumn("payload", F.lit(None).cast(known.schema["payload"].dataType)))
    item = F.struct("pos", "kind", "text", "ref", "caption", "digest", "payload")
    kind = rows.select(F.array(item).alias("x")).schema["x"].dataType
    sequence = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))).alias("s")).select(id_col, F.col("s.item").alias("sequence"))
    return items.select(id_col).distinct().join(sequence.hint("merge"), id_col, "left").withColumn("sequence", F.coalesce("sequence", F.array().cast(kind)))


def document_pages(media: DataFrame) -> DataFrame:
    """(row, html): a page for each stored document: its caption as a heading, its payload as a captioned figure, and a closing line with its size."""

    def safe(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    caption = safe(F.col("caption"))
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.col("digest"), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    return media.select("row", F.concat(F.lit("<article><h1>"), caption, F.lit("</h1>"), figure, F.lit("<p>"), F.col("n_bytes").cast("string"), F.lit(" bytes</p></article>")).alias("html"))


def stored_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored payload's features of every document: stored, shown on a page, parsed into an ordered sequence, resolved by digest, and read from the sequence's media item."""
    media = written(store(docs), "media")
    pages = sequences(document_pages(media), "row")
    found = interleaved(pages, written(features(media), "media-features"), "row")
    shown = found.select("row", F.size("sequence").alias("n_items"), F.filter("sequence", lambda x: x["kind"] == "media")[0].alias("m"))
    return media.select("row", "doc_id", "n_bytes").join(shown, "row").select("doc_id", "n_bytes", "m.payload.*", "m.pos", "m.caption", "n_items")
