"""Media columns: interleaved document sequences with payloads resolved by digest.

A page is parsed into an ordered array of structs, text and media references in page order; a
reference has the digest of its payload and the caption of its figure. Payloads are kept once
written in a store of lossless 8-bit greyscale images, described by reading the stored bytes back,
and joined to the references on the digest: `resolve` joins descriptions, `payloads` the stored bytes
themselves. The store is a Parquet table in the shared folder.

Where pages do not refer to the store yet, `place` deals its entries out over them: several figures a page,
one behind each paragraph, so that the sequences of the pages hold both.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, short_batches
from tidemark.llm.html import FLOWS, RAW, events

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:sha256/"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,entry:string,caption:string>>"
#: Pages of a bucket on average, over which the entries of that bucket are dealt out.
BUCKET = 8


def padded(payload: bytes) -> bytes:
    """The payload with bytes 0 up to a positive multiple of 64."""
    return payload + bytes(max(WIDTH, -(-len(payload) // WIDTH) * WIDTH) - len(payload))


def to_image(payload: bytes) -> bytes:
    """A PNG of 8-bit grey samples, 64 wide, one sample per byte; the length must be a multiple of 64."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_image(media: bytes) -> bytes:
    """The payload of a PNG made by `to_image`; raises ValueError where a check sum or the form is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 64 grey samples of 8 bits wide")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, deviation, entropy and the shares of the 16 sample ranges."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / len(payload)
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(p @ (np.arange(256) - mean) ** 2))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum()) + 0.0
    return f"rows={len(payload) // WIDTH};mean={mean:.4f};dev={deviation:.4f};entropy={entropy:.4f};hist=" + ",".join(map(str, counts.reshape(16, 16).sum(axis=1)))


def sequence(html: str | None) -> list[dict]:
    """Text and media references of a page in order. A figure's caption goes to its references and is not
    a text item of its own; an image outside a figure has its alt text as caption. What a reference has behind a #
    names the entry of the store that it means, of those with one digest."""
    items, text, figure, caption = [], [], None, None

    def flush():
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            items.append({"kind": "text", "text": line, "digest": None, "entry": None, "caption": None})

    for kind, _, name, attributes in events(html or ""):
        if kind == "text":
            (text if caption is None else caption).append(unescape(name))
        elif name == "img" and kind == "open":
            if (source := _attribute(attributes, "src")).startswith(SCHEME):
                flush()
                digest, _, entry = source[len(SCHEME) :].partition("#")
                items.append({"kind": "media", "text": None, "digest": digest, "entry": entry or None, "caption": _attribute(attributes, "alt") or None})
        elif name == "figcaption":
            flush()
            if kind == "open" and figure is not None and caption is None:
                caption = []
            elif kind == "close" and caption is not None:
                line = " ".join("".join(caption).split())
                for item in items[figure:]:
                    if item["kind"] == "media":
                        item["caption"] = line or item["caption"]
                caption = None
        elif name not in FLOWS or name == "br":
            flush()
            if name == "figure":
                figure = len(items) if kind == "open" else None
    if caption is not None:
        text[:] = caption
    flush()
    return [{"position": i, **item} for i, item in enumerate(items)]


def _attribute(attributes: str, name: str) -> str:
    m = re.search(rf"""\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", attributes, re.IGNORECASE)
    return unescape(next((g for g in m.groups() if g is not None), "")) if m else ""


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every text's padded UTF-8 bytes as an image: id, n_bytes, digest and media, read back from
    the shared folder. A null text counts as empty and has 64 zero bytes; a very long one is one tall image; rows that
    repeat have a row each; an empty table gives an empty store."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(1)]
                full = [padded(r) for r in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in full], pa.string()), pa.array([to_image(f) for f in full], pa.binary())], [id_col, "n_bytes", "digest", "media"])

    short_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return materialize(narrow.mapInArrow(run, f"{id_col} {narrow.schema[0].dataType.simpleString()}, n_bytes long, digest string, media binary"))


def describe(stored: DataFrame) -> DataFrame:
    """One row per digest, from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Raises where a stored image does not give back the payload of its digest. An empty store gives no rows.
    """

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = media.as_py()
                payload = from_image(media)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"the store holds another payload for {digest}")
                for column, value in zip(out, (digest, len(payload), found, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)), strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = stored.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    rest = [c for c in rows.columns if c != "digest"]
    # Copies agree in every column, so any row of a digest stands for all; the partial step leaves one per task.
    return rows.groupBy("digest").agg(F.max(F.struct(*rest)).alias("d")).select("digest", *(F.col(f"d.{c}").alias(c) for c in rest))


def interleave(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages with ``items`` in place of their html: the ordered structs of `sequence`, empty for null or empty html."""
    at = pages.columns.index(html_col)
    other = [f for i, f in enumerate(pages.schema) if i != at]

    def run(batches):
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("entry", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sequence(h.as_py()) for h in batch.column(at)], kind)], [*(f.name for f in other), "items"])

    return pages.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in other), f"items {ITEMS}"]))


def references(pages: DataFrame) -> DataFrame:
    """One row per media reference of interleaved pages, with its position and caption."""
    other = [c for c in pages.columns if c != "items"]
    return pages.select(*other, F.explode("items").alias("i")).where("i.kind = 'media'").select(*other, *(F.col(f"i.{c}").alias(c) for c in ("position", "digest", "entry", "caption")))


def place(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page id and html of every page, with a figure for each entry of the store (entry, digest, caption) put at the end of
    one of its paragraphs (see `illustrated`).

    Entries and pages fall into buckets by hashes, some BUCKET pages each, and an entry goes to one page of its bucket; only
    ids meet there. The pages then join their figures by id. Pages without an id, and buckets without pages, get none;
    rows that repeat a page's id get the same.
    """
    ids = pages.select(F.col(id_col).alias("__page")).where(F.col("__page").isNotNull()).distinct()
    buckets = max(1, -(-ids.count() // BUCKET))
    of = lambda c, salt: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(buckets))
    homes = ids.groupBy(of(F.col("__page"), 1).alias("__bucket")).agg(F.sort_array(F.collect_list("__page")).alias("__pages"))
    figure = F.concat(F.lit(f"<figure><img src='{SCHEME}"), "digest", F.lit("#"), F.col("entry").cast("string"), F.lit("'><figcaption>"), F.replace(F.replace(F.coalesce("caption", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</figcaption></figure>"))
    dealt = entries.withColumn("__bucket", of(F.col("entry"), 2)).join(homes, "__bucket").select("entry", figure.alias("f"), F.get("__pages", F.pmod(F.xxhash64(F.lit(3), "entry"), F.size("__pages")).cast("int")).alias("__page"))
    figures = dealt.groupBy("__page").agg(F.transform(F.sort_array(F.collect_list(F.struct("entry", "f"))), lambda x: x["f"]).alias("__figures"))
    joined = pages.select(F.col(id_col), F.col(html_col).cast("string").alias(html_col)).join(figures, F.col(id_col) == F.col("__page"), "left").select(id_col, html_col, "__figures")

    def run(batches):
        for batch in batches:
            filled = [illustrated(h, f) if f else h for h, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(filled, pa.string())], [id_col, html_col])

    return joined.mapInArrow(run, f"{id_col} {joined.schema[0].dataType.simpleString()}, {html_col} string")


def illustrated(html: str | None, figures: list[str]) -> str:
    """The page with a figure at the end of each of its paragraphs, in order. Those left over stand in front, where no
    open element can hide them."""
    html = html or ""
    ends = [at for kind, at, name, _ in events(html) if kind == "close" and name == "p"][: len(figures)]
    parts = [html[a:b] for a, b in zip([0, *ends], [*ends, len(html)], strict=True)]
    rest = figures[len(ends) :]
    return "".join(rest) + parts[0] + "".join(f + p for f, p in zip(figures, parts[1:], strict=False))


def payloads(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """The references with ``media``, the stored bytes of their digest, null where the store has none.

    Of entries with one digest, which hold the same bytes, the partial aggregates leave one a task and the last one,
    so that bytes are moved once for each of them and once for each reference.
    """
    once = stored.groupBy("digest").agg(F.max("media").alias("media"))
    return refs.join(once, "digest", "left")


def resolve(refs: DataFrame, described: DataFrame) -> DataFrame:
    """Joins references to what the store holds for their digests; unresolved ones keep nulls.

    Both sides meet as bare exchanges, so the adaptive plan splits the references of a digest that
    very many pages use.
    """
    return refs.join(materialize(described), "digest", "left")
