"""Media columns: interleaved sequences of text and media references.

A page's HTML becomes an ordered array of structs: text runs, and references to
media with their digest and caption, at consecutive positions. Payloads lie in
a table of their own (digest, media); references are joined to what is computed
from it by digest, so that a payload is never moved along with the documents
that show it, and a payload of many references is a skewed join of small rows.

Payloads are kept as 8-bit grey images (binary PGM) of 64 samples a line. A task
keeps each payload once, whatever its copies; what several tasks keep is
described alike, and joined once. Long pages and payloads take time in
proportion: a tag, comment or script that is never closed is looked for once.
Null html and null text count as empty: no parts, and a payload of 64 zeros.
References of a digest that the store lacks keep their place, with null values.
Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import shipped, stored, table, texts_of

LINE = 64
#: Digests by which a task knows its copies again; beyond them some payloads are kept twice.
KEPT = 1_000_000
SCHEME = "sha256:"
PART = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
PART_DDL = "array<struct<pos: int, kind: string, text: string, digest: string, caption: string>>"

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<![^>]*+>", re.S)
_CLOSED = {n: re.compile(rf"</{n}\s*+>", re.I) for n in ("script", "style")}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Elements that are media, and those that end a text run.
MEDIA = {"img", "video", "audio", "source", "embed"}
INLINE = {"a", "b", "i", "em", "strong", "span", "u", "small", "sub", "sup", "code"}


def tags(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """Where each tag begins and ends, and its match; None for comments, declarations, scripts and styles."""
    at, gone = 0, set()
    while (begin := page.find("<", at)) >= 0:
        at = begin + 1
        if page.startswith("<!--", begin):
            end = -1 if "<!--" in gone else page.find("-->", begin + 4)
            if end < 0:
                # no comment is closed from here on
                gone.add("<!--")
                continue
            at = end + 3
            yield begin, at, None
            continue
        m = _TAG.match(page, begin)
        if not m:
            continue
        name = (m[2] or "").lower()
        at = m.end()
        if name in _CLOSED and not m[1] and name not in gone:
            if closed := _CLOSED[name].search(page, at):
                at = closed.end()
                yield begin, at, None
                continue
            gone.add(name)
        yield begin, at, m if name else None


def parse(page: str) -> list[dict]:
    """The parts of a page in order. A figure's caption, before or after them, or else the alternative text, belongs to its media."""
    parts: list[dict] = []
    run: list[str] = []
    caption: list[str] | None = None
    figure: int | None = None
    waiting: str | None = None

    def add(**part) -> None:
        parts.append({"pos": len(parts), "kind": "text", "text": None, "digest": None, "caption": None} | part)

    def end_run() -> None:
        if text := " ".join("".join(run).split()):
            add(text=text)
        run.clear()

    def give(text: str) -> bool:
        own = [p for p in parts[figure or 0 :] if p["kind"] == "media"] if figure is not None else []
        for p in own:
            p["caption"] = text
        return bool(own)

    at = 0
    for begin, end, m in tags(page):
        (run if caption is None else caption).append(html.unescape(page[at:begin]))
        at = end
        name = m[2].lower() if m else ""
        if not name or name in INLINE:
            continue
        if name == "figcaption":
            if not m[1]:
                end_run()
                caption = []
            elif caption is not None:
                text = " ".join("".join(caption).split())
                if not give(text) and text:
                    if figure is None:
                        add(text=text)
                    else:
                        waiting = text
                caption = None
            continue
        if caption is None:
            end_run()
        if name == "figure":
            if waiting and not give(waiting):
                add(text=waiting)
            waiting, figure = None, None if m[1] else len(parts)
        elif name in MEDIA and not m[1]:
            attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3])}
            if source := attributes.get("src"):
                digest = source.removeprefix(SCHEME) if source.startswith(SCHEME) else hashlib.sha256(source.encode()).hexdigest()
                add(kind="media", digest=digest, caption=attributes.get("alt") or None)
    (run if caption is None else caption).append(html.unescape(page[at:]))
    run += caption or []
    if waiting and not give(waiting):
        run.append(f" {waiting}")
    end_run()
    return parts


def sequences(pages: DataFrame, key: str, page: str = "html") -> DataFrame:
    """(key, parts): the parts of each page in order."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = pa.array([parse(p) for p in texts_of(b, page)], pa.list_(PART))
            yield pa.RecordBatch.from_arrays([b.column(key), parts], names=[key, "parts"])

    return pages.select(key, page).transform(shipped).mapInArrow(run, f"`{key}` {kind}, parts {PART_DDL}")


def references(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, digest, caption): a row for each media part."""
    media = F.filter("parts", lambda p: p["kind"] == "media")
    return parts.select(*keys, F.explode(media).alias("p")).select(*keys, "p.pos", "p.digest", "p.caption")


def resolve(parts: DataFrame, key: str, described: DataFrame, *more: str) -> DataFrame:
    """The references with the columns of ``described`` (one row a digest) and ``more`` columns of the parts beside them."""
    return references(parts, key, *more).join(described, "digest", "left")


def to_image(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (LINE, len(payload) // LINE) + payload


def from_image(media: bytes) -> np.ndarray:
    """The samples of a binary PGM, by line."""
    magic, width, height, most, at = *media[:64].split(maxsplit=4)[:4], 0
    if magic != b"P5" or most != b"255":
        raise ValueError("not an 8-bit grey image")
    for _ in range(3):
        at = media.index(b"\n", at) + 1
    return np.frombuffer(media, np.uint8, int(width) * int(height), at).reshape(int(height), int(width))


def pad(raw: bytes) -> bytes:
    """``raw`` and as many zeros as make its length a positive multiple of LINE."""
    return raw + bytes(-len(raw) % LINE or (LINE if not raw else 0))


STORE = "digest string, n_bytes bigint, media binary"


def store_of(docs: DataFrame) -> DataFrame:
    """(digest, n_bytes, media) of the texts: the digest is that of the unpadded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: set[bytes] = set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                new = {}
                for t in texts_of(b.slice(at, 500)):
                    raw = t.encode()
                    if (digest := hashlib.sha256(raw).digest()) not in kept:
                        new[digest] = raw
                if len(kept) < KEPT:
                    kept.update(new)
                raw = list(new.values())
                yield pa.RecordBatch.from_arrays([pa.array([d.hex() for d in new], pa.string()), pa.array(map(len, raw), pa.int64()), pa.array([to_image(pad(r)) for r in raw], pa.binary())], names=["digest", "n_bytes", "media"])

    return docs.select(F.col("text").cast("string").alias("text")).transform(shipped).mapInArrow(run, STORE)


DESCRIBED = "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def describe(store: DataFrame) -> DataFrame:
    """One row a digest, from the media read back: sums of the payload and of the stored form, and a feature.

    The feature is the image's height, mean sample, and the shares of eight
    equal ranges of samples in parts of 10,000.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for m in b.column("media"):
                media = m.as_py()
                lines = from_image(media)
                payload = lines.tobytes()
                counts = np.bincount(lines.ravel(), minlength=256)
                mean = int(counts @ np.arange(256)) * 1000 // lines.size
                shares = (counts.reshape(8, 32).sum(axis=1) * 10_000 // lines.size).tolist()
                for column, value in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(media), hashlib.sha256(media).hexdigest(), f"{lines.shape[0]}x{LINE};{mean};" + ",".join(map(str, shares)))):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n_bytes"), *map(pa.array, rows, types)], names=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return store.transform(shipped).mapInArrow(run, DESCRIBED).dropDuplicates(["digest"])


def illustrated(docs: DataFrame) -> DataFrame:
    """(doc_id, html): each document as a page that shows its own payload after its text, with the first words as caption."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = []
            for t in texts_of(b):
                paragraphs = "".join(f"<p>{html.escape(p, quote=False)}</p>" for p in t.split("\n") if p)
                digest = hashlib.sha256(t.encode()).hexdigest()
                caption = html.escape(" ".join(t[:200].split()[:8]), quote=False)
                pages.append(f'<article>{paragraphs}<figure><img src="{SCHEME}{digest}"><figcaption>{caption}</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pages, pa.string())], names=["doc_id", "html"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(shipped).mapInArrow(run, "doc_id bigint, html string")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store is written in the shared folder, read back and described; documents reach it by their pages' references."""
    docs = table(spark, sf_dir, "documents")
    described = describe(stored(store_of(docs), "media"))
    parts = sequences(illustrated(docs), "doc_id")
    counted = parts.select("*", F.size(F.filter("parts", lambda p: p["kind"] == "text")).cast("bigint").alias("n_text_parts"))
    shown = resolve(counted, "doc_id", described, "n_text_parts")
    return shown.select("n_text_parts", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("pos").alias("media_pos"), F.col("caption").alias("media_caption"))
