import hashlib
import time
import zlib

from tidemark.llm import media

TEXTS = [None, "", "x", "a" * 63, "b" * 64, "c" * 65, "é < & > 日本\n\nsecond <p> 'line'\x00\x1f", "<figure><img src=x></figure>", "x", "line " * 4000]


def test_digest_columns_match_brute_force(spark, make, folder):
    rows = {r.doc_id: r for r in media.op6_media(spark, folder(documents=make(*TEXTS))).collect()}
    assert sorted(rows) == list(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[2].feature == rows[8].feature and rows[2].feature != rows[3].feature


def test_parts_stay_in_order_with_their_captions():
    page = """<html><style>p{}</style><p>One <b>bold</b> &amp; two<img src="sha256:aa" alt="alt a"> three</p><!-- <img src=no> -->
    <figure><img src='sha256:bb'><figcaption>Cap <i>b</i></figcaption></figure><p>end<script>"<p>"</script></p><img alt="none"><p>"""
    got = [(p["pos"], p["kind"], p["text"] or p["digest"], p["caption"]) for p in media.parse(page)]
    assert got == [(0, "text", "One bold & two", None), (1, "media", "aa", "alt a"), (2, "text", "three", None), (3, "media", "bb", "Cap b"), (4, "text", "end", None)]
    assert media.parse("") == [] and media.parse("< 3 <") != []


def test_references_of_a_missing_digest_stay(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:zz"><p>t</p>'), (2, None)], "page_id bigint, html string")
    parts = media.sequences(pages, "page_id")
    described = media.describe(media.store_of(spark.createDataFrame([("q",)], "text string")))
    rows = media.resolve(parts, "page_id", described).collect()
    assert [(r.page_id, r.pos, r.digest, r.n_bytes) for r in rows] == [(1, 0, "zz", None)]


def test_real_pages_and_empty_table(spark, make, folder):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = media.sequences(pages, "page_id").collect()
    assert len(rows) == pages.count() and all([p.pos for p in r.parts] == list(range(len(r.parts))) for r in rows)
    assert media.op6_media(spark, folder(documents=make("x").limit(0))).count() == 0


def test_captions_before_their_media_and_unclosed_pages():
    got = lambda page: [(p["kind"], p["text"] or p["digest"], p["caption"]) for p in media.parse(page)]
    assert got('<figure><figcaption>first</figcaption><img src="sha256:aa"></figure> after') == [("media", "aa", "first"), ("text", "after", None)]
    assert got("<figure><figcaption>alone</figcaption></figure>x") == [("text", "alone", None), ("text", "x", None)]
    assert got("<figcaption>loose</figcaption><img src='sha256:bb' alt=q>") == [("text", "loose", None), ("media", "bb", "q")]
    assert got("<figure><img src='sha256:c'><img src='sha256:d'><figcaption>both</figcaption></figure>") == [("media", "c", "both"), ("media", "d", "both")]
    assert got("a <script>b <p>c") == [("text", "a", None), ("text", "b", None), ("text", "c", None)]
    for bad in ("<!-- ", "<script>", "<style x", '<a "', "<a '", "<", "<figure><figcaption>"):
        began = time.monotonic()
        media.parse(bad * 40_000)
        assert time.monotonic() - began < 5, bad
