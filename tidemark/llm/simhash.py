"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a word between them that
differs from either in at most r. So every distinct fingerprint emits all
variants within r bits of itself, and the variants are the shuffle key:
whatever collides on one is a candidate pair. A variant holds at most as many
distinct fingerprints as a ball has words (65 for r = 1 of 64 bits), so that no
group grows with the data; copies are folded into their fingerprint before.

Null and empty texts have no shingles: their fingerprint is zero, and it links
like any other. A text with fewer words than a shingle is one shingle. Repeated
rows share a fingerprint. A null doc_id takes part, but is never the least of
its component.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import cut, release, set_aside, shipped, table, texts_of
from tidemark.llm.components import components

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingle_hashes(text: str, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; A to Z count as a to z."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(begins[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)


def bit_majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): 64-bit fingerprints as signed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([bit_majority(shingle_hashes(t, width, seed)) for t in texts_of(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(shipped).mapInArrow(run, "doc_id bigint, fp bigint")


def ball(radius: int, bits: int = 64) -> list[int]:
    """Masks, as signed 64-bit numbers, of all ways to flip at most ``radius`` of the low ``bits``."""
    masks = [sum(1 << i for i in flips) for r in range(radius + 1) for flips in itertools.combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def colliding(fps: DataFrame, distance: int, bits: int = 64, block: Column | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all within ``distance`` bits.

    Members of a variant lie within twice the half radius of each other; each is
    linked with the one before it, which connects the whole ball by verified
    pairs without making all of them.
    """
    masks = F.array(*(F.lit(m) for m in ball((distance + 1) // 2, bits)))
    keys = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = keys.select("fp", before.alias("b")).where("b is not null")
    if distance % 2 == 0:
        return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance).select(F.col("fp").alias("a"), "b").distinct()
    raise ValueError("distance must be even: the half radius is exact then")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    rows = cut(fingerprints(docs, width))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = colliding(least.select("fp"), distance)
    roots = components(links).withColumnRenamed("node", "fp")
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# --- similarity of shingle sets, for the pipeline -------------------------------------------------
#
# At a similarity of 0.8 SimHash fingerprints differ in a seventh of their bits, too many for a ball. So a
# text has a longer SimHash fingerprint, cut into bands, and ball hashing finds the texts that differ in at
# most two bits of a band. Min-wise bands then go over what the balls have left apart.

#: Five-word shingles of which at least so many are shared, as a share of their union.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a ball's band beyond those that tell all texts apart, and the share of pairs at the least similarity that the balls meet.
SPARE_BITS, RECALL = 6, 0.98
#: Variants a text that are dealt at once: more bands take more rounds, and no more disk.
ROUND_KEYS = 128
#: Variants that a task packs at once, and that a bucket has; bytes of a packed variant, before compression; the odd factor that mixes keys.
PACKED_AT_ONCE, BUCKET, PACKED_BYTES, MIX = 1 << 19, 1 << 18, 25, 0x9E3779B97F4A7C15
#: Shingles whose SimHash bits are counted at once: as many as a byte counts.
COUNTED_AT_ONCE = 255
#: A band is one 64-bit word of eight min-wise symbols of a byte. Of pairs at 0.8, 1 - (1 - 0.8 ** 8) ** 32 = 0.997 share one.
BANDS, SYMBOLS = 32, 8
#: Standard errors that an estimate may lie below the similarity (beyond: 0.13 % of the pairs at the very threshold).
ERRORS = 3.0
#: The same for the few bits by which texts of a variant get their comparison (beyond: 3 to 9 in a million).
PLACE_ERRORS = 5.0
#: Texts of a variant up to which it tells by their first words, in pairs, who may be similar to whom; all of a larger one are compared.
PAIRED = 256
#: Shingles whose symbols are taken at once.
SHINGLES_AT_ONCE = 2048
#: Rows of a batch that a worker has as Python objects.
ROWS_AT_ONCE = 500
#: Members of a block in which the texts of a large band that are not linked yet are compared.
GROUP_BLOCK = 1024


def flip_rate(similarity: float) -> float:
    """Share of the SimHash bits in which sets of that Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan_balls(n_texts: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands, from the number of texts: as the bits grow with its logarithm, so do the bands."""
    bits = min(56, max(16, math.ceil(math.log2(max(2, n_texts))) + SPARE_BITS))
    p = flip_rate(similarity)
    hit = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` signed words of a shingle set: bit majorities of as many mixes of each hash."""
    factors = (np.arange(words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), COUNTED_AT_ONCE):
        x = hashes[at : at + COUNTED_AT_ONCE, None] * factors
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)


def most_flipped(similarity: float, bits: int, errors: float = ERRORS) -> int:
    """SimHash bits of so many in which a pair of that similarity differs, but for chance beyond so many standard errors."""
    p = flip_rate(similarity)
    return math.floor(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def _band(fingerprint: str, bits: int, k: int) -> Column:
    """The bits of band ``k`` of a long fingerprint."""
    i, off = divmod(bits * k, 64)
    word = F.shiftrightunsigned(F.col(fingerprint)[i], off)
    if off + bits > 64:
        word = word.bitwiseOR(F.shiftleft(F.col(fingerprint)[i + 1], 64 - off))
    return word.bitwiseAND(F.lit((1 << bits) - 1))


def ball_keys(texts: DataFrame, bits: int, bands: range) -> DataFrame:
    """(key, flip, node, fp): the variants of radius 1 of the bands, the band's number above the bits.

    flip is 0 for the band itself, else one more than the bit that is flipped;
    fp is the first word.
    """
    cuts = F.array(*(F.lit(k << bits) + _band("simhash", bits, k) for k in bands))
    each = texts.select("node", F.col("simhash")[0].alias("fp"), F.explode(cuts).alias("cut"))
    flips = each.select("cut", "node", "fp", F.posexplode(F.array(*(F.lit(m) for m in ball(1, bits)))).alias("flip", "mask"))
    return flips.select(F.col("cut").bitwiseXOR(F.col("mask")).alias("key"), F.col("flip").cast("tinyint").alias("flip"), "node", "fp")


def _pack(place: np.ndarray, node: np.ndarray, fp: np.ndarray, flip: np.ndarray) -> bytes:
    """Variants in the order of their places, byte by byte of each number: steps and ids have mostly zero and equal bytes, which the shuffle's compression takes out."""
    steps = np.diff(place, prepend=np.uint64(0))
    return b"".join(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in (steps, node, fp)) + flip.tobytes()


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(packed) // PACKED_BYTES
    raw = np.frombuffer(packed, np.uint8)
    steps, node, fp = (np.ascontiguousarray(raw[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view(np.uint64).ravel() for i in range(3))
    return np.cumsum(steps, dtype=np.uint64), node.view(np.int64), fp, raw[24 * n :].view(np.int8)


def _dealt(keys: DataFrame, size: int, spread: int) -> DataFrame:
    """(bucket, packed): ball keys below 2 ** size by places, their one-to-one mix; a bucket has those of equal ``spread`` top bits."""
    mask, shift = np.uint64((1 << size) - 1), np.uint64(size - spread)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            key, flip, node, fp = (c.to_numpy() for c in pa.Table.from_batches(held).select(["key", "flip", "node", "fp"]).columns)
            place = key.view(np.uint64) * np.uint64(MIX) & mask
            order = np.argsort(place)
            place, flip, node, fp = place[order], flip[order], node[order], fp[order]
            bucket = (place >> shift).view(np.int64)
            begins = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(begins[1:], len(bucket))
            packs = [_pack(place[s:e], node[s:e], fp[s:e], flip[s:e]) for s, e in zip(begins.tolist(), ends.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), pa.array(packs, pa.binary())], names=["bucket", "packed"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED_AT_ONCE:
                yield chunk(held)
                held, n = [], 0
        if n:
            yield chunk(held)

    return keys.transform(shipped).mapInArrow(pack, "bucket bigint, packed binary")


def _unlike(similarity: float, bits: int, k: int) -> tuple[np.uint64, int]:
    """The bits of the first word that are not of band ``k``, and how many of them may differ in a pair, but for chance beyond PLACE_ERRORS."""
    outside = ~(((1 << bits) - 1) << bits * k) & (1 << 64) - 1
    return np.uint64(outside), most_flipped(similarity, outside.bit_count(), PLACE_ERRORS)


def _meeting(bits: int, bands: int, similarity: float, packs: pa.Table) -> pa.Table:
    """The rows of ``met_in_balls`` of a bucket."""
    size = bits + bands.bit_length()
    place, node, fp, flip = (np.concatenate(x) for x in zip(*(_unpack(p) for p in packs["packed"].to_pylist())))
    order = np.argsort(place)
    new = np.diff(place[order], prepend=~place[order[:1]]) != 0
    alone = new & np.append(new[1:], True)
    some = order[~alone]
    some = some[np.lexsort((node[some], place[some]))]
    place, node, fp, flip = place[some], node[some], fp[some], flip[some].astype(np.int64) - 1
    key = (place * np.uint64(pow(MIX, -1, 1 << size)) & np.uint64((1 << size) - 1)).view(np.int64)
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(np.append(heads, len(key)))
    each = lambda x: np.repeat(x, n)
    led = np.ones(len(key), bool)
    led[heads] = False
    near = led & (np.bitwise_count(fp ^ each(fp[heads])) <= most_flipped(similarity, 64))
    # two texts have their place here (see _first_ball) if both are the band itself, or if the higher bit that one of them flips is not set
    low = (flip >= 0) & (key >> np.maximum(flip, 0) & 1 == 0)
    crowded = led.copy()
    if len(key):
        top = np.maximum.reduceat(np.where(led & low, flip, -2), heads)
        least = np.minimum.reduceat(np.where(led, flip, size), heads)
        plain = np.add.reduceat((led & (flip < 0)).astype(np.int64), heads)
        crowded &= (each(top) > flip) | (low & (each(least) < flip)) | ((flip < 0) & (each(plain) > 1))
        # in all but large variants, pairs tell it by the first word too
        outside, most = (np.array(x)[key >> bits] for x in zip(*(_unlike(similarity, bits, k) for k in range(bands))))
        rest = each(n) - 1 - (np.arange(len(key)) - each(heads))
        paired = each(n) > PAIRED
        a = np.flatnonzero(led & (rest > 0) & ~paired)
        for d in range(1, PAIRED):
            a = a[rest[a] >= d]
            if not len(a):
                break
            b = a + d
            lower, upper = np.minimum(flip[a], flip[b]), np.maximum(flip[a], flip[b])
            here = ((lower < upper) & (key[a] >> np.maximum(upper, 0) & 1 == 0)) | (upper < 0)
            here &= np.bitwise_count((fp[a] ^ fp[b]) & outside[a]) <= most[a]
            paired[a[here]] = paired[b[here]] = True
        crowded &= paired
    out = near | crowded
    return pa.table([pa.array(x[out]) for x in (key, node, each(node[heads]), near, crowded)], names=["key", "node", "leader", "near", "crowded"])


def met_in_balls(texts: DataFrame, bits: int, bands: int, similarity: float) -> DataFrame:
    """(key, node, leader, near, crowded) of the variants of several texts; the leader is the least of them.

    ``near`` says whether the text is not the leader and may, by the first word,
    reach the similarity with it; ``crowded``, whether it and another text that
    is not the leader may, by the first word, be similar and have their place in
    this variant. Only rows of either come out. A round deals ROUND_KEYS variants a text, packed, and its
    shuffle files go before the next. A task has a bucket of some BUCKET
    variants, but all of one variant.
    """
    per, found, n = max(1, ROUND_KEYS // (bits + 1)), [], texts.count()
    meet = functools.partial(_meeting, bits, bands, similarity)
    for at in range(0, bands, per):
        some = range(at, min(bands, at + per))
        spread = max(0, math.ceil(math.log2(max(1, n * len(some) * (bits + 1)) / BUCKET)))
        dealt = _dealt(ball_keys(texts, bits, some), bits + bands.bit_length(), spread)
        found.append(cut(dealt.groupBy("bucket").applyInArrow(lambda t: meet(t), "key bigint, node bigint, leader bigint, near boolean, crowded boolean")))
        del dealt
        release(texts.sparkSession)
    return functools.reduce(DataFrame.union, found)


def _first_ball(x: str, y: str, bits: int, bands: int) -> Column:
    """The first variant that two long fingerprints share, so that each pair is met in one place.

    Words of one or two differing bits share two variants: those in which all
    but one of these bits are the one's, the last of them or the first.
    """

    def shared(k: int) -> Column:
        u, v = _band(x, bits, k), _band(y, bits, k)
        apart = u.bitwiseXOR(v)
        low = apart.bitwiseAND(-apart)
        met = F.when(F.bit_count(apart) < 2, F.least(u, v)).otherwise(F.least(u.bitwiseXOR(low), v.bitwiseXOR(low)))
        return F.when(F.bit_count(apart) <= 2, F.lit(k << bits) + met)

    return F.coalesce(*(shared(k) for k in range(bands)))


def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` words to be added and odd factors, by a multiplicative rule from the seed."""
    x = (np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x = (x >> np.uint64(29)).astype(np.uint32)
    return x[:n], x[n:] | np.uint32(1)


_ADDED, _FACTORS = _mixers(BANDS * SYMBOLS)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """BANDS signed words of a shingle set: a byte of the least mixed hash for each symbol."""
    low = np.full(BANDS * SYMBOLS, 0xFFFFFFFF, np.uint32)
    top = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(top), SHINGLES_AT_ONCE):
        x = top[at : at + SHINGLES_AT_ONCE, None] ^ _ADDED
        x *= _FACTORS
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(low, x.min(axis=0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).view(np.int64)


def most_differing(similarity: float) -> int:
    """Bits in which sketches of a pair of that similarity differ, but for chance beyond ERRORS standard errors.

    A symbol differs for one less the similarity; bytes that do are unrelated,
    and differ in 4 bits with a variance of 2.
    """
    n, q = BANDS * SYMBOLS, 1 - similarity
    return math.floor(n * q * 4 + ERRORS * math.sqrt(n * (q * 18 - (q * 4) ** 2)))


def _differing(x: str, y: str, words: int = BANDS) -> Column:
    """Bits in which two sketches differ."""
    bits = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(words)]
    return sum(bits[1:], bits[0])


def _first_shared(x: str, y: str) -> Column:
    """The first band that two sketches share, so that each pair is met in one place."""
    return F.coalesce(*(F.when(F.col(x)[i] == F.col(y)[i], F.lit(i)) for i in range(BANDS)))


def _sketches(docs: DataFrame, width: int, words: int) -> DataFrame:
    """(doc_id, digest, simhash, sketch) of the rows whose text has words: the long fingerprint and the min-wise one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                keep, longs, found = [], [], []
                for i, t in enumerate(texts_of(b)):
                    h = np.unique(shingle_hashes(t, width))
                    if len(h):
                        keep.append(i)
                        longs.append(long_fingerprint(h, words))
                        found.append(sketch(h))
                columns = [b.column(n).take(pa.array(keep, pa.int64())) for n in ("doc_id", "digest")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.list_(pa.int64())) for x in (longs, found))], names=["doc_id", "digest", "simhash", "sketch"])

    return docs.select("doc_id", "digest", "text").transform(shipped).mapInArrow(run, "doc_id bigint, digest binary, simhash array<bigint>, sketch array<bigint>")


def banded(texts: DataFrame) -> DataFrame:
    """(band, key, node): the keys on which texts meet."""
    each = texts.select("node", F.posexplode("sketch").alias("band", "word"))
    return each.select("band", F.xxhash64("band", "word").alias("key"), "node")


def led(keys: DataFrame) -> DataFrame:
    """(band, key, node, leader, n) of the keys of several texts; the leader is the least of them.

    Counts and leaders are partial aggregates, and joined back: no key's texts
    are gathered in a task, however many they are.
    """
    leaders = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    return keys.join(leaders, "key")


def _similar(x: str, y: str, similarity: float) -> Column:
    """Whether two arrays of distinct shingles reach the similarity."""
    shared = F.size(F.array_intersect(x, y))
    return shared >= F.lit(similarity) * (F.size(x) + F.size(y) - shared)


def _shingles(docs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes: of each text the row of its least doc_id is read again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                h = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts_of(b)]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(h, pa.list_(pa.int64()))], names=["node", "shingles"])

    named = cut(texts.join(nodes.distinct(), "node").select("node", "digest", F.col("head").alias("doc_id")))
    read = suspected(docs.select("doc_id", "digest", "text"), ["doc_id", "digest"], named).join(named, ["doc_id", "digest"]).dropDuplicates(["node"])
    return cut(read.select("node", "text").transform(shipped).mapInArrow(sets, "node bigint, shingles array<bigint>"))


def estimated(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sketches let them reach the similarity."""
    wide = lambda at, x: texts.select(F.col("node").alias(at), F.col("sketch").alias(x))
    return cut(pairs.join(wide("b", "y"), "b").join(wide("a", "x"), "a").where(_differing("x", "y") <= most_differing(similarity)).select("a", "b"))


def verified(docs: DataFrame, texts: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets reach the similarity."""
    sets = _shingles(docs, texts, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), width)
    side = lambda at, x: sets.select(F.col("node").alias(at), F.col("shingles").alias(x))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_similar("x", "y", similarity)).select("a", "b")


def across(docs: DataFrame, crowded: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float, width: int, likely: Column | None = None, place: Column | None = None) -> DataFrame:
    """The pairs (a, b) of nodes that share a key, have different roots, were not compared with their leader, and reach the similarity.

    In a key most texts have the root of its leader by now. Only the others meet
    all, dealt into blocks of GROUP_BLOCK by GROUP_BLOCK texts, so that no task
    has a whole key; a key of one root makes no pair. A pair is compared on its
    first shared band alone, or on the key ``place`` of the sketches x and y,
    and only if they are ``likely`` to be similar. Semi joins by sketch tell which texts have anybody
    to be compared with; those get their shingles, and the last join compares
    within its condition: what comes out of any of them is texts or links, and
    no pair that fails.
    """
    likely = _differing("x", "y") <= most_differing(similarity) if likely is None else likely
    at, shared = ("band", _first_shared("x", "y")) if place is None else ("key", place)
    of = lambda at, name: roots.select(F.col("node").alias(at), F.col("root").alias(name))
    each = crowded.join(of("node", "own"), "node", "left").join(of("leader", "main"), "leader", "left")
    each = cut(each.withColumns({"own": F.coalesce("own", "node"), "main": F.coalesce("main", "leader")}).withColumn("other", F.col("own") != F.col("main")).drop("n", "main"))
    sizes = each.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("other").cast("int")).alias("m")).where("m > 0")
    if sizes.isEmpty():
        return crowded.sparkSession.createDataFrame([], "a bigint, b bigint")
    blocks = lambda c: F.ceil(F.col(c) / GROUP_BLOCK).cast("int")
    sized = sizes.select("key", blocks("m").alias("ms"), blocks("n").alias("ns"))
    dealt = cut(each.join(sized, "key").join(texts.select("node", "sketch"), "node"))
    place = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    left = dealt.where("other").select("key", F.col(at).alias("at"), "leader", place("ms").alias("lo"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("hi"), F.col("node").alias("a"), F.col("own").alias("ra"), F.col("sketch").alias("x"))
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("lo"), place("ns").alias("hi"), F.col("node").alias("b"), F.col("own").alias("rb"), F.col("other").alias("too"), F.col("sketch").alias("y"))

    def near(p: DataFrame, q: DataFrame) -> Column:
        place = (p["key"] == q["key"]) & (p["lo"] == q["lo"]) & (p["hi"] == q["hi"])
        once = (F.col("ra") != F.col("rb")) & (~F.col("too") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("leader")) & (F.col("b") != F.col("leader"))
        return place & once & likely & (shared == F.col("at"))

    some_left = cut(left.join(right, near(left, right), "left_semi"))
    some_right = cut(right.join(some_left, near(right, some_left), "left_semi"))
    sets = _shingles(docs, texts, some_left.select(F.col("a").alias("node")).union(some_right.select("b")), width)
    side = lambda at, x: sets.select(F.col("node").alias(at), F.col("shingles").alias(x))
    # the blocks are even already: dealt by hand, so that the planner doesn't divide them again, each part with each
    p, q = (x.repartition("key", "lo", "hi") for x in (some_left.join(side("a", "sx"), "a"), some_right.join(side("b", "sy"), "b")))
    return p.join(q, F.when(near(p, q), _similar("sx", "sy", similarity)).otherwise(False) & (p["key"] == q["key"]) & (p["lo"] == q["lo"]) & (p["hi"] == q["hi"])).select("a", "b")


#: Bits of the filter that spares rows a join; its size does not grow with the data.
FILTER_BITS = 1 << 24


def _places(columns: list[str]) -> list[Column]:
    return [F.pmod(F.xxhash64(*columns, F.lit(i)), F.lit(FILTER_BITS)) for i in (1, 2)]


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each hash of a key (two of them); at most FILTER_BITS / 64 rows reach the driver."""
    rows = keys.select(F.explode(F.array(*_places(keys.columns))).alias("at")).groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _may_hold(df: DataFrame, key: list[str], keys: DataFrame) -> DataFrame:
    """``df`` with a column _may: false only where the columns ``key`` are not among ``keys``."""
    sent = df.sparkSession.sparkContext.broadcast(_filter_of(keys.select(key)))

    @F.pandas_udf("boolean")
    def may(a, b):
        words = sent.value
        hit = [(words[x >> 6] >> (x & 63)) & 1 for x in (a.to_numpy(), b.to_numpy())]
        import pandas as pd

        return pd.Series((hit[0] & hit[1]).astype(bool))

    return df.withColumn("_may", may(*_places(key)))


def suspected(df: DataFrame, key: list[str], keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among ``keys``: all that are, and few others."""
    return _may_hold(df, key, keys).where("_may").drop("_may")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the least doc_id.

    Groups are the connected components of texts whose sets of ``width``-word
    shingles reach the similarity; equal texts (by 128 bits) are always of one
    group. Texts without words (null too) are of no group, and all stay, as do
    rows of null doc_id. Of repeated rows of one doc_id and text one stays; of
    different texts of the least doc_id, that of the least digest. Long texts
    are hashed in parts. An empty table gives an empty one; columns of names
    used here are set aside and come back under their own.

    Candidates come from ball hashing: every text meets the leader of each of
    its variants, and whoever reaches the similarity is linked. Then all pairs
    of a variant that are not linked by that are compared, so that the links
    connect what all pairs would connect. The same follows on min-wise bands,
    for what has different roots by then.
    """
    docs, back = set_aside(docs, {"digest", "node", "head", "first", "_may"})
    clean = docs.where("doc_id is not null")
    keyed = clean.withColumn("digest", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    bits, bands = plan_balls(docs.count(), similarity)
    words = -(-bits * bands // 64)
    prints = cut(_sketches(keyed.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text").cast("string")}), width, words))
    unique = prints.groupBy("digest").agg(F.min("doc_id").alias("head"), F.first("simhash").alias("simhash"), F.first("sketch").alias("sketch"))
    texts = cut(unique.withColumn("node", F.monotonically_increasing_id()))
    met = met_in_balls(texts, bits, bands, similarity)
    first = met.where("near").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(verified(keyed, texts, estimated(texts, first, similarity), similarity, width))
    roots = components(links)
    long = texts.drop("sketch").withColumnRenamed("simhash", "sketch")
    likely = _differing("x", "y", words) <= most_flipped(similarity, 64 * words)
    more = cut(across(keyed, met.where("crowded").select("key", "node", "leader"), roots, long, similarity, width, likely, _first_ball("x", "y", bits, bands)).distinct())
    if not more.isEmpty():
        links = links.union(more)
        roots = components(links)
    del met, first, more
    release(docs.sparkSession)
    met = cut(led(banded(texts)))
    of = lambda at, name: roots.select(F.col("node").alias(at), F.col("root").alias(name))
    first = met.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    apart = first.join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    more = cut(verified(keyed, texts, estimated(texts, apart, similarity), similarity, width))
    release(docs.sparkSession)
    if not more.isEmpty():
        links = links.union(more)
        roots = components(links)
    # the planner may have divided a large key among thousands of tasks: few links come together again
    more = cut(across(keyed, met.where("n > 2"), roots, texts, similarity, width).distinct())
    if not more.isEmpty():
        roots = components(links.union(more))
    del met, first, apart
    release(docs.sparkSession)
    grouped = texts.select("digest", "head", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = grouped.groupBy("root").agg(F.min(F.struct("head", "digest")).alias("x")).select(F.col("x.head").alias("doc_id"), "x.digest", F.lit(True).alias("first"))
    rows = prints.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    doubtful = cut(rows.join(heads, ["doc_id", "digest"], "left").where("first is null or n > 1").select("doc_id", "digest", F.coalesce("first", F.lit(False)).alias("first")))
    marked = _may_hold(keyed, ["doc_id", "digest"], doubtful)
    tried = marked.where("_may").join(doubtful, ["doc_id", "digest"], "left")
    tried = tried.where("first is null").union(tried.where("first").dropDuplicates(["doc_id", "digest"]))
    return marked.where("not _may").select(docs.columns).union(tried.select(docs.columns)).union(docs.where("doc_id is null")).withColumnsRenamed(back)
