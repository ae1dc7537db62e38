"""Functions and forms that Spark lacks or means otherwise, as expressions of built-in ones.

All are columns within generated code, but for gcd and lcm, which are a bounded
fold (64-bit numbers need at most 93 steps of Euclid's rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.dialect import similar

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gcd(a: Col, b: Col) -> Column:
    start = F.struct(F.abs(_c(a).cast("bigint")).alias("x"), F.abs(_c(b).cast("bigint")).alias("y"))
    steps = F.sequence(F.lit(1), F.lit(93))
    return F.aggregate(steps, start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y"))), lambda s: s["x"])


def lcm(a: Col, b: Col) -> Column:
    x, y = _c(a).cast("bigint"), _c(b).cast("bigint")
    return F.when((x == 0) | (y == 0), F.lit(0).cast("bigint")).otherwise(F.abs(int_div(x, gcd(x, y)) * y))


def iszero(x: Col) -> Column:
    return _c(x) == 0


def trunc(x: Col, n: int = 0) -> Column:
    """Towards zero, at n decimals."""
    return F.signum(_c(x)) * F.floor(F.abs(_c(x)) * 10**n) / 10**n


def int_div(a: Col, b: Col) -> Column:
    """Integer division, towards zero."""
    return F.call_function("div", _c(a), _c(b))


def string_to_array(s: Col, delimiter: str) -> Column:
    return F.split(_c(s), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def to_hex(x: Col) -> Column:
    return F.lower(F.hex(_c(x)))


def strpos(s: Col, part: Col) -> Column:
    return F.instr(_c(s), _c(part))


def similar_to(s: Col, pattern: str) -> Column:
    """SQL's SIMILAR TO: % and _ are wild, | * + ? ( ) and brackets as in regular expressions; the whole string must match."""
    return F.regexp_like(_c(s), F.lit(similar(pattern)))


def regex_match(s: Col, pattern: str, fold: bool = False) -> Column:
    """The operators ~ and ~*."""
    return F.regexp_like(_c(s), F.lit(("(?i)" if fold else "") + pattern))


def regexp_replace_first(s: Col, pattern: str, by: str) -> Column:
    """Without the flag for all matches: the first one only."""
    at = F.regexp_instr(_c(s), F.lit(pattern))
    found = F.regexp_extract(_c(s), pattern, 0)
    return F.when(at == 0, _c(s)).otherwise(F.concat(F.substring(_c(s), F.lit(1), at - 1), F.regexp_replace(found, F.lit(pattern), F.lit(by)), F.substring(_c(s), at + F.char_length(found), F.char_length(_c(s)))))


def date_bin(seconds: int, ts: Col, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the interval of that many seconds that holds ts."""
    micros = F.unix_micros(_c(ts).cast("timestamp"))
    start = F.unix_micros(F.lit(origin).cast("timestamp"))
    width = seconds * 1_000_000
    return F.timestamp_micros((F.floor((micros - start) / width) * width + start).cast("bigint")).cast("timestamp_ntz")


def array_has_all(a: Col, b: Col) -> Column:
    return F.size(F.array_except(_c(b), _c(a))) == 0


def array_has_any(a: Col, b: Col) -> Column:
    return F.arrays_overlap(_c(a), _c(b))


def array_slice(a: Col, first: int, last: int) -> Column:
    """Elements from first to last, from 1, both included."""
    return F.slice(_c(a), first, max(0, last - first + 1))


def array_pop_back(a: Col) -> Column:
    return F.slice(_c(a), F.lit(1), F.greatest(F.size(_c(a)) - 1, F.lit(0)))


def array_pop_front(a: Col) -> Column:
    return F.slice(_c(a), F.lit(2), F.greatest(F.size(_c(a)) - 1, F.lit(0)))


def array_positions(a: Col, value: Col) -> Column:
    return F.filter(F.transform(_c(a), lambda x, i: F.when(x.eqNullSafe(_c(value)), i + 1)), lambda i: i.isNotNull())


def array_replace_all(a: Col, old: Col, new: Col) -> Column:
    return F.transform(_c(a), lambda x: F.when(x.eqNullSafe(_c(old)), _c(new)).otherwise(x))


def array_replace(a: Col, old: Col, new: Col) -> Column:
    """The first occurrence only."""
    at = F.try_element_at(array_positions(a, old), F.lit(1))
    return F.transform(_c(a), lambda x, i: F.when(at.eqNullSafe(i + 1), _c(new)).otherwise(x))


def array_resize(a: Col, size: int, fill: Col) -> Column:
    return F.slice(F.concat(_c(a), F.array_repeat(_c(fill), size)), 1, size)


def array_sum(a: Col) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def array_distance(a: Col, b: Col) -> Column:
    """Euclidean; of doubles, in the order of the elements."""
    squares = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def digest(x: Col, kind: str) -> Column:
    return F.md5(_c(x)) if kind == "md5" else F.sha2(_c(x), {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}[kind])


def generate_subscripts(a: Col) -> Column:
    return F.sequence(F.lit(1), F.size(_c(a)))


def distinct_on(df: DataFrame, keys: list[Col], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def groups_frame(df: DataFrame, value: Column, partition: list[Col], order: Column, before: int, after: int, name: str) -> DataFrame:
    """An aggregate over a GROUPS frame: peers by dense rank, then a range over the rank."""
    ranked = df.withColumn("_peers", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    w = Window.partitionBy(*partition).orderBy("_peers").rangeBetween(-before, after)
    return ranked.withColumn(name, value.over(w)).drop("_peers")
