"""Statements as their writers mean them, in Spark's words.

Spark parses most of the dialect as it is. What it lacks or means otherwise is
rewritten here, token by token: functions under other names, the operators ~ and
SIMILAR TO, DISTINCT ON, QUALIFY, nulls that sort last, and the division of whole
numbers, whose operands' types are asked of the analyzer without running anything.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from tidemark.errors import EngineError
from tidemark.plans.asof import Token, tokens

OPEN, CLOSE = "([", ")]"
VERSION = "tidemark 0.2"


def _depths(toks: list[Token]) -> list[int]:
    out, depth = [], 0
    for t in toks:
        depth -= t.text in CLOSE
        out.append(depth)
        depth += t.text in OPEN
    return out


def _close(toks: list[Token], i: int) -> int:
    """The token that closes what token i opens."""
    depth = 0
    for k in range(i, len(toks)):
        depth += (toks[k].text in OPEN) - (toks[k].text in CLOSE)
        if not depth:
            return k
    raise EngineError("a bracket isn't closed")


def _text(sql: str, toks: list[Token], i: int, j: int) -> str:
    return sql[toks[i].start : toks[j - 1].end] if j > i else ""


def _split(toks: list[Token], i: int, j: int) -> list[tuple[int, int]]:
    out, depth, at = [], 0, i
    for k in range(i, j):
        depth += (toks[k].text in OPEN) - (toks[k].text in CLOSE)
        if not depth and toks[k].text == ",":
            out.append((at, k))
            at = k + 1
    return [*out, (at, j)] if j > i else []


# --- functions --------------------------------------------------------------------------------------

_MICROS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}
_ARROW = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "utf8": "string", "largeutf8": "string", "boolean": "boolean", "date32": "date", "binary": "binary"}


def _interval(text: str) -> int:
    m = re.fullmatch(r"(?is)(?:interval\s+)?'\s*(\d+)\s*([a-z]+?)s?\s*'|(?:interval\s+)'?\s*(\d+)\s*'?\s*([a-z]+?)s?", text.strip())
    unit = (m[2] or m[4]).lower() if m else ""
    if unit not in _MICROS:
        raise EngineError(f"an interval of fixed length is wanted, not {text}")
    return int(m[1] or m[3]) * _MICROS[unit]


def _date_bin(width: str, ts: str, origin: str = "TIMESTAMP_NTZ '1970-01-01 00:00:00'") -> str:
    w, o = _interval(width), f"unix_micros(CAST({origin} AS TIMESTAMP))"
    return f"CAST(timestamp_micros({o} + (unix_micros(CAST({ts} AS TIMESTAMP)) - {o}) - pmod(unix_micros(CAST({ts} AS TIMESTAMP)) - {o}, {w})) AS TIMESTAMP_NTZ)"


def _gcd(a: str, b: str) -> str:
    return f"aggregate(sequence(1, 93), named_struct('x', abs(CAST({a} AS BIGINT)), 'y', abs(CAST({b} AS BIGINT))), (s, i) -> if(s.y = 0, s, named_struct('x', s.y, 'y', try_mod(s.x, s.y))), s -> s.x)"


def _digest(x: str, kind: str) -> str:
    k = kind.strip().strip("'").lower()
    if k == "md5":
        return f"md5({x})"
    if k not in ("sha224", "sha256", "sha384", "sha512"):
        raise EngineError(f"no digest {k}")
    return f"sha2({x}, {k[3:]})"


def _arrow_cast(x: str, kind: str) -> str:
    k = kind.strip().strip("'").lower()
    if k not in _ARROW:
        raise EngineError(f"no type {k}")
    return f"CAST({x} AS {_ARROW[k]})"


def _as(name: str) -> Callable[..., str]:
    return lambda *a: f"{name}({', '.join(a)})"


FUNCTIONS: dict[str, Callable[..., str]] = {
    "make_array": _as("array"),
    "array_has": _as("array_contains"),
    "array_has_all": lambda a, b: f"(size(array_except({b}, {a})) = 0)",
    "array_has_any": _as("arrays_overlap"),
    "array_length": lambda a, dim="1": f"size({a})",
    "array_element": _as("try_element_at"),
    "array_prepend": lambda x, a: f"array_prepend({a}, {x})",
    "array_slice": lambda a, i, j: f"slice({a}, {i}, greatest(({j}) - ({i}) + 1, 0))",
    "array_to_string": _as("array_join"),
    "array_concat": _as("concat"),
    "array_cat": _as("concat"),
    "array_pop_back": lambda a: f"slice({a}, 1, greatest(size({a}) - 1, 0))",
    "array_pop_front": lambda a: f"slice({a}, 2, greatest(size({a}) - 1, 0))",
    "array_positions": lambda a, v: f"filter(transform({a}, (x, i) -> if(x <=> ({v}), i + 1, NULL)), i -> i IS NOT NULL)",
    "array_replace": lambda a, o, n: f"transform({a}, (x, i) -> if(i + 1 = array_position({a}, {o}), {n}, x))",
    "array_replace_all": lambda a, o, n: f"transform({a}, x -> if(x <=> ({o}), {n}, x))",
    "array_resize": lambda a, n, v="NULL": f"slice(concat({a}, array_repeat({v}, {n})), 1, {n})",
    "array_reverse": _as("reverse"),
    "array_sum": lambda a: f"aggregate({a}, 0D, (s, x) -> s + coalesce(x, 0))",
    "array_distance": lambda a, b: f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "string_to_array": lambda s, d: rf"split({s}, concat('\\Q', {d}, '\\E'))",
    "unnest": _as("explode"),
    "generate_series": lambda *a: f"explode(sequence({', '.join(a)}))",
    "generate_subscripts": lambda a, dim="1": f"explode(sequence(1, size({a})))",
    "date_bin": _date_bin,
    "to_hex": lambda x: f"lower(hex({x}))",
    "strpos": _as("instr"),
    "starts_with": _as("startswith"),
    "ends_with": _as("endswith"),
    "substr_index": _as("substring_index"),
    "iszero": lambda x: f"(({x}) = 0)",
    "trunc": lambda x, n="0": f"(signum({x}) * floor(abs({x}) * power(10, {n})) / power(10, {n}))",
    "gcd": _gcd,
    "lcm": lambda a, b: f"if(({a}) = 0 OR ({b}) = 0, 0L, abs((CAST({a} AS BIGINT) DIV {_gcd(a, b)}) * ({b})))",
    "approx_distinct": _as("approx_count_distinct"),
    "approx_median": lambda x: f"approx_percentile({x}, 0.5)",
    "approx_percentile_cont": _as("approx_percentile"),
    "var": _as("var_samp"),
    "arrow_typeof": _as("typeof"),
    "arrow_cast": _arrow_cast,
    "digest": _digest,
    **{f"sha{n}": (lambda n: lambda x: f"sha2({x}, {n})")(n) for n in (224, 256, 384, 512)},
    "regexp_match": lambda s, p: f"regexp_extract_all({s}, {p}, 0)",
    "to_unixtime": lambda x: f"unix_seconds(CAST({x} AS TIMESTAMP))",
    "to_timestamp_seconds": _as("timestamp_seconds"),
    "to_timestamp_millis": _as("timestamp_millis"),
    "to_timestamp_micros": _as("timestamp_micros"),
    "get_field": lambda x, f: f"({x}).`{f.strip()[1:-1]}`",
    "map_extract": _as("try_element_at"),
    "version": lambda: f"'{VERSION}'",
    "current_schema": lambda: "'public'",
    "current_database": lambda: "'tidemark'",
    "current_catalog": lambda: "'tidemark'",
    "pg_get_indexdef": lambda *a: "CAST(NULL AS STRING)",
    "pg_type_is_visible": lambda *a: "true",
}


def functions(sql: str) -> str:
    """Calls under other names; the innermost first, as they stand furthest to the right."""
    toks = tokens(sql)
    for i in range(len(toks) - 2, -1, -1):
        if toks[i].word in FUNCTIONS and toks[i + 1].text == "(" and not (i and toks[i - 1].text == "."):
            end = _close(toks, i + 1)
            args = [_text(sql, toks, a, b) for a, b in _split(toks, i + 2, end)]
            try:
                new = FUNCTIONS[toks[i].word](*args)
            except TypeError:
                raise EngineError(f"{toks[i].word} doesn't take {len(args)} arguments") from None
            sql = sql[: toks[i].start] + new + sql[toks[end].end :]
            toks = tokens(sql)
    return sql


# --- operators --------------------------------------------------------------------------------------

#: Words that stand before an operand, not after one.
_BEFORE_OPERAND = {"select", "where", "and", "or", "not", "on", "having", "by", "when", "then", "else", "case", "distinct", "all", "between", "in", "like", "rlike", "is", "as", "from"}


def _after_operand(toks: list[Token], i: int) -> bool:
    if not i:
        return False
    t = toks[i - 1]
    return t.text in CLOSE or t.kind in ("string", "quoted", "number", "param") or bool(t.word) and t.word not in _BEFORE_OPERAND


def similar(pattern: str) -> str:
    """A SIMILAR TO pattern as a regular expression: % and _ are wild, | * + ? ( ) and brackets as there; the whole must match."""
    out, escaped = [], False
    for ch in pattern:
        if escaped:
            out.append(re.escape(ch))
            escaped = False
        elif ch == "\\":
            escaped = True
        else:
            out.append({"%": "(?s:.*)", "_": "(?s:.)", ".": "\\.", "$": "\\$"}.get(ch, ch))
    return "^(?:" + "".join(out) + ")$"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "''") + "'"


def operators(sql: str) -> str:
    """~, ~*, !~, !~* and SIMILAR TO as RLIKE. Patterns are literals."""
    toks = tokens(sql)
    for i in range(len(toks) - 1, -1, -1):
        t = toks[i]
        regex = t.text in ("~", "~*", "!~", "!~*") and _after_operand(toks, i)
        like = t.word == "similar" and i + 1 < len(toks) and toks[i + 1].word == "to"
        if not regex and not like:
            continue
        at = i + 1 if regex else i + 2
        if at >= len(toks) or toks[at].kind != "string":
            raise EngineError("a pattern must be a literal")
        raw = toks[at].text[1:-1].replace("''", "'")
        pattern = similar(raw) if like else ("(?i)" if "*" in t.text else "") + raw
        word = "NOT RLIKE " if t.text.startswith("!") else "RLIKE "
        sql = sql[: t.start] + word + _quoted(pattern) + sql[toks[at].end :]
    return sql


#: Which end of the other values decides a comparison with all, or with any, of them.
_EDGE = {(">", "all"): "max", (">=", "all"): "max", ("<", "all"): "min", ("<=", "all"): "min", (">", "any"): "min", (">=", "any"): "min", ("<", "any"): "max", ("<=", "any"): "max"}


def quantified(sql: str) -> str:
    """Comparisons with ANY or ALL of a subquery, as IN or comparisons with its least or greatest value.

    With nulls among the values they are unknown rather than false, which a filter treats alike.
    """
    toks = tokens(sql)
    for i in range(len(toks) - 3, 0, -1):
        how = {"some": "any"}.get(toks[i].word, toks[i].word)
        if how not in ("any", "all") or toks[i + 1].text != "(" or toks[i + 2].word not in ("select", "with", "values") or toks[i - 1].text not in ("=", "<>", "!=", "<", "<=", ">", ">="):
            continue
        op, close = toks[i - 1].text.replace("!=", "<>"), _close(toks, i + 1)
        depths, at = _depths(toks), i - 2
        while at > 0 and depths[at - 1] >= depths[i] and not (depths[at - 1] == depths[i] and (toks[at - 1].word in _BEFORE_OPERAND or toks[at - 1].text == ",")):
            at -= 1
        x, q = _text(sql, toks, at, i - 1), f"({_text(sql, toks, i + 2, close)}) AS `__q`(`v`)"
        if (op, how) in (("=", "any"), ("<>", "all")):
            new = f"{x} {'IN' if how == 'any' else 'NOT IN'} (SELECT `v` FROM {q})"
        elif how == "any" and op == "<>":
            new = f"({x} <> (SELECT min(`v`) FROM {q}) OR {x} <> (SELECT max(`v`) FROM {q}))"
        elif how == "any":
            new = f"{x} {op} (SELECT {_EDGE[op, how]}(`v`) FROM {q})"
        else:
            ends = ["min", "max"] if op == "=" else [_EDGE[op, how]]
            each = " AND ".join(f"{x} {op} (SELECT if(count(`v`) = count(*), {e}(`v`), NULL) FROM {q})" for e in ends)
            new = f"((SELECT count(*) FROM {q}) = 0 OR {each})"
        sql = sql[: toks[at].start] + new + sql[toks[close].end :]
        toks = tokens(sql)
    return sql


# --- order ------------------------------------------------------------------------------------------

_ORDER_ENDS = {"limit", "offset", "rows", "range", "groups", "union", "intersect", "except", "minus", "fetch", "window", "qualify"}


def null_order(sql: str) -> str:
    """Nulls are greater than all else, unless it is said where they go."""
    toks = tokens(sql)
    depths = _depths(toks)
    for i in range(len(toks) - 2, -1, -1):
        if toks[i].word != "order" or toks[i + 1].word != "by":
            continue
        end = i + 2
        while end < len(toks) and depths[end] >= depths[i] and not (depths[end] == depths[i] and (toks[end].word in _ORDER_ENDS or toks[end].text == ";")):
            end += 1
        for a, b in reversed(_split(toks, i + 2, end)):
            words = [t.word for t, d in zip(toks[a:b], depths[a:b]) if d == depths[i]]
            if b > a and "nulls" not in words and words != ["all"]:
                sql = sql[: toks[b - 1].end] + (" NULLS FIRST" if "desc" in words else " NULLS LAST") + sql[toks[b - 1].end :]
    return sql


# --- DISTINCT ON, QUALIFY ---------------------------------------------------------------------------

_CLAUSES = ("from", "where", "group", "having", "qualify", "order", "limit", "offset")
_SETS = {"union", "intersect", "except", "minus"}


def _select_at(toks: list[Token], depths: list[int], i: int) -> tuple[dict[str, int], int]:
    """Where the clauses of the SELECT at token i begin, and where it ends."""
    at, k = {}, i + 1
    while k < len(toks) and depths[k] >= depths[i]:
        if depths[k] == depths[i]:
            if toks[k].word in _SETS or toks[k].text == ";":
                break
            if toks[k].word in _CLAUSES and toks[k].word not in at and not (toks[k].word == "from" and toks[k - 1].word == "distinct"):
                at[toks[k].word] = k
        k += 1
    return at, k


def _tail(sql: str, toks: list[Token], at: dict[str, int], end: int, first: str) -> str:
    """The text from the clause ``first`` on."""
    found = [at[c] for c in _CLAUSES[_CLAUSES.index(first) :] if c in at]
    return _text(sql, toks, min(found), end) if found else ""


def distinct_on(sql: str) -> str:
    """The first row of each key, by a row number in the query's own order."""
    toks = tokens(sql)
    depths = _depths(toks)
    for i in range(len(toks) - 3, -1, -1):
        if not (toks[i].word == "select" and toks[i + 1].word == "distinct" and toks[i + 2].word == "on" and toks[i + 3].text == "("):
            continue
        close = _close(toks, i + 3)
        keys = _text(sql, toks, i + 4, close)
        at, end = _select_at(toks, depths, i)
        body = min([at[c] for c in ("from", "where", "group", "having") if c in at] or [at.get("order", at.get("limit", end))])
        columns = _text(sql, toks, close + 1, body)
        order = at.get("order")
        after = min([at[c] for c in ("limit", "offset") if c in at] or [end])
        stop = order if order is not None else after
        items = _split(toks, order + 2, after) if order is not None else []
        plain, ways = [], []
        for a, b in items:
            cut = next((k for k in range(a, b) if toks[k].word in ("asc", "desc", "nulls") and depths[k] == depths[i]), b)
            plain.append(_text(sql, toks, a, cut))
            ways.append(_text(sql, toks, cut, b))
        hidden = "".join(f", {p} AS `__o{k}`" for k, p in enumerate(plain))
        by = ", ".join(f"{p} {w}" for p, w in zip(plain, ways)) or keys
        inner = f"SELECT {columns}{hidden}, row_number() OVER (PARTITION BY {keys} ORDER BY {by}) AS `__nth` {_text(sql, toks, body, stop)}"
        dropped = ", ".join(["`__nth`", *(f"`__o{k}`" for k in range(len(plain)))])
        outer = f"SELECT * EXCEPT ({dropped}) FROM (SELECT * FROM ({inner}) WHERE `__nth` = 1" + (" ORDER BY " + ", ".join(f"`__o{k}` {w}" for k, w in enumerate(ways)) if ways else "") + f" {_text(sql, toks, after, end)})"
        sql = sql[: toks[i].start] + outer + sql[toks[end - 1].end :]
        toks = tokens(sql)
        depths = _depths(toks)
    return sql


def qualify(sql: str) -> str:
    """A filter over window functions, as a column of the query that is filtered on and left out."""
    toks = tokens(sql)
    depths = _depths(toks)
    for i in range(len(toks) - 1, -1, -1):
        if toks[i].word != "select":
            continue
        at, end = _select_at(toks, depths, i)
        if "qualify" not in at:
            continue
        q = at["qualify"]
        stop = min([at[c] for c in ("order", "limit", "offset") if c in at] or [end])
        start = at["from"]
        inner = f"{_text(sql, toks, i, start)}, ({_text(sql, toks, q + 1, stop)}) AS `__kept` {_text(sql, toks, start, q)}"
        outer = f"SELECT * EXCEPT (`__kept`) FROM ({inner}) WHERE `__kept` {_text(sql, toks, stop, end)}"
        sql = sql[: toks[i].start] + outer + sql[toks[end - 1].end :]
        toks = tokens(sql)
        depths = _depths(toks)
    return sql


# --- whole numbers ----------------------------------------------------------------------------------

_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _primary_end(toks: list[Token], i: int) -> int:
    """After the operand that begins at token i."""
    if toks[i].text in "+-":
        return _primary_end(toks, i + 1)
    if toks[i].text in OPEN:
        k = _close(toks, i) + 1
    elif toks[i].word == "case":
        depth, k = 0, i
        while True:
            depth += (toks[k].word == "case") - (toks[k].word == "end")
            k += 1
            if not depth:
                break
    else:
        k = i + 1
    while k < len(toks) and (toks[k].text in (*OPEN, ".", "::") or toks[k].word in ("over", "filter")):
        if toks[k].text in OPEN:
            k = _close(toks, k) + 1
        elif toks[k].word:
            k += 1
        else:
            k += 2
    return k


def _term_start(toks: list[Token], depths: list[int], i: int) -> int:
    """Where the product or quotient begins that the operator at token i goes on with."""
    begin, k = None, i - 1
    # operands are parsed forwards: try each beginning at this depth, the furthest that reaches the operator counts
    while k >= 0 and depths[k] >= depths[i] and not (depths[k] == depths[i] and (toks[k].text in (",", ";", "=", "<", ">", "<=", ">=", "<>", "!=", "||", "+", "-") and _after_operand(toks, k) or toks[k].word in _BEFORE_OPERAND - {"case", "when", "then", "else"})):
        if depths[k] == depths[i]:
            at = k
            while at < i:
                at = _primary_end(toks, at)
                if at < i and toks[at].text in "*/%":
                    at += 1
                elif at < i:
                    break
            if at == i:
                begin = k
        k -= 1
    return i - 1 if begin is None else begin


def whole_division(sql: str, kinds: Callable[[str, list[str]], list[str] | None]) -> str:
    """``a / b`` of whole numbers as DIV. ``kinds``: the types of expressions over a FROM clause, None where they can't be told."""
    done = 0
    while True:
        toks = tokens(sql)
        slashes = [i for i, t in enumerate(toks) if t.text == "/" and t.start >= done]
        if not slashes:
            return sql
        i = slashes[0]
        depths = _depths(toks)
        start, end = _term_start(toks, depths, i), _primary_end(toks, i + 1)
        left, right = _text(sql, toks, start, i), _text(sql, toks, i + 1, end)
        source, depth = "", depths[i]
        for k in range(i, -1, -1):
            if depths[k] < depth:
                depth = depths[k]
            if toks[k].word == "select" and depths[k] <= depth:
                at, stop = _select_at(toks, depths, k)
                if "from" in at:
                    source = _text(sql, toks, at["from"], min([at[c] for c in _CLAUSES[1:] if c in at and at[c] > at["from"]] or [stop]))
                break
        got = kinds(source, [left, right])
        if got and set(got) <= _WHOLE:
            sql = sql[: toks[start].start] + f"({left} DIV {right})" + sql[toks[end - 1].end :]
            done = toks[start].start
        else:
            done = toks[i].end


# --- numbers of all rows ----------------------------------------------------------------------------


@dataclass
class Numbering:
    """A query with row numbers over all of its rows, taken apart.

    ``inner`` has the query's columns, null for the numbers, then the keys of each
    number's order, then those of the query's own. ``numbers``: a column's place,
    and its keys' places and directions; ``order``: places and directions.
    """

    inner: str
    numbers: list[tuple[int, list[tuple[int, str]]]]
    order: list[tuple[int, str]]
    limit: int | None
    offset: int


def _number_end(toks: list[Token], a: int, b: int) -> int | None:
    """The bracket that ends ``row_number() OVER (ORDER BY …)`` in the item from a to b, if it is one but for an alias."""
    if b - a < 8 or toks[a].word != "row_number" or [t.text.lower() for t in toks[a + 1 : a + 7]] != ["(", ")", "over", "(", "order", "by"]:
        return None
    end = _close(toks, a + 4)
    left = toks[end + 1 : b]
    alias = not left or len(left) == 1 or len(left) == 2 and left[0].word == "as"
    return end if alias and not any(t.word in ("rows", "range", "groups") for t in toks[a + 5 : end]) else None


def numbering(sql: str, names: Callable[[], list[str]]) -> Numbering | None:
    """The parts of a SELECT that numbers all its rows, or None: then it runs as it is. ``names``: its columns."""
    toks = tokens(sql)
    while toks and toks[-1].text == ";":
        toks.pop()
    if not toks or toks[0].word != "select" or not any(t.word == "row_number" for t in toks):
        return None
    depths = _depths(toks)
    at, end = _select_at(toks, depths, 0)
    top = {t.word for t, d in zip(toks, depths) if not d}
    if end != len(toks) or "from" not in at or toks[1].word in ("distinct", "all") or top & {"group", "having", "qualify", "window", "fetch", "cluster", "distribute", "sort"}:
        return None
    items = _split(toks, 1, at["from"])
    ends = [_number_end(toks, a, b) for a, b in items]
    # the places of columns are those of the items: a star has several
    if all(e is None for e in ends) or len(columns := names()) != len(items):
        return None
    after = min([at[c] for c in ("limit", "offset") if c in at] or [end])
    bounds = {"limit": None, "offset": 0}
    for k in range(after, end, 2):
        if toks[k].word not in bounds or k + 1 >= end or not toks[k + 1].text.isdigit():
            return None
        bounds[toks[k].word] = int(toks[k + 1].text)
    shown, hidden, numbers, order = [], [], [], []

    def keys(i: int, j: int) -> list[tuple[str, str, list[Token]]]:
        out = []
        for a, b in _split(toks, i, j):
            cut = next((k for k in range(a, b) if toks[k].word in ("asc", "desc", "nulls") and depths[k] == depths[i]), b)
            out.append((_text(sql, toks, a, cut), _text(sql, toks, cut, b).lower(), toks[a:cut]))
        return out

    def hide(text: str) -> int:
        hidden.append(text)
        return len(items) + len(hidden) - 1

    for n, ((a, b), e) in enumerate(zip(items, ends)):
        shown.append(_text(sql, toks, a, b) if e is None else "CAST(NULL AS INT)")
        if e is not None:
            numbers.append((n, [(hide(text), way) for text, way, _ in keys(a + 7, e)]))
    if "order" in at:
        low = [c.lower() for c in columns]
        own = {c for c, (a, b) in zip(low, items) if b - a > 1}
        for text, way, part in keys(at["order"] + 2, after):
            one = part[0] if len(part) == 1 else None
            if one is not None and one.kind in ("word", "quoted") and low.count(one.name.lower()) == 1:
                order.append((low.index(one.name.lower()), way))
            elif one is not None and one.kind == "number" and one.text.isdigit() and 0 < int(one.text) <= len(items):
                order.append((int(one.text) - 1, way))
            elif any(t.kind in ("word", "quoted") and t.name.lower() in own for t in part) or one is not None and one.word == "all":
                return None
            else:
                order.append((hide(text), way))
    body = _text(sql, toks, at["from"], at.get("order", after))
    inner = f"SELECT {', '.join([*shown, *hidden])} {body}"
    return Numbering(inner, numbers, order, bounds["limit"], bounds["offset"])


def rewritten(sql: str, kinds: Callable[[str, list[str]], list[str] | None]) -> str:
    words = {t.word for t in tokens(sql)}
    sql = quantified(operators(functions(sql)))
    if "order" in words:
        sql = null_order(sql)
    if "distinct" in words and "on" in words:
        sql = distinct_on(sql)
    if "qualify" in words:
        sql = qualify(sql)
    return whole_division(sql, kinds) if "/" in sql else sql
