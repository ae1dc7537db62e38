"""SQL text before Spark sees it: tokens, table names, and AS OF.

``FROM t AS OF <snapshot id>``, ``FROM t AS OF TIMESTAMP '…'`` (UTC unless it
has a zone) and ``FROM "t@<id>"`` become reads of a snapshot. Unquoted names
fold to lower case; quoted ones are taken as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from tidemark.errors import EngineError, NotSupported

TOKEN = re.compile(r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`)|(?P<param>\$\d+)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_$]*)|(?P<sign>::|<=|>=|<>|!=|\|\||~\*|!~\*|!~|.)", re.S)
#: Words after which a table stands, and those that can't be its alias.
BEFORE_TABLE = {"from", "join", "into", "update", "table"}
NO_ALIAS = {"where", "group", "order", "having", "limit", "offset", "join", "inner", "left", "right", "full", "cross", "natural", "on", "using", "union", "intersect", "except", "set", "values", "select", "lateral", "window", "as", "semi", "anti", "tablesample", "qualify"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def word(self) -> str:
        return self.text.lower() if self.kind == "word" else ""

    @property
    def name(self) -> str:
        """As an identifier."""
        if self.kind == "quoted":
            q = self.text[0]
            return self.text[1:-1].replace(q * 2, q)
        return self.text.lower()


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup or "", m[0], m.start(), m.end()) for m in TOKEN.finditer(sql) if m.lastgroup != "space"]


@dataclass
class TableUse:
    """A table named in a statement, the span of its name and AS OF, and which state of it is meant."""

    parts: list[str]
    start: int
    end: int
    snapshot_id: int | None = None
    as_of_ms: int | None = None
    quoted: bool = False


def timestamp_ms(text: str) -> int:
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        raise EngineError(f"bad timestamp {text!r}") from None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def table_uses(sql: str) -> list[TableUse]:
    """All names that stand where a table does; names of common table expressions and functions too."""
    toks, found = tokens(sql), []
    depth_from: list[bool] = [False]
    expect = False
    i = 0
    while i < len(toks):
        t = toks[i]
        if t.text == "(":
            depth_from.append(False)
            expect = False
        elif t.text == ")":
            if len(depth_from) > 1:
                depth_from.pop()
            expect = False
        elif t.word in BEFORE_TABLE:
            depth_from[-1] = t.word in ("from", "join")
            # extract(year FROM x), trim(… FROM x), substring(… FROM n), IS DISTINCT FROM
            expect = not (t.word == "from" and (_in_function(toks, i) or i and toks[i - 1].word == "distinct"))
        elif t.word in ("where", "group", "order", "having", "select", "set", "limit", "union", "intersect", "except", "on", "using", "values"):
            depth_from[-1], expect = False, False
        elif t.text == "," and depth_from[-1]:
            expect = True
        elif expect and t.kind in ("word", "quoted") and t.word not in ("lateral", "only", "if", "exists", "not", "values", "select"):
            parts, j = [t.name], i + 1
            while j + 1 < len(toks) and toks[j].text == "." and toks[j + 1].kind in ("word", "quoted"):
                parts.append(toks[j + 1].name)
                j += 2
            use = TableUse(parts, t.start, toks[j - 1].end, quoted=t.kind == "quoted")
            if j < len(toks) and toks[j].text == "(" and t.kind == "word" and depth_from[-1]:
                expect = False
                i = j
                continue
            j = _as_of(toks, j, use)
            found.append(use)
            expect = False
            i = j
            continue
        elif expect and t.word not in ("lateral", "only", "if", "exists", "not"):
            expect = False
        i += 1
    return found


def _in_function(toks: list[Token], i: int) -> bool:
    """Whether FROM belongs to extract, trim, substring, overlay or position."""
    depth = 0
    for k in range(i - 1, -1, -1):
        if toks[k].text == ")":
            depth += 1
        elif toks[k].text == "(":
            if not depth:
                return k > 0 and toks[k - 1].word in ("extract", "trim", "substring", "overlay", "position")
            depth -= 1
        elif not depth and toks[k].word == "select":
            return False
    return False


def _as_of(toks: list[Token], j: int, use: TableUse) -> int:
    last = use.parts[-1]
    if "@" in last and use.quoted:
        base, _, number = last.rpartition("@")
        if not number.isdigit() or "$" in base:
            raise EngineError(f"bad snapshot name {last!r}")
        use.parts[-1], use.snapshot_id = base, int(number)
    if j + 2 < len(toks) and toks[j].word == "as" and toks[j + 1].word == "of":
        if len(use.parts) > 2:
            raise NotSupported("AS OF takes a name of one or two parts")
        if toks[j + 2].kind == "number" and toks[j + 2].text.isdigit():
            use.snapshot_id, use.end = int(toks[j + 2].text), toks[j + 2].end
            return j + 3
        if toks[j + 2].word == "timestamp" and j + 3 < len(toks) and toks[j + 3].kind == "string":
            use.as_of_ms, use.end = timestamp_ms(toks[j + 3].text[1:-1]), toks[j + 3].end
            return j + 4
        raise EngineError("AS OF takes a snapshot id or TIMESTAMP '…'")
    return j


def splice(sql: str, uses: list[TableUse], names: list[str]) -> str:
    """The text with each use replaced by a name of the engine's own."""
    out, at = [], 0
    for use, name in zip(uses, names):
        out += [sql[at : use.start], name]
        at = use.end
    return "".join([*out, sql[at:]])
