"""Personal data: candidate spans, gradient-boosted trees, calibrated redaction.

All of it is DataFrame and SQL functions. Per kind strict patterns with checks
give the base spans. Loose generators propose further, overlapping spans of each
kind they could be, secrets (keys, tokens, passwords) among them. Boosted trees
over format and context features tell how likely a proposal is personal data.

Labels don't come from the rule that decides. A proposal that meets a base span
of its kind is good, and is counted a second time as it would look in a looser
writing, which no base pattern takes: a phone number without plus and country,
a card number in groups with points, an address with "[at]" and "[dot]". A
secret is good where a cue stands before it ("token =") or where it has a
published form; neither is a feature, and it counts a second time as if it stood
alone. All else is not good. The counts by feature values have at most
MOST_CELLS rows, whatever the data.

Thresholds are calibrated for each kind on documents that the scoring trees have
not seen (four folds, each scored by trees of the other three): from the best
score down, while the share of good ones stays at LEAST_SHARE, with PRIOR (good,
bad) counted beforehand. That share is a lower bound of the precision, as looser
writings in the texts themselves have no label and count as bad. Proposals from
there on are taken, best first, if they meet no base span and no better proposal.

Positions are code points, ends exclusive. Null texts count as empty and have no
spans. Repeated rows give repeated rows. Of equal scores the first span, then
the first kind is taken.

Patterns are written so that no text makes them slow or deep: repeated groups
are possessive where nothing can follow from giving back, and a match starts
where its run does, or where the last match ended. Lists of a text's spans are
run through in parts of PART, so that thousands of matches take time in
proportion.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import cut, set_aside, table

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
#: What only the method adds comes after them.
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match of the kind.
SIGN = {"email": "@", "ip": ".", "phone": "+"}
#: Loose generators, and the kinds that they propose.
LOOSE = {
    "address": (r"(?:\G|(?<![^\s@<>()\x22',;]))[^\s@<>()\x22',;]++@[^\s@<>()\x22',;]++", ("email",)),
    "number": (r"[+(]?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+", ("ip", "card", "phone")),
    "spelled": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:[\[(](?:at|@)[\])]|at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?:dot|\.)[\])]|dot\x20|\.)\x20?[A-Za-z0-9-]++)++", ("email",)),
    "token": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{14,}+={0,2}", (SECRET,)),
}
#: What stands before a secret, and the published form of one; these label, and are no features.
CUE = r"(?i)(?:token|passw(?:or)?d|secret|api[_ -]?key|bearer)[\x22\x27]?\s*[:=]?\s*[\x22\x27]?$"
PUBLISHED = r"^AKIA[0-9A-Z]{16}$"
OCTETS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)){3}$"
CONTEXT = 24
SPAN = "array<struct<s: int, e: int, m: string, b: string>>"

#: Features and their largest value; each begins at 0. Secrets have those of the second line, the others those of the first.
FORMAT = {"digits": 21, "before": 2, "signs": 4, "dots": 4, "plus": 1, "paren": 1, "context": 3}
TOKEN = {"digits": 21, "before": 2, "length": 9, "runs": 9, "upper": 1, "hex": 1}
FEATURES = {"kind": len(ALL_KINDS) - 1} | FORMAT | TOKEN
FOLDS = 4
MOST_CELLS = FOLDS * (len(KINDS) * math.prod(v + 1 for v in FORMAT.values()) + math.prod(v + 1 for v in TOKEN.values()))
ROUNDS, RATE, LEAST_SHARE, PRIOR = 20, 0.3, 0.6, (1, 10)
#: Spans of a text that are folded at a time.
PART = 256


# Expressions are made as SQL text, with functions for what repeats: a session parses a text at once, where
# it would be told of each part of a column on its own.

_names = itertools.count()


def _name() -> str:
    """A name for a variable of a lambda that no other one has."""
    return f"v{next(_names)}"


def _raw(pattern: str) -> str:
    """A pattern as a literal of SQL."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is worked out once, however often the body names it."""
    v = _name()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def _scan(array: str, state: str, out: str, step: Callable[[str, str], tuple[str, str]]) -> str:
    """A struct (state, out) after ``step(state, x)``, a pair of the next state and a list of outputs, over the array.

    A list that grows is copied with each addition, so the array is taken in
    parts: outputs are added to a part's list, and that to the whole.
    """
    acc, x, whole, part, i = (_name() for _ in range(5))
    st, o = step(f"{acc}.state", x)
    of_part = f"aggregate({part}, struct({whole}.state AS state, {out} AS out), ({acc}, {x}) -> struct({st} AS state, concat({acc}.out, {o}) AS out))"
    joined = _let(of_part, lambda g: f"struct({g}.state AS state, concat({whole}.out, {g}.out) AS out)")
    start = f"struct({state} AS state, {out} AS out)"

    def parts(a: str) -> str:
        cut = f"transform(sequence(0, CAST(floor((size({a}) - 1) / {PART}) AS INT)), {i} -> slice({a}, {i} * {PART} + 1, {PART}))"
        return f"IF(size({a}) > 0, aggregate({cut}, {start}, ({whole}, {part}) -> {joined}), {start})"

    return _let(array, parts)


def _found(text: str, pattern: str, sign: str | None = None) -> str:
    """Matches from left to right: start, end, the match, and what stands before it since the last one."""
    none = f"CAST(array() AS {SPAN})"

    def step(at: str, x: str) -> tuple[str, str]:
        start, end = f"{at} + char_length({x}.g)", f"{at} + char_length({x}.g) + char_length({x}.m)"
        return end, f"array(struct({start} AS s, {end} AS e, {x}.m AS m, right({x}.g, {CONTEXT}) AS b))"

    def spans(matches: str) -> str:
        whole = f"filter(zip_with(split({text}, {_raw(pattern)}, -1), {matches}, (g, m) -> struct(g AS g, m AS m)), x -> x.m IS NOT NULL)"
        return f"IF(size({matches}) > 0, {_scan(whole, '0', none, step)}.out, {none})"

    found = _let(f"regexp_extract_all({text}, {_raw(pattern)}, 0)", spans)
    return f"IF(contains({text}, '{sign}'), {found}, {none})" if sign else found


CHECKS = {
    "email": "true",
    "ip": f"regexp_like(x.m, {_raw(OCTETS)})",
    "card": "char_length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(x.m, '[^0-9]', ''))",
    "phone": "char_length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 9 AND 15",
}


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base spans by kind (_email, _ip, _card, _phone: start, end) and proposals (_loose: start, end, kind, label, features, those of a looser writing)."""
    t = f"coalesce(CAST(`{text}` AS STRING), '')"
    base = {f"_{k}": F.expr(f"transform(filter({_found(t, p, SIGN.get(k))}, x -> {CHECKS[k]}), x -> struct(x.s AS s, x.e AS e))") for k, p in BASE.items()}
    loose = {f"_{k}": F.expr(_found(t, p, SIGN["email"] if k == "address" else None)) for k, (p, _) in LOOSE.items()}
    proposals = [_proposed(f"_{k}", kind) for k, (_, kinds) in LOOSE.items() for kind in kinds]
    return docs.withColumns(base | loose).withColumn("_loose", F.expr(f"concat({', '.join(proposals)})")).drop(*loose)


def _proposed(spans: str, kind: str) -> str:
    """Proposals of one kind."""
    label = f"(regexp_like(x.b, {_raw(CUE)}) OR regexp_like(x.m, {_raw(PUBLISHED)}))" if kind == SECRET else "false"
    looser = _features(kind, LOOSER[kind], "''" if kind == SECRET else "x.b")
    return f"transform({spans}, x -> struct(x.s AS s, x.e AS e, {ALL_KINDS.index(kind)} AS kind, {label} AS y, struct({_features(kind, 'x.m', 'x.b')}) AS f, struct({looser}) AS looser))"


#: A match as it would look in a looser writing.
LOOSER = {
    "email": "concat(substring_index(x.m, '@', 1), '[at]', replace(substring_index(x.m, '@', -1), '.', '[dot]'))",
    "ip": "x.m",
    "card": r"regexp_replace(regexp_replace(x.m, '[^0-9]', ''), '([0-9]{4})(?=.)', r'$1.')",
    "phone": r"regexp_replace(x.m, r'^\+[0-9]{1,3}[\s.-]*', '')",
    SECRET: "x.m",
}


def _features(kind: str, m: str, b: str) -> str:
    """The features of a match ``m`` and what stands before it, as fields of a struct."""
    last = f"right({b}, 1)"
    values = {
        "kind": str(ALL_KINDS.index(kind)),
        "digits": f"char_length(regexp_replace({m}, '[^0-9]', ''))",
        "before": rf"CASE WHEN {last} = '' THEN 0 WHEN regexp_like({last}, r'\s') THEN 0 WHEN regexp_like({last}, r'[\p{{L}}\p{{N}}]') THEN 1 ELSE 2 END",
    }
    if kind == SECRET:
        values |= {
            "length": f"floor(char_length({m}) / 5)",
            "runs": f"char_length(regexp_replace({m}, '[A-Za-z]++|[0-9]++', 'x'))",
            "upper": f"CAST(regexp_like({m}, '[A-Z]') AS INT)",
            "hex": f"CAST(regexp_like({m}, '^[0-9a-f]++$') AS INT)",
        }
    else:
        near = f"lower({b})"
        values |= {
            "signs": f"char_length(regexp_replace({m}, '[A-Za-z0-9.+()]', ''))",
            "dots": f"char_length({m}) - char_length(replace({m}, '.', ''))",
            "plus": f"CAST(startswith({m}, '+') AS INT)",
            "paren": f"CAST(contains({m}, '(') AS INT)",
            "context": f"CASE WHEN regexp_like({near}, 'tel|phone|call|fax|mobile') THEN 1 WHEN regexp_like({near}, 'card|visa|account|iban') THEN 2 WHEN regexp_like({near}, 'mail|host|server|addr') THEN 3 ELSE 0 END",
        }
    return ", ".join(f"CAST(least({values[name]}, {most}) AS INT) AS {name}" if name in values else f"0 AS {name}" for name, most in FEATURES.items())


def _met(spans: str, of: str) -> str:
    """Places in ``spans`` of those that meet one of the spans ``of``: in order of the start, one run forward and one back."""
    none = "CAST(array() AS ARRAY<INT>)"

    def run(array: str, start: int, edge: str, meets: Callable[[str, str], str]) -> str:
        def step(st: str, x: str) -> tuple[str, str]:
            return f"IF({x}.i < 0, {edge.format(st=st, x=x)}, {st})", f"IF({x}.i >= 0 AND {meets(st, x)}, array({x}.i), {none})"

        return _scan(array, str(start), none, step) + ".out"

    def runs(b: str) -> str:
        # the furthest end of those that began before, the least start of those that begin after
        ahead = run(b, -1, "greatest({st}, {x}.e)", lambda st, x: f"{st} > {x}.s")
        behind = run(f"reverse({b})", 2**31 - 1, "least({st}, {x}.s)", lambda st, x: f"{st} < {x}.e")
        return f"array_union({ahead}, {behind})"

    both = f"array_sort(concat(transform({spans}, (x, i) -> struct(x.s AS s, x.e AS e, i AS i)), transform({of}, x -> struct(x.s AS s, x.e AS e, -1 AS i))))"
    return f"IF(size({spans}) > 0 AND size({of}) > 0, {_let(both, runs)}, {none})"


def _parted(spans: str, of: str, body: Callable[[str, str], str]) -> str:
    """``body`` of the spans that meet one of ``of``, and of the others."""

    def split(v: str) -> str:
        at = lambda places: f"transform({places}, i -> get({v}.spans, i))"
        every = f"IF(size({v}.spans) > 0, sequence(0, size({v}.spans) - 1), CAST(array() AS ARRAY<INT>))"
        return _let(_met(f"{v}.spans", f"{v}.of"), lambda met: body(at(met), at(f"array_except({every}, {met})")))

    return _let(f"struct({spans} AS spans, {of} AS of)", split)


@dataclass
class Tree:
    """One split, and perhaps one below either side: (feature, most on the left, left, right), or a value."""

    feature: str
    most: int
    left: float | Tree
    right: float | Tree

    def of(self, cell: dict) -> float:
        side = self.left if cell[self.feature] <= self.most else self.right
        return side.of(cell) if isinstance(side, Tree) else side

    def sql(self, x: str) -> str:
        left, right = (s.sql(x) if isinstance(s, Tree) else f"{float(s)!r}D" for s in (self.left, self.right))
        return f"CASE WHEN {x}.{self.feature} <= {self.most} THEN {left} ELSE {right} END"


@dataclass
class Model:
    """Boosted trees, and for each kind the least score that redacts (kinds without one are never added)."""

    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    least: dict[str, float] = field(default_factory=dict)

    def score(self, cell: dict) -> float:
        out = self.start
        for t in self.trees:
            out += t.of(cell)  # in the order of sql(): thresholds are compared to the last bit
        return out

    def sql(self, x: str) -> str:
        return " + ".join([f"{float(self.start)!r}D", *(t.sql(x) for t in self.trees)])


def _leaf(rows: list[tuple[dict, float, float]]) -> float:
    return RATE * sum(r[1] for r in rows) / (sum(r[2] for r in rows) + 1.0)


def _grow(rows: list[tuple[dict, float, float]], depth: int) -> float | Tree:
    """The split of greatest gain; rows: cell, negative gradient, curvature."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best: tuple[float, str, int] | None = None
    for name, most in FEATURES.items():
        by = [[0.0, 0.0] for _ in range(most + 1)]
        for cell, gradient, curvature in rows:
            by[cell[name]][0] += gradient
            by[cell[name]][1] += curvature
        gl = hl = 0.0
        for v in range(most):
            gl, hl = gl + by[v][0], hl + by[v][1]
            if hl > 1e-9 and h - hl > 1e-9:
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, name, v)
    if best is None or best[0] <= 1e-6:
        return _leaf(rows)
    _, name, v = best
    sides = [[r for r in rows if r[0][name] <= v], [r for r in rows if r[0][name] > v]]
    left, right = (_grow(s, depth - 1) if depth > 1 else _leaf(s) for s in sides)
    return Tree(name, v, left, right)


def grow(cells: list[dict]) -> Model:
    """Trees of a table of counts: features, n and good."""
    n, good = sum(c["n"] for c in cells), sum(c["good"] for c in cells)
    if not 0 < good < n:
        return Model()
    model = Model(math.log(good / (n - good)))
    scores = [model.start] * len(cells)
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in scores]
        tree = _grow([(c, c["good"] - c["n"] * q, c["n"] * q * (1 - q)) for c, q in zip(cells, p)], 2)
        if not isinstance(tree, Tree):
            break
        model.trees.append(tree)
        scores = [s + tree.of(c) for s, c in zip(scores, cells)]
    return model


def threshold(scored: list[tuple[float, int, int]]) -> float | None:
    """The least score to be taken, of (score, n, good) held back, with PRIOR."""
    # pooled adjacent violators: from the highest score down, the share of good ones never rises
    pools: list[list[float]] = []
    for s, n, good in sorted(scored, reverse=True):
        pools.append([s, n, good])
        while len(pools) > 1 and pools[-1][2] * pools[-2][1] >= pools[-2][2] * pools[-1][1]:
            s, n, good = pools.pop()
            pools[-1] = [s, pools[-1][1] + n, pools[-1][2] + good]
    least, of, right = None, float(sum(PRIOR)), float(PRIOR[0])
    for s, n, good in pools:
        of, right = of + n, right + good
        if good < LEAST_SHARE * n:
            break
        if right >= LEAST_SHARE * of:
            least = s
    return least


def boost(cells: list[dict]) -> Model:
    """Trees of all counts, with thresholds from each fold's scores by the trees of the others."""
    model = grow(cells)
    held: dict[str, list] = {}
    for fold in range(FOLDS):
        others = grow([c for c in cells if c["fold"] != fold])
        for c in cells:
            if c["fold"] == fold and others.trees:
                held.setdefault(ALL_KINDS[c["kind"]], []).append((others.score(c), c["n"], c["good"]))
    for kind, scored in held.items():
        if (least := threshold(scored)) is not None:
            model.least[kind] = least
    return model


def fit(proposed: DataFrame) -> Model:
    """From the proposals of all documents, counted by their features (at most MOST_CELLS rows)."""

    def counted(good: str, bad: str) -> str:
        cells = [(good, "f", 1), (good, "looser", 1), (bad, "f", 0)]
        return "concat(" + ", ".join(f"transform({spans}, x -> struct(x.{f} AS f, {y} AS y))" for spans, f, y in cells) + ")"

    of = lambda k: f"filter(_loose, x -> x.kind = {ALL_KINDS.index(k)})"
    groups = [_parted(of(k), f"_{k}", counted) for k in KINDS]
    groups.append(_let(of(SECRET), lambda v: counted(f"filter({v}, x -> x.y)", f"filter({v}, x -> NOT x.y)")))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = proposed.where("size(_loose) > 0").select(fold, F.expr(f"explode(concat({', '.join(groups)}))").alias("x")).select("fold", "x.y", "x.f.*")
    table_of = rows.groupBy("fold", *FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    return boost([r.asDict() for r in table_of.orderBy("fold", *FEATURES).collect()])


def decide(proposed: DataFrame, model: Model) -> DataFrame:
    """``proposed`` with _added: the proposals that redact (kind, s, e), without those that meet base spans or better ones."""
    none = "CAST(array() AS ARRAY<STRUCT<kind: INT, s: INT, e: INT>>)"
    if not model.least:
        return proposed.withColumn("_added", F.expr(none))
    scored = f"transform(_loose, x -> struct(x.s AS s, x.e AS e, -({model.sql('x.f')}) AS z, x.kind AS kind))"
    enough = " ".join(f"WHEN x.kind = {ALL_KINDS.index(k)} THEN x.z <= {-v!r}D" for k, v in sorted(model.least.items()))
    free = _parted(f"filter({scored}, x -> CASE {enough} ELSE false END)", f"concat({', '.join(f'_{k}' for k in KINDS)})", lambda met, other: other)

    # spans that hang together, by start; of each such group the best first, and none that meets a better one
    group = "ARRAY<STRUCT<s: INT, e: INT, z: DOUBLE, kind: INT>>"
    nothing = f"CAST(array() AS ARRAY<{group}>)"

    def step(st: str, x: str) -> tuple[str, str]:
        apart = f"{x}.s >= {st}.end"
        new = f"struct(greatest({st}.end, {x}.e) AS end, IF({apart}, array({x}), concat({st}.open, array({x}))) AS open)"
        return new, f"IF({apart} AND size({st}.open) > 0, array({st}.open), {nothing})"

    best = f"aggregate(array_sort(transform(g, x -> struct(x.z AS z, x.s AS s, x.e AS e, x.kind AS kind))), {none}, (a, x) -> IF(exists(a, y -> y.s < x.e AND x.s < y.e), a, concat(a, array(struct(x.kind AS kind, x.s AS s, x.e AS e)))))"
    grouped = _let(_scan(f"array_sort({free})", f"struct(-1 AS end, CAST(array() AS {group}) AS open)", nothing, step), lambda v: f"concat({v}.out, array({v}.state.open))")
    return proposed.withColumn("_added", F.expr(f"IF(size(_loose) > 0, flatten(transform({grouped}, g -> {best})), {none})"))


#: All base spans with their kinds.
BASE_SPANS = "concat(" + ", ".join(f"transform(_{k}, x -> struct({i} AS kind, x.s AS s, x.e AS e))" for i, k in enumerate(KINDS)) + ")"


def _written(spans: str) -> Column:
    """kind:start:end of spans (kind, s, e), by kind, then start, joined by commas."""
    names = ", ".join(f"'{k}'" for k in ALL_KINDS)
    return F.expr(f"array_join(transform(array_sort({spans}), x -> concat_ws(':', get(array({names}), x.kind), x.s, x.e)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """Per document the base spans' counts and digest, and all spans. Spans are found once, and kept without the texts in between."""
    proposed = cut(propose(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).drop("text"))
    decided = decide(proposed, fit(proposed)).withColumn("_base", F.expr(BASE_SPANS))
    counts = [F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return decided.select("doc_id", *counts, F.sha2(_written("_base"), 256).alias("base_sha256"), _written("concat(_base, _added)").alias("spans"), F.size("_added").cast("bigint").alias("n_added"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; of overlapping spans the first gives the kind.

    ``n_chars`` follows the text. Null texts stay null.
    """
    docs, back = set_aside(docs, {"_loose", "_added", "_spans", "_new", *(f"_{k}" for k in (*KINDS, *LOOSE))})
    proposed = propose(docs)
    if model is None:
        model = fit(cut(propose(docs.select("doc_id", "text")).drop("text")))
    every = f"transform(concat({BASE_SPANS}, _added), x -> struct(x.s AS s, x.e AS e, x.kind AS kind))"
    none = "CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, kind: INT>>)"

    def step(st: str, x: str) -> tuple[str, str]:
        apart = f"{x}.s >= {st}.e"
        return f"struct(IF({apart}, {x}.s, {st}.s) AS s, greatest({st}.e, {x}.e) AS e, IF({apart}, {x}.kind, {st}.kind) AS kind)", f"IF({apart} AND {st}.e > 0, array({st}), {none})"

    joined = _let(_scan(f"array_sort({every})", "struct(0 AS s, 0 AS e, 0 AS kind)", none, step), lambda v: f"IF({v}.state.e > 0, concat({v}.out, array({v}.state)), {v}.out)")
    found = decide(proposed, model).withColumn("_spans", F.expr(joined))
    marks = ", ".join(f"'[{k.upper()}]'" for k in ALL_KINDS)
    before = "IF(i > 0, get(_spans, i - 1).e, 0)"
    pieces = F.expr(f"transform(_spans, (x, i) -> concat(substring(text, {before} + 1, x.s - {before}), get(array({marks}), x.kind)))")
    rest = F.substring(F.col("text"), F.element_at("_spans", -1)["e"] + 1, F.char_length("text"))
    text = F.when(F.size("_spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    out = found.withColumn("_new", text)
    columns = [F.col("_new").alias("text") if c == "text" else F.when((F.size("_spans") > 0), F.char_length("_new")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(columns).withColumnsRenamed(back)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
