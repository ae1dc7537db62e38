"""Who may do what, and what only reads.

Privileges own, write, read and drop; own holds all others, write holds read.
Grants on the warehouse hold for its namespaces and tables, those on a namespace
for its tables; roles are members of roles. System schemas are free to read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from tidemark.errors import InsufficientPrivilege, NotSupported
from tidemark.plans.asof import tokens

HOLDS = {"own": {"own", "write", "read", "drop"}, "write": {"write", "read"}, "read": {"read"}, "drop": {"drop"}}
SYSTEM = {"information_schema", "pg_catalog"}
WAREHOUSE = "*"


@dataclass
class Authorizer:
    """``grants``: (subject, privilege, object), an object being ``*``, a namespace, or namespace.table."""

    grants: set[tuple[str, str, str]] = field(default_factory=set)
    members: dict[str, set[str]] = field(default_factory=dict)

    def grant(self, subject: str, privilege: str, on: str = WAREHOUSE) -> None:
        if privilege not in HOLDS:
            raise NotSupported(f"no privilege {privilege}")
        self.grants.add((subject, privilege, on))

    def add_member(self, member: str, role: str) -> None:
        self.members.setdefault(member, set()).add(role)

    def subjects(self, who: str) -> set[str]:
        """The subject and all roles that it has, directly or through others."""
        seen, todo = set(), [who]
        while todo:
            if (s := todo.pop()) not in seen:
                seen.add(s)
                todo += self.members.get(s, ())
        return seen

    def allows(self, who: str, privilege: str, table: str) -> bool:
        namespace = table.split(".")[0]
        if namespace in SYSTEM:
            return privilege == "read"
        own = self.subjects(who)
        return any(s in own and privilege in HOLDS[p] and on in (WAREHOUSE, namespace, table) for s, p, on in self.grants)

    def check(self, who: str, needs: Iterable[tuple[str, str]]) -> None:
        """The first (privilege, table) that isn't allowed is the error."""
        for privilege, table in needs:
            if not self.allows(who, privilege, table):
                raise InsufficientPrivilege(f"{who} lacks {privilege} on {table}")


READS = {"select", "with", "values", "show", "describe", "desc", "table"}
WRITES = {"insert", "update", "delete", "merge", "truncate", "create", "drop", "alter", "copy", "begin", "commit", "rollback", "set", "call", "grant", "revoke", "refresh", "analyze", "cache", "uncache", "load", "use", "vacuum", "reset", "replace"}


def read_only(sql: str) -> bool:
    """Whether a statement surely only reads; what isn't known to is taken to write."""
    toks = tokens(sql)
    while toks and toks[-1].text == ";":
        toks.pop()
    if not toks or any(t.text == ";" for t in toks):
        return False
    first = next((t for t in toks if t.text != "("), toks[0]).word
    if first == "explain":
        rest = toks[1:]
        analyze = any(t.word == "analyze" for t in rest[:4])
        while rest and rest[0].word in ("analyze", "verbose", "formatted", "extended", "codegen", "cost"):
            rest = rest[1:]
        return bool(rest) and (read_only(sql[rest[0].start :]) or not analyze and rest[0].word in {"insert", "update", "delete"})
    if first not in READS:
        return False
    if first == "with":
        # each body of a common table expression, and the statement after them
        return not any(t.word in {"insert", "update", "delete", "merge"} and toks[i - 1].text in ("(", ")") for i, t in enumerate(toks) if i)
    return not any(t.word == "into" for t in toks)


def needs(kind: str, target: str | None, sources: Iterable[str]) -> list[tuple[str, str]]:
    """(privilege, table) of a statement, the target first."""
    privilege = {"insert": "write", "update": "write", "delete": "write", "create": "write", "drop": "drop"}.get(kind)
    out = [(privilege, target)] if privilege and target else []
    return out + [("read", s) for s in sources]


def text_read_only(sql: str) -> bool:
    """The coarse guard: begins with a reading verb and has no writing word anywhere outside quotes."""
    words = [t.word for t in tokens(sql) if t.word]
    return bool(words) and words[0] in READS | {"explain"} and not set(words) & (WRITES - {"set", "replace", "analyze", "cache", "use", "load", "call"})
