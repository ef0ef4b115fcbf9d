"""Syntax tree.  Terms are strings: a node name, or ``?x`` for a variable."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .names import attrs_key


def is_variable(term: str) -> bool:
    return term.startswith("?")


@dataclass(frozen=True)
class Atom:
    """``subject#relation@object [attrs]``; attribute values are encoded, or ``?x``."""

    subject: str
    relation: str
    object: str
    attrs: tuple[tuple[str, str], ...] = ()
    line: int | None = None

    def variables(self) -> list[str]:
        found = [t for t in (self.subject, self.object, *(v for _, v in self.attrs)) if is_variable(t)]
        return list(dict.fromkeys(found))

    def is_ground(self) -> bool:
        return not self.variables()

    def same(self, other: "Atom") -> bool:
        """Equal but for where they come from."""
        return (self.subject, self.relation, self.object, attrs_key(dict(self.attrs))) == (other.subject, other.relation, other.object, attrs_key(dict(other.attrs)))

    def text(self) -> str:
        attrs = f" [{', '.join(f'{k}={v}' for k, v in self.attrs)}]" if self.attrs else ""
        return f"{self.subject}#{self.relation}@{self.object}{attrs}"


@dataclass(frozen=True)
class TupleFact:
    """A stored tuple; with ``userset`` its subject is whoever stands in that relation to ``target``."""

    object: str
    relation: str
    target: str
    userset: str | None = None
    attrs: tuple[tuple[str, str], ...] = ()
    line: int | None = None


#: How a rule came about.
TRUST = ("asserted", "graph_derived", "certified")


@dataclass(frozen=True)
class Rule:
    name: str
    positive: tuple[Atom, ...]
    negative: tuple[Atom, ...]
    head: Atom
    trust: str = "graph_derived"
    line: int | None = None


@dataclass(frozen=True)
class Query:
    name: str
    select: tuple[str, ...]
    positive: tuple[Atom, ...]
    negative: tuple[Atom, ...]
    line: int | None = None


@dataclass(frozen=True)
class Value:
    """A declaration's value: kind is text, integer, decimal, boolean, name, list, set or map."""

    kind: str
    value: Any

    def members(self) -> list["Value"]:
        return list(self.value) if self.kind in ("list", "set") else [self]

    def scalars(self) -> list["Value"]:
        if self.kind in ("list", "set"):
            return [x for v in self.value for x in v.scalars()]
        if self.kind == "map":
            return [x for pair in self.value for v in pair for x in v.scalars()]
        return [self]

    def token(self) -> str | None:
        return None if self.kind in ("list", "set", "map") else str(self.value)

    def encoded(self) -> str:
        prefix = {"text": "s:", "integer": "i:", "decimal": "d:", "boolean": "b:", "name": "n:"}[self.kind]
        return prefix + str(self.value)


@dataclass(frozen=True)
class Declaration:
    kind: str
    name: str
    attrs: tuple[tuple[str, Value], ...] = ()
    line: int | None = None

    def get(self, key: str) -> Value | None:
        return next((v for k, v in self.attrs if k == key), None)


@dataclass(frozen=True)
class MacroDef:
    name: str
    parameters: tuple[str, ...]
    emit: tuple[str, ...]
    line: int | None = None


@dataclass(frozen=True)
class Expansion:
    macro: str
    arguments: tuple[str, ...]
    emitted: tuple[str, ...]
    stack: tuple[str, ...]
    line: int


@dataclass
class Program:
    module: str | None = None
    tuples: list[TupleFact] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    queries: list[Query] = field(default_factory=list)
    macros: list[MacroDef] = field(default_factory=list)
    expansions: list[Expansion] = field(default_factory=list)
    declarations: list[Declaration] = field(default_factory=list)

    def facts(self) -> list[Atom]:
        """Ground facts of tuples, then of declarations, without repetitions."""
        from .declarations import lower_all

        found = [Atom(t.object, t.relation, t.target, t.attrs, t.line) for t in self.tuples]
        return distinct([*found, *lower_all(self.declarations)])

    def all_rules(self) -> list[Rule]:
        """Rules that usersets stand for, then the rules written; equal userset rules are shared."""
        out: dict[tuple, Rule] = {}
        for t in self.tuples:
            if t.userset is not None:
                rule = userset_rule(t)
                out.setdefault((rule.positive, rule.head), rule)
        return [*out.values(), *self.rules]

    def query(self, name: str) -> Query:
        for q in self.queries:
            if q.name == name:
                return q
        raise KeyError(f"unknown query {name}")


def userset_rule(t: TupleFact) -> Rule:
    """``o#r@u#s``: whoever stands in s to a u that stands in r to some o, stands in r to that o as well.

    Attributes of the tuple are required of and given to the outer relation.
    """
    body = (Atom("?object", t.relation, "?userset", t.attrs), Atom("?userset", t.userset, "?subject"))
    return Rule(f"userset_{t.relation}_via_{t.userset}_" + (f"line_{t.line}" if t.line else "generated"), body, (), Atom("?object", t.relation, "?subject", t.attrs), line=t.line)


def distinct(atoms: list[Atom]) -> list[Atom]:
    out: dict[tuple, Atom] = {}
    for a in atoms:
        out.setdefault((a.subject, a.relation, a.object, attrs_key(dict(a.attrs))), a)
    return list(out.values())
