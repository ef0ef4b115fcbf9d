"""Programs built in Python: facts, rules, queries and declarations without source text.

    kb = Builder("access")
    kb.tuple("doc:plan", "viewer", "user:1", level=2)
    kb.rule("reads", head=("?u", "reads", "?d"), when=[("?d", "viewer", "?u")], unless=[("?u", "suspended", "value:true")])
    kb.query("who", ["?u"], [("?u", "reads", "doc:plan")])
    kb.program()
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..plans.analysis import stratify
from . import declarations as decl
from .ast import TRUST, Atom, Declaration, Program, TupleFact, Value
from .names import encode_value, node_name, relation_name, term
from .program import make_query, make_rules

Pattern = tuple


def encode(value: object) -> str:
    """A Python value as an encoded attribute; strings are text, unless they start with ``?`` or ``n:``."""
    if isinstance(value, bool):
        return f"b:{str(value).lower()}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        return f"d:{value}"
    text = str(value)
    if text.startswith("?"):
        return encode_value(text)
    return "n:" + node_name(text[2:]) if text.startswith("n:") else "s:" + text


def atom(pattern: Pattern) -> Atom:
    """(subject, relation, object) or (subject, relation, object, attributes)."""
    subject, relation, obj, *attrs = pattern
    return Atom(term(subject), relation_name(relation), term(obj), tuple((node_name(k), encode(v)) for k, v in (attrs[0] if attrs else {}).items()))


@dataclass(frozen=True)
class Profile:
    """Relations with the kinds of their ends."""

    name: str
    signatures: dict[str, tuple[str, str]]

    def problems(self, atoms: list[Atom], kind_of: dict[str, str]) -> list[str]:
        """Atoms whose known ends are of other kinds."""
        out = []
        for a in atoms:
            want = self.signatures.get(a.relation)
            for end, kind in zip((a.subject, a.object), want or ()):
                if kind_of.get(end, kind) != kind:
                    out.append(f"{a.text()}: {end} is a {kind_of[end]}, not a {kind}")
        return out


@dataclass
class Builder:
    module: str | None = None
    tuples: list[TupleFact] = field(default_factory=list)
    rules: list = field(default_factory=list)
    queries: list = field(default_factory=list)
    declarations: list[Declaration] = field(default_factory=list)
    profiles: dict[str, Profile] = field(default_factory=dict)
    links: dict[str, str] = field(default_factory=dict)

    def fact(self, subject: str, relation: str, obj: str, **attrs: object) -> "Builder":
        return self.tuple(subject, relation, obj, **attrs)

    def tuple(self, obj: str, relation: str, target: str, userset: str | None = None, **attrs: object) -> "Builder":
        """A stored tuple; ``userset`` makes its subject whoever stands in that relation to ``target``."""
        found = TupleFact(node_name(obj), relation_name(relation), node_name(target), relation_name(userset) if userset else None, tuple((node_name(k), encode(v)) for k, v in attrs.items()))
        if found not in self.tuples:
            self.tuples.append(found)
        return self

    def rule(self, name: str, head: Pattern | list[Pattern], when: list[Pattern], unless: list[Pattern] = (), trust: str = "asserted") -> "Builder":
        """Rules with one or several heads; raises if they are unsafe or make the program unstratifiable."""
        if trust not in TRUST:
            raise ValueError(f"unknown trust {trust}")
        heads = head if isinstance(head, list) else [head]
        made = make_rules(node_name(name), [*map(atom, when)], [*map(atom, unless)], [*map(atom, heads)], trust=trust)
        stratify([*self.rules, *made])
        self.rules += made
        return self

    def query(self, name: str, select: list[str], where: list[Pattern], unless: list[Pattern] = ()) -> "Builder":
        self.queries.append(make_query(node_name(name), [term(s) for s in select], [*map(atom, where)], [*map(atom, unless)]))
        return self

    def declare(self, kind: str, name: str, **attrs: object) -> "Builder":
        """A typed declaration; lists, sets and dicts nest."""
        found = Declaration(kind.lower(), node_name(name), tuple((k, value_of(v)) for k, v in attrs.items()))
        problems = decl.issues_of(found)
        if problems:
            raise ValueError("; ".join(p.message for p in problems))
        self.declarations.append(found)
        return self

    def profile(self, name: str, **signatures: tuple[str, str]) -> "Builder":
        self.profiles[name] = Profile(name, {relation_name(k): v for k, v in signatures.items()})
        return self

    def link(self, declaration: str, node: str) -> "Builder":
        """Ties a declaration of a host program to a node."""
        self.links[declaration] = node_name(node)
        return self

    def program(self) -> Program:
        """The program; raises on problems between declarations."""
        problems = decl.issues(self.declarations)
        if problems:
            raise ValueError("; ".join(p.message for p in problems))
        return Program(node_name(self.module) if self.module else None, list(self.tuples), list(self.rules), list(self.queries), declarations=list(self.declarations))

    def merge(self, other: "Builder") -> "Builder":
        """What another builder has and this one lacks."""
        for mine, theirs in ((self.tuples, other.tuples), (self.rules, other.rules), (self.queries, other.queries), (self.declarations, other.declarations)):
            mine += [x for x in theirs if x not in mine]
        self.profiles = {**other.profiles, **self.profiles}
        self.links = {**other.links, **self.links}
        return self


def value_of(v: object) -> Value:
    if isinstance(v, Value):
        return v
    if isinstance(v, bool):
        return Value("boolean", str(v).lower())
    if isinstance(v, int):
        return Value("integer", str(v))
    if isinstance(v, float):
        return Value("decimal", str(v))
    if isinstance(v, dict):
        return Value("map", tuple((value_of(k), value_of(x)) for k, x in v.items()))
    if isinstance(v, (set, frozenset)):
        return Value("set", tuple(value_of(x) for x in sorted(v)))
    if isinstance(v, (list, tuple)):
        return Value("list", tuple(map(value_of, v)))
    return decl.parse_value(str(v)) if str(v).isidentifier() else Value("text", str(v))
