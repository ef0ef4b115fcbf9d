"""Typed declarations: parsing, validation and lowering to facts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .ast import Atom, Declaration, Value, distinct, is_variable
from .names import NAMESPACE, SourceError, key_relation, node_name, variable_name
from .text import first_open, split_top

#: Declaration keywords; a kind's prefix is its keyword in lower case.
KINDS = (
    "SERVICE HOST DATASOURCE METRIC POLICY EVENT PROVIDER TM_ATOM LTS_ATOM REFINES CORRESPONDS PROOF_OBLIGATION "
    "FORMALIZATION_TARGET LANGUAGE_PROFILE GRAMMAR_PROFILE PARSER_ADAPTER DSL_PROFILE QUERY_PACK"
).lower().split()

#: Attributes that a kind requires.
REQUIRED = {
    "datasource": "type", "provider": "source", "metric": "source",
    "tm_atom": "states alphabet blank initial accept reject transitions", "lts_atom": "states initial transitions",
    "refines": "spec impl", "corresponds": "left right", "proof_obligation": "relation statement tool",
    "formalization_target": "module file declaration status priority", "language_profile": "family module_system",
    "grammar_profile": "language notation entrypoints", "parser_adapter": "language input_profile output_profile runtime",
    "dsl_profile": "query_pack", "query_pack": "queries",
}

_LEVELS = "low medium high critical"
_ENVIRONMENTS = "dev qa prod dr cqa"
#: Allowed values of a kind's attributes.
ENUMS = {
    ("service", "criticality"): _LEVELS, ("service", "environment"): _ENVIRONMENTS, ("service", "env"): _ENVIRONMENTS,
    ("host", "environment"): _ENVIRONMENTS, ("host", "type"): "physical vm container pod process",
    ("datasource", "type"): "rest file command socket websocket pipe cucumber", ("datasource", "format"): "json text csv edn kv yaml yml", ("datasource", "poll_mode"): "event interval",
    ("provider", "language"): "hcl opentofu terraform native", ("provider", "engine"): "opentofu terraform hcl_native custom",
    ("event", "criticality"): _LEVELS, ("policy", "criticality"): _LEVELS,
    ("proof_obligation", "criticality"): _LEVELS, ("proof_obligation", "status"): "open pending proved failed waived", ("proof_obligation", "tool"): "z3 tlaps lean4 acl2 manual",
    ("proof_obligation", "logic"): "all qf_lia qf_lra qf_nia qf_nra qf_uf", ("proof_obligation", "expectation"): "sat unsat",
    ("formalization_target", "status"): "draft blocked ready in_progress implemented verified reviewed proved rejected superseded",
    ("language_profile", "family"): "ocaml sml antlr ebnf hybrid", ("language_profile", "module_system"): "ml_module sml_structure_signature none",
    ("grammar_profile", "notation"): "ebnf antlr4 menhir ocamlyacc mlyacc custom", ("grammar_profile", "status"): "draft stable deprecated",
    ("parser_adapter", "runtime"): "native jvm python node external", ("parser_adapter", "input_profile"): "source_text grammar_spec typed_ast ast",
    ("parser_adapter", "output_profile"): "vetc_ir core_tuples lean_plan", ("parser_adapter", "determinism"): "deterministic best_effort",
    ("dsl_profile", "planner_hint"): "as_is bound_first high_selectivity_first", ("dsl_profile", "default_profile"): "auto tm.det lts constraint",
    ("dsl_profile", "verification_chain"): "tm.det lts constraint proof_obligation theorem_ci vstack_ci query_ci",
}

#: Attributes that name other declarations: kind (None: any), attribute, kinds that it may name.
REFERENCES = [
    ("service", "uses", ("service",)), ("service", "used_by", ("service",)), ("metric", "source", ("datasource",)),
    (None, "provider", ("provider",)), (None, "providers", ("provider",)), ("grammar_profile", "language", ("language_profile",)),
    ("parser_adapter", "language", ("language_profile",)), ("parser_adapter", "grammar", ("grammar_profile",)), ("dsl_profile", "query_pack", ("query_pack",)),
    ("proof_obligation", "relation", ("refines", "corresponds")), ("corresponds", "refines", ("refines",)),
]
_ALIASES = {("service", "depends"): "uses", ("service", "depended_by"): "used_by"}


@dataclass(frozen=True)
class Issue:
    kind: str
    declaration: str
    message: str
    key: str | None = None


def entity(d: Declaration) -> str:
    """``kind.name``; names with a dot stay."""
    return d.name if "." in d.name else f"{d.kind}.{d.name}"


# ---- parsing


def parse_value(text: str) -> Value:
    token = text.strip()
    if not token:
        raise ValueError("empty declaration value")
    if len(token) >= 2 and token[0] == token[-1] == '"':
        return Value("text", token[1:-1])
    if token in ("true", "false"):
        return Value("boolean", token)
    if re.fullmatch(r"-?\d+", token):
        return Value("integer", str(int(token)))
    if token.startswith("#{") and token.endswith("}"):
        return Value("set", tuple(map(parse_value, split_top(token[2:-1], " "))))
    if token.startswith("[") and token.endswith("]"):
        inner = token[1:-1]
        parts = split_top(inner, ",")
        return Value("list", tuple(map(parse_value, parts if len(parts) > 1 else split_top(inner, " "))))
    if token.startswith("{") and token.endswith("}"):
        pairs = [split_top(e, " ") for e in split_top(token[1:-1], ",")]
        if any(len(p) != 2 for p in pairs):
            raise ValueError("a map entry requires a key and a value")
        return Value("map", tuple((parse_value(k), parse_value(v)) for k, v in pairs))
    name = token.removeprefix(":")
    if "." in token and re.match(r"-?\d", token):
        return Value("decimal", token)
    return Value("name", variable_name(name) if name.startswith("?") else node_name(name))


def is_declaration(text: str) -> bool:
    return text.split(" ", 1)[0].lower() in KINDS and text.split(" ", 1)[0].isupper()


def parse(text: str, line: int) -> Declaration:
    """``KIND name [key=value, ...].``"""
    body = text.strip()
    if not body.endswith("."):
        raise SourceError("declaration must end with '.'", line, text)
    body = body[:-1].strip()
    keyword, _, rest = body.partition(" ")
    if not is_declaration(body):
        raise SourceError(f"unsupported declaration kind {keyword}", line, text)
    kind = keyword.lower()
    cut = first_open(rest, "[")
    name, listed = (rest, "") if cut < 0 else (rest[:cut], rest[cut:].strip())
    if listed and not listed.endswith("]"):
        raise SourceError("declaration attribute list must end with ']'", line, text)
    attrs = []
    try:
        for entry in split_top(listed[1:-1], ",") if listed else []:
            at = first_open(entry, "=")
            if at <= 0:
                raise ValueError(f"declaration attribute requires key=value: {entry}")
            key = node_name(entry[:at])
            key = _ALIASES.get((kind, key), key)
            attrs.append((key, _lower_enum(kind, key, parse_value(entry[at + 1 :]))))
        d = Declaration(kind, node_name(name), tuple(attrs), line)
    except ValueError as e:
        raise SourceError(str(e), line, text) from None
    if found := issues_of(d):
        raise SourceError("; ".join(i.message for i in found), line, text)
    return d


def _lower_enum(kind: str, key: str, value: Value) -> Value:
    """Values of an enumeration are stored in lower case."""
    if (kind, key) not in ENUMS:
        return value
    if value.kind in ("list", "set"):
        return Value(value.kind, tuple(_lower_enum(kind, key, v) for v in value.value))
    return Value(value.kind, value.value.lower()) if value.kind in ("name", "text", "decimal") else value


# ---- validation


def _tokens(d: Declaration, key: str) -> list[str]:
    value = d.get(key)
    return [t for v in value.members() if (t := v.token()) is not None] if value else []


def issues_of(d: Declaration) -> list[Issue]:
    """Problems of a declaration on its own."""
    who, out = entity(d), []
    keys = [k for k, _ in d.attrs]
    if len(set(keys)) != len(keys):
        out.append(Issue("duplicate_key", who, "duplicate declaration attribute key"))
    for key in REQUIRED.get(d.kind, "").split():
        if key not in keys:
            out.append(Issue("missing_required", who, f"missing required attribute {key}", key))
    for key, value in d.attrs:
        if any(is_variable(str(s.value)) for s in value.scalars() if s.kind == "name"):
            out.append(Issue("invalid_structure", who, f"attribute {key} contains a variable", key))
        allowed = ENUMS.get((d.kind, key), "").split()
        for member in value.members() if allowed else []:
            token = member.token()
            if token is None:
                out.append(Issue("invalid_enum", who, f"attribute {key} requires a named enum value", key))
            elif token not in allowed:
                out.append(Issue("invalid_enum", who, f"invalid value {token} for {key}", key))
    if d.kind in ("tm_atom", "lts_atom"):
        out += _automaton_issues(d, who)
    return out


def _automaton_issues(d: Declaration, who: str) -> list[Issue]:
    def bad(message: str, key: str | None = None) -> None:
        out.append(Issue("invalid_structure", who, message, key))

    out: list[Issue] = []
    states, initial = set(_tokens(d, "states")), _tokens(d, "initial")
    label = d.kind.upper()
    if not states:
        bad(f"{label} states must be nonempty", "states")
    if initial and initial[0] not in states:
        bad(f"{label} initial state is unknown", "initial")
    moves = transitions(d)
    if any(m is None for m in moves):
        bad("malformed transition", "transitions")
    moves = [m for m in moves if m is not None]
    for m in moves:
        for s in (m["from_state"], m["to_state"]):
            if states and s not in states:
                bad(f"unknown state {s} in a transition", "transitions")
    if d.kind == "lts_atom":
        return out
    alphabet, accept, reject = set(_tokens(d, "alphabet")), _tokens(d, "accept"), _tokens(d, "reject")
    blank = _tokens(d, "blank")
    if not alphabet:
        bad("TM_ATOM alphabet must be nonempty", "alphabet")
    if blank and blank[0] not in alphabet:
        bad("TM_ATOM blank must belong to alphabet", "blank")
    for key, listed in (("accept", accept), ("reject", reject)):
        if d.get(key) is not None and not listed:
            bad(f"TM_ATOM {key} must be nonempty", key)
        out += [Issue("invalid_structure", who, f"unknown {key} state {s}", key) for s in listed if s not in states]
    out += [Issue("invalid_structure", who, f"state {s} is both accepting and rejecting") for s in accept if s in reject]
    for m in moves:
        if m["move"] not in ("L", "R", "N"):
            bad(f"unknown move {m['move']}", "transitions")
        for s in (m["read_symbol"], m["write_symbol"]):
            if s not in alphabet:
                bad(f"unknown symbol {s} in a transition", "transitions")
    have = {(m["from_state"], m["read_symbol"]) for m in moves}
    for s in sorted(states - set(accept) - set(reject)):
        for a in sorted(alphabet):
            if (s, a) not in have:
                bad(f"no transition from {s} on {a}", "transitions")
    return out


def transitions(d: Declaration) -> list[dict[str, str] | None]:
    """Transitions by source text; None for a malformed one."""
    value = d.get("transitions")
    if value is None or value.kind != "map":
        return [None] if value is not None else []
    out: list[dict[str, str] | None] = []
    for key, target in value.value:
        k = [m.token() for m in key.members()] if key.kind == "list" else []
        t = [m.token() for m in target.members()] if target.kind in ("list", "set") else [target.token()]
        if len(k) != 2 or None in k or None in t:
            out.append(None)
        elif d.kind == "tm_atom":
            out.append(dict(zip(("from_state", "read_symbol", "to_state", "write_symbol", "move"), (*k, *t))) if len(t) == 3 else None)
        elif len(t) >= 1:
            out.append({"from_state": k[0], "label": k[1], "to_state": t[0]} | ({"effect": t[1]} if len(t) > 1 else {}))
        else:
            out.append(None)
    return sorted(out, key=lambda m: (m is None, sorted((m or {}).items())))


def _named(value: Value, prefix: str) -> list[str]:
    """Entities that a value names; bare tokens get the prefix."""
    out = []
    for v in value.members():
        if (token := v.token()) is not None:
            token = clean(token)
            out.append(token if v.kind == "name" and "." in token else f"{prefix}.{token}")
    return out


def reference_rows(declarations: list[Declaration]) -> list[tuple[str, str, str, tuple[str, ...]]]:
    """(declaration, attribute, name as written, entities that would satisfy it)."""
    out = []
    for d in declarations:
        for kind, key, targets in REFERENCES:
            value = d.get(key)
            if value is None or kind not in (None, d.kind):
                continue
            for i, name in enumerate(_named(value, targets[0])):
                if d.kind == "metric" and value.members()[i].token() is not None and "." not in value.members()[i].token():
                    continue  # a bare metric source is free text
                bare = name.split(".", 1)[1] if name.startswith(targets[0] + ".") else name
                out.append((entity(d), key, name, tuple({name, *(f"{t}.{bare}" for t in targets)})))
    return out


def issues(declarations: list[Declaration]) -> list[Issue]:
    """Problems of declarations on their own, repeated names, missing references, service cycles."""
    out = [i for d in declarations for i in issues_of(d)]
    names = [entity(d) for d in declarations]
    out += [Issue("duplicate_declaration", n, f"duplicate declaration {n}") for n in dict.fromkeys(names) if names.count(n) > 1]
    known = set(names)
    for who, key, name, options in reference_rows(declarations):
        if known.isdisjoint(options):
            out.append(Issue("invalid_reference", who, f"attribute {key} references missing declaration {name}", key))
    edges = service_edges(declarations)
    for d in declarations:
        if d.kind == "service" and entity(d) in _reach(edges, entity(d)):
            out.append(Issue("dependency_cycle", entity(d), f"service dependency cycle includes {entity(d)}"))
    return out


def service_edges(declarations: list[Declaration]) -> set[tuple[str, str]]:
    out = set()
    for d in declarations:
        if d.kind == "service":
            out |= {(entity(d), t) for t in _named(d.get("uses"), "service")} if d.get("uses") else set()
            out |= {(t, entity(d)) for t in _named(d.get("used_by"), "service")} if d.get("used_by") else set()
    return out


def _reach(edges: set[tuple[str, str]], start: str) -> set[str]:
    following: dict[str, list[str]] = {}
    for a, b in edges:
        following.setdefault(a, []).append(b)
    seen: set[str] = set()
    todo = list(following.get(start, []))
    while todo:
        if (x := todo.pop()) not in seen:
            seen.add(x)
            todo += following.get(x, [])
    return seen


# ---- lowering


def clean(text: str) -> str:
    """Text as part of a name."""
    return text.replace(":", ".").replace("/", ".").replace(" ", "_").replace("-", "_").replace('"', "")


def node_of(value: Value) -> str:
    return value.value if value.kind == "name" else f"value.{clean(value.value)}"


def lower(d: Declaration) -> list[Atom]:
    """A kind fact, and facts of each attribute."""
    me = entity(d)

    def fact(subject: str, relation: str, obj: str, attrs: tuple[tuple[str, str], ...] = ()) -> None:
        out.append(Atom(subject, f"{NAMESPACE}.{relation}", obj, attrs, d.line))

    out = [Atom(me, f"{NAMESPACE}.kind", f"entity.{d.kind}", line=d.line)]
    for key, value in d.attrs:
        if d.kind == "service" and key in ("uses", "used_by"):
            for other in _named(value, "service"):
                fact(me, "uses" if key == "uses" else "usedBy", other)
                fact(other, "usedBy" if key == "uses" else "uses", me)
                if key == "uses":
                    fact(me, "dependsOn", other)
        elif key in ("provider", "providers"):
            for other in _named(value, "provider"):
                fact(me, key, other)
                fact(other, "providesFor", me)
        elif d.kind in ("tm_atom", "lts_atom") and key == "transitions":
            relation, prefix = ("transition", "tmtr") if d.kind == "tm_atom" else ("edge", "ltsedge")
            for i, move in enumerate(m for m in transitions(d) if m is not None):
                fact(me, relation, f"{prefix}.n{i}", tuple((k, "s:" + v) for k, v in move.items()))
        else:
            for scalar in value.scalars():
                out.append(Atom(me, key_relation(key), node_of(scalar), line=d.line))
    return distinct(out)


def lower_all(declarations: list[Declaration]) -> list[Atom]:
    return distinct([a for d in declarations for a in lower(d)])
