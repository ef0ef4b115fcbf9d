"""Infrastructure descriptions in block syntax (``resource "type" "name" { key = value }``) as facts."""

from __future__ import annotations

import re
from pathlib import Path

from ..language.ast import Atom, distinct
from ..language.declarations import clean
from ..language.names import NAMESPACE, node_name, relation_name

#: Block types that are imported, and how many labels they have.
BLOCKS = {"terraform": 0, "provider": 1, "resource": 2, "data": 2, "module": 1, "variable": 1, "output": 1}
_HEADER = re.compile(r'(\w+)((?:\s+"[^"]*"|\s+[\w\-]+)*)\s*\{')
_ATTRIBUTE = re.compile(r'^\s*([A-Za-z_][\w\-]*|"[^"]+")\s*=\s*(.*?)\s*,?\s*$')


def strip_comments(text: str) -> str:
    """Without ``#``, ``//`` and ``/* */`` comments outside strings."""
    return re.sub(r'("(?:\\.|[^"\\\n])*")|#[^\n]*|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)


def _close(text: str, at: int) -> int:
    """Place after the bracket that closes the one before ``at``."""
    depth, quoted = 1, False
    while at < len(text) and depth:
        c = text[at]
        if c == "\\" and quoted:
            at += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "{") - (c == "}")
        at += 1
    if depth:
        raise ValueError("a block is not closed")
    return at


def blocks(text: str) -> list[tuple[str, list[str], str]]:
    """(type, labels, body) of the top-level blocks."""
    text, out, at = strip_comments(text), [], 0
    while m := _HEADER.search(text, at):
        at = _close(text, m.end())
        out.append((m[1], [a or b for a, b in re.findall(r'"([^"]*)"|([\w\-]+)', m[2])], text[m.end() : at - 1]))
    return out


def attributes(body: str) -> dict[str, str]:
    """Top-level ``key = value`` lines of a body; nested blocks and maps are left out."""
    flat, at = "", 0
    while m := re.search(r"\{", body[at:]):
        flat += body[at : at + m.start()] + "{}"
        at = _close(body, at + m.end())
    flat += body[at:]
    out = {}
    for line in flat.splitlines():
        if (m := _ATTRIBUTE.match(line)) and "{}" not in m[2]:
            value = m[2]
            out[m[1].strip('"')] = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
    return out


def _safe(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.]+", "_", clean(text)).strip("._") or "empty"


def facts_of(text: str, file: str) -> list[Atom]:
    """Facts of one file: a kind, the file and each attribute of every block; providers that it requires and uses."""
    source, out = node_name("file:" + _safe(file)), []

    def fact(subject: str, relation: str, obj: str) -> None:
        out.append(Atom(subject, relation_name(relation) if not relation.startswith(NAMESPACE) else relation, obj))

    for kind, labels, body in blocks(text):
        if kind not in BLOCKS or len(labels) != BLOCKS[kind]:
            continue
        if kind == "terraform":
            for inner, _, required in ((k, n, b) for k, n, b in blocks(body) if k == "required_providers"):
                for name, spec in re.findall(r"([\w\-]+)\s*=\s*\{(.*?)\}", required, re.S):
                    me = node_name("provider:" + _safe(name))
                    fact(me, "kind", "entity.provider")
                    for k, v in attributes(spec).items():
                        fact(me, k, "value." + _safe(v))
            continue
        me = node_name(f"{kind}:" + ".".join(_safe(x) for x in labels))
        fact(me, "kind", f"entity.{kind}")
        fact(me, "declared_in", source)
        if kind in ("resource", "data"):
            fact(me, f"{kind}_type", "value." + _safe(labels[0]))
            fact(me, "provider", node_name("provider:" + _safe(labels[0].split("_")[0])))
        for k, v in attributes(body).items():
            fact(me, k, "value." + _safe(v))
            for ref in re.findall(r"\b(?:module|var|data\.\w+|[a-z]\w*_\w+)\.[A-Za-z_]\w*", v):
                head, _, rest = ref.partition(".")
                to = {"var": "variable:", "module": "module:", "data": "data:"}.get(head)
                fact(me, "references", node_name((to + rest) if to else f"resource:{ref}"))
    return distinct(out)


def import_path(path: str) -> list[Atom]:
    """Facts of a file, or of all ``.tf`` and ``.hcl`` files below a folder."""
    at = Path(path)
    files = [at] if at.is_file() else sorted(f for f in at.rglob("*") if f.suffix in (".tf", ".hcl"))
    if not files:
        raise ValueError(f"no .tf or .hcl files at {path}")
    return distinct([a for f in files for a in facts_of(f.read_text(), f.name)])
