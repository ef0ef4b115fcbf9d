"""Names of nodes and relations, and encoded attribute values."""

from __future__ import annotations

import re

#: Namespace of relation names.
NAMESPACE = "rel"


class SourceError(ValueError):
    """An error of a source text at a line."""

    def __init__(self, message: str, line: int = 1, text: str = ""):
        super().__init__(f"line {line}: {message}" + (f"\n  {text.strip()}" if text.strip() else ""))
        self.line, self.message = line, message


def node_name(token: str) -> str:
    """``user:10/a-b`` -> ``user.u10.a_b``: one dotted name, no segment of which begins with a digit."""
    out: list[str] = []
    for part in re.split(r"[:/.]", token.strip()):
        part = part.replace("-", "_")
        if not part:
            raise ValueError("empty name segment")
        if part[0].isdigit():
            part = ("u" if out and out[-1] == "user" else "n") + part
        out.append(part)
    return ".".join(out)


def relation_name(token: str) -> str:
    """``depends_on`` -> ``rel.dependsOn``; the words of a name are lower-cased before they are joined."""
    token = token.strip()
    token = token.removeprefix(f"{NAMESPACE}.")
    first, *rest = token.replace("_", "-").split("-")
    if not first:
        raise ValueError("empty relation")
    return f"{NAMESPACE}." + first.lower() + "".join(w.lower()[:1].upper() + w.lower()[1:] for w in rest)


def key_relation(key: str) -> str:
    """The relation that a declaration key lowers to: the same function as for query atoms."""
    return relation_name(key)


_INTEGER = re.compile(r"-?\d+\Z")


def encode_value(token: str) -> str:
    """A literal as encoded text: ``s:`` text, ``i:`` integer, ``d:`` decimal (spelling kept), ``b:`` boolean, ``n:`` name, ``?x`` variable."""
    token = token.strip()
    if not token:
        raise ValueError("attribute key and value must be nonempty")
    if len(token) >= 2 and token[0] == token[-1] == '"':
        return "s:" + token[1:-1]
    if token in ("true", "false"):
        return "b:" + token
    if _INTEGER.match(token):
        return f"i:{int(token)}"
    if token.startswith("?"):
        return variable_name(token)
    if "." in token:
        return "d:" + token
    return "n:" + node_name(token)


def variable_name(token: str) -> str:
    token = token.strip()
    if token == "?":
        raise ValueError("empty variable name")
    return "?" + node_name(token[1:])


def term(token: str) -> str:
    """A node name, or ``?variable``; only a leading question mark makes a variable."""
    token = token.strip()
    return variable_name(token) if token.startswith("?") else node_name(token)


#: Characters that are escaped in an attribute key's canonical text, and their escapes.
ESCAPES = {"%": "%25", ";": "%3B", "=": "%3D", ":": "%3A", "\t": "%09", "\n": "%0A"}


def escape(text: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in text)


def unescape(text: str) -> str:
    for c, code in reversed(ESCAPES.items()):
        text = text.replace(code, c)
    return text


def attrs_key(attrs: dict[str, str]) -> str:
    """Canonical text of attributes: sorted ``key=value`` pairs; equal for equal attributes."""
    return ";".join(f"{escape(k)}={v[:2]}{escape(v[2:])}" for k, v in sorted(attrs.items()))


def parse_attrs_key(text: str) -> dict[str, str]:
    pairs = (p.partition("=") for p in text.split(";") if p)
    return {unescape(k): v[:2] + unescape(v[2:]) for k, _, v in pairs}
