"""Policy conditions: ``a > 1 && (b || !c) -> d``, parsed into a column.

Loosest first: ``->`` and ``=>`` (implies, to the right), ``||``, ``&&``,
comparisons, ``+ -``, ``* /``, then ``!`` and unary minus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_][\w.]*)|(&&|\|\||->|=>|>=|<=|==|!=|[!+\-*/<>=()]))")
#: Binary operators from loosest to tightest; the first level associates to the right.
LEVELS = [("->", "=>"), ("||",), ("&&",), (">=", "<=", "==", "!=", ">", "<", "="), ("+", "-"), ("*", "/")]
_NUMERIC = {"+", "-", "*", "/", ">", "<", ">=", "<="}


@dataclass(frozen=True)
class Node:
    """op is number, bool, name or an operator."""

    op: str
    args: tuple


class ConditionError(ValueError):
    pass


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConditionError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


def parse(text: str) -> Node:
    rest = tokens(text)[::-1]

    def level(n: int) -> Node:
        if n == len(LEVELS):
            return unary()
        left = level(n + 1)
        while rest and rest[-1] in LEVELS[n]:
            op = rest.pop()
            right = level(n if n == 0 else n + 1)
            left = Node({"=>": "->", "=": "=="}.get(op, op), (left, right))
        return left

    def unary() -> Node:
        if not rest:
            raise ConditionError("the condition ends too early")
        t = rest.pop()
        if t in ("!", "-"):
            return Node("not" if t == "!" else "negate", (unary(),))
        if t == "(":
            inner = level(0)
            if not rest or rest.pop() != ")":
                raise ConditionError("missing ')'")
            return inner
        if t in ("true", "false"):
            return Node("bool", (t == "true",))
        if t[0].isdigit():
            return Node("number", (t,))
        if re.match(r"[A-Za-z_]", t):
            return Node("name", (t,))
        raise ConditionError(f"unexpected {t!r}")

    found = level(0)
    if rest:
        raise ConditionError(f"unexpected {rest[-1]!r}")
    return found


def sorts(node: Node) -> dict[str, str]:
    """bool or real for each name; raises if a name is used as both, or an operator does not fit."""
    found: dict[str, str] = {}

    def need(n: Node, sort: str | None) -> str | None:
        op = n.op
        if op == "name":
            have = found.get(n.args[0])
            if sort and have and have != sort:
                raise ConditionError(f"{n.args[0]} is used as {have} and as {sort}")
            if sort:
                found[n.args[0]] = sort
            return sort or have
        if op in ("==", "!="):
            known = need(n.args[0], None) or need(n.args[1], None) or "real"
            need(n.args[0], known)
            need(n.args[1], known)
            own = "bool"
        else:
            own = "real" if op in ("number", "negate", "+", "-", "*", "/") else "bool"
            if op not in ("number", "bool"):
                inner = "real" if op in _NUMERIC or op == "negate" else "bool"
                for a in n.args:
                    need(a, inner)
        if sort and own != sort:
            raise ConditionError(f"{op} gives {own} where {sort} is needed")
        return own

    need(node, "bool")
    return found


def column(condition: str | Node) -> Column:
    """The condition over columns named as in it; null operands give null."""
    node = parse(condition) if isinstance(condition, str) else condition
    sorts(node)

    def make(n: Node) -> Column:
        if n.op == "name":
            return F.col(n.args[0])
        if n.op == "bool":
            return F.lit(n.args[0])
        if n.op == "number":
            return F.lit(float(n.args[0]))
        a = [make(x) for x in n.args]
        return {
            "not": lambda: ~a[0], "negate": lambda: -a[0], "->": lambda: ~a[0] | a[1], "||": lambda: a[0] | a[1], "&&": lambda: a[0] & a[1], "==": lambda: a[0] == a[1], "!=": lambda: a[0] != a[1],
            ">": lambda: a[0] > a[1], "<": lambda: a[0] < a[1], ">=": lambda: a[0] >= a[1], "<=": lambda: a[0] <= a[1], "+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: F.try_divide(a[0], a[1]),
        }[n.op]()

    return make(node)
