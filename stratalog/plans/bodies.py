"""Rule and query bodies as joins of fact tables.  Bindings are tables with a column for each variable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.facts import NO_ATTRS, key_of_pairs
from ..language.ast import Atom, is_variable
from .analysis import connected_order


def column(variable: str) -> str:
    """The column of a variable.

    Spark's column names ignore case and split at dots; variables do neither.
    So an underscore stands before what it changes: a capital letter, a dot, an
    underscore itself.
    """
    return "v_" + "".join("__" if c == "_" else "_1" if c == "." else f"_{c.lower()}" if c != c.lower() else c for c in variable[1:])


def answers(variables: tuple[str, ...] | list[str]) -> list[Column]:
    """Columns of selected variables, named without question marks.

    Dots become underscores; a name that is taken, in whatever case, gets the
    first free number at its end.
    """
    out, taken = [], set()
    for v in variables:
        name = base = v[1:].replace(".", "_")
        k = 2
        while name.lower() in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name.lower())
        out.append(F.col(column(v)).alias(name))
    return out


Scan = Callable[[str], DataFrame]


def scan(atom: Atom, facts: DataFrame, any_value: bool = False, extra: dict[str, str] | None = None) -> DataFrame:
    """Bindings of one atom over facts of its relation; ``extra`` keeps further columns under new names.

    An attribute pattern needs its key in the fact and ignores others.  Its
    variable binds names only, unless ``any_value``: then other values bind as
    encoded text.
    """
    out: dict[str, Column] = {}
    tests: list[Column] = []

    def bind(pattern: str, value: Column, encoded: bool = False) -> None:
        if not is_variable(pattern):
            tests.append(value == F.lit(pattern))
            return
        if encoded:
            if not any_value:
                tests.append(value.startswith("n:"))
            value = F.when(value.startswith("n:"), F.substring(value, 3, 1 << 30)).otherwise(value)
            tests.append(value.isNotNull())
        name = column(pattern)
        if name in out:
            tests.append(out[name] == value)
        else:
            out[name] = value

    bind(atom.subject, F.col("subject"))
    bind(atom.object, F.col("object"))
    for key, value in atom.attrs:
        bind(value, F.col("attrs")[key], encoded=is_variable(value))
    rows = facts
    for t in tests:
        rows = rows.where(t)
    return rows.select(*[c.alias(n) for n, c in out.items()], *[F.col(a).alias(b) for a, b in (extra or {}).items()])


def join(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    """Natural join on shared variables; without any, every pair (inner) or all or nothing (anti)."""
    if left is None:
        return right
    keys = [c for c in left.columns if c.startswith("v_") and c in right.columns]
    if keys:
        return left.join(right, keys, how)
    if how == "inner":
        return left.crossJoin(right)
    return left.join(right.select(F.lit(1).alias("__some")).limit(1), F.lit(True), how)


def body(positive: tuple[Atom, ...], negative: tuple[Atom, ...], of: Scan | list[DataFrame], against: Scan, any_value: bool = False) -> DataFrame:
    """Bindings that satisfy all positive atoms and no negative one.

    ``of`` gives the facts of a relation, or is a list with a table for each
    positive atom.  Atoms are joined along shared variables; a body that falls
    into unconnected parts makes their product, as its meaning asks.
    """
    rows = None
    for i in connected_order(list(positive)):
        rows = join(rows, scan(positive[i], of[i] if isinstance(of, list) else of(positive[i].relation), any_value))
    for atom in negative:
        rows = join(rows, scan(atom, against(atom.relation), any_value).distinct(), "left_anti")
    return rows


def value_of(pattern: str, attribute: bool = False) -> Column:
    if not is_variable(pattern):
        return F.lit(pattern)
    c = F.col(column(pattern))
    if not attribute:
        return c
    return F.when(c.rlike("^[sidbn]:"), c).otherwise(F.concat(F.lit("n:"), c))


def head(atom: Atom, rows: DataFrame) -> DataFrame:
    """Facts that bindings make of a rule's head."""
    pairs = {k: value_of(v, attribute=True) for k, v in atom.attrs}
    attrs = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]) if pairs else F.expr(NO_ATTRS)
    return rows.select(value_of(atom.subject).alias("subject"), F.lit(atom.relation).alias("relation"), value_of(atom.object).alias("object"), attrs.alias("attrs"), key_of_pairs(pairs).alias("attrs_key"))
