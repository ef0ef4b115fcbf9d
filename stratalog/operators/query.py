"""Answers to queries over closed facts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..language.ast import Program, Query
from ..plans import bodies
from ..plans.analysis import needed
from .fixpoint import Closure


def solve(closed: Closure, query: Query, distinct: bool = True, ordered: bool = False) -> DataFrame:
    """A row for each answer, a column for each selected variable, named without its question mark.

    ``distinct=False`` gives one row for each binding of the body; ``ordered``
    sorts the rows by the columns.
    """
    rows = bodies.body(query.positive, query.negative, closed.relation, closed.relation, closed.any_value)
    rows = rows.select(*bodies.answers(query.select))
    if distinct:
        rows = rows.distinct()
    return rows.orderBy(*rows.columns) if ordered else rows


def ad_hoc(closed: Closure, text: str, relations: list[str]) -> DataFrame:
    """Spark SQL over relations, each under its own name (dots as underscores) with subject, object, attrs."""
    tables = {name.replace(".", "_"): closed.relation(name).select("subject", "object", "attrs") for name in relations}
    return closed.facts.sparkSession.sql(text.format_map({k: f"{{{k}}}" for k in tables}), **tables)


def answer(program: Program, facts: DataFrame, name: str, distinct: bool = True, ordered: bool = False, **options) -> DataFrame:
    """A query of a program over facts in a table; only rules that can matter to it are evaluated."""
    query = program.query(name)
    rules = needed(program.all_rules(), {a.relation for a in (*query.positive, *query.negative)})
    return solve(Closure(facts, rules, **options), query, distinct, ordered)
