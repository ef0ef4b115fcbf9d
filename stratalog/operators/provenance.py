"""Why a fact holds: a numbered trace of the closure, with the first witness of every fact.

Rules are applied one after another, each to all facts found so far, round by
round in each stratum.  Among a rule's witnesses for a new fact the first counts,
by the numbers of its premises; new facts are numbered in that order.  Numbers
are therefore the same on every run.  From its second application on, a rule
only looks at witnesses with a premise found since its last one: any other would
have given its fact before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as T
from ..language.ast import Atom, Query, Rule
from ..language.names import attrs_key
from ..plans import bodies
from ..plans.analysis import stratify
from ..storage import materialise
from .ordering import number_rows

TRACE = "id bigint, stratum int, subject string, relation string, object string, attrs map<string,string>, attrs_key string, origin string, rule string, premise_ids array<bigint>, negative_checks array<string>, binding map<string,string>"


def _witnesses(rule: Rule | Query, trace: DataFrame, against: DataFrame) -> DataFrame:
    """Bindings of a body with the numbers of the facts they use, in the order of the premises."""
    rows = None
    for i, atom in enumerate(rule.positive):
        found = bodies.scan(atom, trace.where(F.col("relation") == atom.relation), extra={"id": f"p{i}"})
        rows = bodies.join(rows, found)
    for atom in rule.negative:
        rows = bodies.join(rows, bodies.scan(atom, against.where(F.col("relation") == atom.relation)).distinct(), "left_anti")
    names = [v for v in dict.fromkeys(v for a in rule.positive for v in a.variables())]
    binding = F.create_map(*[x for v in names for x in (F.lit(v[1:]), F.col(bodies.column(v)))]) if names else F.expr(T.NO_ATTRS)
    return rows.withColumns({"premise_ids": F.array(*[f"p{i}" for i in range(len(rule.positive))]), "binding": binding})


def _ground_text(atom: Atom):
    parts = [bodies.value_of(atom.subject), F.lit(f"#{atom.relation}@"), bodies.value_of(atom.object)]
    return F.concat(*parts)


def trace(facts: DataFrame, rules: list[Rule], order: list | None = None, max_rounds: int | None = None) -> DataFrame:
    """The closed facts with ``id``, stratum, origin (base or rule), rule, premise_ids, negative_checks and binding.

    Base facts are numbered by ``order`` (their text unless given), from 0.
    """
    strata = stratify(rules)
    base = number_rows(T.distinct(facts.select(*T.COLUMNS)), order or [*T.KEY])
    none = F.lit(None)
    known = materialise(base.select("id", F.lit(0).alias("stratum"), *T.COLUMNS, F.lit("base").alias("origin"), none.cast("string").alias("rule"), none.cast("array<bigint>").alias("premise_ids"), none.cast("array<string>").alias("negative_checks"), none.cast("map<string,string>").alias("binding")), "trace")
    size = known.count()
    for level in range(max(strata.values(), default=0) + 1):
        mine = [r for r in rules if strata[r.head.relation] == level]
        entry, since, rounds = known, dict.fromkeys(range(len(mine)), -1), 0
        while mine:
            if max_rounds is not None and rounds >= max_rounds:
                break
            grown = False
            for k, rule in enumerate(mine):
                if since[k] == size:
                    continue
                rows = _witnesses(rule, known, entry)
                if since[k] >= 0:
                    rows = rows.where(F.array_max("premise_ids") >= F.lit(since[k]))
                checks = F.array(*[_ground_text(a) for a in rule.negative]) if rule.negative else F.array().cast("array<string>")
                rows = rows.withColumn("negative_checks", checks)
                made = rows.select("premise_ids", "negative_checks", "binding", *[e.alias(n) for n, e in _head_columns(rule)])
                fresh = made.join(known.select(*T.KEY), T.KEY, "left_anti")
                first = Window.partitionBy(*T.KEY).orderBy("premise_ids")
                fresh = fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
                since[k] = size
                numbered = number_rows(fresh, ["premise_ids", *T.KEY], first=size)
                n = numbered.count()
                if n:
                    more = numbered.select("id", F.lit(level).alias("stratum"), *T.COLUMNS, F.lit("rule").alias("origin"), F.lit(rule.name).alias("rule"), "premise_ids", "negative_checks", "binding")
                    known = materialise(known.unionByName(more), "trace")
                    size += n
                    grown = True
            rounds += 1
            if not grown:
                break
    return known


def _head_columns(rule: Rule):
    pairs = {k: bodies.value_of(v, attribute=True) for k, v in rule.head.attrs}
    attrs = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]) if pairs else F.expr(T.NO_ATTRS)
    return [("subject", bodies.value_of(rule.head.subject)), ("relation", F.lit(rule.head.relation)), ("object", bodies.value_of(rule.head.object)), ("attrs", attrs), ("attrs_key", T.key_of_pairs(pairs))]


def query_witnesses(traced: DataFrame, query: Query) -> DataFrame:
    """The selected variables and premise_ids of every witness of a query's answers."""
    rows = _witnesses(query, traced, traced)
    return rows.select(*bodies.answers(query.select), "premise_ids")


def explain(traced: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (subject, relation, object, attrs_key) with present, source (base, rule or none) and id."""
    found = targets.join(traced.select(*T.KEY, "id", "origin"), T.KEY, "left")
    return found.select(*T.KEY, F.col("id").isNotNull().alias("present"), F.coalesce("origin", F.lit("none")).alias("source"), "id")


def explain_fact(traced: DataFrame, target: Atom) -> DataFrame:
    spark = traced.sparkSession
    row = spark.createDataFrame([(target.subject, target.relation, target.object, attrs_key(dict(target.attrs)))], "subject string, relation string, object string, attrs_key string")
    return explain(traced, row)


def support(traced: DataFrame, ids: DataFrame) -> DataFrame:
    """id, premise: the edges of the derivations of some facts (column id) down to base facts."""
    edges = traced.where("origin = 'rule'").select("id", F.explode("premise_ids").alias("premise"))
    seen = frontier = materialise(ids.select("id").distinct(), "support")
    while True:
        frontier = edges.join(frontier, "id").select(F.col("premise").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = materialise(frontier, "support")
        if frontier.isEmpty():
            return edges.join(seen, "id", "left_semi").distinct()
        seen = materialise(seen.unionByName(frontier), "support")


def report(traced: DataFrame) -> DataFrame:
    """One line a fact, tab-separated, with its number."""
    none = F.lit("-")
    line = F.concat_ws("\t", F.lit("fact"), F.col("id").cast("string"), F.col("stratum").cast("string"), "subject", "relation", "object", "attrs_key", "origin", F.coalesce("rule", none), F.coalesce(F.concat_ws(",", "premise_ids"), none), F.coalesce(F.concat_ws(",", "negative_checks"), none))
    return traced.select("id", line.alias("line"))
