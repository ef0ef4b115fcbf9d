"""Decisions on access requests over closed facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as T
from ..language.ast import Atom, Rule
from ..language.names import attrs_key
from ..plans.analysis import needed
from .fixpoint import Closure


def decide(facts: DataFrame, rules: list[Rule], requests: DataFrame, relations: set[str] | None = None, closed: Closure | None = None, **options) -> DataFrame:
    """``requests`` (subject, relation, object, attrs_key) with decision (allow, deny), source (direct, derived, none) and candidate_rules.

    All requests are answered by two joins on the fact's key.  ``relations``,
    if given, are those that requests may name: only rules that can matter to
    them are evaluated, and others are denied unless stored.  Candidate rules
    are those with the relation in their head, by name, for derived facts.
    ``closed`` is the facts' closure where there is one already.
    """
    rules = needed(rules, relations) if relations else rules
    closed = closed or Closure(facts, rules, **options)
    asked = sorted(relations) if relations else sorted({r.head.relation for r in rules})
    made = T.union([closed.relation(n).select(*T.KEY) for n in asked]) if asked else T.empty(facts.sparkSession).select(*T.KEY)
    requests = requests.select(*T.KEY)
    # only stored facts that some request names are told apart
    base = facts.select(*T.KEY).join(requests.distinct(), T.KEY, "left_semi").distinct().withColumn("direct", F.lit(True))
    rows = requests.join(base, T.KEY, "left").join(made.distinct().withColumn("derived", F.lit(True)), T.KEY, "left")
    by_head: dict[str, list[str]] = {}
    for r in rules:
        by_head.setdefault(r.head.relation, []).append(r.name)
    names = F.create_map(*[x for k, v in by_head.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(set(v)))))]) if by_head else F.create_map().cast("map<string,array<string>>")
    source = F.when(F.col("direct"), "direct").when(F.col("derived"), "derived").otherwise("none")
    none = F.array().cast("array<string>")
    return rows.withColumn("source", source).select(*T.KEY, F.when(F.col("source") == "none", "deny").otherwise("allow").alias("decision"), "source", F.when(F.col("source") == "derived", F.coalesce(names[F.col("relation")], none)).otherwise(none).alias("candidate_rules"))


def decide_one(facts: DataFrame, rules: list[Rule], request: Atom, **options) -> dict:
    """The decision on one request, with the numbers of stored and closed facts."""
    row = facts.sparkSession.createDataFrame([(request.subject, request.relation, request.object, attrs_key(dict(request.attrs)))], "subject string, relation string, object string, attrs_key string")
    closed = Closure(facts, rules, **options)
    found = decide(facts, rules, row, closed=closed).first().asDict()
    return found | {"base_facts": T.distinct(facts).count(), "closed_facts": closed.all().count()}


def report(decisions: DataFrame) -> DataFrame:
    """One tab-separated line a decision."""
    return decisions.select(F.concat_ws("\t", F.lit("authorization"), "decision", "source", "subject", "relation", "object", "attrs_key", F.concat_ws(",", "candidate_rules")).alias("line"))
