"""Closure of facts under rules: the stratified least fixpoint.

Relations are evaluated in the order of their dependencies, one strongly
connected component at a time, so negated relations are complete when they are
read.  A component without recursion is one lazy plan and costs no job of its
own, unless several atoms read it and would plan it as often: where that makes
plans large (``plan_atoms``), it is written once, so the plans of a program grow
with its rules and not with the ways through them.  A recursive one is evaluated semi-naively: a round joins what is new with
everything known, drops what is known already and writes what is left as one
more piece of the component's table.  Pieces are read back as one Parquet
relation, so plans do not grow from round to round, and a lost executor costs
at most the round in flight.

A linear transitive closure is evaluated by doubling, in a number of rounds
logarithmic in the longest path.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as T
from ..language.ast import Atom, Rule, is_variable
from ..plans import bodies
from ..plans.analysis import Component, components, stratify
from ..storage import materialise, scratch


class RoundLimit(RuntimeError):
    """The fixpoint was not reached within ``max_rounds``."""


class Closure:
    """Facts by relation, closed under rules.

    ``max_rounds`` limits the rounds of a component: it raises RoundLimit, or
    with ``truncate`` stops there with what it has.  A relation without
    recursion is written once if the atoms that its readers would plan for it
    are more than ``plan_atoms``.
    """

    def __init__(self, facts: DataFrame, rules: list[Rule], max_rounds: int | None = None, truncate: bool = False, any_value: bool = False, doubling: bool = True, plan_atoms: int = 8):
        stratify(rules)
        self.facts, self.rules = facts.select(*T.COLUMNS), rules
        self.max_rounds, self.truncate, self.any_value, self.doubling = max_rounds, truncate, any_value, doubling
        self.derived: dict[str, DataFrame] = {}
        self.rounds: dict[str, int] = {}
        self.plan_atoms, self.atoms = plan_atoms, {}
        self.readers = Counter(a.relation for r in rules for a in (*r.positive, *r.negative))
        for part in components(rules):
            if part.recursive:
                self._recursive(part)
            else:
                self._once(part)

    def relation(self, name: str) -> DataFrame:
        """All facts of a relation."""
        return self.derived[name] if name in self.derived else self.base(name)

    def base(self, name: str) -> DataFrame:
        return self.facts.where(F.col("relation") == name)

    def all(self) -> DataFrame:
        """All facts, each once."""
        rest = self.facts.where(~F.col("relation").isin(list(self.derived))) if self.derived else self.facts
        return T.union([T.distinct(rest), *self.derived.values()])

    def _apply(self, rule: Rule, of) -> DataFrame:
        return bodies.head(rule.head, bodies.body(rule.positive, rule.negative, of, self.relation, self.any_value))

    def _once(self, part: Component) -> None:
        name = part.relations[0]
        made = [self._apply(r, self.relation) for r in part.rules]
        rows = T.distinct(T.union([self.base(name), *made]))
        size = 1 + sum(self.atoms.get(a.relation, 1) for r in part.rules for a in (*r.positive, *r.negative))
        if self.readers[name] > 1 and size * self.readers[name] > self.plan_atoms:
            rows, size = materialise(rows, "relation"), 1
        self.derived[name], self.atoms[name] = rows, size

    def _recursive(self, part: Component) -> None:
        spark = self.facts.sparkSession
        rules = as_doubling(part) if self.doubling else part.rules
        root = scratch(spark, "closure")
        inside = set(part.relations)

        def write(rows: DataFrame, n: int) -> DataFrame:
            rows.write.option("compression", "zstd").parquet(f"{root}/round={n}")
            return spark.read.schema(T.FACT_SCHEMA).parquet(f"{root}/round={n}")

        def known() -> DataFrame:
            return spark.read.schema(T.FACT_SCHEMA).parquet(*[f"{root}/round={i}" for i in range(n + 1)])

        # what the component's relations have from the start and from rules that do not look inside it
        start = [self.facts.where(F.col("relation").isin(part.relations))]
        start += [self._apply(r, self.relation) for r in rules if not any(a.relation in inside for a in r.positive)]
        looping = [r for r in rules if any(a.relation in inside for a in r.positive)]
        n = 0
        delta = write(T.distinct(T.union(start)), 0)
        while not delta.isEmpty():
            if self.max_rounds is not None and n >= self.max_rounds:
                if self.truncate:
                    break
                raise RoundLimit(f"no fixpoint after {n} rounds for {', '.join(part.relations)}")
            full, made = known(), []
            for r in looping:
                places = [i for i, a in enumerate(r.positive) if a.relation in inside]
                for i in places:
                    tables = [(delta if j == i else full).where(F.col("relation") == a.relation) if a.relation in inside else self.relation(a.relation) for j, a in enumerate(r.positive)]
                    made.append(self._apply(r, tables))
            fresh = T.distinct(T.union(made)).join(full.select(*T.KEY), T.KEY, "left_anti")
            n += 1
            delta = write(fresh.select(*T.COLUMNS), n)
        full = known()
        for name in part.relations:
            self.derived[name] = full.where(F.col("relation") == name)
        self.rounds[", ".join(part.relations)] = n


def as_doubling(part: Component) -> list[Rule]:
    """The component's rules; in a transitive closure the linear step is replaced by joining the closure with itself.

    The shape: one relation r, ``e(x,y) => r(x,y)``, and ``e(x,y), r(y,z) =>
    r(x,z)`` or ``r(x,y), e(y,z) => r(x,z)``, without attributes or negation.
    """
    if len(part.relations) != 1 or len(part.rules) != 2:
        return part.rules
    r = part.relations[0]
    step = next((x for x in part.rules if any(a.relation == r for a in x.positive)), None)
    copy = next((x for x in part.rules if x is not step), None)
    if step is None or copy is None or len(copy.positive) != 1 or len(step.positive) != 2 or any(x.negative for x in part.rules):
        return part.rules
    edge = copy.positive[0].relation
    atoms = [copy.head, *copy.positive, step.head, *step.positive]
    if any(a.attrs for a in atoms) or edge == r or {a.relation for a in step.positive} != {edge, r}:
        return part.rules
    if (copy.head.subject, copy.head.object) != (copy.positive[0].subject, copy.positive[0].object) or copy.head.subject == copy.head.object:
        return part.rules
    first, second = step.positive
    if first.object != second.subject:
        first, second = second, first
    x, y, z = first.subject, first.object, second.object
    if len({x, y, z}) != 3 or not all(map(is_variable, (x, y, z))) or second.subject != y or (step.head.subject, step.head.object) != (x, z):
        return part.rules
    return [copy, replace(step, positive=(Atom(x, r, y), Atom(y, r, z)))]


def closure(facts: DataFrame, rules: list[Rule], **options) -> DataFrame:
    """All facts that follow, each once; raises ValueError if the rules are not stratifiable."""
    return Closure(facts, rules, **options).all()


def closure_or_input(facts: DataFrame, rules: list[Rule], **options) -> DataFrame:
    """The same, but the facts themselves if the rules are not stratifiable."""
    try:
        return closure(facts, rules, **options)
    except ValueError:
        return facts.select(*T.COLUMNS)


def entails(facts: DataFrame, rules: list[Rule], target: Atom, **options) -> bool:
    """Does a ground fact follow?  Only rules that can matter to its relation are evaluated."""
    from ..language.names import attrs_key
    from ..plans.analysis import needed

    found = Closure(facts, needed(rules, {target.relation}), **options).relation(target.relation)
    return not found.where((F.col("subject") == target.subject) & (F.col("object") == target.object) & (F.col("attrs_key") == attrs_key(dict(target.attrs)))).isEmpty()
