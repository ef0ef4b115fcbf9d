"""Facts and rules that outlive a session: tables of a catalog, merged module by module."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import facts as T
from .language.ast import Atom, Rule
from .operators.fixpoint import Closure

RULES = "name string, body string, trust string"


def _text(r: Rule) -> str:
    atom = lambda a: [a.subject, a.relation, a.object, [list(p) for p in a.attrs]]
    return json.dumps({"positive": [atom(a) for a in r.positive], "negative": [atom(a) for a in r.negative], "head": atom(r.head)}, sort_keys=True)


def _rule(name: str, text: str, trust: str) -> Rule:
    atom = lambda x: Atom(x[0], x[1], x[2], tuple(tuple(p) for p in x[3]))
    d = json.loads(text)
    return Rule(name, tuple(map(atom, d["positive"])), tuple(map(atom, d["negative"])), atom(d["head"]), trust)


def save(spark: SparkSession, path: str, facts: DataFrame, rules: list[Rule], module: str) -> None:
    """A module's facts, partitioned by relation, and its rules; an earlier version of the module is replaced."""
    facts.select(*T.COLUMNS).write.mode("overwrite").partitionBy("relation").parquet(f"{path}/facts/module={module}")
    spark.createDataFrame([(r.name, _text(r), r.trust) for r in rules], RULES).coalesce(1).write.mode("overwrite").parquet(f"{path}/rules/module={module}")


def load(spark: SparkSession, path: str, modules: list[str]) -> tuple[DataFrame, list[Rule]]:
    """The merged facts and rules of modules, each fact and rule once."""
    facts = T.union([spark.read.schema(T.FACT_SCHEMA).parquet(f"{path}/facts/module={m}").select(*T.COLUMNS) for m in modules])
    rows = [r for m in modules for r in spark.read.schema(RULES).parquet(f"{path}/rules/module={m}").collect()]
    rules: dict[str, Rule] = {}
    for r in rows:
        rules.setdefault(r["body"], _rule(r["name"], r["body"], r["trust"]))
    return T.distinct(facts), list(rules.values())


def closure_of(spark: SparkSession, path: str, modules: list[str], **options) -> Closure:
    """The closure of saved modules; scans of one relation read its partition only."""
    facts, rules = load(spark, path, modules)
    return Closure(facts, rules, **options)


def statistics(facts: DataFrame) -> DataFrame:
    return facts.groupBy("relation").agg(F.count("*").alias("facts"), F.approx_count_distinct("subject").alias("subjects"), F.approx_count_distinct("object").alias("objects"))
