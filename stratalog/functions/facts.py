"""Fact tables: their schema, attributes as columns, and facts from rows of other tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..language.ast import Atom
from ..language.names import ESCAPES, attrs_key

#: ``attrs`` holds encoded values; ``attrs_key`` is their canonical text, which is what joins and grouping use.
FACT_SCHEMA = "subject string, relation string, object string, attrs map<string,string>, attrs_key string"
COLUMNS = ["subject", "relation", "object", "attrs", "attrs_key"]
KEY = ["subject", "relation", "object", "attrs_key"]
NO_ATTRS = "cast(map() as map<string,string>)"


def from_atoms(spark: SparkSession, atoms: list[Atom]) -> DataFrame:
    rows = [(a.subject, a.relation, a.object, dict(a.attrs), attrs_key(dict(a.attrs))) for a in atoms]
    return spark.createDataFrame(rows, FACT_SCHEMA)


def escaped(value: Column) -> Column:
    """Text with the characters escaped that separate attributes."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES.items(), value)


def _escaped_value(encoded: Column) -> Column:
    return F.concat(F.substring(encoded, 1, 2), escaped(F.substring(encoded, 3, 1 << 30)))


def key_of(attrs: Column) -> Column:
    """Canonical text of an attribute map; null and empty maps give ''."""
    pairs = F.transform(F.map_entries(attrs), lambda e: F.concat(escaped(e["key"]), F.lit("="), _escaped_value(e["value"])))
    return F.coalesce(F.array_join(F.array_sort(pairs), ";"), F.lit(""))


def key_of_pairs(pairs: dict[str, Column]) -> Column:
    """The same for attributes with known keys."""
    parts = [F.concat(F.lit("".join(ESCAPES.get(c, c) for c in k) + "="), _escaped_value(v)) for k, v in sorted(pairs.items())]
    return F.concat_ws(";", *parts) if parts else F.lit("")


def node(prefix: str, key: Column) -> Column:
    """``prefix.n<key>``: the name of a row of a table with a numeric key."""
    return F.concat(F.lit(f"{prefix}.{'u' if prefix == 'user' else 'n'}"), key.cast("string"))


def text(value: Column) -> Column:
    return F.concat(F.lit("s:"), value.cast("string"))


def integer(value: Column) -> Column:
    return F.concat(F.lit("i:"), value.cast("string"))


def decimal(value: Column) -> Column:
    return F.concat(F.lit("d:"), value.cast("string"))


def boolean(value: Column) -> Column:
    return F.concat(F.lit("b:"), value.cast("string"))


def name(value: Column) -> Column:
    return F.concat(F.lit("n:"), value)


def relationalise(rows: DataFrame, subject: Column, relation: str, obj: Column, attrs: dict[str, Column] | None = None) -> DataFrame:
    """One fact for each row; rows without subject or object give none, null attributes are left out."""
    pairs = attrs or {}
    if pairs:
        entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()]), lambda e: e["value"].isNotNull())
        table = F.map_from_entries(entries)
        key = key_of(table)
    else:
        table, key = F.expr(NO_ATTRS), F.lit("")
    out = rows.select(subject.alias("subject"), F.lit(relation).alias("relation"), obj.alias("object"), table.alias("attrs"), key.alias("attrs_key"))
    return out.where("subject is not null and object is not null")


def typed(attrs: Column, key: str, kind: str) -> Column:
    """An attribute as a typed column; null if it is absent or of another kind."""
    value = F.get(F.array(attrs[key]), F.lit(0))
    prefix, cast = {"text": ("s:", "string"), "integer": ("i:", "decimal(38,0)"), "decimal": ("d:", "double"), "boolean": ("b:", "boolean"), "name": ("n:", "string")}[kind]
    return F.when(value.startswith(prefix), F.substring(value, 3, 1 << 30).try_cast(cast))


def distinct(facts: DataFrame) -> DataFrame:
    return facts.dropDuplicates(KEY)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FACT_SCHEMA)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def relationalise_columns(rows: DataFrame, subject: Column, relation: Column, obj: Column) -> DataFrame:
    """One fact without attributes for each row, its relation from a column."""
    return rows.select(subject.alias("subject"), relation.alias("relation"), obj.alias("object"), F.expr(NO_ATTRS).alias("attrs"), F.lit("").alias("attrs_key")).where("subject is not null and relation is not null and object is not null")
