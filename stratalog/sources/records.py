"""Facts from records: envelopes, metric observations, vector clocks, fields; and causal edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts as T
from ..language.names import NAMESPACE, node_name
from ..operators.causal import edges_of_vector_clocks

#: Fields that are not facts of their own.
RESERVED = ["metric", "value", "metrics", "before", "vector_clock", "event_id", "event-id"]


def relation_column(key: Column) -> Column:
    """The column form of ``relation_name``."""
    words = F.split(F.replace(key, F.lit("_"), F.lit("-")), "-")
    return F.concat(F.lit(f"{NAMESPACE}."), F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.initcap(F.lower(w)))), ""))


def clean_column(text: Column) -> Column:
    """The column form of ``clean``: text as part of a name."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, "[:/]", "."), "[ -]", "_"), F.lit('"'), F.lit(""))


def node_column(token: Column) -> Column:
    """The column form of ``node_name``: segments that begin with a digit get a letter."""
    parts = F.split(F.regexp_replace(F.replace(F.trim(token), F.lit("-"), F.lit("_")), "[:/]", "."), r"\.")
    return F.array_join(F.transform(parts, lambda p, i: F.when(p.rlike("^[0-9]"), F.concat(F.when((i > 0) & (F.get(parts, i - 1) == "user"), F.lit("u")).otherwise(F.lit("n")), p)).otherwise(p)), ".")


def event_of(body: Column) -> Column:
    """The event that a record names, as a name; null without one."""
    raw = F.coalesce(F.get_json_object(body, "$.event_id"), F.get_json_object(body, "$['event-id']"), F.get_json_object(body, "$.event"))
    return F.when(F.length(F.trim(raw)) > 0, F.regexp_replace(F.trim(raw), r"[^A-Za-z0-9_:\-.]", "_"))


def fields(records: DataFrame) -> DataFrame:
    """record_no, event, key, value (text), kind: the top-level fields of each record that are scalars."""
    rows = records.select("record_no", event_of(F.col("body")).alias("event"), F.try_parse_json("body").alias("v"))
    spark = records.sparkSession
    each = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("record_no", "event", "key", F.col("value").alias("x"))
    each = each.withColumns({"kind": F.schema_of_variant("x"), "value": F.try_variant_get("x", "$", "string")})
    return each.where("key is not null and value is not null").where(~F.col("kind").rlike("^(OBJECT|ARRAY|VOID)")).drop("x")


def encoded(value: Column, kind: Column) -> Column:
    """A JSON scalar as an encoded attribute."""
    prefix = F.when(kind == "BOOLEAN", "b:").when(kind == "BIGINT", "i:").when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "d:").otherwise("s:")
    return F.concat(prefix, value)


def to_facts(records: DataFrame, source: str, ingested: int) -> DataFrame:
    """Facts of a source's records, with the event that a record names: the columns of facts and ``event``.

    ``ingested`` is the time of reading, in ms; it goes into each fact's attributes.
    """
    me = F.lit(node_name(source))
    at = T.integer(F.lit(ingested))

    def made(rows: DataFrame, subject: Column, relation: Column, obj: Column, attrs: dict[str, Column]) -> DataFrame:
        pairs = {**attrs, "ingest_ts": at}
        table = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()]), lambda e: e["value"].isNotNull()))
        return rows.select(subject.alias("subject"), relation.alias("relation"), obj.alias("object"), table.alias("attrs"), T.key_of(table).alias("attrs_key"), "event").where("subject is not null and object is not null")

    rows = records.withColumn("event", event_of(F.col("body")))
    lit = lambda name: F.lit(f"{NAMESPACE}.{name}")
    envelope = made(rows, me, lit("ingestedRecord"), F.lit("value.record"), {"payload": T.text(F.col("body"))})
    one = fields(records)
    metric = rows.withColumn("m", F.get_json_object("body", "$.metric"))
    value = one.where("key = 'value'").select("record_no", encoded(F.col("value"), F.col("kind")).alias("v"))
    single = made(metric.where("m is not null").join(value, "record_no"), F.concat(F.lit("metric."), clean_column(F.col("m"))), lit("observedFrom"), me, {"value": F.col("v")})
    several = rows.where(F.get_json_object("body", "$.metric").isNull()).select("record_no", "event", F.explode(F.from_json(F.get_json_object("body", "$.metrics"), "map<string,string>")).alias("m", "x"))
    number = F.when(F.col("x").rlike(r"^-?\d+$"), F.concat(F.lit("i:"), "x")).when(F.col("x").rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), F.concat(F.lit("d:"), "x")).when(F.col("x").isin("true", "false"), F.concat(F.lit("b:"), "x")).otherwise(F.concat(F.lit("s:"), "x"))
    several = made(several, F.concat(F.lit("metric."), clean_column(F.col("m"))), lit("observedFrom"), me, {"value": number})
    clocks = vector_clocks(records).select("event", F.explode("vector").alias("actor", "counter"))
    components = made(clocks, node_column(F.col("event")), lit("vcComponent"), F.concat(F.lit("actor."), clean_column(F.col("actor"))), {"counter": T.integer(F.col("counter"))})
    rest = one.where(~F.col("key").isin(RESERVED))
    scalars = made(rest, me, relation_column(F.col("key")), F.concat(F.lit("value."), clean_column(F.col("value"))), {})
    return T.union([envelope, single, several, components, scalars])


def vector_clocks(records: DataFrame) -> DataFrame:
    """event and vector of the records that have both."""
    vector = F.from_json(F.get_json_object("body", "$.vector_clock"), "map<string,bigint>")
    return records.select(event_of(F.col("body")).alias("event"), vector.alias("vector")).where("event is not null and vector is not null")


def explicit_edges(records: DataFrame) -> DataFrame:
    """left, right: what each record says it comes after."""
    lefts = F.from_json(F.get_json_object("body", "$.before"), "array<string>")
    return records.select(F.explode(lefts).alias("left"), event_of(F.col("body")).alias("right")).where("right is not null and left is not null and trim(left) <> ''").select(F.regexp_replace(F.trim("left"), r"[^A-Za-z0-9_:\-.]", "_").alias("left"), "right")


def edges(records: DataFrame) -> DataFrame:
    """Explicit edges and those that vector clocks give, each once."""
    return explicit_edges(records).unionByName(edges_of_vector_clocks(vector_clocks(records))).distinct()


def ingest(records: DataFrame, source: str, ingested: int, revision: int | None = None, event: str | None = None) -> DataFrame:
    """Facts of records as a log: facts, revision, event and op."""
    facts = to_facts(records, source, ingested)
    named = F.lit(event or f"ingest_{source.replace(':', '_')}")
    return facts.select(*T.COLUMNS, F.lit(ingested if revision is None else revision).cast("bigint").alias("revision"), F.coalesce("event", named).alias("event"), F.lit("assert").alias("op"))


def import_rows(records: DataFrame, prefix: str = "row") -> DataFrame:
    """``prefix.n<k>#field@value.<text>`` for each field of each record, k from 0 in the records' order."""
    from ..operators.ordering import number_rows

    numbered = number_rows(records, ["record_no", "body"], "k")
    each = fields(numbered.select(F.col("k").alias("record_no"), "body"))
    return T.relationalise_columns(each, F.concat(F.lit(f"{node_name(prefix)}.n"), F.col("record_no").cast("string")), relation_column(F.col("key")), F.concat(F.lit("value."), clean_column(F.col("value"))))
