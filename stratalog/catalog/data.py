"""Facts, logs and other inputs made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as T
from ..language.names import relation_name as rel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """in_region of nations, in_nation of customers and suppliers."""
    nation, customer, supplier = (table(spark, sf_dir, n) for n in ("nation", "customer", "supplier"))
    return T.union([
        T.relationalise(nation, T.node("nation", F.col("n_nationkey")), rel("in_region"), T.node("region", F.col("n_regionkey"))),
        T.relationalise(customer, T.node("customer", F.col("c_custkey")), rel("in_nation"), T.node("nation", F.col("c_nationkey"))),
        T.relationalise(supplier, T.node("supplier", F.col("s_suppkey")), rel("in_nation"), T.node("nation", F.col("s_nationkey"))),
    ])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placed_by, status and priority of orders."""
    o = table(spark, sf_dir, "orders")
    order = T.node("order", F.col("o_orderkey"))
    return T.union([
        T.relationalise(o, order, rel("placed_by"), T.node("customer", F.col("o_custkey"))),
        T.relationalise(o, order, rel("status"), F.concat(F.lit("value."), F.col("o_orderstatus"))),
    ])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contains of orders, with the returnflag as text, the line as a number and the supplier as a name."""
    i = table(spark, sf_dir, "lineitem")
    attrs = {"returnflag": T.text(F.col("l_returnflag")), "linenumber": T.integer(F.col("l_linenumber")), "supplier": T.name(T.node("supplier", F.col("l_suppkey")))}
    return T.relationalise(i, T.node("order", F.col("l_orderkey")), rel("contains"), T.node("part", F.col("l_partkey")), attrs)


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.union([places(spark, sf_dir), orders(spark, sf_dir), lines(spark, sf_dir)])


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """before from each turn of a conversation to the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn")).withColumn("has_next", F.lit(True))
    name = lambda turn: F.concat(F.lit("turn.n"), F.col("conv_id").cast("string"), F.lit(".n"), turn.cast("string"))
    return T.relationalise(c.join(nxt, ["conv_id", "turn"]), name(F.col("turn")), rel("follows"), name(F.col("turn") + 1))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of each user's state; an error retracts it."""
    e = table(spark, sf_dir, "events")
    attrs = {"type": T.text(F.col("event_type")), "value": T.decimal(F.col("value"))}
    table_ = F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v)])
    return e.select(
        T.node("user", F.col("user_id")).alias("subject"), F.lit(rel("state")).alias("relation"), F.lit("value.current").alias("object"), table_.alias("attrs"), T.key_of(table_).alias("attrs_key"),
        F.col("event_id").alias("revision"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event"), F.when(F.col("event_type") == "error", "retract").otherwise("assert").alias("op"),
    )


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """depends_on between parts: a forest by halving the key, and short cycles among the first of every hundred."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    tree = T.relationalise(p.where("k >= 2"), T.node("part", F.col("k")), rel("depends_on"), T.node("part", F.floor(F.col("k") / 2)))
    odd = T.relationalise(p.where("k % 100 in (1, 2, 3) and k > 100"), T.node("ring", F.col("k")), rel("uses"), T.node("ring", F.when(F.col("k") % 100 == 3, F.col("k") - 2).otherwise(F.col("k") + 1)))
    return tree.unionByName(odd)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON records."""
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("metric"), F.col("value").alias("value"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.col("user_id").alias("user_id"), F.col("event_type").alias("kind_of")))
    return e.select(F.col("event_id").alias("record_no"), body.alias("body"))
