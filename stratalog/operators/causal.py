"""Causal order of events: happens-before edges (left, right), and clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clocks
from .impact import cyclic_nodes, reachable


def before(edges: DataFrame, doubling: bool = True) -> DataFrame:
    """left, right: the transitive closure of the edges."""
    return reachable(edges.select(F.col("left").alias("a"), F.col("right").alias("b")), doubling).withColumnsRenamed({"a": "left", "b": "right"})


def events(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("left", "right")).alias("event")).distinct()


def concurrent(order: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (left, right) of different events that are not ordered either way; ``order`` is closed."""
    key = ["left", "right"]
    rows = pairs.select(*key).where("left <> right").distinct().join(order, key, "left_anti")
    return rows.join(order.select(F.col("right").alias("left"), F.col("left").alias("right")), key, "left_anti")


def concurrent_within(order: DataFrame, members: DataFrame, by: str) -> DataFrame:
    """Concurrent pairs left < right of events that share the value of column ``by`` (members: event, by)."""
    a, b = members.select(F.col(by), F.col("event").alias("left")), members.select(F.col(by), F.col("event").alias("right"))
    return concurrent(order, a.join(b, by).where("left < right"))


def invalid_edges(edges: DataFrame) -> DataFrame:
    """kind, detail: self edges and events on cycles."""
    loops = edges.where("left = right").select(F.lit("self_edge").alias("kind"), F.col("left").alias("detail")).distinct()
    found = cyclic_nodes(edges.where("left <> right").select(F.col("left").alias("dependent"), F.col("right").alias("dependency")))
    return loops.unionByName(found.select(F.lit("cycle").alias("kind"), F.col("node").alias("detail")))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """The edges with more of them; raises if that makes a cycle."""
    out = edges.select("left", "right").unionByName(more.select("left", "right")).distinct()
    if not invalid_edges(out).isEmpty():
        raise ValueError("the edges would form a cycle")
    return out


def edges_of_vector_clocks(clocked: DataFrame, within: str | None = None) -> DataFrame:
    """left, right: events (event, vector) whose clocks are ordered.

    Clocks are only comparable above zero where they share an actor: if l is
    before r, every actor of l has a counter in r.  So candidates meet on the
    first actor of l, not as all pairs.  A clock without counters is before
    every other; those few are met by all.  ``within`` restricts pairs to equal
    values of a column.
    """
    keys = ["__actor"] + ([within] if within else [])
    extra = [within] if within else []
    counted = F.map_filter("vector", lambda _, v: v > 0)
    rows = clocked.select("event", counted.alias("vector"), *extra)
    left = rows.where(F.size("vector") > 0).select(F.col("event").alias("left"), F.col("vector").alias("l"), F.array_min(F.map_keys("vector")).alias("__actor"), *extra)
    right = rows.select(F.col("event").alias("right"), F.col("vector").alias("r"), F.explode(F.map_keys("vector")).alias("__actor"), *extra)
    found = left.join(right, keys).where(clocks.vector_before(F.col("l"), F.col("r"))).select("left", "right")
    zero = rows.where(F.size("vector") == 0).select(F.col("event").alias("left"), *extra)
    above = rows.where(F.size("vector") > 0).select(F.col("event").alias("right"), *extra)
    below_all = zero.join(above, within) if within else zero.crossJoin(above)
    return found.unionByName(below_all.select("left", "right")).distinct()


def inconsistent(order: DataFrame, clocked: DataFrame, kind: str) -> DataFrame:
    """Ordered pairs that a clock does not order: vector, lamport or hybrid is the column and the kind of clock."""
    test = {"vector": clocks.vector_before, "lamport": clocks.lamport_before, "hybrid": clocks.hybrid_before}[kind]
    a = clocked.select(F.col("event").alias("left"), F.col(kind).alias("l"))
    b = clocked.select(F.col("event").alias("right"), F.col(kind).alias("r"))
    return order.join(a, "left").join(b, "right").where(~F.coalesce(test(F.col("l"), F.col("r")), F.lit(True))).select("left", "right")
