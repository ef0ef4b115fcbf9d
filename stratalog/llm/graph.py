"""Connected components of an edge table, without collecting edges or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, tasks: int = 1 << 20) -> DataFrame:
    """node, root for every node of ``edges`` (columns a and b, bigint); root is the least node it reaches.

    Alternates two contractions until the edges form stars.  In the first every
    node hands its greater neighbours the least node it knows; in the second it
    does so for itself and its smaller neighbours.  The number of edges never
    grows and the rounds are logarithmic in the number of nodes.  A round reads
    a table that the round before has written, of as many files as its rows take,
    so a lost executor costs one round at most, and the minima are pre-aggregated, so a hub costs one row a
    task.  Self links and repeated rows are dropped; an empty table gives no rows.
    The first table is written by ``tasks`` tasks at most.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e.coalesce(tasks), "edges")
    files = e.count() // 200_000 + 1  # few edges are not written to as many files as there are tasks
    while True:
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "edges")
        heads = e.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        if heads.where("n > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
