"""Dependency graphs of closed facts: neighbours, cycles, and what a change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..language.names import NAMESPACE
from ..storage import materialise, scratch
from .ordering import number_rows

#: Fixed value: relations whose subject depends on their object.
POLICY = [f"{NAMESPACE}.{r}" for r in ("dependsOn", "uses", "requires", "validates", "implements", "formalizes", "supports")]


def graph(facts: DataFrame, policy: list[str] = POLICY) -> DataFrame:
    """dependent, dependency, relation, fact_id; ``facts`` may have ids (of a trace), else the key stands for them."""
    number = F.col("id").cast("string") if "id" in facts.columns else F.concat_ws("|", "subject", "relation", "object", "attrs_key")
    return facts.where(F.col("relation").isin(policy)).select(F.col("subject").alias("dependent"), F.col("object").alias("dependency"), "relation", number.alias("fact_id"))


def ordered(edges: DataFrame) -> DataFrame:
    return edges.orderBy("dependency", "dependent", "relation", "fact_id")


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dependent") == node)


def reverse(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dependency") == node)


def reachable(edges: DataFrame, doubling: bool = True) -> DataFrame:
    """a, b: pairs with a path of at least one edge (columns a, b)."""
    total = materialise(edges.select("a", "b").distinct(), "paths")
    delta = total
    while not delta.isEmpty():
        step = total if doubling else edges.select("a", "b").distinct()
        onward = lambda df: df.select(F.col("a").alias("b"), F.col("b").alias("c"))
        made = delta.join(onward(step), "b").select("a", F.col("c").alias("b"))
        if doubling:
            made = made.unionByName(total.join(onward(delta), "b").select("a", F.col("c").alias("b")))
        delta = materialise(made.distinct().join(total, ["a", "b"], "left_anti"), "paths")
        total = materialise(total.unionByName(delta), "paths")
    return total


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a directed cycle, self loops included (column node).

    Nodes without incoming or without outgoing edges are on no cycle; they are
    peeled off first, so only what is left is closed.
    """
    rest = materialise(edges.select(F.col("dependent").alias("a"), F.col("dependency").alias("b")).distinct(), "cycle")
    size = rest.count()
    while True:
        less = rest.join(rest.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        less = less.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
        less = materialise(less, "cycle")
        n = less.count()
        rest = less
        if n == size:
            break
        size = n
    return reachable(rest).where("a = b").select(F.col("a").alias("node")).distinct()


STEP = "struct<dependent:string,dependency:string,relation:string>"


def impact(edges: DataFrame, changed: list[str] | DataFrame, max_depth: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """What depends on changed nodes: origin, node, distance, rank, path, kind (direct or transitive).

    Level by level against the edges, all origins together.  A node keeps one
    shortest path: through the parent met first, then by relation and fact;
    ``rank`` is the order of meeting, from 1.  ``path`` lists (dependent,
    dependency, relation) from the changed node outwards.

    Within a level nodes are met in the order of their parents and then by
    name, so the order of meeting is that of the names along the paths: parents
    are compared by those, and ranks are numbered once, at the end.  With
    ``max_depth`` or ``max_nodes`` (for each origin) what is beyond is left out:
    see ``bounded``.
    """
    spark = edges.sparkSession
    start = changed if isinstance(changed, DataFrame) else spark.createDataFrame([(c,) for c in dict.fromkeys(changed)], "node string")
    root = scratch(spark, "impact")
    edges = materialise(edges, "edges")
    names = F.transform("path", lambda p: p["dependent"])
    frontier = start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("distance"), F.array().cast(f"array<{STEP}>").alias("path")).distinct()
    frontier = materialise(frontier, "impact", f"{root}/level=0")
    schema, depth, left = frontier.schema, 0, max_nodes
    while max_depth is None or depth < max_depth:
        seen = spark.read.schema(schema).parquet(*[f"{root}/level={i}" for i in range(depth + 1)])
        depth += 1
        parents = frontier.select("origin", F.col("node").alias("dependency"), "path", names.alias("names"))
        met = parents.join(edges, "dependency").join(seen.select("origin", F.col("node").alias("dependent")), ["origin", "dependent"], "left_anti")
        best = met.groupBy("origin", "dependent").agg(F.min(F.struct("names", "relation", "fact_id", "dependency", "path")).alias("b"))
        step = F.struct("dependent", "b.dependency", "b.relation").cast(STEP)
        new = best.select("origin", F.col("dependent").alias("node"), F.lit(depth).alias("distance"), F.concat("b.path", F.array(step)).alias("path"))
        if left is not None:  # the first ones of each origin, at most as many as are left
            place = F.row_number().over(Window.partitionBy("origin").orderBy(names))
            sizes = seen.groupBy("origin").agg((F.lit(left) + 1 - F.count("*")).alias("room"))
            new = new.withColumn("place", place).join(sizes, "origin").where("place <= room").drop("place", "room")
        frontier = materialise(new, "impact", f"{root}/level={depth}")
        if frontier.isEmpty():
            break
    found = spark.read.schema(schema).parquet(*[f"{root}/level={i}" for i in range(depth + 1)]).where("distance > 0")
    ranked = number_rows(found, ["origin", "distance", names], "rank")
    first = ranked.groupBy("origin").agg(F.min("rank").alias("first"))
    kind = F.when(F.col("distance") == 1, "direct").otherwise("transitive")
    return ranked.join(first, "origin").select("origin", "node", "distance", (F.col("rank") - F.col("first") + 1).alias("rank"), "path", kind.alias("kind"))


def known(edges: DataFrame, node: str) -> bool:
    """Is the node in the graph at all?"""
    return not edges.where((F.col("dependent") == node) | (F.col("dependency") == node)).isEmpty()


def bounded(edges: DataFrame, changed: list[str], max_depth: int = 8, max_nodes: int = 1000) -> tuple[DataFrame, bool]:
    """Impact within bounds over ``depends_on`` edges, and whether that is all there is."""
    own = edges.where(F.col("relation") == f"{NAMESPACE}.dependsOn")
    found = materialise(impact(own, changed, max_depth, max_nodes), "bounded")
    inside = found.select("origin", "node").unionByName(own.sparkSession.createDataFrame([(c, c) for c in changed], "origin string, node string"))
    beyond = inside.withColumnRenamed("node", "dependency").join(own, "dependency").join(inside.withColumnRenamed("node", "dependent"), ["origin", "dependent"], "left_anti")
    return found, beyond.isEmpty()


def report(found: DataFrame) -> DataFrame:
    path = F.concat_ws(" <- ", F.transform("path", lambda p: F.concat(p["dependent"], F.lit("#"), p["relation"])))
    return found.orderBy("origin", "rank").select(F.concat_ws("\t", F.lit("impact"), "origin", "node", "kind", F.col("distance").cast("string"), path).alias("line"))
