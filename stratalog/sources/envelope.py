"""A log of facts and its causal edges as lines of text, and back.

The first line is ``revisions <tab> 1``, the second ``module <tab> name``; then
come ``record <tab> revision <tab> event <tab> operation <tab> subject <tab>
relation <tab> object <tab> attributes`` and ``before <tab> event <tab> event``.
Tabs, line feeds and other marks in values are written as in canonical facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.facts import KEY, escaped
from ..operators.revision import problems
from .exports import facts_of_lines, plain

HEADER = "revisions\t1"


def lines_of(log: DataFrame, edges: DataFrame | None = None, module: str = "-") -> DataFrame:
    """place (0 for the header, 1 for the module, then 2 for records and 3 for edges) and line."""
    spark = log.sparkSession
    top = spark.createDataFrame([(0, HEADER), (1, f"module\t{module}")], "place int, line string")
    fields = [F.col("revision").cast("string"), escaped(F.col("event")), F.col("op"), *[escaped(F.col(c)) for c in KEY[:3]], F.col("attrs_key")]
    out = top.unionByName(log.select(F.lit(2).alias("place"), F.concat_ws("\t", F.lit("record"), *fields).alias("line")))
    if edges is not None:
        out = out.unionByName(edges.select(F.lit(3).alias("place"), F.concat_ws("\t", F.lit("before"), escaped(F.col("left")), escaped(F.col("right"))).alias("line")))
    return out


def odd_lines(lines: DataFrame) -> DataFrame:
    """Lines (place or not) that an envelope does not have: line, problem."""
    parts = F.split("line", "\t", -1)
    kind, size = F.get(parts, F.lit(0)), F.size(parts)
    problem = (
        F.when(F.col("line") == HEADER, F.lit(None)).when((kind == "module") & (size == 2), F.lit(None)).when((kind == "before") & (size == 3), F.lit(None))
        .when(kind != "record", "unknown-row").when(size != 8, "fields").when(~F.get(parts, F.lit(1)).rlike("^[0-9]+$"), "revision").when(~F.get(parts, F.lit(3)).isin("assert", "retract"), "operation")
    )
    return lines.select("line", problem.alias("problem")).where("line <> '' and problem is not null")


def read(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log and the edges (left, right) of an envelope's lines; raises if it is not sound."""
    if not odd_lines(lines).isEmpty() or lines.where(F.col("line") == HEADER).isEmpty():
        raise ValueError("not an envelope of revisions")
    parts = F.split("line", "\t", -1)
    at = lambda i: F.get(parts, F.lit(i))
    records = lines.where(F.col("line").startswith("record\t"))
    # the fact's part of the line, read as a canonical fact
    split = records.select(F.concat_ws("\t", F.lit("fact"), F.slice(parts, 5, 4)).alias("line"), at(1).cast("bigint").alias("revision"), plain(at(2)).alias("event"), at(3).alias("op"))
    log = facts_of_lines(split, "revision", "event", "op")
    edges = lines.where(F.col("line").startswith("before\t")).select(plain(at(1)).alias("left"), plain(at(2)).alias("right"))
    if not problems(log, edges).isEmpty():
        raise ValueError("the log is not valid")
    return log, edges
