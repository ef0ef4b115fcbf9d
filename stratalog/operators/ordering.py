"""Consecutive numbers for the rows of an ordered table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def number_rows(rows: DataFrame, order: list[str | Column], name: str = "id", first: int = 0) -> DataFrame:
    """``rows`` with a column of consecutive numbers from ``first`` on, by ``order``.

    Rows are sorted range by range; a row's number is its place in its range
    and the sizes of the ranges before, which are all that the driver sees.
    """
    placed = materialise(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], first
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = F.create_map(*[F.lit(x).cast("bigint") for pair in before for x in pair]) if before else F.create_map().cast("map<bigint,bigint>")
    return placed.withColumn(name, offsets[part] + place).drop("__at")
