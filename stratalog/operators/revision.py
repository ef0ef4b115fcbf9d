"""Append logs of facts by revision: snapshots, validity, differences, replay and publishing.

A log has a fact's columns and ``revision``, ``event``, ``op`` (assert or
retract).  A fact's identity there is (subject, relation, object): attributes
come from its latest operation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as T
from ..functions.facts import FACT_SCHEMA

IDENTITY = ["subject", "relation", "object"]
LOG_SCHEMA = FACT_SCHEMA + ", revision bigint, event string, op string"


def snapshot(log: DataFrame, frontier: int | None = None) -> DataFrame:
    """Facts as of a revision: each identity's latest operation at or before it, if that asserts."""
    rows = log if frontier is None else log.where(F.col("revision") <= frontier)
    latest = rows.groupBy(*IDENTITY).agg(F.max_by(F.struct("op", "attrs", "attrs_key", "revision", "event"), "revision").alias("last"))
    return latest.where("last.op = 'assert'").select(*IDENTITY, "last.attrs", "last.attrs_key", "last.revision", "last.event")


def latest_revision(log: DataFrame) -> DataFrame:
    """One row: the greatest revision, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("revision"), F.lit(0)).cast("bigint").alias("revision"))


def problems(log: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """kind, detail: repeated (identity, revision), unknown operations, edges that name unknown events, causal cycles."""
    from .causal import invalid_edges

    again = log.groupBy(*IDENTITY, "revision").count().where("count > 1").select(F.lit("duplicate_revision").alias("kind"), F.concat_ws(" ", F.concat(F.col("subject"), F.lit("#"), F.col("relation"), F.lit("@"), F.col("object")), F.col("revision").cast("string")).alias("detail"))
    odd = log.where("op is null or op not in ('assert', 'retract')").select(F.lit("unknown_operation").alias("kind"), F.coalesce("op", F.lit("null")).alias("detail"))
    out = again.unionByName(odd)
    if edges is not None:
        events = log.select("event").distinct()
        ends = edges.select(F.explode(F.array("left", "right")).alias("event")).distinct()
        out = out.unionByName(ends.join(events, "event", "left_anti").select(F.lit("unknown_event").alias("kind"), F.col("event").alias("detail")))
        out = out.unionByName(invalid_edges(edges))
    return out


def append(log: DataFrame, records: DataFrame) -> DataFrame:
    """The log with records whose (identity, revision) it does not have; their revisions may be out of order."""
    key = [*IDENTITY, "revision"]
    fresh = records.dropDuplicates(key).join(log.select(*key), key, "left_anti")
    return log.unionByName(fresh.select(*log.columns))


def rejected(log: DataFrame, records: DataFrame) -> DataFrame:
    """The records that ``append`` leaves out."""
    key = [*IDENTITY, "revision"]
    return records.join(log.select(*key).distinct(), key, "left_semi")


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Operations from one batch of declarations' facts to the next.

    Both have declaration, subject, relation, object and attrs_key.  A row for
    each fact that comes or goes: declaration, op, cause (declaration_added,
    declaration_removed, declaration_changed), the fact.
    """
    key = ["declaration", *T.KEY]
    old, new = previous.select(*key).distinct(), current.select(*key).distinct()
    sides = old.withColumn("old", F.lit(True)).join(new.withColumn("new", F.lit(True)), key, "full_outer")
    kinds = old.select("declaration").distinct().withColumn("had", F.lit(True)).join(new.select("declaration").distinct().withColumn("has", F.lit(True)), "declaration", "full_outer")
    rows = sides.where("old is null or new is null").join(kinds, "declaration")
    cause = F.when(F.col("had").isNull(), "declaration_added").when(F.col("has").isNull(), "declaration_removed").otherwise("declaration_changed")
    return rows.select("declaration", F.when(F.col("new"), "assert").otherwise("retract").alias("op"), cause.alias("cause"), *T.KEY)


def batch_revision(batch: DataFrame) -> DataFrame:
    """One row: sha256 over the batch's facts in canonical order.

    Facts are hashed each on its own, so only digests are brought together.
    """
    digest = F.sha2(F.concat_ws("\x1f", "declaration", *T.KEY), 256)
    return batch.select(digest.alias("d")).distinct().agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256)).alias("revision"))


def to_log(operations: DataFrame, revision: int, event: str = "delta") -> DataFrame:
    """Operations of ``diff`` as records of a log; cause and declaration become attributes."""
    attrs = F.create_map(F.lit("cause"), T.text(F.col("cause")), F.lit("declaration"), T.text(F.col("declaration")))
    return operations.select(*IDENTITY, attrs.alias("attrs"), T.key_of(attrs).alias("attrs_key"), F.lit(revision).cast("bigint").alias("revision"), F.lit(event).alias("event"), "op")


def replay_differences(log: DataFrame, stored: DataFrame, frontier: int | None = None) -> DataFrame:
    """Facts that only the log's snapshot (side: replayed) or only the stored one (side: stored) has."""
    key = [*IDENTITY, "attrs_key"]
    mine, theirs = snapshot(log, frontier).select(*key), stored.select(*key)
    return mine.exceptAll(theirs).withColumn("side", F.lit("replayed")).unionByName(theirs.exceptAll(mine).withColumn("side", F.lit("stored")))


def drift(log: DataFrame, base: int, current: int) -> DataFrame:
    """Facts added and removed between two revisions: change and the fact's key."""
    key = [*IDENTITY, "attrs_key"]
    a, b = snapshot(log, base).select(*key), snapshot(log, current).select(*key)
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def drift_report(log: DataFrame, edges: DataFrame, base: int, current: int, max_depth: int = 8, max_nodes: int = 1000) -> tuple[DataFrame, bool]:
    """What stands between a context at ``base`` and the log at ``current``: kind and detail; and whether that is all.

    Kinds: changed (a subject some of whose facts came or went), affected (what
    depends on one, within the bounds, over ``edges`` as they are now) and, in
    order, the steps of a plan: discard, load, invalidate, revalidate, preflight.
    """
    from .impact import impact

    changed = drift(log, base, current).select(F.col("subject").alias("node")).distinct()
    found = impact(edges, changed, max_depth + 1, max_nodes + 1)
    beyond = found.where((F.col("distance") > max_depth) | (F.col("rank") > max_nodes)).isEmpty()
    affected = found.where((F.col("distance") <= max_depth) & (F.col("rank") <= max_nodes)).select("node").distinct()
    steps = [("1 discard", "assumptions"), ("2 load", str(current)), ("3 invalidate", "affected"), ("4 revalidate", "obligations"), ("5 preflight", str(current))]
    plan = log.sparkSession.createDataFrame(steps, "kind string, detail string")
    rows = changed.select(F.lit("changed").alias("kind"), F.col("node").alias("detail")).unionByName(affected.select(F.lit("affected").alias("kind"), F.col("node").alias("detail")))
    return (rows.unionByName(plan) if base != current else rows), beyond


def publish(spark, path: str, operations: DataFrame, expected: int, event: str = "delta") -> int:
    """Appends operations as the next revision of the log at ``path`` if its head is ``expected``.

    Retracting or asserting ``provedClaim`` is refused: claims are proved
    elsewhere.  One writer at a time: the head is read, then a new partition
    is written whole.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)  # any other trouble with the log raises
    head = latest_revision(spark.read.schema(LOG_SCHEMA).parquet(path)).first()["revision"] if there else 0
    if head != expected:
        raise ValueError(f"revision conflict: the head is {head}, not {expected}")
    if not operations.where("relation like '%.provedClaim'").isEmpty():
        raise ValueError("a delta cannot promote a claim to proved")
    to_log(operations, head + 1, event).write.mode("append").parquet(path)
    return head + 1


def preflight(log: DataFrame, base: int) -> list[str]:
    """Reasons not to write on top of ``base``: none if the log is sound and at that revision."""
    out = [] if problems(log).isEmpty() else ["store-integrity"]
    return out if latest_revision(log).first()["revision"] == base else [*out, "context-stale"]
