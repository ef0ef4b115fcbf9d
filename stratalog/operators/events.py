"""The control event store: hash-chained append streams, receipts, snapshots, and the workflow projection."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

EVENTS = "stream string, revision bigint, event_id string, event_type string, actor string, request_id string, payload string, payload_sha256 string, previous_event_sha256 string, event_sha256 string, receipt_id string"
#: What the first event of a stream has as its predecessor's hash.
GENESIS = "0" * 64
#: Event types that a workflow is made of.
WORKFLOW_TYPES = ["context-generated", "action-token-issued", "checkpoint-created", "action-consumed", "postcondition-observed", "recovery-started", "recovery-completed", "semantic-decision", "external-evidence-recorded"]


def payload_hash(payload: Column) -> Column:
    return F.sha2(fields(payload).cast("binary"), 256)


def fields(*values: Column | str) -> Column:
    """Values in writing that no other values have: each with its number of bytes before it, a null as a mark of its own."""
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    texts = [c.cast("string") for c in columns]
    return F.concat_ws(",", *[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def fields_of(values: list) -> bytes:
    """The same in Python."""
    data = [None if v is None else str(v).encode() for v in values]
    return b",".join([b"-" if d is None else b"%d:%s" % (len(d), d) for d in data])


def link_hash(previous: Column) -> Column:
    """The hash of an event (columns of EVENTS) after ``previous``."""
    return F.sha2(fields(previous, "stream", "revision", "event_id", "event_type", "actor", "request_id", "payload_sha256").cast("binary"), 256)


def chain(batch: DataFrame, heads: DataFrame | None = None, receipt: str = "receipt") -> DataFrame:
    """Events (stream, event_id, event_type, actor, request_id, payload, order) chained onto their streams' heads.

    Revisions go up by one in ``order``.  A hash needs its predecessor's, so a
    stream is hashed in order; streams are hashed side by side, and rows pass
    through one after another, so nothing is gathered.  ``heads``: stream,
    revision, event_sha256.
    """
    rows = batch.select("stream", F.col("order").cast("bigint").alias("order"), "event_id", "event_type", "actor", "request_id", "payload", payload_hash(F.col("payload")).alias("payload_sha256"))
    if heads is None:
        rows = rows.withColumns({"r": F.lit(0).cast("bigint"), "h": F.lit(GENESIS)})
    else:
        now = heads.select("stream", F.col("revision").alias("r"), F.col("event_sha256").alias("h"))
        rows = rows.join(now, "stream", "left").withColumns({"r": F.coalesce("r", F.lit(0)).cast("bigint"), "h": F.coalesce("h", F.lit(GENESIS))})
    dealt = rows.repartition("stream").sortWithinPartitions("stream", "order", "event_id")

    def link(batches):
        stream, revision, last = None, 0, ""
        for frame in batches:
            revisions, previous, own = [], [], []
            for r in frame.itertuples(index=False):
                if r.stream != stream:
                    stream, revision, last = r.stream, r.r, r.h
                revision += 1
                previous.append(last)
                last = hashlib.sha256(fields_of([last, r.stream, revision, r.event_id, r.event_type, r.actor, r.request_id, r.payload_sha256])).hexdigest()
                revisions.append(revision)
                own.append(last)
            yield frame.assign(revision=revisions, previous_event_sha256=previous, event_sha256=own, receipt_id=receipt)[columns]

    columns = [c.split(" ")[0] for c in EVENTS.split(", ")]
    return dealt.mapInPandas(link, EVENTS)


def heads(events: DataFrame) -> DataFrame:
    """stream, revision and event_sha256 of each stream's last event."""
    return events.groupBy("stream").agg(F.max("revision").alias("revision"), F.max_by("event_sha256", "revision").alias("event_sha256"))


def append(events: DataFrame, batch: DataFrame, stream: str, expected: int, receipt: str) -> DataFrame:
    """A batch chained onto one stream if its head is ``expected``; raises otherwise.  Returns the new rows."""
    head = heads(events.where(F.col("stream") == stream)).first()
    now = head["revision"] if head else 0
    if now != expected:
        raise ValueError(f"revision conflict: the head of {stream} is {now}, not {expected}")
    return materialise(chain(batch.withColumn("stream", F.lit(stream)), heads(events), receipt), "events")


def read_range(events: DataFrame, stream: str, first: int, last: int) -> DataFrame:
    return events.where((F.col("stream") == stream) & F.col("revision").between(first, last)).orderBy("revision")


def verify_chain(events: DataFrame) -> DataFrame:
    """For each stream: events, gaps, broken_links, bad_payloads, bad_hashes, ok."""
    order = Window.partitionBy("stream").orderBy("revision")
    rows = events.withColumns({"__r": F.lag("revision", 1, 0).over(order), "__h": F.lag("event_sha256", 1, GENESIS).over(order)})
    out = rows.groupBy("stream").agg(
        F.count("*").alias("events"), F.count_if(F.col("revision") != F.col("__r") + 1).alias("gaps"), F.count_if(~F.col("previous_event_sha256").eqNullSafe(F.col("__h"))).alias("broken_links"),
        F.count_if(~F.col("payload_sha256").eqNullSafe(payload_hash(F.col("payload")))).alias("bad_payloads"), F.count_if(~F.col("event_sha256").eqNullSafe(link_hash(F.col("previous_event_sha256")))).alias("bad_hashes"),
    )
    return out.withColumn("ok", F.col("gaps") + F.col("broken_links") + F.col("bad_payloads") + F.col("bad_hashes") == 0)


def receipts(events: DataFrame) -> DataFrame:
    """receipt_id, stream, first and last revision, events, batch_sha256 over all events' revisions and hashes, receipt_sha256.

    The batch's hash folds a digest of each event by exclusive or, word by
    word, and adds the last event's hash, which commits to all before it.  So
    it is pre-aggregated and no receipt's events are brought together.
    """
    digest = F.sha2(fields("revision", "event_sha256").cast("binary"), 256)
    word = lambda k: F.conv(F.substring("__d", 1 + 16 * k, 16), 16, -10).cast("bigint")
    folded = [F.bit_xor(word(k)).alias(f"__{k}") for k in range(4)]
    rows = events.withColumn("__d", digest).groupBy("receipt_id", "stream").agg(
        F.min("revision").alias("first_revision"), F.max("revision").alias("last_revision"), F.count("*").alias("events"), F.max_by("event_sha256", "revision").alias("__last"), *folded
    )
    rows = rows.withColumn("batch_sha256", F.sha2(fields(*[f"__{k}" for k in range(4)], "__last").cast("binary"), 256)).drop("__last", *[f"__{k}" for k in range(4)])
    return rows.withColumn("receipt_sha256", F.sha2(fields("receipt_id", "stream", "first_revision", "last_revision", "events", "batch_sha256").cast("binary"), 256))


def verify_receipts(events: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept receipts that do not match the events: receipt_id, stream, problem."""
    key = ["receipt_id", "stream"]
    now = receipts(events).select(*key, F.struct("events", "batch_sha256", "receipt_sha256").alias("now"))
    rows = kept.join(now, key, "left")
    problem = F.when(F.col("now").isNull(), "missing-events").when(F.col("events") != F.col("now.events"), "count").when(F.col("batch_sha256") != F.col("now.batch_sha256"), "batch").when(F.col("receipt_sha256") != F.col("now.receipt_sha256"), "receipt")
    return rows.select(*key, problem.alias("problem")).where("problem is not null")


def keep_snapshot(snapshots: DataFrame, stream: str, revision: int, reducer: str, body: str) -> DataFrame:
    """Snapshots (stream, revision, reducer, body) with one more; equal bytes again are fine, different ones raise."""
    same = snapshots.where((F.col("stream") == stream) & (F.col("revision") == revision) & (F.col("reducer") == reducer)).first()
    if same is not None:
        if same["body"] != body:
            raise ValueError("a snapshot cannot be replaced by a different one")
        return snapshots
    return snapshots.unionByName(snapshots.sparkSession.createDataFrame([(stream, revision, reducer, body)], snapshots.schema))


def workflow_id(payload: Column, request_id: Column) -> Column:
    named = [F.get_json_object(payload, f"$.{k}") for k in ("workflow_id", "action_id", "token_id")]
    return F.coalesce(*named, request_id, F.lit("workflow:unbound"))


def workflow_projection(events: DataFrame) -> DataFrame:
    """Each workflow's observation_count, last_revision, last_event_type, last_event_id and sorted distinct actors.

    Only counts, last values and actors are aggregated; the observations of a
    workflow in order are ``workflow_observations``.
    """
    rows = events.where(F.col("event_type").isin(WORKFLOW_TYPES)).withColumn("workflow_id", workflow_id(F.col("payload"), F.col("request_id")))
    last = F.struct("revision", "event_type", "event_id")
    out = rows.groupBy("workflow_id").agg(F.count("*").alias("observation_count"), F.max(last).alias("last"), F.sort_array(F.collect_set("actor")).alias("actors"))
    return out.select("workflow_id", "observation_count", F.col("last.revision").alias("last_revision"), F.col("last.event_type").alias("last_event_type"), F.col("last.event_id").alias("last_event_id"), "actors")


def workflow_observations(events: DataFrame) -> DataFrame:
    """workflow_id, place (from 1) and the event, for each event of a workflow."""
    rows = events.where(F.col("event_type").isin(WORKFLOW_TYPES)).withColumn("workflow_id", workflow_id(F.col("payload"), F.col("request_id")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("workflow_id").orderBy("revision", "event_id")))


def context_bundle(edges: DataFrame, facts: DataFrame, changed: list[str]) -> DataFrame:
    """node, role (changed or impacted) and the facts that touch it, for an agent that is to work on some nodes."""
    from .impact import impact

    reached = impact(edges, changed).select("node").distinct()
    start = facts.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(changed)], "node string")
    scope = start.withColumn("role", F.lit("changed")).unionByName(reached.join(start, "node", "left_anti").withColumn("role", F.lit("impacted")))
    touching = facts.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("node"), "subject", "relation", "object")
    return scope.join(touching, "node", "left")
