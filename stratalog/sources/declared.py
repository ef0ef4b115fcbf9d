"""Batches of declaration events (JSON) of a proof assistant as facts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts as T
from ..language.names import relation_name as rel
from .records import node_column, relation_column

EVENT = (
    "struct<operation:string,declaration:string,module:string,kind:string,trust:string,kernel_present:boolean,uses_sorry:boolean,proved_claim:boolean,type_fingerprint:string,dependencies:array<string>,"
    "claim:string,concept:string,requires:string,export:boolean,attachments:array<struct<trust:string,relation:string,object:map<string,string>,subject:map<string,string>>>>"
)
BATCH = f"struct<format:string,module:string,complete:boolean,event_count:bigint,events:array<{EVENT}>>"


#: Operations of events.
OPERATIONS = ("linkLeanDecl", "link")


class BatchError(ValueError):
    """A batch that must not be imported."""


def validate(text: str, version: str | None = None) -> dict:
    """A batch that may be imported; raises BatchError otherwise."""
    batch = json.loads(text)
    need = [
        (version is None or batch.get("format") == version, "unsupported format"), (batch.get("complete") is True, "partial batches are quarantined"),
        (batch.get("event_count") == len(batch.get("events", [])), "event_count does not match the events"),
    ]
    for e in batch.get("events", []):
        need += [(e.get("operation") in OPERATIONS, "unsupported operation"), (e.get("proved_claim") is False, "an event must not assert that a claim is proved"), (isinstance(e.get("kernel_present"), bool), "an event lacks its kernel status")]
        need += [(e.get(k) is None or isinstance(e[k], str), f"{k} must be text") for k in ("claim", "concept", "requires")]
        for a in e.get("attachments") or []:
            need += [(a.get("trust") == "elaboration_validated", "an attachment must be validated"), (bool(str(a.get("relation") or "").strip()), "an attachment needs a relation")]
    for ok, message in need:
        if not ok:
            raise BatchError(message)
    return batch


def read(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """One row for each event of a batch file."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one file, validated whole
    validate(text, version)
    return spark.createDataFrame([(text,)], "value string").select(F.explode(F.from_json("value", BATCH)["events"]).alias("e")).select("e.*")


def to_facts(events: DataFrame) -> DataFrame:
    """Facts of events, and ``declaration``: kind, module, trust and so on; dependencies; links to claims, concepts and assumptions both ways; attachments."""
    me = node_column(F.concat(F.lit("decl:"), F.col("declaration")))
    token = lambda prefix, c: node_column(F.concat(F.lit(prefix + ":"), c.cast("string")))

    def made(rows: DataFrame, subject: Column, relation: Column, obj: Column) -> DataFrame:
        keep = rows.select(subject.alias("subject"), relation.alias("relation"), obj.alias("object"), F.expr(T.NO_ATTRS).alias("attrs"), F.lit("").alias("attrs_key"), "declaration")
        return keep.where("subject is not null and relation is not null and object is not null")

    c = F.col
    base = {
        "kind": token("decl_kind", c("kind")), "defined_in": token("decl_module", c("module")), "trust": token("trust", c("trust")), "kernel_present": token("value", c("kernel_present")), "uses_sorry": token("value", c("uses_sorry")),
        "proved_claim": F.lit("value.false"), "export_selected": token("value", F.coalesce(c("export"), F.lit(False))), "type_fingerprint": token("value", c("type_fingerprint")),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(rel(k)).alias("r"), v.alias("o")) for k, v in base.items()]))
    out = [made(events.select("declaration", pairs.alias("p")), me, c("p.r"), c("p.o"))]
    out.append(made(events.select("declaration", F.explode("dependencies").alias("d")), me, F.lit(rel("depends_on")), token("decl", c("d"))))
    for column, prefix, there, back in (("claim", "claim", "formalizes", "formalized_by"), ("concept", "concept", "mentions", "mentioned_by"), ("requires", "assumption", "requires", "required_by")):
        some = events.where(c(column).isNotNull())
        out += [made(some, me, F.lit(rel(there)), token(prefix, c(column))), made(some, token(prefix, c(column)), F.lit(rel(back)), me)]
    value = lambda m: F.coalesce(m["symbol"], m["string"], m["integer"], F.concat(F.lit("value:"), m["boolean"]))
    attached = events.select("declaration", F.explode("attachments").alias("a"))
    out.append(made(attached, node_column(value(c("a.object"))), relation_column(c("a.relation")), node_column(value(c("a.subject")))))
    return T.union(out)
