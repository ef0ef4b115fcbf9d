"""Sources by type: file, rest, command, cucumber.  Further ones can be registered.

A specification is a dict with ``id``, ``type`` and what the type needs; those
of a program's DATASOURCE declarations come from ``declared``.
"""

from __future__ import annotations

import json
import subprocess
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..language.ast import Program
from ..language.declarations import entity
from . import codecs

Reader = Callable[[SparkSession, dict], DataFrame]
_readers: dict[str, Reader] = {}

RECORDS = "record_no bigint, body string"
#: Milliseconds that a request may take.
TIMEOUT = 5000


def register(kind: str, reader: Reader) -> None:
    _readers[kind] = reader


def read(spark: SparkSession, spec: dict) -> DataFrame:
    """The records of a source."""
    kind = spec.get("type")
    if kind not in _readers:
        raise KeyError(f"unknown source type {kind}; known: {', '.join(sorted(_readers))}")
    return _readers[kind](spark, spec)


def declared(program: Program) -> list[dict]:
    """Specifications of a program's DATASOURCE declarations."""
    return [{"id": entity(d), **{k: v.token() if v.token() is not None else [m.token() for m in v.members()] for k, v in d.attrs}} for d in program.declarations if d.kind == "datasource"]


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)], RECORDS)


def _file(spark: SparkSession, spec: dict) -> DataFrame:
    path = spec.get("path") or spec.get("file")
    if not path:
        raise ValueError("a file source requires a path")
    header = str(spec.get("csv_header", "true")).lower() != "false"
    typed = str(spec.get("csv_typed", "true")).lower() != "false"
    return codecs.read(spark, path, spec.get("format") or "lines", spec.get("csv_delimiter") or ",", header, typed)


def fetch(spec: dict) -> str:
    """The body of one request; mock responses are taken in turn."""
    mocks = spec.get("mock_responses") or ([spec["mock_response"]] if spec.get("mock_response") is not None else None)
    if mocks:
        at = spec["__turn"] = spec.get("__turn", -1) + 1
        return mocks[min(at, len(mocks) - 1)]
    url = spec.get("url")
    if not url:
        raise ValueError("a rest source requires a url")
    method = str(spec.get("method", "GET")).upper()
    if method not in ("GET", "POST", "PUT", "PATCH", "DELETE"):
        raise ValueError(f"unsupported method {method}")
    if "://" not in url:
        with open(url, encoding="utf-8") as f:
            return f.read()
    body = spec.get("body")
    headers = spec.get("headers") or {}
    request = urllib.request.Request(url, method=method, data=body.encode() if body else None, headers=json.loads(headers) if isinstance(headers, str) else headers)
    try:
        with urllib.request.urlopen(request, timeout=float(spec.get("timeout_ms", TIMEOUT)) / 1000) as response:
            return response.read().decode()
    except urllib.error.HTTPError as e:
        raise OSError(f"{method} {url}: status {e.code}") from e


def _rest(spark: SparkSession, spec: dict) -> DataFrame:
    return records(spark, codecs.parse(spec.get("format") or "json", fetch(spec)))


def _command(spark: SparkSession, spec: dict) -> DataFrame:
    """Runs only where the specification says ``allow_commands``: it comes from the caller, not from a program's text."""
    if spec.get("allow_commands") is not True:
        raise PermissionError("command sources must be allowed by the caller")
    run = subprocess.run(["bash", "-lc", spec["command"]], capture_output=True, text=True, timeout=float(spec.get("timeout_ms", 30_000)) / 1000)
    if not spec.get("format"):
        return records(spark, [{"exit": run.returncode, "stdout": run.stdout, "stderr": run.stderr}])
    if run.returncode:
        raise OSError(f"command ended with {run.returncode}: {run.stderr.strip()[:200]}")
    return records(spark, codecs.parse(spec["format"], run.stdout))


FEATURES = "array<struct<id:string,name:string,uri:string,elements:array<{s}>,scenarios:array<{s}>>>".format(
    s="struct<id:string,name:string,type:string,steps:array<struct<name:string,keyword:string,result:struct<status:string,duration:string>>>>"
)


def _slug(c):
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def cucumber_steps(reports: DataFrame) -> DataFrame:
    """One row for each step of the scenarios in reports (column value: a report's JSON text)."""
    whole = F.trim("value")
    listed = F.when(whole.startswith("["), whole).otherwise(F.concat(F.lit("["), F.coalesce(F.get_json_object(whole, "$.features"), whole), F.lit("]")))
    features = F.from_json(F.when(listed.startswith("[["), F.substring(listed, F.lit(2), F.length(listed) - 2)).otherwise(listed), FEATURES)
    rows = reports.select(F.posexplode(features).alias("fi", "f"))
    fid = F.coalesce("f.id", F.concat(F.lit("feature_"), (F.col("fi") + 1).cast("string"), F.lit("_"), _slug(F.coalesce("f.name", F.lit("feature")))))
    rows = rows.select(fid.alias("feature_id"), F.coalesce("f.name", F.lit("feature")).alias("feature"), F.coalesce("f.uri", F.lit("unknown")).alias("uri"), F.posexplode(F.coalesce("f.elements", "f.scenarios")).alias("si", "s"))
    rows = rows.where(F.lower(F.coalesce("s.type", F.lit("scenario"))).isin("scenario", "scenario_outline"))
    sid = F.coalesce("s.id", F.concat("feature_id", F.lit("__scenario_"), (F.col("si") + 1).cast("string"), F.lit("_"), _slug(F.coalesce("s.name", F.lit("scenario")))))
    rows = rows.select("feature_id", "feature", "uri", sid.alias("scenario_id"), F.coalesce("s.name", F.lit("scenario")).alias("scenario"), F.posexplode("s.steps").alias("ti", "t"))
    event = lambda at: F.concat(F.lit("evt:"), _slug("scenario_id"), F.lit("__step_"), F.lpad(at.cast("string"), 3, "0"))
    duration = F.coalesce(F.floor(F.trim("t.result.duration").try_cast("double")).cast("bigint"), F.lit(0).cast("bigint"))
    return rows.select(
        F.lit("cucumber_step").alias("record_kind"), "feature", "feature_id", "scenario", "scenario_id", F.coalesce("t.name", F.lit("")).alias("step"), F.trim(F.coalesce("t.keyword", F.lit(""))).alias("step_keyword"),
        (F.col("ti") + 1).alias("step_index"), F.lower(F.coalesce("t.result.status", F.lit("unknown"))).alias("status"), duration.alias("duration_ns"), event(F.col("ti") + 1).alias("event_id"), F.col("scenario_id").alias("actor"),
        F.create_map("scenario_id", F.col("ti") + 1).alias("vector_clock"), F.when(F.col("ti") > 0, F.array(event(F.col("ti")))).otherwise(F.array().cast("array<string>")).alias("before"), "uri",
    )


def _cucumber(spark: SparkSession, spec: dict) -> DataFrame:
    path = spec.get("path") or spec.get("file")
    if not path:
        raise ValueError("a cucumber source requires a path")
    steps = cucumber_steps(spark.read.text(path, wholetext=True))
    return steps.select(F.monotonically_increasing_id().alias("record_no"), F.to_json(F.struct(*steps.columns)).alias("body"))


register("file", _file)
register("rest", _rest)
register("command", _command)
register("cucumber", _cucumber)


class RecordSource(DataSource):
    """``spark.read.format("records")`` with the options of a rest specification: one request, one partition."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(dict(self.options))


class _RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition):
        for i, r in enumerate(codecs.parse(self.options.get("format") or "json", fetch(self.options))):
            yield i, json.dumps(r, ensure_ascii=False)
