"""Text formats: JSON, EDN (its JSON-like part), CSV, YAML (flat maps and lists of them), key=value, plain text.

``parse`` and ``emit`` work on small texts on the driver; ``read`` reads files
of any size with Spark's readers where a format is made of lines.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Record = dict[str, Any]


def scalar(token: str) -> Any:
    """true/false, integers, decimals, quoted strings; anything else is text."""
    t = token.strip()
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if re.fullmatch(r"-?\d+", t):
        return int(t)
    if re.fullmatch(r"-?\d+\.\d+", t):
        return float(t)
    if len(t) >= 2 and t[0] == t[-1] == '"':
        return json.loads(t)
    return t


def header_key(text: str, at: int) -> str:
    """A header cell as a key; an empty one is ``col_<n>``."""
    key = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9_:\-.]+", "_", text.strip().lower()))
    return key or f"col_{at + 1}"


def parse_csv(text: str, delimiter: str = ",", header: bool = True, typed: bool = True) -> list[Record]:
    """Rows padded to the widest; blank lines are skipped."""
    rows = list(csv.reader(io.StringIO("\n".join(line for line in text.splitlines() if line.strip())), delimiter=delimiter or ","))
    if not rows:
        return []
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    value = scalar if typed else str
    names = [header_key(c, i) for i, c in enumerate(rows[0])] if header else [f"col_{i + 1}" for i in range(width)]
    return [dict(zip(names, map(value, r))) for r in (rows[1:] if header else rows)]


def emit_csv(records: list[Record]) -> str:
    names = list(dict.fromkeys(k for r in records for k in r))
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(names)
    for r in records:
        w.writerow(["" if r.get(n) is None else _plain(r[n]) for n in names])
    return out.getvalue()


def _plain(v: Any) -> str:
    return str(v).lower() if isinstance(v, bool) else v if isinstance(v, str) else json.dumps(v)


def parse_yaml(text: str) -> list[Record]:
    """A flat map, or a list of flat maps; JSON is accepted."""
    text = text.strip()
    if text[:1] in ("{", "["):
        return parse_json(text)
    out: list[Record] = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not line or line.strip() == "---":
            continue
        body = line.strip()
        if body == "-" or body.startswith("- "):
            out.append({})
            body = body[1:].strip()
            if not body:
                continue
        elif not out:
            out.append({})
        key, colon, value = body.partition(":")
        if not colon:
            raise ValueError(f"line {number}: key: value expected")
        out[-1][key.strip()] = scalar(value)
    return out


def emit_yaml(records: list[Record]) -> str:
    quote = lambda v: json.dumps(v) if not isinstance(v, str) or scalar(v) != v or v != v.strip() or any(c in v for c in ':#"\n') or v == "" else v
    if len(records) == 1:
        return "".join(f"{k}: {quote(v)}\n" for k, v in records[0].items())
    return "".join(("- " if i == 0 else "  ") + f"{k}: {quote(v)}\n" for r in records for i, (k, v) in enumerate(r.items()))


def parse_kv(text: str) -> list[Record]:
    """``key=value`` lines make one record."""
    pairs = [line.partition("=") for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    if any(not eq for _, eq, _ in pairs):
        raise ValueError("key=value expected")
    return [{k.strip(): scalar(v) for k, _, v in pairs}] if pairs else []


def emit_kv(records: list[Record]) -> str:
    return "\n".join("".join(f"{k}={_plain(v)}\n" for k, v in r.items()) for r in records)


def parse_json(text: str) -> list[Record]:
    if not text.strip():
        return []
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        found = [json.loads(line) for line in text.splitlines() if line.strip()]
    found = found if isinstance(found, list) else [found]
    return [r if isinstance(r, dict) else {"value": r} for r in found if r is not None]


def parse_edn(text: str) -> list[Record]:
    """Maps, vectors, sets, keywords, strings, numbers, booleans and nil."""
    found = re.findall(r'"(?:\\.|[^"\\])*"|#\{|[\[\]{}()]|;[^\n]*|[^\s,\[\]{}()";]+', text)
    items = [t for t in found if not t.startswith(";")][::-1]

    def value() -> Any:
        t = items.pop()
        if t in ("[", "(", "#{"):
            close, out = {"[": "]", "(": ")", "#{": "}"}[t], []
            while items[-1] != close:
                out.append(value())
            items.pop()
            return out
        if t == "{":
            out = {}
            while items[-1] != "}":
                k = value()
                out[k if isinstance(k, str) else json.dumps(k)] = value()
            items.pop()
            return out
        if t == "nil":
            return None
        return t[1:] if t.startswith(":") else scalar(t)

    out = []
    while items:
        v = value()
        out += v if isinstance(v, list) else [v]
    return [r if isinstance(r, dict) else {"value": r} for r in out if r is not None]


def emit_edn(records: list[Record]) -> str:
    def text(v: Any) -> str:
        if isinstance(v, dict):
            return "{" + ", ".join(f":{k} {text(x)}" for k, x in v.items()) + "}"
        if isinstance(v, list):
            return "[" + " ".join(map(text, v)) + "]"
        return "nil" if v is None else json.dumps(v)

    return text(records) + "\n"


Codec = tuple[Callable[[str], list[Record]], Callable[[list[Record]], str]]
_codecs: dict[str, Codec] = {}


def register(name: str, parse: Callable[[str], list[Record]], emit: Callable[[list[Record]], str]) -> None:
    """Adds or replaces a format."""
    _codecs[name.lower()] = (parse, emit)


register("json", parse_json, lambda records: json.dumps(records, ensure_ascii=False) + "\n")
register("edn", parse_edn, emit_edn)
register("csv", parse_csv, emit_csv)
register("yaml", parse_yaml, emit_yaml)
register("yml", parse_yaml, emit_yaml)
register("kv", parse_kv, emit_kv)
register("text", lambda text: [{"text": text}], lambda records: "\n".join(str(r.get("text", r)) for r in records) + "\n")


def parse(name: str, text: str) -> list[Record]:
    return _codec(name)[0](text)


def emit(name: str, records: list[Record]) -> str:
    return _codec(name)[1](records)


def _codec(name: str) -> Codec:
    if name.lower() not in _codecs:
        raise KeyError(f"unknown format {name}; known: {', '.join(sorted(_codecs))}")
    return _codecs[name.lower()]


# ---- files of any size


def json_token(text: Column) -> Column:
    """The JSON literal of a typed token: the column form of ``scalar``."""
    t = F.trim(text)
    quoted = F.to_json(F.struct(F.coalesce(t, F.lit("")).alias("x")))
    return F.when(F.lower(t).isin("true", "false"), F.lower(t)).when(t.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$"), t).when(t.rlike(r'^"(\\.|[^"\\])*"$'), t).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def _object(pairs: list[tuple[str, Column]]) -> Column:
    parts = [F.concat(F.lit(json.dumps(k) + ":"), v) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def read(spark: SparkSession, path: str, fmt: str, delimiter: str = ",", header: bool = True, typed: bool = True) -> DataFrame:
    """record_no and body of the records in files; record_no orders the records of a file but may have gaps."""
    number = F.monotonically_increasing_id().alias("record_no")
    fmt = fmt.lower()
    if fmt in ("lines", "text"):
        return spark.read.text(path, wholetext=fmt == "text").select(number, _object([("text" if fmt == "text" else "line", F.substring(F.to_json(F.struct(F.col("value").alias("x"))), F.lit(6), F.length(F.to_json(F.struct(F.col("value").alias("x")))) - 6))]).alias("body"))
    if fmt == "csv":
        rows = spark.read.csv(path, sep=delimiter, header=header, inferSchema=False, escape='"', mode="PERMISSIVE")
        names = [header_key(c, i) if header else f"col_{i + 1}" for i, c in enumerate(rows.columns)]
        rows = rows.toDF(*[f"c{i}" for i in range(len(names))])
        value = json_token if typed else lambda c: F.substring(F.to_json(F.struct(c.alias("x"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
        return rows.select(number, _object([(n, value(F.coalesce(F.col(f"c{i}"), F.lit("")))) for i, n in enumerate(names)]).alias("body"))
    if fmt == "jsonl":
        return spark.read.text(path).where(F.trim("value") != "").select(number, F.col("value").alias("body"))

    def decode(batches):
        import pandas as pd

        for frame in batches:
            rows = [(i, json.dumps(r, ensure_ascii=False)) for text in frame["value"] for i, r in enumerate(parse(fmt, text))]
            yield pd.DataFrame(rows, columns=["record_no", "body"])

    # whole files: these formats have no lines that could be read apart
    return spark.read.text(path, wholetext=True).mapInPandas(decode, "record_no bigint, body string")
