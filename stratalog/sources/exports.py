"""Sinks: facts and answers in any format, relation folders, canonical lines, conformance reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.facts import FACT_SCHEMA, KEY, escaped
from ..language.ast import Program, Rule
from ..language.names import parse_attrs_key
from . import codecs

#: Formats that Spark writes itself.
WRITERS = ("json", "csv", "parquet", "orc")


def write(rows: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """Rows as files of a format.  Maps and arrays become JSON text in CSV."""
    if fmt not in WRITERS:
        raise ValueError(f"{fmt} is not written in parts; use render for small tables")
    if fmt == "csv":
        nested = [f.name for f in rows.schema if f.dataType.typeName() in ("map", "array", "struct")]
        rows.withColumns({n: F.to_json(n) for n in nested}).write.mode(mode).csv(path, header=True)
    else:
        rows.write.mode(mode).format(fmt).save(path)


def render(rows: DataFrame, fmt: str) -> str:
    """A small table as one text: its rows come to the driver."""
    return codecs.emit(fmt, [json.loads(r) for r in rows.toJSON().collect()])


def render_queries(answers: dict[str, DataFrame], fmt: str) -> str:
    """Answers of several queries as one text; CSV holds one table only."""
    if fmt == "csv":
        if len(answers) != 1:
            raise ValueError("CSV needs a single table")
        return render(next(iter(answers.values())), fmt)
    return codecs.emit(fmt, [{"query": n, "rows": [json.loads(r) for r in df.toJSON().collect()]} for n, df in answers.items()])


def write_relations(facts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder for each relation with ``subject <tab> object`` lines."""
    facts.select("subject", "object", "relation").distinct().repartition("relation").write.mode(mode).partitionBy("relation").csv(path, sep="\t")


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.facts import NO_ATTRS

    rows = spark.read.schema("subject string, object string, relation string").csv(path, sep="\t")
    return rows.select("subject", "relation", "object", F.expr(NO_ATTRS).alias("attrs"), F.lit("").alias("attrs_key"))


def datalog(rules: list[Rule], queries=()) -> str:
    """Rules as text of a Datalog dialect with two-column relations; attributes are dropped."""
    ident = lambda r: r.replace(".", "_")
    term = lambda t: t[1:].replace(".", "_") if t.startswith("?") else json.dumps(t)
    atom = lambda a: f"{ident(a.relation)}({term(a.subject)}, {term(a.object)})"
    names = sorted({a.relation for r in rules for a in (r.head, *r.positive, *r.negative)} | {a.relation for q in queries for a in (*q.positive, *q.negative)})
    out = [f".decl {ident(n)}(subject: symbol, object: symbol)\n.input {ident(n)}" for n in names]
    body = lambda x: ", ".join([atom(a) for a in x.positive] + ["!" + atom(a) for a in x.negative])
    out += [f"{atom(r.head)} :- {body(r)}." for r in rules]
    for q in queries:
        columns = ", ".join(v[1:].replace(".", "_") for v in q.select)
        out.append(f".decl query_{ident(q.name)}({', '.join(v[1:].replace('.', '_') + ': symbol' for v in q.select)})\n.output query_{ident(q.name)}\nquery_{ident(q.name)}({columns}) :- {body(q)}.")
    return "\n".join(out) + "\n"


# ---- canonical text


def fact_lines(facts: DataFrame) -> DataFrame:
    """``fact <tab> subject <tab> relation <tab> object <tab> attrs_key``."""
    return facts.select(F.concat_ws("\t", F.lit("fact"), *[escaped(F.col(c)) for c in KEY[:3]], "attrs_key").alias("line"))


def plain(c):
    """A value as it was before it was escaped."""
    from ..language.names import ESCAPES

    for char, code in reversed(ESCAPES.items()):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def facts_of_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """The facts of ``fact_lines``, with further columns that are to be kept."""
    parts = F.split("line", "\t", -1)
    pairs = F.filter(F.split(F.get(parts, F.lit(4)), ";"), lambda p: p != "")
    entry = lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("key"), plain(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).alias("value"))
    return lines.where(F.col("line").startswith("fact\t")).select(*[plain(F.get(parts, F.lit(i + 1))).alias(c) for i, c in enumerate(KEY[:3])], F.map_from_entries(F.transform(pairs, entry)).alias("attrs"), F.get(parts, F.lit(4)).alias("attrs_key"), *keep)


def rule_line(r: Rule) -> str:
    return "\t".join(["rule", r.name, " AND ".join([a.text() for a in r.positive] + [f"NOT {a.text()}" for a in r.negative]), r.head.text(), r.trust])


def conformance(program: Program) -> str:
    """All that a program means, as sorted lines; sections with their own prefix."""
    from ..language.names import attrs_key

    lines = {f"fact\t{a.subject}\t{a.relation}\t{a.object}\t{attrs_key(dict(a.attrs))}" for a in program.facts()}
    lines |= {rule_line(r) for r in program.all_rules()}
    lines |= {"\t".join(["query", q.name, " ".join(q.select), " AND ".join([a.text() for a in q.positive] + [f"NOT {a.text()}" for a in q.negative])]) for q in program.queries}
    return "\n".join(["conformance\t1", f"module\t{program.module or '-'}", *sorted(lines)]) + "\n"


def compare_conformance(left: str, right: str) -> dict[str, list[str]]:
    """Lines that only one of two reports has."""
    a, b = set(left.splitlines()), set(right.splitlines())
    return {"left": sorted(a - b), "right": sorted(b - a)}


def snapshot_json(facts: DataFrame, module: str) -> str:
    """A canonical snapshot of a small fact table with its hash."""
    rows = sorted((r.asDict() for r in facts.select(*KEY).distinct().collect()), key=lambda r: [r[k] for k in KEY])
    for r in rows:
        r["attrs"] = parse_attrs_key(r.pop("attrs_key"))
    body = json.dumps(rows, sort_keys=True, separators=(",", ":"))
    return json.dumps({"module": module, "facts": rows, "sha256": hashlib.sha256(body.encode()).hexdigest()}, sort_keys=True)


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes and sha256 of files; their aggregate hash is ``aggregate_hash``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def aggregate_hash(files: DataFrame) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit("\t"), x["sha256"]))
    return files.agg(F.sha2(F.array_join(listed, "\n"), 256).alias("sha256"), F.count("*").alias("files"))


EMPTY_FACTS = FACT_SCHEMA
