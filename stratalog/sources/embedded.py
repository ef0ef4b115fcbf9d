"""Annotation blocks in source files: ``@rel ... @endrel`` in comments, and how they change between versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = re.compile(r"@rel(?:\s+(?P<id>[\w.\-]+))?[^\n]*\n(?P<body>.*?)@endrel", re.S)
#: What a following declaration looks like, by file suffix.
DECLARATION = {
    "lean": r"(?:theorem|lemma|def|structure|inductive|class)\s+([\w.']+)", "py": r"(?:def|class)\s+(\w+)", "clj": r"\(def\w*-?\s+([\w\-!?*]+)", "rs": r"(?:fn|struct|enum|trait)\s+(\w+)", "md": r"#+\s+([^\n]+)",
}
COMMENT = re.compile(r"^\s*(?:--|//|;+|#|\*)\s?")
SCHEMA = "block_id string, file string, line bigint, declaration string, context string, text string"


def blocks_of(path: str, text: str) -> list[tuple]:
    """The blocks of one file; ``self`` in a block stands for the declaration after it."""
    suffix = path.rsplit(".", 1)[-1]
    out = []
    for n, m in enumerate(BLOCK.finditer(text)):
        after = re.search(DECLARATION[suffix], text[m.end() :]) if suffix in DECLARATION else None
        name = after[1].strip() if after else ""
        body = "\n".join(COMMENT.sub("", line) for line in m["body"].splitlines())
        if name:
            body = re.sub(r"\bself\b", f"{suffix}:{name}", body)
        out.append((m["id"] or f"{path}#{n}", path, text.count("\n", 0, m.start()) + 1, name, suffix, body.strip()))
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all files below a folder; files are read whole, each by one task."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches):
        import pandas as pd

        columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for frame in batches:
            yield pd.DataFrame([b for p, t in zip(frame["path"], frame["value"]) for b in blocks_of(p, t)], columns=columns)

    return files.mapInPandas(run, SCHEMA)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """block_id, change (added, removed, changed) and the fields of file, declaration, context and text that differ."""
    watched = ["file", "declaration", "context", "text"]
    rows = old.alias("a").join(new.alias("b"), F.col("a.block_id") == F.col("b.block_id"), "full_outer")
    differing = F.array_compact(F.array(*[F.when(F.col("a.block_id").isNotNull() & F.col("b.block_id").isNotNull() & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in watched]))
    change = F.when(F.col("a.block_id").isNull(), "added").when(F.col("b.block_id").isNull(), "removed").when(F.size("fields") > 0, "changed")
    return rows.withColumn("fields", differing).select(F.coalesce("a.block_id", "b.block_id").alias("block_id"), change.alias("change"), "fields").where("change is not null")
