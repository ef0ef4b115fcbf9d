"""Shared helpers: tables, the shared folder, shipping the package, word patterns."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialise, scratch  # noqa: F401  (used by the operators from here)

#: Runs of anything but space, tab, LF, VT, FF and CR are words.
WORD_BREAK = r"[\x20\x09-\x0D]+"
BREAK_CHARS = " \t\n\x0b\x0c\r"

_shipped: set[str] = set()


#: Files of fewer bytes than this may be one row group, which one task reads alone.
SMALL = 32 << 20
#: Tasks that write a table, and bytes of input for each further one.
TASKS, TASK_BYTES = 12, 2 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of ``df`` as Spark estimates them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one is dealt out, so that all cores work on it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(parallelism(spark)) if size_of(df) < SMALL else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    home = tempfile.mkdtemp(prefix="stratalog-ship-")
    archive = os.path.join(home, "stratalog_src.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    atexit.register(shutil.rmtree, home, True)
    _shipped.add(app)


def unpacked(columns: list[str], **replaced):
    """Columns of a struct column ``row``, some replaced."""
    return [replaced.get(c, F.col("row").getField(c)).alias(c) for c in columns]


def words_of(text):
    """Column of the words of a text column; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    return F.array_remove(parts, "")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(df: DataFrame) -> int:
    """How many tasks at most write what is made of ``df``, for ``coalesce``.

    It follows the input, not the number of shuffle partitions: for every file in a local folder an
    executor starts several processes, and tables of a few rows a task were mostly that.
    """
    return min(TASKS + size_of(df) // TASK_BYTES, 1 << 20)


def release() -> None:
    """Gives freed memory back to the system, which the C library and Arrow keep for the process otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in glibc
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; a worker outlives its task, so what the task has freed is given back at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


class Remembered(dict):
    """Results of a function of a word, for the words met lately.

    Holds at most twice ``limit`` words: when ``limit`` new ones have come, what
    was not asked for since the last such time is forgotten.  Words over 64
    characters are not kept.
    """

    def __init__(self, function, limit: int):
        super().__init__()
        self.function, self.limit, self.before = function, limit, {}

    def __missing__(self, word):
        found = self.before.get(word)
        if found is None:
            found = self.function(word)
            if len(word) > 64:
                return found
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[word] = found
        return found
