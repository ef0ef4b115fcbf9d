"""Tables that jobs keep between each other, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset and
    the master is local (tests), a temporary folder is used instead.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _local_dir()
    return found.rstrip("/")


_local: list[str] = []


def _local_dir() -> str:
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="stratalog-shared-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return "file://" + _local[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/stratalog-{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts lineage: a lost executor costs at most the stage in flight, and a
    table that is read several times is computed once.
    """
    spark = df.sparkSession
    path = path or scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
