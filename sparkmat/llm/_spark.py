"""Materialisation in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local temporary folder only in local mode where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkmat-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: While a table is written: Spark removes a query's shuffle files when it has ended, not when the driver happens to
#: collect garbage, and what goes to a Python worker at once is bounded in bytes, not in rows only.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and lost executors lose nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = {name: spark.conf.get(name) for name in _WHILE_WRITING}
    try:
        for name, value in _WHILE_WRITING.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkmat_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove what ``stage`` wrote; nothing may read it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._sparkmat_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the named columns only, so extra columns never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


#: Bytes of a broadcast table at most; a row is counted as ``ROW_BYTES`` and 8 for each column, which is what the hash
#: table of a broadcast join was measured to take. More rows go through a shuffled join.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 32


def bounded(table: DataFrame) -> DataFrame:
    """``table`` (written, of numbers or short names), to be broadcast if its number of rows allows it."""
    return F.broadcast(table) if table.count() * (ROW_BYTES + 8 * len(table.columns)) <= BROADCAST_BYTES else table
