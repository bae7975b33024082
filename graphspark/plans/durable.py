"""Cutting lineage by tables in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ours: dict[str, str] = {}  # by application: the folder of its tables


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share, of this application's own: it goes when the driver ends.

    It lies in ``spark.checkpoint.dir``; where that is unset, in the warehouse, or for a local master in a
    temporary folder.
    """
    context = spark.sparkContext
    if context.applicationId not in _ours:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base and context.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="graphspark-")
        _ours[context.applicationId] = f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/graphspark-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_clear, spark, _ours[context.applicationId])
    return _ours[context.applicationId]


def _clear(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended before
        pass


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def persisted(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(out)
    found = spark.read.schema(df.schema).parquet(out)
    found._stored = out
    return found


def drop(*frames: DataFrame) -> None:
    """Deletes the tables of frames made by :func:`persisted` that nothing reads any more."""
    for df in frames:
        if getattr(df, "_stored", None):
            remove(df.sparkSession, df._stored)


def numbered(df: DataFrame, name: str, *by) -> DataFrame:
    """``df`` written down with a column that numbers its rows from 0 on, in the order of ``by`` if given.

    Partitions number their own rows; only their counts reach the driver.
    """
    df = persisted((df.orderBy(*by) if by else df).withColumn(name, F.monotonically_increasing_id()), "rows")
    counts = df.groupBy(F.shiftright(name, 33).alias("part")).count().orderBy("part").collect()  # a row for each partition
    base, at = [], 0
    for r in counts:
        base.append((r["part"], at))
        at += r["count"]
    offsets = df.sparkSession.createDataFrame(base, "part long, base long")
    placed = df.join(F.broadcast(offsets), F.shiftright(name, 33) == F.col("part"))  # a row for each partition
    return placed.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("base")).drop("part", "base")
