"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_own: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with its file system; only a local session may leave it unset and gets one of its own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or _own.get(context.applicationId)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own[context.applicationId] = tempfile.mkdtemp(prefix="voxloom-")
    path = context._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voxloom-{uuid.uuid4().hex[:12]}-{name}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that this session's operators wrote; call it when their results are stored."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
