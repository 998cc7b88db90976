"""Stores of results as Parquet: weights with what they were fitted for, metrics, statistics, and the status of stages."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import interpret
from voxloom.sources.volume_store import exists

#: The file that names the version that counts; not hidden, as Spark doesn't read names that begin with an underscore or a dot.
CURRENT = "CURRENT"
STATUS = "stage string, task_id string, status string, error string, seq long"


def write_weights(weights: DataFrame, path: str, **metadata: str | int | float) -> None:
    """Stores weights(rid, w1.., ...) under their metadata (fold, spacing, pulse and the like); those of the same metadata are replaced, others stay."""
    keyed = weights.withColumns({k: F.lit(v) for k, v in metadata.items()})
    keyed.write.partitionBy(*metadata).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_weights(spark: SparkSession, path: str, **metadata: str | int | float) -> DataFrame:
    """Stored weights with the metadata given; partitions are pruned."""
    out = spark.read.parquet(path)
    for name, value in metadata.items():
        out = out.where(F.col(name) == value)
    return out


def weight_analysis(weights: DataFrame, columns: list[str]) -> DataFrame:
    """weights with the array w, its entropy and the number of its first largest weight: recomputed when read, so that none can be out of date."""
    return weights.withColumn("w", F.array(*columns)).withColumns({"entropy": interpret.entropy(F.col("w")), "dominant": interpret.dominant(F.col("w"))})


def write_metrics(metrics: DataFrame, path: str, keys: tuple[str, ...] = ("model", "spacing", "pulse")) -> None:
    """The cube of metrics as a long table: one row for each patient, region, metric and statistic, partitioned by its conditions."""
    metrics.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str, meta: dict) -> None:
    """Result tables of one analysis and what it was run with, as a new version; readers see it when all of it is written.

    A version is a folder of its own; which one counts is said by one file, replaced by a rename. A writer that stops
    midway leaves the version before as it is. Versions before are kept, as readers may still be at them.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{path}/{version}/{name}")
    said = json.dumps({"version": version, "meta": meta | {"tables": sorted(tables)}}, sort_keys=True, default=str)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, current = hadoop.Path(f"{path}/_current_.{version}"), hadoop.Path(f"{path}/{CURRENT}")
    out = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(new, True)
    out.write(said.encode())
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, current, how)


def read_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of the version that counts, and what it was run with."""
    said = json.loads(spark.read.text(f"{path}/{CURRENT}").first().value)  # one line
    return {n: spark.read.parquet(f"{path}/{said['version']}/{n}") for n in said["meta"]["tables"]}, said["meta"]


class StatusLog:
    """What became of stages and tasks: rows are only added, so a run that ends halfway leaves the others' rows whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return self.spark.read.schema(STATUS).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], STATUS)

    def add(self, stage: str, task_id: str, status: str, error: str | None = None) -> None:
        seq = time.time_ns()  # no row is read for it, so two writers don't get in each other's way
        self.spark.createDataFrame([(stage, task_id, status, error, seq)], STATUS).coalesce(1).write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        """stage, task_id, status and error of each task's last row."""
        last = self.rows().groupBy("stage", "task_id").agg(F.max_by(F.struct("status", "error"), "seq").alias("l"))
        return last.select("stage", "task_id", "l.status", "l.error")

    def errors(self) -> DataFrame:
        """Every failure that was recorded, also those of tasks that were run again."""
        return self.rows().where("status = 'failed'").select("stage", "task_id", "error", "seq")
