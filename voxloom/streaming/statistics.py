"""Normal equations kept up to date as volumes arrive: they are sums, so a stream of new patients only adds to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxloom.operators.stacking import normal_equations
from voxloom.operators.tiling import Grid


def running_equations(stream: DataFrame, grid: Grid, experts: list[str]) -> DataFrame:
    """A streaming table of each tile's sums over all voxel rows that came so far; write it in update or complete mode."""
    return normal_equations(stream.withColumn("rid", grid.label()).where("rid >= 0"), experts, where=F.col("hr") > 0)


def arrivals(stream: DataFrame, time: str, window: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by event-time window; rows later than `late` are dropped and closed windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))


def store(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Writes each trigger's whole result over the last one; rerun batches give the same table."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
