"""Normalisers of voxel values: statistics by volume, applied to every voxel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import order

EPS = 1e-8


def zscore_params(voxels: DataFrame, value: str = "hr", mask: Column | None = None, keys: tuple[str, ...] = ("patient",)) -> DataFrame:
    """keys..., mean and std (population, at least EPS) over the masked voxels."""
    rows = voxels if mask is None else voxels.where(mask)
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(EPS)).alias("std"))


def zscore(voxels: DataFrame, params: DataFrame, value: str, keys: tuple[str, ...] = ("patient",)) -> DataFrame:
    return voxels.join(params, list(keys)).withColumn(value, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def inverse_zscore(voxels: DataFrame, params: DataFrame, value: str, keys: tuple[str, ...] = ("patient",)) -> DataFrame:
    return voxels.join(params, list(keys)).withColumn(value, F.col(value) * F.col("std") + F.col("mean")).drop("mean", "std")


def _scaled(v: Column, low: Column, high: Column, floor: float = 0.0) -> Column:
    """(v - low) / (high - low), clipped to 0..1; 0 where the range is no larger than floor."""
    return F.when(high - low > floor, F.least(F.greatest(F.try_divide(v - low, high - low), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def minmax(voxels: DataFrame, value: str, keys: tuple[str, ...] = ("patient",)) -> DataFrame:
    ends = voxels.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return voxels.join(ends, list(keys)).withColumn(value, _scaled(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def robust(voxels: DataFrame, value: str, keys: tuple[str, ...] = ("patient",), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rescales percentiles low..high to 0..1 and clips; by minimum and maximum where those meet, to 0 where these do too."""
    ends = voxels.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    ends = order.beside(ends, order.quantiles(voxels, value, list(keys), [low, high], ["_p0", "_p1"]), list(keys))
    flat = F.col("_p1") <= F.col("_p0")
    lo, hi = F.when(flat, F.col("_lo")).otherwise(F.col("_p0")), F.when(flat, F.col("_hi")).otherwise(F.col("_p1"))
    return voxels.join(ends, list(keys)).withColumn(value, _scaled(F.col(value), lo, hi)).drop("_p0", "_p1", "_lo", "_hi")


def normalize_pair(voxels: DataFrame, a: str, b: str, how: str = "none") -> DataFrame:
    """Both columns of a pair by name of the normaliser: none, minmax, robust or zscore."""
    if how not in ("none", "minmax", "robust", "zscore"):
        raise ValueError(f"unknown normaliser {how}")
    for value in (a, b) if how != "none" else ():
        voxels = {"minmax": minmax, "robust": robust}[how](voxels, value) if how != "zscore" else zscore(voxels, zscore_params(voxels, value), value)
    return voxels


def crop_border(voxels: DataFrame, shape: tuple[int, int, int], border: int) -> DataFrame:
    inside = [F.col(a).between(border, n - 1 - border) for a, n in zip("zyx", shape, strict=True)]
    return voxels.where(inside[0] & inside[1] & inside[2])


def z_window(voxels: DataFrame, low: int = 15, high: int = 140) -> DataFrame:
    return voxels.where(F.col("z").between(low, high))
