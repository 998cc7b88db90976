"""Summaries of metric tables: by condition, over several grains, against a method, and the Pareto front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import order


def summary(rows: DataFrame, keys: list[str], values: list[str], spread=F.stddev_samp, median: bool = False) -> DataFrame:
    """keys..., mean and spread of each value, its exact median if asked for, and n rows."""
    out = rows.groupBy(*keys).agg(*[c for v in values for c in (F.avg(v).alias(f"{v}_mean"), spread(v).alias(f"{v}_std"))], F.count("*").alias("n"))
    for v in values if median else ():
        out = order.beside(out, order.quantiles(rows, v, keys, [0.5], [f"{v}_median"]), keys)
    return out


def with_every_group(summed: DataFrame, dims: list[DataFrame], keys: list[str], count: str = "n") -> DataFrame:
    """summed with a row for every combination of the dimensions' values, counts of missing ones 0. Dimensions are short lists."""
    every = dims[0]
    for d in dims[1:]:
        every = every.join(d)
    return every.join(summed, keys, "left").fillna(0, [count])


def multi_grain(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """grain, a, b, mean, std (population), min, max and n by (a, b), a, b and overall: one pass with grouping sets."""
    cube = rows.cube(a, b).agg(F.grouping_id().alias("g"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))
    grain = F.when(F.col("g") == 0, f"{a}_{b}").when(F.col("g") == 1, a).when(F.col("g") == 2, b).otherwise("overall")
    return cube.select(grain.alias("grain"), a, b, "mean", "std", "min", "max", "n")


def gains(means: DataFrame, target: Column | str, keys: list[str], values: list[str], side: str = "model") -> DataFrame:
    """keys..., other_model, each value's mean of target and other, and their difference."""
    t = means.where(F.col(side) == target).select(*keys, *[F.col(v).alias(f"{v}_target") for v in values])
    o = means.where(F.col(side) != target).select(*keys, F.col(side).alias("other_model"), *[F.col(v).alias(f"{v}_other") for v in values])
    return o.join(t, keys).select("*", *[(F.col(f"{v}_target") - F.col(f"{v}_other")).alias(f"delta_{v}") for v in values])


def gain_levels(gain: DataFrame, a: str, b: str, deltas: list[str]) -> DataFrame:
    """level, a, b, other_model and mean deltas for (a, other), (b, other) and other alone."""
    cube = gain.cube(a, b, "other_model").agg(F.grouping_id().alias("g"), *[F.avg(d).alias(d) for d in deltas])
    level = F.when(F.col("g") == 2, a).when(F.col("g") == 4, b).when(F.col("g") == 6, "overall")
    return cube.select(level.alias("level"), a, b, "other_model", *deltas).where("level IS NOT NULL")


def pareto_front(points: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """The rows that no row of their group beats: none is at most as large in both and smaller in one. A skyline by one sort, not a self-join."""
    before = Window.partitionBy(*keys).orderBy(x, y).rowsBetween(Window.unboundedPreceding, -1)
    best = points.select(*keys, x, y).distinct().withColumn("_b", F.min(y).over(before)).where(F.col("_b").isNull() | (F.col(y) < F.col("_b"))).drop("_b")
    return points.join(best, [*keys, x, y], "left_semi")


def mean_of_means(rows: DataFrame, side: str, cells: list[str], values: list[str]) -> DataFrame:
    """side, mean and sample spread over its cells' means."""
    inner = rows.groupBy(side, *cells).agg(*[F.avg(v).alias(v) for v in values])
    return inner.groupBy(side).agg(*[c for v in values for c in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))], F.count("*").alias("n_cells"))


def to_long(rows: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """ids..., metric, value: finite ones only."""
    return rows.unpivot(ids, values, "metric", "value").where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < 1.7976931348623157e308")


def to_wide(rows: DataFrame, unit: list[str], side: str, sides: list[str], value: str) -> DataFrame:
    """A row for each unit that has every side, with the mean of each in its column."""
    return rows.groupBy(*unit).pivot(side, sides).agg(F.avg(value)).na.drop(subset=sides)


def box(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys..., quartiles and whiskers (the outermost values within 1.5 interquartile ranges)."""
    j = order.beside(rows, order.quantiles(rows, value, keys, [0.25, 0.5, 0.75], ["q1", "q2", "q3"]), keys)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return j.groupBy(*keys, "q1", "q2", "q3").agg(F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value))).alias("low"), F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value))).alias("high"))


def best_and_worst(rows: DataFrame, unit: str, value: str, keys: list[str]) -> DataFrame:
    """keys..., the units with the highest and the lowest mean; the smaller id wins a tie."""
    per = rows.groupBy(*keys, unit).agg(F.round(F.avg(value), 6).alias("v"))
    return per.groupBy(*keys).agg(F.max_by(unit, F.struct("v", -F.col(unit))).alias("best"), F.min_by(unit, F.struct("v", unit)).alias("worst"), F.max("v").alias("best_value"), F.min("v").alias("worst_value"))


def flagged(rows: DataFrame, keys: list[str], values: list[str], flag: Column) -> DataFrame:
    """keys..., each value's mean, and is_target: a condition on the keys."""
    return rows.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values]).withColumn("is_target", flag)


def by_metric(rows: DataFrame, ids: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """keys..., metric, mean, std (sample; 0 of a single value), median and n of the values that are numbers; metrics without any are left out."""
    long, each = to_long(rows, ids, values), [*keys, "metric"]
    s = long.groupBy(*each).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    return order.beside(s, order.quantiles(long, "value", each, [0.5], ["median"]), each)


def over_folds(folds: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys..., metric, mean, std (population) and n_folds of a table with a row for each fold."""
    long = folds.unpivot([*keys, "fold"], values, "metric", "value").where("value IS NOT NULL")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n_folds"))


def row_mean(columns: list[str]) -> Column:
    """The mean of a row's columns that are numbers; null without any."""
    known = F.filter(F.array(*columns), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known))


def renamed(rows: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """rows with aliases in a column brought to one name."""
    return rows.replace(names, subset=[column])


def require_columns(rows: DataFrame, *columns: str) -> DataFrame:
    """rows, or an error before any job if a column is missing."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return rows
