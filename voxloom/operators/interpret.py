"""What weight vectors say: spread, entropy, dominance and specialisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, v: a + v)


def entropy(w: Column, floor: float = 1e-10) -> Column:
    """-sum p ln(p + floor), p being w over its sum."""
    return F.aggregate(w, F.lit(0.0), lambda a, v: a - v / (_total(w) + floor) * F.log(v / (_total(w) + floor) + floor))


def dominant(w: Column) -> Column:
    """The number, from 0, of the first largest weight."""
    return F.array_position(w, F.array_max(w)).cast("int") - 1


def dominance(weights: DataFrame) -> DataFrame:
    """dominant, n: how many tiles each expert leads."""
    return weights.groupBy(dominant(F.col("w")).alias("dominant")).agg(F.count("*").alias("n"))


def specialization(w: Column, m: int, floor: float = 1e-8) -> Column:
    """1 - the mean entropy over ln m: 0 for uniform weights, 1 where one expert does all; 1 for a single expert."""
    if m == 1:
        return F.lit(1.0)
    h = F.aggregate(w, F.lit(0.0), lambda a, v: a - v * F.log(v + floor))
    return 1 - F.avg(h / math.log(m))


def by_expert(weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys..., expert (from 0), mean, std (population), min, max, median and quartiles of its weights."""
    keys = keys or []
    each = weights.select(*keys, F.posexplode("w").alias("expert", "v"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = each.groupBy(*keys, "expert").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), q.alias("q"))
    return s.select(*keys, "expert", "mean", "std", "min", "max", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
