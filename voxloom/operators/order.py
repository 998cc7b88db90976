"""Order statistics of groups of any size: running sums, average ranks and exact quantiles.

A group is cut into ranges of its order, so that no task holds a whole one: rows are dealt by
range and written, each range is summed, and what comes before a row is the sum of the ranges
before its own and of the rows before it in its own. Equal values are summed first, so that a
value shared by very many rows is one row here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.sources.scratch import written


def running(rows: DataFrame, keys: list[str], order: list[str], *weights: str, names: list[str] | None = None) -> DataFrame:
    """rows with before_<weight> for each weight: its sum over the rows of the same keys that come earlier in `order`, nulls first.

    `order` tells the rows of one key apart; null keys are a group of their own, null weights add nothing.
    An empty table gives no rows. Columns called _range, _<k> or before_<weight> are the operator's own.
    """
    names = names or [f"before_{w}" for w in weights]
    of_range = [F.sum(w).alias(f"_{i}") for i, w in enumerate(weights)]
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(*of_range)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = written(sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_{i}").over(earlier), F.lit(0)).alias(f"_{i}") for i in range(len(weights))]), "starts")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # rows of one range
    own = dealt.withColumns({n: F.coalesce(F.sum(w).over(inside), F.lit(0)) for n, w in zip(names, weights, strict=True)})
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), *[f"_{i}" for i in range(len(weights))])
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = own.join(starts, same)
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"_{i}")).alias(n) for i, n in enumerate(names)])


def ranked(rows: DataFrame, value: str, keys: list[str], *sums: tuple[str, F.Column]) -> DataFrame:
    """keys..., value, n, rank and named sums: a row for each value of each key, with how many rows have it and the average rank that they share.

    Ranks count from 1 by ascending value; null values have none and are left out. An empty table gives no rows.
    """
    ties = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in sums])
    counted = running(ties, keys, [value], "n", names=["_before"])
    return counted.select(*ties.columns, (F.col("_before") + (F.col("n") + 1) / 2.0).alias("rank"))


def quantiles(rows: DataFrame, value: str, keys: list[str], shares: list[float], names: list[str]) -> DataFrame:
    """keys..., and the exact quantiles of the values under `names`, interpolated between neighbours as Spark's percentile does.

    The two order statistics of each share are looked up among running counts of distinct values. Null values don't
    count; a key without any value has nulls; an empty table gives no rows.
    """
    known = rows.where(F.col(value).isNotNull())
    ties = known.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    counted = running(ties, keys, ["_v"], "_n", names=["_before"])
    total = ties.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    keyed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    j = counted.join(total.select(*keyed, "_total"), same)
    place = [F.lit(float(s)) * (F.col("_total") - 1) for s in shares]
    at = lambda p: F.max(F.when((F.col("_before") <= p) & (p < F.col("_before") + F.col("_n")), F.col("_v")))
    found = j.groupBy(*keys, "_total").agg(*[at(f(p)).alias(f"_{side}{i}") for i, p in enumerate(place) for side, f in (("lo", F.floor), ("hi", F.ceil))])

    def between(i: int):
        p, lo, hi = place[i], F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    out = found.select(*keys, *[between(i).alias(n) for i, n in enumerate(names)])
    every = rows.groupBy(*keys).agg(F.count(value).alias("_n")).where("_n = 0").select(*keys, *[F.lit(None).cast("double").alias(n) for n in names])
    return out.unionByName(every)


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right, which has a row for each of left's keys at most; null keys are the same."""
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(named, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
