"""Catalogue queries: what is there, what is missing, who is complete, how folds and shards are dealt."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete(have: DataFrame, unit: str, key: list[str], required: int | None = None) -> DataFrame:
    """Units that have every key: relational division by counting distinct keys; by default every key that any unit has."""
    distinct = have.select(unit, *key).distinct()
    if required is None:
        required = distinct.select(*key).distinct().count()
    return distinct.groupBy(unit).agg(F.count("*").alias("n")).where(F.col("n") == required).select(unit)


def incomplete(have: DataFrame, unit: str, key: list[str]) -> DataFrame:
    """Units that lack keys that others have: unit, have and missing."""
    distinct = have.select(unit, *key).distinct()
    wanted = distinct.select(*key).distinct().count()
    return distinct.groupBy(unit).agg(F.count("*").alias("have")).where(F.col("have") < wanted).withColumn("missing", F.lit(wanted) - F.col("have"))


def covered_units(results: DataFrame, labels: DataFrame, unit: str, key: list[str]) -> DataFrame:
    """Units that have labels and every key of the results."""
    return complete(results, unit, key).join(labels.select(unit).distinct(), unit, "left_semi")


def replicated(reference: DataFrame, column: str, values: list[str]) -> DataFrame:
    """reference once for each value of a short list, in its column."""
    return reference.withColumn(column, F.explode(F.array(*map(F.lit, values))))


def spacing_of(label: str) -> Column:
    """The number in a label like '3mm'; null for another form."""
    return F.expr(f"try_cast(regexp_extract({label}, '^([0-9]+)mm$', 1) AS int)")


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a finished result: what a resumed run has left to do."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def present(tasks: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.join(inputs.select(*keys).distinct(), keys, "left_semi")


def task_grid(*dims: DataFrame) -> DataFrame:
    """Every combination of short lists, with its task_id."""
    grid = dims[0]
    for d in dims[1:]:
        grid = grid.join(d)
    return grid.withColumn("task_id", F.concat_ws("_", *[F.col(c).cast("string") for c in grid.columns]))


def first_fold(rows: DataFrame, key: list[str], fold: str = "fold") -> DataFrame:
    return rows.groupBy(*key).agg(F.min(fold).alias(fold))


def by_priority(candidates: DataFrame, key: list[str], path: str, priority: str) -> DataFrame:
    """The path of the first pattern that found anything, for each key."""
    return candidates.groupBy(*key).agg(F.min_by(path, F.struct(priority, path)).alias(path))


def resolved(units: DataFrame, sequences: DataFrame, listing: DataFrame, template: str, allow_missing: bool = True) -> DataFrame:
    """case, seq and path of a template like '{case}_{seq}.nii.gz' for each pair of short lists that a listing(path) has; else a missing one is an error."""
    path = F.replace(F.replace(F.lit(template), F.lit("{case}"), F.col("case")), F.lit("{seq}"), F.col("seq"))
    wanted = units.join(sequences).withColumn("path", path)
    found = wanted.join(listing.select("path", F.lit(True).alias("_there")), "path", "left")
    if allow_missing:
        return found.where("_there").select("case", "seq", "path")
    return found.select("case", "seq", F.when(F.col("_there"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("missing: "), "path"))).alias("path"))


def triplets(truth: DataFrame, labels: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., and the paths of cases that all three listings have."""
    named = [d.select(*keys, F.col("path").alias(n)) for d, n in ((truth, "truth_path"), (labels, "label_path"), (made, "made_path"))]
    return named[0].join(named[1], keys).join(named[2], keys)


def kfold(units: DataFrame, unit: str, k: int, order: Column) -> DataFrame:
    """unit, fold: contiguous blocks of the order given, of sizes (n + i) div k. Units are patients: their number fits one window."""
    n = units.count()
    if n < k:
        raise ValueError(f"{n} units can't fill {k} folds")
    ends, total = [], 0
    for i in range(k):
        total += (n + i) // k
        ends.append(total)
    place = F.row_number().over(Window.orderBy(order, unit))
    fold = F.lit(None).cast("int")
    for i, end in reversed(list(enumerate(ends))):
        fold = F.when(F.col("_p") <= end, i + 1).otherwise(fold)
    return units.select(unit).withColumn("_p", place).select(unit, fold.alias("fold"))


def manifest(folds: DataFrame, unit: str) -> DataFrame:
    """fold, split, unit: each fold's own units test, all others train."""
    numbers = folds.select(F.col("fold").alias("of")).distinct()
    return folds.join(numbers).select(F.col("of").alias("fold"), F.when(F.col("fold") == F.col("of"), "test").otherwise("train").alias("split"), unit)


def shards(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """rows with shard, dealt in turn by their order. A row number over range partitions: only counts by partition meet."""
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.withColumn("_i", inside).join(before.select("_part", "_b"), "_part").withColumn("shard", ((F.col("_i") + F.col("_b") - 1) % n).cast("int")).drop("_part", "_i", "_b")


def merge_shards(main: DataFrame, shard_rows: DataFrame, key: list[str], shard: str = "shard") -> DataFrame:
    """main and those shard rows that it lacks; of several shards' rows of a key, the first shard's. Columns are main's."""
    first = shard_rows.groupBy(*key).agg(F.min_by(F.struct(*main.columns), shard).alias("_r")).select("_r.*")
    return main.unionByName(first.join(main.select(*key).distinct(), key, "left_anti").select(*main.columns))


def progress(tasks: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    states = ("pending", "in_progress", "completed", "failed")
    return tasks.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in states])


def sanity(rows: DataFrame, value: str, keys: list[str], low: float, high: float) -> DataFrame:
    """keys..., n, share of nulls and NaN, and how many values are out of range."""
    missing = F.col(value).isNull() | F.isnan(value)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(missing.cast("double")).alias("missing_share"), F.count_if(~missing & ~F.col(value).between(low, high)).alias("out_of_range"))


def config_hash(config: dict) -> str:
    """The first 16 hexadecimal digits of SHA-256 over the configuration as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]
