"""Input tables and what the volume and experiment operators are bound to in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.sources.scratch import written

EXPERTS = ("e1", "e2", "e3", "e4")
#: A volume has DEPTH slices of ROWS lines of COLUMNS voxels; more lines are more volumes, never larger ones.
DEPTH, ROWS, COLUMNS = 10, 10, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean_of(h: Column, start: Column, n: int) -> Column:
    return F.aggregate(F.slice(h, start, n), F.lit(0.0), lambda a, v: a + v) / F.size(F.slice(h, start, n))


def volume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line (patient, z, y) of a volume: hr and the four experts' values as arrays along x."""
    e = table(spark, sf_dir, "embeddings")
    i, h = F.col("vec_id") % (DEPTH * ROWS), F.col("h")
    at = lambda k: F.get(h, k)
    lines = e.select(
        F.floor(F.col("vec_id") / (DEPTH * ROWS)).cast("int").alias("patient"), F.floor(i / ROWS).cast("int").alias("z"), (i % ROWS).cast("int").alias("y"),
        (F.col("label") % 4).cast("int").alias("seg"), F.col("embedding").cast("array<double>").alias("h"),
    )
    return lines.select(
        "patient", "z", "y", "seg", "h",
        F.transform(h, lambda v, k: _mean_of(h, k - k % 4 + 1, 4)).alias("e1"),
        F.transform(h, lambda v, k: (at(F.greatest(k - 1, F.lit(0))) + v + at(F.least(k + 1, F.lit(COLUMNS - 1)))) / 3).alias("e2"),
        F.transform(h, lambda v: F.round(v, 1)).alias("e3"),
        F.transform(h, lambda v: _mean_of(h, F.lit(1), COLUMNS)).alias("e4"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient, z, y, seg, hr, e1..e4: a row for each line, with its voxels' values as arrays."""
    return volume_rows(spark, sf_dir).withColumnRenamed("h", "hr")


def points(rows: DataFrame, arrays: list[str], *keep: str) -> DataFrame:
    """patient, z, y, x, keep... and the arrays' values: a row for each voxel of rows of lines, without a shuffle."""
    each = F.posexplode(F.arrays_zip(*arrays))
    return rows.select("patient", "z", "y", *keep, each.alias("x", "v")).select("patient", "z", "y", "x", *keep, *[f"v.{a}" for a in arrays])


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient, z, y, x, seg, hr, e1..e4: a row for each voxel. Experts are computed in the row of their line, without a shuffle."""
    return points(lines(spark, sf_dir), ["hr", *EXPERTS], "seg")


#: The same voxels in SQL, as the common table expression vox.
VOXELS_SQL = f"""
    line AS (SELECT vec_id // {DEPTH * ROWS} AS patient, vec_id % {DEPTH * ROWS} // {ROWS} AS z, vec_id % {ROWS} AS y, label % 4 AS seg, embedding AS h FROM embeddings),
    point AS (SELECT patient, z, y, seg, generate_subscripts(h, 1) - 1 AS x, unnest(h)::DOUBLE AS hr FROM line),
    vox AS (SELECT patient, z, y, x, seg, hr,
        avg(hr) OVER (PARTITION BY patient, z, y, x // 4) AS e1,
        (coalesce(lag(hr) OVER l, hr) + hr + coalesce(lead(hr) OVER l, hr)) / 3 AS e2,
        round(hr, 1) AS e3, avg(hr) OVER (PARTITION BY patient, z, y) AS e4
        FROM point WINDOW l AS (PARTITION BY patient, z, y ORDER BY x))"""


#: A task joins and sums about so many lines of an experiment, whatever their number.
TASK_ROWS = 500_000


def measured(spark: SparkSession, sf_dir: str, by: dict[str, Column] | None = None, values: tuple[str, ...] = ("psnr", "ssim")) -> DataFrame:
    """case_id, model, pulse, spacing, the columns of `by` and the means asked for, as a table in the shared folder: a row for each case and condition.

    It is written because its readers read it more than once, and its joins are most of their work. Both joins and the sums are
    dealt over as many tasks as the lines ask for, and lines, not partial sums of conditions of few lines, are sent to the sums.
    """
    by = by or {}
    items, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    n = max(1, -(-items.count() // TASK_ROWS))
    means = {"psnr": F.try_divide("l_extendedprice", "l_quantity"), "ssim": F.col("l_discount")}
    named = {"case_id": F.col("l_suppkey"), "pulse": F.col("l_returnflag"), **by}
    each = items.select("l_orderkey", "l_partkey", *[c.alias(k) for k, c in named.items()], *[means[v].alias(v) for v in values]).repartition(n, "l_orderkey")
    at = orders.select("o_orderkey", F.col("o_orderstatus").alias("spacing")).repartition(n, "o_orderkey")
    each = each.join(at.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")
    models = part.select("p_partkey", F.col("p_type").alias("model"))
    if part.count() > TASK_ROWS:
        each, models = each.repartition(n, "l_partkey"), models.repartition(n, "p_partkey").hint("merge")
    each = each.join(models, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
    keys = ["case_id", "model", "pulse", "spacing", *by]
    each = each.repartition(n, *keys)
    found = each.groupBy(*keys).agg(*[F.round(F.avg(v), 6).alias(v) for v in values]) if values else each.distinct()
    return written(found.select(*keys, *values), "metrics")


def metrics(spark: SparkSession, sf_dir: str, values: tuple[str, ...] = ("psnr", "ssim")) -> DataFrame:
    """case_id, model, pulse, spacing, psnr, ssim: one row for each case and condition, written once for all that read it."""
    return measured(spark, sf_dir, values=values)


METRICS_SQL = """
    m AS (SELECT l_suppkey AS case_id, p_type AS model, l_returnflag AS pulse, o_orderstatus AS spacing,
        round(avg(l_extendedprice / l_quantity), 6) AS psnr, round(avg(l_discount), 6) AS ssim
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient, kind, slot, ts, payload: what each patient has in the catalogue."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("patient"), F.col("event_type").alias("kind"), F.floor((F.dayofmonth("ts") - 1) / 8).cast("int").alias("slot"), "ts", "event_id", F.get_json_object("props", "$.k").cast("int").alias("payload"))


ARTEFACTS_SQL = """
    art AS (SELECT user_id AS patient, event_type AS kind, (day(ts) - 1) // 8 AS slot, ts, event_id, (props->>'$.k')::INTEGER AS payload FROM events)"""
