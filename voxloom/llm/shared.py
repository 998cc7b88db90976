"""What the operators of this subpackage share: the shared folder, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts have it, and what `normalised` rewrites: runs that are not already one space.
SPACE = r"[\x20\x09-\x0D]+"
NOT_ONE_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

_written: list[str] = []
_own: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, with its file system.

    Only a local session may do without the setting; it then gets a folder of its own.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or _own.get(context.applicationId)
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own[context.applicationId] = tempfile.mkdtemp(prefix="voxloom-")
    path = context._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for one run's table or files; nothing is there yet."""
    path = f"{shared_dir(spark)}/voxloom-{uuid.uuid4().hex[:12]}-{name}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables and files that this session's operators wrote; call it when their results are stored."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def normalised(column: str) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), NOT_ONE_SPACE, " ")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) of every node in edges (a, b); root is the smallest node that can be reached.

    Large-star and small-star rounds by turns: each links nodes to the smallest node
    known, and ends when nothing changes. Minima are pre-aggregated and joined back, so
    that a node with very many neighbours is neither collected nor held by one task.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large star: larger neighbours of a node link to the smallest of its neighbours and itself
        near = both(e)
        least = written(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # a plain side, so that a hot node's join can be split
        e = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        linked = e.join(least, "a")
        e = written(linked.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
