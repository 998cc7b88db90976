"""The stages of an experiment as DataFrame jobs: manifest, fit, evaluate, analyse. Each one's tables are stored, and a resumed run leaves out what is done."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import aggregate, coverage, ensemble, quality, stats, tiling
from voxloom.sources import results, volume_lines
from voxloom.sources.config import Config, manifest_problems, to_json
from voxloom.sources.tables import COLUMNS, DEPTH, ROWS, lines, metrics, points

SHAPE = (DEPTH, ROWS, COLUMNS)


@dataclass(frozen=True)
class Run:
    spark: SparkSession
    config: Config
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def lines(self) -> DataFrame:
        """The volumes' lines, of the store or of the tables."""
        c = self.config
        if not c.store:
            return lines(self.spark, c.data)
        return volume_lines.bound(volume_lines.read(self.spark, c.store), c.fit.experts, spacing=c.spacings[0], pulse=c.pulses[0], labels=c.labels)

    def shape(self) -> tuple[int, int, int]:
        return tiling.shape_of_lines(self.lines(), "hr") if self.config.store else SHAPE


@dataclass(frozen=True)
class Stage:
    """tasks names what it has to do; do(run, task) makes one task's table, which is stored as `name` with the task as a partition."""

    name: str
    tasks: Callable[[Config], list[str]]
    do: Callable[[Run, str], DataFrame]


def manifest(run: Run, task: str) -> DataFrame:
    units = run.lines().select("patient").distinct()
    made = coverage.manifest(coverage.kfold(units, "patient", run.config.folds, F.xxhash64("patient")), "patient")
    if found := manifest_problems(made, "patient"):
        raise ValueError("; ".join(found))
    return made


def fit(run: Run, task: str) -> DataFrame:
    c, fold = run.config.fit, int(task.removeprefix("fold"))
    train = run.read("manifest").where(f"fold = {fold} AND split = 'train'").select("patient")
    rows = run.lines().join(train, "patient", "left_semi")
    return ensemble.fit(rows, c.grid(run.shape()), list(c.experts), ridge=c.ridge, tau=c.tau, edge=c.edge, gradient=c.gradient).withColumn("fold", F.lit(fold))


def evaluate(run: Run, task: str) -> DataFrame:
    c, fold = run.config.fit, int(task.removeprefix("fold"))
    test = run.read("manifest").where(f"fold = {fold} AND split = 'test'").select("patient")
    rows, shape = run.lines().join(test, "patient", "left_semi"), run.shape()
    weights = run.read("fit").where(F.col("fold") == fold)
    made = ensemble.blend_entry(rows, weights, c.grid(shape), list(c.experts), c.taper)
    return ensemble.evaluate(made, "hr", "blend", shape).withColumn("fold", F.lit(fold))


def predict(run: Run, fold: int, everyone: bool = False) -> None:
    """Blends the store's experts by the fold's weights and puts the blends into the store, as kind blend, model fold<n>, with the truth's geometry."""
    c, rows = run.config, run.lines()
    if not everyone:
        rows = rows.join(run.read("manifest").where(f"fold = {fold} AND split = 'test'").select("patient"), "patient", "left_semi")
    made = ensemble.blend_entry(rows, run.read("fit").where(F.col("fold") == fold), c.fit.grid(run.shape()), list(c.fit.experts), c.fit.taper)
    like = volume_lines.volumes(volume_lines.read(run.spark, c.store, kind="hr", pulse=c.pulses[0]))
    volume_lines.put(volume_lines.unbound(made, "blend", like, "blend", f"fold{fold}", c.spacings[0], c.pulses[0]), c.store)


def compared(m: DataFrame, metric: str, baseline: str) -> DataFrame:
    """pulse, spacing, model: the paired Wilcoxon test of each model's metric against the baseline's, adjusted by Holm's method within pulse and spacing."""
    pairs = stats.paired(m, metric, "case_id", "model", baseline, ["pulse", "spacing"])
    return stats.adjust(stats.wilcoxon(pairs, ["pulse", "spacing", "model"], with_p=True), "p", "holm", ["pulse", "spacing"], ["model"])


def store_metrics(run: Run) -> DataFrame:
    """case_id, model, pulse, spacing and psnr of the experts over all patients, and of the blends as evaluated."""
    c, each = run.config, points(run.lines(), ["hr", *run.config.fit.experts])
    parts = [quality.errors(each, "hr", e, ["patient"]).select("patient", F.lit(e).alias("model"), "psnr") for e in c.fit.experts]
    rows = run.read("evaluate").select("patient", F.lit("blend").alias("model"), "psnr")
    for p in parts:
        rows = rows.union(p)
    return rows.select(F.col("patient").alias("case_id"), "model", F.lit(c.pulses[0]).alias("pulse"), F.lit(c.spacings[0]).alias("spacing"), "psnr")


def analyse(run: Run, task: str) -> DataFrame:
    if run.config.store:
        return compared(store_metrics(run), "psnr", run.config.baseline or run.config.fit.experts[0])
    m = metrics(run.spark, run.config.data).where(F.col("spacing").isin(*run.config.spacings) & F.col("pulse").isin(*run.config.pulses))
    base = run.config.baseline or m.agg(F.min("model")).first()[0]
    return compared(m, "psnr", base)


def summarise(run: Run, task: str) -> DataFrame:
    per = run.read("evaluate").groupBy("fold").agg(*[F.avg(c).alias(c) for c in ("mse", "mae", "psnr", "ssim")])
    return aggregate.over_folds(per.withColumn("all", F.lit("all")), ["all"], ["mse", "mae", "psnr", "ssim"]).drop("all")


def _folds(c: Config) -> list[str]:
    return [f"fold{k + 1}" for k in range(c.folds)]


STAGES = [Stage("manifest", lambda c: ["all"], manifest), Stage("fit", _folds, fit), Stage("evaluate", _folds, evaluate), Stage("analyse", lambda c: ["all"], analyse), Stage("summarise", lambda c: ["all"], summarise)]


def planned(config: Config, done: DataFrame | None = None, stages: list[Stage] = STAGES) -> list[tuple[str, str, str]]:
    """(stage, task, 'run' or 'skip') in order: what a run would do, without any job but for reading what is done."""
    finished = set() if done is None else {(r.stage, r.task_id) for r in done.where("status = 'completed'").collect()}  # a row for each task of the list below
    return [(s.name, t, "skip" if (s.name, t) in finished else "run") for s in stages for t in s.tasks(config)]


def run(spark: SparkSession, config: Config, folder: str, resume: bool = True, dry: bool = False, stages: list[Stage] = STAGES) -> list[tuple[str, str, str]]:
    """Runs the stages' tasks that are not done, in order; returns the plan. A task that fails is recorded and ends the run; a resumed one starts there.

    A task's table replaces its own partition, so that a task that ended halfway is simply run again.
    """
    log = results.StatusLog(spark, f"{folder}/status")
    plan = planned(config, log.latest() if resume else None, stages)
    if dry:
        return plan
    by_name, job = {s.name: s for s in stages}, Run(spark, config, folder)
    for name, task, what in plan:
        if what == "skip":
            continue
        log.add(name, task, "in_progress")
        try:
            table = by_name[name].do(job, task).withColumn("task", F.lit(task))
            table.write.partitionBy("task").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(job.path(name))
        except Exception as e:
            log.add(name, task, "failed", f"{type(e).__name__}: {str(e)[:500]}")
            raise
        log.add(name, task, "completed")
    spark.createDataFrame([(to_json(config),)], "config string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")
    return plan


def folder_for(spark: SparkSession, out: str, name: str, resume: bool, stamp: bool = True) -> str:
    """The folder of a run: with resume the latest of its name that has a status, else a new one with the time in its name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if resume and store.exists(path):
        found = [f.getPath() for f in store.listStatus(path) if f.getPath().getName() == name or f.getPath().getName().startswith(f"{name}-")]
        found = [p for p in found if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "status"))]
        if found:
            return max(found, key=lambda p: p.getName()).toString()
    return f"{out}/{name}-{time.strftime('%Y%m%d-%H%M%S')}" if stamp else f"{out}/{name}"
