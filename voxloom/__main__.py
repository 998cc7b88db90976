"""Command line: python -m voxloom list | run | explain | stages | manifest | ingest | export | predict | analyse."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from voxloom import stages
from voxloom.plans import catalogue
from voxloom.sources import config, volume_lines, volume_store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxloom")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="the queries")
    for name, text in (("run", "store a query's rows as Parquet"), ("explain", "show a query's plan")):
        one = sub.add_parser(name, help=text)
        one.add_argument("query", choices=sorted(catalogue.QUERIES), metavar="QUERY")
        one.add_argument("--data", required=True, help="folder of the tables")
        if name == "run":
            one.add_argument("--out", required=True)
    many = sub.add_parser("stages", help="run an experiment's stages")
    many.add_argument("--config", help="JSON, TOML or YAML")
    many.add_argument("--data")
    many.add_argument("--out", required=True)
    many.add_argument("--name", default="experiment")
    many.add_argument("--folds", type=int)
    many.add_argument("--spacings", nargs="+")
    many.add_argument("--pulses", nargs="+")
    many.add_argument("--resume", action=argparse.BooleanOptionalAction, default=True)
    many.add_argument("--dry-run", action="store_true", help="say what would be done")
    many.add_argument("--no-timestamp", action="store_true")
    listed = sub.add_parser("manifest", help="show the folds' manifest of a run as JSON")
    listed.add_argument("--folder", required=True)
    taken = sub.add_parser("ingest", help="add files of volumes to a store")
    taken.add_argument("--files", required=True, help="folder of .nii, .nii.gz, .npy and .npz files")
    taken.add_argument("--store", required=True)
    taken.add_argument("--kind", required=True, help="hr, expert or labels")
    taken.add_argument("--model")
    taken.add_argument("--spacing", default="3mm")
    taken.add_argument("--pattern", default=volume_lines.PATTERN, help="its groups are the patient and the pulse")
    made = sub.add_parser("predict", help="blend stored experts by a run's weights and store the blends")
    made.add_argument("--config", required=True)
    made.add_argument("--folder", required=True, help="the run's folder")
    made.add_argument("--fold", type=int, required=True)
    made.add_argument("--all", action="store_true", help="all patients, not only those that the fold tests")
    held = sub.add_parser("analyse", help="compare models by stored metrics, pair by pair")
    held.add_argument("--metrics", required=True, help="Parquet table: case_id, model, pulse, spacing and metrics")
    held.add_argument("--metric", default="psnr")
    held.add_argument("--baseline", required=True)
    held.add_argument("--out", required=True)
    files = sub.add_parser("export", help="write stored volumes as NIfTI files")
    files.add_argument("--store", required=True)
    files.add_argument("--out", required=True)
    files.add_argument("--overwrite", action="store_true")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("voxloom").getOrCreate()
    if a.command == "run":
        catalogue.QUERIES[a.query](spark, a.data).write.mode("overwrite").parquet(a.out)
    elif a.command == "explain":
        catalogue.QUERIES[a.query](spark, a.data).explain("formatted")
    elif a.command == "stages":
        changes = {"data": a.data, "folds": a.folds, "spacings": a.spacings and tuple(a.spacings), "pulses": a.pulses and tuple(a.pulses), "out": a.out}
        c = config.load(a.config, **changes) if a.config else config.from_dict({k: v for k, v in changes.items() if v is not None})
        folder = stages.folder_for(spark, a.out, a.name, a.resume, not a.no_timestamp)
        for stage, task, what in stages.run(spark, c, folder, a.resume, a.dry_run):
            print(f"{what}\t{stage}\t{task}")
    elif a.command == "manifest":
        rows = spark.read.parquet(f"{a.folder}/manifest")
        print(volume_store.manifest_json(rows.withColumnRenamed("patient", "patient_id")))
    elif a.command == "ingest":
        for row in volume_lines.ingest(spark, a.files, a.store, a.kind, a.model, a.spacing, a.pattern).groupBy("state").count().orderBy("state").collect():
            print(f"{row.state}\t{row['count']}")
    elif a.command == "predict":
        stages.predict(stages.Run(spark, config.load(a.config), a.folder), a.fold, a.all)
    elif a.command == "analyse":
        stages.compared(spark.read.parquet(a.metrics), a.metric, a.baseline).write.mode("overwrite").parquet(a.out)
    else:
        volume_lines.write_files(volume_lines.read(spark, a.store), a.out, a.overwrite)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
