"""Volumes with their geometry, as lines: a data source of files, a partitioned store, and what fit, blend and evaluate read from it.

A line (t, z, y) has the voxels along a volume's third axis as the array `values`; z and y are its first and second axis,
t its fourth (0 where it has none). Each line carries the volume's shape, affine (16 numbers by rows) and attributes.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from voxloom.sources.scratch import written
from voxloom.sources.volume_store import KEY, exists, open_array, write_nifti

PATTERN = r"([^/]+)-([^/.-]+)\.(?:nii|nii\.gz|npy|npz)$"
_LINE = "t int, z int, y int, values array<float>, shape array<int>, affine array<double>, attributes map<string,string>"
FILE_SCHEMA = f"path string, patient_id string, pulse string, {_LINE}, error string"
STORE_SCHEMA = (
    T.StructType().add("patient_id", "string").add("t", "integer").add("z", "integer").add("y", "integer").add("values", T.ArrayType(T.FloatType())).add("shape", T.ArrayType(T.IntegerType()))
    .add("affine", T.ArrayType(T.DoubleType())).add("attributes", T.MapType(T.StringType(), T.StringType())).add("kind", "string").add("model", "string").add("spacing", "string").add("pulse", "string")
)
_ARROW = pa.schema([
    ("path", pa.string()), ("patient_id", pa.string()), ("pulse", pa.string()), ("t", pa.int32()), ("z", pa.int32()), ("y", pa.int32()), ("values", pa.list_(pa.float32())),
    ("shape", pa.list_(pa.int32())), ("affine", pa.list_(pa.float64())), ("attributes", pa.map_(pa.string(), pa.string())), ("error", pa.string()),
])


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system that a URI or an absolute path names, and the path in it."""
    return arrow_fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, str, str]]  # path, patient, pulse


class VolumeReader(DataSourceReader):
    """A partition for each file (filesPerPartition to change it); conditions on patient_id, pulse and path choose files before any is opened."""

    def __init__(self, options: dict):
        self.root, self.given = options.get("path", ""), options.get("paths")
        self.pattern = re.compile(options.get("pattern", PATTERN))
        self.headers = str(options.get("headers", "false")).lower() == "true"
        self.each = int(options.get("filesPerPartition", 1))
        self.only: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in ("path", "patient_id", "pulse"):
                self.only.append((name, frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def _listed(self) -> list[str]:
        if self.given is not None:
            return json.loads(self.given)
        files, at = _opened(self.root)
        scheme = self.root.split("://")[0] + "://" if "://" in self.root else ""
        found = files.get_file_info(arrow_fs.FileSelector(at, recursive=True))
        return [scheme + f.path for f in found if f.is_file and "/.staging-" not in f.path]

    def partitions(self) -> Sequence[InputPartition]:
        chosen = []
        for path in sorted(self._listed()):
            if m := self.pattern.search(path):
                row = {"path": path, "patient_id": m[1], "pulse": m[2]}
                if all(row[name] in allowed for name, allowed in self.only):
                    chosen.append((path, m[1], m[2]))
        return [Files(chosen[i : i + self.each]) for i in range(0, len(chosen), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, patient, pulse in partition.paths:
            try:
                files, at = _opened(path)
                with files.open_input_file(at) as f:
                    array = open_array(path, f.read())
                if not 1 <= array.raw.ndim <= 4 or 0 in array.raw.shape:
                    raise ValueError(f"a volume of shape {array.raw.shape}")
            except Exception as e:  # noqa: BLE001  a broken file is a row of the result, not the end of the job
                yield self._batch(path, patient, pulse, [None], [None], [None], [None], None, None, None, f"{type(e).__name__}: {e}")
                continue
            v = array.raw.reshape(array.raw.shape + (1,) * (3 - array.raw.ndim))
            facts = (list(v.shape), array.affine.ravel().tolist(), array.attributes)
            if self.headers:
                yield self._batch(path, patient, pulse, [None], [None], [None], [None], *facts, None)
                continue
            for t in range(v.shape[3] if v.ndim == 4 else 1):
                for z in range(v.shape[0]):  # a slice at a time
                    part = array.scaled(v[z, :, :, t] if v.ndim == 4 else v[z])
                    ends = pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32())
                    rows = pa.ListArray.from_arrays(ends, pa.array(part.ravel(), pa.float32()))
                    yield self._batch(path, patient, pulse, [t] * len(part), [z] * len(part), list(range(len(part))), rows, *facts, None)

    @staticmethod
    def _batch(path, patient, pulse, t, z, y, values, shape, affine, attributes, error) -> pa.RecordBatch:
        n = len(y)
        columns = [[path] * n, [patient] * n, [pulse] * n, t, z, y, values, [shape] * n, [affine] * n, [None if attributes is None else list(attributes.items())] * n, [error] * n]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # staged, final


class VolumeWriter(DataSourceArrowWriter):
    """NIfTI files of lines that come volume by volume. Tasks write below a staging folder; the commit renames what they report, an abort deletes it all."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _opened(self.root)
        attempt, out = uuid.uuid4().hex, []
        key, volume, seen, facts = None, None, None, None

        def close() -> None:
            if key is None or volume is None:
                return
            if not seen.all():
                raise ValueError(f"volume {key} has {seen.sum()} of {seen.size} lines")
            kind, model, spacing, patient, pulse = key
            name = posixpath.join(*[p for p in (kind, model, spacing) if p], f"{patient}-{pulse}.nii.gz")
            staged = f"{root}/{self.staging}/{attempt}/{name}"
            files.create_dir(posixpath.dirname(staged), recursive=True)
            with files.open_output_stream(staged, compression=None) as f:
                f.write(write_nifti(volume, facts[0], attributes=facts[1]))
            out.append((staged, f"{root}/{name}"))

        for batch in iterator:
            for r in batch.to_pylist():
                found = (r["kind"], r["model"], r["spacing"], r["patient_id"], r["pulse"])
                if found != key:
                    close()
                    key, seen = found, np.zeros([n for i, n in enumerate(r["shape"]) if i != 2], bool)
                    facts = (np.eye(4) if r["affine"] is None else np.array(r["affine"]).reshape(4, 4), dict(r["attributes"] or {}))
                    kept = not self.overwrite and files.get_file_info(f"{root}/{posixpath.join(*[p for p in found[:3] if p], f'{found[3]}-{found[4]}.nii.gz')}").type != arrow_fs.FileType.NotFound
                    volume = None if kept else np.zeros(r["shape"], np.float32)
                if volume is not None:
                    z, y, t = r["z"], r["y"], r["t"]
                    line = (z, y, t) if volume.ndim == 4 else (z, y)
                    if seen[line]:
                        raise ValueError(f"volume {key} repeats line {line}")
                    seen[line] = True
                    volume[(z, y, slice(None), t) if volume.ndim == 4 else (z, y)] = r["values"]
        close()
        return Staged(out)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _opened(self.root)
        for m in messages:
            for staged, final in m.files if m else ():
                files.create_dir(posixpath.dirname(final), recursive=True)
                files.move(staged, final)
        self._clear(files, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.root))

    def _clear(self, files: arrow_fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.staging}").type != arrow_fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.staging}")


class VolumeFiles(DataSource):
    """spark.read.format("volumes").load(folder) of .nii, .nii.gz, .npy and .npz files, as lines."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema: T.StructType) -> VolumeReader:
        return VolumeReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeFiles)


def read_files(spark: SparkSession, path: str | list[str], pattern: str = PATTERN, headers: bool = False) -> DataFrame:
    """FILE_SCHEMA of the files below a folder, or of those listed, whose path matches: patient_id and pulse are the pattern's groups.

    A file that can't be read, is empty or has over four axes gives one row, with its error. headers gives one row a file, without
    voxels. The folder, with its URI, is one that executors share; a folder without files gives no rows. Files without an affine have the identity.
    """
    register(spark)
    source = spark.read.format("volumes").option("pattern", pattern).option("headers", str(headers).lower())
    return source.option("paths", json.dumps(path)).load() if isinstance(path, list) else source.load(path)


def write_files(lines: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Each volume of lines (STORE_SCHEMA) as folder/kind/model/spacing/patient-pulse.nii.gz, null parts left out, with its affine and attributes.

    All files appear at the commit, or none where a task fails. A volume that lacks a line or repeats one fails the write. Files that are there
    stay unless overwrite. One volume at a time is in a task.
    """
    register(lines.sparkSession)
    rows = lines.select([F.col(f.name).cast(f.dataType) for f in STORE_SCHEMA])
    order = [*KEY, "patient_id"]
    rows.repartition(*order).sortWithinPartitions(*order, "t", "z", "y").write.format("volumes").mode("overwrite" if overwrite else "append").save(folder)


# ---- the store


def read(spark: SparkSession, store: str, **key: str) -> DataFrame:
    """Lines (STORE_SCHEMA) of the volumes with the key given; partitions are pruned. A store that isn't there has none."""
    out = spark.read.schema(STORE_SCHEMA).parquet(store) if exists(spark, store) else spark.createDataFrame([], STORE_SCHEMA)
    for name, value in key.items():
        out = out.where(F.col(name) == value)
    return out


def volumes(lines: DataFrame) -> DataFrame:
    """kind, model, spacing, pulse, patient_id, shape, affine and attributes of each volume, from its first line; no voxel is read."""
    return lines.where("t = 0 AND z = 0 AND y = 0").select(*KEY, "patient_id", "shape", "affine", "attributes")


def _stored(rows: DataFrame, store: str, mode: str) -> None:
    rows = rows.select([F.col(f.name).cast(f.dataType) for f in STORE_SCHEMA])
    rows.repartition(*KEY, "patient_id").sortWithinPartitions("patient_id", "t", "z", "y").write.partitionBy(*KEY).mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(store)


def put(lines: DataFrame, store: str) -> None:
    """Stores volumes; one with the key and patient of a stored volume replaces it whole, the others stay.

    lines is read twice. The partitions that change are written to the shared folder first, then swapped in by Spark's dynamic overwrite.
    """
    spark = lines.sparkSession
    if not exists(spark, store):
        return _stored(lines, store, "append")
    same = lambda names: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    keys = lines.select(*KEY, "patient_id").distinct()
    touched = read(spark, store).alias("a").join(keys.select(*KEY).distinct().alias("b"), same(KEY), "left_semi")
    kept = touched.alias("a").join(keys.alias("b"), same((*KEY, "patient_id")), "left_anti")
    whole = kept.unionByName(lines.select([F.col(f.name).cast(f.dataType) for f in STORE_SCHEMA]))
    return _stored(written(whole, "volumes"), store, "overwrite")


def ingest(spark: SparkSession, path: str, store: str, kind: str, model: str | None = None, spacing: str = "3mm", pattern: str = PATTERN, wanted: DataFrame | None = None) -> DataFrame:
    """Adds to the store the files' volumes that it lacks; returns (patient_id, pulse, state): stored, skipped, missing (of wanted(patient_id, pulse)) or the error.

    Files of volumes that are stored already are not opened. Of several files of one patient and pulse, the first by path counts.
    """
    register(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where(F.col("path").rlike(pattern))
    listed = found.select("path", F.regexp_extract("path", pattern, 1).alias("patient_id"), F.regexp_extract("path", pattern, 2).alias("pulse")).groupBy("patient_id", "pulse").agg(F.min("path").alias("path"))

    def there() -> DataFrame:
        rows = read(spark, store, kind=kind, spacing=spacing)
        rows = rows.where(F.col("model").eqNullSafe(F.lit(model)))
        return volumes(rows).select("patient_id", "pulse")

    before = written(there(), "there")  # what the store had before this call
    names = ["patient_id", "pulse"]
    report = listed.join(before, names, "left_semi").select(*names, F.lit("skipped").alias("state"))
    paths = [r.path for r in listed.join(before, names, "left_anti").select("path").collect()]  # the paths of the files of one call
    if paths:
        lines = read_files(spark, paths, pattern).where("error IS NULL")
        _stored(lines.withColumns({"kind": F.lit(kind), "model": F.lit(model), "spacing": F.lit(spacing)}), store, "append")
        new = listed.join(before, names, "left_anti")
        done = new.join(there(), names, "left_semi").select(*names, F.lit("stored").alias("state"))
        broken = [r.path for r in new.join(there(), names, "left_anti").select("path").collect()]
        report = report.union(done)
        if broken:
            report = report.union(read_files(spark, broken, pattern).where("error IS NOT NULL").select(*names, F.col("error").alias("state")))
    if wanted is not None:
        report = report.union(wanted.join(listed, names, "left_anti").join(before, names, "left_anti").select(*names, F.lit("missing").alias("state")))
    return report


# ---- for fit, blend and evaluate


def bound(lines: DataFrame, experts: Sequence[str], truth: str = "hr", kind: str = "expert", spacing: str | None = None, pulse: str | None = None, labels: str | None = None) -> DataFrame:
    """patient, z, y, seg, hr and each expert's array: what ensemble.fit, blend_entry and evaluate take.

    lines are stored ones. The truth is the volume of kind `truth` (of any spacing: it is stored once), an expert the one of kind `kind` whose model
    has its name. labels names the kind of a label volume, whose middle voxel labels its line; without one seg is 0. Patients that
    lack a volume, or whose volumes differ in shape or have a fourth axis, are left out. One shuffle of the lines, none of voxels.
    """
    rows = lines if pulse is None else lines.where(F.col("pulse") == pulse)
    role = F.when(F.col("kind") == truth, "hr")
    of = (F.col("kind") == kind) & F.col("model").isin(*experts)
    role = role.when(of if spacing is None else of & (F.col("spacing") == spacing), F.col("model"))
    role = role if labels is None else role.when(F.col("kind") == labels, "seg")
    rows = rows.withColumn("role", role).where("role IS NOT NULL")
    names = ["hr", *experts, *(["seg"] if labels else [])]
    each = rows.where("t = 0 AND z = 0 AND y = 0").groupBy("patient_id").agg(F.count("*").alias("n"), F.countDistinct("role").alias("roles"), F.countDistinct("shape").alias("shapes"), F.max(F.size("shape")).alias("axes"))
    whole = each.where((F.col("n") == len(names)) & (F.col("roles") == len(names)) & (F.col("shapes") == 1) & (F.col("axes") == 3))
    one = rows.join(whole, "patient_id", "left_semi").groupBy(F.col("patient_id").alias("patient"), "z", "y")
    out = one.agg(*[F.first(F.when(F.col("role") == n, F.col("values")), ignorenulls=True).alias(n) for n in names])
    seg = F.get("seg", F.floor(F.size("seg") / 2).cast("int")).cast("int") if labels else F.lit(0)
    return out.select("patient", "z", "y", seg.alias("seg"), *[F.col(n).cast("array<double>").alias(n) for n in ("hr", *experts)])


def unbound(made: DataFrame, column: str, like: DataFrame, kind: str, model: str | None, spacing: str | None, pulse: str | None) -> DataFrame:
    """Lines to store of made's array `column` (patient, z, y): the geometry is that of like's volumes (volumes(...)), one for each patient_id."""
    facts = like.select("patient_id", "shape", "affine", "attributes")
    rows = made.withColumn("patient_id", F.col("patient").cast("string")).join(facts, "patient_id")
    lit = lambda v: F.lit(v).cast("string")
    return rows.select("patient_id", F.lit(0).alias("t"), "z", "y", F.col(column).cast("array<float>").alias("values"), "shape", "affine", "attributes", lit(kind).alias("kind"), lit(model).alias("model"), lit(spacing).alias("spacing"), lit(pulse).alias("pulse"))
