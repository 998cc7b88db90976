"""Volumes as a partitioned Parquet table, and the files that they come from and go to."""

from __future__ import annotations

import gzip
import io
import json
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("kind", "model", "spacing", "pulse")
SCHEMA = T.StructType(
    [T.StructField("patient_id", T.StringType()), T.StructField("z", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("value", T.FloatType())]
    + [T.StructField(k, T.StringType()) for k in KEY]
)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_volumes(volumes: DataFrame, path: str) -> None:
    """Overwrites the partitions (kind, model, spacing, pulse) that volumes has, and leaves the others."""
    volumes = volumes.select([F.col(f.name).cast(f.dataType) for f in SCHEMA])
    volumes.repartition(*KEY, "patient_id").sortWithinPartitions("patient_id", "z", "y", "x").write.partitionBy(*KEY).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path)


def read_volumes(spark: SparkSession, path: str, **key: str) -> DataFrame:
    """Voxels of the volumes with the key given; partitions are pruned."""
    out = spark.read.schema(SCHEMA).parquet(path)
    for name, value in key.items():
        out = out.where(F.col(name) == value)
    return out


def keyspace(volumes: DataFrame) -> DataFrame:
    """Each stored volume's key as a path: kind/model/spacing/patient/pulse, null parts left out."""
    path = F.concat_ws("/", "kind", "model", "spacing", "patient_id", "pulse")
    return volumes.select(*KEY, "patient_id", path.alias("path")).distinct()


def key_of(*parts: str) -> Column:
    return F.concat_ws("/", *parts)


# ---- decoding files

_DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: The kind of header extension that holds plain text.
_COMMENT = 6


@dataclass(frozen=True)
class Opened:
    """A file's array as it is stored, how to scale it, its affine and its attributes."""

    raw: np.ndarray
    affine: np.ndarray
    attributes: dict[str, str]
    slope: float = 1.0
    shift: float = 0.0

    def scaled(self, part: np.ndarray) -> np.ndarray:
        part = np.ascontiguousarray(part, np.float32)
        return part if self.slope == 1 and not self.shift else part * np.float32(self.slope) + np.float32(self.shift)


def _affine_of(data: bytes, order: str, shape: tuple[int, ...]) -> np.ndarray:
    """The s-form's rows, else the q-form's rotation, else voxel sizes about the middle with the first axis turned."""
    qform, sform = struct.unpack(order + "2h", data[252:256])
    affine, sizes = np.eye(4), np.array(struct.unpack(order + "4f", data[76:92]))
    if sform > 0:
        affine[:3] = np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4)
    elif qform > 0:
        b, c, d, *origin = struct.unpack(order + "6f", data[256:280])
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine[:3, :3] = turn * sizes[1:] * [1, 1, -1 if sizes[0] < 0 else 1]
        affine[:3, 3] = origin
    else:
        steps = np.where(sizes[1:] == 0, 1, sizes[1:]) * [-1, 1, 1]
        affine[:3, :3], affine[:3, 3] = np.diag(steps), -steps * (np.array(shape[:3]) - 1) / 2
    return affine


def _attributes_of(data: bytes, order: str, end: int) -> dict[str, str]:
    """The JSON object in a text extension of the header, if there is one; other extensions are passed over."""
    at = 352
    while len(data) > 348 and data[348] and at + 8 <= end:
        size, code = struct.unpack(order + "2i", data[at : at + 8])
        if size < 8:
            break
        if code == _COMMENT:
            try:
                found = json.loads(data[at + 8 : at + size].rstrip(b"\0"))
                if isinstance(found, dict):
                    return {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in found.items()}
            except ValueError:
                pass
        at += size
    return {}


def open_nifti(data: bytes) -> Opened:
    """A NIfTI-1 file, its values as they are stored."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", data[40:56])
    code, offset = struct.unpack(order + "h", data[70:72])[0], int(struct.unpack(order + "f", data[108:112])[0])
    slope, shift = struct.unpack(order + "2f", data[112:120])
    shape = dim[1 : 1 + max(3, dim[0])]
    values = np.frombuffer(data, np.dtype(_DTYPES[code]).newbyteorder(order), int(np.prod(shape)), offset).reshape(shape, order="F")
    known = np.isfinite(slope) and slope != 0  # else the values are not scaled
    return Opened(values, _affine_of(data, order, shape), _attributes_of(data, order, offset), slope if known else 1.0, shift if known and np.isfinite(shift) else 0.0)


def read_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A NIfTI-1 file's values as float32 (z, y, x), scaled, and its affine."""
    found = open_nifti(data)
    return found.scaled(found.raw), found.affine


def write_nifti(values: np.ndarray, affine: np.ndarray, compress: bool = True, attributes: dict[str, str] | None = None) -> bytes:
    """A NIfTI-1 file of up to seven axes; attributes go to a text extension of its header, as JSON."""
    affine = np.asarray(affine, float)
    text = json.dumps(attributes, sort_keys=True).encode() if attributes else b""
    extension = struct.pack("<2i", -(-(len(text) + 8) // 16) * 16, _COMMENT) + text if text else b""
    extension += b"\0" * (-len(extension) % 16)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<4f", head, 76, 1, *np.linalg.norm(affine[:3, :3], axis=0))
    struct.pack_into("<3f", head, 108, 352 + len(extension), 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    head[348] = 1 if extension else 0
    out = bytes(head) + extension + values.astype("<f4").tobytes(order="F")
    return gzip.compress(out, mtime=0) if compress else out


def open_array(path: str, data: bytes) -> Opened:
    """The array in a .nii, .nii.gz, .npy or .npz file (arr, or else the first); without geometry the affine is the identity."""
    if path.endswith((".nii", ".nii.gz")):
        return open_nifti(data)
    if path.endswith(".npy"):
        return Opened(np.load(io.BytesIO(data)), np.eye(4), {})
    if path.endswith(".npz"):
        found = np.load(io.BytesIO(data))
        affine = np.asarray(found["affine"], float).reshape(4, 4) if "affine" in found else np.eye(4)
        return Opened(found["arr"] if "arr" in found else found[found.files[0]], affine, {})
    raise ValueError(f"unknown format of {path}")


def decode(path: str, data: bytes) -> np.ndarray:
    """The values in a .nii, .nii.gz, .npy or .npz file, NIfTI's scaled."""
    found = open_array(path, data)
    return found.scaled(found.raw) if path.endswith((".nii", ".nii.gz")) else found.raw


def read_arrays(spark: SparkSession, path: str | list[str], pattern: str = r"([^/]+)-([^/.-]+)\.(?:nii|nii\.gz|npy|npz)$") -> DataFrame:
    """path, patient_id, pulse, t, z, y, x, value and error: a row for each voxel of each file whose name matches; a file that can't be read gives one row with its error."""
    from voxloom.sources.volume_lines import read_files

    lines = read_files(spark, path, pattern)
    return lines.select("path", "patient_id", "pulse", "t", "z", "y", F.posexplode_outer("values").alias("x", "value"), "error").withColumn("value", F.col("value").cast("double"))


def export_plan(volumes: DataFrame, folds: DataFrame) -> DataFrame:
    """The keys of what is exported: the truth once, experts for each spacing, and a blend from the fold that tests its patient. folds: patient_id, fold; volumes' blends have the fold in `model`."""
    keys = volumes.select(*KEY, "patient_id").distinct().join(folds, "patient_id", "left")
    blend = (F.col("kind") != "blend") | (F.col("model") == F.concat(F.lit("fold"), F.col("fold").cast("string")))
    return keys.where(blend).drop("fold")


def load_oriented(values: np.ndarray, affine: np.ndarray, wanted: str = "LPS", like: tuple[np.ndarray, tuple[int, int, int]] | None = None, order: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A volume with its axes along the wanted directions, resampled to another's grid (affine, shape) if given, and its affine."""
    from voxloom.operators import geometry

    if like is not None:
        values, affine = geometry.resample(values, affine, like[0], like[1], order), like[0]
    along, positive, world = geometry.orientation(affine), {"R": 1, "L": -1, "A": 1, "P": -1, "S": 1, "I": -1}, {"R": 0, "L": 0, "A": 1, "P": 1, "S": 2, "I": 2}
    axes = [along[world[c]] for c in wanted]
    out, turned = values.transpose([v for v, _ in axes]), np.eye(4)
    turned[:3, :3], turned[:3, 3] = affine[:3, [v for v, _ in axes]], affine[:3, 3]
    for i, (c, (_, sign)) in enumerate(zip(wanted, axes, strict=True)):
        if sign != positive[c]:
            turned[:3, 3] += turned[:3, i] * (out.shape[i] - 1)
            turned[:3, i] *= -1
            out = np.flip(out, i)
    return out, turned


# ---- tables with columns known only when read


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV files with a header: of the schema given, or as text by name, columns that a file lacks null."""
    if schema:
        return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    out = None
    for one in [path] if isinstance(path, str) else path:
        rows = spark.read.csv(one, header=True)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_wide_csv(spark: SparkSession, path: str, name: str = "subject") -> DataFrame:
    """patient_id, column, value of CSV files with a name column and any numeric ones; suffixes of files and text that is no number are dropped."""
    raw = spark.read.csv(path, header=True)
    first = name if name in raw.columns else raw.columns[0]
    values = [c for c in raw.columns if c != first]
    long = raw.unpivot([first], values, "column", "_v")
    return long.select(F.regexp_replace(F.element_at(F.split(first, "/"), -1), r"\.(nii(\.gz)?|npz|npy)$", "").alias("patient_id"), "column", F.expr("try_cast(_v AS double)").alias("value")).where("value IS NOT NULL")


def write_csv(df: DataFrame, path: str, *partition_by: str) -> None:
    (df.write.partitionBy(*partition_by) if partition_by else df.coalesce(1).write).mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """fold (from 1), split, patient_id of a JSON document {"folds": [{"train": [...], "test": [...]}]}."""
    folds = spark.read.json(path, multiLine=True).select(F.posexplode("folds").alias("fold", "f"))
    parts = [folds.select((F.col("fold") + 1).alias("fold"), F.lit(s).alias("split"), F.explode(f"f.{s}").alias("patient_id")) for s in ("train", "test")]
    return parts[0].union(parts[1])


def manifest_json(manifest: DataFrame) -> str:
    """The same document of a manifest table: patients' ids, a short list."""
    rows = manifest.groupBy("fold", "split").agg(F.array_sort(F.collect_list("patient_id")).alias("ids")).orderBy("fold").collect()
    folds: dict[int, dict[str, list]] = {}
    for r in rows:
        folds.setdefault(r.fold, {"train": [], "test": []})[r.split] = r.ids
    return json.dumps({"folds": [folds[k] for k in sorted(folds)]}, indent=2)


def latex_table(summary: DataFrame, row: str, column: str, mean: str, std: str) -> str:
    """A booktabs table of mean and spread of a summary's few cells; --- where a cell is missing."""
    cells = {(r[0], r[1]): (r[2], r[3]) for r in summary.select(row, column, mean, std).collect()}
    rows, columns = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
    show = lambda k: "---" if k not in cells or cells[k][0] is None else f"{cells[k][0]:.4f} $\\pm$ {cells[k][1] or 0:.4f}"
    body = [" & ".join([str(r), *[show((r, c)) for c in columns]]) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{l" + "c" * len(columns) + "}", r"\toprule", " & ".join(["", *map(str, columns)]) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
