"""Tiles of a volume: labels, boxes, coverage, neighbours and tapers, as expressions of the voxel's place."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


@dataclass(frozen=True)
class Grid:
    """Tiles of size patch every stride along z, y and x; the last ones are cut at the volume's end."""

    shape: tuple[int, int, int]
    patch: tuple[int, int, int]
    stride: tuple[int, int, int]

    @property
    def counts(self) -> tuple[int, int, int]:
        return tuple(math.ceil(n / s) for n, s in zip(self.shape, self.stride, strict=True))

    def rid(self, cz: Column, cy: Column, cx: Column) -> Column:
        _, ny, nx = self.counts
        return ((cz * ny + cy) * nx + cx).cast("int")

    def label(self) -> Column:
        """The last tile that covers a voxel, counted along z, y, x; -1 where tiles leave gaps."""
        cells = [F.floor(F.col(a) / s).cast("int") for a, s in zip(AXES, self.stride, strict=True)]
        inside = [F.col(a) - c * s < p for a, c, s, p in zip(AXES, cells, self.stride, self.patch, strict=True)]
        return F.when(inside[0] & inside[1] & inside[2], self.rid(*cells)).otherwise(F.lit(-1))

    def boxes(self, spark: SparkSession) -> DataFrame:
        """rid, cell and box (z0, z1, y0, y1, x0, x1) of each tile."""
        if 0 in self.counts:
            return spark.createDataFrame([], "rid int, cz int, cy int, cx int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
        out = spark.range(1).select(*[F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(f"c{a}") if a == "z" else F.lit(n).alias(f"n{a}") for a, n in zip(AXES, self.counts, strict=True)])
        for a in ("y", "x"):
            out = out.withColumn(f"c{a}", F.explode(F.sequence(F.lit(0), F.col(f"n{a}") - 1)))
        ends = [c for a, n, s, p in zip(AXES, self.shape, self.stride, self.patch, strict=True) for c in ((F.col(f"c{a}") * s).alias(f"{a}0"), F.least(F.col(f"c{a}") * s + p, F.lit(n)).alias(f"{a}1"))]
        return out.select(self.rid(F.col("cz"), F.col("cy"), F.col("cx")).alias("rid"), "cz", "cy", "cx", *ends)

    def covering(self, axis: int) -> Column:
        """The numbers of the tiles along an axis that cover a voxel, as an array."""
        a, s, p, n = F.col(AXES[axis]), self.stride[axis], self.patch[axis], self.counts[axis]
        last = F.least(F.floor(a / s), F.lit(n - 1)).cast("int")
        first = F.greatest(F.lit(0), F.floor((a - p) / s) + 1).cast("int")
        return F.filter(F.sequence(F.least(first, last), last), lambda k: a < k * s + p)

    def covered(self, voxels: DataFrame) -> DataFrame:
        """voxels with a row for each covering tile: rid and w3, the tile's taper at the voxel."""
        for i, a in enumerate(AXES):
            voxels = voxels.withColumn(f"k{a}", F.explode(self.covering(i)))
        return voxels.withColumn("rid", self.rid(F.col("kz"), F.col("ky"), F.col("kx")))

    def taper(self, kind: str = "hann") -> Column:
        """The product of the tile's tapers along each axis (columns kz, ky, kx): periodic Hann of the tile's own, possibly cut, side; else flat."""
        if kind != "hann":
            return F.lit(1.0)
        out = F.lit(1.0)
        for i, a in enumerate(AXES):
            start = F.col(f"k{a}") * self.stride[i]
            side = F.least(start + self.patch[i], F.lit(self.shape[i])) - start
            out = out * F.when(side == 1, 1.0).otherwise(0.5 - 0.5 * F.cos(2 * math.pi * (F.col(a) - start) / side))
        return out

    def adjacency(self, spark: SparkSession) -> DataFrame:
        """(rid, nbr), both ways, of tiles whose labels touch; for patch >= stride."""
        cells = self.boxes(spark).select("rid", "cz", "cy", "cx")
        steps = F.array(*[F.struct(*[F.lit(d * (b == a)).alias(f"d{b}") for b in AXES]) for a in AXES for d in (-1, 1)])
        moved = cells.withColumn("d", F.explode(steps)).select("rid", *[(F.col(f"c{a}") + F.col(f"d.d{a}")).alias(f"c{a}") for a in AXES])
        inside = [F.col(f"c{a}").between(0, n - 1) for a, n in zip(AXES, self.counts, strict=True)]
        return moved.where(inside[0] & inside[1] & inside[2]).select("rid", self.rid(F.col("cz"), F.col("cy"), F.col("cx")).alias("nbr"))


def shape_of(voxels: DataFrame) -> tuple[int, int, int]:
    """The common shape of the volumes: one row to the driver."""
    row = voxels.agg(*[F.max(a) for a in AXES]).first()
    return tuple((v if v is not None else -1) + 1 for v in row)


def shape_of_lines(lines: DataFrame, value: str) -> tuple[int, int, int]:
    """The common shape of volumes kept as lines: one row to the driver."""
    row = lines.agg(F.max("z"), F.max("y"), F.max(F.size(value))).first()
    return tuple((v if v is not None else -1) + 1 for v in row[:2]) + (row[2] or 0,)


def expand_weights(voxels: DataFrame, weights: DataFrame, grid: Grid, m: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """voxels with w, their tile's weight vector; uniform where the tile has none."""
    labelled = voxels.withColumn("rid", grid.label())
    return labelled.join(weights, [*keys, "rid"], "left").withColumn("w", F.coalesce("w", F.array(*[F.lit(1.0 / m)] * m)))
