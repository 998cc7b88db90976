"""Orientation, alignment and where things are in a volume."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators import order
from voxloom.sources.scratch import written

AXES = ("z", "y", "x")


def orientation(affine: np.ndarray) -> list[tuple[int, int]]:
    """For each world axis, the voxel axis that runs along it and its direction (1 or -1); greedy by the largest part."""
    m = np.abs(np.asarray(affine, float)[:3, :3])
    out: list[tuple[int, int]] = [(0, 0)] * 3
    left_world, left_voxel = set(range(3)), set(range(3))
    while left_world:
        w, v = max(((w, v) for w in left_world for v in left_voxel), key=lambda p: m[p])
        out[w] = (v, 1 if np.asarray(affine)[w, v] >= 0 else -1)
        left_world.remove(w)
        left_voxel.remove(v)
    return out


def reorient(voxels: DataFrame, affine: np.ndarray, shape: tuple[int, int, int], wanted: str = "RAS") -> DataFrame:
    """voxels with coordinates along the wanted directions: a projection of the old ones, without a shuffle."""
    positive = {"R": 1, "L": -1, "A": 1, "P": -1, "S": 1, "I": -1}
    world = {"R": 0, "L": 0, "A": 1, "P": 1, "S": 2, "I": 2}
    along = orientation(affine)
    new = {}
    for name, letter in zip(AXES, wanted, strict=True):
        v, sign = along[world[letter]]
        old = F.col(AXES[v])
        new[name] = old if sign == positive[letter] else F.lit(shape[v] - 1) - old
    return voxels.select(*[new[c].cast("int").alias(c) if c in new else F.col(c) for c in voxels.columns])


def crop_to_common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The voxels that both volumes have, from the corner: an inner join on coordinates."""
    return a.join(b, [*keys, *AXES])


def pad_to_both(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The voxels that either volume has, zero where it lacks them: a full join."""
    return a.join(b, [*keys, *AXES], "full").fillna(0, values)


def fit_to_shape(voxels: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int], keys: list[str], values: list[str], centre: bool = False) -> DataFrame:
    """keys..., z, y, x and values on a target shape: cut or filled with zeros at the far ends, or at both ends alike if centre."""
    offsets = [(t - n) // 2 if centre else 0 for n, t in zip(shape, target, strict=True)]
    moved = voxels.select(*keys, *[(F.col(a) + o).cast("int").alias(a) for a, o in zip(AXES, offsets, strict=True)], *values)
    every = voxels.select(*keys).distinct()
    for a, n in zip(AXES, target, strict=True):
        every = every.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return every.join(moved, [*keys, *AXES], "left").fillna(0, values)


def shape_gaps(a: DataFrame, b: DataFrame, keys: list[str], tolerance: int = 2) -> DataFrame:
    """keys..., the largest difference of a side between two volumes' shapes, and whether it is within the tolerance; null where one is missing."""
    ends = lambda df, p: df.groupBy(*keys).agg(*[(F.max(c) + 1).alias(f"{p}{c}") for c in AXES])
    both = ends(a, "a").join(ends(b, "b"), keys, "full")
    gap = F.when(F.col("az").isNotNull() & F.col("bz").isNotNull(), F.greatest(*[F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in AXES]))
    return both.select(*keys, gap.cast("int").alias("gap"), (gap <= tolerance).alias("fits"))


def apply_mask(voxels: DataFrame, mask: DataFrame, keys: list[str], value: str) -> DataFrame:
    """voxels with the value zero outside the mask's rows."""
    inside = mask.select(*keys, *AXES, F.lit(True).alias("_in"))
    return voxels.join(inside, [*keys, *AXES], "left").withColumn(value, F.when(F.col("_in"), F.col(value)).otherwise(0.0)).drop("_in")


def display_window(voxels: DataFrame, value: str, inside: Column, keys: list[str]) -> DataFrame:
    """keys..., vmin and vmax: percentiles 1 and 99 of the inside, or its ends where these meet."""
    v = voxels.select(*keys, F.when(inside, F.col(value)).alias("_inside"))
    s = v.groupBy(*keys).agg(F.min("_inside").alias("lo"), F.max("_inside").alias("hi"))
    s = order.beside(s, order.quantiles(v, "_inside", keys, [0.01, 0.99], ["p1", "p99"]), keys)
    flat = F.col("p99") <= F.col("p1")
    return s.select(*keys, F.when(flat, F.col("lo")).otherwise(F.col("p1")).alias("vmin"), F.when(flat, F.col("hi")).otherwise(F.col("p99")).alias("vmax"))


def octant(voxels: DataFrame, inside: Column, shape: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """keys..., and per axis the cut: the centre of the inside's box, kept off the volume's border, and which half holds more of it."""
    box = voxels.where(inside).groupBy(*keys).agg(*[f(a).alias(f"{a}{i}") for a in AXES for i, f in ((0, F.min), (1, F.max))], *[F.avg(a).alias(f"m{a}") for a in AXES])
    cuts = []
    for a, n in zip(AXES, shape, strict=True):
        cut = F.least(F.lit(n - 2), F.greatest(F.lit(1), F.floor((F.col(f"{a}0") + F.col(f"{a}1")) / 2))).cast("int")
        cuts += [cut.alias(f"cut_{a}"), (F.col(f"m{a}") >= cut).alias(f"upper_{a}")]
    return box.select(*keys, *cuts)


def scan_patches(voxels: DataFrame, value: str, inside: Column, patch: int, keys: list[str], least_inside: float = 0.5) -> DataFrame:
    """keys..., pz, py, px, inside share, mean and spread of cubes every half patch, with enough of them inside."""
    step = max(1, patch // 2)
    for a in AXES:
        first = F.greatest(F.lit(0), F.floor((F.col(a) - patch) / step) + 1).cast("int")
        voxels = voxels.withColumn(f"p{a}", F.explode(F.sequence(first, F.floor(F.col(a) / step).cast("int"))))
    s = voxels.groupBy(*keys, *[f"p{a}" for a in AXES]).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("share"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))
    return s.where((F.col("n") == patch**3) & (F.col("share") >= least_inside)).drop("n")


def spread_out(candidates: DataFrame, score: str, place: list[str], keys: list[str], k: int, apart: float) -> DataFrame:
    """keys..., rank from 1, place... and score of k places for each key that are at least `apart` from each other, taken greedily by score, ties by place.

    Every candidate counts in each round. Where fewer than k are so far apart, others at least half as far apart follow.
    candidates has no null key or score, and `apart` is over 0. What was chosen is written after each round and joined to the candidates.
    """
    all_of = written(candidates.select(*keys, *place, score), "candidates")
    kind = T.ArrayType(T.StructType([all_of.schema[c] for c in [*place, score]]))
    none = F.array().cast(kind)
    chosen = all_of.sparkSession.createDataFrame([], T.StructType([*[all_of.schema[c] for c in keys], T.StructField("chosen", kind)]))
    n = 0
    best = F.max_by(F.struct(*place, score), F.struct(score, *[-F.col(c) for c in place])).alias("best")
    for least in (apart, apart / 2):
        for _ in range(k):
            far = lambda o: sum((F.col(c) - o[c]) * (F.col(c) - o[c]) for c in place) >= least**2  # noqa: B023, E731
            free = all_of.join(chosen, keys, "left").where(F.col("chosen").isNull() | ((F.size("chosen") < k) & F.forall("chosen", far)))
            longer = F.concat(F.coalesce("chosen", none), F.when(F.col("best").isNull(), none).otherwise(F.array("best"))).cast(kind)
            chosen = written(chosen.join(free.groupBy(*keys).agg(best), keys, "full").select(*keys, longer.alias("chosen")), "chosen")
            before, n = n, chosen.agg(F.sum(F.size("chosen"))).first()[0] or 0
            if n == before:
                break
    return chosen.select(*keys, F.posexplode("chosen").alias("rank", "p")).select(*keys, (F.col("rank") + 1).alias("rank"), *[F.col(f"p.{c}").alias(c) for c in [*place, score]])


def resample(x: np.ndarray, source: np.ndarray, target: np.ndarray, shape: tuple[int, int, int], order: int = 1) -> np.ndarray:
    """x, on the grid of one affine, read on another's: nearest (0) or linear (1); 0 outside."""
    at = np.indices(shape).reshape(3, -1)
    m = np.linalg.inv(source) @ target
    at = m[:3, :3] @ at + m[:3, 3:]
    if order == 0:
        i = np.rint(at).astype(int)
        ok = ((i >= 0) & (i < np.array(x.shape)[:, None])).all(axis=0)
        out = np.zeros(at.shape[1])
        out[ok] = x[tuple(i[:, ok])]
        return out.reshape(shape)
    wide = np.pad(x, 1)
    at = at + 1
    ok = ((at >= 0) & (at <= np.array(wide.shape)[:, None] - 1)).all(axis=0)
    at = np.where(ok, at, 0)
    base = np.minimum(np.floor(at).astype(int), np.array(wide.shape)[:, None] - 2)
    f, out = at - base, np.zeros(at.shape[1])
    for d in np.ndindex(2, 2, 2):
        w = np.prod([f[a] if d[a] else 1 - f[a] for a in range(3)], axis=0)
        out += w * wide[tuple(base[a] + d[a] for a in range(3))]
    return np.where(ok, out, 0.0).reshape(shape)
