"""Patchwise convex stacking: normal equations by tile, simplex weights, smoothing and blending."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.tiling import AXES, Grid

EPS = 1e-8


def normal_equations(voxels: DataFrame, experts: list[str], target: str = "hr", keys: list[str] | None = None, weight: Column | None = None, where: Column | None = None) -> DataFrame:
    """keys..., q_ij (i <= j), b_i and vox: the sums of w x x', w x y and rows by key, in one pass with partial sums."""
    w = F.lit(1.0) if weight is None else weight
    rows = voxels if where is None else voxels.where(where)
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"q{i + 1}{j + 1}") for (i, a), (j, b) in itertools.combinations_with_replacement(enumerate(experts), 2)]
    sums += [F.sum(w * F.col(a) * F.col(target)).alias(f"b{i + 1}") for i, a in enumerate(experts)]
    return rows.groupBy(*(keys or ["rid"])).agg(*sums, F.count("*").alias("vox"))


def simplex_weights_two(equations: DataFrame, ridge: float = 1e-4) -> DataFrame:
    """equations with w1 and w2, the closed-form minimum of w'(Q + ridge I)w - 2 b'w over the simplex; uniform where it is flat."""
    bend = F.col("q11") + F.col("q22") + 2 * ridge - 2 * F.col("q12")
    t = (F.col("q22") + ridge - F.col("q12") + F.col("b1") - F.col("b2")) / F.nullif(bend, F.lit(0.0))
    w1 = F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.5))
    return equations.withColumn("w1", w1).withColumn("w2", 1 - F.col("w1"))


def solve_simplex(q: np.ndarray, b: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """The exact minimum over the simplex: the best stationary point of any set of experts that has no negative weight."""
    m = len(b)
    a = q + ridge * np.eye(m)
    best, best_w = np.inf, np.full(m, 1 / m)
    for k in range(1, m + 1):
        for on in itertools.combinations(range(m), k):
            on = list(on)
            kkt = np.zeros((k + 1, k + 1))
            kkt[:k, :k], kkt[k, :k], kkt[:k, k] = 2 * a[np.ix_(on, on)], 1, 1
            w = np.linalg.lstsq(kkt, np.r_[2 * b[on], 1], rcond=None)[0][:k]
            if w.min() >= -1e-12:
                full = np.zeros(m)
                full[on] = np.maximum(w, 0)
                if not full.sum() > 0:
                    continue
                full /= full.sum()
                value = full @ a @ full - 2 * b @ full
                if value < best - 1e-12:
                    best, best_w = value, full
    return best_w


def simplex_weights(equations: DataFrame, m: int, ridge: float = 1e-4) -> DataFrame:
    """equations with w, the weights of m experts, and objective; an Arrow batch of tiles at a time."""
    pairs = list(itertools.combinations_with_replacement(range(m), 2))

    @F.pandas_udf("w array<double>, objective double")
    def solve(*columns: pd.Series) -> pd.DataFrame:
        data = np.stack([c.to_numpy(float) for c in columns], axis=1)
        w, objective = [], []
        for row in data:
            q, b = np.zeros((m, m)), row[len(pairs) : len(pairs) + m]
            for (i, j), v in zip(pairs, row, strict=False):
                q[i, j] = q[j, i] = v
            w.append(solve_simplex(q, b, ridge))
            objective.append(w[-1] @ (q + ridge * np.eye(m)) @ w[-1] - 2 * b @ w[-1])
        return pd.DataFrame({"w": w, "objective": objective})

    columns = [F.col(f"q{i + 1}{j + 1}") for i, j in pairs] + [F.col(f"b{i + 1}") for i in range(m)]
    return equations.withColumn("s", solve(*columns)).select(*equations.columns, "s.w", "s.objective")


def linear_weights(equations: DataFrame, m: int, ridge: float = 1e-4) -> DataFrame:
    """equations with w, the weights of m experts without any constraint, objective and message: the direct solution, or by the pseudo-inverse where there is none."""
    pairs = list(itertools.combinations_with_replacement(range(m), 2))

    @F.pandas_udf("w array<double>, objective double, message string")
    def solve(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for row in np.stack([c.to_numpy(float) for c in columns], axis=1):
            a, b = np.zeros((m, m)), row[len(pairs) :]
            for (i, j), v in zip(pairs, row, strict=False):
                a[i, j] = a[j, i] = v
            a += ridge * np.eye(m)
            try:
                w, message = np.linalg.solve(a, b), "direct"
            except np.linalg.LinAlgError:
                w, message = np.linalg.pinv(a) @ b, "pseudo-inverse"
            out.append((w, w @ a @ w - 2 * b @ w, message))
        return pd.DataFrame(out, columns=["w", "objective", "message"])

    columns = [F.col(f"q{i + 1}{j + 1}") for i, j in pairs] + [F.col(f"b{i + 1}") for i in range(m)]
    return equations.withColumn("s", solve(*columns)).select(*equations.columns, "s.w", "s.objective", "s.message")


def with_record(weights: DataFrame, tiles: DataFrame, m: int) -> DataFrame:
    """A row for each tile of tiles(rid): w, objective, vox, method, success and message; tiles without voxels take uniform weights."""
    every = tiles.select("rid").join(weights.select("rid", "w", "objective", "vox"), "rid", "left")
    empty = F.col("vox").isNull() | (F.col("vox") == 0)
    return every.select(
        "rid", F.when(empty, F.array(*[F.lit(1.0 / m)] * m)).otherwise(F.col("w")).alias("w"), F.when(~empty, F.col("objective")).alias("objective"), F.coalesce("vox", F.lit(0)).cast("long").alias("vox"),
        F.when(empty, "uniform").otherwise("active_set").alias("method"), (~empty).alias("success"), F.when(empty, "no voxels").otherwise("optimal").alias("message"),
    )


def smooth_weights(weights: DataFrame, adjacency: DataFrame, tau: float, columns: list[str], rounds: int = 1) -> DataFrame:
    """Jacobi steps w <- (1 - tau) w + tau * mean of the neighbours; tiles without any stay; then clipped and normalised. tau <= 0: as it is."""
    if tau <= 0:
        return weights
    for _ in range(rounds):
        near = adjacency.join(weights.select(F.col("rid").alias("nbr"), *columns), "nbr").groupBy("rid").agg(*[F.avg(c).alias(f"_{c}") for c in columns])
        mixed = [F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise((1 - tau) * F.col(c) + tau * F.col(f"_{c}")).alias(c) for c in columns]
        weights = weights.join(near, "rid", "left").select("rid", *mixed)
    total = sum((F.greatest(F.col(c), F.lit(0.0)) for c in columns), F.lit(EPS))
    return weights.select("rid", *[(F.greatest(F.col(c), F.lit(0.0)) / total).alias(c) for c in columns])


def _taper(kind: str, n: int, patch: int, stride: int) -> list[list[float]]:
    """For each tile along an axis, its taper at each place it covers: periodic Hann of its own, possibly cut, side; else flat."""
    out = []
    for start in range(0, n, stride):
        side = min(start + patch, n) - start
        out.append([0.5 - 0.5 * math.cos(2 * math.pi * i / side) if kind == "hann" and side > 1 else 1.0 for i in range(side)])
    return out


def blend(lines: DataFrame, weights: DataFrame, grid: Grid, experts: list[str], kind: str = "hann") -> DataFrame:
    """lines with the array blend: overlap-add of each covering tile's weighted experts.

    lines has a row for each line (patient, z, y) and the experts as arrays along x. weights has
    rid and w1.. of the tiles that were fitted; others blend uniformly. The taper is flat
    where tiles don't overlap. Tapers are products of one for each axis, so tiles are first summed
    over z and y to a table of (z, y), which all volumes share, with the weights of the tiles along x;
    a line meets its row of that table, and a voxel its few tiles in arrays.
    """
    m = len(experts)
    kind = "flat" if any(s >= p for s, p in zip(grid.stride, grid.patch, strict=True)) else kind
    tiles = grid.boxes(lines.sparkSession).select("rid", "cz", "cy", "cx").join(weights, "rid", "left")
    tiles = tiles.select("cz", "cy", "cx", *[F.coalesce(F.col(f"w{i + 1}"), F.lit(1.0 / m)).alias(f"w{i + 1}") for i in range(m)])
    constant = lambda rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    for i, a in enumerate(AXES[:2]):
        taper = constant(_taper(kind, grid.shape[i], grid.patch[i], grid.stride[i]))
        tiles = tiles.withColumn("_t", F.get(taper, F.col(f"c{a}"))).select("*", F.posexplode("_t").alias("_i", f"_t{a}")).withColumn(a, F.col(f"c{a}") * grid.stride[i] + F.col("_i")).drop("_t", "_i")
    t = F.col("_tz") * F.col("_ty")
    summed = tiles.groupBy("z", "y", "cx").agg(F.sum(t).alias("_n"), F.array(*[F.sum(t * F.col(f"w{i + 1}")) for i in range(m)]).alias("_w"))
    rows = summed.groupBy("z", "y").agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("cx", "_w"))).alias("_a")).select("z", "y", "_n", F.col("_a._w").alias("_a"))
    # the tiles that cover each x, and their tapers there
    n, patch, stride = grid.shape[2], grid.patch[2], grid.stride[2]
    along = _taper(kind, n, patch, stride)
    cover = [[(k, row[x - k * stride]) for k, row in enumerate(along) if 0 <= x - k * stride < len(row)] for x in range(n)]
    places = F.array(*[F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in c]) if c else F.array().cast("array<struct<k:int,w:double>>") for c in cover])
    norm = F.array(*[F.lit(float(sum(w for _, w in c))) for c in cover])

    def at(v: Column, i: Column) -> Column:
        dot = lambda k: F.aggregate(F.zip_with(F.get(F.col("_a"), k), v, lambda w, e: w * e), F.lit(0.0), lambda total, e: total + e)
        total = F.aggregate(F.get(places, i), F.lit(0.0), lambda total, p: total + p["w"] * dot(p["k"]))
        return total / (F.get(norm, i) * F.col("_n") + EPS)

    per_voxel = F.transform(F.arrays_zip(*experts), lambda e: F.array(*[e[x] for x in experts]))
    return lines.join(rows, ["z", "y"]).withColumn("_e", per_voxel).withColumn("blend", F.transform("_e", at)).drop("_n", "_a", "_e")


def predict(voxels: DataFrame, weights: DataFrame, grid: Grid, experts: list[str]) -> DataFrame:
    """voxels with blend, each by its own label's weights alone: no taper, uniform where a tile has none."""
    m = len(experts)
    out = voxels.withColumn("rid", grid.label()).join(weights, "rid", "left")
    return out.withColumn("blend", sum((F.coalesce(F.col(f"w{i + 1}"), F.lit(1.0 / m)) * F.col(e) for i, e in enumerate(experts)), F.lit(0.0)))
