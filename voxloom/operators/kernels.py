"""Stencils over volumes kept as lines (an array of x in each row), with edges repeated; splines, LoG and components in numpy by volume."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTH = {"sobel": (1, 2, 1), "prewitt": (1, 1, 1), "scharr": (3, 10, 3)}
AXES = ("z", "y", "x")


def _near(column: str, k: int, axis: str, keys: tuple[str, ...]) -> Column:
    """The line k steps away along z or y; the last one before the edge where there is none."""
    window = Window.partitionBy(*keys, *[a for a in ("z", "y") if a != axis]).orderBy(axis)
    step = F.lag if k < 0 else F.lead
    return F.coalesce(*[step(column, n).over(window) for n in range(abs(k), 0, -1)], F.col(column))


def stencil(column: str, weights: tuple[float, ...], axis: str, keys: tuple[str, ...] = ("patient",)) -> Column:
    """The weighted sum of the values around each voxel of an array column, along an axis. Along x it stays in the row; along z and y only lines move."""
    r = len(weights) // 2
    terms = [(k, float(w)) for k, w in zip(range(-r, r + 1), weights, strict=True) if w]
    if axis == "x":
        at = lambda i, k: F.get(F.col(column), F.least(F.greatest(i + k, F.lit(0)), F.size(column) - 1))
        return F.transform(F.col(column), lambda v, i: sum((w * (at(i, k) if k else v) for k, w in terms), F.lit(0.0)))

    def scaled(w: float):
        return lambda v: w * v

    def added(w: float):
        return lambda total, v: total + w * v

    arrays = [(F.col(column) if k == 0 else _near(column, k, axis, keys), w) for k, w in terms]
    out = F.transform(arrays[0][0], scaled(arrays[0][1]))
    for a, w in arrays[1:]:
        out = F.zip_with(out, a, added(w))
    return out


def gradients(lines: DataFrame, value: str = "hr", operator: str = "sobel", keys: tuple[str, ...] = ("patient",)) -> DataFrame:
    """lines with the arrays gz, gy, gx of `value`: differences along an axis, smoothed along the other two. Two shuffles of lines."""
    if operator not in SMOOTH:
        raise ValueError(f"unknown gradient operator {operator}")
    names = {"": value}
    for axis in AXES:
        new = {}
        for done, column in names.items():
            new[f"{done}s"] = stencil(column, SMOOTH[operator], axis, keys)
            if "d" not in done:
                new[f"{done}d"] = stencil(column, (-1, 0, 1), axis, keys)
        lines = lines.withColumns({f"_{k}": v for k, v in new.items()})
        names = {k: f"_{k}" for k in new}
    out = lines.withColumns({"gz": F.col("_dss"), "gy": F.col("_sds"), "gx": F.col("_ssd")})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def magnitude(gz: str = "gz", gy: str = "gy", gx: str = "gx") -> Column:
    square = F.zip_with(F.zip_with(gz, gy, lambda a, b: a * a + b * b), gx, lambda s, c: s + c * c)
    return F.transform(square, F.sqrt)


def edge_weights(lines: DataFrame, strength: float, power: float = 1.0, operator: str = "sobel", keys: tuple[str, ...] = ("patient",)) -> DataFrame:
    """lines with the array ew = 1 + strength * (g / (max g + 1e-6)) ** power; 1 where strength is not positive."""
    if strength <= 0:
        return lines.withColumn("ew", F.transform("hr", lambda v: F.lit(1.0)))
    g = gradients(lines, operator=operator, keys=keys).withColumn("g", magnitude())
    top = g.groupBy(*keys).agg(F.max(F.array_max("g")).alias("_top"))
    weighed = F.transform("g", lambda v: 1 + strength * F.pow(v / (F.col("_top") + 1e-6), F.lit(float(power))))
    return g.join(top, list(keys)).withColumn("ew", weighed).drop("g", "_top", "gz", "gy", "gx")


def local_variance(lines: DataFrame, value: str = "hr", radius: int = 2, keys: tuple[str, ...] = ("patient",)) -> DataFrame:
    """lines with the array lvar: E[x^2] - E[x]^2 over the cube around each voxel, at least 0."""
    mean = (1.0 / (2 * radius + 1),) * (2 * radius + 1)
    lines = lines.withColumns({"_m": F.col(value), "_q": F.transform(value, lambda v: v * v)})
    for axis in AXES:
        lines = lines.withColumns({c: stencil(c, mean, axis, keys) for c in ("_m", "_q")})
    return lines.withColumn("lvar", F.zip_with("_q", "_m", lambda q, m: F.greatest(F.lit(0.0), q - m * m))).drop("_m", "_q")


def halved(column: str) -> Column:
    """An array column with half as many values, read between neighbours with both ends kept."""
    n = F.size(column)
    m = F.floor(n / 2).cast("int")

    def at(i: Column) -> Column:
        u = F.when(m > 1, F.try_divide(i * (n - 1).cast("double"), m - 1)).otherwise(0.0)
        low = F.floor(u).cast("int")
        return (1 - (u - low)) * F.get(F.col(column), low) + (u - low) * F.get(F.col(column), F.least(low + 1, n - 1))

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.array().cast("array<double>"))


def turned(lines: DataFrame, columns: list[str], keys: tuple[str, ...] = ("patient",)) -> DataFrame:
    """The volumes as lines along y: y of each row is the old x, and its arrays run along the old y."""
    each = lines.select(*keys, "z", F.col("y").alias("_y"), F.posexplode(F.arrays_zip(*columns)).alias("y", "_v"))
    rows = each.groupBy(*keys, "z", "y").agg(F.array_sort(F.collect_list(F.struct("_y", "_v"))).alias("_l"))  # as long as a volume has lines in a slice
    return rows.select(*keys, "z", "y", *[F.col("_l._v").getField(c).alias(c) for c in columns])


# ---- numpy kernels, one volume of bounded size at a time


def volumes_of(pdf: pd.DataFrame, columns: list[str], shape: tuple[int, ...], at: list[str]) -> list[np.ndarray]:
    """Arrays of the columns' lines, placed by their coordinates; 0 where a line is missing."""
    out, where = [], tuple(pdf[a].to_numpy() for a in at)
    for c in columns:
        v = np.zeros(shape)
        if len(pdf):
            v[where] = np.stack(pdf[c].to_numpy())
        out.append(v)
    return out


def by_volume(lines: DataFrame, run, schema: str, columns: list[str], shape: tuple[int, int, int], keys: tuple[str, ...] = ("patient",), there: bool = False) -> DataFrame:
    """run(volumes of the columns) -> pandas rows, for each volume. Volumes have a fixed shape: a task holds one at a time, sent as lines.

    With `there`, run gets one array more: which lines (z, y) the volume has.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        volumes = volumes_of(pdf, columns, shape, ["z", "y"])
        if there:
            known = np.zeros(shape[:2], bool)
            known[pdf["z"].to_numpy(), pdf["y"].to_numpy()] = True
            volumes.append(known)
        out = run(*volumes)
        for name, k in zip(keys, key, strict=True):
            out[name] = k
        return out

    heads = ", ".join(f"{k} {dict(lines.dtypes)[k]}" for k in keys)
    return lines.select(*keys, "z", "y", *columns).groupBy(*keys).applyInPandas(one, f"{heads}, {schema}")


def _correlate(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r = len(kernel) // 2
    wide = np.pad(x, [(r, r) if i == axis else (0, 0) for i in range(x.ndim)], mode="symmetric")
    return sum(w * np.take(wide, np.arange(i, i + x.shape[axis]), axis) for i, w in enumerate(kernel))


def laplacian_of_gaussian(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """The sum over axes of the Gaussian's second derivative along one and its mean along the others; edges are mirrored."""
    t = np.arange(-int(truncate * sigma + 0.5), int(truncate * sigma + 0.5) + 1)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    g /= g.sum()
    second = (t * t / sigma**4 - 1 / sigma**2) * g
    out = np.zeros_like(x)
    for axis in range(x.ndim):
        y = x
        for i in range(x.ndim):
            y = _correlate(y, second if i == axis else g, i)
        out += y
    return out


def _spline_coefficients(x: np.ndarray, axis: int) -> np.ndarray:
    """Cubic B-spline coefficients along an axis, edges mirrored: one small linear system for all lines."""
    n = x.shape[axis]
    if n == 1:
        return x
    a = np.diag(np.full(n, 4 / 6)) + np.diag(np.full(n - 1, 1 / 6), 1) + np.diag(np.full(n - 1, 1 / 6), -1)
    a[0, 1] = a[-1, -2] = 2 / 6
    return np.moveaxis(np.tensordot(np.linalg.inv(a), x, (1, axis)), 0, axis)


def spline_zoom(x: np.ndarray, shape: tuple[int, ...], order: int = 3) -> np.ndarray:
    """x resampled to a shape with both ends kept: cubic (3), linear (1) or nearest (0)."""
    for axis, m in enumerate(shape):
        n = x.shape[axis]
        if n == m:
            continue
        at = np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0)
        if order == 0:
            x = np.take(x, np.floor(at + 0.5).astype(int).clip(0, n - 1), axis)
            continue
        base = np.floor(at).astype(int)
        f = (at - base).reshape([-1 if i == axis else 1 for i in range(x.ndim)])
        if order == 1:
            x = (1 - f) * np.take(x, base, axis) + f * np.take(x, np.minimum(base + 1, n - 1), axis)
            continue
        c = _spline_coefficients(x, axis)
        mirrored = lambda i: np.take(c, np.abs((i + n - 1) % (2 * n - 2) - (n - 1)) if n > 1 else i * 0, axis)  # noqa: B023, E731
        x = mirrored(base - 1) * (1 - f) ** 3 / 6 + mirrored(base) * (4 - 6 * f**2 + 3 * f**3) / 6 + mirrored(base + 1) * (4 - 6 * (1 - f) ** 2 + 3 * (1 - f) ** 3) / 6 + mirrored(base + 2) * f**3 / 6
    return x


def largest_component(mask: np.ndarray, connectivity: int = 18) -> np.ndarray:
    """The largest connected set of true voxels (neighbours across 6 faces, 18 with edges, 26 with corners); the first of equal ones. ValueError if none is true."""
    if not mask.any():
        raise ValueError("no voxel is true")
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    label = np.where(mask.ravel(), np.arange(mask.size), mask.size).reshape(mask.shape)
    steps = [d for d in np.ndindex(3, 3, 3) if 0 < sum(abs(k - 1) for k in d) <= reach]
    while True:
        wide = np.pad(label, 1, constant_values=mask.size)
        new = label
        for d in steps:
            new = np.minimum(new, wide[tuple(slice(k, k + n) for k, n in zip(d, mask.shape, strict=True))])
        new = np.where(mask, new, mask.size)
        flat = np.append(new.ravel(), mask.size)
        new = np.minimum(new, flat[flat[new]])  # pointer jump
        if np.array_equal(new, label):
            break
        label = new
    roots, counts = np.unique(label[mask], return_counts=True)
    return label == roots[counts.argmax()]


def variance_peak(x: np.ndarray, size: int = 15, there: np.ndarray | None = None) -> tuple[int, int, float]:
    """Where an image's variance over size x size squares (edges mirrored) is largest, the first of equal ones, and how large.

    there: which of the image's rows are known; what is not is 0, and squares without a known row don't count.
    """
    mean = np.full(size, 1.0 / size)
    smooth = lambda v: _correlate(_correlate(v, mean, 0), mean, 1)
    var = np.round(np.maximum(0.0, smooth(x * x) - smooth(x) ** 2), 9)
    if there is not None:
        var = np.where(_correlate(there.astype(float), mean, 0)[:, None] > 0, var, -1.0)
    at = np.unravel_index(var.argmax(), var.shape)
    return int(at[0]), int(at[1]), float(var[at])


def box_mean(x: np.ndarray, radius: int) -> np.ndarray:
    """Means over cubes, edges repeated."""
    n = 2 * radius + 1
    for axis in range(x.ndim):
        wide = np.pad(x, [(radius, radius) if i == axis else (0, 0) for i in range(x.ndim)], mode="edge")
        x = sum(np.take(wide, np.arange(i, i + x.shape[axis]), axis) for i in range(n)) / n
    return x


def sobel_magnitude(x: np.ndarray) -> np.ndarray:
    total = np.zeros_like(x)
    for axis in range(x.ndim):
        g = x
        for i in range(x.ndim):
            wide = np.pad(g, [(1, 1) if a == i else (0, 0) for a in range(x.ndim)], mode="edge")
            at = lambda k: np.take(wide, np.arange(k, k + x.shape[i]), i)  # noqa: B023, E731
            g = at(2) - at(0) if i == axis else at(0) + 2 * at(1) + at(2)
        total += g * g
    return np.sqrt(total)


def _grown(mask: np.ndarray, times: int) -> np.ndarray:
    """Dilation by the 6 face neighbours."""
    for _ in range(times):
        wide = np.pad(mask, 1)
        mask = mask.copy()
        for axis in range(mask.ndim):
            for k in (0, 2):
                mask |= wide[tuple(slice(k, k + n) if i == axis else slice(1, 1 + n) for i, n in enumerate(mask.shape))]
    return mask


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with all of its background that no path of faces joins to the border."""
    outside = ~np.pad(mask, 1)
    seen = np.zeros_like(outside)
    seen[0, 0, 0] = True
    while True:
        new = _grown(seen, 1) & outside
        if np.array_equal(new, seen):
            return ~seen[1:-1, 1:-1, 1:-1]
        seen = new


def brain_mask(x: np.ndarray, percentile: float = 5) -> np.ndarray:
    """Values over a percentile of the positive ones: holes filled, opened twice, the largest part, closed twice."""
    if not (x > 0).any():
        return np.zeros(x.shape, bool)
    mask = fill_holes(x > np.percentile(x[x > 0], percentile))
    opened = _grown(~_grown(~np.pad(mask, 2), 2), 2)[2:-2, 2:-2, 2:-2]
    if not opened.any():
        return opened
    best = np.pad(largest_component(opened, 6), 2)
    return (~_grown(~_grown(best, 2), 2))[2:-2, 2:-2, 2:-2]
