"""Fit, blend and evaluate: the patchwise ensemble from lines of volumes to its metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import kernels, quality, stacking
from voxloom.operators.tiling import Grid
from voxloom.sources.tables import points


def fit(lines: DataFrame, grid: Grid, experts: list[str], target: str = "hr", ridge: float = 1e-4, tau: float = 0.3, rounds: int = 1, edge: float = 0.0, gradient: float = 0.0, mask: Column | None = None) -> DataFrame:
    """rid, w1.., objective, vox, method, success and message of every tile of the grid.

    lines has a row for each line of the training volumes, with the target and the experts as arrays; mask is a
    condition on voxels (their columns, z, y, x and seg), by default that the target is positive. edge weighs voxels by the target's
    gradient, gradient adds the products of the experts' and the target's differences along each axis. Weights
    are smoothed over neighbouring tiles after the fit; tiles without voxels take uniform ones.
    """
    m = len(experts)
    inside = (F.col(target) > 0) if mask is None else mask
    rows = lines.withColumn("seg", F.lit(0)) if "seg" not in lines.columns else lines
    rows = kernels.edge_weights(rows.withColumn("hr", F.col(target)), edge) if edge > 0 else rows.withColumn("ew", F.transform(target, lambda v: F.lit(1.0)))
    steps = {f"_{a}{i}": (c, a) for a in kernels.AXES for i, c in enumerate([*experts, target])} if gradient > 0 else {}
    rows = rows.withColumns({n: kernels.stencil(c, (-1, 0, 1), a) for n, (c, a) in steps.items()}) if steps else rows
    v = points(rows, list(dict.fromkeys([*experts, target, "ew", *steps])), "seg").where(inside).withColumn("rid", grid.label()).where("rid >= 0")
    equations = stacking.normal_equations(v, experts, target, weight=F.col("ew"))
    for a in kernels.AXES if steps else ():
        named = v.select("rid", "ew", *[F.col(f"_{a}{i}").alias(c) for i, c in enumerate([*experts, target])])
        more = stacking.normal_equations(named, experts, target, weight=gradient * F.col("ew"))
        sums = [c for c in equations.columns if c not in ("rid", "vox")]
        both = equations.join(more.select("rid", *[F.col(c).alias(f"_{c}") for c in sums]), "rid")
        equations = both.select("rid", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums], "vox")
    if m == 2:
        two = stacking.simplex_weights_two(equations, ridge)
        value = F.col("w1") ** 2 * (F.col("q11") + ridge) + 2 * F.col("w1") * F.col("w2") * F.col("q12") + F.col("w2") ** 2 * (F.col("q22") + ridge) - 2 * (F.col("w1") * F.col("b1") + F.col("w2") * F.col("b2"))
        solved = two.select("rid", F.array("w1", "w2").alias("w"), value.alias("objective"), "vox")
    else:
        solved = stacking.simplex_weights(equations, m, ridge)
    record = stacking.with_record(solved, grid.boxes(lines.sparkSession), m)
    record = record.withColumn("method", F.when((F.col("method") == "active_set") & F.lit(m == 2), "closed_form").otherwise(F.col("method")))
    names = [f"w{i + 1}" for i in range(m)]
    fitted = record.where("success").select("rid", *[F.col("w")[i].alias(n) for i, n in enumerate(names)])
    smooth = stacking.smooth_weights(fitted, grid.adjacency(lines.sparkSession), tau, names, rounds)
    out = record.drop("w").join(smooth, "rid", "left")
    return out.select("rid", *[F.coalesce(n, F.lit(1.0 / m)).alias(n) for n in names], "objective", "vox", "method", "success", "message")


def blend_entry(lines: DataFrame, weights: DataFrame, grid: Grid, experts: list[str], kind: str = "hann", params: DataFrame | None = None, mask: Column | None = None) -> DataFrame:
    """lines with the array blend. params(patient, mean, std) normalise the experts before and undo it after; blend is 0 outside of mask, a condition on lines' columns."""
    rows = lines if params is None else lines.join(params, "patient")
    if params is not None:
        rows = rows.withColumns({f"_{e}": F.transform(e, lambda v: (v - F.col("mean")) / F.col("std")) for e in experts})
    out = stacking.blend(rows, weights, grid, [f"_{e}" for e in experts] if params is not None else experts, kind)
    if params is not None:
        out = out.withColumn("blend", F.transform("blend", lambda v: v * F.col("std") + F.col("mean"))).drop("mean", "std", *[f"_{e}" for e in experts])
    return out if mask is None else out.withColumn("blend", F.transform("blend", lambda v: F.when(mask, v).otherwise(0.0)))


def evaluate(lines: DataFrame, truth: str, made: str, shape: tuple[int, int, int]) -> DataFrame:
    """patient, mse, mae, psnr and ssim (uniform windows, mean over slices)."""
    e = quality.errors(points(lines, [truth, made]), truth, made, ["patient"])
    return e.join(quality.ssim_slicewise(lines, truth, made, shape), "patient").select("patient", "mse", "mae", "psnr", "ssim")


def summarise(metrics: DataFrame) -> DataFrame:
    """metric, mean, std (population) and n over the patients."""
    long = metrics.unpivot(["patient"], [c for c in metrics.columns if c != "patient"], "metric", "v")
    return long.where("v IS NOT NULL AND NOT isnan(v)").groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"))


def roi_quality(lines: DataFrame, truth: str, made: str, shape: tuple[int, int, int], rois: dict[str, int | None] = quality.ROIS) -> DataFrame:
    """patient, roi, psnr, ssim and n_voxels of each region with voxels: a label of seg, or None for where the truth is positive. For ssim both are 0 outside, and slices without range are passed over."""

    def one(name: str, label: int | None) -> DataFrame:
        inside = (lambda t: t > 0) if label is None else (lambda t: F.col("seg") == label)
        masked = lines.withColumns({"_t": F.transform(truth, lambda t: F.when(inside(t), t).otherwise(0.0)), "_m": F.zip_with(truth, made, lambda t, v: F.when(inside(t), v).otherwise(0.0))})
        ssim = quality.ssim_slicewise(masked, "_t", "_m", shape, least=1e-7)
        v = points(lines, [truth, made], "seg").where(F.col(truth) > 0 if label is None else F.col("seg") == label)
        s = v.groupBy("patient").agg(F.count("*").alias("n_voxels"), quality.mse(truth, made).alias("e"), (F.max(truth) - F.min(truth)).alias("r"))
        psnr = F.when(F.col("e") <= 0, float("inf")).when(F.col("r") <= 0, float("nan")).otherwise(10 * F.log10(F.col("r") * F.col("r") / F.col("e")))
        return s.join(ssim, "patient", "left").select("patient", F.lit(name).alias("roi"), psnr.alias("psnr"), F.coalesce("ssim", F.lit(0.0)).alias("ssim"), "n_voxels")

    return reduce(DataFrame.union, [one(n, k) for n, k in rois.items()])


def roi_cube(lines: DataFrame, truth: str, made: str, shape: tuple[int, int, int], rois: dict[str, int | None] = quality.ROIS) -> DataFrame:
    """patient, roi, metric, mean, std (population) and n over the slices that have the region, values that are no numbers passed over; ssim has Gaussian windows and is the slice's."""
    each = points(lines, [truth, made], "seg").withColumn("roi", F.explode(quality.regions_of("seg", rois)))
    cells = quality.errors(each, truth, made, ["patient", "roi", "z"]).join(quality.ssim_slices(lines, truth, made, shape, gaussian=True), ["patient", "z"], "left")
    long = cells.withColumnRenamed("s", "ssim").unpivot(["patient", "roi", "z"], ["mae", "mse", "psnr", "ssim"], "metric", "v")
    known = long.where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < 1e308")
    return known.groupBy("patient", "roi", "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"))
