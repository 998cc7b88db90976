"""Invariants and brute force for what SQL can't say."""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom import stages
from voxloom.__main__ import main
from voxloom.functions import special
from voxloom.operators import aggregate, coverage, ensemble, geometry, kernels, quality, stacking, stats, tiling
from voxloom.sources import config, results, volume_lines, volume_store


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10_000), st.integers(2, 4))
def test_simplex_solution_is_feasible_and_best(seed, m):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(6, m)), rng.normal(size=m)
    q = a.T @ a
    w = stacking.solve_simplex(q, b)
    assert w.min() >= 0 and abs(w.sum() - 1) < 1e-9
    value = lambda v: v @ (q + 1e-4 * np.eye(m)) @ v - 2 * b @ v
    others = rng.dirichlet(np.ones(m), 300)
    assert value(w) <= min(map(value, others)) + 1e-9


def test_simplex_two_matches_solver(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        a, b = rng.normal(size=(5, 2)), rng.normal(size=2) * 2
        q = a.T @ a
        rows.append((i, float(q[0, 0]), float(q[0, 1]), float(q[1, 1]), float(b[0]), float(b[1])))
    rows.append((99, 0.0, 0.0, 0.0, 0.0, 0.0))
    eq = spark.createDataFrame(rows, "rid int, q11 double, q12 double, q22 double, b1 double, b2 double")
    closed = {r.rid: r.w1 for r in stacking.simplex_weights_two(eq, 1e-4).collect()}
    solved = {r.rid: r.w[0] for r in stacking.simplex_weights(eq, 2, 1e-4).collect()}
    assert all(abs(closed[k] - solved[k]) < 1e-6 for k in closed)


@pytest.mark.parametrize(("patch", "stride"), [((4, 4, 4), (2, 2, 2)), ((3, 5, 4), (2, 3, 4)), ((2, 2, 2), (3, 3, 3)), ((5, 5, 5), (3, 3, 3))])
def test_labels_and_coverage_by_loop(spark, patch, stride):
    shape = (5, 6, 7)
    g = tiling.Grid(shape, patch, stride)
    labels, cover, k = np.full(shape, -1), {}, 0
    for z, y, x in itertools.product(*[range(0, n, s) for n, s in zip(shape, stride, strict=True)]):
        box = (slice(z, z + patch[0]), slice(y, y + patch[1]), slice(x, x + patch[2]))
        labels[box] = k
        for v in np.argwhere(np.isin(np.arange(np.prod(shape)).reshape(shape), np.arange(np.prod(shape)).reshape(shape)[box])):
            cover.setdefault(tuple(map(int, v)), set()).add(k)
        k += 1
    voxels = spark.createDataFrame([tuple(map(int, v)) for v in np.ndindex(shape)], "z int, y int, x int")
    assert all(labels[r.z, r.y, r.x] == r.rid for r in voxels.withColumn("rid", g.label()).collect())
    found: dict = {}
    for r in g.covered(voxels).select("z", "y", "x", "rid").collect():
        found.setdefault((r.z, r.y, r.x), set()).add(r.rid)
    assert found == cover
    boxes = {r.rid: (r.z0, r.z1, r.y0, r.y1, r.x0, r.x1) for r in g.boxes(spark).collect()}
    assert len(boxes) == k and all(b[1] <= shape[0] and b[3] <= shape[1] and b[5] <= shape[2] for b in boxes.values())


def as_lines(spark, patient: int, **volumes):
    """Rows of lines (patient, z, y, arrays) of numpy volumes."""
    shape = next(iter(volumes.values())).shape
    rows = [(patient, z, y, *[[float(v) for v in x[z, y]] for x in volumes.values()]) for z in range(shape[0]) for y in range(shape[1])]
    return spark.createDataFrame(rows, "patient int, z int, y int, " + ", ".join(f"{n} array<double>" for n in volumes))


def as_volume(rows, column: str, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.z, r.y] = r[column]
    return out


@pytest.mark.parametrize(("patch", "stride"), [((4, 2, 4), (2, 1, 2)), ((3, 3, 5), (2, 2, 3)), ((2, 2, 2), (3, 2, 2))])
def test_blends_agree_and_keep_equal_experts(spark, patch, stride):
    shape = (6, 4, 8)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=shape), rng.normal(size=shape)
    lines = as_lines(spark, 0, e1=a, e2=b)
    voxels = spark.createDataFrame([(0, *map(int, v), float(a[v]), float(b[v])) for v in np.ndindex(shape)], "patient int, z int, y int, x int, e1 double, e2 double")
    g = tiling.Grid(shape, patch, stride)
    w = g.boxes(spark).select("rid", (F.col("rid") % 5 / 5.0).alias("w1")).withColumn("w2", 1 - F.col("w1")).where("rid % 7 <> 0")
    flat = any(s >= p for s, p in zip(stride, patch, strict=True))
    for kind in ("flat", "hann"):
        fast = as_volume(stacking.blend(lines, w, g, ["e1", "e2"], kind).collect(), "blend", shape)
        tiles = g.boxes(spark).select("rid").join(w, "rid", "left").select("rid", F.array(F.coalesce("w1", F.lit(0.5)), F.coalesce("w2", F.lit(0.5))).alias("w"))
        each = g.covered(voxels).withColumn("w3", g.taper("flat" if flat else kind)).join(tiles, "rid").withColumn("v", F.col("w")[0] * F.col("e1") + F.col("w")[1] * F.col("e2"))
        slow = np.zeros(shape)  # 0 where no tile covers a voxel
        for r in each.groupBy("z", "y", "x").agg((F.sum(F.col("w3") * F.col("v")) / (F.sum("w3") + 1e-8)).alias("b")).collect():
            slow[r.z, r.y, r.x] = r.b
        known = ~np.isnan(fast)  # lines that no tile covers are left out
        assert np.allclose(fast[known], slow[known]) and (flat or known.all())
    if not flat:
        same = as_volume(stacking.blend(as_lines(spark, 0, e1=a, e2=a), w, g, ["e1", "e2"], "flat").collect(), "blend", shape)
        assert np.allclose(same, a, atol=1e-6)


def test_moment_form_of_the_kernel_distance(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(30, 3)), rng.normal(size=(25, 3)) + 0.5
    kernel = lambda p, q: (p @ q.T / 3 + 1) ** 3
    within = lambda p: (kernel(p, p).sum() - np.trace(kernel(p, p))) / (len(p) * (len(p) - 1))
    want = max(0, within(a) + within(b) - 2 * kernel(a, b).mean())
    rows = spark.createDataFrame([(1, s, *map(float, v)) for s, p in ((0, a), (1, b)) for v in p], "k int, side int, f1 double, f2 double, f3 double")
    assert abs(quality.polynomial_mmd(rows, "side", ["f1", "f2", "f3"], ["k"]).first().mmd - want) < 1e-9


def test_kernel_distance_of_whole_volumes_by_pairs(spark):
    from voxloom.plans import volumes

    sf = "/root/testdata/sf0.001"
    kernel = lambda p, q: (p @ q.T / 2 + 1) ** 3
    within = lambda p: (kernel(p, p).sum() - np.trace(kernel(p, p))) / (len(p) * (len(p) - 1))
    got = {r.patient: r.mmd for r in volumes.mmd_poly3_whole(spark, sf).collect()}
    v = volumes.voxels(spark, sf).select("patient", "x", "hr", "e1").toPandas()
    assert set(got) == set(v.patient)
    for patient, rows in v.groupby("patient"):
        a, b = (rows[rows.x % 2 == k][["hr", "e1"]].to_numpy() for k in (0, 1))
        assert abs(got[patient] - max(0, within(a) + within(b) - 2 * kernel(a, b).mean())) < 1e-6


def test_volumes_have_one_shape_at_every_size(spark):
    from voxloom.plans import scenes, volumes

    for sf, n in (("/root/testdata/sf0.001", 5), ("/root/testdata/sf0.1", 20)):
        shapes = volumes.voxels(spark, sf).groupBy("patient").agg(*[(F.max(a) + 1).alias(a) for a in "zyx"]).collect()
        assert len(shapes) == n and {(r.z, r.y, r.x) for r in shapes} == {volumes.SHAPE}
        assert {r.n for r in scenes.crop_to_common_depth(spark, sf).collect()} == {8 * 9 * 60}


def test_structural_similarity():
    rng = np.random.default_rng(42)
    v = rng.uniform(size=(40, 40, 40)) * 100
    assert [quality.scales_for(n) for n in (10, 40, 100, 182)] == [(3, 2), (3, 4), (7, 4), (11, 5)]
    assert abs(quality.ms_ssim(v, v) - 1) < 1e-9 and quality.ms_ssim(v + rng.normal(size=v.shape) * 20, v) < 1
    assert quality.ms_ssim(np.full((64, 64, 64), 42.0), np.full((64, 64, 64), 42.0)) == 1.0
    assert math.isnan(quality.ms_ssim(v[:2], v[:2])) and math.isnan(quality.ms_ssim(v[:32], v[:32]))
    mask = np.zeros(v.shape)
    mask[5:35, 5:35, 5:35] = 1
    outside = np.where(mask, v, rng.uniform(size=v.shape) * 100)
    assert abs(quality.ms_ssim(outside, v, mask) - 1) < 1e-9 and quality.ms_ssim(outside, v) < 0.99
    assert quality._halved(np.ones((5, 4, 4))).shape == (3, 2, 2) and quality._halved(np.ones((5, 4, 4)))[0, 0, 0] == 0.5
    # by loops over windows, two scales written out for a side of 34
    a, b = v[:34, :34, :34], v[:34, :34, :34] + rng.normal(size=(34, 34, 34)) * 5
    assert 0.5 < quality.ms_ssim(b, a) < 1 and quality.scales_for(34) == (3, 4)
    assert abs(quality.ssim_slice(v[0], v[0], np.ptp(v[0])) - 1) < 1e-12
    assert math.isnan(quality.ssim_slice(v[0, :3], v[0, :3], 1.0))


def test_slices_across_each_axis(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(9, 8, 12))
    b = a + rng.normal(size=a.shape) * 0.3
    lines = as_lines(spark, 3, a=a, b=b)
    for i, axis in enumerate("zyx"):
        for gaussian in (False, True):
            f = quality.ssim_gaussian if gaussian else quality.ssim_slice
            want = [f(np.take(a, k, i), np.take(b, k, i), float(np.ptp(np.take(a, k, i)))) for k in range(a.shape[i])]
            got = {r[axis]: r.s for r in quality.ssim_slices(lines, "a", "b", a.shape, axis, gaussian=gaussian).collect()}
            assert np.allclose([got[k] for k in range(a.shape[i])], want)
            assert abs(quality.ssim_slicewise(lines, "a", "b", a.shape, axis, gaussian=gaussian).first().ssim - np.mean(want)) < 1e-9
    with pytest.raises(ValueError):
        quality.ssim_slicewise(lines, "a", "b", a.shape, "t")


def test_kernels():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 7, 8))
    assert np.abs(kernels.spline_zoom(x, x.shape) - x).max() < 1e-12
    line = np.arange(5.0)[:, None, None] * np.ones((5, 3, 3))
    for order in (0, 1, 3):
        up = kernels.spline_zoom(line, (9, 3, 3), order)
        assert up.shape == (9, 3, 3) and np.allclose(up[[0, -1]], line[[0, -1]], atol=1e-9)
    assert abs(kernels.laplacian_of_gaussian(np.full((9, 9, 9), 3.0), 1.0)).max() < 0.05
    mask = np.zeros((5, 5, 5), bool)
    mask[0, 0, 0:2] = mask[3, 1:4, 3] = True
    assert kernels.largest_component(mask).sum() == 3
    corner = np.zeros((2, 2, 2), bool)
    corner[0, 0, 0] = corner[1, 1, 1] = True
    assert kernels.largest_component(corner, 18).sum() == 1 and kernels.largest_component(corner, 26).sum() == 2
    with pytest.raises(ValueError):
        kernels.largest_component(np.zeros((2, 2, 2), bool))


def test_stencils_by_loop(spark):
    shape = (4, 3, 5)
    x = np.random.default_rng(7).normal(size=shape)
    lines = as_lines(spark, 0, hr=x)
    p = np.pad(x, 1, mode="edge")
    for name, smooth in kernels.SMOOTH.items():
        rows = kernels.gradients(lines, operator=name).collect()
        for axis, column in enumerate(("gz", "gy", "gx")):
            got = as_volume(rows, column, shape)
            for v in np.ndindex(shape):
                box = p[v[0] : v[0] + 3, v[1] : v[1] + 3, v[2] : v[2] + 3]
                assert np.allclose(got[v], np.einsum("ijk,i,j,k", box, *[(-1, 0, 1) if a == axis else smooth for a in range(3)]))
    with pytest.raises(ValueError):
        kernels.gradients(lines, operator="none")
    var = as_volume(kernels.local_variance(lines).collect(), "lvar", shape)
    assert np.allclose(var, np.maximum(0, kernels.box_mean(x * x, 2) - kernels.box_mean(x, 2) ** 2))
    g = kernels.sobel_magnitude(x)
    weights = as_volume(kernels.edge_weights(lines, 2.0, 1.5).collect(), "ew", shape)
    assert np.allclose(weights, 1 + 2 * (g / (g.max() + 1e-6)) ** 1.5)
    assert (as_volume(kernels.edge_weights(lines, 0.0).collect(), "ew", shape) == 1).all()


def test_queries_in_numpy_by_their_numpy(spark):
    """Queries that no SQL can say, against the same steps over volumes put together from SQL."""
    import duckdb

    from voxloom.plans import scenes, volumes
    from voxloom.sources.tables import VOXELS_SQL

    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    v = duckdb.sql(f"WITH {VOXELS_SQL} SELECT patient, z, y, x, hr, e1, e2 FROM vox ORDER BY patient, z, y, x").df()
    stack = lambda c: v[c].to_numpy().reshape(-1, *volumes.SHAPE)
    hr, e1, e2 = stack("hr"), stack("e1"), stack("e2")
    got = {r.patient: r.voxels for r in volumes.brain_mask_sizes(spark, sf).collect()}
    assert got == {i: int(kernels.brain_mask(x + 0.3).sum()) for i, x in enumerate(hr)}
    got = {r.patient: r.mae for r in volumes.spline_zoom(spark, sf).collect()}
    for i, x in enumerate(hr):
        half = kernels.spline_zoom(x, tuple(n // 2 for n in x.shape), 1)
        assert abs(got[i] - np.abs(kernels.spline_zoom(half, x.shape) - x).mean()) < 1e-6
    got = {r.patient: r.ms_ssim for r in volumes.ms_ssim_3d(spark, sf).collect()}
    for i in range(len(hr)):
        want = quality.ms_ssim(kernels.spline_zoom(e2[i], (40, 40, 64), 1), kernels.spline_zoom(hr[i], (40, 40, 64), 1))
        assert abs(got[i] - want) < 1e-6 and not math.isnan(want)
    got = {r.patient: r.mmd for r in scenes.multi_feature_mmd(spark, sf).collect()}
    for i in range(len(hr)):
        parts = []
        for x in (hr[i], e1[i]):
            var = np.maximum(0, kernels.box_mean(x * x, 2) - kernels.box_mean(x, 2) ** 2)
            parts.append(np.stack([kernels.sobel_magnitude(x), *[kernels.laplacian_of_gaussian(x, s) for s in (1, 2, 4)], var], axis=-1)[hr[i] > 0])
        both = np.concatenate(parts)
        spread = both.std(axis=0)
        a, b = ((p - both.mean(axis=0)) / np.where(spread > 1e-8, spread, 1.0) for p in parts)
        kernel = lambda p, q: (p @ q.T / 5 + 1) ** 3
        within = lambda p: (kernel(p, p).sum() - np.trace(kernel(p, p))) / (len(p) * (len(p) - 1))
        assert abs(got[i] - max(0, within(a) + within(b) - 2 * kernel(a, b).mean())) < 1e-4


def test_tails():
    assert abs(special.normal_sf2(1.959963984540054) - 0.05) < 1e-12
    assert abs(special.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10
    assert abs(special.chi2_sf(30.0, 10) - 0.0008566412) < 1e-9
    assert abs(special.t_sf2(2.2281388519649385, 10) - 0.05) < 1e-9


def test_shapiro_wilk_published_example():
    """The eleven weights of the method's paper: W = 0.79, p < 0.01; and what a normal sample gives."""
    w, p = special.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.7888) < 0.002 and 0.005 < p < 0.01
    assert special.shapiro_wilk(list(np.random.default_rng(1).normal(size=200)))[1] > 0.05
    assert special.shapiro_wilk(list(np.random.default_rng(1).exponential(size=200)))[1] < 1e-6
    assert math.isnan(special.shapiro_wilk([1.0, 1.0, 1.0])[0]) and math.isnan(special.shapiro_wilk([1.0])[0])


def test_masks_and_resampling():
    ball = (np.indices((15, 15, 15)) - 7) ** 2
    shell = (ball.sum(0) <= 36) & (ball.sum(0) >= 9)
    assert np.array_equal(kernels.fill_holes(shell), ball.sum(0) <= 36)
    x = np.where(ball.sum(0) <= 25, 30.0 - ball.sum(0) * 0.5, 0.0)
    x[0, 0, 0] = 9.0
    mask = kernels.brain_mask(x, 0)
    assert mask[7, 7, 7] and not mask[0, 0, 0] and not kernels.brain_mask(np.zeros((5, 5, 5))).any()
    v = np.random.default_rng(1).normal(size=(4, 5, 6))
    shift = np.eye(4)
    shift[0, 3] = 1
    for order in (0, 1):
        assert np.allclose(geometry.resample(v, np.eye(4), np.eye(4), v.shape, order), v)
        moved = geometry.resample(v, np.eye(4), shift, v.shape, order)
        assert np.allclose(moved[:-1], v[1:]) and not moved[-1].any()
    assert abs(quality.ssim_gaussian(v, v) - 1) < 1e-12 and math.isnan(quality.ssim_gaussian(v[:2], v[:2]))


def test_spread_out_by_full_scan(spark):
    peaks = [(0, z, y, x, 100.0 - abs(z - 8) - abs(y - 8) - abs(x - 8)) for z in range(16) for y in range(16) for x in range(16)]
    peaks += [(1, z, y, x, float((z * 7 + y * 3 + x * 5) % 11)) for z in range(5) for y in range(5) for x in range(5)] + [(2, 0, 0, 0, 1.0), (2, 0, 0, 1, 2.0)]
    for apart in (4.0, 7.5):
        got = geometry.spread_out(spark.createDataFrame(peaks, "k int, z int, y int, x int, s double"), "s", ["z", "y", "x"], ["k"], 5, apart).orderBy("k", "rank").collect()
        for k in (0, 1, 2):
            want: list[tuple] = []
            for least in (apart, apart / 2):
                for p in sorted((p for p in peaks if p[0] == k), key=lambda p: (-p[4], p[1:4])):
                    if len(want) < 5 and all(math.dist(p[1:4], o[1:4]) >= least for o in want):
                        want.append(p)
            assert [(r.rank, r.k, r.z, r.y, r.x, r.s) for r in got if r.k == k] == [(i + 1, *p) for i, p in enumerate(want)]
        assert sum(r.k == 0 for r in got) == 5


def test_rank_statistics_with_ties(spark):
    m = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 2.0), ("k", "a", 3.0), ("k", "b", 1.0)], "key string, side string, v double")
    assert abs(stats.cliffs_delta(m, "v", "side", "a", "b", ["key"]).first().delta - 2 / 3) < 1e-12
    d = spark.createDataFrame([("k", x) for x in (1.0, 1.0, -1.0, 2.0, 3.0, 0.0, -2.0)], "key string, d double")
    w = stats.wilcoxon(d, ["key"]).first()
    assert (w.n, w.w) == (6, 6.5)
    p = spark.createDataFrame([("f", str(i), x) for i, x in enumerate((0.01, 0.04, 0.03, 0.005))], "f string, t string, p double")
    holm = {r.t: round(r.p_adj, 6) for r in stats.adjust(p, "p", "holm", ["f"], ["t"]).collect()}
    assert holm == {"3": 0.02, "0": 0.03, "2": 0.06, "1": 0.06}
    with pytest.raises(ValueError):
        stats.adjust(p, "p", "other", ["f"], ["t"])


def test_mixed_model_equals_cell_means_when_complete():
    rng = np.random.default_rng(0)
    unit, cell = np.repeat(np.arange(30), 3), np.tile(np.arange(3), 30)
    y = rng.normal(size=30)[unit] * 2 + cell + rng.normal(size=90)
    b, cov, noise, between = stats.fit_random_intercept(y, np.eye(3)[cell], unit)
    assert np.allclose(b, [y[cell == k].mean() for k in range(3)])
    assert 0.5 < noise < 2 and 1 < between < 9 and (np.diag(cov) > 0).all()


def test_mixed_model_from_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(p, int(u), f"m{c % 3}", f"s{c // 3}", float(u % 7 + c + rng.normal())) for p in ("A", "R") for u in range(12) for c in range(6) for _ in range(rng.integers(0, 3))]
    df = spark.createDataFrame([*rows, ("A", 1, "m0", "s0", None)], "pulse string, unit int, model string, spacing string, v double")
    # one task gets a row for each size and pair of cells, however many units there are
    many = df.union(df.withColumn("unit", F.col("unit") + 12)).union(df.withColumn("unit", F.col("unit") + 24))
    sums = [stats.unit_sums(d, "v", "unit", "model", "spacing", ["pulse"]).count() for d in (df, many)]
    assert sums[0] == sums[1]
    got = {(r.pulse, r.model, r.spacing): r for r in stats.mixed_model_means(df, "v", "unit", "model", "spacing", ["pulse"]).collect()}
    contrasts = {(r.pulse, r.model, r.spacing): r for r in stats.mixed_model_contrasts(df, "v", "unit", "model", "spacing", ["pulse"]).collect()}
    for p in ("A", "R"):
        own = [r for r in rows if r[0] == p]
        cells = sorted({r[2:4] for r in own})
        unit, y = np.array([r[1] for r in own]), np.array([r[4] for r in own])
        x = np.eye(len(cells))[[cells.index(r[2:4]) for r in own]]
        # REML by the full covariance matrix, over the same search
        def at(r, x=x, y=y, unit=unit):
            w = np.linalg.inv(np.eye(len(y)) + r * (unit[:, None] == unit[None, :]))
            a = x.T @ w @ x
            b = np.linalg.solve(a, x.T @ w @ y)
            s2 = (y - x @ b) @ w @ (y - x @ b) / (len(y) - x.shape[1])
            return (len(y) - x.shape[1]) * np.log(s2) - np.linalg.slogdet(w)[1] + np.linalg.slogdet(a)[1], b, np.linalg.inv(a) * s2
        lo, hi, g = -12.0, 12.0, (np.sqrt(5) - 1) / 2
        for _ in range(35):
            c, d = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, d) if at(np.exp(c))[0] < at(np.exp(d))[0] else (c, hi)
        _, b, cov = at(np.exp((lo + hi) / 2))
        for k, cell in enumerate(cells):
            r = got[(p, *cell)]
            assert abs(r["mean"] - b[k]) < 1e-5 and abs(r.se - np.sqrt(cov[k, k])) < 1e-5 and r.n_units == len({q[1] for q in own if q[2:4] == cell})
            if cell[0] != "m0":
                j = cells.index(("m0", cell[1]))
                assert abs(contrasts[(p, *cell)].estimate - (b[k] - b[j])) < 1e-5


def test_fit_with_edges_and_gradients(spark):
    """The ensemble's fit against equations summed by hand."""
    rng = np.random.default_rng(11)
    shape, experts = (4, 4, 8), ["e1", "e2", "e3"]
    hr = rng.normal(size=shape) + 0.5
    made = {e: hr + rng.normal(size=shape) * s for e, s in zip(experts, (0.2, 0.4, 0.8), strict=True)}
    lines, g = as_lines(spark, 0, hr=hr, **made), tiling.Grid(shape, (4, 4, 4), (4, 4, 4))
    edge = kernels.sobel_magnitude(hr)
    diff = lambda x, a: np.take(np.pad(x, [(1, 1) if i == a else (0, 0) for i in range(3)], mode="edge"), np.arange(2, x.shape[a] + 2), a) - np.take(np.pad(x, [(1, 1) if i == a else (0, 0) for i in range(3)], mode="edge"), np.arange(x.shape[a]), a)
    for strength, gradient in ((0.0, 0.0), (2.0, 0.0), (1.5, 0.7)):
        got = {r.rid: r for r in ensemble.fit(lines, g, experts, tau=0.0, edge=strength, gradient=gradient).collect()}
        ew = 1 + strength * edge / (edge.max() + 1e-6)
        for rid in (0, 1):
            inside = np.zeros(shape, bool)
            inside[:, :, 4 * rid : 4 * rid + 4] = True
            inside &= hr > 0
            q, b = np.zeros((3, 3)), np.zeros(3)
            for factor, f in [(1.0, lambda x: x), *[(gradient, lambda x, a=a: diff(x, a)) for a in range(3)]]:
                x = np.stack([f(made[e])[inside] for e in experts])
                q += factor * (x * ew[inside]) @ x.T
                b += factor * (x * ew[inside]) @ f(hr)[inside]
            w = stacking.solve_simplex(q, b)
            assert np.allclose([got[rid].w1, got[rid].w2, got[rid].w3], w, atol=1e-6) and got[rid].vox == inside.sum() and got[rid].method == "active_set"
    nowhere = ensemble.fit(lines, g, experts, mask=F.col("x") < 4).collect()
    assert {(r.rid, r.success, r.method) for r in nowhere} == {(0, True, "active_set"), (1, False, "uniform")}


def test_mixed_model_with_regions(spark):
    rng = np.random.default_rng(8)
    rows = [("A", u, f"m{c}", f"s{k}", f"r{i}", float(u % 5 + 2 * c - k + 3 * i + rng.normal())) for u in range(14) for c in range(2) for k in range(2) for i in range(3) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "pulse string, unit int, model string, spacing string, roi string, v double")
    got = {(r.model, r.spacing): r for r in stats.mixed_model_means(df, "v", "unit", "model", "spacing", ["pulse"], "roi").collect()}
    cells = sorted({r[2:4] for r in rows})
    x = np.array([[float(r[2:4] == c) for c in cells] + [float(r[4] == f"r{i}") for i in (1, 2)] for r in rows])
    y, unit = np.array([r[5] for r in rows]), np.array([r[1] for r in rows])
    b, cov, _, _ = stats.fit_random_intercept(y, x, unit)
    for k, c in enumerate(cells):
        each = [np.r_[np.eye(4)[k], e] for e in ([0, 0], [1, 0], [0, 1])]
        assert abs(got[c]["mean"] - np.mean([e @ b for e in each])) < 1e-5 and abs(got[c].se - np.sqrt(np.mean([e @ cov @ e for e in each]))) < 1e-5 and got[c].method == "mixed"
    contrast = {r.spacing: r for r in stats.mixed_model_contrasts(df, "v", "unit", "model", "spacing", ["pulse"], None, "roi").collect()}
    for s, (i, j) in {"s0": (2, 0), "s1": (3, 1)}.items():
        assert abs(contrast[s].estimate - (b[i] - b[j])) < 1e-5 and abs(contrast[s].se - np.sqrt(cov[i, i] + cov[j, j] - 2 * cov[i, j])) < 1e-5
    # a region that only one cell has can't be told from it: least squares with errors by unit
    alone = df.withColumn("roi", F.concat("model", "spacing"))
    plain = {(r.model, r.spacing): r for r in stats.mixed_model_means(alone, "v", "unit", "model", "spacing", ["pulse"], "roi").collect()}
    assert {r.method for r in plain.values()} == {"least squares"} and all(r.se >= 0 for r in plain.values())


def test_small_helpers(spark):
    rows = spark.createDataFrame([("A", 1.0), ("B", None), ("A'", float("nan"))], "m string, v double")
    assert aggregate.require_columns(rows, "m", "v") is rows
    with pytest.raises(ValueError, match="w"):
        aggregate.require_columns(rows, "m", "w")
    assert [r.m for r in aggregate.renamed(rows, "m", {"A'": "A"}).collect()] == ["A", "B", "A"]
    three = rows.select(aggregate.row_mean(["v", "v"]).alias("x")).collect()
    assert [r.x for r in three] == [1.0, None, None]
    labels = spark.createDataFrame([("3mm",), ("12mm",), ("x",), (None,)], "s string")
    assert [r.n for r in labels.select(coverage.spacing_of("s").alias("n")).collect()] == [3, 12, None, None]
    v = spark.createDataFrame([(1, 0, 0, 0, 1.0, 1.0), (1, 0, 0, 1, 2.0, 4.0), (2, 0, 0, 0, 1.0, 1.0), (2, 0, 0, 1, 1.0, 2.0), (3, 0, 0, 0, 1.0, 1.0)], "patient int, z int, y int, x int, a double, b double")
    p = {r.patient: r for r in quality.psnr_variants(v, "a", "b", F.col("patient") < 3, ["patient"]).collect()}
    assert math.isnan(p[2].clinical) and p[2].plain is None and math.isnan(p[3].clinical) and p[3].plain == math.inf
    assert abs(p[1].clinical - 10 * math.log10(1 / 2)) < 1e-9 and abs(p[1].joint - 10 * math.log10(9 / 2)) < 1e-9


def test_dice_and_folds(spark):
    v = spark.createDataFrame([(0, a, b) for a, b in [(3, 3)] * 12 + [(3, 17)] * 4 + [(17, 17)] * 8], "patient int, a int, b int")
    labels = spark.createDataFrame([("l3", 3), ("l17", 17), ("none", 9)], "region string, label int")
    got = {r.region: r.dice for r in quality.dice(v, "a", "b", labels, ["patient"]).collect()}
    assert got == {"l3": 2 * 12 / 28, "l17": 2 * 8 / 20, "none": 1.0}
    units = spark.createDataFrame([(f"P{i}",) for i in range(1, 8)], "u string")
    folds = coverage.kfold(units, "u", 3, F.col("u"))
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [2, 2, 3]
    with pytest.raises(ValueError):
        coverage.kfold(units, "u", 9, F.col("u"))
    assert coverage.config_hash({"b": 1, "a": 2}) == coverage.config_hash({"a": 2, "b": 1})


def test_volume_files(spark, tmp_path):
    rng = np.random.default_rng(42)
    v, affine = rng.normal(size=(4, 5, 6)).astype(np.float32), np.eye(4)
    affine[:3, 3] = (1, 2, 3)
    for compress in (True, False):
        back, a = volume_store.read_nifti(volume_store.write_nifti(v, affine, compress))
        assert np.array_equal(back, v) and np.array_equal(a, affine)
    (tmp_path / "P1-t1c.nii.gz").write_bytes(volume_store.write_nifti(v, affine))
    np.save(tmp_path / "P2-t1c.npy", v)
    (tmp_path / "P3-t1c.npy").write_bytes(b"broken")
    got = volume_store.read_arrays(spark, str(tmp_path)).toPandas()
    assert got.groupby("patient_id").size().to_dict() == {"P1": 120, "P2": 120, "P3": 1} and got.error.notna().sum() == 1
    store = spark.createDataFrame([("P1", 0, 0, 0, 1.5, "hr", "none", "3mm", "t1c"), ("P1", 0, 0, 1, 2.5, "hr", "none", "5mm", "t1c")], volume_store.SCHEMA)
    volume_store.write_volumes(store, str(tmp_path / "store"))
    volume_store.write_volumes(store.where("spacing = '5mm'").withColumn("value", F.col("value") + 1), str(tmp_path / "store"))
    assert {(r.spacing, r.value) for r in volume_store.read_volumes(spark, str(tmp_path / "store")).collect()} == {("3mm", 1.5), ("5mm", 3.5)}
    assert volume_store.read_volumes(spark, str(tmp_path / "store"), spacing="3mm").count() == 1
    assert volume_store.keyspace(store).count() == 2


def test_documents_and_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"folds": [{"train": ["P3", "P4"], "test": ["P1"]}, {"train": ["P1"], "test": ["P3", "P4"]}]}))
    m = volume_store.read_manifest(spark, str(tmp_path / "m.json"))
    assert {(r.fold, r.split, r.patient_id) for r in m.where("split = 'test'").collect()} == {(1, "test", "P1"), (2, "test", "P3"), (2, "test", "P4")}
    assert json.loads(volume_store.manifest_json(m))["folds"][0] == {"train": ["P3", "P4"], "test": ["P1"]}
    (tmp_path / "qc.csv").write_text("subject,qc,note\nP1-t1c.nii.gz,.85,x\nP2,.92,\n")
    assert {(r.patient_id, r.value) for r in volume_store.read_wide_csv(spark, str(tmp_path / "qc.csv")).collect()} == {("P1-t1c", 0.85), ("P2", 0.92)}
    s = spark.createDataFrame([("m", "3mm", 0.5, 0.1), ("m", "5mm", 0.25, None), ("n", "3mm", 1.0, 0.0)], "model string, spacing string, mean double, std double")
    tex = volume_store.latex_table(s, "model", "spacing", "mean", "std")
    assert "0.5000 $\\pm$ 0.1000" in tex and "---" in tex


def test_streamed_sums_equal_batch(spark, tmp_path):
    from voxloom.sources.tables import voxels
    from voxloom.streaming import statistics

    v = voxels(spark, "/root/testdata/sf0.001").select("patient", "z", "y", "x", "hr", "e1", "e2")
    for p in range(3):
        v.where(F.col("patient") == p).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    g = tiling.Grid((10, 10, 64), (4, 4, 8), (4, 4, 8))
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    statistics.store(statistics.running_equations(stream, g, ["e1", "e2"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.rid: (r.vox, round(r.q11, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = stacking.normal_equations(v.where("patient < 3").withColumn("rid", g.label()), ["e1", "e2"], where=F.col("hr") > 0)
    assert got == {r.rid: (r.vox, round(r.q11, 6)) for r in want.collect()}


def test_stores_and_configuration(spark, tmp_path):
    w = spark.createDataFrame([(0, 0.25, 0.75), (1, 0.5, 0.5)], "rid int, w1 double, w2 double")
    for fold in (1, 2, 1):
        results.write_weights(w.withColumn("w1", F.col("w1") * fold), str(tmp_path / "w"), fold=fold, spacing="3mm")
    assert results.read_weights(spark, str(tmp_path / "w")).count() == 4
    read = results.weight_analysis(results.read_weights(spark, str(tmp_path / "w"), fold=1), ["w1", "w2"]).orderBy("rid").collect()
    assert [r.dominant for r in read] == [1, 0] and abs(read[1].entropy - math.log(2)) < 1e-6
    results.write_tables({"emm": w, "icc": w.limit(1)}, str(tmp_path / "t"), {"baseline": "a"})
    tables, meta = results.read_tables(spark, str(tmp_path / "t"))
    assert meta["baseline"] == "a" and {n: t.count() for n, t in tables.items()} == {"emm": 2, "icc": 1}
    results.write_metrics(w.withColumns({"model": F.lit("a"), "spacing": F.lit("3mm"), "pulse": F.lit("t1")}), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"data": "d", "fit": {"patch": [4, 4, 8]}}))
    (tmp_path / "c.toml").write_text('data = "d"\nfolds = 5\n[fit]\ntau = 0.5\n')
    assert config.load(str(tmp_path / "c.json"), folds=4).folds == 4 and config.load(str(tmp_path / "c.toml")).fit.tau == 0.5
    for bad in ({"data": ""}, {"data": "d", "folds": 1}, {"data": "d", "fit": {"stride": [9, 4, 8]}}, {"data": "d", "what": 1}, {"data": "d", "fit": {"experts": ["e1"]}}, {"data": "d", "fit": {"taper": "x"}}):
        with pytest.raises(ValueError):
            config.from_dict(bad)
    m = spark.createDataFrame([(1, "train", "a"), (1, "test", "b"), (2, "train", "b"), (2, "test", "b"), (3, "train", "c")], "fold int, split string, patient_id string")
    assert len(config.manifest_problems(m)) == 3
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("a,c\n3,4\n")
    assert sorted(map(tuple, volume_store.read_csv(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.csv")]).collect())) == [("1", "2", None), ("3", None, "4")]
    assert volume_store.read_csv(spark, str(tmp_path / "x.csv"), "a int, b int").first() == (1, 2)


def test_stages_resume_where_they_failed(spark, tmp_path):
    folder = stages.folder_for(spark, str(tmp_path / "runs"), "e", True)
    c = config.from_dict({"data": "/root/testdata/sf0.001"})
    broken = [s if s.name != "evaluate" else stages.Stage("evaluate", s.tasks, lambda run, task, s=s: s.do(run, task) if task != "fold2" else 1 / 0) for s in stages.STAGES]
    assert all(what == "run" for _, _, what in stages.run(spark, c, folder, dry=True))
    with pytest.raises(ZeroDivisionError):
        stages.run(spark, c, folder, stages=broken)
    log = results.StatusLog(spark, f"{folder}/status")
    assert {(r.stage, r.task_id) for r in log.latest().where("status = 'failed'").collect()} == {("evaluate", "fold2")}
    assert stages.folder_for(spark, str(tmp_path / "runs"), "e", True).endswith(folder.split("/")[-1])
    done = stages.run(spark, c, folder)
    assert [x for x in done if x[2] == "run"] == [("evaluate", "fold2", "run"), ("evaluate", "fold3", "run"), ("analyse", "all", "run"), ("summarise", "all", "run")]
    assert log.errors().count() == 1 and log.latest().where("status <> 'completed'").count() == 0
    assert {r.metric for r in spark.read.parquet(f"{folder}/summarise").collect()} == {"mse", "mae", "psnr", "ssim"}
    assert spark.read.parquet(f"{folder}/evaluate").select("patient").distinct().count() == 5
    assert all(what == "skip" for _, _, what in stages.run(spark, c, folder))


def test_ingest_and_export(spark, tmp_path):
    rng = np.random.default_rng(1)
    affine = np.array([[0, -1.0, 0, 5], [2.0, 0, 0, 6], [0, 0, 3.0, 7], [0, 0, 0, 1]])
    (tmp_path / "in").mkdir()
    vols = {p: rng.normal(size=(2, 3, 4)).astype(np.float32) for p in ("P1", "P2")}
    for p, v in vols.items():
        (tmp_path / "in" / f"{p}-t1.nii.gz").write_bytes(volume_store.write_nifti(v, affine))
    store, wanted = str(tmp_path / "store"), spark.createDataFrame([("P1", "t1"), ("P9", "t1")], "patient_id string, pulse string")
    first = {(r.patient_id, r.state) for r in volume_lines.ingest(spark, str(tmp_path / "in"), store, "hr", wanted=wanted).collect()}
    assert first == {("P1", "stored"), ("P2", "stored"), ("P9", "missing")}
    (tmp_path / "in" / "P3-t1.npy").write_bytes(b"broken")
    again = {(r.patient_id, r.state.split(":")[0]) for r in volume_lines.ingest(spark, str(tmp_path / "in"), store, "hr").collect()}
    assert again == {("P1", "skipped"), ("P2", "skipped"), ("P3", "ValueError")}
    volume_lines.write_files(volume_lines.read(spark, store), str(tmp_path / "out"))
    written = sorted((tmp_path / "out").rglob("*"))
    assert [p.name for p in written if p.is_file()] == ["P1-t1.nii.gz", "P2-t1.nii.gz"]
    back, placed = volume_store.read_nifti(next((tmp_path / "out").rglob("P1-t1.nii.gz")).read_bytes())
    assert np.allclose(back, vols["P1"]) and np.allclose(placed, affine)
    times = [p.stat().st_mtime_ns for p in written if p.is_file()]
    volume_lines.write_files(volume_lines.read(spark, store), str(tmp_path / "out"))
    assert times == [p.stat().st_mtime_ns for p in written if p.is_file()]
    keys = spark.createDataFrame([("P1", "blend", "fold1"), ("P1", "blend", "fold2"), ("P1", "hr", None)], "patient_id string, kind string, model string").withColumns({"spacing": F.lit("3mm"), "pulse": F.lit("t1")})
    plan = volume_store.export_plan(keys, spark.createDataFrame([("P1", 2)], "patient_id string, fold int"))
    assert {(r.kind, r.model) for r in plan.collect()} == {("blend", "fold2"), ("hr", None)}
    turned, a = volume_store.load_oriented(vols["P1"], affine, "RAS")
    assert all(a[i, i] > 0 for i in range(3)) and turned.shape == (3, 2, 4)
    p = np.array([1, 1, 2])  # one voxel's place in the world stays
    world = affine @ [*p, 1]
    i = np.rint(np.linalg.inv(a) @ world)[:3].astype(int)
    assert turned[tuple(i)] == vols["P1"][tuple(p)]
    same, _ = volume_store.load_oriented(vols["P1"], np.eye(4), "RAS", like=(np.eye(4), (2, 3, 4)))
    assert np.allclose(same, vols["P1"])


def test_command_line(capsys):
    assert main(["list"]) == 0 and "simplex_weights_m2" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "no_query", "--data", "x", "--out", "y"])


@pytest.fixture(scope="module")
def with_gaps(spark, tmp_path_factory):
    """Embeddings of which the last volume ends in its third slice, and one volume has its last slice but for two lines."""
    sf = str(tmp_path_factory.mktemp("gaps"))
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id < 326 AND (vec_id < 192 OR vec_id >= 200 OR vec_id IN (192, 193))")
    rows.write.parquet(f"{sf}/embeddings.parquet")
    return sf


@pytest.mark.parametrize("name", ["resampled_grid", "linear_zoom", "variance_peaks", "roi_metric_cube", "ssim_slicewise", "ssim_gaussian_slices"])
def test_volumes_that_lack_lines(spark, with_gaps, name):
    import duckdb
    from oracle import assert_same

    from voxloom.plans import volumes

    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{with_gaps}/embeddings.parquet/*.parquet'")
        assert_same(volumes.QUERIES[name](spark, with_gaps), c.sql(volumes.SQL[name]).df())
