"""Run lengths, zones and grey-tone differences on lines against loops over a small volume."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from test_numbers import as_lines

from voxloom.operators import kernels, radiomics

SHAPE = (4, 5, 6)


def levelled(spark, seed=0):
    x = np.random.default_rng(seed).integers(1, 5, SHAPE)
    x[0] = 2
    lines = as_lines(spark, 0, g=x.astype(float))
    return x, lines.selectExpr("patient", "z", "y", "transform(g, v -> cast(v as int)) AS g")


def test_run_lengths(spark):
    x, lines = levelled(spark)
    want: dict[tuple, int] = {}
    for axis, rows in (("x", x.reshape(-1, 6)), ("y", np.moveaxis(x, 1, 2).reshape(-1, 5))):
        for row in rows:
            for g, run in itertools.groupby(row):
                k = (axis, int(g), len(list(run)))
                want[k] = want.get(k, 0) + 1
    m = radiomics.run_lengths(lines, "g", ["patient"])
    assert {(r.axis, r.g, r["size"]): r.n for r in m.collect()} == want
    f = radiomics.run_length_features(m, ["patient"]).first()
    by_axis = [[(g, j, n) for (a, g, j), n in want.items() if a == axis] for axis in "xy"]
    mean = lambda of: sum(sum(of(g, j) * n for g, j, n in rows) / sum(n for *_, n in rows) for rows in by_axis) / 2
    assert f.short_run_emphasis == pytest.approx(mean(lambda g, j: 1 / j**2)) and f.high_grey_level_run_emphasis == pytest.approx(mean(lambda g, j: g * g))
    assert f.run_percentage == pytest.approx(sum(sum(n for *_, n in rows) / x.size for rows in by_axis) / 2)
    gln = sum(sum(sum(n for h, _, n in rows if h == g) ** 2 for g in range(1, 5)) / sum(n for *_, n in rows) for rows in by_axis) / 2
    assert f.grey_level_non_uniformity == pytest.approx(gln)


def test_zones(spark):
    x, lines = levelled(spark, 3)
    want: dict[tuple, int] = {}
    for g in range(1, 5):
        left = x == g
        while left.any():
            one = kernels.largest_component(left, 26)
            left &= ~one
            want[(g, int(one.sum()))] = want.get((g, int(one.sum())), 0) + 1
    m = radiomics.zone_sizes(lines, "g", ["patient"])
    assert {(r.g, r["size"]): r.n for r in m.collect()} == want
    f, nz = radiomics.zone_features(m, ["patient"]).first(), sum(want.values())
    mu = x.size / nz
    assert f.zone_variance == pytest.approx(sum(n * (j - mu) ** 2 for (_, j), n in want.items()) / nz)
    assert f.zone_entropy == pytest.approx(-sum(n / nz * math.log2(n / nz) for n in want.values()))
    assert f.small_area_emphasis == pytest.approx(sum(n / j**2 for (_, j), n in want.items()) / nz)


def test_tone_differences(spark):
    x, lines = levelled(spark, 5)
    n, s = {}, {}
    for v in np.ndindex(SHAPE):
        box = x[tuple(slice(max(0, i - 1), i + 2) for i in v)]
        g = int(x[v])
        n[g] = n.get(g, 0) + 1
        s[g] = s.get(g, 0.0) + abs(g - (box.sum() - g) / (box.size - 1))
    m = radiomics.tone_differences(lines, "g", ["patient"])
    for r in m.collect():
        assert r.n == n[r.g] and r.s == pytest.approx(s[r.g])
    f = radiomics.tone_features(m, ["patient"]).first()
    p = {g: n[g] / x.size for g in n}
    pairs = list(itertools.product(n, n))
    ps = sum(p[g] * s[g] for g in n)
    assert f.coarseness == pytest.approx(1 / ps)
    assert f.contrast == pytest.approx(sum(p[i] * p[j] * (i - j) ** 2 for i, j in pairs) / (len(n) * (len(n) - 1)) * sum(s.values()) / x.size)
    assert f.busyness == pytest.approx(ps / sum(abs(i * p[i] - j * p[j]) for i, j in pairs))
    assert f.complexity == pytest.approx(sum(abs(i - j) * (p[i] * s[i] + p[j] * s[j]) / (p[i] + p[j]) for i, j in pairs) / x.size)
    assert f.strength == pytest.approx(sum((p[i] + p[j]) * (i - j) ** 2 for i, j in pairs) / sum(s.values()))


def test_flat_and_empty_volumes(spark):
    flat = radiomics.levels(as_lines(spark, 0, v=np.full((2, 3, 4), 7.0)), "v", ["patient"], 8)
    assert [tuple(r) for r in radiomics.zone_sizes(flat, "g", ["patient"]).collect()] == [(0, 1, 24, 1)]
    f = radiomics.tone_features(radiomics.tone_differences(flat, "g", ["patient"]), ["patient"]).first()
    assert f.coarseness is None and f.contrast is None and f.complexity == 0
    none = flat.limit(0)
    for m in (radiomics.run_lengths, radiomics.zone_sizes, radiomics.tone_differences):
        assert m(none, "g", ["patient"]).count() == 0
