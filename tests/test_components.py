"""Components, holes and morphology on lines against numpy volumes."""

from __future__ import annotations

import numpy as np
import pytest
from test_numbers import as_lines, as_volume

from voxloom.operators import components, kernels

KEYS = ["patient"]


def lines_of(spark, masks):
    rows = [(p, z, y, m[z, y].tolist()) for p, m in masks.items() for z in range(m.shape[0]) for y in range(m.shape[1])]
    kind = "boolean" if next(iter(masks.values())).dtype == bool else "double"
    return spark.createDataFrame(rows, f"patient int, z int, y int, mask array<{kind}>")


def volumes(seed=0):
    rng = np.random.default_rng(seed)
    snake = np.zeros((7, 7, 7), bool)
    snake[::2] = True
    snake[1, 0, 0] = snake[3, 6, 6] = snake[5, 0, 6] = True  # one long winding part
    apart = np.zeros((4, 4, 4), bool)
    apart[0, 0, :2] = apart[3, 3, 2:] = True  # two of one size
    return {0: rng.random((5, 6, 9)) < 0.3, 1: rng.random((5, 6, 9)) < 0.5, 2: snake, 3: apart, 4: np.ones((2, 3, 4), bool), 5: np.zeros((2, 2, 2), bool)}


def mask_of(intervals, shape):
    out = np.zeros(shape, bool)
    for r in intervals:
        out[r.z, r.y, r.x0 : r.x1 + 1] = True
    return out


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_largest_by_numpy(spark, connectivity):
    masks = volumes()
    found = components.largest(lines_of(spark, masks), "mask", KEYS, connectivity).collect()
    for p, m in masks.items():
        want = kernels.largest_component(m, connectivity) if m.any() else m
        assert (mask_of([r for r in found if r.patient == p], m.shape) == want).all(), p
    with pytest.raises(ValueError):
        components.components(lines_of(spark, masks), "mask", KEYS, 8)


def test_labels_are_told_apart(spark):
    x = np.random.default_rng(3).integers(0, 3, (4, 5, 6))
    lines = lines_of(spark, {0: x.astype(float)})
    parts = components.components(lines, "mask", KEYS, 26)
    found = sorted((r.label, r.voxels) for r in components.sizes(parts, KEYS).collect())
    want = []
    for level in range(3):
        left = x == level
        while left.any():
            one = kernels.largest_component(left, 26)
            want.append((float(level), int(one.sum())))
            left &= ~one
    assert found == sorted(want)
    assert components.components(lines.limit(0), "mask", KEYS).count() == 0


def test_morphology_by_numpy(spark):
    masks = {p: m for p, m in volumes(4).items()} | {6: np.random.default_rng(9).random((7, 8, 9)) < 0.9}
    lines = lines_of(spark, masks)
    grown, shrunk = (f(lines, "mask", KEYS, 2).collect() for f in (components.dilated, components.eroded))
    filled = components.holes_filled(lines, "mask", KEYS).collect()
    for p, m in masks.items():
        of = lambda rows: as_volume([r for r in rows if r.patient == p], "mask", m.shape)  # noqa: B023, E731
        assert (of(grown) == kernels._grown(m, 2)).all()
        assert (of(shrunk) == ~kernels._grown(~np.pad(m, 2), 2)[2:-2, 2:-2, 2:-2]).all()
        assert (of(filled) == kernels.fill_holes(m)).all()


def test_brain_mask_by_numpy(spark):
    rng = np.random.default_rng(2)
    ball = np.linalg.norm(np.indices((12, 12, 12)) - 5.5, axis=0)
    head = np.where(ball < 5, 1.0, 0.01) + 0.05 * rng.random((12, 12, 12))
    head[5:7, 5:7, 5:7] = 0  # a hole
    head[0, 0, :3] = 2.0  # a part of its own
    at_edge = rng.normal(size=(8, 9, 10)) + 1.5
    data = {0: head, 1: at_edge, 2: -np.ones((3, 4, 5)), 3: np.where(ball < 3, 1.0, 0.0)}
    rows = components.brain_mask(lines_of(spark, data), "mask", KEYS).collect()
    for p, x in data.items():
        got = as_volume([r for r in rows if r.patient == p], "mask", x.shape)
        assert (got == kernels.brain_mask(x)).all(), p


def test_brain_mask_of_missing_lines(spark):
    """A volume that lacks lines: what they hide is no path out of a hole and no part of the mask before closing, which may reach into them."""
    rng = np.random.default_rng(8)
    shape = (8, 9, 10)
    ball = np.linalg.norm(np.indices(shape) - np.array([3.5, 4.0, 4.5])[:, None, None, None], axis=0)
    x = np.where(ball < 4, 1.0, -0.01) + 0.005 * rng.random(shape)
    x[3:6, 3, 3:6] = -1.0  # a hole that ends where lines are missing
    there = np.ones(shape[:2], bool)
    there[5, 4:] = there[6:] = False
    lines = lines_of(spark, {0: x, 1: x}).where("patient = 1 OR z < 5 OR (z = 5 AND y < 4)")
    rows = components.brain_mask(lines, "mask", KEYS, shape=shape).collect()
    known = np.broadcast_to(there[:, :, None], shape)
    cut = np.percentile(x[known & (x > 0)], 5)
    back = known & ~(x > cut)
    seen = np.zeros(shape, bool)
    seen[[0, -1]] = seen[:, [0, -1]] = seen[:, :, [0, -1]] = True
    seen &= back
    while (grown := kernels._grown(seen, 1) & back).sum() > seen.sum():
        seen = grown
    filled = known & ~seen
    assert filled[3:6, 3, 3:6].all()
    opened = kernels._grown(~kernels._grown(~np.pad(filled, 2), 2)[2:-2, 2:-2, 2:-2], 2)
    best = np.pad(kernels.largest_component(opened, 6), 2)
    want = {0: (~kernels._grown(~kernels._grown(best, 2), 2))[2:-2, 2:-2, 2:-2], 1: kernels.brain_mask(x)}
    for p, w in want.items():
        got = as_volume([r for r in rows if r.patient == p], "mask", shape)
        assert (got == w).all(), p
    assert want[0].any()


@pytest.mark.parametrize(("at_once", "slab"), [(1 << 20, 32), (7, 32), (1 << 20, 2), (1, 1)])
def test_most_parts_are_contracted_in_tasks(spark, monkeypatch, at_once, slab):
    """Whatever tasks hold together, parts are the same; where they hold a part whole, it comes to the rounds as one star."""
    monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once)
    monkeypatch.setattr(components, "SLAB", slab)
    come, rounds = [], components.contracted
    monkeypatch.setattr(components, "contracted", lambda edges: come.append(edges.collect()) or rounds(edges))
    x = np.random.default_rng(4).integers(1, 4, (5, 6, 7))
    lines = as_lines(spark, 0, g=x.astype(float)).selectExpr("patient", "z", "y", "transform(g, v -> cast(v as int)) AS g")
    parts = components.components(lines, "g", ["patient"], 26)
    got = sorted((r.label, r.voxels) for r in components.sizes(parts, ["patient"]).collect())
    want = []
    for g in range(1, 4):
        left = x == g
        while left.any():
            one = kernels.largest_component(left, 26)
            left &= ~one
            want.append((g, int(one.sum())))
    assert got == sorted(want)
    if slab > 5 and at_once > 7:
        nodes = {r.a for r in come[0]}
        assert len(nodes) == len(come[0]) and not nodes & {r.b for r in come[0]} and all(r.b < r.a for r in come[0])
