"""Connected components, holes and morphology of volumes kept as lines, whatever a volume's size.

Voxels are not rows: a line's true voxels are intervals, intervals of neighbouring lines that touch are edges, and
edges are contracted to stars: first in tasks, so many at a time, then what is left in rounds over all volumes at once. Erosion and dilation are minima and maxima of a
line, its shifted self and its neighbours. No task holds a volume.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import order
from voxloom.sources.scratch import written

#: Neighbouring lines (dz, dy) by connectivity, half of them, and how far apart along x their intervals still touch.
NEIGHBOURS = {
    6: ((0, 1, 0), (1, 0, 0)),
    18: ((0, 1, 1), (1, 0, 1), (1, 1, 0), (1, -1, 0)),
    26: ((0, 1, 1), (1, 0, 1), (1, 1, 1), (1, -1, 1)),
}
#: Edges that a task contracts together, and slices of a volume whose edges go to one task.
EDGES_AT_ONCE, SLAB = 1 << 20, 32


def runs(lines: DataFrame, labels: str, keys: list[str]) -> DataFrame:
    """keys..., z, y, x0, x1, label: each stretch of one label in an array column, in x from x0 to x1; null labels are in none."""
    same = lambda i, k: F.coalesce(F.get(F.col(labels), i + k).eqNullSafe(F.get(F.col(labels), i)), F.lit(False))
    within = lambda i, k: (i + k >= 0) & (i + k < F.size(labels)) & same(i, k)
    ends = lambda k: F.filter(F.transform(labels, lambda v, i: F.when(v.isNotNull() & ~within(i, k), i)), lambda i: i.isNotNull())
    each = lines.select(*keys, "z", "y", labels, F.explode(F.arrays_zip(ends(-1).alias("a"), ends(1).alias("b"))).alias("_r"))
    return each.select(*keys, "z", "y", F.col("_r.a").alias("x0"), F.col("_r.b").alias("x1"), F.get(F.col(labels), F.col("_r.a")).alias("label"))


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that edges a-b join to a smaller one, and the smallest that each can reach by them."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def joined_in_tasks(edges: DataFrame, by: list[str]) -> DataFrame:
    """(a, b): fewer edges that join the same nodes as edges(by..., a, b), as stars.

    Edges that are equal in `by` go to one task and follow one another there. A task contracts about EDGES_AT_ONCE of them together,
    and parts only those of more edges than that; all other parts are one star afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def star(edges: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in least_nodes(edges[1], edges[2])], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            n += batch.num_rows
            if n >= EDGES_AT_ONCE:
                every = np.concatenate(held, axis=1)
                starts = np.flatnonzero(np.diff(every[0])) + 1
                cut = starts[-1] if len(starts) else n
                yield star(every[:, :cut])
                held, n = [every[:, cut:]], n - cut
        if n:
            yield star(np.concatenate(held, axis=1))

    dealt = edges.select(F.xxhash64(*by).alias("deal"), F.col("a").cast("long"), F.col("b").cast("long"))
    return dealt.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "a long, b long")


def contracted(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes in edges(a, b), whole numbers; root is the smallest node that can be reached.

    Rounds link each node and its larger neighbours to the smallest one known, then its smaller ones, until nothing
    changes. Minima are summed before they are shuffled and joined back, so a node may have any number of neighbours.
    """
    state_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    e = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = state_of(e)  # stars that have come as such need one round
    for _ in range(max_rounds):
        near = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = low.join(low.groupBy("a").agg(F.min("b").alias("m")), "a")
        links = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")
        e = written(low.select(links).select("x.a", "x.b").where("a <> b").distinct(), "edges")
        state = state_of(e)
        if state == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(lines: DataFrame, labels: str, keys: list[str], connectivity: int = 18) -> DataFrame:
    """keys..., z, y, x0, x1, label, root: the stretches of one label in lines(keys..., z, y, array of labels), and the component of each.

    Stretches of one label touch across faces (6), edges too (18) or corners too (26). A root is a number that names a
    component among all volumes. Null labels are in no component; keys are not null; an empty table gives no rows.
    """
    if connectivity not in NEIGHBOURS:
        raise ValueError(f"unknown connectivity {connectivity}")
    found = written(runs(lines, labels, keys).withColumn("id", F.monotonically_increasing_id()), "runs")
    steps = F.explode(F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dz, dy, dx in NEIGHBOURS[connectivity]]))
    a = found.select(*keys, "label", steps.alias("o"), "z", "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("id").alias("a"))
    a = a.select(*keys, "label", (F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), F.col("o.dx").alias("dx"), "a0", "a1", "a")
    b = found.withColumnRenamed("id", "b")
    edges = a.join(b, [*keys, "label", "z", "y"]).where("x0 <= a1 + dx AND a0 <= x1 + dx").select(*keys, "label", F.floor(F.col("z") / SLAB).alias("slab"), "a", "b")
    roots = contracted(joined_in_tasks(edges, [*keys, "label", "slab"]))
    return found.join(roots, F.col("id") == F.col("node"), "left").select(*keys, "z", "y", "x0", "x1", "label", F.coalesce("root", "id").alias("root"))


def sizes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., label, root, voxels and the first voxel (z, y, x) of each component."""
    return parts.groupBy(*keys, "label", "root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("voxels"), F.min(F.struct("z", "y", F.col("x0").alias("x"))).alias("first"))


def largest(lines: DataFrame, mask: str, keys: list[str], connectivity: int = 18) -> DataFrame:
    """keys..., z, y, x0, x1 of the largest component of true voxels of each volume, of equal ones that with the first voxel. Volumes without one have no rows."""
    only = lines.withColumn(mask, F.transform(mask, lambda v: F.when(v, 1)))
    parts = written(components(only, mask, keys, connectivity), "parts")
    best = sizes(parts, keys).groupBy(*keys).agg(F.max_by("root", F.struct("voxels", -F.col("first.z"), -F.col("first.y"), -F.col("first.x"))).alias("root"))
    return parts.join(best, [*keys, "root"]).select(*keys, "z", "y", "x0", "x1")


def filled_in(lines: DataFrame, intervals: DataFrame, mask: str, keys: list[str]) -> DataFrame:
    """lines with the mask true where an interval (keys..., z, y, x0, x1) is, besides where it is already; a line's intervals fit its row."""
    of_line = intervals.groupBy(*keys, "z", "y").agg(F.collect_list(F.struct("x0", "x1")).alias("_in"))
    inside = lambda i: F.exists("_in", lambda r: (i >= r["x0"]) & (i <= r["x1"]))
    out = lines.join(of_line, [*keys, "z", "y"], "left")
    return out.withColumn(mask, F.when(F.col("_in").isNull(), F.col(mask)).otherwise(F.transform(mask, lambda v, i: v | inside(i)))).drop("_in")


def _beside(mask: str, keys: list[str]) -> list[Column]:
    """The four neighbouring lines of each line; null beyond the volume."""
    along = lambda a, b: Window.partitionBy(*keys, b).orderBy(a)
    return [step(mask).over(along(a, b)) for a, b in (("y", "z"), ("z", "y")) for step in (F.lag, F.lead)]


def dilated(lines: DataFrame, mask: str, keys: list[str], times: int = 1) -> DataFrame:
    """The mask grown by its 6 face neighbours, `times` times. Volumes are whole grids of lines."""
    for _ in range(times):
        own = F.transform(mask, lambda v, i: v | F.coalesce(F.get(F.col(mask), i - 1), F.lit(False)) | F.coalesce(F.get(F.col(mask), i + 1), F.lit(False)))
        near = {f"_n{k}": F.coalesce(c, F.col(mask)) for k, c in enumerate(_beside(mask, keys))}
        lines = lines.withColumns({**near, "_own": own})
        grown = F.col("_own")
        for n in near:
            grown = F.zip_with(grown, n, lambda a, b: a | b)
        lines = lines.withColumn(mask, grown).drop("_own", *near)
    return lines


def eroded(lines: DataFrame, mask: str, keys: list[str], times: int = 1) -> DataFrame:
    """The mask without the voxels that have a face neighbour outside it, or outside the volume, `times` times."""
    for _ in range(times):
        own = F.transform(mask, lambda v, i: v & F.coalesce(F.get(F.col(mask), i - 1), F.lit(False)) & F.coalesce(F.get(F.col(mask), i + 1), F.lit(False)))
        near = {f"_n{k}": F.coalesce(c, F.transform(mask, lambda v: F.lit(False))) for k, c in enumerate(_beside(mask, keys))}
        lines = lines.withColumns({**near, "_own": own})
        left = F.col("_own")
        for n in near:
            left = F.zip_with(left, n, lambda a, b: a & b)
        lines = lines.withColumn(mask, left).drop("_own", *near)
    return lines


def padded(lines: DataFrame, mask: str, keys: list[str], width: int) -> DataFrame:
    """keys..., z, y and the mask, with `width` false voxels and lines on every side; coordinates start at -width."""
    false = F.array_repeat(F.lit(False), width)
    wide = lines.select(*keys, "z", "y", F.concat(false, mask, false).alias(mask))
    ends = wide.groupBy(*keys).agg(F.max("z").alias("_z"), F.max("y").alias("_y"), F.max(F.size(mask)).alias("_n"))
    every = ends.withColumn("z", F.explode(F.sequence(F.lit(-width), F.col("_z") + width))).withColumn("y", F.explode(F.sequence(F.lit(-width), F.col("_y") + width)))
    around = every.where("z < 0 OR y < 0 OR z > _z OR y > _y").select(*keys, F.col("z").cast("int"), F.col("y").cast("int"), F.array_repeat(F.lit(False), F.col("_n")).alias(mask))
    return wide.unionByName(around)


def whole_grid(lines: DataFrame, array: str, keys: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """keys..., z, y and the array of every line of volumes of that shape: null where `lines` lacks it."""
    every = lines.select(*keys).distinct()
    for axis, n in zip(("z", "y"), shape[:2], strict=True):
        every = every.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return every.join(lines.select(*keys, "z", "y", array), [*keys, "z", "y"], "left")


def holes_filled(lines: DataFrame, mask: str, keys: list[str]) -> DataFrame:
    """The mask with all of its background that no path of faces joins to the volume's border. Null voxels stay null, and no path leads through them."""
    back = lines.withColumn(mask, F.transform(mask, lambda v: F.when(~v, 0)))
    parts = written(components(back, mask, keys, 6), "background")
    ends = lines.groupBy(*keys).agg(F.max("z").alias("_z"), F.max("y").alias("_y"), F.max(F.size(mask)).alias("_n"))
    at_border = F.bool_or((F.col("z") == 0) | (F.col("y") == 0) | (F.col("x0") == 0) | (F.col("z") == F.col("_z")) | (F.col("y") == F.col("_y")) | (F.col("x1") == F.col("_n") - 1))
    inner = parts.join(ends, keys).groupBy("root").agg(at_border.alias("out")).where("NOT out").select("root")
    return filled_in(lines, parts.join(inner, "root").select(*keys, "z", "y", "x0", "x1"), mask, keys)


def brain_mask(lines: DataFrame, value: str, keys: list[str], share: float = 0.05, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """keys..., z, y and the array mask: values over a quantile of the positive ones, holes filled, opened twice, the largest part, closed twice.

    Lines are whole grids (keys..., z, y, array), or else `shape` is that of every volume: lines that are missing are then neither inside nor background until
    holes are filled, and outside afterwards; the mask has a row for each of them too, as closing may reach into them.
    A volume without a positive value, or of which opening leaves nothing, has a mask without a true voxel.
    """
    if shape:
        lines = whole_grid(lines, value, keys, shape)
    positive = lines.select(*keys, F.explode(value).alias("_v")).where("_v > 0")
    cut = order.quantiles(positive, "_v", keys, [share], ["_cut"])
    over = F.transform(value, lambda v: F.coalesce(v > F.col("_cut"), F.lit(False)))
    if shape:
        over = F.coalesce(over, F.array_repeat(F.lit(None).cast("boolean"), shape[2]))
    mask = lines.join(cut, keys, "left").select(*keys, "z", "y", over.alias("mask"))
    filled = holes_filled(written(mask, "mask"), "mask", keys)
    mask = written(filled.withColumn("mask", F.transform("mask", lambda v: F.coalesce(v, F.lit(False)))), "mask")
    opened = written(dilated(eroded(mask, "mask", keys, 2), "mask", keys, 2), "opened")
    none = opened.withColumn("mask", F.transform("mask", lambda v: F.lit(False)))
    best = filled_in(none, largest(opened, "mask", keys, 6), "mask", keys)
    closed = eroded(dilated(padded(best, "mask", keys, 2), "mask", keys, 2), "mask", keys, 2)
    inside = closed.join(lines.select(*keys, "z", "y"), [*keys, "z", "y"], "left_semi")
    return inside.withColumn("mask", F.slice("mask", 3, F.size("mask") - 4))
