"""Queries about orientation, alignment and places in volumes, and what figures are drawn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import geometry, interpret, kernels, quality
from voxloom.plans.volumes import BASE, EQ2, RIDGE, SHAPE, W2, grid, r6, weights_on
from voxloom.sources.tables import METRICS_SQL, artefacts, lines, metrics, voxels

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{BASE}, d AS (SELECT max(z) + 1 AS nz FROM vox) SELECT patient, 9 - y AS z, z AS y, 63 - x AS x, round(hr, 6) AS hr FROM vox")
def reorient_ras(spark, sf_dir):
    """Axes (z, y, x) of a scan whose affine swaps the first two, and turns the second and third around."""
    affine = np.zeros((4, 4))
    affine[1, 0], affine[0, 1], affine[2, 2], affine[3, 3] = 1, -1, -1, 1
    v = voxels(spark, sf_dir).select("patient", "z", "y", "x", F.round("hr", 6).alias("hr"))
    return geometry.reorient(v, affine, SHAPE)


_A, _B = "a AS (SELECT patient, z, y, x, hr FROM vox WHERE z < 8 AND y < 9)", "b AS (SELECT patient, z, y, x, e1 FROM vox WHERE x < 60)"


def _two(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return v.where("z < 8 AND y < 9").select("patient", "z", "y", "x", "hr"), v.where("x < 60").select("patient", "z", "y", "x", "e1")


@query(f"{BASE}, {_A}, {_B} SELECT patient, count(*) AS n, round(avg(abs(hr - e1)), 6) AS mae FROM a JOIN b USING (patient, z, y, x) GROUP BY 1")
def crop_to_common_box(spark, sf_dir):
    return geometry.crop_to_common(*_two(spark, sf_dir), ["patient"]).groupBy("patient").agg(F.count("*").alias("n"), F.round(quality.mae("hr", "e1"), 6).alias("mae"))


@query(f"{BASE}, {_A}, {_B} SELECT patient, count(*) AS n, round(avg(abs(coalesce(hr, 0) - coalesce(e1, 0))), 6) AS mae FROM a FULL JOIN b USING (patient, z, y, x) GROUP BY 1")
def pad_to_common_box(spark, sf_dir):
    return geometry.pad_to_both(*_two(spark, sf_dir), ["patient"], ["hr", "e1"]).groupBy("patient").agg(F.count("*").alias("n"), F.round(quality.mae("hr", "e1"), 6).alias("mae"))


_DEEP = "a AS (SELECT patient, z, y, x, hr FROM vox WHERE z < (SELECT max(z) - 1 FROM vox) AND y < 9)"


def _two_deep(spark, sf_dir):
    """All slices but the last two on one side, and the first 60 columns on the other."""
    v, (nz, _, _) = voxels(spark, sf_dir), SHAPE
    return v.where((F.col("z") < nz - 2) & (F.col("y") < 9)).select("patient", "z", "y", "x", "hr"), v.where("x < 60").select("patient", "z", "y", "x", "e1")


@query(f"{BASE}, {_DEEP}, {_B} SELECT patient, count(*) AS n, round(avg(abs(hr - e1)), 6) AS mae FROM a JOIN b USING (patient, z, y, x) GROUP BY 1")
def crop_to_common_depth(spark, sf_dir):
    return geometry.crop_to_common(*_two_deep(spark, sf_dir), ["patient"]).groupBy("patient").agg(F.count("*").alias("n"), F.round(quality.mae("hr", "e1"), 6).alias("mae"))


@query(f"{BASE}, {_DEEP}, {_B} SELECT patient, count(*) AS n, round(avg(abs(coalesce(hr, 0) - coalesce(e1, 0))), 6) AS mae FROM a FULL JOIN b USING (patient, z, y, x) GROUP BY 1")
def pad_to_common_depth(spark, sf_dir):
    return geometry.pad_to_both(*_two_deep(spark, sf_dir), ["patient"], ["hr", "e1"]).groupBy("patient").agg(F.count("*").alias("n"), F.round(quality.mae("hr", "e1"), 6).alias("mae"))


@query(f"""{BASE}, t AS (SELECT patient, z, y, x FROM (SELECT DISTINCT patient FROM vox), generate_series(0, 7) a(z), generate_series(0, 11) b(y), generate_series(0, 59) c(x))
    SELECT t.patient, t.z, round(sum(coalesce(hr, 0)), 5) AS total, count(hr) AS kept, count(*) AS n FROM t LEFT JOIN vox ON (vox.patient, vox.z, vox.y, vox.x) = (t.patient, t.z + 1, t.y - 1, t.x + 2) GROUP BY 1, 2""")
def centre_fitted(spark, sf_dir):
    """Volumes cut along z and x, and filled with zeros along y, at both ends alike."""
    v = voxels(spark, sf_dir).select("patient", "z", "y", "x", "hr", F.lit(1).alias("own"))
    out = geometry.fit_to_shape(v, SHAPE, (8, 12, 60), ["patient"], ["hr", "own"], centre=True)
    return out.groupBy("patient", "z").agg(F.round(F.sum("hr"), 5).alias("total"), F.sum("own").alias("kept"), F.count("*").alias("n"))


@query(f"""{BASE}, t AS (SELECT patient, z, y, x FROM (SELECT DISTINCT patient FROM vox), generate_series(0, 11) a(z), generate_series(0, 7) b(y), generate_series(0, 63) c(x))
    SELECT t.patient, t.z, round(sum(coalesce(hr, 0)), 5) AS total, count(*) AS n FROM t LEFT JOIN vox USING (patient, z, y, x) GROUP BY 1, 2""")
def corner_fitted(spark, sf_dir):
    """Volumes filled along z and cut along y at the far ends."""
    out = geometry.fit_to_shape(voxels(spark, sf_dir).select("patient", "z", "y", "x", "hr"), SHAPE, (12, 8, 64), ["patient"], ["hr"])
    return out.groupBy("patient", "z").agg(F.round(F.sum("hr"), 5).alias("total"), F.count("*").alias("n"))


@query(f"""{BASE}, a AS (SELECT patient, max(z) + 1 AS z, max(y) + 1 AS y, max(x) + 1 AS x FROM vox WHERE patient % 4 <> 1 AND z < 8 GROUP BY 1), b AS (SELECT patient, max(z) + 1 AS z, max(y) + 1 AS y, max(x) + 1 AS x FROM vox WHERE patient % 4 <> 2 AND x < 64 - patient % 5 GROUP BY 1)
    SELECT coalesce(a.patient, b.patient) AS patient, CASE WHEN a.z IS NOT NULL AND b.z IS NOT NULL THEN greatest(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)) ELSE -1 END AS gap, CASE WHEN a.z IS NOT NULL AND b.z IS NOT NULL THEN greatest(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)) <= 2 ELSE false END AS fits FROM a FULL JOIN b ON a.patient = b.patient""")
def shape_mismatches(spark, sf_dir):
    """Pairs of volumes whose sides differ by more than two voxels, and those of which one is missing (-1)."""
    v = voxels(spark, sf_dir)
    gaps = geometry.shape_gaps(v.where("patient % 4 <> 1 AND z < 8"), v.where("patient % 4 <> 2 AND x < 64 - patient % 5"), ["patient"])
    return gaps.select("patient", F.coalesce("gap", F.lit(-1)).alias("gap"), F.coalesce("fits", F.lit(False)).alias("fits"))


@query(f"{BASE}, k AS (SELECT patient, z, y, x FROM vox WHERE seg > 0) SELECT vox.patient, count(*) AS n, round(sum(CASE WHEN k.z IS NULL THEN 0 ELSE e1 END), 5) AS total FROM vox LEFT JOIN k ON vox.patient = k.patient AND vox.z = k.z AND vox.y = k.y AND vox.x = k.x GROUP BY 1")
def masked_volume(spark, sf_dir):
    v = voxels(spark, sf_dir)
    m = geometry.apply_mask(v.select("patient", "z", "y", "x", "e1"), v.where("seg > 0"), ["patient"], "e1")
    return m.groupBy("patient").agg(F.count("*").alias("n"), F.round(F.sum("e1"), 5).alias("total"))


@query(f"{BASE} SELECT patient, round(quantile_cont(hr, 0.01), 6) AS vmin, round(quantile_cont(hr, 0.99), 6) AS vmax FROM vox WHERE hr > 0 GROUP BY 1")
def display_windows(spark, sf_dir):
    return r6(geometry.display_window(voxels(spark, sf_dir), "hr", F.col("hr") > 0, ["patient"]), "patient")


def _cut(a: str, n: str) -> str:
    return f"least({n} - 2, greatest(1, (min({a}) + max({a})) // 2)) AS cut_{a}, avg({a}) >= least({n} - 2, greatest(1, (min({a}) + max({a})) // 2)) AS upper_{a}"


@query(f"{BASE}, d AS (SELECT max(z) + 1 AS nz FROM vox) SELECT patient, {_cut('z', '(SELECT nz FROM d)')}, {_cut('y', '10')}, {_cut('x', '64')} FROM vox WHERE seg = 1 AND hr > 0.05 GROUP BY 1")
def lesion_octant(spark, sf_dir):
    return geometry.octant(voxels(spark, sf_dir), (F.col("seg") == 1) & (F.col("hr") > 0.05), SHAPE, ["patient"])


@query(f"""{BASE}, p AS (SELECT patient, pz, py, px, count(*) AS n, avg((hr > 0)::INTEGER) AS share, avg(hr) AS mean, stddev_pop(hr) AS spread FROM vox, generate_series(0, 100) a(pz), generate_series(0, 10) b(py), generate_series(0, 40) c(px)
    WHERE z >= pz*2 AND z < pz*2 + 4 AND y >= py*2 AND y < py*2 + 4 AND x >= px*2 AND x < px*2 + 4 GROUP BY 1, 2, 3, 4)
    SELECT patient, pz, py, px, round(share, 6) AS share, round(mean, 6) AS mean, round(spread, 6) AS spread FROM p WHERE n = 64 AND share >= 0.5""")
def patch_scan(spark, sf_dir):
    return r6(geometry.scan_patches(voxels(spark, sf_dir), "hr", F.col("hr") > 0, 4, ["patient"]), "patient", "pz", "py", "px")


def _spread_sql(k: int, apart: float) -> str:
    """k places a patient, one after another: the best of those far enough from all before; then at half the distance."""
    steps, n = ["c0 AS (SELECT patient, pz, py, px, score, 0 AS step FROM cand WHERE false)"], 0
    for least in (apart, apart / 2):
        for _ in range(k):
            n += 1
            far = f"pow(h.pz - c.pz, 2) + pow(h.py - c.py, 2) + pow(h.px - c.px, 2) < {least**2}"
            steps.append(f"""p{n} AS MATERIALIZED (SELECT c.* FROM cand c WHERE (SELECT count(*) FROM c{n - 1} h WHERE h.patient = c.patient) < {k} AND NOT EXISTS (SELECT 1 FROM c{n - 1} h WHERE h.patient = c.patient AND {far})
                QUALIFY row_number() OVER (PARTITION BY patient ORDER BY score DESC, pz, py, px) = 1), c{n} AS MATERIALIZED (SELECT * FROM c{n - 1} UNION ALL SELECT *, {n} FROM p{n})""")
    return ", ".join(steps) + f" SELECT patient, row_number() OVER (PARTITION BY patient ORDER BY step) AS rank, pz, py, px, score FROM c{n}"


@query(f"""{SQL['patch_scan'].replace('SELECT patient, pz, py, px, round(share, 6) AS share, round(mean, 6) AS mean, round(spread, 6) AS spread FROM p WHERE n = 64 AND share >= 0.5', '').rstrip()},
    cand AS MATERIALIZED (SELECT patient, pz, py, px, round(spread, 6) AS score FROM p WHERE n = 64 AND share >= 0.5), {_spread_sql(5, 4.0)}""")
def spread_out_patches(spark, sf_dir):
    s = geometry.scan_patches(voxels(spark, sf_dir), "hr", F.col("hr") > 0, 4, ["patient"]).withColumn("score", F.round("spread", 6))
    return geometry.spread_out(s, "score", ["pz", "py", "px"], ["patient"], 5, 4.0)


@query(f"{BASE}, s AS (SELECT patient, z, round(avg(abs(e1 - hr)) - avg(abs(e2 - hr)), 6) AS gain FROM vox WHERE hr > 0.05 GROUP BY 1, 2) SELECT patient, z AS best_z, gain FROM s QUALIFY row_number() OVER (PARTITION BY patient ORDER BY gain DESC, z) = 1")
def best_slice_by_advantage(spark, sf_dir):
    s = voxels(spark, sf_dir).where("hr > 0.05").groupBy("patient", "z").agg(F.round(quality.mae("e1", "hr") - quality.mae("e2", "hr"), 6).alias("gain"))
    return s.groupBy("patient").agg(F.max_by("z", F.struct("gain", -F.col("z"))).alias("best_z"), F.max("gain").alias("gain"))


@query(f"""{BASE}, c(seg, r, g, b) AS (VALUES (1, 230, 60, 60), (2, 60, 160, 230), (3, 250, 210, 80)), l AS (SELECT patient, z, y, x, seg AS truth, CASE WHEN e1 > 0 THEN seg ELSE 0 END AS made FROM vox WHERE z = 4)
    SELECT patient, y, x, CASE WHEN truth = 0 AND made = 0 THEN 0 WHEN truth = made THEN 217 ELSE coalesce(r, 0) END AS r, CASE WHEN truth = 0 AND made = 0 THEN 0 WHEN truth = made THEN 217 ELSE coalesce(g, 0) END AS g, CASE WHEN truth = 0 AND made = 0 THEN 0 WHEN truth = made THEN 217 ELSE coalesce(b, 0) END AS b
    FROM l LEFT JOIN c ON c.seg = l.truth""")
def label_difference_colours(spark, sf_dir):
    v = voxels(spark, sf_dir).where("z = 4").select("patient", "y", "x", "seg", F.when(F.col("e1") > 0, F.col("seg")).otherwise(0).alias("made"))
    colours = spark.createDataFrame([(1, 230, 60, 60), (2, 60, 160, 230), (3, 250, 210, 80)], "seg int, r int, g int, b int")
    j = v.join(F.broadcast(colours), "seg", "left")  # three rows
    shade = lambda c: F.when((F.col("seg") == 0) & (F.col("made") == 0), 0).when(F.col("seg") == F.col("made"), 217).otherwise(F.coalesce(c, F.lit(0))).alias(c)
    return j.select("patient", "y", "x", shade("r"), shade("g"), shade("b"))


@query(f"""{BASE}, {EQ2}, {W2}, o AS (SELECT vox, w1*w1*(q11 + {RIDGE}) + 2*w1*(1 - w1)*q12 + (1 - w1)*(1 - w1)*(q22 + {RIDGE}) - 2*(w1*b1 + (1 - w1)*b2) AS objective FROM w JOIN eq USING (rid, vox))
    SELECT count(*) AS tiles, round(sum(objective), 4) AS total, round(avg(objective), 5) AS mean, round(stddev_pop(objective), 5) AS std, round(min(objective), 5) AS min, round(max(objective), 5) AS max, round(median(objective), 5) AS median, round(avg(vox), 5) AS vox_mean FROM o""")
def optimisation_summary(spark, sf_dir):
    w = weights_on(grid(), voxels(spark, sf_dir))
    value = F.col("w1") ** 2 * (F.col("q11") + RIDGE) + 2 * F.col("w1") * F.col("w2") * F.col("q12") + F.col("w2") ** 2 * (F.col("q22") + RIDGE) - 2 * (F.col("w1") * F.col("b1") + F.col("w2") * F.col("b2"))
    o = w.withColumn("o", value)
    return o.agg(F.count("*").alias("tiles"), F.round(F.sum("o"), 4).alias("total"), *[F.round(f("o"), 5).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("median", F.median))], F.round(F.avg("vox"), 5).alias("vox_mean"))


@query(f"""{BASE}, {EQ2}, {W2}, f AS (SELECT patient, coalesce(w1, 0.5) AS w1 FROM vox LEFT JOIN w ON w.rid = ((z // 4) * 3 + y // 4) * 8 + x // 8), p AS (SELECT patient, avg(w1) AS m, 1 - avg((-w1*ln(w1 + 1e-8) - (1 - w1)*ln(1 - w1 + 1e-8))/ln(2)) AS s FROM f GROUP BY 1)
    SELECT count(*) AS patients, round(avg(m), 6) AS mean_of_means, round(stddev_pop(m), 6) AS std_of_means, round(avg(s), 6) AS specialization_mean, round(min(s), 6) AS specialization_min, round(max(s), 6) AS specialization_max FROM p""")
def weights_across_patients(spark, sf_dir):
    from voxloom.operators.tiling import expand_weights

    g = grid()
    v = expand_weights(voxels(spark, sf_dir), weights_on(g, voxels(spark, sf_dir)).select("rid", F.array("w1", "w2").alias("w")), g, 2)
    p = v.groupBy("patient").agg(F.avg(F.col("w")[0]).alias("m"), interpret.specialization(F.col("w"), 2).alias("s"))
    return p.agg(F.count("*").alias("patients"), F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.stddev_pop("m"), 6).alias("std_of_means"), F.round(F.avg("s"), 6).alias("specialization_mean"), F.round(F.min("s"), 6).alias("specialization_min"), F.round(F.max("s"), 6).alias("specialization_max"))


@query("WITH j AS (SELECT user_id AS patient, event_type AS kind, (props->>'$.k')::INTEGER AS k FROM events), d AS (SELECT patient, kind, avg(k) AS v, count(*) AS n FROM j GROUP BY 1, 2) SELECT patient, kind, round(v, 6) AS value, n FROM d")
def nested_to_tidy(spark, sf_dir):
    """Documents of maps of maps, as results are stored, back to a row for each entry."""
    per = artefacts(spark, sf_dir).groupBy("patient", "kind").agg(F.avg("payload").alias("value"), F.count("*").alias("n"))
    nested = per.groupBy("patient").agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("value", "n")))).alias("methods"))
    text = nested.select("patient", F.to_json("methods").alias("document"))
    back = text.select("patient", F.explode(F.from_json("document", "map<string, struct<value: double, n: bigint>>")).alias("kind", "v"))
    return back.select("patient", "kind", F.round("v.value", 6).alias("value"), F.col("v.n").alias("n"))


@query()
def multi_feature_mmd(spark, sf_dir):
    """Five features of each voxel in both volumes, put on one scale, compared by the cubic kernel."""
    import pandas as pd

    def run(hr, e1):
        parts = []
        for side, x in ((0, hr), (1, e1)):
            var = np.maximum(0, kernels.box_mean(x * x, 2) - kernels.box_mean(x, 2) ** 2)
            f = np.stack([kernels.sobel_magnitude(x), *[kernels.laplacian_of_gaussian(x, s) for s in (1, 2, 4)], var], axis=-1)[hr > 0]
            parts.append(pd.DataFrame(f, columns=[f"f{i}" for i in range(5)]).assign(side=side))
        both = pd.concat(parts)
        f = both[[f"f{i}" for i in range(5)]]
        both[f.columns] = (f - f.mean()) / f.std(ddof=0).where(lambda s: s > 1e-8, 1.0)
        return both

    rows = kernels.by_volume(lines(spark, sf_dir), run, ", ".join(f"f{i} double" for i in range(5)) + ", side int", ["hr", "e1"], SHAPE)
    return r6(quality.polynomial_mmd(rows, "side", [f"f{i}" for i in range(5)], ["patient"]), "patient")


@query(rf"""WITH {METRICS_SQL}, s AS (SELECT model, spacing, avg(ssim) AS mean, stddev_samp(ssim) AS std FROM m GROUP BY 1, 2), c AS (SELECT DISTINCT spacing FROM s), r AS (SELECT DISTINCT model FROM s),
    b AS (SELECT model, string_agg(coalesce(printf('%.4f $\pm$ %.4f', mean, coalesce(std, 0)), '---'), ' & ' ORDER BY spacing) AS t FROM r CROSS JOIN c LEFT JOIN s USING (model, spacing) GROUP BY 1), k AS (SELECT count(*) AS k FROM b)
    SELECT 0 AS line, '\begin{{tabular}}{{l' || repeat('c', (SELECT count(*) FROM c)::INTEGER) || '}}' AS text UNION ALL SELECT 1, '\toprule' UNION ALL SELECT 2, ' & ' || string_agg(spacing, ' & ' ORDER BY spacing) || ' \\' FROM c
    UNION ALL SELECT 3, '\midrule' UNION ALL SELECT 3 + row_number() OVER (ORDER BY model), model || ' & ' || t || ' \\' FROM b UNION ALL SELECT 4 + k, '\bottomrule' FROM k UNION ALL SELECT 5 + k, '\end{{tabular}}' FROM k""")
def nested_cross_spacing_table(spark, sf_dir):
    """Mean and spread of each model at each spacing, as the rows of a printed table."""
    from voxloom.sources.volume_store import latex_table

    s = metrics(spark, sf_dir).groupBy("model", "spacing").agg(F.avg("ssim").alias("mean"), F.stddev_samp("ssim").alias("std"))
    return spark.createDataFrame([(i, line) for i, line in enumerate(latex_table(s, "model", "spacing", "mean", "std").split("\n"))], "line int, text string")
