"""Queries over metric tables: summaries, gains, fronts and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import aggregate, coverage, stats
from voxloom.plans.volumes import r6
from voxloom.sources.tables import METRICS_SQL, measured, metrics, table

QUERIES: dict = {}
SQL: dict = {}
BASE = "WITH " + METRICS_SQL
KEYS = ["pulse", "spacing"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def first_model(spark, sf_dir) -> str:
    return table(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]


def last_model(spark, sf_dir) -> str:
    return table(spark, sf_dir, "part").agg(F.max("p_type")).first()[0]


def against_first(spark, sf_dir, value="psnr"):
    """Every model's values next to the first model's of the same case."""
    return stats.paired(metrics(spark, sf_dir), value, "case_id", "model", first_model(spark, sf_dir), KEYS)


PAIRS = """b AS (SELECT min(p_type) AS b FROM part), pr AS (SELECT x.pulse, x.spacing, x.model, x.case_id, x.psnr AS v, y.psnr AS base, round(x.psnr - y.psnr, 6) AS d
    FROM m x JOIN m y USING (case_id, pulse, spacing), b WHERE y.model = b AND x.model <> b)"""


# ---- summaries


@query(f"{BASE} SELECT model, spacing, pulse, round(avg(psnr), 5) AS psnr_mean, round(stddev_samp(psnr), 5) AS psnr_std, round(avg(ssim), 5) AS ssim_mean, round(stddev_samp(ssim), 5) AS ssim_std, count(*) AS n FROM m GROUP BY 1, 2, 3")
def metrics_summary_samp(spark, sf_dir):
    return r6(aggregate.summary(metrics(spark, sf_dir), ["model", "spacing", "pulse"], ["psnr", "ssim"]), "model", "spacing", "pulse", "n", digits=5)


@query(f"{BASE} SELECT model, spacing, round(avg(psnr), 5) AS psnr_mean, round(stddev_pop(psnr), 5) AS psnr_std, count(*) AS n FROM m GROUP BY 1, 2")
def metrics_summary_pop(spark, sf_dir):
    return r6(aggregate.summary(metrics(spark, sf_dir), ["model", "spacing"], ["psnr"], F.stddev_pop), "model", "spacing", "n", digits=5)


@query(f"{BASE} SELECT model, pulse, round(avg(ssim), 5) AS ssim_mean, round(stddev_samp(ssim), 5) AS ssim_std, round(median(ssim), 5) AS ssim_median, count(*) AS n FROM m GROUP BY 1, 2")
def metrics_summary_median(spark, sf_dir):
    return r6(aggregate.summary(metrics(spark, sf_dir), ["model", "pulse"], ["ssim"], median=True), "model", "pulse", "n", digits=5)


@query(f"{BASE} SELECT model, pulse, spacing, round(avg(psnr), 5) AS psnr_mean, round(avg(ssim), 5) AS ssim_mean, count(DISTINCT case_id) AS n FROM m GROUP BY 1, 2, 3")
def means_with_case_counts(spark, sf_dir):
    return metrics(spark, sf_dir).groupBy("model", "pulse", "spacing").agg(F.round(F.avg("psnr"), 5).alias("psnr_mean"), F.round(F.avg("ssim"), 5).alias("ssim_mean"), F.countDistinct("case_id").alias("n"))


@query("""WITH j AS (SELECT p_brand, p_size, l_returnflag, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT p_brand, p_size, l_returnflag, round(sum(l_discount), 2) AS v, count(*) AS n FROM j GROUP BY ALL)
    SELECT b.p_brand, z.p_size, f.l_returnflag, v AS total, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT DISTINCT p_size FROM part) z, (SELECT DISTINCT l_returnflag FROM lineitem) f LEFT JOIN s ON s.p_brand = b.p_brand AND s.p_size = z.p_size AND s.l_returnflag = f.l_returnflag""")
def metrics_categorical_fill(spark, sf_dir):
    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    keys = ["p_brand", "p_size", "l_returnflag"]
    s = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(*keys).agg(F.round(F.sum("l_discount"), 2).alias("total"), F.count("*").alias("n"))
    full = aggregate.with_every_group(s, [part.select("p_brand").distinct(), part.select("p_size").distinct(), items.select("l_returnflag").distinct()], keys)
    return full.select(*keys, "total", "n")


@query(f"""{BASE} SELECT CASE grouping_id(spacing, pulse) WHEN 0 THEN 'spacing_pulse' WHEN 1 THEN 'spacing' WHEN 2 THEN 'pulse' ELSE 'overall' END AS grain, spacing, pulse, round(avg(psnr), 5) AS mean, round(stddev_pop(psnr), 5) AS std, round(min(psnr), 5) AS min, round(max(psnr), 5) AS max, count(*) AS n
    FROM m GROUP BY CUBE (spacing, pulse)""")
def metrics_multigrain(spark, sf_dir):
    return r6(aggregate.multi_grain(metrics(spark, sf_dir), "spacing", "pulse", "psnr"), "grain", "spacing", "pulse", "n", digits=5)


GAIN = """a AS (SELECT pulse, spacing, model, avg(psnr) AS psnr, avg(ssim) AS ssim FROM m GROUP BY ALL), t AS (SELECT min(p_type) AS t FROM part),
    g AS (SELECT o.pulse, o.spacing, o.model AS other_model, x.psnr AS psnr_target, o.psnr AS psnr_other, x.ssim AS ssim_target, o.ssim AS ssim_other, x.psnr - o.psnr AS delta_psnr, x.ssim - o.ssim AS delta_ssim FROM a o JOIN a x USING (pulse, spacing), t WHERE x.model = t AND o.model <> t)"""


def _gains(spark, sf_dir):
    means = metrics(spark, sf_dir).groupBy("pulse", "spacing", "model").agg(F.avg("psnr").alias("psnr"), F.avg("ssim").alias("ssim"))
    return aggregate.gains(means, first_model(spark, sf_dir), KEYS, ["psnr", "ssim"])


@query(f"{BASE}, {GAIN} SELECT pulse, spacing, other_model, round(psnr_target, 5) AS psnr_target, round(psnr_other, 5) AS psnr_other, round(ssim_target, 5) AS ssim_target, round(ssim_other, 5) AS ssim_other, round(delta_psnr, 5) AS delta_psnr, round(delta_ssim, 5) AS delta_ssim FROM g")
def gain_by_seq_spacing(spark, sf_dir):
    return r6(_gains(spark, sf_dir), "pulse", "spacing", "other_model", digits=5)


@query(f"""{BASE}, {GAIN} SELECT CASE grouping_id(pulse, spacing, other_model) WHEN 2 THEN 'pulse' WHEN 4 THEN 'spacing' ELSE 'overall' END AS level, pulse, spacing, other_model, round(avg(delta_psnr), 5) AS delta_psnr, round(avg(delta_ssim), 5) AS delta_ssim
    FROM g GROUP BY GROUPING SETS ((pulse, other_model), (spacing, other_model), (other_model))""")
def gain_grouping_sets(spark, sf_dir):
    levels = aggregate.gain_levels(_gains(spark, sf_dir), "pulse", "spacing", ["delta_psnr", "delta_ssim"])
    return r6(levels, "level", "pulse", "spacing", "other_model", digits=5)


PARETO = "p AS (SELECT p_brand AS method, l_returnflag AS pulse, round(avg(l_discount), 3) AS x, round(avg(l_tax), 3) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f"WITH {PARETO} SELECT method, pulse, x, y FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.pulse = a.pulse AND b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))")
def pareto_front(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    points = items.groupBy(F.col("p_brand").alias("method"), F.col("l_returnflag").alias("pulse")).agg(F.round(F.avg("l_discount"), 3).alias("x"), F.round(F.avg("l_tax"), 3).alias("y"))
    return aggregate.pareto_front(points, "x", "y", ["pulse"])


@query(f"{BASE}, i AS (SELECT model, pulse, spacing, avg(psnr) AS psnr, avg(ssim) AS ssim FROM m GROUP BY ALL) SELECT model, round(avg(psnr), 5) AS psnr_mean, round(stddev_samp(psnr), 5) AS psnr_std, round(avg(ssim), 5) AS ssim_mean, round(stddev_samp(ssim), 5) AS ssim_std, count(*) AS n_cells FROM i GROUP BY 1")
def method_mean_of_means(spark, sf_dir):
    return r6(aggregate.mean_of_means(metrics(spark, sf_dir), "model", KEYS, ["psnr", "ssim"]), "model", "n_cells", digits=5)


@query(f"{BASE} SELECT case_id, model, pulse, spacing, metric, value FROM (UNPIVOT m ON psnr, ssim INTO NAME metric VALUE value)")
def metrics_wide_to_long(spark, sf_dir):
    return aggregate.to_long(metrics(spark, sf_dir), ["case_id", "model", "pulse", "spacing"], ["psnr", "ssim"])


@query(f"{BASE} SELECT case_id, round(avg(psnr) FILTER (pulse = 'A'), 3) AS \"A\", round(avg(psnr) FILTER (pulse = 'N'), 3) AS \"N\", round(avg(psnr) FILTER (pulse = 'R'), 3) AS \"R\" FROM m GROUP BY 1 HAVING count(DISTINCT pulse) = 3")
def patient_by_pulse_pivot(spark, sf_dir):
    return r6(aggregate.to_wide(metrics(spark, sf_dir), ["case_id"], "pulse", ["A", "N", "R"], "psnr"), "case_id", digits=3)


@query(f"{BASE} SELECT case_id FROM m GROUP BY 1 HAVING count(DISTINCT (model, pulse, spacing)) = (SELECT count(DISTINCT (model, pulse, spacing)) FROM m)")
def complete_panels(spark, sf_dir):
    return coverage.complete(metrics(spark, sf_dir, ()), "case_id", ["model", "pulse", "spacing"])


@query(f"{BASE}, q AS (SELECT model, quantile_cont(psnr, 0.25) AS q1, quantile_cont(psnr, 0.5) AS q2, quantile_cont(psnr, 0.75) AS q3 FROM m GROUP BY 1) SELECT model, round(q1, 5) AS q1, round(q2, 5) AS q2, round(q3, 5) AS q3, round(min(psnr) FILTER (psnr >= q1 - 1.5*(q3 - q1)), 5) AS low, round(max(psnr) FILTER (psnr <= q3 + 1.5*(q3 - q1)), 5) AS high FROM m JOIN q USING (model) GROUP BY model, q.q1, q.q2, q.q3")
def box_plot_stats(spark, sf_dir):
    return r6(aggregate.box(metrics(spark, sf_dir), ["model"], "psnr"), "model", digits=5)


@query(f"""{BASE}, p AS (SELECT model, case_id, round(avg(psnr), 6) AS v FROM m GROUP BY 1, 2) SELECT model, first(case_id ORDER BY v DESC, case_id) AS best, first(case_id ORDER BY v, case_id) AS worst, max(v) AS best_value, min(v) AS worst_value FROM p GROUP BY 1""")
def best_worst_patient(spark, sf_dir):
    return aggregate.best_and_worst(metrics(spark, sf_dir), "case_id", "psnr", ["model"])


@query(f"{BASE} SELECT model, spacing, count(*) AS n, round(avg(CASE WHEN psnr IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share, count(*) FILTER (psnr NOT BETWEEN 1000 AND 1500) AS out_of_range FROM m GROUP BY 1, 2")
def sanity_report(spark, sf_dir):
    return coverage.sanity(metrics(spark, sf_dir), "psnr", ["model", "spacing"], 1000, 1500)


@query(f"{BASE}, s AS (SELECT model, spacing, avg(psnr) AS a, stddev_samp(psnr) AS d FROM m GROUP BY 1, 2) SELECT model, printf('%.2f ± %.2f', max(a) FILTER (spacing = 'F'), max(d) FILTER (spacing = 'F')) AS \"F\", printf('%.2f ± %.2f', max(a) FILTER (spacing = 'O'), max(d) FILTER (spacing = 'O')) AS \"O\", printf('%.2f ± %.2f', max(a) FILTER (spacing = 'P'), max(d) FILTER (spacing = 'P')) AS \"P\" FROM s GROUP BY 1")
def formatted_table(spark, sf_dir):
    s = metrics(spark, sf_dir).groupBy("model", "spacing").agg(F.format_string("%.2f ± %.2f", F.avg("psnr"), F.stddev_samp("psnr")).alias("cell"))
    return s.groupBy("model").pivot("spacing", ["F", "O", "P"]).agg(F.max("cell"))


# ---- paired and rank statistics


@query(f"{BASE}, {PAIRS} SELECT pulse, spacing, model, count(d) AS n, round(avg(d), 5) AS mean_d, round(avg(d)/(stddev_samp(d)/sqrt(count(d))), 5) AS t FROM pr GROUP BY 1, 2, 3")
def paired_ttest_stat(spark, sf_dir):
    return r6(stats.paired_t(against_first(spark, sf_dir), [*KEYS, "model"]), *KEYS, "model", "n", digits=5)


@query(f"""{BASE}, s AS (SELECT model, pulse, count(psnr) FILTER (spacing = 'F') AS n0, count(psnr) FILTER (spacing = 'O') AS n1, avg(psnr) FILTER (spacing = 'F') AS m0, avg(psnr) FILTER (spacing = 'O') AS m1, var_samp(psnr) FILTER (spacing = 'F') AS v0, var_samp(psnr) FILTER (spacing = 'O') AS v1 FROM m GROUP BY 1, 2)
    SELECT model, pulse, n0, n1, round((m0 - m1)/sqrt(((n0 - 1)*v0 + (n1 - 1)*v1)/(n0 + n1 - 2)*(1/n0 + 1/n1)), 5) AS t FROM s WHERE n0 >= 2 AND n1 >= 2""")
def independent_ttest_stat(spark, sf_dir):
    return r6(stats.independent_t(metrics(spark, sf_dir), "psnr", "spacing", "F", "O", ["model", "pulse"]), "model", "pulse", "n0", "n1", digits=5)


@query(f"""{BASE}, {PAIRS}, r AS (SELECT *, rank() OVER (PARTITION BY pulse, spacing, model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY pulse, spacing, model, abs(d)) - 1)/2.0 AS r, count(*) OVER (PARTITION BY pulse, spacing, model, abs(d)) AS t FROM pr WHERE d <> 0),
    s AS (SELECT pulse, spacing, model, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down, sum(t*t - 1) AS ties FROM r GROUP BY 1, 2, 3)
    SELECT pulse, spacing, model, n, least(up, down)::DOUBLE AS w, round((least(up, down) - n*(n + 1)/4)/sqrt(n*(n + 1)*(2*n + 1)/24 - ties/48), 5) AS z FROM s WHERE n >= 5""")
def wilcoxon_signed_rank_w(spark, sf_dir):
    return stats.wilcoxon(against_first(spark, sf_dir), [*KEYS, "model"]).withColumn("z", F.round("z", 5))


def normal_p(z: str) -> str:
    """The two-sided tail of a normal value, from the series of its error function; 0 beyond nine deviations."""
    x = f"(abs({z})/sqrt(2))"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 9 THEN 0.0 ELSE greatest(0, 1 - 2/sqrt(pi())*exp(-{x}*{x})*list_sum([exp(2*i*ln(2) + (2*i + 1)*ln({x}) + lgamma(i + 1) - lgamma(2*i + 2)) for i in generate_series(0, 300)])) END"


def chi2_p(chi2: str, df: str) -> str:
    """The upper tail of chi2, from the series of the incomplete gamma function; 0 beyond 500."""
    return f"CASE WHEN {chi2} > 500 THEN 0.0 WHEN {chi2} <= 0 THEN 1.0 ELSE greatest(0, 1 - list_sum([exp(({df}/2.0 + i)*ln({chi2}/2) - {chi2}/2 - lgamma({df}/2.0 + i + 1)) for i in generate_series(0, 1500)])) END"


def student_p(t: str, df: str) -> str:
    """The two-sided tail of t, from the series of the incomplete beta function at t^2 / (df + t^2)."""
    y, a = f"({t}*{t}/({df} + {t}*{t}))", f"({df}/2.0)"
    terms = f"[exp(0.5*ln({y}) + {a}*ln(1 - {y}) + lgamma({a} + 0.5 + i) - lgamma(1.5 + i) - lgamma({a}) + i*ln({y})) for i in generate_series(0, 3000)]"
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 0 THEN 1.0 ELSE greatest(0, 1 - list_sum({terms})) END"


@query(f"""WITH t AS ({SQL['paired_ttest_stat'].replace('round(avg(d)/(stddev_samp(d)/sqrt(count(d))), 5) AS t', 'avg(d)/(stddev_samp(d)/sqrt(count(d))) AS t')})
    SELECT pulse, spacing, model, n, round(t, 5) AS t, round({student_p('t', '(n - 1)')}, 5) AS p FROM t""")
def paired_t_p_values(spark, sf_dir):
    return r6(stats.paired_t(against_first(spark, sf_dir), [*KEYS, "model"], with_p=True).select(*KEYS, "model", "n", "t", "p"), *KEYS, "model", "n", digits=5)


@query(f"""WITH w AS ({SQL['wilcoxon_signed_rank_w'].replace('round((least(up, down)', '((least(up, down)').replace('ties/48), 5) AS z', 'ties/48)) AS z')}), p AS (SELECT pulse, spacing, model, {normal_p('z')} AS p FROM w),
    k AS (SELECT *, row_number() OVER (PARTITION BY pulse, spacing ORDER BY p, model) AS k, count(*) OVER (PARTITION BY pulse, spacing) AS n FROM p),
    h AS (SELECT *, least(1, max((n - k + 1)*p) OVER (PARTITION BY pulse, spacing ORDER BY k ROWS UNBOUNDED PRECEDING)) AS p_adj FROM k)
    SELECT pulse, spacing, model, round(p, 6) AS p, round(p_adj, 6) AS p_adj, CASE WHEN p_adj < 0.001 THEN '***' WHEN p_adj < 0.01 THEN '**' WHEN p_adj < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM h""")
def wilcoxon_p_values(spark, sf_dir):
    w = stats.wilcoxon(against_first(spark, sf_dir), [*KEYS, "model"], with_p=True)
    adjusted = stats.adjust(w, "p", "holm", KEYS, ["model"])
    return adjusted.select(*KEYS, "model", F.round("p", 6).alias("p"), F.round("p_adj", 6).alias("p_adj"), stats.stars(F.col("p_adj")).alias("stars"))


@query(f"""{BASE}, k AS (SELECT pulse, spacing, count(DISTINCT model) AS k FROM m GROUP BY 1, 2), c AS (SELECT pulse, spacing, case_id FROM m JOIN k USING (pulse, spacing) GROUP BY 1, 2, 3 HAVING count(DISTINCT model) = max(k)),
    r AS (SELECT m.*, rank() OVER (PARTITION BY pulse, spacing, case_id ORDER BY psnr) + (count(*) OVER (PARTITION BY pulse, spacing, case_id, psnr) - 1)/2.0 AS r, count(*) OVER (PARTITION BY pulse, spacing, case_id, psnr) AS t FROM m JOIN c USING (pulse, spacing, case_id)),
    s AS (SELECT pulse, spacing, model, count(*) AS n, sum(r) AS rj, sum(t*t - 1) AS ties FROM r GROUP BY 1, 2, 3), f AS (SELECT pulse, spacing, count(*) AS k, max(n) AS n, sum(rj*rj) AS ss, sum(ties) AS ties FROM s GROUP BY 1, 2)
    SELECT pulse, spacing, n, k, round((12.0/(n*k*(k + 1))*ss - 3*n*(k + 1))/(1 - ties/(n*k*(k*k - 1))), 5) AS chi2 FROM f WHERE n >= 3 AND k >= 2""")
def friedman_chi2(spark, sf_dir):
    return stats.friedman(metrics(spark, sf_dir), "psnr", "case_id", "model", KEYS).withColumn("chi2", F.round("chi2", 5))


@query(f"""{BASE}, {PAIRS}, s AS (SELECT pulse, spacing, model, count(d) AS n, avg(d)/stddev_samp(d) AS dz FROM pr GROUP BY 1, 2, 3)
    SELECT pulse, spacing, model, n, round(dz, 5) AS dz, round(dz - 1.96*sqrt(1.0/n + dz*dz/(2.0*(n - 1))), 5) AS dz_low, round(dz + 1.96*sqrt(1.0/n + dz*dz/(2.0*(n - 1))), 5) AS dz_high, round(dz*(1 - 3.0/(4.0*n - 1)), 5) AS g,
    CASE WHEN abs(dz) < 0.2 THEN 'negligible' WHEN abs(dz) < 0.5 THEN 'small' WHEN abs(dz) < 0.8 THEN 'medium' ELSE 'large' END AS size FROM s""")
def cohen_dz_hedges_g(spark, sf_dir):
    e = stats.effect_sizes(against_first(spark, sf_dir), [*KEYS, "model"]).withColumn("size", stats.effect_label(F.col("dz")))
    return r6(e, *KEYS, "model", "n", "size", digits=5)


@query(f"""{BASE}, t AS (SELECT min(p_type) AS a, max(p_type) AS b FROM part), x AS (SELECT m.*, m.model = t.a AS is_a, rank() OVER (PARTITION BY pulse, spacing ORDER BY psnr) + (count(*) OVER (PARTITION BY pulse, spacing, psnr) - 1)/2.0 AS r FROM m, t WHERE m.model IN (t.a, t.b)),
    s AS (SELECT pulse, spacing, count(*) FILTER (is_a) AS na, count(*) FILTER (NOT is_a) AS nb, sum(r) FILTER (is_a) AS ra FROM x GROUP BY 1, 2) SELECT pulse, spacing, na, nb, round(2*(ra - na*(na + 1)/2)/(na*nb) - 1, 5) AS delta FROM s""")
def cliffs_delta(spark, sf_dir):
    return r6(stats.cliffs_delta(metrics(spark, sf_dir), "psnr", "model", first_model(spark, sf_dir), last_model(spark, sf_dir), KEYS), *KEYS, "na", "nb", digits=5)


P = "p AS (SELECT p_brand AS test, l_returnflag AS family, round(avg(l_discount)*avg(l_tax)*10, 6) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def _tests(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return items.groupBy(F.col("p_brand").alias("test"), F.col("l_returnflag").alias("family")).agg(F.round(F.avg("l_discount") * F.avg("l_tax") * 10, 6).alias("p"))


RANKED = "k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS k, count(*) OVER (PARTITION BY family) AS n FROM p)"


@query(f"WITH {P}, {RANKED} SELECT test, family, p, round(least(1, min(p*n/k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM k")
def bh_adjust(spark, sf_dir):
    return stats.adjust(_tests(spark, sf_dir), "p", "fdr_bh", ["family"], ["test"]).withColumn("p_adj", F.round("p_adj", 6))


@query(f"WITH {P}, {RANKED} SELECT test, family, p, round(least(1, max((n - k + 1)*p) OVER (PARTITION BY family ORDER BY k ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM k")
def holm_adjust(spark, sf_dir):
    return stats.adjust(_tests(spark, sf_dir), "p", "holm", ["family"], ["test"]).withColumn("p_adj", F.round("p_adj", 6))


@query(f"WITH {P}, {RANKED} SELECT test, family, p, round(least(1, p*n), 6) AS p_adj FROM k")
def bonferroni_adjust(spark, sf_dir):
    return stats.adjust(_tests(spark, sf_dir), "p", "bonferroni", ["family"], ["test"]).withColumn("p_adj", F.round("p_adj", 6))


@query(f"WITH {P} SELECT test, family, round(CASE WHEN test < 'Brand#3' THEN 1 ELSE -1 END * least(10, -log10(greatest(p, 1e-300))), 5) AS cell, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM p")
def significance_cells(spark, sf_dir):
    sign = F.when(F.col("test") < "Brand#3", 1.0).otherwise(-1.0)
    return _tests(spark, sf_dir).select("test", "family", F.round(stats.signed_log_p(sign, F.col("p")), 5).alias("cell"), stats.stars(F.col("p")).alias("stars"))


@query(f"""{BASE}, a AS (SELECT x.model, x.pulse, x.psnr AS x, y.psnr AS y FROM m x JOIN m y USING (case_id, model, pulse) WHERE x.spacing = 'F' AND y.spacing = 'O'),
    s AS (SELECT model, pulse, count(*) AS n, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(y*y) syy, sum(x*y) sxy FROM a GROUP BY 1, 2),
    q AS (SELECT *, sxx + syy - (sx + sy)*(sx + sy)/(2.0*n) AS sst, (sxx + syy + 2*sxy)/2 - (sx + sy)*(sx + sy)/(2.0*n) AS ssr, (sx*sx + sy*sy)/n - (sx + sy)*(sx + sy)/(2.0*n) AS ssc FROM s WHERE n >= 2),
    e AS (SELECT *, ssr/(n - 1) AS msr, (sst - ssr - ssc)/(n - 1) AS mse FROM q) SELECT model, pulse, n, round(CASE WHEN msr + mse + 2*(ssc - mse)/n > 0 THEN (msr - mse)/(msr + mse + 2*(ssc - mse)/n) END, 5) AS icc FROM e""")
def icc21(spark, sf_dir):
    m = metrics(spark, sf_dir)
    a = m.where("spacing = 'F'").select("case_id", "model", "pulse", F.col("psnr").alias("x")).join(m.where("spacing = 'O'").select("case_id", "model", "pulse", F.col("psnr").alias("y")), ["case_id", "model", "pulse"])
    return r6(stats.icc21(a, "x", "y", ["model", "pulse"]), "model", "pulse", "n", digits=5)


@query("SELECT source, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS both, round(coalesce(2.0*sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END)/nullif(sum(quality) + sum(toxic), 0), 1), 6) AS dice FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def rater_agreement(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    both = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1))
    return j.groupBy("source").agg(F.count("*").alias("n"), both.alias("both"), F.round(F.coalesce(F.try_divide(2.0 * both, F.sum("quality") + F.sum("toxic")), F.lit(1.0)), 6).alias("dice"))


@query(f"{BASE} SELECT model, count(*) AS n, round(regr_slope(ssim, psnr), 9) AS slope, round(regr_intercept(ssim, psnr), 6) AS intercept, round(regr_r2(ssim, psnr), 6) AS r2 FROM m GROUP BY 1 HAVING count(*) >= 3")
def linregress_by_method(spark, sf_dir):
    r = stats.regression(metrics(spark, sf_dir), "ssim", "psnr", ["model"])
    return r.select("model", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"))


def _fifth(x: str) -> str:
    return f"({x})*({x}) % {stats.PRIME} * (({x})*({x}) % {stats.PRIME}) % {stats.PRIME} * ({x}) % {stats.PRIME}"


@query(f"""{BASE}, {PAIRS}, u AS (SELECT pulse, spacing, model, d, r, (case_id % {stats.PRIME} * 48271 + r*69621 + 42) % {stats.PRIME} AS x FROM pr, generate_series(0, 4999) g(r)),
    v AS (SELECT *, ({_fifth('x')} * 16807 + r*39373 + 12345) % {stats.PRIME} AS y FROM u), w AS (SELECT *, {_fifth('y')} AS z FROM v),
    k AS (SELECT pulse, spacing, model, r, d, {' + '.join(f'(z >= {t})::INTEGER' for t in stats.DRAWN)} AS k FROM w),
    s AS (SELECT pulse, spacing, model, r, sum(k*d)/nullif(sum(k), 0) AS m FROM k GROUP BY ALL), o AS (SELECT pulse, spacing, model, avg(d) AS mean_d FROM pr GROUP BY ALL)
    SELECT pulse, spacing, model, round(any_value(mean_d), 5) AS mean_d, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high FROM s JOIN o USING (pulse, spacing, model) GROUP BY ALL""")
def bootstrap_ci(spark, sf_dir):
    """Intervals of the mean gain over 5,000 resamples of the cases."""
    return r6(stats.bootstrap_mean(against_first(spark, sf_dir), [*KEYS, "model"], "case_id"), *KEYS, "model", digits=5)


@query()
def lmm_emm(spark, sf_dir):
    return r6(stats.mixed_model_means(metrics(spark, sf_dir), "psnr", "case_id", "model", "spacing", ["pulse"]), "pulse", "model", "spacing", "n_units", "method", digits=5)


@query()
def lmm_contrasts(spark, sf_dir):
    return r6(stats.mixed_model_contrasts(metrics(spark, sf_dir), "psnr", "case_id", "model", "spacing", ["pulse"]), "pulse", "model", "spacing", "baseline", digits=5)


def region_metrics(spark, sf_dir):
    """case_id, model, pulse, spacing, roi, psnr: as metrics, by the line's number as its region."""
    return measured(spark, sf_dir, {"roi": F.concat(F.lit("roi"), (F.col("l_linenumber") % 3).cast("string"))}, ("psnr",))


@query()
def lmm_emm_by_region(spark, sf_dir):
    """Marginal means over regions, of a model with a term for each region."""
    m = stats.mixed_model_means(region_metrics(spark, sf_dir), "psnr", "case_id", "model", "spacing", ["pulse"], "roi")
    return r6(m, "pulse", "model", "spacing", "n_units", "method", digits=5)


@query()
def lmm_contrasts_by_region(spark, sf_dir):
    m = stats.mixed_model_contrasts(region_metrics(spark, sf_dir), "psnr", "case_id", "model", "spacing", ["pulse"], roi="roi")
    return r6(m, "pulse", "model", "spacing", "baseline", digits=5)


@query()
def normality_of_fold_means(spark, sf_dir):
    means = metrics(spark, sf_dir).groupBy("model", (F.col("case_id") % 20).alias("fold")).agg(F.avg("psnr").alias("v"))
    return r6(stats.normality(means, "v", ["model"]), "model", "n")


@query(f"""WITH f AS ({SQL['friedman_chi2'].replace('round((12.0/', '((12.0/').replace('(k*k - 1))), 5) AS chi2', '(k*k - 1)))) AS chi2')}) SELECT pulse, spacing, n, k, round(chi2, 5) AS chi2, round({chi2_p('chi2', '(k - 1)')}, 5) AS p FROM f""")
def friedman_p_values(spark, sf_dir):
    return r6(stats.friedman(metrics(spark, sf_dir), "psnr", "case_id", "model", KEYS, with_p=True), *KEYS, "n", "k", digits=5)


# ---- further shapes of summaries


@query(f"{BASE} SELECT model, spacing, pulse, round(avg(psnr), 5) AS psnr, round(avg(ssim), 5) AS ssim, model = (SELECT min(p_type) FROM part) AS is_target FROM m GROUP BY 1, 2, 3")
def flagged_means(spark, sf_dir):
    """Means by condition, with a flag on the method of interest."""
    return aggregate.flagged(metrics(spark, sf_dir), ["model", "spacing", "pulse"], ["psnr", "ssim"], F.col("model") == first_model(spark, sf_dir)).select("model", "spacing", "pulse", F.round("psnr", 5).alias("psnr"), F.round("ssim", 5).alias("ssim"), "is_target")


@query(f"{BASE}, o AS (SELECT * FROM m WHERE case_id % 7 <> 0 OR spacing <> 'P'), l AS (UNPIVOT o ON psnr, ssim INTO NAME metric VALUE v) SELECT model, spacing, metric, round(avg(v), 3) AS mean, round(coalesce(stddev_samp(v), 0), 3) AS std, round(median(v), 3) AS median, count(*) AS n FROM l GROUP BY 1, 2, 3")
def metric_summary(spark, sf_dir):
    """One row for each metric: mean, sample spread (0 of a single value), median and n."""
    rows = metrics(spark, sf_dir).where("case_id % 7 <> 0 OR spacing <> 'P'")
    return r6(aggregate.by_metric(rows, ["case_id", "model", "spacing", "pulse"], ["model", "spacing"], ["psnr", "ssim"]), "model", "spacing", "metric", "n", digits=3)


@query(f"{BASE}, f AS (SELECT spacing, pulse, case_id % 5 + 1 AS fold, avg(psnr) AS psnr, avg(ssim) AS ssim FROM m GROUP BY 1, 2, 3), l AS (UNPIVOT f ON psnr, ssim INTO NAME metric VALUE v) SELECT spacing, pulse, metric, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, count(*) AS n_folds FROM l GROUP BY 1, 2, 3")
def fold_table(spark, sf_dir):
    """Mean and population spread over folds."""
    folds = metrics(spark, sf_dir).groupBy("spacing", "pulse", (F.col("case_id") % 5 + 1).alias("fold")).agg(F.avg("psnr").alias("psnr"), F.avg("ssim").alias("ssim"))
    return r6(aggregate.over_folds(folds, ["spacing", "pulse"], ["psnr", "ssim"]), "spacing", "pulse", "metric", "n_folds", digits=5)


@query(f"{BASE}, f AS (SELECT pulse, case_id % 5 + 1 AS fold, avg(psnr) AS v FROM m GROUP BY 1, 2) SELECT pulse, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std FROM f GROUP BY 1")
def fold_spread_by_pulse(spark, sf_dir):
    folds = metrics(spark, sf_dir).groupBy("pulse", (F.col("case_id") % 5 + 1).alias("fold")).agg(F.avg("psnr").alias("v"))
    return r6(folds.groupBy("pulse").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")), "pulse", digits=5)


@query(f"{BASE}, w AS (SELECT case_id, avg(psnr) FILTER (pulse = 'A' AND case_id % 3 <> 0) AS a, avg(psnr) FILTER (pulse = 'N') AS n, avg(psnr) FILTER (pulse = 'R' AND case_id % 2 = 0) AS r FROM m GROUP BY 1) SELECT case_id, round(list_avg([x for x in [a, n, r] if x IS NOT NULL]), 5) AS mean FROM w")
def row_means(spark, sf_dir):
    """The mean over a row's columns, those without a value passed over."""
    pick = lambda c: F.avg(F.when(c, F.col("psnr")))
    w = metrics(spark, sf_dir).groupBy("case_id").agg(pick((F.col("pulse") == "A") & (F.col("case_id") % 3 != 0)).alias("a"), pick(F.col("pulse") == "N").alias("n"), pick((F.col("pulse") == "R") & (F.col("case_id") % 2 == 0)).alias("r"))
    return r6(w.select("case_id", aggregate.row_mean(["a", "n", "r"]).alias("mean")), "case_id", digits=5)


@query(f"WITH i AS ({SQL['icc21']}) SELECT model, round(median(icc), 5) AS median_icc, count(icc) AS n FROM i GROUP BY 1")
def median_icc(spark, sf_dir):
    return icc21(spark, sf_dir).groupBy("model").agg(F.round(F.median("icc"), 5).alias("median_icc"), F.count("icc").alias("n"))


@query(f"{BASE}, o AS (SELECT * FROM m WHERE case_id % 7 <> 0 OR spacing <> 'P'), e AS (SELECT DISTINCT model, pulse, spacing FROM o), h AS (SELECT case_id, count(*) AS have FROM o GROUP BY 1) SELECT case_id, have, (SELECT count(*) FROM e) - have AS missing FROM h WHERE have < (SELECT count(*) FROM e)")
def incomplete_panels(spark, sf_dir):
    """Cases that lack conditions that others have, and how many."""
    return coverage.incomplete(metrics(spark, sf_dir, ()).where("case_id % 7 <> 0 OR spacing <> 'P'"), "case_id", ["model", "pulse", "spacing"])


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'PLAIN' WHEN 'STANDARD' THEN 'PLAIN' ELSE p_type END AS method, p_size AS spacing FROM part")
def renamed_methods(spark, sf_dir):
    """Aliases of a method brought to one name, and a spacing read from its label."""
    p = table(spark, sf_dir, "part").withColumn("label", F.concat(F.col("p_size").cast("string"), F.lit("mm")))
    named = aggregate.renamed(p, "p_type", {"ECONOMY": "PLAIN", "STANDARD": "PLAIN"})
    return named.select("p_partkey", F.col("p_type").alias("method"), coverage.spacing_of("label").alias("spacing"))


@query(f"{BASE} SELECT a.case_id, a.model, a.case_id || '_' || a.model AS truth_path, b.case_id || '-' || b.model AS label_path, c.case_id || '+' || c.model AS made_path FROM m a JOIN m b USING (case_id, model) JOIN m c USING (case_id, model) WHERE a.pulse = 'A' AND a.spacing = 'F' AND b.pulse = 'N' AND b.spacing = 'F' AND c.pulse = 'R' AND c.spacing = 'P'")
def path_triplets(spark, sf_dir):
    m = metrics(spark, sf_dir)
    of = lambda pulse, spacing, mark: m.where((F.col("pulse") == pulse) & (F.col("spacing") == spacing)).select("case_id", "model", F.concat_ws(mark, "case_id", "model").alias("path"))
    return coverage.triplets(of("A", "F", "_"), of("N", "F", "-"), of("R", "P", "+"), ["case_id", "model"])
