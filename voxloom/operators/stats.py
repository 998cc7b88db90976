"""Paired and rank statistics as grouped aggregates and ranks of any size; resampling from sums by task; mixed models by group in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.special import normal_sf2, p_chi2, p_normal, p_student, shapiro_wilk
from voxloom.operators import order
from voxloom.sources.scratch import written


def average_rank(value: str, keys: list[str]) -> Column:
    """The rank within keys; equal values share the mean of theirs. For keys of few rows, such as one unit's; order.ranked is for any."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def paired(metrics: DataFrame, value: str, unit: str, side: str, baseline: Column | str, keys: list[str]) -> DataFrame:
    """keys..., side, unit, v, base and d: every side's values next to the baseline side's of the same unit."""
    base = metrics.where(F.col(side) == baseline).select(*keys, unit, F.col(value).alias("base"))
    return metrics.where(F.col(side) != baseline).select(*keys, side, unit, F.col(value).alias("v")).join(base, [*keys, unit]).withColumn("d", F.round(F.col("v") - F.col("base"), 6))


def paired_t(pairs: DataFrame, keys: list[str], with_p: bool = False) -> DataFrame:
    """keys..., n, mean_d, t."""
    s = pairs.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd"))
    out = s.select(*keys, "n", "mean_d", F.try_divide("mean_d", F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).alias("t"))
    return out.withColumn("p", p_student(F.col("t"), (F.col("n") - 1).cast("double"))) if with_p else out


def independent_t(metrics: DataFrame, value: str, side: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys..., t of side a against side b with pooled variance; at least 2 values each. Null values are dropped, zeros count."""
    pick = lambda s, f: f(F.when(F.col(side) == s, F.col(value)))
    s = metrics.groupBy(*keys).agg(*[pick(k, f).alias(f"{n}{i}") for i, k in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2)
    return s.where("n0 >= 2 AND n1 >= 2").select(*keys, "n0", "n1", F.try_divide(F.col("m0") - F.col("m1"), F.nullif(F.sqrt(pooled * (F.lit(1.0) / F.col("n0") + F.lit(1.0) / F.col("n1"))), F.lit(0.0))).alias("t"))


def wilcoxon(pairs: DataFrame, keys: list[str], least: int = 5, with_p: bool = False) -> DataFrame:
    """keys..., n, w, z: signed ranks without zero differences; z is the normal approximation, corrected for ties.

    Ranks are those of distinct differences, counted range by range (order.ranked), so that no task holds a condition.
    """
    signs = [(name, F.count_if(c).cast("double")) for name, c in (("_up", F.col("d") > 0), ("_down", F.col("d") < 0))]
    r = order.ranked(pairs.where("d <> 0").withColumn("_a", F.abs("d")), "_a", keys, *signs)
    t = F.col("n").cast("double")
    s = r.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("_up")).alias("up"), F.sum(F.col("rank") * F.col("_down")).alias("down"), F.sum(t * (t * t - 1)).alias("ties"), F.sum("n").alias("n"))
    n, w = F.col("n").cast("double"), F.least("up", "down")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48.0)
    out = s.where(F.col("n") >= least).select(*keys, "n", w.alias("w"), F.try_divide(w - n * (n + 1) / 4, F.nullif(sd, F.lit(0.0))).alias("z"))
    return out.withColumn("p", p_normal("z")) if with_p else out


def friedman(metrics: DataFrame, value: str, unit: str, side: str, keys: list[str], least_units: int = 3, least_sides: int = 2, with_p: bool = False) -> DataFrame:
    """keys..., n, k, chi2 over the units that have every side, corrected for ties."""
    known = metrics.where(F.col(value).isNotNull())
    sides = known.groupBy(*keys).agg(F.countDistinct(side).alias("k"))
    per = known.groupBy(*keys, unit).agg(F.countDistinct(side).alias("have"))
    full = known.join(per.join(sides, keys).where("have = k").select(*keys, unit, "k"), [*keys, unit])
    r = full.withColumn("_r", average_rank(value, [*keys, unit])).withColumn("_t", F.count("*").over(Window.partitionBy(*keys, unit, value)))
    by_side = r.groupBy(*keys, side, "k").agg(F.count("*").alias("n"), F.sum("_r").alias("rj"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"))
    s = by_side.groupBy(*keys, "k").agg(F.max("n").alias("n"), F.sum(F.col("rj") * F.col("rj")).alias("ss"), F.sum("ties").alias("ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    out = s.where((F.col("n") >= least_units) & (F.col("k") >= least_sides)).select(*keys, "n", "k", F.try_divide(raw, F.nullif(1 - F.col("ties") / (n * k * (k * k - 1)), F.lit(0.0))).alias("chi2"))
    return out.withColumn("p", p_chi2(F.col("chi2"), (F.col("k") - 1).cast("double"))) if with_p else out


def effect_sizes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., n, dz (0 without spread), its 95 % interval, and g, corrected for small samples."""
    s = pairs.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"))
    dz = F.when(F.coalesce("sd", F.lit(0.0)) == 0, 0.0).otherwise(F.try_divide("m", "sd"))
    half = 1.96 * F.sqrt(1.0 / F.col("n") + F.try_divide(F.col("dz") * F.col("dz"), 2.0 * (F.col("n") - 1)))
    s = s.withColumn("dz", dz)
    return s.select(*keys, "n", "dz", (F.col("dz") - half).alias("dz_low"), (F.col("dz") + half).alias("dz_high"), (F.col("dz") * (1 - 3.0 / (4.0 * F.col("n") - 1))).alias("g"))


def cliffs_delta(metrics: DataFrame, value: str, side: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys..., delta = P(a > b) - P(a < b), exact with ties, from the ranks of both together, counted range by range."""
    both = metrics.where(F.col(side).isin(a, b) & F.col(value).isNotNull())
    r = order.ranked(both, value, keys, ("na", F.count_if(F.col(side) == a)), ("nb", F.count_if(F.col(side) == b)))
    s = r.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("na")).alias("ra"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2.0
    return s.select(*keys, "na", "nb", F.try_divide(2 * u, F.col("na") * F.col("nb")).alias("q")).select(*keys, "na", "nb", (F.col("q") - 1).alias("delta"))


def adjust(rows: DataFrame, p: str, how: str, family: list[str], tie: list[str]) -> DataFrame:
    """rows with p_adj: none, bonferroni, holm or fdr_bh within each family; tie orders equal p values."""
    ranked = Window.partitionBy(*family).orderBy(p, *tie)
    m = F.count(p).over(Window.partitionBy(*family))
    rows = rows.where(F.col(p).isNotNull()).withColumns({"_m": m, "_k": F.row_number().over(ranked)})
    up = ranked.rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*family).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    out = {
        "none": F.col(p),
        "bonferroni": F.col(p) * F.col("_m"),
        "holm": F.max((F.col("_m") - F.col("_k") + 1) * F.col(p)).over(up),
        "fdr_bh": F.min(F.col(p) * F.col("_m") / F.col("_k")).over(down),
    }
    if how not in out:
        raise ValueError(f"unknown adjustment {how}")
    return rows.withColumn("p_adj", F.least(F.lit(1.0), out[how])).drop("_m", "_k")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def effect_label(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def signed_log_p(effect: Column, p: Column) -> Column:
    """sign(effect) * -log10 p, at most 10; a null p counts as 1."""
    return F.sign(effect) * F.least(F.lit(10.0), -F.log10(F.greatest(F.coalesce(p, F.lit(1.0)), F.lit(1e-300))))


def icc21(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """keys..., n, icc: two-way random, absolute agreement, single rater, from six sums; null for n < 2 or a denominator that is not positive."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pairs.where(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    n, t = F.col("n"), F.col("sx") + F.col("sy")
    centre = t * t / (2.0 * n)
    s = s.where("n >= 2").withColumns({"sst": F.col("sxx") + F.col("syy") - centre, "ssr": (F.col("sxx") + F.col("syy") + 2 * F.col("sxy")) / 2 - centre, "ssc": (F.col("sx") ** 2 + F.col("sy") ** 2) / n - centre})
    msr, msc, mse = F.col("ssr") / (n - 1), F.col("ssc"), (F.col("sst") - F.col("ssr") - F.col("ssc")) / (n - 1)
    below = msr + mse + 2 * (msc - mse) / n
    return s.select(*keys, "n", F.when(below > 0, (msr - mse) / below).alias("icc"))


def regression(rows: DataFrame, y: str, x: str, keys: list[str], least: int = 3) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2")).where(F.col("n") >= least)


#: Resampling weights come from whole numbers below a prime, so that they are the same on any engine and for any partitioning.
PRIME = 2**31 - 1
#: How often a unit is drawn: the number of these bounds (of Poisson probabilities with mean 1) that its number reaches.
DRAWN = [int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


#: How many conditions' sums a task of bootstrap_mean holds, and how many rows (sums of a unit in a condition) it reads, both about.
CONDITIONS, UNIT_ROWS = 256, 100_000


def draws(unit: np.ndarray, resample: np.ndarray, seed: int) -> np.ndarray:
    """How often each unit (whole numbers) is in each resample, 1 on average: a row for each unit."""
    fifth = lambda x: x * x % PRIME * (x * x % PRIME) % PRIME * x % PRIME  # a bijection below the prime
    x = fifth((unit[:, None] % PRIME * 48271 + resample[None, :] * 69621 + seed) % PRIME)
    x = fifth((x * 16807 + resample[None, :] * 39373 + 12345) % PRIME)
    return np.searchsorted(np.array(DRAWN), x, side="right")


def bootstrap_mean(pairs: DataFrame, keys: list[str], unit: Column | str, resamples: int = 5000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """keys..., mean_d, low, high: percentile interval of the mean difference over resampled units.

    Each resample draws each unit a Poisson number of times, by a hash of unit, resample and seed; a unit's rows are drawn together.
    unit: a column of whole numbers, or one of another kind, which is hashed. A task draws each of its units once for a block of about
    CONDITIONS conditions and adds up its share of their resamples' sums; no group of rows is held, and tasks have UNIT_ROWS rows or so. Null differences are left out; an empty table gives no rows.
    """
    unit = F.col(unit) if isinstance(unit, str) else unit
    whole = pairs.select(unit.alias("u")).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint")
    number = F.pmod(unit.cast("long") if whole else F.xxhash64(unit), F.lit(PRIME))
    key = F.to_json(F.struct(*keys))
    rows = pairs.where("d IS NOT NULL").groupBy(key.alias("_key"), F.coalesce(number, F.lit(0)).alias("_u")).agg(F.sum("d").alias("_s"), F.count("d").cast("double").alias("_c"))
    rows = written(rows, "units")
    size = rows.agg(F.count("*").alias("rows"), F.countDistinct("_key").alias("keys")).first()
    blocks, tasks = max(1, -(-size["keys"] // CONDITIONS)), max(1, -(-size["rows"] // UNIT_ROWS))
    each, chunk = np.arange(resamples), max(1, 4_000_000 // resamples)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, place, sums = None, {}, []

        def done() -> Iterator[pd.DataFrame]:
            for k, i in place.items():
                yield pd.DataFrame({"_key": [k], "s": [sums[i][0]], "c": [sums[i][1]]})

        for pdf in frames:
            for block, part in pdf.groupby("_block", sort=False):
                if block != now:
                    yield from done()
                    now, place, sums = block, {}, []
                codes, names = pd.factorize(part["_key"])
                for k in names:
                    if k not in place:
                        place[k] = len(place)
                        sums.append(np.zeros((2, resamples)))
                at, units = pd.factorize(part["_u"].to_numpy(np.int64))
                for i in range(0, len(units), chunk):
                    here = (at >= i) & (at < i + chunk)
                    few = units[i : i + chunk]
                    values = np.zeros((2, len(names), len(few)))  # a unit's draws are the same in all conditions
                    np.add.at(values, (slice(None), codes[here], at[here] - i), part.loc[here, ["_s", "_c"]].to_numpy(float).T)
                    added = values @ draws(few, each, seed).astype(float)
                    for j, k in enumerate(names):
                        sums[place[k]] += added[:, j]
        yield from done()

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks))).repartition(tasks, "_block", "_u").sortWithinPartitions("_block", "_u")
    shares = dealt.mapInPandas(run, "_key string, s array<double>, c array<double>")
    summed = shares.select("_key", F.posexplode(F.arrays_zip("s", "c")).alias("r", "v")).groupBy("_key", "r").agg(F.sum("v.s").alias("s"), F.sum("v.c").alias("c"))
    low, high = (1 - level) / 2, (1 + level) / 2
    ends = summed.select("_key", F.try_divide("s", "c").alias("m")).groupBy("_key").agg(F.percentile("m", F.array(F.lit(low), F.lit(high))).alias("q"))  # `resamples` values
    means = rows.groupBy("_key").agg((F.sum("_s") / F.sum("_c")).alias("mean_d"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in pairs.select(*keys).dtypes)
    out = means.join(ends, "_key").select(F.from_json("_key", kinds).alias("k"), "mean_d", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return out.select(*[F.col("k").getField(k).alias(k) for k in keys], "mean_d", "low", "high")


def fit_random_intercept(y: np.ndarray, x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """REML of y = x b + group + noise: b, its covariance, and both variances. A search over the variance ratio; each group is a rank-one update."""
    _, at = np.unique(group, return_inverse=True)
    n = np.bincount(at).astype(float)
    sums = lambda v: np.stack([np.bincount(at, c) for c in v.T], axis=1)
    sx, sy = sums(x), np.bincount(at, y)
    sizes, of = np.unique(n, return_inverse=True)
    per = [of == i for i in range(len(sizes))]
    return reml(sizes, np.bincount(of).astype(float), np.stack([sx[p].T @ sx[p] for p in per]), np.stack([sx[p].T @ sy[p] for p in per]), np.array([sy[p] @ sy[p] for p in per]), x.T @ x, x.T @ y, y @ y, len(y))


def reml(n: np.ndarray, times: np.ndarray, sxx: np.ndarray, sxy: np.ndarray, syy: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: float, rows: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """fit_random_intercept from sums: for each size n of a group, how many groups have it, and the sums over them of the squares and products of their sums of x and y."""

    def at_ratio(r: float):
        k = r / (1 + r * n)
        a = xx - np.tensordot(k, sxx, 1)
        c = xy - k @ sxy
        b = np.linalg.lstsq(a, c, rcond=None)[0]
        rss = yy - k @ syy - b @ c
        df = rows - len(xy)
        s2 = max(rss / df, 1e-300)
        return df * np.log(s2) + times @ np.log(1 + r * n) + np.linalg.slogdet(a)[1], b, a, s2

    lo, hi, g = -12.0, 12.0, (np.sqrt(5) - 1) / 2
    for _ in range(80):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, d) if at_ratio(np.exp(c))[0] < at_ratio(np.exp(d))[0] else (c, hi)
    _, b, a, s2 = at_ratio(np.exp((lo + hi) / 2))
    return b, np.linalg.pinv(a) * s2, s2, s2 * float(np.exp((lo + hi) / 2))


def unit_sums(metrics: DataFrame, value: str, unit: str, side: str, condition: str, keys: list[str], roi: str | None = None) -> DataFrame:
    """keys..., n, the cells a and b (side, condition and, if given, roi), and sums over the units of n rows that have both: what reml needs, in as many rows as there are sizes n and pairs of cells."""
    v = F.col(value).cast("double")
    parts = {"side": side, "condition": condition} | ({"roi": roi} if roi else {})
    cells = metrics.where(F.col(value).isNotNull()).groupBy(*keys, unit, *parts.values()).agg(F.count("*").cast("double").alias("c"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    units = cells.groupBy(*keys, unit).agg(F.sum("c").alias("n"), F.collect_list(F.struct(*parts.values(), "c", "s", "q")).alias("cells"))
    pairs = units.withColumn("a", F.explode("cells")).withColumn("b", F.explode("cells"))
    names = [F.col(f"{p}.{c}").alias(f"{p}_{k}") for p in "ab" for k, c in parts.items()]
    return pairs.groupBy(*keys, "n", *names).agg(F.count("*").alias("units"), *[F.sum(f"a.{x}").alias(x) for x in "csq"], *[F.sum(F.col(f"a.{x}") * F.col(f"b.{y}")).alias(x + y) for x, y in ("cc", "cs", "ss")])


def _designs(cells: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """For rows of cells (a_side, a_condition): a mean for each of both, and the sum of the two without their interaction; and for cells with a_roi, the regions but the first."""
    dummies = lambda columns: pd.get_dummies(cells[columns].apply(tuple, axis=1), dtype=float).to_numpy()
    region = dummies(["a_roi"])[:, 1:] if "a_roi" in cells else np.zeros((len(cells), 0))
    return [dummies(["a_side", "a_condition"]), np.hstack([np.ones((len(cells), 1)), dummies(["a_side"])[:, 1:], dummies(["a_condition"])[:, 1:]])], region


def fit_cells(pdf: pd.DataFrame, side: str, condition: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, str]:
    """From rows of unit_sums: the sides and conditions with n_units (of the fullest region), the design's rows of each by region, the coefficients, their covariance, and what was fitted.

    A random intercept for the unit with the interaction; without it where that can't be told apart; ordinary least squares with
    errors by unit where neither can be fitted.
    """
    parts = [p for p in ("side", "condition", "roi") if f"a_{p}" in pdf]
    names = [f"a_{p}" for p in parts]
    cells = pdf[names].drop_duplicates().sort_values(names).reset_index(drop=True)
    index = lambda p: pdf[[f"{p}_{c}" for c in parts]].set_axis(names, axis=1).merge(cells.reset_index(), on=names, how="left")["index"].to_numpy()
    i, j = index("a"), index("b")
    sizes, of = np.unique(pdf["n"].to_numpy(), return_inverse=True)
    own, m = i == j, len(cells)
    sxx, sxy = np.zeros((len(sizes), m, m)), np.zeros((len(sizes), m))
    np.add.at(sxx, (of, i, j), pdf["cc"].to_numpy())
    np.add.at(sxy, (of, i), pdf["cs"].to_numpy())
    total = lambda c: np.bincount(i[own], pdf[c].to_numpy()[own], m)
    xx, xy, yy = total("c"), total("s"), total("q").sum()
    syy, rows = np.bincount(of, pdf["ss"].to_numpy()), int(xx.sum())
    times = sxx.sum(axis=(1, 2)) / sizes**2
    method, (designs, region) = "", _designs(cells)
    for part, name in zip(designs, ("mixed", "mixed additive"), strict=True):
        d = np.hstack([part, region])
        full = (d * xx[:, None]).T @ d
        if rows <= d.shape[1] or np.linalg.matrix_rank(full) < d.shape[1]:
            continue
        b, cov, _, _ = reml(sizes, times, np.einsum("ki,skl,lj->sij", d, sxx, d), sxy @ d, syy, full, d.T @ xy, yy, rows)
        if np.isfinite(b).all() and np.isfinite(cov).all():
            method = name
            break
    if not method:
        part = designs[0]
        d = np.hstack([part, region])
        inner = np.linalg.pinv((d * xx[:, None]).T @ d)
        b, p = inner @ (d.T @ xy), d @ inner @ (d.T @ xy)
        meat = np.zeros((m, m))  # sums over units of the products of their residuals by cell
        np.add.at(meat, (i, j), (pdf["ss"] + p[i] * p[j] * pdf["cc"]).to_numpy())
        cross = np.zeros((m, m))
        np.add.at(cross, (i, j), pdf["cs"].to_numpy())  # c of the first cell, s of the second
        meat -= p[:, None] * cross + (p[:, None] * cross).T
        units, k = times.sum(), d.shape[1]
        scale = units / max(units - 1, 1) * (rows - 1) / max(rows - k, 1)
        cov, method = scale * inner @ (d.T @ meat @ d) @ inner, "least squares"
    w, q = np.linalg.eigh((cov + cov.T) / 2)
    cov = (q * np.clip(w, 0, None)) @ q.T
    found = cells.assign(units=total("units").astype(int)).groupby(["a_side", "a_condition"], sort=True)["units"].max().reset_index()
    first = cells.reset_index().groupby(["a_side", "a_condition"], sort=True)["index"].first().to_numpy()
    every = np.unique(region, axis=0) if region.shape[1] else region[:1]  # a row for each region
    rows_of = np.array([[np.r_[part[c], r] for r in every] for c in first])
    return found.set_axis([side, condition, "n_units"], axis=1), rows_of, b, cov, method


def mixed_model_means(metrics: DataFrame, value: str, unit: str, side: str, condition: str, keys: list[str], roi: str | None = None) -> DataFrame:
    """keys..., side, condition, n_units, mean, se, 95 % limits and method of each cell, with a random intercept for the unit; over the regions, each with the same weight, if roi is given."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells, rows, b, cov, method = fit_cells(pdf, side, condition)
        mean = (rows @ b).mean(axis=1)
        se = np.sqrt(np.maximum(np.einsum("cri,ij,crj->cr", rows, cov, rows), 0).mean(axis=1))
        out = cells.assign(mean=mean, se=se, low=mean - 1.96 * se, high=mean + 1.96 * se, method=method)
        for name, k in zip(keys, key, strict=True):
            out[name] = k
        return out

    kinds = dict(metrics.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, side, condition]) + ", n_units long, mean double, se double, low double, high double, method string"
    return unit_sums(metrics, value, unit, side, condition, keys, roi).groupBy(*keys).applyInPandas(one, schema)


def mixed_model_contrasts(metrics: DataFrame, value: str, unit: str, side: str, condition: str, keys: list[str], baseline: str | None = None, roi: str | None = None) -> DataFrame:
    """keys..., side, condition, baseline, estimate, se, z and p_raw of each side against the baseline (by default the first) in each condition; p_holm within keys."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells, rows, b, cov, _ = fit_cells(pdf, side, condition)
        place = {tuple(c): i for i, c in enumerate(cells[[side, condition]].itertuples(index=False, name=None))}
        base, out = baseline or cells[side].min(), []
        for (s, c), i in place.items():
            j = place.get((base, c))
            if s != base and j is not None:
                x = rows[i, 0] - rows[j, 0]
                se = float(np.sqrt(max(x @ cov @ x, 0)))
                z = float(x @ b) / se if se > 0 else None
                out.append((*key, s, c, base, float(x @ b), se, z, normal_sf2(z) if z is not None else None))
        return pd.DataFrame(out, columns=[*keys, side, condition, "baseline", "estimate", "se", "z", "p_raw"])

    kinds = dict(metrics.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, side, condition]) + f", baseline {kinds[side]}, estimate double, se double, z double, p_raw double"
    found = unit_sums(metrics, value, unit, side, condition, keys, roi).groupBy(*keys).applyInPandas(one, schema)
    return adjust(found, "p_raw", "holm", keys, [side, condition]).withColumnRenamed("p_adj", "p_holm")


def normality(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys..., n, w, p: Shapiro-Wilk over a group's few means."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf[value].tolist())
        return pd.DataFrame([(*key, len(pdf), w, p)], columns=[*keys, "n", "w", "p"])

    schema = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", n long, w double, p double"
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(one, schema)
