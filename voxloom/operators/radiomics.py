"""Texture and first-order features, from matrices summed over lines: co-occurrence, run lengths, size zones and grey-tone differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import components, kernels
from voxloom.operators.quality import bucket


def first_order(voxels: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys..., n, mean, var (sample), and bias-corrected skew and excess kurtosis; null where n is too small or values don't vary."""
    m = voxels.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    d = F.col(value) - F.col("mean")
    s = voxels.join(m, keys).groupBy(*keys, "n", "mean").agg(*[F.sum(F.pow(d, F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)])
    n, m2 = F.col("n").cast("double"), F.nullif(F.col("m2") / F.col("n"), F.lit(0.0))
    g1, g2 = F.col("m3") / n / F.pow(m2, F.lit(1.5)), F.col("m4") / n / (m2 * m2) - 3
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * g1)
    kurt = F.when(n > 3, (n - 1) / (F.nullif(n - 2, F.lit(0.0)) * F.nullif(n - 3, F.lit(0.0))) * ((n + 1) * g2 + 6))
    return s.select(*keys, "n", "mean", F.when(n > 1, F.col("m2") / F.nullif(n - 1, F.lit(0.0))).alias("var"), skew.alias("skew"), kurt.alias("kurtosis"))


def entropy(voxels: DataFrame, value: str, keys: list[str], bins: int = 256) -> DataFrame:
    """keys..., entropy in bits of the histogram."""
    ends = voxels.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    counts = voxels.join(ends, keys).groupBy(*keys, "_n", bucket(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("_n")
    return counts.groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def glcm(voxels: DataFrame, value: str, levels: int = 32, keys: tuple[str, ...] = ("patient", "z"), row: str = "y", col: str = "x") -> DataFrame:
    """keys..., contrast, homogeneity and correlation of each slice's co-occurrence of neighbours along a row, counted both ways.

    Values are cut to percentiles 1 to 99 and put into levels first.
    """
    ends = voxels.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.01), F.lit(0.99))).alias("_p"))
    q = voxels.join(ends, list(keys)).withColumn("i", bucket(F.least(F.greatest(F.col(value), F.col("_p")[0]), F.col("_p")[1]), F.col("_p")[0], F.col("_p")[1], levels))
    pairs = q.withColumn("j", F.lead("i").over(Window.partitionBy(*keys, row).orderBy(col))).where("j IS NOT NULL")
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    s = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((i - j) * (i - j)).alias("contrast"), F.avg(1 / (1 + (i - j) * (i - j))).alias("homogeneity"), F.avg(i * j).alias("ij"), (F.avg(i + j) / 2).alias("mu"), (F.avg(i * i + j * j) / 2).alias("sq"))
    var = F.nullif(F.round(F.col("sq") - F.col("mu") * F.col("mu"), 12), F.lit(0.0))
    return s.select(*keys, "contrast", "homogeneity", F.coalesce((F.col("ij") - F.col("mu") * F.col("mu")) / var, F.lit(1.0)).alias("correlation"))


# ---- matrices of grey levels, kept as lines


def levels(lines: DataFrame, value: str, keys: list[str], n: int) -> DataFrame:
    """keys..., z, y and the array g: levels 1..n of equal widths over a volume's range; null values have none."""
    ends = lines.groupBy(*keys).agg(F.min(F.array_min(value)).alias("_lo"), F.max(F.array_max(value)).alias("_hi"))
    return lines.join(ends, keys).select(*keys, "z", "y", F.transform(value, lambda v: F.when(v.isNotNull(), bucket(v, F.col("_lo"), F.col("_hi"), n) + 1)).alias("g"))


def run_lengths(lines: DataFrame, g: str, keys: list[str]) -> DataFrame:
    """keys..., axis, g, size, n: how many runs of one level and length there are along x, and along y."""
    along = {"x": lines.select(*keys, "z", "y", g), "y": kernels.turned(lines, [g], tuple(keys))}
    each = [components.runs(rows, g, keys).withColumn("axis", F.lit(a)) for a, rows in along.items()]
    return each[0].unionByName(each[1]).groupBy(*keys, "axis", F.col("label").alias("g"), (F.col("x1") - F.col("x0") + 1).alias("size")).agg(F.count("*").alias("n"))


def zone_sizes(lines: DataFrame, g: str, keys: list[str], connectivity: int = 26) -> DataFrame:
    """keys..., g, size, n: how many connected zones of one level and size there are."""
    zones = components.sizes(components.components(lines, g, keys, connectivity), keys)
    return zones.groupBy(*keys, F.col("label").alias("g"), F.col("voxels").alias("size")).agg(F.count("*").alias("n"))


def _emphases(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., sums over a matrix (g, size, n): all, by size and level, and of the squares of its margins."""
    n, g, size = (F.col(c).cast("double") for c in ("n", "g", "size"))
    s = matrix.groupBy(*keys).agg(F.sum(n).alias("all"), F.sum(n / (size * size)).alias("small"), F.sum(n * size * size).alias("large"), F.sum(n * size).alias("voxels"), F.sum(n / (g * g)).alias("low"), F.sum(n * g * g).alias("high"))
    for margin in ("g", "size"):
        m = matrix.groupBy(*keys, margin).agg(F.sum(n).alias("_m")).groupBy(*keys).agg(F.sum(F.col("_m") * F.col("_m")).alias(f"{margin}_squares"))
        s = s.join(m, keys)
    return s


def run_length_features(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., the run-length features, the mean over axes."""
    s, every = _emphases(matrix, [*keys, "axis"]), F.col("all")
    parts = {"short_run_emphasis": "small", "long_run_emphasis": "large", "grey_level_non_uniformity": "g_squares", "run_length_non_uniformity": "size_squares", "low_grey_level_run_emphasis": "low", "high_grey_level_run_emphasis": "high"}
    return s.groupBy(*keys).agg(*[F.avg(F.col(c) / every).alias(name) for name, c in parts.items()], F.avg(every / F.col("voxels")).alias("run_percentage"))


def zone_features(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., the size-zone features."""
    s, every = _emphases(matrix, keys), F.col("all")
    p = F.col("n") / every
    entropy = matrix.join(s.select(*keys, "all"), keys).groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("zone_entropy"))
    parts = {"small_area_emphasis": "small", "large_area_emphasis": "large", "grey_level_non_uniformity": "g_squares", "zone_size_non_uniformity": "size_squares"}
    variance = F.col("large") / every - (F.col("voxels") / every) * (F.col("voxels") / every)
    return s.join(entropy, keys).select(*keys, *[(F.col(c) / every).alias(name) for name, c in parts.items()], "zone_entropy", variance.alias("zone_variance"))


def tone_differences(lines: DataFrame, g: str, keys: list[str]) -> DataFrame:
    """keys..., g, n, s: of each level, its voxels and the sum of their differences from the mean level of the (up to 26) voxels around them. Volumes are whole grids of lines."""
    rows = lines.select(*keys, "z", "y", F.col(g).alias("g")).withColumns({"sum": F.transform("g", lambda v: F.coalesce(v, F.lit(0)).cast("double")), "cnt": F.transform("g", lambda v: v.isNotNull().cast("double"))})
    zero = F.lit(0.0)

    def three(column: str):
        return F.transform(column, lambda v, i: v + F.coalesce(F.get(F.col(column), i - 1), zero) + F.coalesce(F.get(F.col(column), i + 1), zero))

    rows = rows.withColumns({c: three(c) for c in ("sum", "cnt")})  # boxes of 3 along each axis by turns; beyond the volume nothing is added
    for axis, other in (("y", "z"), ("z", "y")):
        w = Window.partitionBy(*keys, other).orderBy(axis)
        nothing = F.transform("sum", lambda v: F.lit(0.0))
        near = {f"_{c}{k}": F.coalesce(step(c).over(w), nothing) for c in ("sum", "cnt") for k, step in enumerate((F.lag, F.lead))}
        rows = rows.withColumns(near)
        rows = rows.withColumns({c: F.zip_with(F.zip_with(c, f"_{c}0", lambda a, b: a + b), f"_{c}1", lambda a, b: a + b) for c in ("sum", "cnt")}).drop(*near)
    each = rows.select(*keys, F.explode(F.arrays_zip("g", "sum", "cnt")).alias("v")).where("v.g IS NOT NULL")
    mean = F.try_divide(F.col("v.sum") - F.col("v.g"), F.col("v.cnt") - 1)
    return each.select(*keys, F.col("v.g").alias("g"), F.coalesce(F.abs(F.col("v.g") - mean), zero).alias("d")).groupBy(*keys, "g").agg(F.count("*").alias("n"), F.sum("d").alias("s"))


def tone_features(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., coarseness, contrast, busyness, complexity and strength, over all pairs of a volume's levels (a short list)."""
    t = matrix.groupBy(*keys).agg(F.sum("n").alias("np"), F.count("*").alias("ng"), F.sum("s").alias("ss"))
    p = matrix.join(t, keys).select(*keys, F.col("g").cast("double").alias("g"), (F.col("n") / F.col("np")).alias("p"), "s", "np", "ng", "ss")
    j = p.join(p.select(*keys, F.col("g").alias("h"), F.col("p").alias("q"), F.col("s").alias("r")), keys)
    gap = F.col("g") - F.col("h")
    x = j.groupBy(*keys).agg(
        F.sum(F.col("p") * F.col("q") * gap * gap).alias("c"), F.sum(F.abs(F.col("g") * F.col("p") - F.col("h") * F.col("q"))).alias("b"),
        F.sum(F.abs(gap) * (F.col("p") * F.col("s") + F.col("q") * F.col("r")) / (F.col("p") + F.col("q"))).alias("x"), F.sum((F.col("p") + F.col("q")) * gap * gap).alias("t"),
    )
    ps = p.groupBy(*keys, "np", "ng", "ss").agg(F.sum(F.col("p") * F.col("s")).alias("ps"))
    some = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    pairs = (F.col("ng") * (F.col("ng") - 1)).cast("double")
    return x.join(ps, keys).select(
        *keys, some(F.lit(1.0), F.col("ps")).alias("coarseness"), (some(F.col("c"), pairs) * F.col("ss") / F.col("np")).alias("contrast"), some(F.col("ps"), F.col("b")).alias("busyness"),
        (F.col("x") / F.col("np")).alias("complexity"), some(F.col("t"), F.col("ss")).alias("strength"),
    )
