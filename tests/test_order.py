"""Running sums, ranks and quantiles of groups cut into ranges, against windows and Spark's own percentile."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.operators import order

SCHEMA = "g string, v double, i long, n long"


def data(seed=3, n=400):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 0.0, -1.5, 2.0, r.random()]), i, r.choice([1, 2, None])) for i in range(n)]
    return rows + [("only null", None, n, 1), ("one", 7.0, n + 1, 1)]


def test_running_equals_window(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    w = Window.partitionBy("g").orderBy("v", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = {r.i: r.w for r in df.withColumn("w", F.coalesce(F.sum("n").over(w), F.lit(0))).collect()}
    got = order.running(df, ["g"], ["v", "i"], "n")
    assert got.columns == [*df.columns, "before_n"]
    assert {r.i: r.before_n for r in got.collect()} == want
    assert order.running(df.limit(0), ["g"], ["v", "i"], "n").count() == 0


def test_ranks_equal_window(spark):
    df = spark.createDataFrame(data(), SCHEMA).where("v IS NOT NULL")
    rank = F.rank().over(Window.partitionBy("g").orderBy("v")) + (F.count("*").over(Window.partitionBy("g", "v")) - 1) / 2.0
    want = {(r.g, r.v): r.rank for r in df.withColumn("rank", rank).collect()}
    got = order.ranked(df, "v", ["g"], ("total", F.sum("i"))).collect()
    assert {(r.g, r.v): r["rank"] for r in got} == want
    assert sum(r.n for r in got) == df.count()
    assert sum(r.total for r in got) == df.agg(F.sum("i")).first()[0]


def test_quantiles_equal_percentile(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    shares = [0.0, 0.01, 0.25, 0.5, 0.613, 0.75, 0.99, 1.0]
    want = {r.g: r.q and list(r.q) for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    names = [f"q{i}" for i in range(len(shares))]
    got = {r.g: [r[n] for n in names] for r in order.quantiles(df, "v", ["g"], shares, names).collect()}
    assert got.pop("only null") == [None] * len(shares) and want.pop("only null") is None
    assert got == want  # to the last digit


def test_one_hot_condition(spark):
    """A million rows of one condition: no range holds more than its share, and no exchange goes to one task."""
    df = spark.range(1_000_000, numPartitions=8).select(F.lit("hot").alias("g"), F.round(F.rand(5) * 300_000).alias("v"))
    got = order.ranked(df, "v", ["g"])
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    total = got.agg(F.sum(F.col("n") * F.col("rank")).alias("s"), F.sum("n").alias("n")).first()
    assert total.n == 1_000_000 and total.s == pytest.approx(1_000_000 * 1_000_001 / 2)
    held = order.written(df.groupBy("g", "v").count().repartitionByRange(4, "g", "v").withColumn("p", F.spark_partition_id()), "t").groupBy("p").count()
    assert held.agg(F.max("count") / F.avg("count")).first()[0] < 1.5
    (q,) = order.quantiles(df, "v", ["g"], [0.5], ["q"]).collect()
    assert q.q == df.agg(F.percentile("v", F.lit(0.5))).first()[0]


def test_rank_statistics_equal_windows(spark):
    """Wilcoxon's and Cliff's statistics from ranges against ranks in one window by condition."""
    from voxloom.operators import stats

    rnd = random.Random(6)
    pairs = spark.createDataFrame([(rnd.choice("ab"), rnd.choice(["x", "y"]), rnd.choice([0.0, 1.0, -1.0, round(rnd.gauss(0.2, 1), 2)])) for _ in range(900)], "g string, side string, d double")
    r = pairs.where("d <> 0").withColumn("_a", F.abs("d")).withColumn("_r", stats.average_rank("_a", ["g"]))
    want = {x.g: (x.n, min(x.up, x.down)) for x in r.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("_r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("_r")).otherwise(0.0)).alias("down")).collect()}
    assert {x.g: (x.n, x.w) for x in stats.wilcoxon(pairs, ["g"]).collect()} == want
    rows = pairs.collect()
    for x in stats.cliffs_delta(pairs, "d", "side", "x", "y", ["g"]).collect():
        a, b = ([v.d for v in rows if v.g == x.g and v.side == s] for s in "xy")
        assert x.delta == pytest.approx(sum((u > v) - (u < v) for u in a for v in b) / len(a) / len(b), abs=1e-12)


def test_bootstrap_by_numpy_and_partitioning(spark):
    import numpy as np

    from voxloom.operators import stats

    rng = np.random.default_rng(1)
    data = [(g, k, float(rng.normal(0.3, 1.0))) for g in ("a", None) for k in range(120)] + [("one", 5, 2.0), ("a", 7, None)]
    df = spark.createDataFrame(data, "g string, unit long, d double")
    got = {r.g: (r.mean_d, r.low, r.high) for r in stats.bootstrap_mean(df, ["g"], "unit", 2000).collect()}
    assert got["one"] == (2.0, 2.0, 2.0)
    for g in ("a", None):
        unit, d = (np.array(x) for x in zip(*[(u, v) for h, u, v in data if h == g and v is not None], strict=True))
        w = stats.draws(unit.astype(np.int64), np.arange(2000), 42)
        assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
        low, high = np.quantile(d @ w / w.sum(axis=0), [0.025, 0.975])
        assert got[g] == pytest.approx((d.mean(), low, high), abs=1e-9)
        plain = np.quantile(d[rng.integers(0, len(d), (20_000, len(d)))].mean(axis=1), [0.025, 0.975])  # rows drawn with replacement
        assert abs(low - plain[0]) < 0.03 and abs(high - plain[1]) < 0.03
    again = {r.g: (r.mean_d, r.low, r.high) for r in stats.bootstrap_mean(df.repartition(7), ["g"], "unit", 2000).collect()}
    assert all(again[g] == pytest.approx(got[g], abs=1e-12) for g in got)
    named = stats.bootstrap_mean(df.withColumn("unit", F.concat(F.lit("u"), "unit")), ["g"], "unit", 500).collect()
    assert len(named) == 3 and stats.bootstrap_mean(df.limit(0), ["g"], "unit", 50).count() == 0


def test_versions_of_tables(spark, tmp_path):
    """A writer that stops midway leaves the version before whole; two writers' status rows keep their order."""
    from voxloom.sources import results

    path = str(tmp_path / "tables")
    one, two = spark.range(3), spark.range(5)
    results.write_tables({"a": one, "b": one}, path, {"run": 1})
    fails = two.select(F.raise_error(F.lit("stopped")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        results.write_tables({"a": two, "b": fails}, path, {"run": 2})
    tables, meta = results.read_tables(spark, path)
    assert meta["run"] == 1 and [tables[n].count() for n in "ab"] == [3, 3]
    results.write_tables({"a": two}, path, {"run": 3})
    held = tables["a"].count()  # who reads the old version still can
    tables, meta = results.read_tables(spark, path)
    assert (meta, held) == ({"run": 3, "tables": ["a"]}, 3) and tables["a"].count() == 5
    first, second = (results.StatusLog(spark, str(tmp_path / "log")) for _ in range(2))
    first.add("s", "t", "failed", "x")
    second.add("s", "t", "done")
    assert [tuple(r) for r in first.latest().collect()] == [("s", "t", "done", None)]


def test_linear_weights_by_numpy(spark):
    import numpy as np

    from voxloom.operators import stacking

    eq = spark.createDataFrame([(0, 4.0, 1.0, 3.0, 5.0, 2.0), (1, 1.0, 1.0, 1.0, 2.0, 2.0)], "rid int, q11 double, q12 double, q22 double, b1 double, b2 double")
    got = {r.rid: r for r in stacking.linear_weights(eq, 2, 0.0).collect()}
    assert np.allclose(got[0].w, np.linalg.solve([[4, 1], [1, 3]], [5, 2])) and got[0].message == "direct"
    assert np.allclose(got[1].w, [1, 1]) and got[1].message == "pseudo-inverse"
    assert got[1].objective == pytest.approx(4 - 8)


def test_bootstrap_draws_a_unit_once(spark, monkeypatch):
    """Units are drawn for a block of conditions at a time, not again for each, and the intervals don't depend on blocks and tasks."""
    from voxloom.operators import stats

    rnd = random.Random(4)
    df = spark.createDataFrame([(g, k, rnd.gauss(g, 1.0)) for g in range(30) for k in range(40)], "g int, unit long, d double")
    of = lambda: {r.g: (r.mean_d, r.low, r.high) for r in stats.bootstrap_mean(df, ["g"], "unit", 300).collect()}
    drawn = spark.sparkContext.accumulator(0)
    plain = stats.draws

    def counted(unit, resample, seed):
        drawn.add(len(unit))
        return plain(unit, resample, seed)

    monkeypatch.setattr(stats, "draws", counted)
    whole = of()
    assert 40 <= drawn.value < 120  # 30 times 40 if each condition drew its own
    monkeypatch.setattr(stats, "CONDITIONS", 4)
    monkeypatch.setattr(stats, "UNIT_ROWS", 150)
    cut = of()
    assert whole.keys() == cut.keys() and all(cut[g] == pytest.approx(whole[g], abs=1e-12) for g in whole)


def test_metrics_are_dealt_by_their_lines(spark, monkeypatch):
    """However many tasks join and sum the lines, and on either way to the parts, the rows are the same, and readers get a table that is written once."""
    from voxloom.sources import tables

    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, tables.metrics(spark, sf).collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 150)
    dealt = tables.metrics(spark, sf)
    assert "Exchange" not in dealt._jdf.queryExecution().toString()
    assert sorted(map(tuple, dealt.collect())) == whole
    conditions = tables.metrics(spark, sf, ())
    assert conditions.columns == ["case_id", "model", "pulse", "spacing"] and sorted(map(tuple, conditions.collect())) == [r[:4] for r in whole]
