"""Ranks, quantiles and running sums over ranges against plain Python, with ties, nulls and one value for ten million rows."""

import bisect
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import evaluation as E
from folioscope.operators import ordered as O


@pytest.mark.parametrize("parts", ["4", "23"])
def test_running(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = random.Random(1)
        rows = [(g, v, rng.randint(0, 9)) for g in ("a", "b", None) for v in rng.sample(range(1000), 200)] + [("one", 5, 7)]
        df = spark.createDataFrame(rows, "g string, v int, n int").withColumn("place", F.lit("clash"))
        got = {(r.g, r.v): (r.upto, r.every) for r in O.running(df, ["g"], [F.desc("v")], {"upto": "n"}, {"every": "n"}).collect()}
        want = {(g, v): (sum(n for h, w, n in rows if h == g and w >= v), sum(n for h, _, n in rows if h == g)) for g, v, _ in rows}
        assert got == want
        whole = O.running(df, [], ["v", "g"], {"upto": "n"}).agg(F.max("upto")).first()[0]
        assert whole == sum(r[2] for r in rows)
        assert O.running(df.limit(0), ["g"], ["v"], {"upto": "n"}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def brute_spearman(pairs):
    def ranks(values):
        s = sorted(values)
        return [(bisect.bisect_left(s, v) + bisect.bisect_right(s, v) + 1) / 2 for v in values]

    if len(pairs) < 3:
        return None
    x, y = (np.array(ranks(v)) for v in zip(*pairs, strict=True))
    x, y = x - x.mean(), y - y.mean()
    d = (x @ x) * (y @ y)
    return None if d == 0 else float(x @ y / d**0.5)


def test_spearman(spark):
    rng = random.Random(2)
    groups = {
        "ties": [(rng.randint(0, 5), rng.randint(0, 3)) for _ in range(500)],
        "plain": [(rng.random(), rng.random()) for _ in range(300)],
        "hot": [(0.0 if rng.random() < 0.8 else rng.random(), rng.random()) for _ in range(700)],
        "constant": [(0.1, rng.random()) for _ in range(50)],
        "two": [(1.0, 2.0), (2.0, 1.0)],
        None: [(float(i), -float(i)) for i in range(20)],
    }
    rows = [(g, float(x), float(y)) for g, p in groups.items() for x, y in p]
    rows += [("ties", None, 1.0), ("ties", 1.0, float("nan")), ("ties", float("inf"), 1.0), ("lost", None, None)]
    got = {r.metric: (r.n, r.rho) for r in E.spearman(spark.createDataFrame(rows, "metric string, x double, y double")).collect()}
    assert set(got) == set(groups)
    for g, pairs in groups.items():
        want = brute_spearman(pairs)
        assert got[g][0] == len(pairs) and (got[g][1] is None if want is None else got[g][1] == pytest.approx(want, abs=1e-12)), g


def test_ten_million_equal_values(spark):
    """Equal values are a row by the time that anything is ordered."""
    n = 10_000_000
    same = spark.range(0, n, 1, 8).select(F.lit("m").alias("metric"), F.lit(3.5).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    more = spark.range(0, 3).select(F.lit("m").alias("metric"), F.col("id").cast("double").alias("x"), F.lit(9.0).alias("y"))
    got = E.spearman(same.unionByName(more)).first()
    # ranks by hand: x has 0, 1, 2 below the crowd; y has 7 runs and then the three
    runs = [len(range(i, n, 7)) for i in range(7)]
    total, at, ry = n + 3, 0, []
    for k in [*runs, 3]:
        ry.append(at + (k + 1) / 2)
        at += k
    mean, rx = (total + 1) / 2, [1, 2, 3, 3 + (n + 1) / 2]
    sxx = sum((r - mean) ** 2 for r in rx[:3]) + n * (rx[3] - mean) ** 2
    syy = sum(k * (r - mean) ** 2 for k, r in zip([*runs, 3], ry, strict=True))
    sxy = sum((r - mean) * (ry[7] - mean) for r in rx[:3]) + sum(k * (rx[3] - mean) * (r - mean) for k, r in zip(runs, ry[:7], strict=True))
    assert got.n == total and got.rho == pytest.approx(sxy / (sxx * syy) ** 0.5, rel=1e-9)
    q = O.quantiles(same, ["metric"], "x", [0.0, 0.5, 1.0]).first()
    assert (q.n, q.low, q.high, q.q) == (n, 3.5, 3.5, [3.5, 3.5, 3.5])


@pytest.mark.parametrize("margin", [5, 0, 4000])
def test_quantiles(spark, monkeypatch, margin):
    """With a margin of nothing brackets miss places, which are then looked for among all values."""
    monkeypatch.setattr(O, "MARGIN", margin)
    if margin == 0:
        monkeypatch.setattr(O, "ACCURACY", 7)
    rng = np.random.default_rng(3)
    groups = {"wide": rng.lognormal(0, 9, 20_000), "ties": rng.integers(0, 4, 5_000).astype(float), "one": np.array([2.5]), "two": np.array([1.0, 2.0]), "signs": rng.normal(0, 1, 999), None: np.arange(11.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("wide", None), ("none", None)]
    shares = [0.0, 0.05, 0.4, 0.5, 0.95, 1.0]
    got = {r.metric: r for r in O.quantiles(spark.createDataFrame(rows, "metric string, value double"), ["metric"], "value", shares).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert (got[g].n, got[g].low, got[g].high) == (len(v), v.min(), v.max())
        assert got[g].q == pytest.approx(np.quantile(v, shares).tolist(), rel=1e-12), g


def test_average_precision_over_ranges(spark):
    rng = random.Random(5)
    rows = [(g, rng.random() < 0.3, round(rng.random(), d)) for g, d in (("fine", 9), ("coarse", 1)) for _ in range(2000)] + [("all", True, 0.5), ("none", False, 0.5)]
    got = {r.label: r.average_precision for r in E.average_precision(spark.createDataFrame(rows, "label string, truth boolean, score double")).collect()}
    for g in ("fine", "coarse"):
        own = sorted(((s, t) for h, t, s in rows if h == g), reverse=True)
        cum = pos = 0
        total, want = sum(t for _, t in own), 0.0
        for i, (s, t) in enumerate(own):
            cum, pos = cum + t, pos + t
            if i + 1 == len(own) or own[i + 1][0] != s:
                want += pos * cum / (i + 1)
                pos = 0
        assert got[g] == pytest.approx(want / total, abs=1e-12)
    assert got["all"] is None and got["none"] is None


def test_no_window_over_a_whole_group(spark):
    """Windows over rows are dealt by range as well as by group."""
    rows = spark.range(100).select(F.lit("m").alias("label"), (F.col("id") % 2 == 0).alias("truth"), F.col("id").cast("double").alias("score"))
    plan = E.average_precision(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    for line in re.findall(r"Window \[.*", plan):
        if "__own" in line:
            assert "__range" in line.split("windowspecdefinition(")[1].split("ASC")[0]
