"""The logistic baseline against Newton steps by numpy, and its odd cases."""

import math
import zlib

import numpy as np
import pytest

from folioscope.operators import baseline as B


def newton(x, y, test, most=50.0, regular=1e-3):
    """The same model, plainly: mean of weighted losses plus half the squared weights of scaled measures."""
    x, test = x.copy(), test.copy()
    mean = np.nanmean(x, axis=0)
    for a in (x, test):
        a[np.isnan(a)] = np.take(mean, np.nonzero(np.isnan(a))[1])
    mu, sd = x.mean(0), x.std(0, ddof=1)
    one = lambda a: np.hstack([(a - mu) / sd, np.ones((len(a), 1))])
    f, w = one(x), np.where(y, min(most, (~y).sum() / y.sum()), 1.0)
    b, r = np.zeros(f.shape[1]), np.append(np.full(x.shape[1], regular), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-f @ b))
        h = (f * (w * p * (1 - p))[:, None]).T @ f / w.sum() + np.diag(r)
        b -= np.linalg.solve(h, f.T @ (w * (p - y)) / w.sum() + r * b)
    return 1 / (1 + np.exp(-one(test) @ b))


def test_baseline_equals_newton_in_every_fold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        a, b = rng.normal(size=2)
        rows.append((f"d{i % 23}", "x", None if i % 17 == 0 else float(a), float("nan") if i % 29 == 0 else float(b), bool(a + rng.normal() > 0.7), None if i % 5 == 0 else bool(b > 0.5)))
    rows += rows[:7]
    df = spark.createDataFrame(rows, "doc string, label string, m1 double, m2 double, one boolean, two boolean").withColumnsRenamed({"doc": "truth"})
    got = B.cross_validated(df, "truth", ["m1", "m2"], ["one", "two"], folds=2).collect()
    want = []
    for name, at in (("one", 4), ("two", 5)):
        own = [r for r in rows if r[at] is not None]
        k = np.array([zlib.crc32(r[0].encode()) % 2 for r in own])
        x = np.array([[math.nan if v is None else v for v in r[2:4]] for r in own])
        y = np.array([r[at] for r in own])
        for f in (0, 1):
            p = newton(x[k != f], y[k != f], x[k == f])
            want += [(r[0], name, r[at], s) for r, s in zip([r for r, q in zip(own, k) if q == f], p)]
    key = lambda r: (r[1], r[0], r[2], r[3])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-3)


def test_baseline_odd_cases(spark):
    schema = "doc string, m double, nothing double, y boolean, never boolean"
    df = spark.createDataFrame([("a", 1.0, None, True, False), ("b", 2.0, None, False, False), ("b", 2.5, None, False, False), (None, None, None, None, False)], schema)
    got = B.held_out_scores(df, df, "doc", ["m", "nothing"], ["y", "never"]).collect()
    assert sorted(r.label for r in got) == ["never"] * 4 + ["y"] * 3
    assert all(r.score == 0 for r in got if r.label == "never")
    assert all((r.score > 0.5) == r.truth for r in got if r.label == "y")
    only = B.held_out_scores(df, df, "doc", ["nothing"], ["y"]).collect()
    assert {round(r.score, 6) for r in only} == {round(1 / 3, 6)}
    assert B.held_out_scores(df.limit(0), df.limit(0), "doc", ["m"], ["y"]).count() == 0
    assert {r.score for r in B.held_out_scores(df.limit(0), df, "doc", ["m"], ["y"]).collect()} == {0.0}
