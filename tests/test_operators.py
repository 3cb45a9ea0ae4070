"""Operators on small hand-made tables."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from folioscope import config
from folioscope.functions import scoring as S
from folioscope.functions import text as X
from folioscope.operators import evaluation as E
from folioscope.operators import labels as L
from folioscope.operators import pixels as P
from folioscope.operators import split as D
from folioscope.operators import synth as Y
from folioscope.sources import logs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def smap(**scores):
    pairs = [v for k, s in scores.items() for v in (F.lit(k), F.lit(s))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


@pytest.mark.parametrize(("scores", "want"), [({"blur": 0.1, "unreadable": 0.05}, "good"), ({"blur": 0.45}, "acceptable"), ({"blur": 0.85}, "bad"), ({"unreadable": 0.55}, "bad"), ({}, "good")])
def test_verdict(spark, scores, want):
    assert one(spark, S.verdict(smap(**scores))) == want


def test_quality_and_anchors(spark):
    assert one(spark, S.quality(smap())) == 1.0
    assert one(spark, S.quality(smap(blur=0.25, noise=0.1))) == 0.75
    assert one(spark, S.anchor_score(F.lit(510.0), 900, 120)) == 0.5
    assert one(spark, S.anchor_score(F.lit(None).cast("double"), 0, 1)) is None
    with pytest.raises(ValueError):
        S.anchor_score(F.lit(1), 2, 2)


@pytest.mark.parametrize(("name", "want"), [("0000002770.tif", "0000002"), ("515575465+-5466.tif", "5155754"), ("scan_no_digits.tif", "scan_no_digits")])
def test_document_id(spark, name, want):
    assert one(spark, S.document_id(F.lit(f"/a/b/{name}"), "bates7")) == want
    assert one(spark, S.document_id(F.lit(f"/a/b/{name}"), "parent")) == "b"


def test_text(spark):
    assert one(spark, X.garbage_ratio(F.lit("ab □□"), ["en"], "")) == 0.5
    assert one(spark, X.garbage_ratio(F.lit(""), ["en"], "")) == 0.0
    assert one(spark, X.nonword_ratio(F.lit("the rn1lI brrr, 1994 --"), ["en"])) == 0.5
    anchors = config.DEFAULTS["ocr"]["unreadable"]
    good = {"mean_confidence": F.lit(0.92), "garbage_ratio": F.lit(0.0), "nonword_ratio": F.lit(0.0)}
    assert one(spark, X.unreadable(F.lit(50), good, anchors)) == 0.0
    assert one(spark, X.unreadable(F.lit(50), good | {"mean_confidence": F.lit(0.3)}, anchors)) == 1.0
    assert one(spark, X.unreadable(F.lit(2), good, anchors)) is None


def test_config(tmp_path):
    base = config.load()
    over = config.load({"scores": {"blur": {"good": 2.0}}, "local": ["glare"]})
    assert over["scores"]["blur"] == {"metric": "tenengrad_norm", "good": 2.0, "bad": 0.459} and over["local"] == ["glare"] and base["scores"]["blur"]["good"] == 0.988
    for wrong in ({"split": {"ratios": {"train": 0.5}}}, {"verdict": {"tau_low": 0.9}}, {"unheard": 1}, {"scores": {"blur": {"good": 0.459}}}, {"cv": {"tpyo": 1}}):
        with pytest.raises(ValueError):
            config.load(wrong)
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yaml")
    (tmp_path / "list.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "list.yaml")


def test_last_wins_and_strict_lines(spark, tmp_path):
    rec = '{"image": "%s", "document": "d", "labels": {"blur": %s}}'
    (tmp_path / "log.jsonl").write_text("﻿" + rec % ("a", "true") + "\n{not json\n\n" + rec % ("b", "false") + "\n" + rec % ("a", "false") + "\n" + '{"image": "c", "document": "d", "labels": {}, "oops": 1}\n', encoding="utf-8")
    got = logs.read_labels(spark, str(tmp_path / "log.jsonl")).orderBy("first_pos").collect()
    assert [(r.image, r.labels["blur"]) for r in got] == [("a", False), ("b", False)]
    assert logs.read_labels(spark, str(tmp_path / "log.jsonl"), dedupe=False).count() == 3
    assert logs.bad_lines(spark, str(tmp_path / "log.jsonl")).count() == 2


def test_manifest_fails_on_a_bad_line(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"image": "a", "reference": "r", "seed": 42000126}\n')
    assert logs.read_manifest(spark, str(tmp_path / "m.jsonl")).first()["seed"] == 42000126
    (tmp_path / "m.jsonl").write_text('{"image": "a", "reference": "r", "seed": 1}\n{"image": 3\n')
    with pytest.raises(Exception, match="bad manifest line"):
        logs.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()


def test_split(spark):
    sizes = [20, 15, 10, 5, 3, 3, 2, 2, 1, 1, 1, 1]
    df = spark.createDataFrame([(f"d{i}", n) for i, n in enumerate(sizes)], "document string, n long")
    got = D.allocate(df, {"train": 0.2, "val": 0.3, "test": 0.5}, 42)
    pages = {r["part"]: r["n_images"] for r in D.shares(got).collect()}
    assert abs(pages["train"] / 64 - 0.2) <= 0.05 and abs(pages["val"] / 64 - 0.3) <= 0.05 and abs(pages["test"] / 64 - 0.5) <= 0.05
    assert D.leaks(got).count() == 0 and got.count() == len(sizes)
    assert D.allocate(df.limit(0), {"train": 0.2, "val": 0.3, "test": 0.5}, 42).count() == 0


def test_split_beyond_the_greedy_bound(spark, monkeypatch):
    monkeypatch.setattr(D, "GREEDY_DOCUMENTS", 50)
    df = spark.range(2000).select(F.concat(F.lit("d"), "id").alias("document"), F.lit(1).cast("long").alias("n"))
    got = D.allocate(df, {"train": 0.2, "val": 0.3, "test": 0.5}, 42)
    share = {r["part"]: r["n_images"] / 2000 for r in D.shares(got).collect()}
    assert got.count() == 2000 and D.leaks(got).count() == 0
    assert abs(share["train"] - 0.2) < 0.05 and abs(share["val"] - 0.3) < 0.05


def _greedy(sizes, ratios, seed):
    """The rule one document at a time."""
    pages, filled, out = sum(sizes.values()), dict.fromkeys(ratios, 0), {}
    for d in sorted(sizes, key=lambda d: (-sizes[d], hashlib.md5(f"{seed}:{d}".encode()).hexdigest(), d)):
        out[d] = max(ratios, key=lambda p: pages * ratios[p] - filled[p])
        filled[out[d]] += sizes[d]
    return out


def test_split_is_greedy_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(D, "GREEDY_DOCUMENTS", 50)
    monkeypatch.setattr(D, "STEPS", 20)
    ratios = {"train": 0.2, "val": 0.3, "test": 0.5}
    for sizes in ({f"d{i}": 1 for i in range(2001)}, {f"d{i}": 1 + (i * i) % 7 + 400 * (i % 97 == 0) + i * (i % 131 == 0) for i in range(1500)}):
        got = D.allocate(spark.createDataFrame(list(sizes.items()), "document string, n long"), ratios, 42).collect()
        assert {r["document"]: (r["part"], r["n"]) for r in got} == {d: (p, sizes[d]) for d, p in _greedy(sizes, ratios, 42).items()} and len(got) == len(sizes)


def test_split_counts_a_run_off_at_once(monkeypatch):
    for filled, target, n in (([0, 0, 0], [0.2 * 9001, 0.3 * 9001, 0.5 * 9001], 1), ([70, 3, 500], [200.1, 300.0, 499.9], 3), ([5, 5, 5], [10.0, 10.0, 10.0], 2), ([0, 0, 0], [1.0, 1.0, 2.0], 0)):
        for k in (0, 1, 2, 3, 50, 333, 900):
            stepped = D.advance(filled, target, n, k)
            with monkeypatch.context() as m:
                m.setattr(D, "STEPS", -1)
                assert D.advance(filled, target, n, k) == stepped


def test_evaluation(spark):
    rows = spark.createDataFrame([("a", True, 0.9), ("a", False, 0.8), ("a", True, 0.8), ("a", False, 0.1), ("b", False, 0.9)], "label string, truth boolean, score double")
    pr = {r["label"]: r for r in E.precision_recall(rows).collect()}
    assert pr["a"]["precision"] == pytest.approx(2 / 3) and pr["a"]["recall"] == 1 and pr["b"]["f1"] == 0 and pr["b"]["support"] == 0
    ap = {r["label"]: r["average_precision"] for r in E.average_precision(rows).collect()}
    assert ap["a"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and ap["b"] is None
    w = {r["label"]: r for r in E.pos_weight(spark.createDataFrame([("x", i < 10) for i in range(100)] + [("y", i < 1) for i in range(100)] + [("z", False)], "label string, truth boolean")).collect()}
    assert w["x"]["pos_weight"] == 9 and w["y"]["capped"] == 50 and w["z"]["pos_weight"] == 1
    assert "—" in E.metric_table([{"label": "b", "precision": 0, "recall": 0, "f1": 0, "average_precision": None, "support": 0}])


def test_spearman(spark):
    rows = spark.createDataFrame([("up", float(i), float(i * i)) for i in range(9)] + [("flat", 1.0, float(i)) for i in range(9)] + [("few", 1.0, 2.0), ("up", math.nan, 0.0)], "metric string, x double, y double")
    rho = {r["metric"]: r["rho"] for r in E.spearman(rows).collect()}
    assert rho["up"] == pytest.approx(1) and rho["flat"] is None and rho["few"] is None
    assert E.spearman_p(0.5, 20) == pytest.approx(0.0248, abs=2e-4) and E.stars(0.0005) == "***"


def test_calibration(spark):
    v = spark.createDataFrame([("tenengrad_norm", float(i)) for i in range(1000)] + [("noise_sigma", float(i)) for i in range(1000)] + [("shadow_frac", 0.0)] * 5, "metric string, value double")
    got = {r["label"]: (r["good"], r["bad"]) for r in E.calibrate(v, config.DEFAULTS["scores"]).collect()}
    assert got == {"blur": (599.4, 49.95), "noise": (399.6, 949.05)}


def test_best_so_far(spark):
    rows = spark.createDataFrame([(1, 0.2), (2, math.nan), (3, 0.1), (4, 0.5), (5, None)], "epoch int, v double").withColumn("k", F.lit(1))
    assert [r["improved"] for r in E.best_so_far(rows, "v", "epoch", ["k"]).orderBy("epoch").collect()] == [True, False, False, True, False]


def test_patch_grid(spark):
    g = P.patch_grid(spark.createDataFrame([(1, 1200, 1600), (2, 100, 100), (3, 0, 5)], "page int, width int, height int")).collect()
    a = [r for r in g if r["page"] == 1]
    assert len(a) == 54 and max(r["x1"] for r in a) == 1200 and max(r["y1"] for r in a) == 1600 and [r["index"] for r in a] == list(range(54))
    assert len([r for r in g if r["page"] == 2]) == 1


def test_plan_meets_quotas():
    labels = [x for x in config.LABELS if x != "unreadable"]
    rows = Y.plan(600, labels, config.DEFAULTS["synth"])
    assert all(1 <= len(r["steps"]) <= 3 for r in rows) and rows == Y.plan(600, labels, config.DEFAULTS["synth"])
    assert rows[5]["seed"] == 42 * 1_000_003 + 5
    for x in labels:
        assert sum(x in dict(r["steps"]) for r in rows) >= 0.9 * 0.15 * 600


def test_queue_takes_rare_labels(spark):
    rows = [(f"p{i:03d}", {"blur": 0.9 if i % 3 == 0 else 0.1, "streaks": 0.9 if i % 97 == 0 else 0.0}) for i in range(400)]
    df = spark.createDataFrame(rows, "image string, scores map<string,double>")
    got = {r["image"] for r in L.select_queue(df, ["blur", "streaks"], 40, 0.5, 42).collect()}
    assert len(got) == 40 and {f"p{i:03d}" for i in range(0, 400, 97)} <= got
    assert L.select_queue(df.limit(0), ["blur"], 40).count() == 0


def test_enrich_and_resume(spark):
    m = one(spark, L.enrich(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))))
    assert m == {"a": 1, "b": 3}
    queue = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, image string")
    assert L.resume_position(queue, queue.where("pos = 0"), "image").first()["pos"] == 1
    assert L.resume_position(queue, queue, "image").first()["pos"] == 0


def test_label_stream(spark, tmp_path):
    """Late, repeated and tied lines, a null key; a batch writes what it changes and no more; a version run again and a compaction change nothing."""
    from folioscope.streaming import label_log

    schema, table = "image string, ord int, v int", f"file://{tmp_path}/t"
    log = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    now = lambda: {r["image"]: r["v"] for r in label_log.current(spark, table, "image", "ord").collect()}
    assert label_log.current(spark, table, "image", "ord") is None
    batches = [[("a", 1, 10), ("b", 2, 20)] + [(f"i{i}", 1, i) for i in range(50)], [("a", 3, 30), ("a", 3, 30)], [("b", 1, 99), (None, 1, 7)], [("a", 3, 31), ("b", None, 5)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        label_log.upsert_stream(log(), "image", "ord", table, str(tmp_path / "cp")).awaitTermination(60)
        if k == 1:
            assert {r["image"]: r["v"] for r in spark.read.parquet(f"{table}/v=1").collect()} == {"a": 30}
            label_log.compact(spark, table, "image", "ord")
            assert now()["a"] == 30 and len(now()) == 52
    want = {"a": 31, "b": 20, None: 7} | {f"i{i}": i for i in range(50)}
    assert now() == want
    spark.read.parquet(f"{table}/v=3").write.parquet(f"{table}/v=4")
    assert now() == want
    label_log.compact(spark, table, "image", "ord")
    label_log.compact(spark, table, "image", "ord")
    assert now() == want == {r["image"]: r["v"] for r in spark.read.parquet(f"{table}/c=4").collect()}
