"""Writers and readers of split, queue and manifest files, reports, and faster kernels against plain loops."""

import numpy as np
import pytest

from folioscope.functions import raster as R
from folioscope.operators import evaluation as E
from folioscope.operators import labels as L
from folioscope.operators import split as D
from folioscope.sources import logs


def test_split_files(spark, tmp_path):
    records = spark.createDataFrame([(f"{d}{p}.jpg", d) for d in "abc" for p in range(2)] + [("a0.jpg", "a")], "image string, document string")
    split = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train")], "document string, part string")
    whole = D.assemble(split, records)
    got = {r["part"]: (r["documents"], r["images"], r["n_documents"], r["n_images"]) for r in whole.collect()}
    assert got == {"train": (["a", "c"], ["a0.jpg", "a0.jpg", "a1.jpg", "c0.jpg", "c1.jpg"], 2, 5), "val": ([], [], 0, 0), "test": (["b"], ["b0.jpg", "b1.jpg"], 1, 2)}
    logs.write_split(whole, str(tmp_path))
    assert {r["part"]: r["documents"] for r in logs.read_split(spark, str(tmp_path)).collect()} == {k: v[0] for k, v in got.items()}
    assert [r["document"] for r in logs.read_held_out(spark, str(tmp_path)).collect()] == ["b"]
    (tmp_path / "val.json").unlink()
    with pytest.raises(FileNotFoundError, match="val.json"):
        logs.read_held_out(spark, str(tmp_path))


def test_queue_and_missing_logs(spark, tmp_path):
    queue = spark.createDataFrame([("b.jpg", "b", None, 0.5), ("a.jpg", "é", None, 0.1)], "image string, document string, corpus string, score double")
    logs.write_queue(queue, f"{tmp_path}/queue.json")
    assert [r["image"] for r in logs.read_queue(spark, f"{tmp_path}/queue.json").orderBy("pos").collect()] == ["b.jpg", "a.jpg"]
    text = (tmp_path / "queue.json").read_text()
    assert '"document": "é"' in text and '"corpus": null' in text
    assert logs.read_done(spark, f"{tmp_path}/none.jsonl").count() == 0 and logs.read_prelabels(spark, f"{tmp_path}/none.jsonl").count() == 0


def test_manifest_is_replaced(spark, tmp_path):
    for seed in (1, 2):
        logs.write_manifest(spark.createDataFrame([("x", "r", "d", seed)], "image string, reference string, document string, seed long"), f"{tmp_path}/m")
    assert [r["seed"] for r in spark.read.json(f"{tmp_path}/m").collect()] == [2]


def test_reports(spark):
    rows = spark.createDataFrame([("a", 0.1, 50), ("b", None, 2), ("c", -0.9, 50)], "metric string, rho double, n long")
    got = [r.asDict() for r in E.ranked(rows).collect()]
    assert [r["metric"] for r in got] == ["c", "a", "b"]
    lines = E.correlation_report(got).splitlines()
    assert lines[2].startswith("| c | -0.900 | 50 | 0.0000 | ***") and lines[4] == "| b | — | 2 | — |  |"
    report = L.frequency_report([{"label": "blur", "train": 3, "val": 1, "test": 0, "status": "missing"}])
    assert report.splitlines()[-1] == "| blur | 3 | 1 | 0 | missing |"
    many = spark.createDataFrame([(x, f"{i:03}") for x in "ab" for i in range(15)], "label string, image string")
    assert sorted((r["label"], r["image"]) for r in L.first_per_label(many).collect()) == [(x, f"{i:03}") for x in "ab" for i in range(10)]


def test_median_and_components_by_loops():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (1, 9), (7, 2), (12, 15)):
        img = rng.integers(0, 256, (h, w)).astype(np.uint8)
        p = np.pad(img, 1, mode="edge")
        assert (R.median3(img) == np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)).all()
    for share in (0.1, 0.3, 0.5, 0.9):
        mask = rng.random((23, 31)) < share
        labels, stats = R.components(mask)
        seen, found = np.zeros(mask.shape, bool), []
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            todo, cells = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                cells.append((a, b))
                for i in range(max(0, a - 1), min(23, a + 2)):
                    for j in range(max(0, b - 1), min(31, b + 2)):
                        if mask[i, j] and not seen[i, j]:
                            seen[i, j] = True
                            todo.append((i, j))
            own = {labels[c] for c in cells}
            assert len(own) == 1 and (labels == own.copy().pop()).sum() == len(cells)
            ys, xs = zip(*cells, strict=True)
            found.append((len(cells), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
        assert sorted(map(tuple, stats.tolist())) == sorted(found) and not labels[~mask].any()
