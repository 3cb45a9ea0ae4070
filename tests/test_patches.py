"""Training patches, the recognition hook, rasters with a resolution, the metric log and the queue's turns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.config import DEFAULTS
from folioscope.functions import measures as M
from folioscope.operators import labels as L
from folioscope.operators import pages as G
from folioscope.operators import patches as T
from folioscope.operators import recognise as O
from folioscope.sources import logs
from folioscope.sources import pages as I

from .test_pages import text_page

SMALL = DEFAULTS | {"patch_size": 64}
MASK = "array<struct<label:string,height:int,width:int,mask:binary>>"
PAGES = f"image string, height int, width int, gray binary, labels map<string,boolean>, masks {MASK}"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture(scope="module")
def page():
    return text_page(300, 400, margin=40)


def test_choice_is_the_first_with_ink_or_the_best(page):
    got, ink = T.choose(page, 64, 0.01, 12, np.random.default_rng(5))
    x0, y0, x1, y1 = got
    assert ink >= 0.01 and ink == pytest.approx(float(M.ink(page[y0:y1, x0:x1]).mean())) and (x1 - x0, y1 - y0) == (64, 64)
    tried = [tuple(c) for c in np.random.default_rng(5).integers(0, [300 - 63, 400 - 63], size=(12, 2)).tolist()]
    shares = [float(M.ink(page[y : y + 64, x : x + 64]).mean()) for x, y in tried]
    first = next(i for i, s in enumerate(shares) if s >= 0.01)
    assert (x0, y0) == tried[first]
    most, ink = T.choose(page, 64, 2.0, 12, np.random.default_rng(5))  # no window has so much
    assert most[:2] == tried[int(np.argmax(shares))] and ink == pytest.approx(max(shares))
    assert T.choose(np.full((10, 30), 240, np.uint8), 64, 0.01, 3, np.random.default_rng(1))[1] == 0


def test_targets_follow_masks():
    mask = np.zeros((10, 10), np.uint8)
    mask[:, :5] = 255
    local = frozenset({"glare", "shadow"})
    of = lambda box, given: T.targets(given, {"glare": mask}, ["blur", "glare", "shadow"], local, box, (100, 100), 0.15)
    assert of((0, 0, 40, 40), {"glare": True, "blur": True}) == [1, 1, 0]
    assert of((60, 0, 100, 40), {"glare": True, "shadow": True}) == [0, 0, 1]  # outside its mask; no mask at all
    assert of((0, 0, 40, 40), {}) == [0, 0, 0]


def test_patches(spark, page):
    gray = page.tobytes()
    rows = [("a", 400, 300, gray, {"blur": True, "noise": False}, None), ("b", 400, 300, gray, None, [("glare", 0, 0, b"")]), ("none", None, None, None, None, None), ("tiny", 20, 30, bytes(600), {}, [])]
    df = rows_of(spark, rows)
    train = {(r["image"], r["step"]): r for r in T.patches(df, SMALL, seed=3).collect()}
    assert set(train) == {(x, i) for x in ("a", "b", "tiny") for i in range(4)}
    again = {(r["image"], r["step"]): r for r in T.patches(df.repartition(3), SMALL, seed=3).collect()}
    assert train == again
    assert train["a", 0]["pixels"] != train["b", 0]["pixels"]
    one = train["a", 0]
    assert one["target"] == [float(x == "blur") for x in DEFAULTS["labels"]] and len(one["pixels"]) == 64 * 64
    assert (train["tiny", 0]["x1"], train["tiny", 0]["y1"]) != (0, 0) and train["tiny", 0]["side"] == 64
    (check,) = T.patches(rows_of(spark, rows[:1]), SMALL, train=False).collect()
    part = page[check["y0"] : check["y1"], check["x0"] : check["x1"]]
    assert np.allclose(np.array(check["pixels"]).reshape(64, 64), (part / 255 - 0.449) / 0.226, atol=1e-5)
    assert T.channels(check["pixels"], 64).shape == (3, 64, 64)
    assert T.patches(rows_of(spark, []), SMALL).count() == 0


def test_variation_keeps_geometry():
    flat = np.full((8, 8), 100.0)
    out = T.varied(flat, 0.12, 0.12, np.random.default_rng(1))
    assert np.allclose(out, out[0, 0]) and abs(out[0, 0] - 100) <= 0.12 * 255
    assert T.varied(np.array([[0.0, 255.0]]), 0.12, 0.12, np.random.default_rng(1)).max() <= 255


class Ruler:
    """An engine that reads the size of a page, and fails on black ones."""

    def __init__(self, languages):
        self.languages = languages

    def read(self, gray):
        if not gray.any():
            raise RuntimeError("black")
        return [(f"{gray.shape[1]}x{gray.shape[0]}-{'+'.join(self.languages)}", 0.5, (0, 0, gray.shape[1], gray.shape[0]))]


def test_recognition_hook(spark):
    def make(languages):
        class Own:
            def read(self, gray):
                if not gray.any():
                    raise RuntimeError("black")
                return [(f"{gray.shape[1]}x{gray.shape[0]}-{'+'.join(languages)}", 0.5, (0, 0, gray.shape[1], gray.shape[0]))]

        return Own()

    ddl = "path string, page int, height int, width int, gray binary"
    df = spark.createDataFrame([("a", 0, 20, 40, bytes([9]) * 800), ("b", 0, 4, 4, bytes(16)), ("c", 0, None, None, None)], ddl)
    got = {r["path"]: r for r in O.words(df, ["en", "de"], make, side=10).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["words"][0]["text"] == "10x5-en+de" and (got["a"]["width"], got["a"]["height"]) == (10, 5)
    assert got["b"]["words"] == [] and got["b"]["error"] == "RuntimeError: black"
    with pytest.raises(ValueError, match="no such engine"):
        O.words(df, ["en"], "other")
    assert O.work_size(100, 50, 1600) == (100, 50) and O.work_size(3200, 10, 1600) == (1600, 5)
    assert O.engine(Ruler, ["en"]) is O.engine(Ruler, ["en"]) and O.engine(Ruler, ["de"]) is not O.engine(Ruler, ["en"])


def test_tesseract_rows():
    class Module:
        class Output:
            DICT = "dict"

        @staticmethod
        def image_to_data(gray, lang, output_type):
            assert (lang, output_type) == ("eng+deu", "dict")
            return {"text": ["", " word ", "low"], "conf": ["-1", "87.5", "-1"], "left": [0, 1, 2], "top": [0, 3, 4], "width": [5, 5, 5], "height": [6, 6, 6]}

    own = object.__new__(O.Tesseract)
    own.module, own.languages = Module, "+".join(O.TESSERACT_CODES.get(x, x) for x in ("en", "deu"))
    assert own.read(np.zeros((2, 2), np.uint8)) == [("word", 0.875, (1, 3, 6, 9))]


def test_jpeg_with_resolution(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    img = jvm.java.awt.image.BufferedImage(60, 80, 10)  # TYPE_BYTE_GRAY
    raster = img.getRaster()
    for x in range(60):
        for y in range(80):
            raster.setSample(x, y, 0, 200)
    path = tmp_path / "scan.jpg"
    assert jvm.javax.imageio.ImageIO.write(img, "jpg", jvm.java.io.File(str(path)))
    data = bytearray(path.read_bytes())
    assert data[6:11] == b"JFIF\0"
    data[13:16] = bytes([1, 0x02, 0x58])  # 600 dots an inch
    path.write_bytes(data)
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8 nothing")
    got = {r["path"].rpartition("/")[2]: r for r in I.load_rasters(spark, str(tmp_path)).collect()}
    assert set(got) == {"scan.jpg", "broken.jpg"}
    r = got["scan.jpg"]
    assert (r["height"], r["width"], r["dpi"], r["original_width"], r["original_height"]) == (40, 30, 300.0, 60, 80)
    assert abs(np.frombuffer(r["gray"], np.uint8).mean() - 200) <= 3 and r["error"] is None
    assert got["broken.jpg"]["gray"] is None and got["broken.jpg"]["error"]
    with pytest.raises(IndexError):
        I.load_page(I.scan(spark, str(tmp_path)), 1)
    assert I.load_page(I.scan(spark, str(tmp_path))).count() == 2


def test_metric_log(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    logs.append_metrics(spark, path, {"epoch": 1, "loss": 0.5, "other": 3}, ["epoch", "loss", "f1"])
    logs.append_metrics(spark, path, {"epoch": 2, "f1": None, "loss": "a,b"}, ["epoch", "loss", "f1"])
    assert (tmp_path / "log.csv").read_text() == 'epoch,loss,f1\n1,0.5,\n2,"a,b",\n'


def test_shown_measures(spark):
    df = spark.createDataFrame([("a", {"dpi": 300.0, "tenengrad": 2.0, "hidden": 1.0})], "image string, cv_metrics map<string,double>")
    assert [tuple(r) for r in G.shown(df).orderBy("place").collect()] == [("a", 1, "tenengrad", 2.0), ("a", 14, "dpi", 300.0)]
    assert len(G.SHOWN) == 16 and set(G.SHOWN) <= set(M.METRICS)


def test_queue_takes_turns(spark):
    """Against a plain loop: the random part, then each label's worst page in turn, none twice."""
    labels, seed, total = ["blur", "noise", "skew"], 7, 40
    rng = np.random.default_rng(2)
    pool = [(i, dict(zip(labels, map(float, rng.integers(0, 20, 3) / 20), strict=True)) if i % 17 else {}) for i in range(150)]
    df = spark.createDataFrame(pool, "image long, scores map<string,double>")
    keys = {r["image"]: (r["a"], r["b"]) for r in df.select("image", L.hashed_order(seed, F.col("image")).alias("a"), L.hashed_order(seed + 1, F.col("image")).alias("b")).collect()}
    chosen = sorted(keys, key=lambda i: (keys[i][0], i))[: total // 2]
    scores = dict(pool)
    orders = {x: sorted(keys, key=lambda i: (-scores[i].get(x, 0.0), keys[i][0], i)) for x in labels}
    while len(chosen) < total:
        for x in labels:
            if len(chosen) < total:
                chosen.append(next(i for i in orders[x] if i not in chosen))
    want = sorted(chosen, key=lambda i: (keys[i][1], i))
    got = [r["image"] for r in L.select_queue(df, labels, total, 0.5, seed).orderBy("pos").collect()]
    assert got == want
