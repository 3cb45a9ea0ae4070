"""Kernels on generated pages: each defect moves its own measure; kernels equal the relational forms."""

import numpy as np
import pytest

from folioscope.config import DEFAULTS, LOCAL_LABELS
from folioscope.functions import degrade as D
from folioscope.functions import measures as M
from folioscope.functions import raster as R
from folioscope.operators import pages as G
from folioscope.operators import pixels as P
from folioscope.operators import synth as Y
from folioscope.sources import pages as I

CV = DEFAULTS["cv"]
PARAMS = DEFAULTS["synth"]["params"]


def text_page(w=600, h=800, line=24, gap=18, margin=60, paper=238, ink=45, seed=0):
    rng, p, y = np.random.default_rng(seed), np.full((h, w), paper, np.uint8), margin
    while y + line < h - margin:
        x = margin
        while x < w - margin - 110:
            n = int(rng.integers(30, 110))
            for g in range(x, x + n, 7):
                p[y : y + line, g : g + 4] = ink
            x += n + 14
        y += line + gap
    return p


@pytest.fixture(scope="module")
def page():
    return text_page()


def worse(page, name, severity=0.8, seed=3):
    return D.compose(page, [(name, severity)], PARAMS, seed, frozenset(LOCAL_LABELS))


def test_clean_page(page):
    m = M.measure(page, DEFAULTS)
    assert list(m) == M.METRICS and len(M.METRICS) == 37
    assert abs(m["line_height_px"] - 24) <= 3 and m["glare_cluster_frac"] == 0 and m["border_ink_frac"] == 0 and m["shadow_frac"] == 0 and m["n_patches"] == 54


@pytest.mark.parametrize("angle", [3, -5, 0])
def test_skew_is_the_correcting_angle(page, angle):
    assert M.skew(R.turned(page, angle, 238), CV) == pytest.approx(-angle, abs=0.6)


def test_noise_estimate(page):
    rng = np.random.default_rng(1)
    noisy = np.clip(page + rng.normal(0, 6, page.shape), 0, 255).astype(np.uint8)
    assert 4 <= M.noise_sigma(noisy) <= 8.5 and M.noise_sigma(page) < 1 and M.noise_sigma(page[:2, :2]) == 0
    assert M.immerkaer_sigma(noisy) > 0


def test_each_defect_shows(page):
    m = M.measure
    base = m(page, DEFAULTS)
    checks = {"blur": ("tenengrad_norm", -1), "noise": ("noise_sigma", 1), "low_contrast": ("ink_paper_gap", -1), "low_resolution": ("line_height_px", -1), "skew": ("skew_abs_deg", 1), "glare": ("glare_cluster_frac", 1), "shadow": ("shadow_frac", 1), "streaks": ("streak_energy", 1), "cropped": ("border_ink_frac", 1)}
    for name, (metric, sign) in checks.items():
        seed = 3 if name != "cropped" else next(i for i in range(20) if np.random.default_rng([i, *b"cropped"]).integers(0, 4) < 2)  # a cut across the lines
        image, masks = worse(page, name, 1.0, seed)
        assert sign * (m(image, DEFAULTS)[metric] - base[metric]) > 0, name
        assert (masks[name] is not None) == (name in LOCAL_LABELS)


def test_frames_and_bitonal(page):
    framed = page.copy()
    framed[:12], framed[-12:], framed[:, :12], framed[:, -12:] = 0, 0, 0, 0
    assert abs(M.measure(framed, DEFAULTS)["line_height_px"] - 24) <= 4
    bitonal = np.where(page > 128, 255, 0).astype(np.uint8)
    assert ((bitonal > 40) & (bitonal < 215)).mean() < 0.05


def test_compose_is_repeatable_and_order_free(page):
    steps = [("glare", 0.5), ("cropped", 0.5), ("skew", 0.4), ("noise", 0.6)]
    a, masks = D.compose(page, steps, PARAMS, 9, frozenset(LOCAL_LABELS))
    b, _ = D.compose(page, [steps[0], steps[2], steps[1], steps[3]], PARAMS, 9, frozenset(LOCAL_LABELS))
    assert (a == b).all() and masks["glare"].shape == a.shape == masks["cropped"].shape


def test_masks():
    m = np.zeros((1000, 800), np.uint8)
    m[500] = 255
    small = D.small_mask(m)
    assert max(small.shape) == 256 and small.max() == 255
    assert D.mask_share(np.full((10, 10), 255, np.uint8), (0, 0, 50, 50), 100, 100) == 1 and D.mask_share(m, (0, 0, 800, 1000), 1000, 800) == pytest.approx(0.001)


def test_components():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 1]], bool)
    labels, stats = R.components(mask)
    assert len(stats) == 3 and sorted(stats[:, 0].tolist()) == [2, 2, 4] and labels[0, 0] == labels[1, 1] != labels[0, 3]


def test_kernels_equal_relational_forms(spark):
    rng = np.random.default_rng(4)
    imgs = rng.integers(0, 256, (5, 8, 8)).astype(np.uint8)
    px = spark.createDataFrame([(p, y, x, int(imgs[p, y, x])) for p in range(5) for y in range(8) for x in range(8)], "page int, y int, x int, v int")
    sharp = {r["page"]: r for r in P.sharpness(px).collect()}
    noise = {r["page"]: r["noise_sigma"] for r in P.noise_sigma(px).collect()}
    gap = {r["page"]: r for r in P.otsu_gap(px).collect()}
    for p in range(5):
        assert sharp[p]["tenengrad"] == pytest.approx(M.tenengrad(imgs[p])) and sharp[p]["laplacian_var"] == pytest.approx(M.laplacian_variance(imgs[p]))
        assert noise[p] == pytest.approx(M.noise_sigma(imgs[p])) and gap[p]["threshold"] == M.otsu(imgs[p]) and gap[p]["gap"] == pytest.approx(M.ink_paper_gap(imgs[p]))


def test_png_and_dpi(page):
    data = I.encode_png(page, 200)
    assert (I.decode_png(data) == page).all() and I.read_dpi(data) == pytest.approx(200, abs=0.1) and I.read_dpi(I.encode_png(page, 72)) is None and I.read_dpi(b"junk") is None
    same, dpi = I.normalised(page, 200, 300, False)
    assert same is page and dpi == 200
    half, dpi = I.normalised(page, 600, 300, False)
    assert half.shape == (400, 300) and dpi == 300
    assert I.normalised(page, None, 300, False)[1] == 0.0
    for bad in (b"", b"\x89PNG\r\n\x1a\nxx", data[:200]):
        with pytest.raises(ValueError):
            I.decode_png(bad)


def test_file_to_report(spark, tmp_path, page):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "0000001.png").write_bytes(I.encode_png(page, 300))
    (tmp_path / "страница.png").write_bytes(I.encode_png(worse(page, "blur")[0], 300))
    (tmp_path / "bad.png").write_bytes(I.encode_png(page)[:300])
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "notes.txt").write_text("no page")
    pages = I.load_pages(I.scan(spark, str(tmp_path)))
    rows = {r["path"].rpartition("/")[2]: r for r in pages.drop("gray").collect()}
    assert len(rows) == 4 and rows["bad.png"]["error"] == "damaged PNG" and rows["x.pdf"]["error"] == "unsupported: pdf"
    scored = G.scored(G.raw_metrics(pages, DEFAULTS), DEFAULTS)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "gray" not in plan.split("MapInArrow")[0]
    out = {r["image"]: r for r in G.reports(scored, DEFAULTS).collect()}
    assert len(out) == 2 and out["0000001.png"]["verdict"] != "bad" and "heatmap_path" in out["0000001.png"]["json"]
    assert out["0000001.png"]["defects"] is not None and out["страница.png"]["quality_score"] <= out["0000001.png"]["quality_score"]
    pre = {r["image"]: r for r in G.prelabels(scored, DEFAULTS, "c").collect()}
    assert pre["0000001.png"]["document"] == "0000001"


def test_render_does_not_depend_on_partitions(spark, page):
    refs = spark.createDataFrame([("r1", "d1", 0.1, *page.shape, bytearray(page.tobytes()))], "image string, document string, suspicion double, height int, width int, gray binary")
    plan = Y.recipe(refs, 6, DEFAULTS, ["suspicion", "image"])
    one, four = ({r["image"]: (bytes(r["gray"]), len(r["masks"])) for r in Y.render(plan.repartition(n), refs, DEFAULTS).collect()} for n in (1, 4))
    assert one == four and len(one) == 6
    Y.assert_no_leak(plan, refs.where("false"))
    with pytest.raises(ValueError):
        Y.assert_no_leak(plan, refs)
