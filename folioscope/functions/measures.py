"""Raw measures of one grey page: 37 numbers in one pass over shared intermediate images."""

from __future__ import annotations

from typing import Any

import numpy as np

from . import raster as R

# The names of the measures, in the order in which rows hold them.
METRICS = (
    "tenengrad tenengrad_norm laplacian_var noise_sigma high_freq_energy rms_contrast dynamic_range ink_paper_gap mid_tone_frac glare_bright_frac "
    "glare_cluster_frac glare_clusters shadow_frac illumination_range skew_deg skew_abs_deg margin_left margin_right margin_top margin_bottom "
    "min_margin_frac border_ink_frac border_ink_left border_ink_right border_ink_top border_ink_bottom has_scan_frame line_height_px "
    "source_line_height_px n_lines text_density streak_energy streak_column_energy streak_row_energy dpi n_patches n_informative_patches"
).split()
MAD = 1.4826
LAPLACE = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
SOBEL = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SECOND = [[1, -2, 1], [-2, 4, -2], [1, -2, 1]]


def odd_part(side: int, share: float) -> int:
    """A share of a side as an odd window of 3 at least."""
    return max(3, int(side * share) | 1)


def noise_sigma(img: np.ndarray) -> float:
    if min(img.shape) < 3:
        return 0.0
    off = np.abs(R.conv3(img, SECOND)[1:-1, 1:-1])
    if off.dtype != np.int16:
        return float(np.median(off)) * MAD / 6
    n = np.bincount(off.ravel()).cumsum()  # at most 16 * 255 values
    middle = np.searchsorted(n, [(off.size - 1) // 2, off.size // 2], side="right")
    return float(middle.mean()) * MAD / 6


def immerkaer_sigma(img: np.ndarray) -> float:
    h, w = img.shape
    if min(h, w) < 3:
        return 0.0
    return float(np.abs(R.conv3(img, SECOND)[1:-1, 1:-1]).sum(dtype=np.float64) * np.sqrt(np.pi / 2) / (6 * (w - 2) * (h - 2)))


def ink(img: np.ndarray, block_frac: float = 0.03, offset: int = 10, sigma: float | None = None) -> np.ndarray:
    """Pixels darker than their surroundings by an offset that grows with noise, which is measured unless it is given."""
    if img.size == 0:
        return np.zeros(img.shape, bool)
    sigma = noise_sigma(img) if sigma is None else sigma
    src = R.median3(img) if sigma > 2 else img
    least = int(min(60, max(offset, round(3 * sigma))))
    return src + float(least) <= np.rint(R.box_mean(src, odd_part(min(img.shape), block_frac), "edge"))


def patches(width: int, height: int, size: int, rows: int, cols: int) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) of an even grid that reaches every corner, row by row."""
    if min(width, height, size, rows, cols) <= 0:
        raise ValueError("a grid needs positive sizes")
    side = min(size, width, height)
    starts = lambda total, n: [0] if total <= side or n <= 1 else [round(i * (total - side) / (n - 1)) for i in range(n)]
    return [(x, y, x + side, y + side) for y in starts(height, rows) for x in starts(width, cols)]


def informative(img: np.ndarray, boxes: list[tuple[int, int, int, int]], least: float, sigmas: list[float] | None = None) -> list[tuple[int, int, int, int]]:
    """Boxes with enough ink, or all if none has; sigmas is the noise of each box where it is known."""
    known = sigmas or [None] * len(boxes)
    return [b for b, s in zip(boxes, known, strict=True) if ink(img[b[1] : b[3], b[0] : b[2]], sigma=s).mean() >= least] or boxes


def tenengrad(img: np.ndarray) -> float:
    x, y = (R.conv3(img, k).astype(np.int32 if img.dtype == np.uint8 else np.float64) for k in (SOBEL, np.transpose(SOBEL).tolist()))
    return float((x * x + y * y).mean())


def laplacian_variance(img: np.ndarray) -> float:
    return float(R.conv3(img, LAPLACE).var())


def high_frequency(img: np.ndarray) -> float:
    s = np.abs(np.fft.rfft2(img.astype(np.float64) - img.mean()))
    total = s.sum()
    return float(s[:, s.shape[1] // 2 :].sum() / total) if total else 0.0


def otsu(img: np.ndarray) -> int:
    n = np.bincount(img.ravel(), minlength=256).astype(float)
    w = n.cumsum()
    s = (n * np.arange(256)).cumsum()
    rest = w[-1] - w
    ok = (w > 0) & (rest > 0)
    between = np.where(ok, w * rest * (s / np.maximum(w, 1) - (s[-1] - s) / np.maximum(rest, 1)) ** 2, -1)
    return int(between.argmax())


def ink_paper_gap(img: np.ndarray) -> float:
    t = otsu(img)
    light, dark = img[img > t], img[img <= t]
    return float(np.median(light) - np.median(dark)) if light.size and dark.size else 0.0


def frame_mask(mask: np.ndarray, span: float = 0.8) -> np.ndarray:
    """Components that reach across most of the page: scanner frames, not text."""
    labels, stats = R.components(mask)
    if not len(stats):
        return np.zeros(mask.shape, bool)
    wide = (stats[:, 1] >= span * mask.shape[1]) | (stats[:, 2] >= span * mask.shape[0])
    return np.concatenate([[False], wide])[labels]


def local_std(img: np.ndarray, window: int) -> np.ndarray:
    """Deviation in a window, from exact sums of values and squares."""
    n = window * window
    mean = R.box_sum(img, window) / n
    spread = R.box_sum(img.astype(np.uint16) ** 2, window) / n
    spread -= mean * mean
    return np.sqrt(np.maximum(spread, 0, out=spread), out=spread)


def glare(img: np.ndarray, cv: dict[str, Any]) -> tuple[float, float, int]:
    """Share of bright pixels, share of bright flat clusters, their number. Flatness is measured around bright pixels only."""
    bright = float((img >= cv["glare_threshold"]).mean())
    mask = img >= max(cv["glare_threshold"], R.percentiles(img, [50])[0] + cv["glare_min_excess"])
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows):
        return bright, 0.0, 0
    window = odd_part(min(img.shape), cv["glare_flat_window_frac"])
    h, w = img.shape
    y0, y1, x0, x1 = max(0, rows[0] - window), min(h, rows[-1] + 1 + window), max(0, cols[0] - window), min(w, cols[-1] + 1 + window)
    if min(y1 - y0, x1 - x0) <= window // 2 + 1:  # too small a part to mirror like the page
        y0, y1, x0, x1 = 0, h, 0, w
    part = mask[y0:y1, x0:x1] & (local_std(img[y0:y1, x0:x1], window) < cv["glare_flat_std"])
    area = R.components(part)[1][:, 0]
    area = area[area >= cv["glare_min_cluster_frac"] * img.size]
    return bright, float(area.sum() / img.size), len(area)


def background(img: np.ndarray, share: float) -> np.ndarray:
    """The paper without what is written on it, at the page's size."""
    f = min(1.0, 256 / max(img.shape))
    small = R.shrink(img, max(1, round(img.shape[0] * f)), max(1, round(img.shape[1] * f))) if f < 1 else img
    k = odd_part(min(small.shape), share)
    return R.resize(np.rint(R.gaussian(R.closed(small, R.ellipse(k)), k)), *img.shape)


def shadow(img: np.ndarray, cv: dict[str, Any]) -> tuple[float, float, float]:
    """Share of dark background, range of light, darkest against the median."""
    bg = background(img, cv["shadow_background_frac"])
    m = float(np.median(bg))
    if m <= 0:
        return 1.0, 0.0, 0.0
    lo, hi = np.percentile(bg, [5, 95])
    return float((bg < cv["shadow_rel_threshold"] * m).mean()), float((hi - lo) / m), float(bg.min() / m)


def streaks(img: np.ndarray, axis: int, share: float) -> float:
    p = np.percentile(img, 75, axis=axis)
    level = float(np.median(p))
    if p.size < 5 or level <= 0:
        return 0.0
    rest = np.abs(p - R.box_mean_1d(p, odd_part(p.size, share)))
    over = np.maximum(rest - 3 * MAD * np.median(rest), 0)
    return float(np.sqrt((over**2).mean()) / level)


def skew(img: np.ndarray, cv: dict[str, Any]) -> float:
    """The angle by which the page must be turned for its lines to lie level.

    Ink points are projected for each angle; no image is turned.
    """
    f = min(1.0, cv["skew_work_height"] / img.shape[0])
    small = R.shrink(img, max(1, round(img.shape[0] * f)), max(1, round(img.shape[1] * f))) if f < 1 else img
    y, x = np.nonzero(ink(small, cv["ink_block_frac"], cv["ink_offset"]))
    if not len(y):
        return 0.0
    h, w = small.shape
    y, x = y - h / 2, x - w / 2

    def sharp(degrees: float) -> float:
        t = np.deg2rad(degrees)
        at = np.cos(t) * y - np.sin(t) * x + h / 2
        low = np.floor(at).astype(int)
        part = at - low
        inside = (low >= 0) & (low < h - 1)
        profile = np.bincount(low[inside], 1 - part[inside], h) + np.bincount(low[inside] + 1, part[inside], h)
        return float((np.diff(profile) ** 2).sum())

    coarse, fine, most = cv["skew_coarse_step"], cv["skew_fine_step"], cv["skew_max_angle"]
    best = max(np.arange(-most, most + coarse / 2, coarse), key=sharp)
    return round(float(max(np.arange(best - coarse, best + coarse + fine / 2, fine), key=sharp)), 2) + 0.0


def text_box(mask: np.ndarray, least: float = 0.005) -> tuple[int, int, int, int]:
    rows, cols = np.flatnonzero(mask.mean(1) >= least), np.flatnonzero(mask.mean(0) >= least)
    if not len(rows) or not len(cols):
        return 0, 0, mask.shape[1], mask.shape[0]
    return int(cols[0]), int(rows[0]), int(cols[-1]) + 1, int(rows[-1]) + 1


def border_ink(mask: np.ndarray, cv: dict[str, Any]) -> tuple[dict[str, float], bool]:
    band = max(1, int(min(mask.shape) * cv["crop_band_frac"]))
    frame = frame_mask(mask, cv["crop_frame_span_frac"])
    text = mask & ~frame
    sides = {"left": text[:, :band].any(1), "right": text[:, -band:].any(1), "top": text[:band].any(0), "bottom": text[-band:].any(0)}
    return {k: float(v.mean()) for k, v in sides.items()}, bool(frame.any())


def text_scale(mask: np.ndarray, cv: dict[str, Any]) -> tuple[float, int, float]:
    """Median line height, number of lines, share of ink."""
    h = mask.shape[0]
    profile = (mask & ~frame_mask(mask, cv["crop_frame_span_frac"])).mean(1)
    smooth = max(1, int(h * cv["line_profile_smooth_frac"]))
    if smooth > 1:
        profile = np.convolve(profile, np.ones(smooth) / smooth, mode="same")
    step = np.diff(np.pad((profile >= cv["line_min_row_ink_frac"]).astype(np.int8), 1))
    height = np.flatnonzero(step == -1) - np.flatnonzero(step == 1)
    height = height[(height >= 2) & (height <= cv["line_max_height_frac"] * h)]
    return (float(np.median(height)) if len(height) else 0.0), len(height), float(mask.mean())


def measure(img: np.ndarray, settings: dict[str, Any], dpi: float = 0.0, original_width: int = 0) -> dict[str, float]:
    """All measures of a page. Sharpness and noise come from patches with text, before any turning."""
    cv, grid = settings["cv"], settings["grid"]
    h, w = img.shape
    boxes = patches(w, h, settings["patch_size"], grid["rows"], grid["cols"])
    sigmas = {b: noise_sigma(img[b[1] : b[3], b[0] : b[2]]) for b in boxes}
    good = informative(img, boxes, cv["min_ink_frac"], [sigmas[b] for b in boxes])
    crops = [img[b[1] : b[3], b[0] : b[2]] for b in good]
    mean = lambda f: float(np.mean([f(c) for c in crops]))
    angle = skew(img, cv)
    page = ink(img, cv["ink_block_frac"], cv["ink_offset"])
    clean = R.opened(page.astype(np.uint8), np.ones((odd_part(min(h, w), cv["ink_denoise_frac"]),) * 2, bool)) > 0
    level = page if abs(angle) < cv["skew_coarse_step"] else ink(R.turned(img, angle, int(R.percentiles(img, [90])[0])), cv["ink_block_frac"], cv["ink_offset"])
    line, n_lines, density = text_scale(level, cv)
    x0, y0, x1, y1 = text_box(clean)
    edge, framed = border_ink(clean, cv)
    bright, clusters, n_clusters = glare(img, cv)
    dark, light_range, _ = shadow(img, cv)
    columns, rows = streaks(img, 0, cv["streak_smooth_frac"]), streaks(img, 1, cv["streak_smooth_frac"])
    sharp, gap = mean(tenengrad), ink_paper_gap(img)
    margin = (x0 / w, (w - x1) / w, y0 / h, (h - y1) / h)
    low, high = R.percentiles(img, [1, 99])
    scale = original_width / w if original_width > 0 and w > 0 else 1.0
    values = (
        sharp, sharp / max(gap, 1.0) ** 2, mean(laplacian_variance), float(np.mean([sigmas[b] for b in good])), high_frequency(crops[0]), float(img.std()), float(high - low), gap,
        float(((img > cv["bitonal_mid_low"]) & (img < cv["bitonal_mid_high"])).mean()), bright, clusters, n_clusters, dark, light_range, angle, abs(angle), *margin, min(margin),
        max(edge.values()), edge["left"], edge["right"], edge["top"], edge["bottom"], framed, line, line * scale, n_lines, density, max(columns, rows), columns, rows, dpi, len(boxes), len(good),
    )
    return dict(zip(METRICS, map(float, values), strict=True))
