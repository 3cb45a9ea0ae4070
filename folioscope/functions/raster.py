"""Grey-image primitives in numpy: windows, filters, components, resampling."""

from __future__ import annotations

import numpy as np


def conv3(img: np.ndarray, kernel: list[list[int]], border: str = "reflect") -> np.ndarray:
    """A 3x3 correlation; reflect mirrors without repeating the edge, symmetric repeats it. Of bytes it is exact, in 16 bits."""
    if min(img.shape) < 2 and border == "reflect":
        border = "edge"
    kind = np.int16 if img.dtype == np.uint8 and 255 * np.abs(kernel).sum() < 1 << 15 else np.float64
    p = np.pad(img.astype(kind), 1, mode=border)
    h, w = img.shape
    out = np.zeros((h, w), kind)
    for i, line in enumerate(kernel):
        for j, k in enumerate(line):
            if k:
                part = p[i : i + h, j : j + w]
                out += part if k == 1 else k * part
    return out


def box_sum(img: np.ndarray, size: int, border: str = "symmetric") -> np.ndarray:
    """Sums over a size x size window, by running sums along one side and then the other; of integers they are exact."""
    r = size // 2
    small = img.dtype.kind == "u" and img.dtype.itemsize <= 2 and size * size * int(np.iinfo(img.dtype).max) < 1 << 32
    kind = np.float64 if img.dtype.kind == "f" else np.uint32 if small else np.int64
    p = np.pad(img, r, mode=border if min(img.shape) > r + 1 else "edge")
    s = np.zeros((p.shape[0] + 1, p.shape[1]), kind)
    np.cumsum(p, axis=0, dtype=kind, out=s[1:])
    rows = s[size:] - s[:-size]
    s = np.zeros((rows.shape[0], p.shape[1] + 1), kind)
    np.cumsum(rows, axis=1, dtype=kind, out=s[:, 1:])  # 32 bits may wrap, but their differences don't: a window's sum is below 2^32
    return s[:, size:] - s[:, :-size]


def box_mean(img: np.ndarray, size: int, border: str = "symmetric") -> np.ndarray:
    """Mean over a size x size window."""
    return box_sum(img, size, border) / (size * size)


def percentiles(img: np.ndarray, q: list[float]) -> list[float]:
    """Percentiles of bytes from their counts, between two values in proportion."""
    n = np.bincount(img.ravel(), minlength=256).cumsum()
    place = [(n[-1] - 1) * x / 100 for x in q]
    low, high = (np.searchsorted(n, [int(end(p)) for p in place], side="right") for end in (np.floor, np.ceil))
    return [float(a + (b - a) * (p - np.floor(p))) for a, b, p in zip(low, high, place, strict=True)]


def box_mean_1d(v: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    p = np.pad(v.astype(np.float64), r, mode="reflect" if len(v) > r else "edge")
    s = np.concatenate([[0.0], np.cumsum(p)])
    return (s[size:] - s[:-size])[: len(v)] / size


def median3(img: np.ndarray) -> np.ndarray:
    """The median of nine is that of the highest low, the middle middle and the lowest high of the columns of three."""
    p = np.pad(img, 1, mode="edge")
    low, mid, high = _sorted3(p[:-2], p[1:-1], p[2:])
    a = np.maximum(np.maximum(low[:, :-2], low[:, 1:-1]), low[:, 2:])
    b = _sorted3(mid[:, :-2], mid[:, 1:-1], mid[:, 2:])[1]
    c = np.minimum(np.minimum(high[:, :-2], high[:, 1:-1]), high[:, 2:])
    return _sorted3(a, b, c)[1]


def _sorted3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return np.minimum(low, c), np.maximum(low, np.minimum(high, c)), np.maximum(high, c)


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-connected components of a mask: labels (0 is background) and rows (area, width, height) for labels 1, 2, ...

    Runs of each row are joined with touching runs of the row before.
    """
    h, w = mask.shape
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, xs = np.nonzero(step == 1)
    _, xe = np.nonzero(step == -1)
    n = len(ys)
    labels = np.zeros((h, w), np.int32)
    if not n:
        return labels, np.zeros((0, 3), np.int64)
    # Runs of the row above that a run touches follow each other, as runs are in reading order.
    wide = w + 2
    first = np.searchsorted(ys * wide + xe, (ys - 1) * wide + xs, "left")
    count = np.maximum(np.searchsorted(ys * wide + xs, (ys - 1) * wide + xe, "right") - first, 0)
    below = np.repeat(np.arange(n), count)
    above = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(below))
    label = np.arange(n)
    while True:
        a, b = label[above], label[below]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up := label[label]).sum() != label.sum():
            label = up
    roots, label = np.unique(label, return_inverse=True)
    k = len(roots)
    area = np.bincount(label, xe - xs, k).astype(np.int64)
    lo_x, hi_x, lo_y, hi_y = np.full(k, w), np.zeros(k, np.int64), np.full(k, h), np.zeros(k, np.int64)
    np.minimum.at(lo_x, label, xs)
    np.maximum.at(hi_x, label, xe)
    np.minimum.at(lo_y, label, ys)
    np.maximum.at(hi_y, label, ys + 1)
    mark = np.zeros((h, w + 1), np.int32)
    np.add.at(mark, (ys, xs), label + 1)
    np.add.at(mark, (ys, xe), -(label + 1))
    labels = mark.cumsum(axis=1)[:, :w]
    return labels, np.stack([area, hi_x - lo_x, hi_y - lo_y], axis=1)


def _extreme(img: np.ndarray, shape: np.ndarray, low: bool) -> np.ndarray:
    """Least or largest value under a structuring element; outside the image counts for neither."""
    ry, rx = shape.shape[0] // 2, shape.shape[1] // 2
    fill = 255 if low else 0
    p = np.pad(img, ((ry, ry), (rx, rx)), constant_values=fill)
    h, w = img.shape
    pick = np.minimum if low else np.maximum
    out = np.full((h, w), fill, img.dtype)
    for i in range(shape.shape[0]):
        on = np.flatnonzero(shape[i])
        if len(on):  # a row of the element is one run: doubling covers it in log steps
            run, width = p[i : i + h], 1
            need = on[-1] - on[0] + 1
            while 2 * width <= need:
                run = pick(run[:, : run.shape[1] - width], run[:, width:])
                width *= 2
            a, b = on[0], on[-1] - width + 1
            out = pick(out, pick(run[:, a : a + w], run[:, b : b + w]))
    return out


def opened(img: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return _extreme(_extreme(img, shape, True), shape, False)


def closed(img: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return _extreme(_extreme(img, shape, False), shape, True)


def ellipse(size: int) -> np.ndarray:
    r = size // 2
    y = np.arange(-r, r + 1)[:, None]
    half = np.round(r * np.sqrt(np.maximum(0.0, 1 - (y / max(r, 1)) ** 2)))
    return np.abs(np.arange(-r, r + 1)[None, :]) <= half


def gaussian(img: np.ndarray, size: int) -> np.ndarray:
    """A Gaussian whose deviation follows from the window's size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    r = size // 2
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = img.astype(np.float64)
    for axis in (0, 1):
        mode = "reflect" if out.shape[axis] > r else "edge"
        p = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode=mode)
        n = out.shape[axis]
        out = sum(k[i] * (p[i : i + n] if axis == 0 else p[:, i : i + n]) for i in range(size))
    return out


def _weights(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.linspace(0, old, new + 1)
    return edges[:-1], edges[1:]


def shrink(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-weighted means, by interpolating the summed-area table at fractional edges."""
    def along(v: np.ndarray, n: int) -> np.ndarray:
        s = np.zeros((len(v) + 1, v.shape[1]), np.uint32 if v.dtype == np.uint8 else np.float64)
        np.cumsum(v, axis=0, dtype=s.dtype, out=s[1:])
        lo, hi = _weights(len(v), n)

        def at(x: np.ndarray) -> np.ndarray:
            i = np.minimum(x.astype(int), len(v) - 1)
            return s[i] + (x - i)[:, None] * v[i]

        return (at(hi) - at(lo)) / (hi - lo)[:, None]

    return np.clip(np.rint(along(along(img if img.dtype == np.uint8 and img.shape[0] < 1 << 24 else img.astype(np.float64), height).T, width).T), 0, 255).astype(np.uint8)


def bilinear(img: np.ndarray, y: np.ndarray, x: np.ndarray, border: float | None = None) -> np.ndarray:
    """Values at fractional places; outside, border, or the nearest edge without one."""
    h, w = img.shape
    if border is None:
        y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    p = np.pad(img.astype(np.float64), 1, mode="edge") if border is None else np.pad(img.astype(np.float64), 1, constant_values=border)
    y, x = np.clip(y + 1, 0, h + 1), np.clip(x + 1, 0, w + 1)
    i, j = np.minimum(y.astype(int), h), np.minimum(x.astype(int), w)
    fy, fx = y - i, x - j
    return (p[i, j] * (1 - fx) + p[i, j + 1] * fx) * (1 - fy) + (p[i + 1, j] * (1 - fx) + p[i + 1, j + 1] * fx) * fy


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, one side after the other."""
    out = img.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        old = out.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1)
        low = np.minimum(at.astype(int), max(0, old - 2))
        part = (at - low)[:, None] if axis == 0 else (at - low)[None, :]
        a = np.take(out, low, axis)
        out = a + (np.take(out, np.minimum(low + 1, old - 1), axis) - a) * part
    return out


def nearest(img: np.ndarray, height: int, width: int) -> np.ndarray:
    return img[np.arange(height)[:, None] * img.shape[0] // height, np.arange(width)[None, :] * img.shape[1] // width]


def turned(img: np.ndarray, degrees: float, border: float) -> np.ndarray:
    """The page turned counter-clockwise about its centre."""
    h, w = img.shape
    t = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    y, x = y - h / 2, x - w / 2
    return np.clip(np.rint(bilinear(img, np.sin(t) * x + np.cos(t) * y + h / 2, np.cos(t) * x - np.sin(t) * y + w / 2, border)), 0, 255).astype(np.uint8)
