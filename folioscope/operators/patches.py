"""Training patches as rows: where to look on a page, what the patch shows, which labels hold there."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import raster as R
from ..functions.degrade import mask_share

# Mean and deviation of grey natural images, as pretrained networks expect.
MEAN, DEVIATION = 0.449, 0.226

SCHEMA = "image string, step int, x0 int, y0 int, x1 int, y1 int, ink double, side int, pixels array<float>, target array<float>"


def stream(image: str, step: int, seed: int) -> np.random.Generator:
    """The random stream of one patch: the same in any order and partitioning."""
    return np.random.default_rng([seed, zlib.crc32(image.encode()), step])


def choose(img: np.ndarray, size: int, least: float, tries: int, rng: np.random.Generator) -> tuple[tuple[int, int, int, int], float]:
    """The first of some random windows with enough ink, or the one with most; with its share of ink."""
    h, w = img.shape
    side = min(size, h, w)
    corners = rng.integers(0, [w - side + 1, h - side + 1], size=(max(1, tries), 2)).tolist()
    best: tuple[tuple[int, int, int, int], float] | None = None
    for x, y in corners:
        share = float(M.ink(img[y : y + side, x : x + side]).mean())
        if best is None or share > best[1]:
            best = (x, y, x + side, y + side), share
        if share >= least:
            break
    return best


def varied(patch: np.ndarray, brightness: float, contrast: float, rng: np.random.Generator) -> np.ndarray:
    """Brightness and contrast alone: turning or mirroring would forge the labels of geometry."""
    shift, gain = rng.uniform(-brightness, brightness) * 255, 1 + rng.uniform(-contrast, contrast)
    middle = patch.mean()
    return np.clip((patch - middle) * gain + middle + shift, 0, 255)


def normalised(patch: np.ndarray) -> np.ndarray:
    return ((patch / 255 - MEAN) / DEVIATION).astype(np.float32)


def targets(given: dict[str, bool], masks: dict[str, np.ndarray], labels: list[str], local: frozenset[str], box: tuple[int, int, int, int], shape: tuple[int, int], least: float) -> list[float]:
    """1 where a label holds in the window: a local label with a mask only where the mask covers enough of it."""
    holds = lambda x: bool(given.get(x)) and not (x in local and x in masks and mask_share(masks[x], box, *shape) < least)
    return [float(holds(x)) for x in labels]


def patches(pages: DataFrame, settings: dict[str, Any], train: bool = True, seed: int = 0) -> DataFrame:
    """Rows of SCHEMA, one a patch, from pages (image, height, width, gray, labels, masks as operators.synth.render has them).

    A page is decoded once for all its patches. pixels is the normalised patch, row by
    row; `channels` repeats it for a network
    with three inputs. Training takes several varied patches a page, validation
    one that never changes. Pages without pixels have no patch; no labels, no
    masks and a mask of no pixels are all right.
    """
    data, labels, local, size = settings["dataset"], settings["labels"], frozenset(settings["local"]), settings["patch_size"]
    steps = data["patches_per_page"] if train else 1
    schema = pa.schema([("image", pa.string()), ("step", pa.int32()), *[(c, pa.int32()) for c in ("x0", "y0", "x1", "y1")], ("ink", pa.float64()), ("side", pa.int32()), ("pixels", pa.list_(pa.float32())), ("target", pa.list_(pa.float32()))])

    def of_page(r: dict[str, Any]) -> Iterator[dict[str, Any]]:
        img = np.frombuffer(r["gray"], np.uint8).reshape(r["height"], r["width"])
        masks = {m["label"]: np.frombuffer(m["mask"], np.uint8).reshape(m["height"], m["width"]) for m in r["masks"] or [] if m["mask"]}
        for step in range(steps):
            rng = stream(r["image"] or "", step, seed)
            box, ink = choose(img, size, data["min_ink_frac"], data["max_patch_attempts"], rng)
            x0, y0, x1, y1 = box
            part = img[y0:y1, x0:x1]
            part = (part if len(part) == size else np.clip(np.rint(R.resize(part, size, size)), 0, 255)).astype(np.float64)
            part = varied(part, data["brightness"], data["contrast"], rng) if train else part
            target = targets(dict(r["labels"] or []), masks, labels, local, box, img.shape, data["min_mask_overlap"])
            yield dict(zip(schema.names, (r["image"], step, x0, y0, x1, y1, ink, size, normalised(part).ravel(), target), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a page at a time: a batch of pages as Python objects would be large
                for r in batch.slice(i, 1).to_pylist():
                    yield pa.RecordBatch.from_pylist(list(of_page(r)), schema)

    rows = pages.where(F.col("gray").isNotNull() & (F.col("height") > 0) & (F.col("width") > 0))
    return rows.select("image", "height", "width", "gray", "labels", "masks").mapInArrow(run, SCHEMA)


def channels(pixels: list[float] | np.ndarray, side: int, n: int = 3) -> np.ndarray:
    """A patch as n equal planes, without copying it."""
    return np.broadcast_to(np.asarray(pixels, np.float32).reshape(side, side), (n, side, side))
