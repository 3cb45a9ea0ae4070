"""Recipes of synthetic pages, and pages from recipes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.degrade import DEFECTS, compose, small_mask

SEED_STEP = 1_000_003


def plan(total: int, labels: list[str], synth: dict[str, Any]) -> list[dict[str, Any]]:
    """Which defects each page gets: labels that lag behind their share get likelier, no page is left clean.

    Sequential by nature (each page looks at the counts so far), so it runs on the
    driver; a recipe row is small and its number is a setting.
    """
    rng = np.random.default_rng(synth["seed"])
    count = dict.fromkeys(labels, 0)
    goal = synth["min_label_share"] * total
    out = []
    for i in range(total):
        left = total - i
        p = np.array([max(synth["base_probability"], min(0.9, (goal - count[x]) / left)) for x in labels])
        pick = [x for x, hit in zip(labels, rng.random(len(labels)) < p, strict=True) if hit] or [labels[int(rng.integers(len(labels)))]]
        if len(pick) > synth["max_defects_per_image"]:
            pick = [pick[k] for k in sorted(rng.choice(len(pick), synth["max_defects_per_image"], replace=False))]
        steps = [(x, round(float(rng.uniform(synth["severity"]["min"], synth["severity"]["max"])), 3)) for x in pick]
        for x in pick:
            count[x] += 1
        out.append({"index": i, "steps": steps, "seed": synth["seed"] * SEED_STEP + i})
    return out


def recipe(references: DataFrame, total: int, settings: dict[str, Any], order: list[str]) -> DataFrame:
    """image, reference, document, steps, labels, seed: references are used in turns in the given order.

    references is the bounded result of a ranking; its keys are numbered on the driver.
    """
    spark: SparkSession = references.sparkSession
    refs = references.select("image", "document", *order).orderBy(*order).collect()
    if not refs:
        raise ValueError("there is no clean page to start from")
    rows = []
    for p in plan(total, [x for x in settings["labels"] if x in DEFECTS], settings["synth"]):
        r = refs[p["index"] % len(refs)]
        rows.append((f"{settings['synth']['seed']}_{p['index']:06d}.jpg", str(r["image"]), str(r["document"]), p["steps"], {x: True for x, _ in p["steps"]}, p["seed"]))
    return spark.createDataFrame(rows, "image string, reference string, document string, steps array<struct<label:string,severity:double>>, labels map<string,boolean>, seed bigint")


def assert_no_leak(manifest: DataFrame, held: DataFrame) -> None:
    """No synthetic page may come from a held-out document."""
    if bad := manifest.select("document").intersect(held.select("document")).take(1):
        raise ValueError(f"a synthetic page comes from a held-out document: {bad[0][0]}")


def render(manifest: DataFrame, pages: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """image, height, width, gray, masks (label -> small mask): the same for any partitioning, as every row has its seed."""
    joined = manifest.join(pages.select(F.col("image").alias("reference"), "height", "width", "gray"), "reference")
    params, local = settings["synth"]["params"], frozenset(settings["local"])
    schema = pa.schema([("image", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("gray", pa.binary()), ("masks", pa.list_(pa.struct([("label", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("mask", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                img = np.frombuffer(r["gray"], np.uint8).reshape(r["height"], r["width"])
                out, masks = compose(img, [(s["label"], s["severity"]) for s in r["steps"]], params, r["seed"], local)
                small = {k: small_mask(m) for k, m in masks.items() if m is not None}
                yield pa.RecordBatch.from_pylist([{"image": r["image"], "height": out.shape[0], "width": out.shape[1], "gray": np.ascontiguousarray(out).tobytes(), "masks": [{"label": k, "height": m.shape[0], "width": m.shape[1], "mask": np.ascontiguousarray(m).tobytes()} for k, m in small.items()]}], schema)

    return joined.select("image", "steps", "seed", "height", "width", "gray").mapInArrow(run, "image string, height int, width int, gray binary, masks array<struct<label:string,height:int,width:int,mask:binary>>")
