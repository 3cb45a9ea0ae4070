"""Pages to measures, scores and reports. Pixels cross into Python once and go no further than the kernel."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.measures import METRICS, measure

VERSION = "cv-baseline"


def raw_metrics(pages: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """path, page, width, height and the 37 measures of every page that has pixels; one wide row from one kernel call."""
    keys = ["path", "page", "height", "width", "dpi", "original_width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                img = np.frombuffer(r["gray"], np.uint8).reshape(r["height"], r["width"])
                m = measure(img, settings, r["dpi"] or 0.0, r["original_width"] or 0)
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("path", "page", "height", "width")} | m], schema)

    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), *[(m, pa.float64()) for m in METRICS]])
    rows = pages.where(F.col("gray").isNotNull() & (F.col("height") > 0) & (F.col("width") > 0)).select(*keys, "gray")
    return rows.mapInArrow(run, "path string, page int, height int, width int, " + ", ".join(f"{m} double" for m in METRICS))


def scored(metrics: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """metrics with scores (map) and not_applicable."""
    skip = S.not_applicable(F.col("mid_tone_frac"), F.col("n_lines"), settings["cv"]["bitonal_max_mid_frac"])
    rows = metrics.withColumn("not_applicable", skip)
    return rows.withColumn("scores", S.score_map(S.score_columns(settings["scores"], F.col("not_applicable"))))


def reports(rows: DataFrame, settings: dict[str, Any], unreadable: Column | None = None) -> DataFrame:
    """image, verdict, quality_score, defects, cv_metrics, not_applicable and the whole report as JSON.

    unreadable: a score from recognised text, null where there is none.
    """
    v = settings["verdict"]
    name = F.element_at(F.split("path", "/"), -1)
    image = F.when(F.col("page") > 0, F.concat(name, F.lit("#"), (F.col("page") + 1).cast("string"))).otherwise(name)
    scores = F.col("scores")
    if unreadable is not None:
        scores = F.when(unreadable.isNotNull(), F.map_concat(scores, F.create_map(F.lit("unreadable"), unreadable))).otherwise(scores)
    missing = F.col("not_applicable") if unreadable is not None else F.array_sort(F.array_union("not_applicable", F.array(F.lit("unreadable"))))
    source = lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score"), F.when(e["label"] == "unreadable", "ocr").otherwise("cv").alias("source"), F.array().cast("array<int>").alias("top_patches"))
    body = rows.select(
        F.lit("1.0").alias("schema_version"), F.lit(VERSION if unreadable is None else f"{VERSION}+ocr").alias("pipeline_version"), image.alias("image"), "width", "height",
        S.verdict(scores, v["tau_low"], v["tau_high"], v["tau_unreadable"]).alias("verdict"), S.quality(scores).alias("quality_score"),
        F.transform(S.ranked_defects(scores, settings["labels"]), source).alias("defects"),
        F.create_map(*[x for m in METRICS for x in (F.lit(m), F.round(m, 4))]).alias("cv_metrics"), missing.alias("not_applicable"),
        F.lit(None).cast("string").alias("heatmap_path"), F.lit(None).cast("string").alias("explanation"),
    )
    return body.withColumn("json", F.to_json(F.struct(*[F.col(c) for c in body.columns]), {"ignoreNullFields": "false"}))


def prelabels(rows: DataFrame, settings: dict[str, Any], corpus: str) -> DataFrame:
    """Prelabel records of scored pages."""
    manual = [x for x in settings["labels"] if x not in settings["auto_labels"]]
    v = settings["verdict"]
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("image"), S.document_id(F.col("path"), settings["split"]["document_id"]).alias("document"), F.lit(corpus).alias("corpus"), "scores",
        S.suggested(F.col("scores"), manual, settings["labeling"]["suggest_threshold"]).alias("suggested"), "not_applicable",
        S.verdict(F.col("scores"), v["tau_low"], v["tau_high"], v["tau_unreadable"]).alias("verdict"), S.quality(F.col("scores")).alias("quality_score"), "width", "height",
    )


# The measures that a table of a page shows, in its order.
SHOWN = [
    "tenengrad_norm", "tenengrad", "laplacian_var", "noise_sigma", "ink_paper_gap", "rms_contrast", "line_height_px", "source_line_height_px", "skew_deg",
    "min_margin_frac", "glare_cluster_frac", "shadow_frac", "streak_energy", "mid_tone_frac", "dpi", "n_informative_patches",
]


def shown(rows: DataFrame, metrics: str = "cv_metrics") -> DataFrame:
    """image, place, metric, value: the measures of a report that a reader sees; what a report lacks is left out."""
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), F.try_element_at(F.col(metrics), F.lit(m)).alias("value")) for i, m in enumerate(SHOWN)])
    return rows.select("image", F.explode(pairs).alias("m")).select("image", "m.*").where("value is not null")
