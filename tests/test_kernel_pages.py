"""The enlarged pages of q_kernel_metrics: their pixels, and that making them costs less than measuring them."""

import time

import numpy as np
from pyspark.sql import functions as F

from folioscope.plans import catalogue


class _Made(Exception):
    pass


def test_enlarged_pages(spark, tmp_path, monkeypatch):
    rng, n = np.random.default_rng(0), 3000
    vectors = rng.normal(0, 0.3, (n, 64)).astype(np.float32)
    vectors[0, :3] = (9, -9, 0)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(n, None)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = []

    def take(pages, settings):
        made.append(pages)
        raise _Made

    monkeypatch.setattr(catalogue.G, "raw_metrics", take)
    try:
        catalogue.q_kernel_metrics(spark, str(tmp_path))
    except _Made:
        pass
    pages = made[0].where(F.col("gray").isNotNull())
    pages.limit(1).count()
    began = time.perf_counter()
    assert pages.agg(F.sum(F.length("gray"))).first()[0] == n * 96 * 96
    assert time.perf_counter() - began < 15  # about 1 s; a minute where each pixel went through an expression
    for r in pages.where("path in ('0', '1', '2999')").collect():
        want = np.clip(np.floor(vectors[int(r["path"])].astype(float) * 255 + 128), 0, 255).astype(np.uint8)
        assert np.array_equal(np.frombuffer(r["gray"], np.uint8).reshape(96, 96), np.kron(want.reshape(8, 8), np.ones((12, 12), np.uint8)))
