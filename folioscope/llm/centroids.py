"""Centroid clustering: plain Lloyd rounds on integer vectors.

Components become integers, so that sums are exact and the result is the same in
any order and partitioning. The centroids (k rows, a parameter) go to every task.
A task measures its vectors against one centroid after another, gives each to the
nearest, and adds up what each centroid got: one row for a centroid and component
leaves it, however many vectors it read, and these rows are summed by groupBy.

Defined results: a vector is kept if it has exactly `size` components, none null,
NaN or infinite; others aren't in the result. An integer is held within ±LARGEST
(components of ±2^21), so that a squared distance fits a long. Repeated rows are vectors
of their own, each in the result. A null vec_id is hashed as empty text. With
fewer than k kept vectors there are as many centroids as vectors; without any
the result is empty. Ties: equal hashes by the smaller vec_id, then the smaller
vector; equal distances by the smaller number. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written

#: 64 * (2 * 2^27)^2 < 2^63.
LARGEST = 1 << 27
#: Vectors measured at once.
BLOCK = 4096


def integers(column: pd.Series, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and floor(scale * component) of those, as rows."""
    right = np.array([x is not None and len(x) == size for x in column], bool)
    if not right.any():
        return right, np.zeros((0, size), np.int64)
    values = np.array([np.asarray(x, np.float64) for x in column[right]]).reshape(-1, size)  # null components are NaN here
    finite = np.isfinite(values).all(axis=1)
    right[np.flatnonzero(right)[~finite]] = False
    return right, np.clip(np.floor(scale * values[finite]), -LARGEST, LARGEST).astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid (the lowest if equal) and the squared distance."""
    found, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(vectors), BLOCK):
        part = vectors[at : at + BLOCK]
        distances = np.empty((len(part), len(centroids)), np.int64)
        for k, c in enumerate(centroids):
            off = part - c
            distances[:, k] = np.einsum("ij,ij->i", off, off)
        best = distances.argmin(axis=1)
        found.append(best)
        least.append(distances[np.arange(len(part)), best])
    return np.concatenate(found), np.concatenate(least)


def _plain(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _first(vectors: DataFrame, k: int, seed: int, size: int, scale: int) -> np.ndarray:
    """The k kept vectors with the smallest hashes. At most k rows reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            right, rows = integers(frame["embedding"], size, scale)
            yield pd.DataFrame({"vec_id": frame["vec_id"][right].array, "vector": pd.Series(list(rows), dtype=object)})
        release()

    kept = _plain(vectors).mapInPandas(run, "vec_id long, vector array<long>")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    top = kept.orderBy(digest, "vec_id", "vector").limit(k).collect()
    return np.array([r["vector"] for r in top], np.int64).reshape(-1, size)


def _sums(frames: Iterator[pd.DataFrame], centroids: np.ndarray, scale: int) -> Iterator[pd.DataFrame]:
    """cluster, component, total, members of what the task read."""
    k, size = centroids.shape
    totals, members = np.zeros((k, size), object), np.zeros(k, np.int64)
    for frame in frames:
        _, rows = integers(frame["embedding"], size, scale)
        where, _ = nearest(rows, centroids)
        block = np.zeros((k, size), np.int64)  # a batch's sums fit: at most 2^27 each
        np.add.at(block, where, rows)
        totals += block
        members += np.bincount(where, minlength=k)
    own = np.flatnonzero(members)
    if len(own):
        yield pd.DataFrame({"cluster": np.repeat(own, size), "component": np.tile(np.arange(size), len(own)), "total": [str(x) for x in totals[own].ravel()], "members": np.repeat(members[own], size)})
    release()


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, size: int = 64, scale: int = 64) -> np.ndarray:
    """The centroids after so many rounds, one a row; empty ones stay as they were."""
    centroids = _first(vectors, k, seed, size, scale)
    for _ in range(rounds if len(centroids) else 0):
        part = _plain(vectors).select("embedding").mapInPandas(partial(_sums, centroids=centroids, scale=scale), "cluster int, component int, total string, members long")
        merged = part.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members")).collect()  # k * size rows
        centroids = centroids.copy()
        for r in merged:
            centroids[r["cluster"], r["component"]] = int(r["total"]) // int(r["members"])
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance of every kept vector; one pass, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            right, rows = integers(frame["embedding"], centroids.shape[1], scale)
            where, least = nearest(rows, centroids)
            yield pd.DataFrame({"vec_id": frame["vec_id"][right].array, "cluster": where.astype(np.int32), "distance": least})
        release()

    kind = "vec_id long, cluster int, distance long"
    return _plain(vectors).mapInPandas(run, kind) if len(centroids) else vectors.sparkSession.createDataFrame([], kind)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, size: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    centroids = lloyd(vectors, k, rounds, seed, size, scale)
    rows = written(assign(vectors, centroids, scale), "clusters")
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect()}  # k rows
    facts = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    side = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    """The same in SQL: a table of (cluster, vector) for each round."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id, x) - 1)::INT AS cluster, x FROM v ORDER BY sha256('1:' || vec_id), vec_id, x LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT v.n, v.vec_id, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM v, c{r} c)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT n, vec_id, x, cluster, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, cluster) = 1)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT cluster, i, sum(x[i])::BIGINT AS s, count(*) AS m FROM a{r}, range(1, {size + 1}) t(i) GROUP BY 1, 2)")
            parts.append(f"m{r} AS (SELECT cluster, list((s - (s % m + m) % m) // m ORDER BY i) AS x FROM s{r} GROUP BY 1)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    a, c = f"a{rounds}", f"c{rounds}"
    return f"WITH {', '.join(parts)} SELECT vec_id, {a}.cluster, distance, (sum(distance) OVER (PARTITION BY {a}.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string({c}.x, ',')) AS centroid_sha256 FROM {a} JOIN {c} USING (cluster)"


ORACLE_SQL = _oracle()
