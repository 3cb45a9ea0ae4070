"""A growing label log as a stream: the latest record of each image. An extension, not parity.

The latest records are keyed state of the stream, which Spark checkpoints. Every
micro-batch writes the records that it changed, and nothing else, as a version of a
folder (table/v=<batch>); the latest record over all versions is current. So
the cost of a batch follows the batch, not the table. `compact` folds versions
into one when readers should have less to read.

Defined results: the record with the largest order wins, however late it comes; of
equal orders the one whose text as JSON is larger; repeated lines change nothing.
A null key is a key of its own, a null order is smaller than any other. An empty
log gives no version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The record of each key that wins; the same on a stream (update mode) and on a table."""
    record = F.struct(*[F.col(c) for c in log.columns if c != key])
    rank = F.struct(F.col(order), F.to_json(record, {"ignoreNullFields": "false"}))
    return log.groupBy(key).agg(F.max_by(record, rank).alias("r")).select(key, "r.*")


def upsert_stream(log: DataFrame, key: str, order: str, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest record of each key of log, writing what each micro-batch changes.

    A batch that is run again after a failure writes the same version again, so the
    result is exactly-once. For more keys than executors can hold, set
    spark.sql.streaming.stateStore.providerClass to the RocksDB store.
    """

    def put(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/v={version}")

    return latest(log, key, order).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, table: str) -> dict[str, list[int]]:
    """Complete versions: of batches (v), and of compacted ones (c), which hold all batches up to their number."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"v": [], "c": []}
    for s in fs.listStatus(path) if fs.exists(path) else []:
        kind, _, number = s.getPath().getName().partition("=")
        if kind in out and number.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            out[kind].append(int(number))
    return out


def current(spark: SparkSession, table: str, key: str, order: str) -> DataFrame | None:
    """The latest record of each key over the newest compacted version and the batches after it; None if there is none."""
    found = _versions(spark, table)
    base = max(found["c"], default=-1)
    paths = [f"{table}/c={base}"] * (base >= 0) + [f"{table}/v={v}" for v in sorted(found["v"]) if v > base]
    return latest(spark.read.parquet(*paths), key, order) if paths else None


def compact(spark: SparkSession, table: str, key: str, order: str) -> None:
    """Folds all versions into one. Readers that began before keep theirs, as no file is removed; run again, it does nothing."""
    found = _versions(spark, table)
    if found["v"] and max(found["v"]) not in found["c"]:
        current(spark, table, key, order).write.mode("overwrite").parquet(f"{table}/c={max(found['v'])}")
