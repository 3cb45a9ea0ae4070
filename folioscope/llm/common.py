"""Helpers shared by the operators of this folder: inputs, shared storage, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in local mode) one beside the warehouse."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.path.join(spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), "folioscope-scratch")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage by files in the shared folder, which survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that a later step reads."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: later steps read it, and it survives the loss of any executor."""
    df.write.option("compression", "zstd").parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table holds; null text is empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def binary_column(batch: pa.RecordBatch | pa.Table, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def text_buffer(column) -> tuple["np.ndarray", "np.ndarray"]:
    """The bytes of an Arrow string or binary column as one array, and the n+1 row bounds in it; null rows are empty."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    _, bounds, data = column.buffers()
    if n == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], most_bytes: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most most_bytes of text, or one row; memory then follows the longest text, not the batch."""
    import numpy as np

    for batch in batches:
        _, at = text_buffer(batch.column(column))
        start, n = 0, batch.num_rows
        while start < n:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most_bytes, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def release() -> None:
    """Gives memory that is free again back to the system: workers are reused, and what one stage leaves idle is missing in the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with its memory given back at the end of the partition."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return own


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn over slices of bounded size, in one pass and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield fn(part)

    return df.mapInArrow(tidy(run), schema)


def remainder(column: str, by: int) -> "F.Column":
    """crc32 of the column as text, modulo by: the fold of a row."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by).cast("long"))
