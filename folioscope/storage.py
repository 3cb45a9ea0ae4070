"""Tables that a later step reads again: in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode only, a folder beside the warehouse."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir").rstrip("/"), "folioscope-scratch")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: computed once, and it survives the loss of any executor."""
    df.write.option("compression", "zstd").parquet(path := f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)
