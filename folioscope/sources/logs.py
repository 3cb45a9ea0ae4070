"""Append-only JSON-line logs as tables: labels, prelabels, manifests, splits, queues."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import SPLIT_PARTS
from ..operators.labels import last_wins

#: The file that says how much the shards of a split hold.
COUNTS = "counts.json"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, ord: lines with their order (file, then block, then place in the task)."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return rows.where(F.trim("value") != "").select("value", F.struct("file", "block", "place").alias("ord"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any store that Spark reads; a pattern is taken to match."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return any(c in path for c in "*?[{") or at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """Label records as read_labels gives them; none where no log has been begun."""
    return read_labels(spark, path) if exists(spark, path) else spark.createDataFrame([], schemas.LABEL)


def read_labels(spark: SparkSession, path: str, dedupe: bool = True) -> DataFrame:
    """Label records; bad lines are left out. With dedupe the last record of an image wins, at its first position."""
    rows = schemas.parse_strict(read_lines(spark, path), schemas.LABEL, ["image", "document", "labels"], F.coalesce(F.col("r.duration_s") >= 0, F.lit(True)))
    good = rows.where("ok").select("r.*", "ord")
    return last_wins(good, "image", ["ord"]).drop("ord") if dedupe else good


def bad_lines(spark: SparkSession, path: str, ddl: str = schemas.LABEL, required: tuple[str, ...] = ("image", "document", "labels")) -> DataFrame:
    """What read_labels leaves out, for a log."""
    return schemas.parse_strict(read_lines(spark, path), ddl, list(required)).where("not ok").select("value", "ord")


def read_prelabels(spark: SparkSession, path: str) -> DataFrame:
    """Prelabel records as they were written, repeats included; none where no log has been begun."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.PRELABEL + ", ord struct<file: string, block: long, place: long>")
    return schemas.parse_strict(read_lines(spark, path), schemas.PRELABEL, ["image", "document"], schemas.score_ranges("r.scores")).where("ok").select("r.*", "ord")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Synthetic records; one bad line fails the read, as pages made from a damaged recipe would be wrong."""
    rows = schemas.parse_strict(read_lines(spark, path), schemas.SYNTHETIC, ["image", "reference", "seed"])
    fault = F.when(~F.col("ok"), F.raise_error(F.concat(F.lit("bad manifest line: "), F.substring("value", 1, 200))).cast("string"))
    return rows.withColumn("fault", fault).where("fault is null").select("r.*", "ord")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """pos, image of a JSON array of records."""
    rows = spark.read.schema(schemas.PRELABEL).option("multiLine", True).json(path)
    return rows.select(F.monotonically_increasing_id().alias("pos"), "*")


def read_split(spark: SparkSession, folder: str) -> DataFrame:
    """part, document, image of the parts in a folder."""
    rows = spark.read.schema("documents array<string>, images array<string>, n_documents int, n_images int").option("multiLine", True).json([f"{folder}/{p}.json" for p in ("train", "val", "test")])
    part = F.regexp_extract(F.col("_metadata.file_path"), r"(train|val|test)\.json$", 1)
    return rows.select(part.alias("part"), "documents", "images")


def read_members(spark: SparkSession, folder: str) -> DataFrame:
    """part, document, image of a split, from its shards or its three files.

    Shards whose rows aren't as many as their counts say are an error: a split
    that has lost a file would let its pages leak into training unseen.
    """
    if not exists(spark, f"{folder}/{COUNTS}"):
        lists = read_split(spark, folder)
        return lists.select("part", F.lit(None).cast("string").alias("document"), F.explode("images").alias("image"))
    want = {r["part"]: r["n_images"] for r in spark.read.schema("part string, n_documents long, n_images long").json(f"{folder}/{COUNTS}").collect()}
    rows = spark.read.schema("document string, image string, part string").json(f"{folder}/members") if any(want.values()) else spark.createDataFrame([], "document string, image string, part string")
    got = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    for part, n in want.items():
        if got.get(part, 0) != n:
            raise ValueError(f"{folder}: {part} has {got.get(part, 0)} of {n} pages")
    return rows.select("part", "document", "image")


def read_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """document of val and test. A missing file is an error that names it, as pages would leak into training unseen."""
    if exists(spark, f"{folder}/{COUNTS}"):
        return read_members(spark, folder).where(F.col("part").isin("val", "test")).select("document").distinct()
    for part in ("val", "test"):
        if not exists(spark, f"{folder}/{part}.json"):
            raise FileNotFoundError(f"{folder}/{part}.json")
    rows = spark.read.schema("documents array<string>").option("multiLine", True).json([f"{folder}/{p}.json" for p in ("val", "test")])
    return rows.select(F.explode("documents").alias("document")).distinct()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced whole, in any store that Spark writes to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_split(assembled: DataFrame, folder: str) -> None:
    """train.json, val.json and test.json from the rows of operators.split.assemble, one part on the driver at a time."""
    for r in assembled.toLocalIterator():
        write_text(assembled.sparkSession, f"{folder}/{r['part']}.json", json.dumps({k: v for k, v in r.asDict().items() if k != "part"}, ensure_ascii=False, indent=2))


def write_members(members: DataFrame, folder: str, shards: int | None = None) -> None:
    """A split of any size as shards: JSON lines of document and image, a folder a part, each file a range of documents.

    Spark commits the files as one job. The counts come from an aggregate and are
    written last, so a folder with counts is whole. Repeated pages are one. Without
    a number of shards Spark sets it by the bytes.
    """
    spark = members.sparkSession
    rows = members.select("part", F.col("document").cast("string").alias("document"), F.col("image").cast("string").alias("image")).distinct()
    order = ["part", "document", "image"]
    if exists(spark, f"{folder}/{COUNTS}"):
        raise FileExistsError(f"{folder}/{COUNTS}")
    (rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("part").json(f"{folder}/members")
    written = spark.read.schema("document string, image string, part string").json(f"{folder}/members")
    counts = {r["part"]: r for r in written.groupBy("part").agg(F.count_distinct("document").alias("n_documents"), F.count(F.lit(1)).alias("n_images")).collect()}
    lines = [{"part": p, "n_documents": counts[p]["n_documents"] if p in counts else 0, "n_images": counts[p]["n_images"] if p in counts else 0} for p in SPLIT_PARTS]
    write_text(spark, f"{folder}/{COUNTS}", "".join(json.dumps(x) + "\n" for x in lines))


def write_queue(queue: DataFrame, path: str) -> None:
    """A JSON array of the records in order. A queue is what people label by hand, so it is small."""
    records = [json.loads(x) for x in queue.select(F.to_json(F.struct(*queue.columns), {"ignoreNullFields": "false"}).alias("r")).toPandas()["r"]]
    write_text(queue.sparkSession, path, json.dumps(records, ensure_ascii=False, indent=2))


def write_manifest(df: DataFrame, path: str) -> None:
    """Synthetic records as JSON lines; what was there goes."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds records as JSON lines; files appear whole or not at all."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def append_metrics(spark: SparkSession, path: str, row: dict, fields: list[str]) -> None:
    """Adds a line to a small CSV log, which begins with the names of its fields; a field that row lacks is empty, others are left out."""
    buffer = io.StringIO()
    out = csv.DictWriter(buffer, fields, restval="", extrasaction="ignore", lineterminator="\n")
    before = ""
    if exists(spark, path):
        before = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if not before:
        out.writeheader()
    out.writerow({k: v for k, v in row.items() if v is not None})
    write_text(spark, path, before + ("" if before.endswith("\n") or not before else "\n") + buffer.getvalue())
