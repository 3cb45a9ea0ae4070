"""Page files of all formats as one table, and files and archives written by tasks.

The `pages` data source plans its partitions by bytes: small files are dealt
together, and a TIFF that is larger than a partition is cut into ranges of its
pages. Reading goes through Arrow's file systems, and of a TIFF only the pages of
the own range are read. The `page_files` sink writes one file a row under its final
name by an atomic move, so a task that runs again writes the same; `tar_shards`
writes archives, which the driver moves into place once all tasks are done.
"""

from __future__ import annotations

import io
import json
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import PAGE
from .decoders import tiff_pages
from .pages import _FIELDS, decoded, load_rasters, scan

#: Formats of the `pages` source, and of Spark's image source.
OWN, IMAGES = ("png", "tif", "tiff"), ("jpg", "jpeg", "bmp", "gif")
PARTITION_BYTES = 64 << 20
SHARD_BYTES = 512 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def suffix(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2].lower()


@dataclass
class Files(InputPartition):
    """(path, first page, end or None for all) of the files of a task."""

    items: list[tuple[str, int, int | None]]

    def __post_init__(self) -> None:
        super().__init__(self.items)


def planned(sizes: list[tuple[str, int, int, int | None]], most: int) -> list[list[tuple[str, int, int | None]]]:
    """Items (path, bytes, first, end) in order, dealt to lists of at most so many bytes, or of one item."""
    out: list[list[tuple[str, int, int | None]]] = []
    room = 0
    for path, n, first, end in sizes:
        if not out or n > room:
            out.append([])
            room = most
        out[-1].append((path, first, end))
        room -= n
    return out


def page_ranges(where: fs.FileSystem, path: str, size: int, most: int) -> Iterator[tuple[str, int, int, int | None]]:
    """A file as one item, or a large TIFF as ranges of pages of about most bytes each."""
    if size <= most or suffix(path) == "png":
        yield path, size, 0, None
        return
    try:
        with where.open_input_file(path) as f:
            _, pages = tiff_pages(lambda at, n: f.read_at(n, at))
    except (ValueError, OSError):
        yield path, size, 0, None  # the task finds out, and reports it
        return
    first, n = 0, 0
    for i, page in enumerate(pages):
        if i > first and n + page.n_bytes > most:
            yield path, n, first, i
            first, n = i, 0
        n += page.n_bytes
    yield path, n, first, len(pages)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.page = int(options["page"]) if "page" in options else None
        self.how = {"target_dpi": float(options.get("targetdpi", 300)), "fallback": options.get("fallback", "a4"), "upscale": options.get("upscale", "false").lower() == "true"}

    def partitions(self) -> list[InputPartition]:
        where, root = located(self.root)
        at = where.get_file_info(root)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [at] if at.is_file else where.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and suffix(f.path) in OWN)
        items = [x for path, size in files for x in ([(path, size, 0, None)] if self.page is not None else page_ranges(where, path, size, self.most))]
        return [Files(x) for x in planned(items, self.most)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        where, _ = located(self.root)
        for path, first, end in partition.items:
            try:
                with where.open_input_file(path) as f:
                    for row in decoded(path, lambda at, n, f=f: f.read_at(n, at), f.size(), self.how, first, end, self.page):
                        yield pa.RecordBatch.from_pylist([row], _FIELDS)
            except OSError as e:
                yield pa.RecordBatch.from_pylist([dict.fromkeys(_FIELDS.names) | {"path": path, "page": first, "error": str(e)}], _FIELDS)


class PageSource(DataSource):
    """spark.read.format("pages").load(folder): a row for each page of its PNG and TIFF files.

    Options: targetDpi, fallback, upscale, page (one index of every file), partitionBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: int
    n_bytes: int
    moves: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.job = options["path"], uuid.uuid4().hex
        self.shard_bytes = int(options.get("shardbytes", SHARD_BYTES))
        where, root = located(self.root)
        if overwrite and where.get_file_info(root).type == fs.FileType.Directory:
            where.delete_dir_contents(root)
        where.create_dir(f"{root}/_staging-{self.job}")

    def _close(self) -> tuple[fs.FileSystem, str]:
        where, root = located(self.root)
        where.delete_dir(f"{root}/_staging-{self.job}")
        return where, root

    def commit(self, messages: list[Written | None]) -> None:
        """Moves whole shards into place; then says how much there is."""
        where, root = located(self.root)
        done = [m for m in messages if m]
        for a, b in (x for m in done for x in m.moves):
            where.move(f"{root}/_staging-{self.job}/{a}", f"{root}/{b}")
        self._close()
        with where.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.n_bytes for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._close()


def inside(name: str | None) -> str:
    """A name that stays below the folder."""
    parts = (name or "").split("/")
    if not name or "" in parts or "." in parts or ".." in parts:
        raise ValueError(f"not a name below the folder: {name!r}")
    return name


class FileWriter(_Writer):
    def write(self, iterator: Iterator[Row]) -> Written:
        where, root = located(self.root)
        n, size, made = 0, 0, set()
        for row in iterator:
            name, body = inside(row["name"]), bytes(row["content"] or b"")
            own = f"{root}/_staging-{self.job}/{uuid.uuid4().hex}"
            with where.open_output_stream(own) as out:
                out.write(body)
            if (folder := f"{root}/{name}".rpartition("/")[0]) not in made:
                where.create_dir(folder)
                made.add(folder)
            where.move(own, f"{root}/{name}")
            n, size = n + 1, size + len(body)
        return Written(n, size, [])


class TarWriter(_Writer):
    """Shards of about shardBytes, and beside each the names, offsets and sizes of its members as JSON lines."""

    def write(self, iterator: Iterator[Row]) -> Written:
        where, root = located(self.root)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        n, total, moves = 0, 0, []
        tar = sink = index = None

        def close() -> None:
            if tar is not None:
                tar.close()
                sink.close()
                with where.open_output_stream(f"{root}/_staging-{self.job}/{moves[-1][0]}") as out:
                    out.write(index.getvalue())

        for row in iterator:
            name, body = inside(row["name"]), bytes(row["content"] or b"")
            if tar is None or tar.offset >= self.shard_bytes:
                close()
                final = f"shard-{task:05d}-{len(moves) // 2:03d}"
                moves += [(f"{attempt}-{final}.tar", f"{final}.tar"), (f"{attempt}-{final}.jsonl", f"{final}.jsonl")]
                sink, index = where.open_output_stream(f"{root}/_staging-{self.job}/{moves[-2][0]}"), io.BytesIO()
                tar = tarfile.open(fileobj=sink, mode="w|", format=tarfile.PAX_FORMAT)  # noqa: SIM115
            info = tarfile.TarInfo(name)
            info.size = len(body)  # the time stays 0, so that a second attempt gives the same bytes
            tar.addfile(info, io.BytesIO(body))
            index.write(json.dumps({"name": name, "shard": f"{final}.tar", "offset": tar.offset - -(-len(body) // 512) * 512, "size": len(body)}, ensure_ascii=False).encode() + b"\n")
            n, total = n + 1, total + len(body)
        close()
        return Written(n, total, moves)


class FileSink(DataSource):
    """df(name, content).write.format("page_files"): a file for each row, folders made as needed."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options, overwrite)


class TarSink(DataSource):
    """df(name, content).write.format("tar_shards"): archives of the rows."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TarWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (PageSource, FileSink, TarSink):
        spark.dataSource.register(source)


def read_pages(spark: SparkSession, root: str, target_dpi: float = 300, fallback: str = "a4", upscale: bool = False, page: int | None = None) -> DataFrame:
    """Rows of PAGE of all page files below a folder, whatever their format; page takes one index of every file.

    A file that can't be read, has a format without a reader here (PDF, WebP) or
    lacks the page is a row with an error and no pixels.
    """
    register(spark)
    reader = spark.read.format("pages").option("targetDpi", target_dpi).option("fallback", fallback).option("upscale", upscale)
    own = (reader if page is None else reader.option("page", page)).load(root)
    images = load_rasters(spark, root, target_dpi, fallback, upscale, IMAGES)
    if page:
        lost = {"error": F.lit(f"page {page}: the file has 1 page"), "page": F.lit(page)} | {c: F.lit(None) for c in ("height", "width", "dpi", "original_width", "original_height", "gray")}
        images = images.select(*[lost[f.name].cast(f.dataType).alias(f.name) if f.name in lost else F.col(f.name) for f in images.schema.fields])
    rest = scan(spark, root, ("pdf", "webp")).select("path")
    rest = rest.select("path", F.lit(page or 0).alias("page"), *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("height", "width", "dpi", "original_width", "original_height", "gray")], F.concat(F.lit("unsupported: "), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).alias("error"))
    return own.unionByName(images).unionByName(rest)


def write_files(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A file for each row (name, content)."""
    register(rows.sparkSession)
    rows.select("name", "content").write.format("page_files").mode("overwrite" if overwrite else "append").save(folder)


def package(pages: DataFrame, root: str, required: dict[str, str], target: str, shards: int = 8) -> dict[str, Any]:
    """Archives of pages (name: a path below root, once each) and of required files (name in the archive: path).

    A page without a file, or with one of no bytes, is counted and left out; a required file that is missing
    is an error before anything is written. Members are dealt by ranges of names.
    """
    spark: SparkSession = pages.sparkSession
    register(spark)
    where = {name: located(path) for name, path in required.items()}
    for name, (store, path) in where.items():
        if store.get_file_info(path).type != fs.FileType.File:
            raise FileNotFoundError(required[name])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_replace("path", "^file:/+", "/")
    top = located(root)[1].rstrip("/") + "/"
    found = files.withColumn("p", at).where(F.instr("p", top) > 0).select(F.substr("p", F.instr("p", top) + len(top)).alias("__name"), "content")
    wanted = pages.select("name").distinct()
    both = wanted.join(found, F.col("name") == F.col("__name"), "left")
    extra = spark.createDataFrame([], "name string, content binary")
    for name, path in required.items():
        extra = extra.unionByName(spark.read.format("binaryFile").load(path).select(F.lit(name).alias("name"), "content"))
    members = both.where(F.col("__name").isNotNull()).select("name", "content").unionByName(extra)
    members.repartitionByRange(shards, "name").sortWithinPartitions("name").write.format("tar_shards").mode("overwrite").save(target)
    n, there = (wanted.count(), wanted.join(found.select("__name"), F.col("name") == F.col("__name"), "left_semi").count())
    return {"pages": there, "missing": n - there, "required": len(required)}
