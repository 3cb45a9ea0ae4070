"""Page images as rows: files are listed and read by Spark, decoded in Arrow batches.

PNG and TIFF are decoded in `decoders`; other rasters go through Spark's own image
source. `sources.files` has the entry for a folder of all formats. PDF and WebP have
no reader in this environment and come out as rows with an error, not as missing rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster as R
from ..schemas import PAGE
from .decoders import GREY, decode_png, decode_tiff, png_chunks, tiff_pages

SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")
A4_INCHES = 297 / 25.4


def scan(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (*SUFFIXES, "pdf")) -> DataFrame:
    """path, content of all page files below root. Spark's reader leaves files of no bytes out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).select("path", "content")


def encode_png(img: np.ndarray, dpi: float | None = None) -> bytes:
    h, w = img.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.hstack([np.zeros((h, 1), np.uint8), img]).tobytes()
    size = b"" if dpi is None else chunk(b"pHYs", struct.pack(">IIB", *[round(dpi / 0.0254)] * 2, 1))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + size + chunk(b"IDAT", zlib.compress(raw, 3)) + chunk(b"IEND", b"")


def read_dpi(data: bytes) -> float | None:
    """Dots per inch from PNG, JPEG or TIFF headers; 72 and less say nothing."""
    dpi = None
    try:
        if data[:4] == b"\x89PNG":
            for kind, part in png_chunks(data):
                if kind == b"pHYs" and part[8] == 1:
                    dpi = struct.unpack(">I", part[:4])[0] * 0.0254
                if kind == b"IDAT":
                    break
        elif data[:2] == b"\xff\xd8" and data[6:11] == b"JFIF\0":
            unit, x = data[13], struct.unpack(">H", data[14:16])[0]
            dpi = x * {1: 1.0, 2: 2.54}.get(unit, 0.0)
        elif data[:4] in (b"II*\0", b"MM\0*"):
            e = "<" if data[:2] == b"II" else ">"
            at = struct.unpack(e + "I", data[4:8])[0]
            for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
                tag, _, _, value = struct.unpack(e + "HHII", data[at + 2 + 12 * i : at + 14 + 12 * i])
                if tag == 282:
                    a, b = struct.unpack(e + "II", data[value : value + 8])
                    dpi = a / b
    except (struct.error, ZeroDivisionError, IndexError):
        return None
    return dpi if dpi and round(dpi) > 72 else None


def guess_dpi(height: int, width: int, fallback: str) -> float | None:
    return max(height, width) / A4_INCHES if fallback == "a4" else None


def normalised(img: np.ndarray, dpi: float | None, target: float, upscale: bool) -> tuple[np.ndarray, float]:
    """The page at the target resolution, never enlarged unless allowed; 0 where nothing is known."""
    if not dpi or not target:
        return img, float(dpi or 0.0)
    f = target / dpi
    if f > 1 and not upscale:
        return img, dpi
    if abs(f - 1) >= 0.02:
        h, w = max(1, round(img.shape[0] * f)), max(1, round(img.shape[1] * f))
        img = R.shrink(img, h, w) if f < 1 else np.clip(np.rint(R.resize(img, h, w)), 0, 255).astype(np.uint8)
    return img, target


_FIELDS = pa.schema([("path", pa.string()), ("page", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("dpi", pa.float64()), ("original_width", pa.int32()), ("original_height", pa.int32()), ("gray", pa.binary()), ("error", pa.string())])


def decoded(path: str, read: Callable[[int, int], bytes], size: int, options: dict[str, Any], first: int = 0, last: int | None = None, only: int | None = None) -> Iterator[dict[str, Any]]:
    """Rows of PAGE for pages first to last of a PNG or TIFF (all of them, or one index), by reads of (offset, bytes)."""
    blank = dict.fromkeys(_FIELDS.names) | {"path": path, "page": only or first}
    try:
        if not size:
            raise ValueError("empty file")
        start = read(0, 8)
        if start[:4] in (b"II*\0", b"MM\0*"):
            order, directories = tiff_pages(read)
            known = {i: (lambda d=d: (decode_tiff(d, read, order), d.dpi)) for i, d in enumerate(directories)}
        elif start == b"\x89PNG\r\n\x1a\n":
            known = {0: lambda: (decode_png(data := read(0, size)), read_dpi(data))}
        else:
            raise ValueError(f"unsupported: {path.rpartition('.')[2].lower()}")
        if only is not None and only not in known:
            raise ValueError(f"page {only}: the file has {len(known)} page{'s' * (len(known) != 1)}")
    except (ValueError, OSError) as e:
        yield blank | {"error": str(e)}
        return
    for i in [only] if only is not None else range(first, len(known) if last is None else min(last, len(known))):
        try:
            img, dpi = known[i]()
            h, w = img.shape
            new, dpi = normalised(img, dpi or guess_dpi(h, w, options["fallback"]), options["target_dpi"], options["upscale"])
            yield blank | {"page": i, "height": new.shape[0], "width": new.shape[1], "dpi": dpi, "original_width": w, "original_height": h, "gray": np.ascontiguousarray(new).tobytes()}
        except (ValueError, OSError) as e:
            yield blank | {"page": i, "error": str(e)}


def load_pages(files: DataFrame, target_dpi: float = 300, fallback: str = "a4", upscale: bool = False) -> DataFrame:
    """Rows of PAGE from (path, content) of PNG and TIFF files: one for each page; what can't be read has an error and no pixels."""
    options = {"target_dpi": target_dpi, "fallback": fallback, "upscale": upscale}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                body = data or b""
                for row in decoded(path, lambda at, n, body=body: body[at : at + n], len(body), options):
                    yield pa.RecordBatch.from_pylist([row], _FIELDS)

    return files.select("path", "content").mapInArrow(run, PAGE)


def load_page(files: DataFrame, index: int = 0, **options) -> DataFrame:
    """One page of every file, as load_pages gives it. Rasters hold one page, so another index is an error at once."""
    if index:
        raise IndexError(f"page {index}: the file has one page")
    return load_pages(files, **options)


#: Up to this many files their resolutions (some 200 bytes each) go to every executor, so that pixels don't move.
BROADCAST_FILES = 100_000
HEAD_BYTES = 64 << 10  # holds the resolution of a JPEG; a TIFF may keep its directory anywhere, so it is read whole


def resolutions(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, dpi of the raster files below root, from their headers; null where they say nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([read_dpi(x or b"") for x in b.column("head").to_pylist()], pa.float64())], ["path", "dpi"])

    files = scan(spark, root, suffixes)
    head = F.when(F.lower("path").rlike(r"\.tiff?$"), F.col("content")).otherwise(F.substring("content", 1, HEAD_BYTES))
    return files.select("path", head.alias("head")).mapInArrow(run, "path string, dpi double")


def any_case(suffixes: tuple[str, ...]) -> str:
    """A path pattern for files with these suffixes, small or capital."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in suffixes) + "}"


def load_rasters(spark: SparkSession, root: str, target_dpi: float = 300, fallback: str = "a4", upscale: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of PAGE for what Spark's image source reads (jpeg, png, bmp, gif), at the target resolution.

    only names the suffixes of the files to read.

    The resolution comes from the file's header, or from the fallback. A file that
    can't be decoded is a row with an error and no pixels.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731 - the two sources spell local paths differently
    reader = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False)
    i = (reader.option("pathGlobFilter", any_case(only)) if only else reader).load(root).select("image.*")
    known = resolutions(spark, root, only or SUFFIXES).select(plain(F.col("path")).alias("name"), "dpi")
    few = scan(spark, root, only or SUFFIXES).select("path").limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    rows = i.withColumn("name", plain(F.col("origin"))).join(F.broadcast(known) if few else known, "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                row = dict.fromkeys(_FIELDS.names) | {"path": r["origin"], "page": 0}
                h, w, n = r["height"], r["width"], r["nChannels"]
                if h <= 0 or w <= 0 or len(r["data"] or b"") != h * w * n:
                    row["error"] = "damaged or unsupported image"
                else:
                    px = np.frombuffer(r["data"], np.uint8).reshape(h, w, n)
                    img = px[:, :, 0] if n == 1 else np.rint(px[:, :, :3] @ GREY[::-1]).astype(np.uint8)
                    new, dpi = normalised(img, r["dpi"] or guess_dpi(h, w, fallback), target_dpi, upscale)
                    row |= {"height": new.shape[0], "width": new.shape[1], "dpi": dpi, "original_width": w, "original_height": h, "gray": np.ascontiguousarray(new).tobytes()}
                yield pa.RecordBatch.from_pylist([row], _FIELDS)

    return rows.select("origin", "height", "width", "nChannels", "data", "dpi").mapInArrow(run, PAGE)
