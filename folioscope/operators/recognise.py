"""Text recognition behind one small interface; engines are loaded once a worker and never imported here."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import raster as R

WORD = "struct<text:string,confidence:double,x0:int,y0:int,x1:int,y1:int>"
SCHEMA = f"path string, page int, words array<{WORD}>, height int, width int, error string"

# Language codes of one engine.
TESSERACT_CODES = {"en": "eng", "ru": "rus"}


class Engine(Protocol):
    def read(self, gray: np.ndarray) -> list[tuple[str, float, tuple[int, int, int, int]]]:
        """Words of a page with confidence (0 to 1) and box (x0, y0, x1, y1)."""


class Tesseract:
    """Words with a confidence in percent; the layout rows between them have a negative one."""

    def __init__(self, languages: list[str]) -> None:
        self.module = importlib.import_module("pytesseract")
        self.languages = "+".join(TESSERACT_CODES.get(x, x) for x in languages)

    def read(self, gray: np.ndarray) -> list[tuple[str, float, tuple[int, int, int, int]]]:
        d = self.module.image_to_data(gray, lang=self.languages, output_type=self.module.Output.DICT)
        rows = zip(*(d[k] for k in ("text", "conf", "left", "top", "width", "height")), strict=True)
        return [(t.strip(), float(c) / 100, (x, y, x + w, y + h)) for t, c, x, y, w, h in rows if t.strip() and float(c) >= 0]


class Easy:
    """Words with four corners each, of which the upright box is kept."""

    def __init__(self, languages: list[str]) -> None:
        self.reader = importlib.import_module("easyocr").Reader(list(languages), gpu=False, verbose=False)

    def read(self, gray: np.ndarray) -> list[tuple[str, float, tuple[int, int, int, int]]]:
        out = []
        for corners, text, confidence in self.reader.readtext(gray):
            at = np.asarray(corners).astype(int)
            out.append((str(text), float(confidence), (*at.min(axis=0).tolist(), *at.max(axis=0).tolist())))
        return out


ENGINES: dict[str, Callable[[list[str]], Engine]] = {"tesseract": Tesseract, "easyocr": Easy}
_MADE: dict[tuple, Engine] = {}


def engine(make: Callable[[list[str]], Engine], languages: list[str]) -> Engine:
    """The worker's own engine: building one takes seconds."""
    key = (make, *languages)
    if key not in _MADE:
        _MADE[key] = make(languages)
    return _MADE[key]


def work_size(height: int, width: int, side: int) -> tuple[int, int]:
    """The size at which a page is read: at most side long, never enlarged."""
    f = min(1.0, side / max(height, width))
    return max(1, round(height * f)), max(1, round(width * f))


def words(pages: DataFrame, languages: list[str], make: str | Callable[[list[str]], Engine] = "tesseract", side: int = 1600) -> DataFrame:
    """Rows of SCHEMA from pages with pixels: boxes are in the size that was read, which height and width give.

    make: a name of ENGINES, or a function of the languages that returns an
    Engine. A page on which the engine fails has no words and the reason in
    error; an engine that can't be built fails the job.
    """
    if isinstance(make, str):
        if make not in ENGINES:
            raise ValueError(f"no such engine: {make}")
        make = ENGINES[make]
    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("words", pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), *[(c, pa.int32()) for c in ("x0", "y0", "x1", "y1")]]))), ("height", pa.int32()), ("width", pa.int32()), ("error", pa.string())])

    def of_page(own: Engine, r: dict[str, Any]) -> dict[str, Any]:
        h, w = work_size(r["height"], r["width"], side)
        img = np.frombuffer(r["gray"], np.uint8).reshape(r["height"], r["width"])
        out = {"path": r["path"], "page": r["page"], "words": [], "height": h, "width": w, "error": None}
        try:
            found = own.read(img if img.shape == (h, w) else R.shrink(img, h, w))
            out["words"] = [{"text": t, "confidence": float(c), **dict(zip(("x0", "y0", "x1", "y1"), map(int, box), strict=True))} for t, c, box in found]
        except Exception as e:  # noqa: BLE001 - any engine may fail on any page, and the others are still to be read
            out["error"] = f"{type(e).__name__}: {e}"
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = engine(make, languages)
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([of_page(own, r) for r in batch.slice(i, 1).to_pylist()], schema)

    rows = pages.where(F.col("gray").isNotNull() & (F.col("height") > 0) & (F.col("width") > 0))
    return rows.select("path", "page", "height", "width", "gray").mapInArrow(run, SCHEMA)
