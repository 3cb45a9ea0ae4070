"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from texts labelled good, one from
texts labelled bad. A text is compressed piece by piece with each; the
difference of the two sizes (bad minus good), divided by the text's bytes, is
the evidence: a text that the good dictionary shortens more than the bad one is
likelier good. A logistic curve over the evidence and over how little text there
is, fitted on labelled texts that neither dictionary has seen, gives a
probability: a text of a few words, which no dictionary can shorten, falls back
on how such short texts are labelled.

Defined results: null and empty texts have evidence 0 and get the curve's value
for no text. Rows without a label, with a null label or with conflicting labels: a
document's label is the smallest that isn't null. With labels of one class only,
or none, every score is the share of good labels (0.5 if there is none). Columns
besides doc_id and text are ignored; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ids_and_texts, release, remainder, slices, text_buffer, tidy

#: Bytes of a piece: short enough that the dictionary, not the piece's own repeats, decides its size.
PIECE = 1024
DICTIONARY = 65_536
LEVEL = 3
#: Bytes at which a text counts as half known: it has PRIOR_BYTES / (PRIOR_BYTES + bytes) of the weight of no text.
PRIOR_BYTES = 60
#: The bounds of the training sample: labelled rows of each class, and bytes of one training text.
ROWS_PER_CLASS = 3000
TRAINING_BYTES = 20_000


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]  # of the evidence, of shortness, and the offset

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """A model with its compressors, which can't be sent between processes."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.made = [self._compressor(x) for x in (model.good, model.bad)] if model.good and model.bad else []
        self.frame = [len(c.compress(b"")) for c in self.made]

    @staticmethod
    def _compressor(data: bytes) -> zstandard.ZstdCompressor:
        own = zstandard.ZstdCompressionDict(data)
        own.precompute_compress(LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False, write_checksum=False)

    def evidence(self, text: bytes | memoryview) -> float:
        if not self.made or not len(text):
            return 0.0
        diff = 0
        good, bad = self.made
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            diff += len(bad.compress(piece)) - self.frame[1] - len(good.compress(piece)) + self.frame[0]
        return diff / len(text)

    def probabilities(self, texts: list[bytes | memoryview]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(curve_inputs([self.evidence(x) for x in texts], [len(x) for x in texts]) @ np.array(self.model.weights), -30, 30)))


def curve_inputs(evidence: list[float], sizes: list[int]) -> np.ndarray:
    short = PRIOR_BYTES / (PRIOR_BYTES + np.array(sizes, float))
    return np.stack([np.array(evidence, float) * (1 - short), short, np.ones(len(short))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights by Newton's method, with a light ridge on all but the offset; inputs are scaled for it."""
    scale = np.append(x[:, :-1].std(0), 1.0)
    scale[scale == 0] = 1.0
    z = x / scale
    w = np.zeros(z.shape[1])
    ridge = np.append(np.full(len(w) - 1, 0.1), 1e-3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple((w / scale).tolist())


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [x[i : i + PIECE] for x in texts for i in range(0, len(x), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples for training: their own bytes serve
        return b"".join(pieces)[-DICTIONARY:] or b" "


def fit(texts: list[bytes], good: np.ndarray) -> Model:
    """Every other text of each class makes the dictionaries, the rest the curve."""
    share = float(good.mean()) if len(good) else 0.5
    nth = np.where(good, np.cumsum(good), np.cumsum(~good))
    if min(good.sum(), (~good).sum()) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"", b"", (0.0, 0.0, float(np.log(share / (1 - share)))))
    first = nth % 2 == 1
    pick = lambda mask: [texts[i] for i in np.flatnonzero(mask)]
    dictionaries = _dictionary(pick(first & good)), _dictionary(pick(first & ~good))
    own, rest = Scorer(Model(*dictionaries, (0.0, 0.0, 0.0))), pick(~first)
    inputs = curve_inputs([own.evidence(x) for x in rest], [len(x) for x in rest])
    return Model(*dictionaries, _logistic(inputs, good[~first].astype(float)))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fits on at most rows_per_class labelled documents of each class, chosen by a hash of doc_id.

    Only the chosen ids (a bound that doesn't grow) are broadcast, and only
    their texts come to the driver, one of each id (the smallest). A chosen
    document without a text of 1 to TRAINING_BYTES bytes isn't learnt from.
    """
    label = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and l_id is not null").groupBy("l_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("l_id")
    chosen = None
    for c in (0, 1):
        part = label.where(F.col("quality") == c).orderBy(order, "l_id").limit(rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = ids_and_texts(docs).where((F.octet_length("text") <= TRAINING_BYTES) & (F.octet_length("text") > 0))
    got = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    data, at = text_buffer(got.column("text"))
    raw = data.tobytes()
    model = fit([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.array(got.column("quality").to_pylist(), bool))
    del got, data, raw
    release()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.scorer()
        for part in slices(batches):
            data, at = text_buffer(part.column("text"))
            raw = memoryview(np.ascontiguousarray(data)).toreadonly()
            scores = own.probabilities([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return ids_and_texts(docs).mapInArrow(tidy(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score is below threshold; all columns stay. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.scorer()
        for part in slices(batches):
            data, at = text_buffer(part.column("text"))
            raw = memoryview(np.ascontiguousarray(data)).toreadonly()
            scores = own.probabilities([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(tidy(run), StructType(list(docs.schema.fields)))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the folds other than 2 of 4, given for all rows."""
    model = train(docs, labels.where(remainder("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
