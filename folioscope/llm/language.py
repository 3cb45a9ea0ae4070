"""Language identification by hierarchical discrimination.

Texts become vectors of hashed character n-grams, of length one. Language
families are found from the training texts: the languages' mean vectors are
merged by average linkage until about the square root of their number is left, or
no two fit into one of FAMILY languages. A text is first given to a family by
linear support vector machines, one against the rest; within the family,
one-versus-one linear support vector machines vote between its languages. The
score is the probability of the winning family times the language's share of the
pairwise probabilities.

Learning: the texts of the sample become vectors where they are read. Each
language's mean, each family's machine and each pair's machine is one task's
work, on a bounded number of vectors. The driver gets the means and the weights:
a language has at most FAMILY - 1 pairs, so the model takes about 64 KB for each
language (130 MB for 2,000).

Defined results: a text that is null or has no letter is `und` with score 0.
With one learnt language everything else is that language with score 1; with
none, everything is `und`. A null language isn't learnt from. Columns besides
doc_id, text and (for learning) lang are ignored; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ids_and_texts, remainder, slices, tidy, written

DIMENSIONS = 1 << 12
ORDERS = (1, 2, 3, 4)
#: The bounds of the training sample: texts of each language, texts in all (each language has LEAST_ROWS, however many there are), bytes of a text.
ROWS_PER_LANGUAGE = 600
TRAINING_ROWS, LEAST_ROWS = 24_000, 20
TRAINING_BYTES = 20_000
#: Texts of a language that has longer texts only, of the shorter half of these.
LONG_ROWS = 20
#: Languages of a family; vectors that the families' machines learn from, of each language at least one.
FAMILY, FAMILY_ROWS = 8, 4_000
#: Up to this many languages their numbers of texts are broadcast.
BROADCAST_LANGUAGES = 100_000
_LETTER = regex.compile(r"\p{L}").search
_MULTIPLIER = np.uint32(2_654_435_761)


def _space_table() -> np.ndarray:
    """Bytes that aren't part of a word become spaces; letters of other scripts (bytes over 127) stay."""
    out = np.full(256, 32, np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    out[128:] = np.arange(128, 256)
    return out


_TABLE = _space_table()


def features(text: str) -> np.ndarray:
    """Hashed n-gram counts of the whole text, square-rooted and brought to length one."""
    b = _TABLE[np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])].astype(np.uint32)
    out = np.zeros(DIMENSIONS)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        if n in ORDERS:
            out += np.bincount(((code + np.uint32(n)) * _MULTIPLIER) >> np.uint32(20), minlength=DIMENSIONS)
    np.sqrt(out, out)
    return out / (np.linalg.norm(out) or 1.0)


def _svm(x: np.ndarray, y: np.ndarray, strength: float = 10.0) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by Newton steps with conjugate gradients.

    y is -1 or 1, classes weigh the same; the last weight is the bias.
    """
    n = len(y)
    rows = np.hstack([x, np.ones((n, 1), x.dtype)])
    turned = rows.T
    thin = lambda v: v.astype(x.dtype, copy=False)  # noqa: E731  a product with another type would copy the matrix
    cost = strength * np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        gap = np.maximum(0.0, 1 - y * (rows @ thin(w)))
        return 0.5 * float(w @ w) + float((cost * gap * gap).sum()), gap

    w = np.zeros(rows.shape[1])
    value, gap = loss(w)
    for _ in range(40):
        gradient = w - 2 * (turned @ thin(cost * y * gap))
        live = gap > 0
        own, weight = rows[live], cost[live]
        step, rest = np.zeros_like(w), -gradient
        way, size = rest.copy(), float(rest @ rest)
        if size < 1e-10:
            break
        first = size
        for _ in range(50):
            curved = way + 2 * (own.T @ thin(weight * (own @ thin(way))))
            move = size / float(way @ curved)
            step += move * way
            rest -= move * curved
            new = float(rest @ rest)
            if new < 1e-6 * first:
                break
            way = rest + (new / size) * way
            size = new
        scale = 1.0
        while (trial := loss(w + scale * step))[0] > value and scale > 1e-4:
            scale /= 2
        if value - trial[0] < 1e-6 * max(1.0, value):
            break
        w = w + scale * step
        value, gap = trial
    return w


@dataclass
class Model:
    families: tuple[tuple[str, ...], ...]
    family_weights: np.ndarray  # families x (DIMENSIONS + 1)
    pairs: tuple[tuple[int, int, int], ...]  # family, first language, second language
    pair_weights: np.ndarray

    @cached_property
    def _pairs_of(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i, (f, _, _) in enumerate(self.pairs):
            out.setdefault(f, []).append(i)
        return out

    def predict(self, text: str) -> tuple[str, float]:
        if not self.families or not _LETTER(text):
            return "und", 0.0
        x = features(text)
        family, sure = 0, 1.0
        if len(self.families) > 1:
            margin = 4 * (self.family_weights[:, :-1] @ x + self.family_weights[:, -1])
            p = np.exp(margin - margin.max())
            family = int(margin.argmax())
            sure = float(p[family] / p.sum())
        names = self.families[family]
        if len(names) == 1:
            return names[0], sure
        votes, share = np.zeros(len(names)), np.zeros(len(names))
        for i in self._pairs_of[family]:
            (_, a, b), w = self.pairs[i], self.pair_weights[i]
            margin = float(w[:-1] @ x + w[-1])
            votes[a if margin >= 0 else b] += 1
            p = 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
            share[a] += p
            share[b] += 1 - p
        best = max(range(len(names)), key=lambda i: (votes[i], share[i], -i))
        return names[best], min(1.0, sure * float(share[best] / (len(names) - 1)))


def find_families(names: list[str], means: np.ndarray, most: int = FAMILY) -> list[tuple[str, ...]]:
    """Average linkage over cosine similarity, until about sqrt(languages) families are left or all others would be too large.

    Each group keeps its best partner, so a merge costs a few rows of the table of similarities.
    """
    n = len(names)
    groups: dict[int, list[int]] = {i: [i] for i in range(n)}
    near = means @ means.T
    size = np.ones(n)
    np.fill_diagonal(near, -np.inf)
    best = near.argmax(axis=1)
    while len(groups) > max(1, round(n**0.5)):
        value = near[np.arange(n), best]
        a = int(value.argmax())
        b = int(best[a])
        if value[a] == -np.inf:
            break
        a, b = min(a, b), max(a, b)
        if size[a] + size[b] > most:
            near[a, b] = near[b, a] = -np.inf
            touched = [a, b]
        else:
            row = (size[a] * near[a] + size[b] * near[b]) / (size[a] + size[b])
            near[a], near[:, a] = row, row
            near[b], near[:, b] = -np.inf, -np.inf
            near[a, a] = -np.inf
            size[a] += size[b]
            groups[a] += groups.pop(b)
            touched = [a, *np.flatnonzero((best == a) | (best == b)).tolist()]
        for i in touched:
            best[i] = int(near[i].argmax())
    return sorted(tuple(names[i] for i in sorted(g)) for g in groups.values())


def _packed(x: np.ndarray) -> bytes:
    return x.astype(np.float16).tobytes()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)


def sample(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> tuple[DataFrame, int]:
    """lang, spread, vector of a bounded number of whole texts of every language, as a written table; and the number of languages.

    Texts are chosen by a hash of doc_id and text: a few hash values hold the
    share that is wanted, so a language's rows are cut by its count before they
    are ranked. A language without a text of at most TRAINING_BYTES is learnt
    from the shorter half of its texts, however long these are.
    """
    size = F.octet_length("text")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (size > 0))
    counts = named.groupBy("lang").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(size <= TRAINING_BYTES, 1)).alias("short"), F.percentile_approx(size, F.lit(0.5), F.lit(100)).alias("half"))
    counts = written(counts, "language-counts")
    n = counts.count()
    each = min(rows_per_language, max(LEAST_ROWS, TRAINING_ROWS // max(1, n)))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    has = F.col("short") > 0
    facts = counts.select(F.col("lang").alias("__lang"), F.when(has, F.lit(TRAINING_BYTES)).otherwise(F.col("half")).alias("bound"), (F.when(has, F.lit(each)).otherwise(F.lit(min(each, LONG_ROWS))) / F.when(has, F.col("short")).otherwise(F.greatest(F.lit(1), F.col("all") / 2))).alias("share"), F.when(has, F.lit(each)).otherwise(F.lit(min(each, LONG_ROWS))).alias("most"))
    facts = F.broadcast(facts) if n <= BROADCAST_LANGUAGES else facts
    # Three times the share, so that the cut by rank below takes what is wanted and not what a hash happens to give.
    some = named.withColumn("spread", spread).join(facts, F.col("lang") == F.col("__lang")).where((size <= F.col("bound")) & (F.col("spread") < 3 * F.col("share") + 10 / F.col("most") * F.col("share")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            vectors = pa.array([_packed(features(t)) for t in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("spread"), part.column("most"), vectors], ["lang", "spread", "most", "vector"])

    rows = some.dropDuplicates(["lang", "spread"]).select("text", "lang", "spread", "most").mapInArrow(tidy(run), "lang string, spread double, most int, vector binary")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("spread"))
    return written(rows.withColumn("nth", nth).where(F.col("nth") <= F.col("most")).drop("most"), "language-sample"), n


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Families and machines from a bounded sample of every language."""
    spark = docs.sparkSession
    rows, n = sample(docs, rows_per_language)
    blank = np.zeros((0, DIMENSIONS + 1), np.float32)
    if not n:
        return Model((), blank, (), blank)

    def mean(key: tuple[str], frame: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(frame["vector"]).mean(0, dtype=np.float64)
        return pd.DataFrame({"lang": [key[0]], "mean": [(m / (np.linalg.norm(m) or 1.0)).astype(np.float32).tobytes()]})

    means = rows.groupBy("lang").applyInPandas(mean, "lang string, mean binary").orderBy("lang").toArrow()  # a row for each language
    names = means.column("lang").to_pylist()
    families = find_families(names, np.frombuffer(b"".join(means.column("mean").to_pylist()), np.float32).reshape(-1, DIMENSIONS))
    home = {v: f for f, group in enumerate(families) for v in group}
    family_weights = blank
    if len(families) > 1:
        few = rows.where(F.col("nth") <= max(1, FAMILY_ROWS // len(names))).orderBy("lang", "nth").select("lang", "vector").toArrow()
        sent = spark.sparkContext.broadcast((b"".join(few.column("vector").to_pylist()), np.array([home[v] for v in few.column("lang").to_pylist()])))  # FAMILY_ROWS vectors, or one a language

        def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            data, own = sent.value
            x = np.frombuffer(data, np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
            for frame in frames:
                for f in frame["id"]:
                    yield pd.DataFrame({"family": [f], "weights": [_svm(x, np.where(own == f, 1.0, -1.0)).astype(np.float32).tobytes()]})

        got = spark.range(0, len(families), 1, min(len(families), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(one, "family long, weights binary").orderBy("family").toArrow()
        family_weights = np.frombuffer(b"".join(got.column("weights").to_pylist()), np.float32).reshape(-1, DIMENSIONS + 1)
        sent.unpersist()
    pairs = [(f, a, b) for f, group in enumerate(families) for a in range(len(group)) for b in range(a + 1, len(group))]
    if not pairs:
        return Model(tuple(families), family_weights, (), blank)
    sides = spark.createDataFrame([(families[f][x], i, 1.0 if x == a else -1.0) for i, (f, a, b) in enumerate(pairs) for x in (a, b)], "lang string, pair int, side double")

    def duel(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "nth"], ascending=[False, True])
        return pd.DataFrame({"pair": [key[0]], "weights": [_svm(_matrix(frame["vector"]), frame["side"].to_numpy()).astype(np.float32).tobytes()]})

    got = rows.join(F.broadcast(sides) if len(names) <= BROADCAST_LANGUAGES else sides, "lang").groupBy("pair").applyInPandas(duel, "pair int, weights binary").orderBy("pair").toArrow()
    return Model(tuple(families), family_weights, tuple(pairs), np.frombuffer(b"".join(got.column("weights").to_pylist()), np.float32).reshape(-1, DIMENSIONS + 1))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; one pass, no shuffle."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # follows the number of languages and families, not the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in slices(batches):
            got = [own.predict(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return ids_and_texts(docs).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the folds other than 2 of 4, given for all rows."""
    model = train(docs.where(remainder("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
