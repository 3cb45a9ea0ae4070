"""A hashed maximum-entropy language model with a class-factored softmax.

Every token belongs to a class: the end of a text, each of the commonest words
by itself, and the other words by a hash of their last two bytes (so any word,
known or not, has a class). The probability of a token is that of its class in
its context times that of the word in its class:

* the class comes from a softmax over weights of hashed features of the context:
  the word before (n-gram), the pair of classes before (n-gram), the class before
  that (skip), and the mean over the classes of up to WINDOW words before (skips
  of every distance);
* the word comes from the class's training counts, c + 0.5 over N + 0.5 (V + 1).

Counts are exact and cover all training documents: blocks of documents send
their distinct words with counts to buckets of word names, which answer with
totals. The weights start from class frequencies and are trained by rounds of
distributed gradient updates: AdaGrad runs over every block of documents, the
blocks' weights and squared gradients are averaged by tokens, in a tree, and the
next round starts there. The updates read every training document in every
round, and scores don't depend on how the table is split into partitions. Scoring is in sparse batches:
rows of the weight tables are gathered by index, nothing dense in the vocabulary is
formed.

Defined results: null and empty texts are one end token. A null doc_id is not
learnt from and not held out. Repeated rows are scored each; columns besides
doc_id and text are ignored. Words are known by 64-bit names of their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import MESSAGE, bucket_bounds, meet, messages, mix, word_names
from .common import ids_and_texts, scratch, slices, text_buffer, tidy
from .shingle_join import words

CLASSES = 64
SINGLE = 23  # commonest words that are classes of their own
SUFFIXES = CLASSES - 1 - SINGLE
HASHED = 1 << 12
WINDOW = 16
CHUNK = 1 << 14  # tokens of a gradient step
PIECE = 1 << 12  # tokens worked on at a time, so that their rows stay in the cache
ROUNDS = 2
RATE = 0.3
END = np.uint64(0x1D2C3B4A59687786)
BLOCK_BYTES = 8 << 20
STATS = blocks.CARRY  # rows of a bucket's sums, for no block


def suffix_class(lower: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    last = lower[start + size - 1].astype(np.uint32)
    before = np.where(size > 1, lower[np.maximum(start + size - 2, 0)], 0).astype(np.uint32)
    return (((before * np.uint32(257) + last) * np.uint32(2_654_435_761)) >> np.uint32(16)) % np.uint32(SUFFIXES)


@dataclass
class Tokens:
    """The tokens of some texts in order, each text closed by an end: names (distinct ones, or all), places among them, suffix classes."""

    distinct: np.ndarray
    place: np.ndarray
    suffix: np.ndarray  # of each name; SUFFIXES for the end
    at: np.ndarray  # bounds of texts


def tokens(data: np.ndarray, at: np.ndarray, unique: bool = True) -> Tokens:
    """unique: whether to sort for the distinct names, which counting needs and training doesn't."""
    lower, start, size = words(data, at)
    bounds = np.searchsorted(start, at)
    n = len(at) - 1
    named = np.insert(word_names(lower, start, size), bounds[1:], END)
    kinds = np.insert(suffix_class(lower, start, size), bounds[1:], np.uint32(SUFFIXES))
    bounds = bounds + np.arange(n + 1)
    if not unique:
        return Tokens(named, np.arange(len(named)), kinds, bounds)
    distinct, first, place = np.unique(named, return_index=True, return_inverse=True)
    return Tokens(distinct, place, kinds[first], bounds)


def is_held_out(doc_id: int | None, folds: int = 5, fold: int = 1) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


@dataclass(frozen=True)
class Counts:
    """What the corpus says: tokens, distinct tokens, the classes' tokens and distinct words, the single words."""

    total: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    single: np.ndarray  # names, sorted

    def classes(self, t: Tokens) -> np.ndarray:
        """The class of each name."""
        out = np.where(t.suffix == SUFFIXES, 0, 1 + SINGLE + t.suffix).astype(np.int64)
        if len(self.single):
            k = np.minimum(np.searchsorted(self.single, t.distinct), len(self.single) - 1)
            out = np.where((self.single[k] == t.distinct) & (out > 0), 1 + k, out)
        return out


def _count(rows: pa.Table) -> pa.Table:
    """A bucket's totals for each block's names, and its sums."""
    blocks_, buckets, payloads = (rows.column(c).to_pylist() for c in ("block", "bucket", "payload"))
    sizes = [len(p) // 17 for p in payloads]
    named = np.frombuffer(b"".join(p[: 8 * n] for p, n in zip(payloads, sizes, strict=True)), np.uint64)
    own = np.frombuffer(b"".join(p[8 * n : 16 * n] for p, n in zip(payloads, sizes, strict=True)), np.int64)
    suffix = np.frombuffer(b"".join(p[16 * n :] for p, n in zip(payloads, sizes, strict=True)), np.uint8)
    distinct, first, place = np.unique(named, return_index=True, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, own)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = [(b, k, 0, total[place[i:j]].tobytes()) for b, k, i, j in zip(blocks_, buckets, at[:-1], at[1:], strict=True)]
    seen = total > 0
    kind = suffix[first][seen]
    sums = np.concatenate([np.bincount(kind, total[seen], SUFFIXES + 1), np.bincount(kind, minlength=SUFFIXES + 1)]).astype(np.int64)
    top = np.argsort(-total[seen], kind="stable")[: SINGLE + 1]
    most = np.stack([distinct[seen][top].view(np.int64), total[seen][top], kind[top].astype(np.int64)]).tobytes()
    return messages([*out, (-1, buckets[0], STATS, sums.tobytes() + most)])


def _add_stats(rows: pa.Table) -> pa.Table:
    sums, most = np.zeros(2 * (SUFFIXES + 1), np.int64), []
    for p in rows.column("payload").to_pylist():
        sums += np.frombuffer(p, np.int64, 2 * (SUFFIXES + 1))
        most.append(np.frombuffer(p, np.int64, -1, 16 * (SUFFIXES + 1)).reshape(3, -1))
    whole = np.concatenate(most, axis=1)
    whole = whole[:, np.lexsort((whole[0], -whole[1]))[: SINGLE + 1]]
    return messages([(-1, 0, STATS, sums.tobytes() + np.ascontiguousarray(whole).tobytes())])


def count_words(rows: DataFrame, total_bytes: int) -> tuple[DataFrame, Counts, int]:
    """Each block's totals (written to the shared folder), the sums over all, and the number of buckets."""
    buckets = max(1, -(-(total_bytes // 24) // blocks.BUCKET_NAMES))

    def ask(part: pa.Table) -> pa.Table:
        t = tokens(*text_buffer(part.column("text")))
        learnt = np.array([i is not None and not is_held_out(i) for i in part.column("doc_id").to_pylist()])
        count = np.bincount(t.place[np.repeat(learnt, np.diff(t.at))], minlength=len(t.distinct)).astype(np.int64)
        at = bucket_bounds(t.distinct, buckets)
        block = part.column("block")[0].as_py()
        suffix = t.suffix.astype(np.uint8)
        return messages([(block, b, 0, t.distinct[at[b] : at[b + 1]].tobytes() + count[at[b] : at[b + 1]].tobytes() + suffix[at[b] : at[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(at)).tolist()])

    spark = rows.sparkSession
    blocks.ask(rows, ask).groupBy("bucket").applyInArrow(_count, MESSAGE).write.option("compression", "zstd").parquet(path := scratch(spark, "word-counts"))
    told = spark.read.schema(MESSAGE).parquet(path)
    stats = told.where(F.col("kind") == STATS).withColumn("bucket", F.pmod("bucket", F.lit(64))).groupBy("bucket").applyInArrow(_add_stats, MESSAGE).toArrow()
    if not stats.num_rows:
        nothing = np.zeros(CLASSES, np.int64)
        return told, Counts(0, 0, nothing, nothing, np.zeros(0, np.uint64)), buckets
    payload = _add_stats(stats).column("payload")[0].as_py()
    n, v = np.frombuffer(payload, np.int64, 2 * (SUFFIXES + 1)).reshape(2, -1)
    named, count, kind = np.frombuffer(payload, np.int64, -1, 16 * (SUFFIXES + 1)).reshape(3, -1)
    word = np.flatnonzero(kind < SUFFIXES)[:SINGLE]
    word = word[np.argsort(named[word].view(np.uint64))]
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    class_tokens[0], class_words[0] = n[SUFFIXES], v[SUFFIXES]
    class_tokens[1 : 1 + len(word)], class_words[1 : 1 + len(word)] = count[word], 1
    class_tokens[1 + SINGLE :], class_words[1 + SINGLE :] = n[:SUFFIXES], v[:SUFFIXES]
    np.subtract.at(class_tokens, 1 + SINGLE + kind[word], count[word])
    np.subtract.at(class_words, 1 + SINGLE + kind[word], 1)
    return told.where(F.col("kind") != STATS), Counts(int(n.sum()), int(v.sum()), class_tokens, class_words, named[word].view(np.uint64).copy()), buckets


#: Weight tables: bias, word before, class pair before, class two before, window of classes; START stands before a text.
START = CLASSES
TABLES = {"bias": 1, "word": HASHED, "pair": (CLASSES + 1) ** 2, "skip": CLASSES + 1, "window": CLASSES + 1}


class Weights:
    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat
        self.tables, at = {}, 0
        for name, n in TABLES.items():
            self.tables[name] = flat[at : at + n * CLASSES].reshape(n, CLASSES)
            at += n * CLASSES

    @staticmethod
    def size() -> int:
        return sum(TABLES.values()) * CLASSES


class Contexts:
    """Feature rows of every token of some texts."""

    def __init__(self, t: Tokens, classes: np.ndarray) -> None:
        n = len(t.place)
        self.cls = classes[t.place]
        first = np.zeros(n, bool)
        first[t.at[:-1]] = True
        second = np.concatenate([[False], first[:-1]]) if n else first
        one = np.concatenate([[START], self.cls[:-1]]) if n else self.cls
        one[first] = START
        two = np.concatenate([[START], one[:-1]]) if n else one.copy()
        two[first | second] = START
        before = np.concatenate([[0], t.place[:-1]]) if n else t.place
        self.word = (mix(t.distinct)[before] >> np.uint64(52)).astype(np.int64) % HASHED
        self.word[first] = 0
        self.pair = one * (CLASSES + 1) + two
        self.skip = two
        self.span = np.minimum(np.arange(n) - np.repeat(t.at[:-1], np.diff(t.at)), WINDOW)

    def windows(self, a: int, b: int) -> np.ndarray:
        """For each of tokens a to b, the share of every class among the words of its window."""
        n, span = b - a, self.span[a:b]
        before = np.full(n + WINDOW, CLASSES, np.int64)
        first = max(0, a - WINDOW)
        before[WINDOW - (a - first) :] = self.cls[first:b]
        at = np.lib.stride_tricks.sliding_window_view(before, WINDOW)[:n] + np.arange(0, n * CLASSES, CLASSES)[:, None]
        if len(short := np.flatnonzero(span < WINDOW)):  # places before the text count in a cell beyond the rows
            at[short] = np.where(np.arange(WINDOW, 0, -1) <= span[short, None], at[short], n * CLASSES)
        out = np.zeros((n + 1) * CLASSES, np.float32)  # whole numbers up to WINDOW
        np.add.at(out, at.reshape(-1), np.float32(1))
        out = out[: n * CLASSES].reshape(n, CLASSES)
        out /= np.maximum(span, 1)[:, None].astype(np.float32)
        return out

    @staticmethod
    def joined(w: Weights) -> np.ndarray:
        """The class two before is part of the pair, so its row, the bias and the pair's row are one."""
        return (w.tables["pair"].reshape(-1, CLASSES + 1, CLASSES) + (w.tables["skip"] + w.tables["bias"])).reshape(-1, CLASSES)

    def logits(self, w: Weights, a: int, b: int, windows: np.ndarray | None = None, joined: np.ndarray | None = None) -> np.ndarray:
        x = (self.windows(a, b) if windows is None else windows) @ w.tables["window"][:CLASSES]
        x += w.tables["word"].take(self.word[a:b], axis=0)
        x += (self.joined(w) if joined is None else joined).take(self.pair[a:b], axis=0)
        return x

    def log_class(self, w: Weights) -> np.ndarray:
        """Natural log probability of every token's class."""
        out, joined = np.zeros(len(self.cls)), self.joined(w)
        for a in range(0, len(out), PIECE):
            b = min(a + PIECE, len(out))
            x = _bounded(self.logits(w, a, b, joined=joined))
            own = x[np.arange(b - a), self.cls[a:b]].astype(np.float64)
            out[a:b] = own - np.log(np.exp(x, out=x).sum(axis=1, dtype=np.float64))
        return out

    def gradient(self, w: Weights, a: int, b: int, into: Weights | None = None) -> np.ndarray:
        """Of the mean log probability of tokens a to b; into is room for it, whatever it held before."""
        into = into or Weights(np.empty(Weights.size(), np.float32))
        into.flat[:] = 0
        joined, share = self.joined(w), np.float32(1 / (b - a))
        for i in range(a, b, PIECE):
            j = min(i + PIECE, b)
            windows = self.windows(i, j)
            x = _bounded(self.logits(w, i, j, windows, joined))
            np.exp(x, out=x)
            x *= -share / (x @ ONES)
            x[np.arange(j - i), self.cls[i:j]] += share
            _add_rows(into.tables["word"], self.word[i:j], x)
            _add_rows(into.tables["pair"], self.pair[i:j], x)
            into.tables["window"][:CLASSES] += windows.T @ x
        into.tables["skip"] += into.tables["pair"].reshape(-1, CLASSES + 1, CLASSES).sum(axis=0)
        into.tables["bias"][0] = into.tables["skip"].sum(axis=0)
        return into.flat


ONES = np.ones((CLASSES, 1), np.float32)


def _bounded(x: np.ndarray) -> np.ndarray:
    """x, or x less the largest of each row where exponentials of 32 bits could overflow or vanish."""
    if len(x) and (x.max() > 60 or x.min() < -60):
        x -= x.max(axis=1, keepdims=True)
    return x


def _add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each value to its row of the table; by flat places, as numpy is fast at these only."""
    np.add.at(table.reshape(-1), (rows[:, None] * CLASSES + np.arange(CLASSES)).reshape(-1), values.reshape(-1))


#: Sums of weights are sent as integers, whose sums don't depend on their order: 1 / UNIT is a step of a weight.
#: A weight of at most BOUND times the thousands of tokens of a block takes 39 bits, so 2**24 blocks (128 TB) fit.
UNIT, BOUND, THOUSAND = 1 << 20, 63.0, 1 << 10
PARTS = 64  # slices of the weights, each summed by a worker of its own
FAN = 256  # tasks whose slices one worker sums


def descend(rows: pa.Table, counts: Counts, own: np.ndarray, squares: np.ndarray) -> int:
    """AdaGrad over the texts of a block, in its order; changes the weights and their sums of squared gradients. Returns the tokens."""
    w, seen = Weights(own), 0
    into, step = Weights(np.empty(len(own), np.float32)), np.empty(len(own), np.float32)
    for part in slices(rows.combine_chunks().to_batches()):
        t = tokens(*text_buffer(part.column("text")), unique=False)
        c = Contexts(t, counts.classes(t))
        for a in range(0, len(c.cls), CHUNK):
            g = c.gradient(w, a, min(a + CHUNK, len(c.cls)), into)
            squares += np.multiply(g, g, out=step)
            np.sqrt(squares, out=step)
            own += np.divide(np.multiply(g, np.float32(RATE), out=g), step, out=step)
        seen += len(c.cls)
    return seen


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from rows sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[-1].column("block")[0].as_py() != block[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


SUMS = "part int, branch int, n long, sums binary"


def _sums(part: int, branch: int, n: int, sums: np.ndarray) -> list:
    return [part, branch, n, sums.tobytes()]


def _table(rows: list[list]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "branch", "n", "sums"])


def _add(rows: pa.Table) -> pa.Table:
    whole: np.ndarray | int = 0
    for x in rows.column("sums"):
        whole = whole + np.frombuffer(x.as_buffer(), np.int64)
    return _table([_sums(rows.column("part")[0].as_py(), rows.column("branch")[0].as_py(), pc.sum(rows.column("n")).as_py(), whole)])


def train(docs: DataFrame, counts: Counts, rounds: int = ROUNDS, share: float = 1.0) -> np.ndarray:
    """The weights, flat."""
    return train_blocks(blocks.sized(docs, BLOCK_BYTES)[0], counts, rounds, share)


def train_blocks(rows: DataFrame, counts: Counts, rounds: int = ROUNDS, share: float = 1.0) -> np.ndarray:
    """The weights, flat, from the rows of blocks.sized.

    A round works on every block by itself, from the same weights and squares; the
    next one starts from the means over blocks, by tokens. Blocks and the order in
    them depend on the rows alone, and means are of integers, so the weights
    don't depend on how the table is split or which tasks ran again.
    """
    spark = rows.sparkSession
    flat = np.zeros(Weights.size(), np.float32)
    flat[:CLASSES] = np.log((counts.class_tokens + 0.5) / (counts.class_tokens.sum() + 0.5 * CLASSES))
    if not counts.total:
        return flat
    rows = rows.where(F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = rows.repartition("block").sortWithinPartitions("block", "doc_id", "text")
    size = -(-2 * len(flat) // PARTS)
    roots = np.full(len(flat), 1e-3, np.float32)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((flat, roots))  # a fixed size

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            first, start = sent.value
            sums, n = np.zeros(2 * len(first), np.int64), 0
            for block in _by_block(batches):
                own, squares = first.copy(), start * start
                seen = -(-descend(block, counts, own, squares) // THOUSAND)
                n += seen
                sums += np.rint(np.clip(np.concatenate([own, np.sqrt(squares)]), -BOUND, BOUND).astype(np.float64) * UNIT).astype(np.int64) * seen
            if n:
                branch = TaskContext.get().partitionId() // FAN
                yield from _table([_sums(i, branch, n, sums[i * size : (i + 1) * size]) for i in range(PARTS)]).to_batches()

        got = rows.mapInArrow(tidy(learn), SUMS).groupBy("part", "branch").applyInArrow(_add, SUMS).groupBy("part").applyInArrow(_add, SUMS).toArrow().sort_by("part")
        if got.num_rows:
            mean = np.concatenate([np.frombuffer(x, np.int64) for x in got.column("sums").to_pylist()]) / (got.column("n")[0].as_py() * float(UNIT))
            flat, roots = mean[: len(flat)].astype(np.float32), np.maximum(mean[len(flat) :], 1e-3).astype(np.float32)
        sent.unpersist()
    return flat


def score_documents(docs: DataFrame, share: float = 1.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows, total_bytes = blocks.sized(docs, BLOCK_BYTES)
    told, counts, buckets = count_words(rows, total_bytes)
    flat = train_blocks(rows, counts, share=share)
    sent = docs.sparkSession.sparkContext.broadcast((flat, counts))  # a fixed size
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def final(part: pa.Table, got: pa.Table) -> pa.Table:
        own, known = sent.value
        t = tokens(*text_buffer(part.column("text")))
        at = bucket_bounds(t.distinct, buckets)
        count = np.zeros(len(t.distinct), np.int64)
        for bucket, payload in zip(got.column("bucket").to_pylist(), got.column("payload").to_pylist(), strict=True):
            count[at[bucket] : at[bucket + 1]] = np.frombuffer(payload, np.int64)
        classes = known.classes(t)
        base = np.log10((count + 0.5) / (known.total + 0.5 * (known.distinct + 1)))
        inside = np.log10((count + 0.5) / (known.class_tokens[classes] + 0.5 * (known.class_words[classes] + 1)))
        inside[classes <= SINGLE] = 0.0
        log_class = Contexts(t, classes).log_class(Weights(own)) / np.log(10)
        doc = np.repeat(np.arange(part.num_rows), np.diff(t.at))
        total = lambda x: np.bincount(doc, x, part.num_rows)
        n = np.diff(t.at)
        ids = part.column("doc_id").to_pylist()
        return pa.table(
            [part.column("doc_id"), pa.array([is_held_out(i) for i in ids], pa.bool_()), pa.array(n), pa.array(total((count > 0)[t.place]).astype(np.int64)), pa.array(np.full(len(n), known.total, np.int64)), pa.array(total(base[t.place])), pa.array(total(inside[t.place] + log_class))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return meet(rows, told, final, schema)
