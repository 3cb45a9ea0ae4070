"""Token ids in patched frame-of-reference files.

Documents are range-partitioned and sorted by doc_id; each partition encodes its
texts and writes shards of its own binary format:

    magic, counts of documents, ids and blocks            4 x uint32 (magic first)
    doc_id and number of ids of each document             int64, uint32 arrays
    index: byte offset of each block                      uint32 array
    blocks of up to BLOCK ids: minimum uint32, width uint8, number of ids
    uint16, number of exceptions uint16, packed low bits (lanes of 64 ids),
    exception positions uint16, exception high bits uint32

In a block the minimum is subtracted; the width is the number of bits that a
percentile of the differences needs, of those in KEEP the one that takes the
fewest bytes; what is wider keeps its low bits in place and its high bits in the
exception list. Shards are rows (part, shard,
payload) of a Parquet table, so that any store that Spark writes to can hold
them; `export` copies them to plain files on a mounted folder.

Defined results: null and empty texts hold the end id alone. Equal doc_ids are
ordered by a hash of their texts; a null doc_id comes first and is stored as a flag value.
Columns besides doc_id and text are ignored; an empty table has no shard.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import KEPT_LENGTH
from .common import ids_and_texts, scratch, slices, tidy

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MAGIC = 0x31525046
BLOCK = 4096
KEEP = (90, 95, 99, 100)  # percentiles of differences that the packed width may hold
SHARD_IDS = 2_000_000
PARTITION_BYTES = 256 << 20
#: Units and words kept in each of the two generations of the encoder's table.
KEPT_UNITS = KEPT_WORDS = 500_000
#: Words that the library encodes as one text.
JOINED = 512
NO_ID = -(1 << 63)  # stands for a null doc_id


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64*k values as rows of width*k 64-bit words: lanes of 64 values, each value's low width bits in turn."""
    rows, n = values.shape
    if width in (8, 16, 32):  # the same layout, as the machine has it
        return values.astype(f"<u{width // 8}").view("<u8")
    out = np.zeros((width, rows * n // 64), np.uint64)
    lanes = np.ascontiguousarray((values & np.uint32((1 << width) - 1)).reshape(-1, 64).T).astype(np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(rows, -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The rows that pack was given."""
    rows = len(words)
    if not width:
        return np.zeros((rows, 0), np.uint32)
    if width in (8, 16, 32):
        return np.ascontiguousarray(words).view(f"<u{width // 8}").astype(np.uint32)
    columns = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, columns.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        lane = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            lane |= columns[word + 1] << np.uint64(64 - shift)
        out[j] = lane & mask
    return np.ascontiguousarray(out.T).reshape(rows, -1)


def _widths(rest: np.ndarray, n: int) -> np.ndarray:
    """For each row, the width of the percentile in KEEP that takes the fewest bytes; only the first n columns count."""
    rows = len(rest)
    length = (rest[:, :n].astype(np.float64).view(np.int64) >> 52) - 1022
    length[rest[:, :n] == 0] = 0
    counts = np.bincount((np.arange(rows)[:, None] * 33 + length).ravel(), minlength=rows * 33).reshape(rows, 33)
    below = np.cumsum(counts, axis=1)
    choice = np.stack([(below < -(-n * k // 100)).sum(axis=1) for k in KEEP])
    cost = choice * n / 8 + 6 * (n - np.take_along_axis(below, choice.T, axis=1).T)
    return choice[cost.argmin(axis=0), np.arange(rows)]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids, all of BLOCK ids but the last; blocks of equal width are packed together."""
    full = len(ids) // BLOCK
    parts = [ids[: full * BLOCK].reshape(full, BLOCK)] if full else []
    if tail := len(ids) - full * BLOCK:
        parts.append(np.pad(ids[-tail:], (0, -tail % 64), mode="edge")[None])
    out: list[bytes] = []
    for part in parts:
        n = BLOCK if part.shape[1] == BLOCK and len(out) < full else tail
        low = part[:, :n].min(axis=1)
        rest = np.where(np.arange(part.shape[1]) < n, part - low[:, None], 0).astype(np.uint32)
        widths = _widths(rest, n)
        made: list[bytes] = [b""] * len(part)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            packed = pack(rest[rows], width)
            high = (rest[rows].astype(np.uint64) >> np.uint64(width)).astype("<u4")
            for k, row in enumerate(rows.tolist()):
                odd = np.flatnonzero(high[k])
                head = np.array([low[row]], "<u4").tobytes() + bytes([width]) + np.array([n, len(odd)], "<u2").tobytes()
                made[row] = head + packed[k].astype("<u8").tobytes() + odd.astype("<u2").tobytes() + high[k][odd].tobytes()
        out += made
    return out


def decode_blocks(payload: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at starts."""
    heads = [(int.from_bytes(payload[i : i + 4], "little"), payload[i + 4], *np.frombuffer(payload, "<u2", 2, i + 5).tolist()) for i in starts]
    at = np.concatenate([[0], np.cumsum([h[2] for h in heads])]).astype(np.int64)
    out = np.empty(int(at[-1]), np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (_, width, n, _) in enumerate(heads):
        alike.setdefault((width, -(-n // 64)), []).append(k)
    for (width, lanes), group in alike.items():
        size = lanes * width
        words = np.stack([np.frombuffer(payload, "<u8", size, starts[k] + 9) for k in group]) if size else None
        values = unpack(words, width) if size else np.zeros((len(group), lanes * 64), np.uint32)
        for row, k in enumerate(group):
            low, _, n, odd = heads[k]
            own = out[at[k] : at[k + 1]]
            own[:] = values[row, :n]
            if odd:
                tail = starts[k] + 9 + 8 * size
                own[np.frombuffer(payload, "<u2", odd, tail)] |= np.frombuffer(payload, "<u4", odd, tail + 2 * odd) << np.uint32(width)
            own += np.uint32(low)
    return out


def encode_shard(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = encode_blocks(flat.astype(np.uint32))
    head = np.array([MAGIC, len(ids), len(flat), len(blocks)], "<u4").tobytes() + np.array(doc_ids, "<i8").tobytes() + np.array([len(x) for x in ids], "<u4").tobytes()
    at = np.cumsum([len(head) + 4 * len(blocks), *(len(x) for x in blocks)])[:-1]
    return head + at.astype("<u4").tobytes() + b"".join(blocks)


def decode_shard(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids, all ids."""
    magic, docs, n, blocks = (int(x) for x in np.frombuffer(payload, "<u4", 4))
    if magic != MAGIC:
        raise ValueError("not a token shard")
    doc_ids = np.frombuffer(payload, "<i8", docs, 16)
    counts = np.frombuffer(payload, "<u4", docs, 16 + 8 * docs).astype(np.int64)
    out = decode_blocks(payload, np.frombuffer(payload, "<u4", blocks, 16 + 12 * docs).tolist())
    if len(out) != n or counts.sum() != n:
        raise ValueError("a token shard is damaged")
    return doc_ids, counts, out


class LibraryEncoder:
    """Ids from the tokenizers library, for vocabularies that drop white space and split letters from other signs.

    Texts are cut at spaces and line ends into units, and each different one of
    a call is looked up once. A unit of letters and closing punctuation is cut
    again between the two, so that a word is encoded once, whatever follows it;
    the library encodes what isn't in the tables (of bounded size) yet, words
    many at a time as one text where their ends show in the ids. A text that may
    hold the string of an added token, which the library gives that token's id,
    goes to the library whole.
    """

    #: Signs after a word that the pattern always splits from letters; no apostrophe, which may begin a contraction.
    CLOSING = string.punctuation.replace("'", "")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            lean = json.load(f)
        self.added = sorted({x["content"].strip().lower() for x in lean.get("added_tokens") or []})
        # For words that are normal already: the same model without the normaliser and the splitting pattern, which would change nothing.
        steps = (lean.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.word_tokenizer, self.ends = self.tokenizer, None
        if [x["type"] for x in (lean.get("normalizer") or {}).get("normalizers") or []] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]:
            lean |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
            self.word_tokenizer = Tokenizer.from_str(json.dumps(lean))
            if suffix := lean["model"].get("end_of_word_suffix"):
                vocab = self.tokenizer.get_vocab()
                self.ends = np.zeros(max(vocab.values()) + 1, bool)
                self.ends[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _has_added(self, text: str) -> bool:
        low = text.lower()
        return any(x in low for x in self.added)

    def _parts(self, unit: str) -> tuple[str, str, bool]:
        """The unit as a word and its closing signs; whether the word is letters in their normal form."""
        word = unit.rstrip(self.CLOSING)
        if word.isalpha():
            normal = word if word.isascii() else unicodedata.normalize("NFC", word)
            # The library lowers letter by letter, also a sigma at the end of a word.
            normal = "".join(x.lower() for x in normal) if "\u03a3" in normal else normal.lower()
            if normal.isalpha():
                return normal, unit[len(word) :], True
        return unit, "", False

    def _each(self, own: list[str], tokenizer: Tokenizer) -> list[bytes]:
        return [array("I", e.ids).tobytes() for i in range(0, len(own), 4096) for e in tokenizer.encode_batch_fast(own[i : i + 4096], add_special_tokens=False)]

    def _joined(self, own: list[str]) -> list[bytes]:
        """Ids of words, JOINED of them encoded as one text and told apart by the last token of each."""
        if self.ends is None:
            return self._each(own, self.word_tokenizer)
        out: list[bytes] = []
        for i in range(0, len(own), JOINED):
            part = own[i : i + JOINED]
            ids = np.array(self.word_tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            raw, at = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            out += [raw[a:b] for a, b in pairwise(at)] if len(at) == len(part) + 1 and at[-1] == len(raw) else self._each(part, self.word_tokenizer)
        return out

    def _learn(self, units: list[str]) -> dict[str, bytes | None]:
        """The ids of units that aren't in the table, and of the words and signs that they consist of."""
        known, old = self.known, self.old
        got: dict[str, bytes | None] = dict(zip(units, map(old.get, units), strict=True))
        got[""] = b""
        plain: list[str] = []
        other: list[str] = []
        cut, words, tails = [], [], []
        for unit in [x for x, ids in got.items() if ids is None]:
            if unit.islower() and unit.isascii() and unit.isalpha():
                plain.append(unit)
                continue
            word, tail, normal = self._parts(unit)
            if word == unit:
                (plain if normal else other).append(unit)
                continue
            cut.append(unit)
            words.append(word)
            tails.append(tail)
            for x, kind in ((word, plain if normal else other), (tail, other)):
                if x not in got:
                    got[x] = known.get(x, old.get(x))
                    if got[x] is None:
                        kind.append(x)
        got.update(zip(plain, self._joined(plain), strict=True))
        got.update(zip(other, self._each(other, self.tokenizer), strict=True))
        got.update(zip(cut, [got[word] + got[tail] for word, tail in zip(words, tails, strict=True)], strict=True))
        known.update(got)
        for x in [x for x in got if len(x) > KEPT_LENGTH]:
            del known[x]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_UNITS + KEPT_WORDS:
            self.old, self.known = self.known, {}
        whole = {i: array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes() for i, x in enumerate(texts) if self._has_added(x)}
        cut = [[] if i in whole else x.replace("\n", " ").split(" ") for i, x in enumerate(texts)]
        own = dict.fromkeys(chain.from_iterable(cut))
        found = dict(zip(own, map(self.known.get, own), strict=True))
        if missed := [x for x, ids in found.items() if ids is None]:
            found.update(self._learn(missed))
        get = found.__getitem__
        out = [b"".join(map(get, x)) for x in cut]
        for i, ids in whole.items():
            out[i] = ids
        return out


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def _shards(rows: Iterable[tuple[int | None, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """Shards (number, payload) of rows in order."""
    doc_ids: list[int] = []
    ids: list[np.ndarray] = []
    size = number = 0
    for doc_id, own in rows:
        doc_ids.append(NO_ID if doc_id is None else doc_id)
        ids.append(own)
        size += len(own)
        if size >= SHARD_IDS:
            yield number, encode_shard(doc_ids, ids)
            doc_ids, ids, size, number = [], [], 0, number + 1
    if ids:
        yield number, encode_shard(doc_ids, ids)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Writes the shards of docs to path. vocabulary: the tokenizer's file, at the same place on every executor.

    Ranges hold PARTITION_BYTES of text at most, about; there are as many as the session's shuffles have, or more.
    """
    spark, rows_in = docs.sparkSession, ids_and_texts(docs)
    n = partitions
    if not n:
        total = rows_in.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(vocabulary)
        part_id = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for part in slices(batches):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text").to_pylist()), strict=True):
                    yield doc_id, np.frombuffer(ids + last, "<u4")

        for number, payload in _shards(rows()):
            yield pa.RecordBatch.from_arrays([pa.array([part_id], pa.int32()), pa.array([number], pa.int32()), pa.array([payload], pa.binary())], ["part", "shard", "payload"])

    # Rows of one doc_id may be dealt to several ranges, by a hash of the text.
    dealt = rows_in.withColumn("h", F.xxhash64("text")).repartitionByRange(n, F.col("doc_id"), F.col("h"))
    ordered = dealt.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    ordered.mapInArrow(tidy(run), "part int, shard int, payload binary").write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, shard, position, doc_id, ids from the shards of path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "payload")), strict=True):
                doc_ids, counts, ids = decode_shard(payload)
                at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32)))], ["part", "shard", "position", "doc_id", "ids"])

    return _payloads(spark, path).mapInArrow(run, "part int, shard int, position int, doc_id long, ids array<int>")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, shard int, payload binary").parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards of path.

    start sums the shards before: a running sum inside each partition, and one
    over partitions (as many rows as the writer had partitions).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "payload")), strict=True):
                doc_ids, counts, ids = decode_shard(payload)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = np.concatenate([[0], np.cumsum(counts)])
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(at[:-1]), pa.array(counts), pa.array(sums, pa.int64())], ["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"])

    spark.sparkContext  # noqa: B018
    rows = _payloads(spark, path).mapInArrow(run, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    rows = rows.select(*rows.columns)
    head = F.substring("payload", 9, 4)  # number of ids, little-endian
    count = sum((F.conv(F.hex(F.substring(head, i + 1, 1)), 16, 10).cast("long") * (1 << 8 * i) for i in range(4)), F.lit(0).cast("long"))
    shards = _payloads(spark, path).select(F.col("part").alias("s_part"), F.col("shard").alias("s_shard"), count.alias("n"))
    inside = F.sum("n").over(Window.partitionBy("s_part").orderBy("s_shard").rowsBetween(Window.unboundedPreceding, -1))
    parts = shards.groupBy(F.col("s_part").alias("p_part")).agg(F.sum("n").alias("p_n"))
    ahead = F.sum("p_n").over(Window.orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1))
    base = shards.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts.withColumn("ahead", F.coalesce(ahead, F.lit(0))), F.col("s_part") == F.col("p_part"))
    base = base.select("s_part", "s_shard", (F.col("inside") + F.col("ahead")).alias("base"))
    out = rows.join(base, (F.col("part") == F.col("s_part")) & (F.col("shard") == F.col("s_shard")))
    return out.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def write_and_digest(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes docs to a new path of the shared folder and gives the digests of what is read back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return digests(docs.sparkSession, path)


def export(spark: SparkSession, path: str, folder: str) -> None:
    """Copies each shard to a plain file of folder, which must be mounted on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "payload")), strict=True):
                name = os.path.join(folder, f"tokens-{part:05d}-{shard:05d}.pfr")
                with open(name + f".{os.getpid()}", "wb") as f:
                    f.write(payload)
                os.replace(f.name, name)
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    _payloads(spark, path).mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()
