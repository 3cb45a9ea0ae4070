"""Byte-level BPE encoding and decoding with a segment tree.

A piece of text (one match of the vocabulary's pattern) is merged bottom-up.
The leaves of a segment tree stand for byte positions and hold the rank of the
pair that starts there, each inner node the smallest rank below it and, at equal
ranks, the leftmost position. The root names the next merge; a merge changes
three leaves (the pair itself, the one before it, the position that is gone),
each in logarithmic time. Nodes are FAN wide.

Texts are cut at single spaces first. The pattern never lets a match run on
from a character into a following space, so pieces of such units are pieces of
the text; only where a space has white space on both sides (or ends the text
after white space) may units hang together, and then the whole text goes through
the pattern. Units already seen come from a table of bounded size.

Defined results: null and empty texts have no ids. Rows are independent, so
repeated rows and doc_ids and null doc_ids pass through as they are. Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ids_and_texts, slices, tidy

#: Unicode White_Space, as the tokenizer's own pattern engine reads \s.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Units kept in each of the two generations of the table; longer units are not kept.
KEPT_UNITS = 250_000
KEPT_LENGTH = 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


#: Children of an inner node. A wide node costs one built-in min over a short slice, far less than three binary levels.
FAN = 8
_NONE = 1 << 62


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    shift = n.bit_length()
    mask = (1 << shift) - 1
    leaves = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        leaves.append(_NONE if r is None else r << shift | i)
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    depth = len(levels)
    top = levels[-1]
    after = list(range(1, n + 1))  # start of the next live part
    before = list(range(-1, n))
    while top[0] != _NONE:
        i = top[0] & mask
        gone = after[i]
        end = after[gone]
        after[i] = end
        before[end] = i
        a = b = c = i
        if gone < n - 1:
            leaves[gone] = _NONE
            c = gone
        r = get(piece[i : after[end]]) if end < n else None
        leaves[i] = _NONE if r is None else r << shift | i
        left = before[i]
        if left >= 0:
            r = get(piece[left:end])
            leaves[left] = _NONE if r is None else r << shift | left
            a = left
        for k in range(1, depth):
            below, here = levels[k - 1], levels[k]
            a //= FAN
            b //= FAN
            c //= FAN
            here[b] = min(below[b * FAN : b * FAN + FAN])
            if a != b:
                here[a] = min(below[a * FAN : a * FAN + FAN])
            if c != b:
                here[c] = min(below[c * FAN : c * FAN + FAN])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Units(dict):
    """Unit -> its ids as little-endian bytes, in two generations; what is not there is made."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.make(unit)
        if len(unit) <= KEPT_LENGTH:
            if len(self) >= KEPT_UNITS:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class Codec:
    """Encodes texts to ids and ids back to bytes, for one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall
        self.loose = re.compile(f" (?:[{WHITE}]|\\Z)").search  # cheap, and without a match there is none of joined
        self.joined = regex.compile(f"[{WHITE}] (?:[{WHITE}]|\\Z)").search
        self.pieces = _Units(lambda piece: np.array(merge_piece(piece.encode(), ranks), "<u4").tobytes())
        self.spaced = _Units(lambda unit: self._encode(" " + unit))
        get = self.spaced.__getitem__
        self.unit = get
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        self.starts = np.zeros_like(self.lengths)
        at = 0
        for token, r in order:
            self.lengths[r], self.starts[r] = len(token), at
            at += len(token)
        self.bytes = np.frombuffer(b"".join(x for x, _ in order), np.uint8)

    def _encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.loose(text) and self.joined(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        head = self._encode(first) if first else b""
        return head + b"".join(map(self.unit, rest))

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4")
        n = self.lengths[i]
        ends = np.cumsum(n)
        if not len(ends):
            return b""
        at = np.repeat(self.starts[i] - (ends - n), n)
        at += np.arange(ends[-1])
        return self.bytes[at].tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the ids of every text. path: the vocabulary's file, at the same place on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in slices(batches):
            ids = [np.frombuffer(own.encode(x), "<u4").astype(np.int32) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return ids_and_texts(docs).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text from doc_id, ids; bytes that aren't UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in batches:
            texts = [own.decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if with_ids): ids are made and decoded in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in slices(batches):
            n, made, back, kept = [], [], [], []
            for text in part.column("text").to_pylist():
                ids = own.encode(text)
                n.append(len(ids) // 4)
                made.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<i4"))
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(made, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.list_(pa.int32()))] * with_ids], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return ids_and_texts(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
