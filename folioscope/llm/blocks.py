"""Blocks of documents that ask questions about each other without meeting.

Documents are dealt to blocks of a few megabytes by a hash. A block sends the
fingerprints ("names") of its strings, each once, to buckets: ranges of the name
space. A bucket sees which names came from more than one block and answers each
block with a bitmap in the order of its question. Text moves in one shuffle,
which all passes over the blocks of one plan share; questions are packed arrays.
As a block sends a name once, however often it holds it, a string that every
document shares is no heavier for its bucket than the number of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, release

BLOCK_BYTES = 4 << 20
#: Names that a bucket holds, about.
BUCKET_NAMES = 1 << 20
MESSAGE = "block int, bucket int, kind int, payload binary"
#: Kinds: which of these names has another block; which of these names (with a flag each) is flagged by any block; what passes through.
QUESTION, FLAGGED, CARRY = 0, 1, 2


def sized(docs: DataFrame, block_bytes: int | None = None) -> tuple[DataFrame, int]:
    """(block, doc_id, text) and the bytes of all texts."""
    rows, block_bytes = ids_and_texts(docs), block_bytes or BLOCK_BYTES
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), "doc_id", "text"), total


def ordered(rows: pa.Table) -> pa.Table:
    """The rows of a block in an order that doesn't depend on how they arrived."""
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "bucket", "kind", "payload"])


def bucket_bounds(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted names begins, and the end."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])


def question(block: int, names: np.ndarray, buckets: int) -> list[tuple[int, int, int, bytes]]:
    """Messages that carry sorted, distinct names to their buckets."""
    at = bucket_bounds(names, buckets)
    return [(block, b, QUESTION, names[at[b] : at[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(at)).tolist()]


def _shared(rows: pa.Table) -> pa.Table:
    """A bucket's answers: for each block, a bit for each of its names; carried messages pass."""
    blocks, buckets, kinds, payloads = (rows.column(c).to_pylist() for c in ("block", "bucket", "kind", "payload"))
    out = [(blocks[i], buckets[i], k, payloads[i]) for i, k in enumerate(kinds) if k >= CARRY]
    for kind, width in ((QUESTION, 8), (FLAGGED, 9)):
        asked = [i for i, k in enumerate(kinds) if k == kind]
        if not asked:
            continue
        sizes = [len(payloads[i]) // width for i in asked]
        names = np.frombuffer(b"".join(payloads[i][: 8 * n] for i, n in zip(asked, sizes, strict=True)), np.uint64)
        order = np.argsort(names, kind="stable")
        new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
        group = np.cumsum(new) - 1
        if kind == QUESTION:
            good = np.bincount(group) > 1
        else:
            flags = np.frombuffer(b"".join(payloads[i][8 * n :] for i, n in zip(asked, sizes, strict=True)), np.uint8)
            good = np.bincount(group, weights=flags[order]) > 0
        hit = np.zeros(len(names), bool)
        hit[order] = good[group]
        at = np.concatenate([[0], np.cumsum(sizes)])
        out += [(blocks[i], buckets[i], kind, np.packbits(hit[a:b]).tobytes()) for i, a, b in zip(asked, at[:-1], at[1:], strict=True)]
    return messages(out)


def answers(questions: DataFrame) -> DataFrame:
    return questions.groupBy("bucket").applyInArrow(_shared, MESSAGE)


def read_answer(rows: pa.Table, names: np.ndarray, buckets: int) -> np.ndarray:
    """The answer for each of the sorted, distinct names that were asked."""
    at = bucket_bounds(names, buckets)
    out = np.zeros(len(names), bool)
    for bucket, kind, payload in zip(*(rows.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True):
        if kind < CARRY:
            a, b = at[bucket], at[bucket + 1]
            out[a:b] = np.unpackbits(np.frombuffer(payload, np.uint8), count=b - a).astype(bool)
    return out


def carried(rows: pa.Table, kind: int) -> bytes | None:
    return next((p for k, p in zip(rows.column("kind").to_pylist(), rows.column("payload").to_pylist(), strict=True) if k == kind), None)


def ask(blocks: DataFrame, fn: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Messages of fn(rows of a block)."""
    return blocks.groupBy("block").applyInArrow(lambda rows: fn(ordered(rows)), MESSAGE)


def meet(blocks: DataFrame, told: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn(rows of a block, messages to it), for blocks that have rows."""
    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        out = fn(ordered(rows), got)
        release()
        return out

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


# Names: polynomials modulo the prime 2**31 - 1 in three radices, by prefix sums.

_SEGMENT = 1 << 19
_PRIME = (1 << 31) - 1
_RADICES = (1_220_703_125, 16_807, 630_360_016)  # generators of the prime's group
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_TABLES: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    return x ^ (x >> np.uint64(33))


def _powers(radix: int, n: int) -> np.ndarray:
    have = _TABLES.get(radix)
    if have is None or len(have) < n:
        have = np.ones(max(n, _SEGMENT + 4096), np.uint64)
        done = 1
        while done < len(have):
            more = min(done, len(have) - done)
            have[done : done + more] = have[:more] * np.uint64(pow(radix, done, _PRIME)) % np.uint64(_PRIME)
            done += more
        _TABLES[radix] = have
    return have


_BELOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Strings longer than this are named by blake2b, one by one.
_LONG = 64


def word_names(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit names of words: eight bytes at a time, each step mixed, so that no structure of the bytes cancels out."""
    out = mix(sizes.astype(np.uint64) * _MIX2)
    wide = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    at, left, which = starts, sizes, None
    while len(at):
        step = mix((out if which is None else out[which]) ^ (wide[at] & _BELOW[np.minimum(left, 8)]))
        if which is None:
            out = step
        else:
            out[which] = step
        more = np.flatnonzero((left > 8) & (left <= _LONG)) if which is None else np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    view = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(sizes > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(view[starts[i] : starts[i] + sizes[i]], digest_size=8).digest(), "little")
    return out


def names(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """A 31-bit and a 64-bit name of data[start:start+size] for each of the ascending starts; memory follows a segment, not the data.

    Together they hold three hashes of 31 bits, each of which differs for two
    strings of n bytes but for n of the 2**31 radices.
    """
    out = np.zeros((3, len(starts)), np.uint64)
    sizes = np.broadcast_to(np.asarray(sizes, np.int64), starts.shape)
    cuts = np.searchsorted(starts, np.arange(starts[0] // _SEGMENT, starts[-1] // _SEGMENT + 2) * _SEGMENT) if len(starts) else np.zeros(1, np.int64)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if i == j:
            continue
        lo = int(starts[i])
        hi = int((starts[i:j] + sizes[i:j]).max())
        values, a = data[lo:hi].astype(np.uint64) + np.uint64(1), starts[i:j] - lo
        sums = np.zeros(hi - lo + 1, np.uint64)
        for k, radix in enumerate(_RADICES):
            # A value below 2**9 times a power below 2**31, summed over less than 2**23 bytes, stays below 2**63.
            np.multiply(values, _powers(radix, hi - lo)[: hi - lo], out=sums[1:])
            np.cumsum(sums, out=sums)
            found = (sums[a + sizes[i:j]] - sums[a]) % np.uint64(_PRIME)
            out[k, i:j] = found * _powers(pow(radix, -1, _PRIME), hi - lo)[a] % np.uint64(_PRIME)
            sums[0] = 0
    wide = (out[1] << np.uint64(31) | out[2]) << np.uint64(2) | (out[0] & np.uint64(3))
    return out[0], mix(wide ^ (sizes.astype(np.uint64) * _MIX2))


class Asked:
    """Distinct names by bucket. The bucket comes from the 31-bit name and the message holds the 64-bit one.

    What tells strings apart so grows with the number of buckets, which follows
    the input: a name meets about BUCKET_NAMES others, whatever the input.
    """

    def __init__(self, named: tuple[np.ndarray, np.ndarray], buckets: int) -> None:
        bucket, name = (named[0] * np.uint64(buckets) >> np.uint64(31)).astype(np.int64), named[1]
        order = np.argsort(name)
        if buckets > 1:
            order = order[np.argsort(bucket[order].astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")]
        bucket, name = bucket[order], name[order]
        new = np.ones(len(order), bool)
        new[1:] = (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1])
        self.distinct = name[new]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.buckets, first = np.unique(bucket[new], return_index=True)
        self.at = np.append(first, len(self.distinct))

    def question(self, block: int, flags: np.ndarray | None = None) -> list[tuple[int, int, int, bytes]]:
        """Messages that carry the names (and a flag for each) to their buckets."""
        kind = QUESTION if flags is None else FLAGGED
        more = lambda a, b: b"" if flags is None else flags[a:b].astype(np.uint8).tobytes()
        return [(block, k, kind, self.distinct[a:b].tobytes() + more(a, b)) for k, a, b in zip(self.buckets.tolist(), self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]

    def answer(self, rows: pa.Table) -> np.ndarray:
        """The answer for each distinct name that was asked."""
        out = np.zeros(len(self.distinct), bool)
        for bucket, kind, payload in zip(*(rows.column(c).to_pylist() for c in ("bucket", "kind", "payload")), strict=True):
            if kind < CARRY:
                k = int(np.searchsorted(self.buckets, bucket))
                a, b = self.at[k], self.at[k + 1]
                out[a:b] = np.unpackbits(np.frombuffer(payload, np.uint8), count=b - a).astype(bool)
        return out
