"""Repeated-substring removal by a difference-cover suffix array, built bucket by bucket.

A string of LENGTH bytes that occurs twice has, whatever its two places, a
shift below PERIOD at which both places fall on positions of a difference cover
(a Singer set: PERIOD = q*q + q + 1, q + 1 positions in each period). So:

1. Cover suffixes are bucketed by a name of their first CORE = LENGTH - PERIOD + 1
   bytes, one bucket sorted at a time. A suffix alone with its name can't lie in
   a repeat; the rest are ranked as tied.
2. For tied suffixes the longest context any shift can reach (PERIOD - 1 bytes
   before, LENGTH bytes after) is named and sorted the same way. Equal contexts
   settle all strings in them at once, so long ties cost no more than short ones.
3. Some strings remain open (near the ends of repeats). Their cover suffixes tell
   every suffix tied with them, and the strings of all these are named and sorted
   themselves, bucket by bucket.

Buckets hold 64-bit names of bytes, not the bytes, so memory is bounded by a
bucket's number of names; equal names stand for equal strings. A name is made of
polynomials modulo a prime, and the bucket is chosen by a further one: two
different strings of n live ones, with BUCKET_NAMES to a bucket, get the same
bucket and name with probability about n * BUCKET_NAMES / 2**65, so 0.3 at 10**13
of them. Text moves in one shuffle.

Defined results: null text is empty; a text shorter than LENGTH holds no string
to remove. Matches never cross documents. Repeated rows repeat each other's
bytes. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks
from .blocks import CARRY, Asked, answers, ask, meet, messages, names
from .common import text_buffer

LENGTH = 400
LIVE, LONG, ACTIVE = CARRY, CARRY + 1, CARRY + 2  # kinds of carried bitmaps


@lru_cache
def singer(q: int) -> tuple[int, tuple[int, ...]]:
    """The period q*q+q+1 and a set of q+1 residues whose differences are all residues; q is a prime.

    The powers of a generator of the field with q**3 elements that lie in a plane.
    """
    v = q * q + q + 1
    for c2 in range(q):
        for c1 in range(q):
            for c0 in range(1, q):
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    x = (c0 * x[2] % q, (x[0] + c1 * x[2]) % q, (x[1] + c2 * x[2]) % q)
                if len(found) == q + 1 and len({(a - b) % v for a in found for b in found}) == v:
                    return v, tuple(found)
    raise ValueError(f"no set for {q}")


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves at least a quarter of length (or all but a period of 7) for the core."""
    q = next((q for q in (17, 13, 11, 7, 5, 3) if q * q + q < length - length // 5), 2)
    return singer(q)


class Text:
    """The texts of a block as one array, with the cover positions of each."""

    def __init__(self, rows: pa.Table, length: int, buckets: int) -> None:
        self.length, self.buckets = length, buckets
        self.period, cover = cover_for(length)
        self.core = length - self.period + 1
        self.rows = rows
        self.data, self.at = text_buffer(rows.column("text"))
        n = np.diff(self.at)
        self.long = np.flatnonzero(n >= length)
        found = []
        for i in self.long.tolist():
            last = n[i] - self.core
            p = (np.arange(0, last + 1, self.period)[:, None] + np.array(cover)).ravel()
            found.append(self.at[i] + p[p <= last])
        counts = [len(x) for x in found]
        self.cover = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.owner = np.repeat(self.long, counts) if found else np.zeros(0, np.int64)

    def cores(self, live: np.ndarray | slice = slice(None)) -> Asked:
        """Names of the cover suffixes."""
        return Asked(names(self.data, self.cover[live], self.core), self.buckets)

    def contexts(self, live: np.ndarray) -> tuple[Asked, np.ndarray, np.ndarray]:
        """Names of the contexts of live suffixes that are wide enough for a string, with first and last string start."""
        p, own = self.cover[live], self.owner[live]
        left = np.minimum(p - self.at[own], self.period - 1)
        right = np.minimum(self.at[own + 1] - p, self.length)
        wide = left + right >= self.length
        p, left, right = p[wide], left[wide], right[wide]
        start = p - left
        order = np.argsort(start, kind="stable")
        named = np.empty((2, len(p)), np.uint64)
        named[:, order] = names(self.data, start[order], (left + right)[order])
        return Asked((named[0], blocks.mix(named[1] ^ left.astype(np.uint64))), self.buckets), start, p + right - self.length

    def spread(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A flag for each byte, set from first to last of each pair."""
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, first, 1)
        np.add.at(step, last + 1, -1)
        return np.cumsum(step[:-1]) > 0

    def ranges(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last start of the strings that hold each chosen cover suffix's core, and whether there is any."""
        p, own = self.cover[which], self.owner[which]
        first = np.maximum(p - self.period + 1, self.at[own])
        last = np.minimum(p, self.at[own + 1] - self.length)
        return first, last, first <= last

    def unsettled(self, live: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """Of live suffixes: whether a string that holds the core isn't settled."""
        first, last, any_ = self.ranges(live)
        left = np.concatenate([[0], np.cumsum(~settled)])
        return any_ & (left[np.where(any_, last, first) + 1] > left[first]) if len(first) else np.zeros(0, bool)

    def strings(self, active: np.ndarray) -> tuple[np.ndarray, Asked]:
        """Starts of the strings that hold the core of an active suffix, and their names."""
        first, last, any_ = self.ranges(active)
        starts = np.flatnonzero(self.spread(first[any_], last[any_]))
        return starts, Asked(names(self.data, starts, self.length), self.buckets)


def _shared(rows: pa.Table, asked: Asked) -> np.ndarray:
    """Whether each item's name is another's, too, in this block or elsewhere."""
    if not len(asked.place):
        return np.zeros(0, bool)
    return (asked.answer(rows) | (np.bincount(asked.place, minlength=len(asked.distinct)) > 1))[asked.place]


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _flags(data: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data or b"", np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if with_text) of every row."""
    rows, total = blocks.sized(docs)
    period, cover = cover_for(length)
    buckets = max(1, -(-(total * len(cover) // period) // blocks.BUCKET_NAMES))

    def first(part: pa.Table) -> pa.Table:
        text = Text(part, length, buckets)
        return messages(text.cores().question(part.column("block")[0].as_py()))

    def second(part: pa.Table, told: pa.Table) -> pa.Table:
        if not part.num_rows:
            return messages([])
        text, block = Text(part, length, buckets), part.column("block")[0].as_py()
        live = _shared(told, text.cores())
        if not live.any():
            return messages([])
        out = text.contexts(live)[0].question(block)
        return messages([*out, (block, block % buckets, LIVE, _bits(live))])

    def third(part: pa.Table, told: pa.Table) -> pa.Table:
        if not part.num_rows or not told.num_rows:
            return messages([])
        text, block = Text(part, length, buckets), part.column("block")[0].as_py()
        live = _flags(blocks.carried(told, LIVE), len(text.cover))
        contexts, start, last = text.contexts(live)
        same = _shared(told, contexts)
        open_ = text.unsettled(live, text.spread(start[same], last[same]))
        cores = text.cores(live)
        out = cores.question(block, np.bincount(cores.place, weights=open_, minlength=len(cores.distinct)) > 0)
        return messages([*out, (block, block % buckets, LIVE, _bits(live)), (block, block % buckets, LONG, _bits(same))])

    def fourth(part: pa.Table, told: pa.Table) -> pa.Table:
        if not part.num_rows or not told.num_rows:
            return messages([])
        text, block = Text(part, length, buckets), part.column("block")[0].as_py()
        live = _flags(blocks.carried(told, LIVE), len(text.cover))
        cores = text.cores(live)
        active = live.copy()
        active[live] = cores.answer(told)[cores.place]
        out = text.strings(active)[1].question(block)
        return messages([*out, *((block, block % buckets, kind, x) for kind, x in ((LIVE, _bits(live)), (LONG, blocks.carried(told, LONG)), (ACTIVE, _bits(active))))])

    def final(part: pa.Table, told: pa.Table) -> pa.Table:
        text = Text(part, length, buckets)
        repeated = np.zeros(len(text.data), bool)
        if told.num_rows:
            live = _flags(blocks.carried(told, LIVE), len(text.cover))
            _, start, last = text.contexts(live)
            same = _flags(blocks.carried(told, LONG), len(start))
            starts, strings = text.strings(_flags(blocks.carried(told, ACTIVE), len(text.cover)))
            hit = starts[_shared(told, strings)]
            repeated = text.spread(np.concatenate([start[same], hit]), np.concatenate([last[same], hit]) + length - 1)
        n, removed, spans, digests, left = [], [], [], [], []
        for a, b in zip(text.at[:-1].tolist(), text.at[1:].tolist(), strict=True):
            gone = repeated[a:b]
            count = int(gone.sum())
            kept = (text.data[a:b][~gone] if count else text.data[a:b]).tobytes()
            n.append(b - a)
            removed.append(count)
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if count else 0)
            digests.append(hashlib.sha256(kept).hexdigest())
            left.append(kept)
        columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        return pa.table([*columns, *[pa.array(left, pa.binary())] * with_text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    told = answers(ask(rows, first))
    told = answers(meet(rows, told, second, blocks.MESSAGE))
    told = answers(meet(rows, told, third, blocks.MESSAGE))
    told = answers(meet(rows, told, fourth, blocks.MESSAGE))
    return meet(rows, told, final, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
