"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and white space becomes single spaces. An item of m
characters may differ from a passage by up to ERROR_SHARE * m edits. Cut into
one piece more than that, at least one piece must occur unchanged in any such
passage; all pieces of all items are looked up at once with an Aho-Corasick
automaton. Around each hit, Myers' bit-parallel algorithm gives the smallest
number of edits between the item and a passage of the text there.

Defined results: null or empty texts and null or empty items match nothing. An
item of fewer than SHORT characters (a word, a number, a yes or no) is no passage
that gives a benchmark away: it matches a text that is nothing else, without edits.
Items with equal normalised texts all match where one does. Repeated rows of
documents give repeated rows of hits. Columns besides doc_id and text, item_id
and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ids_and_texts, slices, tidy

#: Edits allowed for each character of an item.
ERROR_SHARE = 0.06
#: Normalised characters that an item needs to count as a passage inside a longer text.
SHORT = 20
#: Characters of items held by one automaton; more items mean more passes over the documents, not more memory.
ITEM_CHARS = 1_000_000


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces, as even as can be, with their places."""
    n, k = len(item), errors + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def myers(item: str, text: str) -> int:
    """The smallest edit distance between item and any passage of text, by bit-parallel columns."""
    m = len(item)
    if not m:
        return 0
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    ones, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best = score
    get = where.get
    for c in text:
        eq = get(c, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & ones
        up = (minus | ~(diagonal | plus)) & ones
        down = plus & diagonal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
            if score < best:
                best = score
        up = (up << 1) & ones
        down = (down << 1) & ones
        plus = (down | ~(diagonal | up)) & ones
        minus = up & diagonal
    return best


class Matcher:
    """The automaton of one set of items: normalised text -> item ids."""

    def __init__(self, items: dict[str, list[int]], error_share: float) -> None:
        import ahocorasick

        self.items = [(text, int(len(text) * error_share), ids) for text, ids in items.items() if len(text) >= SHORT]
        self.short = {text: ids for text, ids in items.items() if 0 < len(text) < SHORT}
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (text, errors, _) in enumerate(self.items):
            for place, piece in pieces(text, errors):
                at[piece].append((n, place + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in at.items():
            self.automaton.add_word(piece, owners)
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, errors allowed) of the items that text holds."""
        if text in self.short:
            return [(i, 0, 0) for i in self.short[text]]
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, owners in self.automaton.iter(text):
            for n, after in owners:
                starts[n].add(end + 1 - after)
        out = []
        for n, found in sorted(starts.items()):
            item, errors, ids = self.items[n]
            best = errors + 1
            for a, b in self._windows(sorted(found), len(item), errors):
                window = text[max(0, a) : b]
                best = min(best, 0 if item in window else myers(item, window) if errors else best)
                if not best:
                    break
            if best <= errors:
                out += [(i, best, errors) for i in ids]
        return out

    @staticmethod
    def _windows(starts: list[int], m: int, errors: int) -> Iterator[tuple[int, int]]:
        """Where the item may lie, with overlapping places joined."""
        a = b = None
        for s in starts:
            lo, hi = s - errors, s + m + errors
            if b is not None and lo <= b:
                b = hi
                continue
            if b is not None:
                yield a, b
            a, b = lo, hi
        if b is not None:
            yield a, b


def item_groups(benchmark: DataFrame, most: int = ITEM_CHARS) -> Iterator[dict[str, list[int]]]:
    """The items, a bounded number of characters at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // most)) if total > most else 1
    for k in range(parts):
        group: dict[str, list[int]] = defaultdict(list)
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).toLocalIterator():
            if text := normalise(r["text"]):
                group[text].append(r["item_id"])
        if group:
            yield {text: sorted(set(ids)) for text, ids in sorted(group.items())}


def leaks(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE) -> DataFrame:
    """doc_id, item_id, distance, errors_allowed: a row for each document and item that it holds."""
    schema = "doc_id long, item_id long, distance int, errors_allowed int"
    out = None
    for items in item_groups(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: dict[str, list[int]] = items) -> Iterator[pa.RecordBatch]:
            own = Matcher(items, error_share)
            for part in slices(batches):
                rows = [(doc_id, *hit) for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for hit in own.matches(normalise(text))]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance", "errors_allowed"])

        found = ids_and_texts(docs).mapInArrow(tidy(run), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE) -> DataFrame:
    """docs without the rows that hold an item; all columns stay. One pass for each group of items, no shuffle."""
    for items in item_groups(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: dict[str, list[int]] = items) -> Iterator[pa.RecordBatch]:
            own = Matcher(items, error_share)
            for part in slices(batches):
                clean = pa.array([not own.matches(normalise(x)) for x in part.column("text").to_pylist()], pa.bool_())
                yield part.filter(clean)

        docs = docs.mapInArrow(tidy(run), StructType(list(docs.schema.fields)))
    return docs
