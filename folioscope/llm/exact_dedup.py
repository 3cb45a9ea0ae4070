"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks. Every chunk gets a polynomial hash for each of two
radices modulo the prime 2^31-1; the hash of two neighbours is
``left * radix**len(right) + right``, so chunks can be hashed in any place and
in any order and still give the hash of the whole text. Rows with an equal
fingerprint (both hashes and the length) form a group; each member's text is
then compared, chunk by chunk, with that of the group's largest doc_id, and a
member that differs (a collision) is grouped again by its digest.

Defined results: null text is empty text, and all empty texts are equal. Rows
that share doc_id and text are the same document given twice: each is reported,
one of them is kept. A null doc_id is smaller than any other. Columns besides
doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, ids_and_texts, slices, text_buffer, tidy, written

PRIME = (1 << 31) - 1
RADICES = (1_103_515_245, 747_796_405)
#: Bytes hashed at once, and bytes compared at once. Products of a byte and a 31-bit power stay below 2^39, so a sum over a chunk fits in 63 bits.
HASH_CHUNK = 1 << 16
COMPARE_CHUNK = 1 << 20
#: Members of a group that are compared with one copy of its largest document.
MEMBERS_PER_COPY = 512
#: A group with more than one HOTth of all rows is joined by broadcast; there are fewer than HOT of these.
HOT = 1000


def _powers(radix: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * pow(radix, have, PRIME) % PRIME
        have += more
    return out


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend(_powers(r, HASH_CHUNK) for r in RADICES)
    return _TABLES


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint (hash, hash, length) of a text from those of its two parts."""
    n = right[2]
    return (*((left[i] * pow(RADICES[i], n, PRIME) + right[i]) % PRIME for i in (0, 1)), left[2] + n)


def fingerprints(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row (hash, hash, length) for each text data[at[i]:at[i+1]]."""
    n = np.diff(at)
    out = np.zeros((len(n), 3), np.int64)
    out[:, 2] = n
    full = np.flatnonzero(n > 0)
    pieces = -(-n[full] // HASH_CHUNK)
    owner = np.repeat(full, pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = at[owner] + nth * HASH_CHUNK
    size = np.minimum(at[owner + 1] - start, HASH_CHUNK)
    if not len(start):
        return out
    back = np.repeat(start + size - 1, size) - np.arange(len(data))  # bytes to the end of the own chunk
    sums = [np.add.reduceat(table[back] * data, start) % PRIME for table in _tables()]
    single = pieces == 1
    first = np.cumsum(pieces) - pieces
    for i in (0, 1):
        out[full[single], i] = sums[i][first[single]]
    for row, k, m in zip(full[~single], first[~single], pieces[~single], strict=True):
        whole = (0, 0, 0)
        for j in range(k, k + m):
            whole = combine(whole, (int(sums[0][j]), int(sums[1][j]), int(size[j])))
        out[row, :2] = whole[:2]
    return out


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """doc_id, fp, n_bytes, text_sha256 of every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, at = text_buffer(part.column("text"))
            fp = fingerprints(data, at)
            view = memoryview(np.ascontiguousarray(data))
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array((fp[:, 0] << 31) | fp[:, 1]), pa.array(fp[:, 2]), pa.array(digests, pa.string())], ["doc_id", "fp", "n_bytes", "text_sha256"])

    return ids_and_texts(docs).mapInArrow(tidy(run), "doc_id long, fp long, n_bytes long, text_sha256 string")


def _chunks(rows: DataFrame) -> DataFrame:
    """A row for each chunk of each text; an empty text has one."""
    body = F.col("text").cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("text") / F.lit(COMPARE_CHUNK)) - 1).cast("int")
    cut = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return cut.withColumn("chunk", F.substring(body, F.col("chunk_no") * COMPARE_CHUNK + 1, F.lit(COMPARE_CHUNK))).drop("text")


def differing(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Of members (m_id, text_sha256, keep_id, keep_sha256, group_size), those whose text isn't that of keep_id.

    Texts of members alone are compared. Copies of keep_id's chunks are dealt
    with a salt, one for each MEMBERS_PER_COPY members, so that no task gets a
    whole large group.
    """
    texts = ids_and_texts(docs).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    distinct = members.dropDuplicates(["text_sha256", "m_id"])
    own = distinct.join(texts, F.col("m_id").eqNullSafe(F.col("doc_id")) & (F.col("text_sha256") == F.col("sha"))).dropDuplicates(["sha", "doc_id"])
    own = own.withColumn("salts", F.ceil(F.col("group_size") / MEMBERS_PER_COPY).cast("int"))
    first = own.where(F.col("m_id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha256")))
    first = _chunks(first.select("keep_id", "keep_sha256", "salts", "text"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(F.col("keep_id").alias("k_id"), F.col("keep_sha256").alias("k_sha"), F.col("salt").alias("k_salt"), F.col("chunk_no").alias("k_no"), F.col("chunk").alias("k_chunk"))
    rest = own.where(~(F.col("m_id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha256"))))
    rest = _chunks(rest.select("m_id", "text_sha256", "keep_id", "keep_sha256", "salts", "text")).withColumn("salt", F.pmod(F.xxhash64("m_id", "text_sha256"), F.col("salts").cast("long")).cast("int"))
    same = rest.join(first, F.col("keep_id").eqNullSafe(F.col("k_id")) & (F.col("keep_sha256") == F.col("k_sha")) & (F.col("salt") == F.col("k_salt")) & (F.col("chunk_no") == F.col("k_no")), "left")
    return same.where(~F.coalesce(F.col("chunk") == F.col("k_chunk"), F.lit(False))).select(F.col("m_id").alias("d_id"), F.col("text_sha256").alias("d_sha")).distinct()


def _attach(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, how: str) -> DataFrame:
    """rows joined with their groups by keys, which are never null. Groups of over a thousandth of all rows, at most HOT of them, are broadcast."""
    hot = F.col("group_size") * HOT > total
    few = F.broadcast(groups.where(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(groups.where(~hot), keys, how)
    return rows.join(few, keys).unionByName(rest)


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    top = F.max(F.struct("doc_id", "text_sha256"))
    return rows.groupBy(*keys).agg(top.alias("top"), F.count(F.lit(1)).alias("group_size")).select(*keys, F.col("top.doc_id").alias("keep_id"), F.col("top.text_sha256").alias("keep_sha256"), "group_size")


def _classes(docs: DataFrame) -> tuple[DataFrame, list[str], int]:
    """The fingerprint rows, the columns by which equal texts are equal, and the number of rows.

    Fingerprints are computed once and written. Where the comparison finds that
    members of a group differ, these are also told apart by their digest.
    """
    rows = written(fingerprint_rows(docs), "fingerprints")
    total = rows.count()
    keys = ["fp", "n_bytes"]
    groups = written(_grouped(rows, keys).where("group_size > 1"), "fingerprint-groups")
    members = _attach(rows, groups, keys, total, "inner")
    off = written(differing(docs, members.select(F.col("doc_id").alias("m_id"), "text_sha256", "keep_id", "keep_sha256", "group_size")), "fingerprint-collisions")
    if off.isEmpty():
        return rows, keys, total
    classed = rows.join(off, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_sha256") == F.col("d_sha")), "left")
    return classed.select(*rows.columns, F.coalesce("d_sha", F.lit("")).alias("class")), [*keys, "class"], total


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    rows, keys, total = _classes(docs)
    out = _attach(rows, _grouped(rows, keys).where("group_size > 1"), keys, total, "left")
    out = out.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("n_bytes"))
    return out.withColumn("nth", nth).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups doesn't keep; all columns stay."""
    own, sha = fresh(docs, "own_id", "own_sha")
    key = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("null"))  # noqa: E731  never null, so join and dropDuplicates share one shuffle
    rows, keys, _ = _classes(docs)
    kept = _grouped(rows, keys).select(key(F.col("keep_id")).alias(own), F.col("keep_sha256").alias(sha))
    marked = docs.withColumn(own, key(F.col("doc_id"))).withColumn(sha, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    return marked.join(kept, [own, sha]).dropDuplicates([own, sha]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
