"""Importance resampling towards a target text distribution, by hashed n-gram buckets.

Inside each partition DuckDB does the counting: SQL cuts a text into words,
unnests them, pairs neighbours by window functions, hashes each n-gram by a
registered zlib CRC-32 and counts by bucket. The counts of every document are
spilled to Parquet in the shared folder, so the texts are read and hashed once.
Spark merges them: sums over the corpus and over the target give each bucket a
gain, the gains give each document a weight, and Gumbel noise from a hash of the
id turns the highest scores into a draw without replacement. The draw is ranked
over ranges of scores, not in one task.

Memory: DuckDB sees PART_BYTES of text at a time. A longer text is cut between
words, and each piece begins with the last words of the one before, so no n-gram
is lost. A document's counts have at most as many entries as there are buckets.

Defined results: null text has no words. Without features the weight is 0. A
document with fewer words than `least` isn't drawn. Repeated rows are documents
of their own: each has its row, and both can be drawn. A null doc_id is hashed as
empty text, and is smaller than any other. An empty target or corpus counts as
zeros. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running
from .common import ids_and_texts, slices, text_buffer, tidy, written

# Words are runs of 0-9, a-z and whatever isn't ASCII, after A-Z have become small letters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Text that DuckDB holds at once, and the memory that it may take for it; it never spills, as the folder would be the machine's own.
PART_BYTES = 1 << 19
MEMORY = "768MB"


def counting_sql(n_words: int, buckets: int) -> str:
    """row, bucket, n, words from the table part(row, carried, text); n-grams that end in the carried words were counted before."""
    leads = "".join(f", lead(word, {k}) OVER (PARTITION BY row ORDER BY i) AS w{k}" for k in range(1, n_words))
    grams = []
    for k in range(1, n_words + 1):
        whole = " || ' ' || ".join(["word", *[f"w{j}" for j in range(1, k)]])
        grams.append(f"SELECT row, {whole} AS gram, {int(k == 1)} AS single FROM near WHERE i + {k - 1} > carried" + (f" AND w{k - 1} IS NOT NULL" if k > 1 else ""))
    return f"""WITH words AS (SELECT row, carried, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT row, carried, regexp_extract_all(text, '{WORD}') AS w FROM part)),
near AS MATERIALIZED (SELECT row, carried, i, word{leads} FROM words), grams AS ({' UNION ALL '.join(grams)})
SELECT row, (crc(gram) % {buckets})::INT AS bucket, count(*) AS n, sum(single)::BIGINT AS words FROM grams GROUP BY 1, 2"""


def _crc(grams: pa.ChunkedArray | pa.Array) -> pa.Array:
    data, at = text_buffer(grams)
    body, ends, crc = data.tobytes(), at.tolist(), zlib.crc32
    return pa.array([crc(body[a:b]) for a, b in zip(ends, ends[1:])], pa.uint32())  # noqa: B905


def _session():  # noqa: ANN202
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
    con.create_function("crc", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def parts(data: bytes, at: list[int], n_words: int) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (row, carried words, text) of about PART_BYTES; a list holds one piece of a row at most."""
    have: list[tuple[int, int, str]] = []
    size = 0
    for row, (start, end) in enumerate(zip(at[:-1], at[1:], strict=True)):
        carried: list[bytes] = []
        while start < end:
            stop = end
            if end - start > PART_BYTES:
                cut = NOT_WORD.search(data, start + PART_BYTES, end)
                stop = cut.start() if cut else end
            piece = data[start:stop]
            if carried or stop < end or size + len(piece) > PART_BYTES:
                if have:
                    yield have
                have, size = [], 0
            have.append((row, len(carried), b" ".join([*carried, piece]).decode("utf-8", "replace")))
            size += len(piece)
            if stop < end and n_words > 1:
                tail = [w for w in NOT_WORD.split(piece) if w]
                carried = [*carried, *tail][-(n_words - 1) :]
            start = stop
    if have:
        yield have


def spilled_counts(docs: DataFrame, n_words: int, buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, buckets, counts of every row of docs, as a written table."""
    sql = counting_sql(n_words, buckets)
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = None
        for batch in slices(batches, 4 * PART_BYTES):
            con = con or _session()
            raw, at = text_buffer(batch.column("text"))
            data = raw.tobytes().lower()  # of bytes: A-Z alone
            n = batch.num_rows
            found, words = [np.zeros((2, 0), np.int64)], np.zeros(n, np.int64)
            for part in parts(data, at.tolist(), n_words):
                con.register("part", pa.table({"row": [p[0] for p in part], "carried": [p[1] for p in part], "text": pa.array([p[2] for p in part], pa.large_string())}))
                got = con.sql(sql).to_arrow_table()
                con.unregister("part")
                row, bucket, count = (got.column(c).to_numpy().astype(np.int64) for c in ("row", "bucket", "n"))
                np.add.at(words, row, got.column("words").to_numpy().astype(np.int64))
                found.append(np.array([row * buckets + bucket, count]))
            key, count = np.concatenate(found, axis=1)
            own, inverse = np.unique(key, return_inverse=True)
            sums = np.zeros(len(own), np.int64)
            np.add.at(sums, inverse, count)
            offsets = np.searchsorted(own, np.arange(n + 1) * buckets).astype(np.int32)
            features = np.zeros(n, np.int64)
            np.add.at(features, own // buckets, sums)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in ((own % buckets).astype(np.int32), sums)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(words), pa.array(features), *lists], schema=out_schema)
        if con:
            con.close()

    return written(ids_and_texts(docs).mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"), "bucket-counts")


def _sums(counts: DataFrame, name: str) -> DataFrame:
    each = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("e")).select(F.col("e.buckets").alias("bucket"), F.col("e.counts").alias("n"))
    return each.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, from spilled counts; as many numbers as there are buckets reach the driver."""
    rows = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(_sums(corpus, "s"), "bucket", "left").join(_sums(target, "t"), "bucket", "left").na.fill(0, ["s", "t"]).select("bucket", "s", "t").collect()
    total_s, total_t = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    facts = corpus.sparkSession.createDataFrame([tuple(r) for r in rows], "bucket int, s long, t long")
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * F.lit(float(total_s + buckets)) / ((d("s") + 1) * F.lit(float(total_t + buckets)))
    out = np.zeros(buckets, np.int64)
    for r in facts.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("g")).collect():
        out[r["bucket"]] = r["g"]
    return out


def weights(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, n = b.column("buckets"), b.column("counts")
            at = lists.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            got = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()] * n.flatten().to_numpy())])
            features = b.column("n_features").to_numpy()
            mean = (got[at[1:]] - got[at[:-1]]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(mean)], ["doc_id", "n_words", "n_features", "weight"])

    return counts.mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, n_words: int = 2, buckets: int = 10_000, share: int = 25, least: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for what isn't drawn.

    docs and target hold doc_id and text. Of the documents with enough words,
    floor(share * number / 100) are drawn.
    """
    counts = spilled_counts(docs, n_words, buckets)
    rows = weights(counts, gains(counts, spilled_counts(target, n_words, buckets), buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")
    fit = (F.col("n_words") >= least).cast("long")
    scored = rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), fit.alias("fit"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("salt"))
    placed = running(scored, [], [F.desc("fit"), F.desc("score"), F.col("doc_id"), F.col("salt")], {"place": "one"}, {"all_fit": "fit"})
    drawn = F.col("place") <= F.floor(F.col("all_fit") * share / 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))


_TABLE = "list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(gram))), lambda j: ('0x' || substr(hex(encode(gram)), (2 * j + 1)::INT, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _grams(name: str, table: str, key: str) -> str:
    return f"""{name}_w AS MATERIALIZED (SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM {table}),
{name}_g AS MATERIALIZED (SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM {name}_w)"""


ORACLE_SQL = f"""WITH tab AS MATERIALIZED (SELECT {_TABLE} AS tab), {_grams("d", "documents", "doc_id")}, {_grams("b", "benchmark", "item_id")},
crc AS MATERIALIZED (SELECT gram, {_CRC} % 10000 AS bucket FROM (SELECT gram FROM d_g UNION SELECT gram FROM b_g), tab),
s AS (SELECT bucket, count(*) AS s FROM d_g JOIN crc USING (gram) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b_g JOIN crc USING (gram) GROUP BY 1),
sums AS (SELECT (SELECT count(*) FROM d_g) AS ss, (SELECT count(*) FROM b_g) AS tt),
gain AS MATERIALIZED (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS g FROM range(10000) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), sums),
mean AS (SELECT id, count(*) AS n, sum(g)::BIGINT AS g FROM d_g JOIN crc USING (gram) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce((g - (g % n + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM (SELECT id AS doc_id, w FROM d_w) LEFT JOIN mean ON id = doc_id),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
best AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM noisy WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM best) THEN place END AS rank FROM noisy LEFT JOIN best USING (doc_id)"""
