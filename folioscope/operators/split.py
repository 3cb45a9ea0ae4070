"""Leak-free splits: whole documents, shares balanced by pages."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SPLIT_PARTS
from .labels import hashed_order

#: Documents allocated in one array, about. A longer run of documents of one size is cut by ranges of their hashes.
GREEDY_DOCUMENTS = 10_000
#: Documents of one size up to which the driver counts them off one by one.
STEPS = 1_000


def document_sizes(records: DataFrame, document: str = "document") -> DataFrame:
    return records.groupBy(document).agg(F.count(F.lit(1)).alias("n"))


def _first(most: int, holds: Callable[[int], bool]) -> int:
    """The first of 0 to most - 1 for which this holds, from which on it holds for all; else most."""
    return bisect_left(range(most), True, key=holds)


def advance(filled: list[int], target: list[float], n: int, documents: int) -> list[int]:
    """The parts' pages after so many more documents of n pages.

    A part's shortfalls before its documents never rise, and each step takes the
    highest (the earlier part if equal), so the steps are the merge of the parts'
    falling sequences, and a place in it is found by bisection.
    """
    parts = range(len(filled))
    short = lambda p, k: target[p] - float(filled[p] + k * n)
    taken = [0 for _ in parts]
    if documents <= STEPS:
        for _ in range(documents):
            taken[max(parts, key=lambda p: short(p, taken[p]))] += 1
    else:

        def place(p: int, k: int) -> int:
            v = short(p, k)
            return k + sum(_first(documents, (lambda j, q=q: short(q, j) < v) if q < p else (lambda j, q=q: short(q, j) <= v)) for q in parts if q != p)

        taken = [_first(documents, lambda k, p=p: place(p, k) >= documents) for p in parts]
    return [f + k * n for f, k in zip(filled, taken, strict=True)]


def allocate(sizes: DataFrame, ratios: dict[str, float], seed: int, document: str = "document") -> DataFrame:
    """document, part, n: largest documents first, each to the part that is furthest below its target.

    What a document gets depends on the parts' pages before it, and these on the
    sizes before it only. So the driver works out the pages at which each run of
    documents of one size begins (and each range of hashes of a long run), and the
    runs are folded side by side, each inside one expression over an ordered array.
    """
    spark, h = sizes.sparkSession, hashed_order(seed, F.col(document))
    runs = [(r["n"], r["documents"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("n")).collect()]
    pages = float(sum(n * k for n, k in runs))
    target = [pages * float(ratios[p]) for p in SPLIT_PARTS]
    bits = [(n, min(32, ((k - 1) // GREEDY_DOCUMENTS).bit_length())) for n, k in runs if k > GREEDY_DOCUMENTS]
    rows = sizes.select(F.col(document).alias("d"), "n", h.alias("h"), F.lit(0).cast("long").alias("range"))
    ranges: dict[int, list[tuple[int, int]]] = {}
    if bits:
        place = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / F.pow(F.lit(2.0), 32 - F.col("bits")))
        rows = rows.join(spark.createDataFrame(bits, "n long, bits int"), "n", "left").select("d", "n", "h", F.coalesce(place, F.lit(0)).cast("long").alias("range"))
        for r in rows.where(F.col("n").isin([n for n, _ in bits])).groupBy("n", "range").agg(F.count(F.lit(1)).alias("documents")).orderBy("n", "range").collect():
            ranges.setdefault(r["n"], []).append((r["range"], r["documents"]))
    filled, begins = [0 for _ in SPLIT_PARTS], []
    for n, k in runs:
        for at, documents in ranges.get(n, [(0, k)]):
            begins.append((n, at, *map(float, filled)))
            filled = advance(filled, target, n, documents)
    begin = spark.createDataFrame(begins, "n long, range long, " + ", ".join(f"{p} double" for p in SPLIT_PARTS))
    runs_of_rows = rows.groupBy("n", "range").agg(F.array_sort(F.collect_list(F.struct("h", "d"))).alias("rows")).join(begin, ["n", "range"])

    def step(acc, x):  # noqa: ANN001, ANN202
        short = [F.lit(t) - acc[p] for t, p in zip(target, SPLIT_PARTS, strict=True)]
        part = F.when((short[0] >= short[1]) & (short[0] >= short[2]), SPLIT_PARTS[0]).when(short[1] >= short[2], SPLIT_PARTS[1]).otherwise(SPLIT_PARTS[2])
        return F.struct(
            *[(acc[p] + F.when(part == p, F.col("n")).otherwise(F.lit(0)).cast("double")).alias(p) for p in SPLIT_PARTS],
            F.concat(acc["out"], F.array(F.struct(x["d"].alias("d"), part.alias("part")))).alias("out"),
        )

    kind = sizes.schema[document].dataType.simpleString()
    zero = F.struct(*[F.col(p) for p in SPLIT_PARTS], F.array().cast(f"array<struct<d:{kind},part:string>>").alias("out"))
    return runs_of_rows.select("n", F.explode(F.aggregate("rows", zero, step, lambda acc: acc["out"])).alias("r")).select(F.col("r.d").alias(document), F.col("r.part").alias("part"), "n")


def shares(split: DataFrame) -> DataFrame:
    """part, n_documents, n_images."""
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_images"))


def assemble(split: DataFrame, records: DataFrame, document: str = "document", image: str = "image") -> DataFrame:
    """part, documents, images, n_documents, n_images of every part, lists sorted; a part without documents has empty lists.

    The lists are what a split file holds, so a row is as large as that file; for
    parts beyond what a task holds there are members() and shards of it.
    """
    own = records.select(document, image).join(split.select(document, "part"), document)
    lists = own.groupBy("part").agg(F.array_sort(F.collect_set(document)).alias("documents"), F.array_sort(F.collect_list(image)).alias("images"))
    kinds = dict(lists.dtypes)
    parts = lists.sparkSession.createDataFrame([(p,) for p in SPLIT_PARTS], "part string")
    full = parts.join(lists, "part", "left").select("part", *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("documents", "images")])
    return full.select("*", F.size("documents").alias("n_documents"), F.size("images").alias("n_images"))


def members(split: DataFrame, records: DataFrame, document: str = "document", image: str = "image") -> DataFrame:
    """part, document, image: a row for each page of a document in the split."""
    return records.select(F.col(document).alias("document"), F.col(image).alias("image")).join(split.select(F.col(document).alias("document"), "part"), "document").select("part", "document", "image")


def leaks(assigned: DataFrame, document: str = "document") -> DataFrame:
    """Documents that stand in more than one part, with the number of parts."""
    return assigned.groupBy(document).agg(F.count_distinct("part").alias("parts")).where("parts > 1")


def held_out(split: DataFrame, document: str = "document") -> DataFrame:
    return split.where(F.col("part").isin("val", "test")).select(document).distinct()


def references(pages: DataFrame, held: DataFrame, human_clean: DataFrame, count: int, most: float, key: str = "image", document: str = "document") -> DataFrame:
    """Clean pages outside val and test: those that a person found clean first, then by suspicion; at most count."""
    clean = F.forall(F.map_values("scores"), lambda x: x <= most) & (F.size("scores") > 0)
    marked = pages.join(held, document, "left_anti").join(human_clean.select(key, F.lit(True).alias("__human")).distinct(), key, "left").withColumn("human", F.coalesce("__human", F.lit(False))).drop("__human")
    worst = F.coalesce(F.array_max(F.map_values("scores")), F.lit(0.0))
    return marked.where(F.col("human") | clean).withColumn("suspicion", worst).orderBy(F.desc("human"), "suspicion", key).limit(count)
