"""Label logs and prelabels: last-write-wins, resume, frequencies, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key, with first_pos, the position at which the key first appeared.

    One aggregation with map-side combining; the whole row travels as a struct.
    """
    place = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in log.columns])
    out = log.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, place).alias("r"), F.min(place).alias("first_pos"))
    return out.select("r.*", "first_pos")


def todo(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of items whose key isn't done yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def lacking(records: DataFrame, label: str, column: str = "labels") -> DataFrame:
    """Records whose label map has no entry for label."""
    return records.where(~F.map_contains_key(F.col(column), F.lit(label)))


def enrich(base: Column, more: Column) -> Column:
    """Two maps as one; entries of more win."""
    keep = F.map_filter(base, lambda k, v: ~F.map_contains_key(more, k))
    return F.map_concat(keep, more)


def resume_position(queue: DataFrame, done: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """The first queue position not done, 0 if all are."""
    return todo(queue, done, key).agg(F.coalesce(F.min(position), F.lit(0)).alias(position))


def signal_columns(prelabels: DataFrame, records: DataFrame, signals: list[str], scored: list[str], manual: list[str], key: str = "image") -> DataFrame:
    """One wide row for each page that has both scores and recognised text: signals, scores, human_<label>, quality_score.

    prelabels (key, scores, quality_score) and records (key, labels, derived) hold
    a key once each (see last_wins); records whose derived map is null or empty
    are left out. What a map lacks is null.
    """
    number = lambda m, x: F.try_element_at(m, F.lit(x)).cast("double")
    own = records.where(F.size("derived") > 0).select(F.col(key).alias("__key"), "derived", "labels")
    both = prelabels.join(own, F.col(key) == F.col("__key"))
    return both.select(
        key, *[number(F.col("derived"), x).alias(x) for x in signals], *[number(F.col("scores"), x).alias(x) for x in scored],
        *[number(F.col("labels"), x).alias(f"human_{x}") for x in manual], "quality_score",
    )


def frequencies(records: DataFrame, labels: list[str], column: str = "labels") -> DataFrame:
    """label, n in the given order, zero for labels that never occur; one pass, one row of partial sums a task."""
    sums = records.agg(*[F.coalesce(F.sum(F.coalesce(F.try_element_at(F.col(column), F.lit(x)), F.lit(False)).cast("long")), F.lit(0)).alias(x) for x in labels])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(x).alias("label"), F.col(x).alias("n")) for i, x in enumerate(labels)])).alias("r")).select("r.*")


def status(label: Column, counts: dict[str, Column], total: Column, share: float, auto: list[str]) -> Column:
    """What a label's counts in the parts mean for training."""
    n = counts["train"] + counts["val"] + counts["test"]
    return (
        F.when(label.isin(*auto), "automatic").when(n == 0, "none").when((counts["val"] == 0) | (counts["test"] == 0), "missing")
        .when(F.coalesce(F.try_divide(n.cast("double"), total.cast("double")), F.lit(0.0)) < share, "rare").otherwise("ok")
    )


def frequency_report(rows: list[dict], parts: tuple[str, ...] = ("train", "val", "test")) -> str:
    """Label counts of the parts (label, one column a part, status) as a markdown table."""
    out = ["| label | " + " | ".join(parts) + " | status |", "| --- |" + " ---: |" * len(parts) + " --- |"]
    out += [f"| {r['label']} | " + " | ".join(str(r[p]) for p in parts) + f" | {r['status']} |" for r in rows]
    return "\n".join(out)


def first_per_label(rows: DataFrame, most: int = 10, label: str = "label", order: str = "image") -> DataFrame:
    """The first rows of each label, as a contact sheet shows them."""
    nth = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most)


def hashed_order(seed: int, key: Column) -> Column:
    """A random order that any engine can repeat: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def random_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the same for the same seed; a top-n, so no task holds more than n rows."""
    return df.orderBy(hashed_order(seed, F.col(key)), F.col(key)).limit(n)


def top_candidates(prelabels: DataFrame, labels: list[str], n: int, seed: int, key: str = "image") -> DataFrame:
    """The n best rows for each label: label, rank, key, score. A missing score counts as 0."""
    long = prelabels.select(key, F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.coalesce(F.try_element_at("scores", F.lit(x)), F.lit(0.0)).alias("score")) for x in labels])).alias("e")).select(key, "e.label", "e.score")
    w = Window.partitionBy("label").orderBy(F.desc("score"), hashed_order(seed, F.col(key)), F.col(key))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def select_queue(prelabels: DataFrame, labels: list[str], total: int = 300, random_share: float = 0.5, seed: int = 42, key: str = "image") -> DataFrame:
    """pos, key: part random, the rest taken in turns from each label's worst pages.

    Only len(labels) * total keys reach the driver, whatever the size of the
    table: at most total - 1 of a label's best can already be taken.
    """
    spark = prelabels.sparkSession
    total = min(total, prelabels.limit(total).count())
    first = [r[0] for r in random_sample(prelabels, key, int(total * random_share), seed).select(key).collect()]
    need = total - len(first)
    rest = prelabels.join(F.broadcast(spark.createDataFrame([(x,) for x in first], f"{key} {prelabels.schema[key].dataType.simpleString()}")), key, "left_anti") if first else prelabels
    best: dict[str, list] = {x: [] for x in labels}
    for r in top_candidates(rest, labels, need, seed, key).orderBy("label", "rank").collect():
        best[r["label"]].append(r[key])
    chosen = dict.fromkeys(first)
    turn = {x: iter(v) for x, v in best.items()}
    while len(chosen) < total and turn:
        for label in list(turn):
            pick = next((x for x in turn[label] if x not in chosen), None)
            if pick is None:
                del turn[label]
            elif len(chosen) < total:
                chosen[pick] = None
    rows = spark.createDataFrame([(x,) for x in chosen], f"{key} {prelabels.schema[key].dataType.simpleString()}")
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(hashed_order(seed + 1, F.col(key)), F.col(key))) - 1)
