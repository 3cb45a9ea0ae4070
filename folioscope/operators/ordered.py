"""Order statistics of groups of any size: running sums in two levels, average ranks, exact quantiles.

No step sorts a whole group in one task. Rows are summed by value first, so equal
values are one row each however many there are. These rows are dealt to ranges of
the order (Spark's range partitioning, from a sample), summed up inside each
range, and shifted by the sums of the ranges before it: a table of a row for each
range and group, which follows the number of partitions and not that of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written

#: A key that more than one HOTth of all rows have is joined by broadcast; there are fewer than HOT of these.
HOT = 1_000
#: Rows up to which a table of one row for each group is broadcast.
GROUPS = 100_000
#: The sketch is right to 1 / ACCURACY of a group, and a wanted place is looked for this many times as far to either side.
ACCURACY, MARGIN = 10_000, 5


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)], F.lit(True))


def ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df as a written table with __at, its place in the order: the number of its range times 2^33, and the place in that range.

    It is written because the bounds of ranges come from a sample: drawn again, they would be others.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    return written(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__at", F.monotonically_increasing_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """df with running sums inside each group of by, in the order: sums maps a new column to the one that it adds up, this row included.

    totals maps new columns to those whose sum over the whole group they get.
    Where rows can be equal in the order, end it with something that tells them
    apart, as equal rows all fall into one range.
    """
    totals = totals or {}
    laid = ranged(df, [*by, *order]).withColumn("__range", F.shiftright("__at", 33))
    parts = laid.groupBy("__range", *by).agg(*[F.sum(c).alias(f"__s{i}") for i, c in enumerate([*sums.values(), *totals.values()])])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(
        F.col("__range").alias("__r"), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)],
        *[F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).alias(f"__before{i}") for i in range(len(sums))],
        *[F.sum(f"__s{len(sums) + i}").over(group).alias(name) for i, name in enumerate(totals)],
    )
    inside = Window.partitionBy("__range", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    own = laid.select("*", *[F.sum(c).over(inside).alias(f"__own{i}") for i, c in enumerate(sums.values())])
    both = own.join(shift, _same([F.col("__range"), *[F.col(c) for c in by]], [F.col("__r"), *[F.col(f"__b{i}") for i in range(len(by))]]))
    return both.select(*df.columns, *[(F.col(f"__own{i}") + F.col(f"__before{i}")).alias(name) for i, name in enumerate(sums)], *totals)


def attach(rows: DataFrame, facts: DataFrame, keys: dict[str, str], total: int, count: str) -> DataFrame:
    """rows joined with facts, which hold each key once, by columns of rows = columns of facts; count is a key's number of rows.

    Hot keys' facts are broadcast (see HOT), so that no task gets all rows of one.
    """
    names = {c: f"__f{i}" for i, c in enumerate(keys.values())}
    side = facts.select(*[F.col(c).alias(names.get(c, c)) for c in facts.columns])
    on = _same([F.col(c) for c in keys], [F.col(names[c]) for c in keys.values()])
    hot = F.col(count) * HOT > total
    few = F.broadcast(side.where(hot).drop(count))
    cold = rows.join(few.select(*names.values()), on, "left_anti").join(side.where(~hot).drop(count), on)
    return rows.join(few, on).unionByName(cold).drop(*names.values())


def average_ranks(values: DataFrame, by: list[str], value: str, count: str = "n", keep: str | None = None) -> DataFrame:
    """by, value, n, rank, centred (and what keep names) of values, which hold each value of a group once, with its count.

    Ranks go from 1, and equal values share the mean of theirs. centred is the
    rank less the mean rank of the group, exactly 0 where all values are equal.
    """
    run = running(values, by, [value], {"__upto": count}, {"__all": count})
    rank = F.col("__upto") - (F.col(count) - 1) / F.lit(2.0)
    return run.select(*by, value, F.col(count).alias("n"), *([keep] if keep else []), rank.alias("rank"), (rank - (F.col("__all") + 1) / F.lit(2.0)).alias("centred"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], everything: bool = False) -> DataFrame:
    """by, n, low, high, q: exact quantiles of each group, between two values in proportion; nulls are left out.

    A first pass sketches each group and brackets every wanted place. A second
    counts the values: one by one inside a bracket, as one sum between brackets,
    so that what is sorted is a small part of the group. A place that a bracket
    misses, which the sketch's bound rules out, is looked for among all values
    (everything).
    """
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull()).select(*by, v.alias("__v"))
    reach = MARGIN / ACCURACY
    edges = F.array(*[F.lit(float(e)) for p in shares for e in (max(0.0, p - reach), min(1.0, p + reach))])
    facts = [F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")]
    groups = written(rows.groupBy(*by).agg(*facts, F.percentile_approx("__v", edges, F.lit(ACCURACY)).alias("__e")), "brackets")
    names = {c: f"__g{i}" for i, c in enumerate(by)}
    small = groups.count() <= GROUPS
    side = groups.select(*[F.col(c).alias(g) for c, g in names.items()], "n", "low", "high", "__e")
    side = F.broadcast(side) if small else side
    on = _same([F.col(c) for c in by], [F.col(g) for g in names.values()])
    inside = [(F.col("__v") >= F.col("__e")[2 * i]) & (F.col("__v") <= F.col("__e")[2 * i + 1]) for i in range(len(shares))]
    gap = reduce(lambda a, b: a + b, [(F.col("__v") > F.col("__e")[2 * i + 1]).cast("int") for i in range(len(shares))])
    keep = F.lit(True) if everything else reduce(lambda a, b: a | b, inside)
    counted = rows.join(side.drop("n", "low", "high"), on).groupBy(*by, gap.alias("__gap"), F.when(keep, F.col("__v")).alias("__own")).agg(F.count(F.lit(1)).alias("__k"), F.min("__v").alias("__low"))
    run = running(counted, by, ["__low", "__gap"], {"__upto": "__k"})
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in shares]
    at = lambda k: (F.col("__upto") - F.col("__k") <= k) & (k < F.col("__upto"))
    got = written(
        run.join(side.drop("low", "high", "__e"), on).groupBy(*by).agg(
            F.array(*[F.max(F.when(at(end(k)), F.col("__own"))) for k in place for end in (F.floor, F.ceil)]).alias("__q"),
        ),
        "quantiles",
    )
    lost = F.exists("__q", lambda x: x.isNull())
    if not everything and not (again := got.where(lost).select(*by)).isEmpty():
        missed = again.select(*[F.col(c).alias(g) for c, g in names.items()])
        more = quantiles(rows.join(missed, on, "left_semi"), by, "__v", shares, True)
        got = got.where(~lost).unionByName(more.select(*by, F.flatten(F.transform("q", lambda x: F.array(x, x))).alias("__q")))
    q = [F.col("__q")[2 * i] + (F.col("__q")[2 * i + 1] - F.col("__q")[2 * i]) * (k - F.floor(k)) for i, k in enumerate(place)]
    return got.join(side.drop("__e"), on).select(*by, "n", "low", "high", F.array(*q).alias("q"))
