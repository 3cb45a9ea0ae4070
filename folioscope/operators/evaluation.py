"""Multi-label metrics, correlations, calibration: exact, as aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written
from .ordered import attach, average_ranks, quantiles, running


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """label, precision, recall, f1, support from rows (label, truth, score)."""
    guess = F.col("score") >= threshold
    n = rows.groupBy("label").agg(F.sum((guess & F.col("truth")).cast("long")).alias("tp"), F.sum(guess.cast("long")).alias("p"), F.sum(F.col("truth").cast("long")).alias("support"))
    pr = n.select("label", _share(F.col("tp"), F.col("p")).alias("precision"), _share(F.col("tp"), F.col("support")).alias("recall"), "support")
    return pr.withColumn("f1", _share(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def average_precision(rows: DataFrame) -> DataFrame:
    """label, average_precision: precision weighted by the gain in recall over distinct scores; null without both classes.

    Rows are summed by distinct score first, and the running sums go over ranges of scores.
    """
    by = rows.groupBy("label", "score").agg(F.sum(F.col("truth").cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    run = running(by, ["label"], [F.desc("score")], {"cum_tp": "tp", "cum_n": "n"})
    return run.groupBy("label").agg(F.sum(F.col("tp") * F.col("cum_tp").cast("double") / F.col("cum_n")).alias("s"), F.sum("tp").alias("pos"), F.sum("n").alias("n")).select("label", F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n")), F.col("s") / F.col("pos")).alias("average_precision"))


def macro(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Means over labels with support; nulls don't count."""
    return metrics.where("support > 0").agg(*[F.avg(c).alias(f"macro_{c}") for c in columns], F.count(F.lit(1)).alias("n_labels"))


def metric_table(metrics: list[dict]) -> str:
    """The metrics as text, a dash where average precision is undefined."""
    lines = [f"{'label':<16}{'P':>8}{'R':>8}{'F1':>8}{'AP':>8}{'n':>7}"]
    for m in metrics:
        ap = m.get("average_precision")
        lines.append(f"{m['label']:<16}{m['precision']:>8.3f}{m['recall']:>8.3f}{m['f1']:>8.3f}{'—' if ap is None else f'{ap:.3f}':>8}{m['support']:>7}")
    return "\n".join(lines)


def spearman(rows: DataFrame, x: str = "x", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """rho and n by group; null with fewer than three pairs or a constant side. Non-finite pairs are left out.

    Equal pairs are counted first. Both sides' distinct values are ranked over
    ranges of values, and the ranks come back to the pairs by value, hot values by
    broadcast. Centred ranks make a constant side exactly constant.
    """
    by = by or ["metric"]
    usable = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in (x, y)]
    pairs = rows.where(usable[0] & usable[1]).groupBy(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).agg(F.count(F.lit(1)).alias("n"))
    pairs = written(pairs, "pairs")
    total = pairs.count()
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("__x").alias("v")), F.struct(F.lit(1).alias("side"), F.col("__y").alias("v"))))
    values = pairs.select(*by, sides.alias("s"), "n").select(*by, "s.side", "s.v", "n").groupBy(*by, "side", "v").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    ranks = average_ranks(values, [*by, "side"], "v", keep="rows")
    ranks = written(ranks, "ranks")
    side = lambda i, name: ranks.where(F.col("side") == i).select(*[F.col(c).alias(f"__k{j}") for j, c in enumerate(by)], "v", "rows", F.col("centred").alias(name))
    keys = {c: f"__k{j}" for j, c in enumerate(by)}
    both = attach(attach(pairs, side(0, "__rx"), keys | {"__x": "v"}, total, "rows"), side(1, "__ry"), keys | {"__y": "v"}, total, "rows")
    n, a, b = F.col("n"), F.col("__rx"), F.col("__ry")
    sums = both.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(n * a * a).alias("sxx"), F.sum(n * b * b).alias("syy"), F.sum(n * a * b).alias("sxy"))
    # The built-in correlation divides by zero for a constant side under ANSI rules.
    return sums.select(*by, "n", F.when(n >= 3, F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy"))).alias("rho"))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom."""
    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else math.nan
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def unpivoted(rows: DataFrame, metrics: list[str], signal: str) -> DataFrame:
    """metric, x, y for every column of metrics against the signal: the pairs that spearman takes, from one wide row a page."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    return rows.select(F.explode(pairs).alias("p"), F.col(signal).cast("double").alias("y")).select("p.metric", "p.x", "y")


def correlations(rows: DataFrame, metrics: list[str], signal: str) -> DataFrame:
    """metric, n, rho of every column of metrics with the signal; one without usable pairs has n = 0 and no rho."""
    names = rows.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    return names.join(spearman(unpivoted(rows, metrics, signal)), "metric", "left").select("metric", F.coalesce("n", F.lit(0)).alias("n"), "rho")


def ranked(correlations: DataFrame, by: str = "metric") -> DataFrame:
    """Correlations (rho, n) from the strongest, either sign; undefined ones last. There is a row for each pair of columns, so one task sorts them."""
    return correlations.orderBy(F.abs("rho").desc_nulls_last(), by)


def correlation_report(rows: list[dict], by: str = "metric", signal: str = "OCR confidence") -> str:
    """A markdown table of ranked correlations, with p and stars."""
    out = [f"| metric | rho with {signal} | n | p | |", "| --- | --- | --- | --- | --- |"]
    for r in rows:
        rho = r["rho"]
        p = math.nan if rho is None else spearman_p(rho, r["n"])
        out.append(f"| {r[by]} | " + ("— | " if rho is None else f"{rho:+.3f} | ") + f"{r['n']} | " + ("—" if math.isnan(p) else f"{p:.4f}") + f" | {'' if math.isnan(p) else stars(p)} |")
    return "\n".join(out)


def stars(p: float) -> str:
    return "***" if p < 0.001 else "*" if p < 0.05 else ""


def expected_sign(metric: Column, signal: Column) -> Column:
    """How a metric should move with a signal: quality with confidence, defects against it; non-words the other way."""
    s = F.when(metric == "quality_score", 1).otherwise(-1)
    return F.when(signal == "mean_confidence", s).otherwise(-s)


def pos_weight(rows: DataFrame, most: float = 50.0, labels: list[str] | None = None, given: list[float] | None = None) -> DataFrame:
    """label, pos_weight, capped from rows (label, truth): negatives for each positive, 1 without positives.

    given sets the weights of labels one by one, in their order, in place of the
    counted ones; it is taken as it is, without the cap. A list of another length
    would weigh the wrong labels, so it is an error.
    """
    if given is not None and len(given) != len(labels or []):
        raise ValueError(f"{len(given)} weights for {len(labels or [])} labels")
    n = rows.groupBy("label").agg(F.sum(F.col("truth").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = F.coalesce(F.try_divide((F.col("n") - F.col("pos")).cast("double"), F.col("pos").cast("double")), F.lit(1.0))
    out = n.select("label", w.alias("pos_weight"), F.least(w, F.lit(most)).alias("capped"))
    if labels is None:
        return out
    spark = rows.sparkSession
    own = F.broadcast(spark.createDataFrame([(i, x, None if given is None else float(given[i])) for i, x in enumerate(labels)], "place int, label string, own double"))  # a row a label of the settings
    return own.join(out, "label", "left").select("place", "label", F.coalesce("own", "pos_weight", F.lit(1.0)).alias("pos_weight"), F.coalesce("own", "capped", F.lit(1.0)).alias("capped"))


def best_so_far(rows: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """The running best of value and whether each row improved on it; null and NaN never do."""
    usable = F.when(~F.isnan(value), F.col(value))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(usable).over(w)
    return rows.withColumn("improved", F.coalesce(usable > before, usable.isNotNull())).withColumn("best", F.greatest(usable, before))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.lit(1.0), F.sum(weight).cast("double"))


def calibrate(values: DataFrame, scores: dict[str, dict], good_pct: float = 60.0, bad_pct: float = 5.0) -> DataFrame:
    """label, metric, good, bad from values (metric, value): exact percentiles, mirrored where more is worse; equal ones give no row."""
    spark = values.sparkSession
    want = spark.createDataFrame([(k, a["metric"], bool(a["good"] > a["bad"])) for k, a in scores.items()], "label string, metric string, down boolean")
    q = quantiles(values, ["metric"], "value", [good_pct / 100, bad_pct / 100, 1 - good_pct / 100, 1 - bad_pct / 100])
    out = q.join(F.broadcast(want), "metric").select("label", "metric", F.when(F.col("down"), F.col("q")[0]).otherwise(F.col("q")[2]).alias("good"), F.when(F.col("down"), F.col("q")[1]).otherwise(F.col("q")[3]).alias("bad"))
    return out.where("good <> bad").select("label", "metric", F.round("good", 4).alias("good"), F.round("bad", 4).alias("bad"))


def anchors_yaml(rows: list[dict]) -> str:
    """Calibrated anchors as text; larger numbers get fewer decimals."""
    digits = lambda v: round(v, 1 if abs(v) >= 100 else 3 if abs(v) >= 1 else 5)
    return "scores:\n" + "".join(f"  {r['label']}: {{metric: {r['metric']}, good: {digits(r['good'])}, bad: {digits(r['bad'])}}}\n" for r in rows)
