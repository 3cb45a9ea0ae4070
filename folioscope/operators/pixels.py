"""Pixel measures as relational operators over (page, y, x, v); the numpy kernels are checked against these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micro_pages(vectors: DataFrame, side: int = 8, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """page, y, x, v: a vector read as a small grey page."""
    rows = vectors.select(F.col(key).alias("page"), F.posexplode(values).alias("pos", "e"))
    grey = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("e").cast("double") * 255 + 128))).cast("int")
    return rows.select("page", F.floor(F.col("pos") / side).cast("int").alias("y"), (F.col("pos") % side).cast("int").alias("x"), grey.alias("v"))


def contrast(px: DataFrame, low: int = 40, high: int = 215) -> DataFrame:
    """page, rms, mid_tone, dynamic_range."""
    q = F.expr("percentile(v, array(0.01D, 0.99D))")
    return px.groupBy("page").agg(F.stddev_pop("v").alias("rms"), F.avg(((F.col("v") > low) & (F.col("v") < high)).cast("double")).alias("mid_tone"), (q[1] - q[0]).alias("dynamic_range"))


def _grid(px: DataFrame) -> DataFrame:
    """A page's pixels in one row, in order; later operators index into it instead of joining neighbours."""
    return px.groupBy("page").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"].cast("double")).alias("g"))


def _reflect(i: Column, n: Column) -> Column:
    """Border positions mirrored without repeating the edge."""
    return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)


def _convolved(grid: DataFrame, kernels: dict[str, list[list[int]]], inner: bool = False) -> DataFrame:
    """page, y, x and a column for each 3x3 kernel."""
    rows = grid.select("page", "h", "w", "g", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).select("page", "h", "w", "g", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    if inner:
        rows = rows.where("y > 0 and x > 0 and y < h - 1 and x < w - 1")

    def at(dy: int, dx: int) -> Column:
        return F.element_at("g", (_reflect(F.col("y") + dy, F.col("h")) * F.col("w") + _reflect(F.col("x") + dx, F.col("w")) + 1).cast("int"))

    cols = {name: sum((at(i - 1, j - 1) * float(k) for i, line in enumerate(kernel) for j, k in enumerate(line) if k), F.lit(0.0)).alias(name) for name, kernel in kernels.items()}
    return rows.select("page", "y", "x", *cols.values())


LAPLACE = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
NOISE = [[1, -2, 1], [-2, 4, -2], [1, -2, 1]]


def sharpness(px: DataFrame) -> DataFrame:
    """page, laplacian_var, tenengrad. The variance is the mean square less the squared mean: whole numbers, so it is exact."""
    c = _convolved(_grid(px), {"l": LAPLACE, "gx": SOBEL_X, "gy": SOBEL_Y})
    return c.groupBy("page").agg((F.avg(F.col("l") * F.col("l")) - F.avg("l") * F.avg("l")).alias("laplacian_var"), F.avg(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("tenengrad"))


def noise_sigma(px: DataFrame) -> DataFrame:
    """page, noise_sigma: from the median of the second differences without the frame."""
    c = _convolved(_grid(px), {"n": NOISE}, inner=True)
    return c.groupBy("page").agg((F.expr("percentile(abs(n), 0.5D)") * 1.4826 / 6).alias("noise_sigma"))


def otsu_gap(px: DataFrame) -> DataFrame:
    """page, threshold, gap between the medians of paper and ink at the best split of the histogram."""
    hist = px.groupBy("page", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.partitionBy("page").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("page")
    c = hist.withColumn("w0", F.sum("n").over(w)).withColumn("s0", F.sum(F.col("n") * F.col("v")).over(w)).withColumn("n_all", F.sum("n").over(all_)).withColumn("s_all", F.sum(F.col("n") * F.col("v")).over(all_))
    between = F.when(F.col("w0") < F.col("n_all"), F.col("w0") * (F.col("n_all") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s_all") - F.col("s0")) / (F.col("n_all") - F.col("w0")), F.lit(2.0)))
    best = c.withColumn("b", F.coalesce(F.round(between, 6), F.lit(-1.0))).groupBy("page").agg(F.max(F.struct("b", (-F.col("v")).alias("down"))).alias("m")).select("page", (-F.col("m.down")).alias("threshold"))
    return px.join(best, "page").groupBy("page", "threshold").agg(F.expr("percentile(v, 0.5D) filter (where v > threshold)").alias("paper"), F.expr("percentile(v, 0.5D) filter (where v <= threshold)").alias("ink")).select("page", "threshold", F.coalesce(F.col("paper") - F.col("ink"), F.lit(0.0)).alias("gap"))


def streak_energy(px: DataFrame, axis: str = "x", smooth: int = 3) -> DataFrame:
    """page, streak_energy along one axis: profile of upper quartiles less its local mean, beyond three robust deviations."""
    prof = px.groupBy("page", axis).agg(F.expr("percentile(v, 0.75D)").alias("p"))
    near = Window.partitionBy("page").orderBy(axis).rowsBetween(-(smooth // 2), smooth // 2)
    res = prof.withColumn("r", F.col("p") - F.avg("p").over(near))
    scale = res.groupBy("page").agg((F.expr("percentile(abs(r), 0.5D)") * 1.4826).alias("s"), F.expr("percentile(p, 0.5D)").alias("m"), F.count(F.lit(1)).alias("k"))
    over = F.greatest(F.abs("r") - 3 * F.col("s"), F.lit(0.0))
    return res.join(scale, "page").groupBy("page").agg(F.when((F.first("k") >= 5) & (F.first("m") > 0), F.sqrt(F.avg(over * over)) / F.first("m")).otherwise(0.0).alias("streak_energy"))


def text_box(px: DataFrame, dark: int = 128, least: float = 0.2) -> DataFrame:
    """page, top, bottom, left, right: rows and columns with enough ink; the whole page if there is none."""
    size = px.groupBy("page").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    rows = px.groupBy("page", "y").agg(F.avg((F.col("v") < dark).cast("double")).alias("s")).where(F.col("s") >= least).groupBy("page").agg(F.min("y").alias("t"), (F.max("y") + 1).alias("b"))
    cols = px.groupBy("page", "x").agg(F.avg((F.col("v") < dark).cast("double")).alias("s")).where(F.col("s") >= least).groupBy("page").agg(F.min("x").alias("l"), (F.max("x") + 1).alias("r"))
    none = F.col("t").isNull() | F.col("l").isNull()
    return size.join(rows, "page", "left").join(cols, "page", "left").select("page", *[F.when(none, whole).otherwise(F.col(c)).alias(name) for name, c, whole in (("top", "t", F.lit(0)), ("bottom", "b", F.col("h")), ("left", "l", F.lit(0)), ("right", "r", F.col("w")))])


def line_runs(px: DataFrame, dark: int = 128, least: float = 0.4) -> DataFrame:
    """page, line, top, height: runs of inked rows, as islands."""
    rows = px.groupBy("page", "y").agg(F.avg((F.col("v") < dark).cast("double")).alias("s")).where(F.col("s") >= least)
    w = Window.partitionBy("page").orderBy("y")
    runs = rows.withColumn("island", F.col("y") - F.row_number().over(w)).groupBy("page", "island").agg(F.min("y").alias("top"), F.count(F.lit(1)).alias("height"))
    return runs.select("page", F.row_number().over(Window.partitionBy("page").orderBy("top")).alias("line"), "top", "height")


def patch_grid(pages: DataFrame, patch: int = 384, rows: int = 9, cols: int = 6) -> DataFrame:
    """page, index, row, col, x0, y0, x1, y1: an even grid of square patches that reaches every corner; starts are rounded half to even."""
    side = F.least(F.lit(patch), F.col("width"), F.col("height"))

    def start(i: Column, n: int, total: Column) -> Column:
        return F.when(total <= side, 0).otherwise(F.bround(i * (total - side).cast("double") / max(1, n - 1), 0)).cast("int")

    def count(n: int, total: Column) -> Column:
        return F.when((total <= side) | F.lit(n <= 1), 1).otherwise(n)

    g = pages.where("width > 0 and height > 0").select("page", "width", "height", side.alias("side"), count(rows, F.col("height")).alias("nr"), count(cols, F.col("width")).alias("nc"))
    g = g.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
    y0, x0 = start(F.col("row"), rows, F.col("height")), start(F.col("col"), cols, F.col("width"))
    return g.select("page", (F.col("row") * F.col("nc") + F.col("col")).alias("index"), "row", "col", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("side")).alias("x1"), (y0 + F.col("side")).alias("y1"))
