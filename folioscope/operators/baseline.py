"""A baseline of many labels on page measures: a logistic regression for each label, with folds that keep documents whole.

Rows are wide: a column for the document, numbers for measures, a boolean for each
label. Defined results: a null or NaN measure counts as the mean of the rows
learnt from (0 where there is none); a row whose label is null is neither learnt
from nor scored for that label; a label with one class only gets its share
as every score; rows repeat as often as they come; no rows give no scores. A null
document belongs to the fold of the empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .evaluation import pos_weight


def fold(document: Column, folds: int) -> Column:
    """The fold of a document, 0 to folds - 1: all its pages share it."""
    return F.pmod(F.crc32(F.coalesce(document.cast("string"), F.lit("")).cast("binary")), F.lit(folds).cast("long")).cast("int")


def _pick(rows: DataFrame, document: str, measures: list[str], label: str) -> DataFrame:
    """Columns under names of our own, so that no other column clashes."""
    x = [F.coalesce(F.col(m).cast("double"), F.lit(float("nan"))).alias(f"x{i}") for i, m in enumerate(measures)]
    return rows.where(F.col(label).isNotNull()).select(F.col(document).cast("string").alias("document"), F.col(label).cast("boolean").alias("truth"), *x)


def _fit_predict(train: DataFrame, test: DataFrame, n: int, label: str, most: float, regular: float) -> DataFrame:
    """Scores of test by a model of train; both come from _pick."""
    names = [f"x{i}" for i in range(n)]
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("truth").cast("long")).alias("pos"), *[F.max(F.when(~F.isnan(c), 1)).alias(c) for c in names]).first()
    out = lambda score, rows: rows.select("document", F.lit(label).alias("label"), "truth", score.alias("score"))
    if not stats["n"] or stats["pos"] in (0, stats["n"]):
        return out(F.lit(float(stats["pos"] or 0) / max(1, stats["n"])), test)
    names = [c for c in names if stats[c]]  # an all-null measure says nothing
    if not names:
        return out(F.lit(stats["pos"] / stats["n"]), test)
    weight = pos_weight(train.select(F.lit(label).alias("label"), "truth"), most).first()["capped"]
    steps = [
        Imputer(inputCols=names, outputCols=[f"{c}_" for c in names]),
        VectorAssembler(inputCols=[f"{c}_" for c in names], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol="y", weightCol="w", regParam=regular, standardization=False, maxIter=100, tol=1e-8),
    ]
    model = Pipeline(stages=steps).fit(train.select("*", F.col("truth").cast("double").alias("y"), F.when(F.col("truth"), F.lit(weight)).otherwise(F.lit(1.0)).alias("w")))
    return out(vector_to_array("probability")[1], model.transform(test))


def held_out_scores(train: DataFrame, test: DataFrame, document: str, measures: list[str], labels: list[str], most: float = 50.0, regular: float = 1e-3) -> DataFrame:
    """document, label, truth, score of test's rows, from models that saw train alone."""
    return reduce(DataFrame.unionByName, [_fit_predict(_pick(train, document, measures, k), _pick(test, document, measures, k), len(measures), k, most, regular) for k in labels])


def cross_validated(rows: DataFrame, document: str, measures: list[str], labels: list[str], folds: int = 5, most: float = 50.0, regular: float = 1e-3) -> DataFrame:
    """document, label, truth, score of every row, each from a model that saw no page of its document.

    The measures are written once, as every fold and label reads them.
    """
    own = written(rows.select(document, *measures, *labels), "baseline")
    at = fold(F.col(document), folds)
    return reduce(DataFrame.unionByName, [held_out_scores(own.where(at != k), own.where(at == k), document, measures, labels, most, regular) for k in range(folds)])
