"""Scores, applicability and verdicts as native column expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: float) -> Column:
    return F.lit(float(x))


def anchor_score(value: Column, good: float, bad: float) -> Column:
    """0 at good, 1 at bad, linear between, clipped; the direction follows from the anchors. Null stays null."""
    if good == bad:
        raise ValueError("anchors are equal")
    share = (value.cast("double") - _d(good)) / _d(bad - good)
    return F.when(value.isNotNull(), F.least(_d(1), F.greatest(_d(0), share)))


def not_applicable(mid_tone: Column, n_lines: Column, max_mid: float = 0.05) -> Column:
    """Labels that this page can't be scored for, sorted; missing metrics don't exclude any."""
    bitonal = F.coalesce(mid_tone.cast("double"), _d(1)) < _d(max_mid)
    no_lines = F.coalesce(n_lines.cast("double"), _d(0)) <= _d(0)
    return F.array_sort(F.array_compact(F.array(F.when(bitonal, F.lit("low_contrast")), F.when(no_lines, F.lit("low_resolution")), F.when(bitonal, F.lit("noise")))))


def score_columns(scores: dict[str, dict[str, Any]], skip: Column | None = None, digits: int = 4) -> dict[str, Column]:
    """A column for each label; null where it doesn't apply or its metric is missing."""
    out = {}
    for label, a in scores.items():
        s = F.round(anchor_score(F.col(a["metric"]), a["good"], a["bad"]), digits)
        out[label] = s if skip is None else F.when(~F.array_contains(skip, label), s)
    return out


def score_map(columns: dict[str, Column]) -> Column:
    """label -> score of those that aren't null."""
    pairs = [x for label, s in columns.items() for x in (F.lit(label), s)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def worst(scores: Column) -> Column:
    """The largest score of a map, null if there is none."""
    return F.array_max(F.map_values(scores))


def suspicion(scores: Column) -> Column:
    return F.coalesce(worst(scores), _d(0))


def quality(scores: Column, digits: int = 4) -> Column:
    return F.coalesce(F.round(_d(1) - worst(scores), digits), _d(1))


def verdict(scores: Column, low: float = 0.3, high: float = 0.6, unreadable: float = 0.5) -> Column:
    """good, acceptable or bad by strict thresholds; an unreadable page is bad by its own."""
    top = F.coalesce(worst(scores), _d(0))
    return F.when(F.coalesce(F.try_element_at(scores, F.lit("unreadable")), _d(0)) > _d(unreadable), "bad").when(top > _d(high), "bad").when(top > _d(low), "acceptable").otherwise("good")


def suggested(scores: Column, labels: list[str], threshold: float = 0.3) -> Column:
    """label -> whether the score reaches threshold, of those labels that have one."""
    wanted = F.array(*[F.lit(x) for x in labels])
    return F.transform_values(F.map_filter(scores, lambda k, v: F.array_contains(wanted, k)), lambda k, v: v >= _d(threshold))


def positive(labels: Column) -> Column:
    """Sorted names of the true labels."""
    return F.array_sort(F.map_keys(F.map_filter(labels, lambda k, v: F.coalesce(v, F.lit(False)))))


def ranked_defects(scores: Column, order: list[str]) -> Column:
    """Structs (label, score), highest first; ties in the order of the taxonomy."""
    place = F.array(*[F.lit(x) for x in order])
    rows = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("down"), F.array_position(place, e["key"]).alias("place"), e["key"].alias("label"), e["value"].alias("score")))
    return F.transform(F.array_sort(rows), lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score")))


def document_id(path: Column, how: str) -> Column:
    """The document that a page's file belongs to: its stem, its folder, or the first seven digits of the stem."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    if how == "stem":
        return stem
    if how == "parent":
        return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    if how != "bates7":
        raise ValueError(f"unknown document id: {how}")
    digits = F.regexp_replace(stem, r"\D", "")
    return F.when(digits == "", stem).otherwise(F.substring(digits, 1, 7))


def patch_label(is_local: Column, has_mask: Column, overlap: Column, label: Column, least: float = 0.15) -> Column:
    """A page's label for one patch: local defects only where their mask covers enough of it."""
    given = F.coalesce(label, F.lit(False))
    return F.when(~given, F.lit(0)).when(is_local & has_mask, (overlap >= _d(least)).cast("int")).otherwise(F.lit(1))


def page_score(patch_scores: Column, is_local: Column) -> Column:
    """An aggregate: the largest patch score of a local label, the mean of a global one."""
    return F.when(F.first(is_local), F.max(patch_scores)).otherwise(F.avg(patch_scores))
