"""Readability of recognised text as native string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import anchor_score

# Letters and vowels that the ratios count as the language's own, and the signs stripped from words.
SCRIPTS = {"en": "A-Za-z", "ru": "А-яЁё"}
VOWELS = {"en": "aeiouy", "ru": "аеёиоуыэюя"}
STRIPPED = ".,;:!?()[]{}«»\"'-–—/\\"


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&~" else c for c in chars)


def garbage_counts(text: Column, languages: list[str], extra: str) -> tuple[Column, Column]:
    """Signs outside the languages' letters and extra, and all signs but white space."""
    solid = F.coalesce(text, F.lit(""))
    letters = "".join(SCRIPTS.get(x, "") for x in languages) or r"\p{L}"
    # Taken out in runs: one match for each sign costs many times as much.
    return F.length(F.regexp_replace(solid, f"[\\s{letters}{_class(''.join(extra.split()))}]+", "")), F.length(F.regexp_replace(solid, r"\s+", ""))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def garbage_ratio(text: Column, languages: list[str], extra: str) -> Column:
    return ratio(*garbage_counts(text, languages, extra))


def bare_words(text: Column) -> Column:
    """Words without the signs around them; empty ones are left out."""
    solid = F.coalesce(text, F.lit(""))
    return F.filter(F.transform(F.split(solid, r"\s+"), lambda t: F.trim(t, F.lit(STRIPPED))), lambda t: t != "")


def implausible(token: Column, languages: list[str]) -> Column:
    """A token that can't be a word: letters without a vowel, letters mixed with digits, long runs of signs."""
    vowels = "".join(VOWELS.get(x, "") for x in languages)
    n = F.length(F.regexp_replace(token, r"\P{L}+", ""))
    # Most words have vowels and no digit, and are done after two looks.
    mute = (n >= 3) if vowels else F.lit(False)
    sung = token.rlike(f"[{vowels}{vowels.upper()}]") if vowels else F.lit(True)
    digit = token.rlike(r"\p{Nd}")
    return F.when(sung & ~digit, F.when(n == 0, F.length(token) > 2).otherwise(False) if not vowels else F.lit(False)).when(token.rlike(r"^\p{Nd}+$"), False).when(n == 0, F.length(token) > 2).when(~sung & mute, True).otherwise((n >= 2) & digit)


def doubtful(text: Column, languages: list[str]) -> Column:
    """The text without its words that have a vowel and no digit, which are plausible: one pass in place of looks at each word."""
    solid, vowels = F.coalesce(text, F.lit("")), "".join(VOWELS.get(x, "") for x in languages)
    if not vowels:
        return solid
    vowels += vowels.upper()
    return F.regexp_replace(solid, rf"(?<!\S)[^\s\p{{Nd}}{vowels}]*+[{vowels}][^\s\p{{Nd}}]*+(?!\S)", "")


def nonword_counts(text: Column, languages: list[str]) -> tuple[Column, Column]:
    """Words that can't be any, and all words: tokens with a sign besides those that are stripped."""
    odd = F.filter(bare_words(doubtful(text, languages)), lambda t: implausible(t, languages))
    return F.size(odd), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^\s{_class(STRIPPED)}]\S*+"))


def nonword_ratio(text: Column, languages: list[str]) -> Column:
    return ratio(*nonword_counts(text, languages))


def unreadable(n_boxes: Column, signals: dict[str, Column], anchors: dict[str, dict[str, float]], least: int = 5) -> Column:
    """The worst of the signals, null where too little was recognised."""
    return F.when(n_boxes >= least, F.round(F.greatest(*[anchor_score(signals[k], a["good"], a["bad"]) for k, a in anchors.items()]), 4))
