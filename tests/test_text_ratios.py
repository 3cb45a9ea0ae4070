"""Ratios of texts against plain loops, and that a query measures its texts once."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.plans import catalogue

SPACE, EXTRA = " \t\n\x0b\f\r", "0-9^]&. ,"


def words(text):
    return [w for w in (t.strip(X.STRIPPED) for t in re.split(f"[{SPACE}]+", text)) if w]


def nonword(word):
    letters = [c for c in word if unicodedata.category(c)[0] == "L"]
    digits = [c for c in word if unicodedata.category(c) == "Nd"]
    if len(digits) == len(word):
        return False
    if not letters:
        return bool(digits or not any(c in "aeiouyAEIOUY" for c in word)) and len(word) > 2
    if not any(c in "aeiouyAEIOUY" for c in word) and len(letters) >= 3:
        return True
    return len(letters) >= 2 and bool(digits)


def test_ratios_equal_loops(spark):
    r = random.Random(2)
    signs = [*"aeiyAEXbczTя019٣\U0001d7cf\U0001d41a\U0001f600é´.,;:!?()[]«»\"'-–/\\№^&|", " ", "́", *SPACE, *"     "]
    texts = [None, "", " ", "...", "\U0001d7cfab a1", *("".join(r.choices(signs, k=r.randint(1, 40))) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bad, solid = X.garbage_counts(F.col("t"), ["en"], EXTRA)
    odd, all_ = X.nonword_counts(F.col("t"), ["en"])
    for row in df.select("t", bad, solid, odd, all_).collect():
        own = row[0] or ""
        signs_in = [c for c in own if c not in SPACE]
        garbage = [c for c in signs_in if not (c in EXTRA or re.match("[A-Za-z]", c))]
        assert tuple(row)[1:] == (len(garbage), len(signs_in), sum(map(nonword, words(own))), len(words(own))), own


def test_spearman_takes_measured_texts(spark, tmp_path, monkeypatch):
    texts = ["the cat sat", "brrr a1b2 cat", "□□ so so", "tree, 1994 --", "xkcd xkcd a", None]
    docs = [(i, t, "en", "s", 9) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (0, 1, 2, 3, 3, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given, real = [], catalogue.E.spearman
    monkeypatch.setattr(catalogue.E, "spearman", lambda rows: given.append(rows) or real(rows))
    got = {r["metric"]: r["n"] for r in catalogue.q_spearman(spark, str(tmp_path)).collect()}
    assert got == {"blur": 5, "noise": 5, "quality_score": 5}  # a page labelled twice counts twice, an unlabelled one not at all
    # Conditions on a ratio must not measure the text again.
    plan = given[0].where("y < 1 and x is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "RLIKE" not in plan
