"""Splits of any size: shards written by ranges, read back, counted."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import split as D
from folioscope.sources import logs as L


@pytest.fixture
def split(spark):
    sizes = spark.createDataFrame([(f"d{i:02d}", 1 + i % 5) for i in range(40)], "document string, n long")
    parts = D.allocate(sizes, {"train": 0.2, "val": 0.3, "test": 0.5}, 42)
    records = sizes.select("document", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select("document", F.concat_ws("/", "document", F.col("k").cast("string")).alias("image"))
    return parts, records.unionByName(records.limit(3))  # repeated rows


def test_shards_hold_what_the_lists_hold(spark, split, tmp_path):
    parts, records = split
    out = str(tmp_path / "split")
    L.write_members(D.members(parts, records), out)
    got = {}
    for r in L.read_members(spark, out).collect():
        got.setdefault(r.part, []).append((r.document, r.image))
    want = {r["part"]: (r.documents, sorted(set(r.images))) for r in D.assemble(parts, records).collect()}
    assert {p: (sorted({d for d, _ in v}), sorted(i for _, i in v)) for p, v in got.items()} == want
    counts = {x["part"]: x for x in map(json.loads, (tmp_path / "split" / L.COUNTS).read_text().splitlines())}
    assert {p: (c["n_documents"], c["n_images"]) for p, c in counts.items()} == {p: (len(d), len(i)) for p, (d, i) in want.items()}
    held = {r.document for r in L.read_held_out(spark, out).collect()}
    assert held == {d for p in ("val", "test") for d in want[p][0]}
    with pytest.raises(FileExistsError):
        L.write_members(D.members(parts, records), out)


def test_shards_are_ranges(spark, tmp_path):
    n = 20_000
    rows = spark.range(n).select(F.lit("train").alias("part"), F.lpad((F.col("id") * 7919 % n).cast("string"), 6, "0").alias("document"), F.col("id").cast("string").alias("image"))
    L.write_members(rows, str(tmp_path / "s"), shards=6)
    files = sorted((tmp_path / "s/members/part=train").glob("*.json"))
    spans = sorted((x[0], x[-1], len(x)) for x in ([json.loads(y)["document"] for y in f.read_text().splitlines()] for f in files))
    assert len(files) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and max(s[2] for s in spans) < n / 2
    assert sum(s[2] for s in spans) == n


def test_a_lost_shard_is_an_error(spark, split, tmp_path):
    parts, records = split
    L.write_members(D.members(parts, records), str(tmp_path / "s"))
    next((tmp_path / "s/members/part=val").glob("*.json")).unlink()
    with pytest.raises(ValueError, match="val has"):
        L.read_held_out(spark, str(tmp_path / "s"))


def test_empty_split(spark, tmp_path):
    none = spark.createDataFrame([], "part string, document string, image string")
    L.write_members(none, str(tmp_path / "s"))
    assert L.read_members(spark, str(tmp_path / "s")).count() == 0 == L.read_held_out(spark, str(tmp_path / "s")).count()


def test_class_weights_of_the_settings(spark):
    from folioscope.operators import evaluation as E

    rows = spark.createDataFrame([("a", True), ("a", False), ("a", False), ("b", False)], "label string, truth boolean")
    got = {r.label: (r.place, r.pos_weight, r.capped) for r in E.pos_weight(rows, 1.5, ["b", "a", "c"]).collect()}
    assert got == {"b": (0, 1.0, 1.0), "a": (1, 2.0, 1.5), "c": (2, 1.0, 1.0)}
    given = {r.label: (r.pos_weight, r.capped) for r in E.pos_weight(rows, 1.5, ["b", "a", "c"], [3.0, 0.5, 9.0]).collect()}
    assert given == {"b": (3.0, 3.0), "a": (0.5, 0.5), "c": (9.0, 9.0)}
    with pytest.raises(ValueError, match="2 weights for 3 labels"):
        E.pos_weight(rows, 1.5, ["b", "a", "c"], [1.0, 2.0])
