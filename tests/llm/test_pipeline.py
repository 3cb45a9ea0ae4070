"""The pipeline against its stages done by brute force."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import bpe, decontamination, quality
from folioscope.llm.common import remainder

from ..conftest import DATA
from .test_llm import brute_components, edit


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(remainder("doc_id", 4) != 2)
    model = quality.train(docs, labels).scorer()
    left = {r.doc_id: r.text for r in docs.collect()}
    left = {i: t for i, t in left.items() if model.probabilities([t.encode()])[0] >= 0.7}
    last = {t: i for i, t in sorted(left.items())}
    left = {i: t for t, i in last.items()}
    comp = {i: c for i, _, c in brute_components(sorted(left.items()), 5, 80)}
    left = {i: t for i, t in left.items() if comp[i] == i}
    items = [decontamination.normalise(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def holds(t: str) -> bool:
        n = decontamination.normalise(t)
        return any(p in n or (any(q in n for _, q in decontamination.pieces(p, int(0.06 * len(p)))) and edit(p, n) <= int(0.06 * len(p))) for p in items)

    left = {i: t for i, t in left.items() if not holds(t)}
    got = corpus_pipeline.run(spark, DATA).collect()
    own = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids_sha256 for r in got} == {i: hashlib.sha256(own.encode(t)).hexdigest() for i, t in left.items()} and len(got) == len(left) > 50


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name


def test_stages_on_odd_tables(spark):
    """Nulls, empty and long texts, repeated rows, ties, clashing columns and an empty table at every stage."""
    rows = [(None, "some plain text of a document"), (1, None), (2, ""), (2, ""), (3, "word " * 30_000), (4, "Une phrase ici"), (5, "Une phrase ici"), (5, "Une phrase ici"), (6, " \t\n ")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("id", F.lit("clash")).withColumn("block", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        got = sorted((str(r.doc_id)) for r in out.collect())
        if name == "exact_deduplication":
            assert got == ["2", "3", "5", "6", "None"], got  # null and empty texts are equal, the largest doc_id stays
        elif name == "near_deduplication":
            assert got == ["1", "2", "2", "3", "4", "6", "None"], got
        elif name in ("benchmark_decontamination", "bpe_encoding"):
            assert got == sorted(str(i) for i, _ in rows), name
        else:
            assert set(got) <= {str(i) for i, _ in rows}
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
