"""Chat formatting, importance resampling and centroid clustering against plain Python."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import centroids, chat_format, queries, resampling

from ..conftest import DATA

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# 11


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_chat(turns):
    """n_turns, turns_sha256, loss_chars, loss_sha256."""
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


HOSTILE = ["", "\\", "\\\\", "</turn>", "\\</turn>", "<\\/turn>", "</turn", "</turn>\n", "### assistant: hi", "#### ", "### ### ", "\\### Assistant: </turn> ok", ": ", ":", " ", "\n", "a\\", "<", "é\U0001f600 </turn></turn>", "$1 \\1", "x" * 300_000 + "\\" * 5000 + "</turn>" * 3000]


def test_chat(spark):
    rng = random.Random(3)
    convs, rows = {}, []
    for c in [None, *range(40)]:
        turns = [(rng.choice(["user", "assistant", "system", "a: b", "</turn>", "x:", "\\"]), rng.choice(HOSTILE)) for _ in range(rng.randint(1, 9))]
        convs[c] = turns
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(100, 0, None, None), (100, 1, "assistant", None), (101, None, "user", "first"), (101, 5, "assistant", "b"), (101, 5, "assistant", "a"), (101, 5, "assistant", "a")]
    convs |= {100: [("", ""), ("assistant", "")], 101: [("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("segments", "formatted", "n_turns", "prompt", "messages"):
        df = df.withColumn(c, F.lit("clash"))
    out = chat_format.formatted(df)
    got = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: brute_chat(t) for c, t in convs.items()}
    for r in out.collect():
        assert r.formatted == "".join(s.text for s in r.segments) and len(r.formatted) == got[r.conv_id].formatted_chars
        assert r.formatted.count("</turn>") == len(convs[r.conv_id])  # none is left inside a text
        assert [s.loss for s in r.segments] == [k == 1 and role == "assistant" for role, _ in convs[r.conv_id] for k in range(3)]
    assert chat_format.formatted(df.limit(0)).count() == 0


def test_chat_layouts_of_json(spark):
    user, bot = ("user", "Q"), ("assistant", "A")
    cases = [
        ({"messages": [{"role": "user", "content": "Q"}, {"role": "assistant", "content": [{"type": "text", "text": "A"}, {"type": "image"}]}], "id": 1}, "messages", [user, bot]),
        ({"conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}, {"from": "tool", "value": None}]}, "from_value", [user, bot, ("tool", "")]),
        ({"instruction": "Q", "input": "", "output": "A"}, "instruction", [user, bot]),
        ({"instruction": "Q", "input": "more", "output": "A", "system": "S", "history": [["a", "b"]]}, "instruction", [("system", "S"), ("user", "a"), ("assistant", "b"), ("user", "Q\n\nmore"), bot]),
        ({"instruction": "Q", "response": "A", "category": "x"}, "instruction_response", [user, bot]),
        ({"prompt": "Q", "completion": "A", "a: `b`": {"prompt": 1}}, "completion", [user, bot]),
        ({"prompt": "Q", "response": "A"}, "response", [user, bot]),
        ({"question": "Q", "answer": "A"}, "question", [user, bot]),
        ({"nested": {"prompt": "Q", "completion": "A"}}, None, []),
        ({"messages": []}, None, []),
        ({"messages": [{"role": "user", "content": "[not parts]"}]}, "messages", [("user", "[not parts]")]),
    ]
    rows = [(i, json.dumps(c[0])) for i, c in enumerate(cases)] + [(90, "{broken"), (91, None), (92, "[1]")]
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat_format.canonical_json(spark.createDataFrame(rows, "conv_id long, j string"), "j").collect()}
    assert got == {i: (layout, turns) for i, (_, layout, turns) in enumerate(cases)} | dict.fromkeys((90, 91, 92), (None, []))


def test_chat_layouts_of_typed_tables(spark):
    one = spark.createDataFrame([(1, [("user", "Q"), ("assistant", "A")], "x"), (2, None, "y")], "conv_id long, messages array<struct<role: string, content: string>>, turns string")
    parts = spark.createDataFrame([(1, [("user", [("Q",)]), ("assistant", [("A",), (None,)])])], "conv_id long, messages array<struct<role: string, content: array<struct<text: string>>>>")
    plain = spark.createDataFrame([(1, "Q", None, "A")], "conv_id long, instruction string, input string, output string")
    for df in (one, parts, plain):
        got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.canonical(df).collect()}
        assert got == {1: [("user", "Q"), ("assistant", "A")]} | ({2: []} if df is one else {})
    with pytest.raises(ValueError, match="no layout"):
        chat_format.canonical(spark.range(3))


def test_chat_is_native(spark):
    df = queries.op11_chat_format(spark, DATA)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
    own = {r.conv_id: r for r in df.collect()}[-7]
    said = r"\### Assistant: </turn> ok"
    assert (own.n_turns, own.turns_sha256, own.loss_chars, own.loss_sha256) == brute_chat([("user", said), ("assistant", said)])


# 12


def brute_resample(docs, target, n_words, buckets, share, least, seed):
    def counts(text):
        w = WORD.findall((text or "").encode().lower())
        grams = [b" ".join(w[i : i + k]) for k in range(1, n_words + 1) for i in range(len(w) - k + 1)]
        return len(w), len(grams), Counter(zlib.crc32(g) % buckets for g in grams)

    rows = [(i, *counts(t)) for i, t in docs]
    s, t = sum((r[3] for r in rows), Counter()), sum((counts(x)[2] for _, x in target), Counter())
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)}
    out = []
    for i, words, n, c in rows:
        weight = sum(gain[b] * k for b, k in c.items()) // n if n else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    drawn = fit[: share * len(fit) // 100]
    ranks = {}
    for k, r in enumerate(drawn, 1):
        ranks.setdefault(r[0], []).append(k)
    return Counter((r[0], r[1], r[2], r[3]) for r in out), ranks


def resample_rows(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉéX1-ß日") for _ in range(rng.randint(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 19, 20, 60])))) for i in range(150)]
    rows += [(None, " ".join(word() for _ in range(40))), (200, None), (201, ""), (202, " \x00\t. "), (203, "one two " * 9000), (204, "x" * 5000)]
    return rows + [rows[7], rows[7], rows[30]], [(i, " ".join(word() for _ in range(30))) for i in range(9)] + [(9, None)]


@pytest.mark.parametrize(("n_words", "buckets", "part"), [(2, 10_000, 1 << 20), (2, 97, 300), (1, 50, 200), (3, 500, 64)])
def test_resample(spark, monkeypatch, n_words, buckets, part):
    monkeypatch.setattr(resampling, "PART_BYTES", part)
    rows, target = resample_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for c in ("weight", "rank", "row", "fit", "one"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = resampling.resample(docs, spark.createDataFrame(target, "doc_id long, text string"), n_words, buckets, 25, 20, 7).collect()
    want, ranks = brute_resample(rows, target, n_words, buckets, 25, 20, 7)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == want
    mine = {}
    for r in got:
        if r["rank"] is not None:
            mine.setdefault(r.doc_id, []).append(r["rank"])
    assert {i: sorted(k) for i, k in mine.items()} == ranks


def test_resample_pieces_of_a_long_text():
    rng = random.Random(1)
    text = b" ".join(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(400)) + b"z" * 500 + "é".encode() * 300
    resampling_parts = resampling.PART_BYTES
    try:
        resampling.PART_BYTES = 50
        found, words = Counter(), 0
        for part in resampling.parts(text, [0, len(text)], 3):
            ((_, carried, piece),) = part
            w = WORD.findall(piece.encode())
            found.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1) if i + k > carried)
            words += len(w) - carried
    finally:
        resampling.PART_BYTES = resampling_parts
    w = WORD.findall(text)
    assert words == len(w) and found == Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i, "word " * (i + 15)) for i in range(12)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    got = resampling.resample(some, none).collect()
    assert len(got) == 12 and sum(r["rank"] is not None for r in got) == 1  # 7 have enough words


# 13


def brute_lloyd(rows, k, rounds, seed, size, scale):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(scale * x))) for x in v]))
    first = sorted(kept, key=lambda r: (sha(f"{seed}:{'' if r[0] is None else r[0]}"), r[0] or 0, r[1]))[:k]
    cs = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds):
        own = [[] for _ in cs]
        for _, v in kept:
            own[min(range(len(cs)), key=lambda c, v=v: far(v, cs[c]))].append(v)
        cs = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, cs, strict=True)]
    out = [(i, c := min(range(len(cs)), key=lambda c, v=v: far(v, cs[c])), far(v, cs[c])) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, cs[c])))) for i, c, d in out)


@pytest.mark.parametrize(("n", "k"), [(300, 16), (5, 16), (40, 3)])
def test_centroids(spark, n, k):
    rng = random.Random(n)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5, -0.25]) for _ in range(6)]) for i in range(n)]
    rows += [(None, [1.0] * 6), (900, None), (901, [1.0] * 5), (902, []), (903, [None] + [1.0] * 5), (904, [math.nan] + [1.0] * 5), (905, [math.inf] * 6), (906, [-1e30, 3e38, 0.0, 1.0, 2.0, 3.0]), (907, [1.0] * 7)]
    rows += [rows[0], rows[0], rows[1]] + [(1000 + i, [2.0] * 6) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("distance", F.lit("clash")).repartition(4)
    got = Counter(tuple(r) for r in centroids.cluster(df, k, 3, 1, 6, 64).collect())
    assert got == brute_lloyd(rows, k, 3, 1, 6, 64)


def test_centroids_without_vectors(spark):
    for rows in ([], [(1, [1.0]), (2, None)]):
        df = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert df.count() == 0 and df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_nearest_takes_the_lowest_of_equals():
    where, far = centroids.nearest(np.array([[0, 0], [4, 4], [centroids.LARGEST, 0]]), np.array([[1, 1], [-1, -1], [1, 1], [-centroids.LARGEST, 0]]))
    assert where.tolist() == [0, 0, 0] and far.tolist()[:2] == [2, 18]


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_resample", "op13_centroids"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns) and got.count() > 20
    assert Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall())
