"""Operators 1 to 10 against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as T
import pytest
from pyspark.sql import functions as F

from folioscope.llm import blocks, bpe, components, decontamination, exact_dedup, html_text, language, maxent_lm, quality, queries, shingle_join, substring_dedup, token_files

from ..conftest import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE, WORD = T.path("byte_bpe_multi_50k.tiktoken"), T.path("word_bpe_49k.json")


def make(spark, rows, extra=True):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    if extra:
        for c in ("block", "keep_id", "sha", "score", "lang", "n", "id", "kept", "__fs_id"):
            df = df.withColumn(c, F.lit("x"))
    return df


def odd_rows(seed=0):
    """Nulls, empty and long texts, exact and near copies, repeated rows, a null doc_id."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = [text(90) for _ in range(6)], text(100)
    rows = [(None, "some text"), (1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one TWO"), (6, text(6000))]
    i = 10
    for b in base:
        for _ in range(4):
            w = b.split()
            w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
        rows += [(i, b), (i + 1, b), (i + 2, b.upper()), (i + 3, text(20) + " " + passage + " " + text(30))]
        i += 4
    return rows + [rows[-1], rows[-2]]


def as_dict(df):
    return {r["doc_id"]: r for r in df.collect()}


# 10


def test_exact(spark):
    rows = odd_rows()
    got = exact_dedup.exact_groups(make(spark, rows)).collect()
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    want = collections.Counter((i, max(x for x in by[t or ""] if x is not None) if any(x is not None for x in by[t or ""]) else None, len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(by)
    kept = exact_dedup.keep_one(make(spark, rows))
    assert kept.columns == make(spark, rows).columns and kept.count() == len(by)
    assert exact_dedup.exact_groups(make(spark, rows).limit(0)).count() == 0


def test_fingerprints_compose():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, exact_dedup.HASH_CHUNK, exact_dedup.HASH_CHUNK + 1, 3 * exact_dedup.HASH_CHUNK + 5):
        data = rng.integers(0, 256, n).astype(np.uint8)
        whole = tuple(exact_dedup.fingerprints(data, np.array([0, n]))[0].tolist())
        for cut in {0, n // 3, n}:
            two = exact_dedup.fingerprints(data, np.array([0, cut, n])).tolist()
            assert exact_dedup.combine(tuple(two[0]), tuple(two[1])) == whole


def test_collisions_are_told_apart(spark, monkeypatch):
    """With fingerprints that know only the length, the comparison has to do all the work."""
    monkeypatch.setattr(exact_dedup, "fingerprint_rows", lambda docs: docs.select("doc_id", F.lit(0).cast("long").alias("fp"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")))
    got = as_dict(exact_dedup.exact_groups(make(spark, [(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "cc")])))
    assert {i: (r.keep_id, r.group_size) for i, r in got.items()} == {1: (3, 2), 2: (4, 2), 3: (3, 2), 4: (4, 2), 5: (5, 1)}


# 1


def brute_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        yield gone


@pytest.mark.parametrize(("length", "seed"), [(30, 1), (400, 4)])
def test_repeats(spark, monkeypatch, length, seed):
    monkeypatch.setattr(blocks, "BUCKET_NAMES", 500)
    monkeypatch.setattr(substring_dedup.blocks, "BLOCK_BYTES", 3000)
    rng = random.Random(seed)
    shared = ["".join(rng.choice("ab") for _ in range(rng.randint(length, 3 * length))) for _ in range(4)]
    rows = odd_rows(seed) if length > 100 else [(None, "x"), (0, None), (1, "")]
    for i in range(100, 160):
        t = ""
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            t += "".join(rng.choice("abc") for _ in range(rng.randint(0, 50))) + s[a : a + rng.randint(0, len(s))]
        rows.append((i, t))
    rows += [rows[-1], (500, rows[-2][1]), (501, "z" * (3 * length))]
    want = collections.Counter()
    for (i, t), gone in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], length), strict=True):
        b = (t or "").encode()
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = substring_dedup.remove_repeats(make(spark, rows), length).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert substring_dedup.remove_repeats(make(spark, rows).limit(0), length).count() == 0


def test_repeats_of_structured_bytes(spark):
    """Strings that polynomials modulo a power of two can't tell apart stay; their true copies go."""
    words = [(i + 1, w[:512]) for i, w in enumerate([*thue_morse(11, "tP"), *thue_morse(9, "tP")])]
    rows = [*words[2:], (9, "x" + words[0][1][:450])]
    want = collections.Counter()
    for (i, t), gone in zip(rows, brute_repeats([t.encode() for _, t in rows], 400), strict=True):
        want[i, int(gone.sum())] += 1
    got = substring_dedup.remove_repeats(make(spark, rows), 400).collect()
    assert collections.Counter((r.doc_id, r.n_removed) for r in got) == want
    far = np.frombuffer("".join(w for _, w in words).encode(), np.uint8)
    one, two = blocks.names(far, np.arange(0, len(far) - 399), 400)
    assert len(set(zip(one.tolist(), two.tolist(), strict=True))) == len({far[i : i + 400].tobytes() for i in range(len(far) - 399)})


@pytest.mark.parametrize("q", [2, 3, 5, 7, 17])
def test_cover(q):
    v, cover = substring_dedup.singer(q)
    assert v == q * q + q + 1 and {(a - b) % v for a in cover for b in cover} == set(range(v))


# 2


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.held_out_scores(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([(s >= 0.7) == t for s, t in held]) >= 0.8
    model = quality.train(docs, labels)
    odd = make(spark, odd_rows())
    assert quality.score(odd, model).count() == odd.count() and quality.score(odd.limit(0), model).count() == 0
    assert quality.keep_good(odd, model, 0.0).columns == odd.columns


def test_quality_evidence_by_hand(spark):
    """The score from compressed sizes taken piece by piece with zstandard itself; repeated rows change nothing."""
    import zstandard

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(docs, labels)
    assert quality.train(docs.unionByName(docs), labels.unionByName(labels)) == model
    makers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_dict_id=False) for x in (model.good, model.bad)]
    rows = docs.select("doc_id", "text").limit(40).collect()
    want = {}
    for r in rows:
        raw = (r.text or "").encode()
        pieces = [raw[i : i + quality.PIECE] for i in range(0, len(raw), quality.PIECE)]
        good, bad = (sum(len(m.compress(p)) - len(m.compress(b"")) for p in pieces) for m in makers)
        short = quality.PRIOR_BYTES / (quality.PRIOR_BYTES + len(raw))
        z = model.weights[0] * (bad - good) / max(1, len(raw)) * (1 - short) + model.weights[1] * short + model.weights[2]
        want[r.doc_id] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(got[i] == pytest.approx(x, abs=1e-9) for i, x in want.items())


def test_quality_without_labels(spark):
    docs = make(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(10, 1), (11, 1), (12, None), (10, None)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.score(docs, quality.train(docs, one)).collect())


# 3


def test_maxent(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BUCKET_NAMES", 200)
    monkeypatch.setattr(maxent_lm, "BLOCK_BYTES", 4000)
    rows = odd_rows(5)
    got = maxent_lm.score_documents(make(spark, rows), share=1.0).collect()
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for i, t in rows]
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(x for i, v in toks if i is not None and not fold(i) for x in v)
    n, k = sum(c.values()), len(c)
    want = sorted((str(i), fold(i), len(v), sum(c[x] > 0 for x in v), n, round(float(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (k + 1))) for x in v)), 6)) for i, v in toks)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert maxent_lm.score_documents(make(spark, rows).limit(0)).count() == 0


def test_maxent_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    text = np.frombuffer(b" ".join(rng.choice([b"the cat", b"a dog", b"le chat", b"un chien"]) for _ in range(2000)), np.uint8)
    t = maxent_lm.tokens(text, np.array([0, 5000, len(text)]))
    n = np.ones(maxent_lm.CLASSES, np.int64)
    counts = maxent_lm.Counts(100, 10, n, n, np.sort(t.distinct[:3]))
    c = maxent_lm.Contexts(t, counts.classes(t))
    w = maxent_lm.Weights(rng.normal(0, 0.1, maxent_lm.Weights.size()).astype(np.float32))
    x = c.logits(w, 0, 50).astype(np.float64)
    own = x[np.arange(50), c.cls[:50]] - np.log(np.exp(x).sum(1))
    assert np.allclose(own, c.log_class(w)[:50], atol=1e-4)
    g = c.gradient(w, 0, len(c.cls))
    before = c.log_class(w).mean()
    step = maxent_lm.Weights(w.flat + 0.5 * g)
    assert c.log_class(step).mean() > before
    e, at = 0.01, int(np.abs(g).argmax())  # one derivative by differences
    up, down = w.flat.copy(), w.flat.copy()
    up[at] += e
    down[at] -= e
    assert (c.log_class(maxent_lm.Weights(up)).mean() - c.log_class(maxent_lm.Weights(down)).mean()) / (2 * e) == pytest.approx(g[at], rel=0.05)


def test_maxent_learns_from_the_whole_fold(spark):
    """Two documents outside the old sample of an eighth: the weights leave the class frequencies, and words of each count."""
    rows = [(i, "") for i in range(400)]
    late = [r.doc_id for r in make(spark, rows, extra=False).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) >= 1 << 17).collect() if not maxent_lm.is_held_out(r.doc_id)][:2]
    docs = make(spark, [(late[0], "a b a c " * 50), (late[1], "x y x z " * 50)])
    rows, size = blocks.sized(docs, maxent_lm.BLOCK_BYTES)
    _, counts, _ = maxent_lm.count_words(rows, size)
    whole, none = maxent_lm.train(docs, counts), maxent_lm.train(docs, counts, rounds=0)
    assert np.abs(whole - none).max() > 0.1
    assert all(np.abs(whole - maxent_lm.train(docs.where(F.col("doc_id") == i), counts)).max() > 0.01 for i in late)


def test_maxent_gradient_by_loops():
    rng = np.random.default_rng(2)
    text = np.frombuffer(b" ".join(bytes(rng.choice(list(b"abcdef"), 2)) for _ in range(60)), np.uint8)
    t = maxent_lm.tokens(text, np.array([0, 0, 4, 90, len(text)]))
    n = np.ones(maxent_lm.CLASSES, np.int64)
    c = maxent_lm.Contexts(t, maxent_lm.Counts(100, 10, n, n, np.sort(t.distinct[:3])).classes(t))
    w = maxent_lm.Weights(rng.normal(0, 0.5, maxent_lm.Weights.size()).astype(np.float32))
    want = maxent_lm.Weights(np.zeros(maxent_lm.Weights.size()))
    a, b = 10, len(c.cls)
    for i in range(a, b):
        window = [c.cls[i - k] for k in range(1, c.span[i] + 1)]
        x = w.tables["bias"][0].astype(float) + w.tables["word"][c.word[i]] + w.tables["pair"][c.pair[i]] + w.tables["skip"][c.skip[i]] + sum(w.tables["window"][k] for k in window) / max(1, len(window))
        assert np.allclose(x, c.logits(w, i, i + 1)[0], atol=1e-4)
        d = -np.exp(x) / np.exp(x).sum() / (b - a)
        d[c.cls[i]] += 1 / (b - a)
        for name, row in (("bias", 0), ("word", c.word[i]), ("pair", c.pair[i]), ("skip", c.skip[i])):
            want.tables[name][row] += d
        for k in window:
            want.tables["window"][k] += d / len(window)
    assert np.allclose(c.gradient(w, a, b), want.flat, atol=1e-6)


def test_maxent_score_by_loops_and_any_partitions(spark, monkeypatch):
    """score is the sum over tokens of the class's and the word's log10 probability, by loops; the split of the table changes no bit."""
    monkeypatch.setattr(blocks, "BUCKET_NAMES", 200)
    monkeypatch.setattr(maxent_lm, "BLOCK_BYTES", 6000)
    monkeypatch.setattr(maxent_lm, "CHUNK", 300)
    monkeypatch.setattr(maxent_lm, "FAN", 2)
    rows = odd_rows(6)
    docs = make(spark, rows)
    runs = [sorted((str(r.doc_id), r.n_tokens, r.score) for r in maxent_lm.score_documents(docs.repartition(k)).collect()) for k in (1, 7)]
    assert runs[0] == runs[1]

    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for _, t in rows]
    fold = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    c = collections.Counter(x for v, learnt in zip(toks, fold) if learnt for x in v)
    sized, size = blocks.sized(docs, 6000)
    _, counts, _ = maxent_lm.count_words(sized, size)
    w = maxent_lm.Weights(maxent_lm.train(docs, counts).astype(np.float64))
    words_ = [x for x in c if x is not None]
    names = dict(zip(words_, (blocks.word_names(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0] for x in words_)))

    def cls(x):
        if x is None:
            return 0
        if x in names and names[x] in counts.single:
            return 1 + counts.single.tolist().index(names[x])
        b = x.encode()
        return 1 + maxent_lm.SINGLE + ((((b[-2] if len(b) > 1 else 0) * 257 + b[-1]) * 2654435761 & 0xFFFFFFFF) >> 16) % maxent_lm.SUFFIXES

    common = sorted(words_, key=lambda x: -c[x])
    assert {x for x in common if names[x] in counts.single} >= {x for x in common if c[x] > c[common[maxent_lm.SINGLE]]}
    held, kinds = collections.Counter(), collections.Counter()
    for x, n in c.items():
        held[cls(x)] += n
        kinds[cls(x)] += 1
    assert [held[k] for k in range(maxent_lm.CLASSES)] == counts.class_tokens.tolist()
    want = []
    for (i, _), v in zip(rows, toks):
        total, k = 0.0, [cls(x) for x in v]
        for j, x in enumerate(v):
            one, two = k[j - 1] if j else maxent_lm.START, k[j - 2] if j > 1 else maxent_lm.START
            at = 0 if not j else int(blocks.mix(blocks.word_names(np.frombuffer(v[j - 1].encode(), np.uint8), np.array([0]), np.array([len(v[j - 1].encode())])))[0]) >> 52
            near = k[max(0, j - maxent_lm.WINDOW) : j]
            z = w.tables["bias"][0] + w.tables["word"][at] + w.tables["pair"][one * (maxent_lm.CLASSES + 1) + two] + w.tables["skip"][two] + sum((w.tables["window"][q] for q in near), np.zeros(maxent_lm.CLASSES)) / max(1, len(near))
            total += z[k[j]] / np.log(10) - np.log10(np.exp(z).sum())
            if k[j] > maxent_lm.SINGLE:
                total += np.log10((c[x] + 0.5) / (held[k[j]] + 0.5 * (kinds[k[j]] + 1)))
        want.append((str(i), len(v), total))
    assert all(a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4, abs=1e-4) for a, b in zip(runs[0], sorted(want)))


# 4


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got, truth = as_dict(language.held_out_predictions(docs)), {r.doc_id: r.lang for r in docs.collect()}
    held = [r.lang_pred == truth[i] for i, r in got.items() if r.held_out]
    assert np.mean(held) >= 0.95 and all(0 <= r.score <= 1 for r in got.values())
    model = language.train(docs)
    assert len(model.families) >= 2 and {"und"} == {r.lang_pred for r in language.predict(make(spark, [(1, None), (2, ""), (3, "12 !? 3")]), model).collect()}
    assert language.predict(make(spark, odd_rows()).limit(0), model).count() == 0
    none = language.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.predict("hello") == ("und", 0.0)
    only = language.train(docs.where("lang = 'en'"))
    assert only.predict("bonjour") == ("en", 1.0)


def test_language_learns_every_language(spark, monkeypatch):
    """Rare languages, one with long texts only, repeated rows; votes by hand."""
    monkeypatch.setattr(language, "TRAINING_BYTES", 400)
    rng = random.Random(2)
    rows = []
    for k in range(9):
        letters = "abcdefghijklmnopqrstuvwxyz"[2 * k : 2 * k + 8]
        for i in range(40 if k < 8 else 6):
            rows.append((1000 * k + i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12 if k else 100)), f"l{k}"))
    rows += [rows[-1]] * 30 + [(9000, None, "l1"), (9001, "", "l2"), (9002, "words", None), (None, "abc", "l3"), (9003, "x" * 50_000, "l4")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.train(df, 30)
    assert sorted(x for f in model.families for x in f) == [f"l{k}" for k in range(9)]
    got = [(r.doc_id, r.lang_pred) for r in language.predict(df, model).collect()]
    truth = {i: v for i, t, v in rows if t and v and i != 9003}
    assert len(got) == len(rows) and np.mean([truth[i] == p for i, p in got if i in truth]) > 0.9
    text = rows[50][1]
    x = language.features(text)
    family = max(range(len(model.families)), key=lambda f: float(model.family_weights[f, :-1] @ x + model.family_weights[f, -1]))
    names = model.families[family]
    votes = collections.Counter(names[a if w[:-1] @ x + w[-1] >= 0 else b] for (f, a, b), w in zip(model.pairs, model.pair_weights, strict=True) if f == family)
    assert votes[model.predict(text)[0]] == max(votes.values(), default=0)


def test_language_of_hundreds(spark):
    """No plan, driver list or family grows with the square of the number of languages."""
    n, rng = 400, random.Random(6)
    letters = [rng.sample("abcdefghijklmnopqrstuvwxyzßàéîõüčłøœ", 7) for _ in range(n)]
    text = lambda k: " ".join("".join(rng.choice(letters[k]) for _ in range(4)) for _ in range(40))
    df = spark.createDataFrame([(3 * k + i, text(k), f"l{k:04d}") for k in range(n) for i in range(3)], "doc_id long, text string, lang string").repartition(4)
    model = language.train(df)
    assert sorted(x for f in model.families for x in f) == [f"l{k:04d}" for k in range(n)]
    assert max(map(len, model.families)) <= language.FAMILY and len(model.pairs) <= n * (language.FAMILY - 1) / 2
    assert model.family_weights.nbytes + model.pair_weights.nbytes <= 64_000 * n
    own = [model.predict(text(k))[0] == f"l{k:04d}" for k in range(0, n, 10)]
    assert np.mean(own) > 0.5  # by chance: 0.0025


def test_families_equal_plain_linkage():
    rng = np.random.default_rng(8)
    for n, most in ((1, 8), (2, 8), (4, 8), (9, 8), (12, 3), (12, 1)):
        means = rng.normal(size=(n, 5))
        means /= np.linalg.norm(means, axis=1, keepdims=True)
        groups, near = [[i] for i in range(n)], means @ means.T
        while len(groups) > max(1, round(n**0.5)):
            fit = [(near[np.ix_(groups[a], groups[b])].mean(), -a, -b) for a in range(len(groups)) for b in range(a + 1, len(groups)) if len(groups[a] + groups[b]) <= most]
            if not fit:
                break
            _, a, b = max(fit)
            groups[-a] += groups.pop(-b)
        assert language.find_families([str(i + 10) for i in range(n)], means, most) == sorted(tuple(str(i + 10) for i in sorted(g)) for g in groups)


# 5


def edit(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1]))
        prev = cur
    return min(prev)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 12)))) for i in range(12)] + [(90, None), (91, ""), (92, "Tiny")]
    rows = odd_rows(3)
    for i in range(200, 240):
        t = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(t))
            t[k] = rng.choice(["", "z", t[k] + "y"])
        rows.append((i, " ".join(word() for _ in range(6)) + "  " + "".join(t).upper() + "\n" + " ".join(word() for _ in range(6))))
    rows.append((300, " and ".join(t for _, t in items[:12])))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = collections.Counter()
    for i, t in rows:
        for k, item in items:
            p, norm = decontamination.normalise(item), decontamination.normalise(t)
            if p and norm and (d := edit(p, norm)) <= int(len(p) * 0.06):
                want[i, k, d] += 1
    for size in (10**6, 150):
        monkeypatch.setattr(decontamination, "ITEM_CHARS", size)
        groups = list(decontamination.item_groups(bench, size))
        assert (len(groups) > 1) == (size == 150)
    got = decontamination.leaks(make(spark, rows), bench)
    assert collections.Counter((r.doc_id, r.item_id, r.distance) for r in got.collect()) == want and len(want) > 30
    clean = decontamination.without_leaks(make(spark, rows), bench)
    hit = {i for i, _, _ in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in hit)
    assert decontamination.leaks(make(spark, rows), bench.limit(0)).count() == 0 and decontamination.leaks(make(spark, rows).limit(0), bench).count() == 0


def test_short_items_match_whole_texts_only(spark):
    bench = spark.createDataFrame([(1, "a"), (2, "of"), (3, " Of "), (4, "nineteen characters"), (5, "twenty characters ok")], "item_id long, text string")
    docs = make(spark, [(1, "a tale of a town of nineteen characters"), (2, " OF "), (3, "so twenty  characters okay"), (4, "A"), (5, None), (6, "nineteen characters")])
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontamination.leaks(docs, bench).collect()) == [(2, 2, 0), (2, 3, 0), (3, 5, 0), (4, 1, 0), (6, 4, 0)]
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, bench).collect()) == [1, 5]


# 6


def gold(page):
    """The text of a labelled page without the runs that hold noise."""
    return " ".join("".join(" " if html_text.NOISE in t else t for _, _, t in html_text.parse(page)).split())


@pytest.fixture(scope="module")
def weights():
    return html_text.train(html_text.labelled_pages())


def test_html_of_labelled_pages_needs_the_region(weights):
    right = without = kept = lost = noise = 0
    for page in html_text.labelled_pages(200, 77):
        tokens, want = html_text.parse(page), gold(page)
        got = html_text.extract(page, weights)
        right += got == want
        without += html_text.text_of(tokens, (0, len(tokens)), weights) == want
        n = collections.Counter(got.split())
        w = collections.Counter(want.split())
        kept, lost, noise = kept + (n & w).total(), lost + (w - n).total(), noise + (n - w).total()
    assert right >= 110 and right >= without + 30
    assert lost <= 0.02 * (kept + lost) and noise <= 0.06 * kept


def test_html_region_is_the_best_stretch():
    rng = random.Random(4)
    for _ in range(300):
        tokens = [(("words",) if rng.random() < 0.5 else ("tag p",) if rng.random() < 0.7 else ("space",), rng.randint(0, 3), "x") for _ in range(rng.randint(0, 12))]
        tokens = [(f, 0 if f == ("space",) else k, t) for f, k, t in tokens]
        w = {"words": 1.0, "tag": -1.0, "tag p": -rng.choice([0.5, 1.0, 2.0])}
        own = brute_scores(tokens, w)
        value = lambda a, b: sum(own[a:b])  # noqa: B023, E731
        best = max([0.0, *(value(a, b) for a in range(len(tokens)) for b in range(a + 1, len(tokens) + 1))])
        assert html_text.scores(tokens, w) == pytest.approx(own) and value(*html_text.region(tokens, w)) == pytest.approx(best)


def brute_scores(tokens, w):
    """Each token's weight; tags between words share the cost of GAP words if they cost more."""
    out = [html_text.weight(w, f) * k for f, k, _ in tokens]
    words = [i for i, x in enumerate(tokens) if x[0][0] == "words"]
    for a, b in zip([-1, *words], [*words, len(tokens)], strict=True):
        if (cost := -sum(out[a + 1 : b])) > html_text.GAP * w["words"]:
            out[a + 1 : b] = [x * html_text.GAP * w["words"] / cost for x in out[a + 1 : b]]
    return out


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi omega."
MORE = LONG.replace("a", "o")
COMMON_PAGES = {
    "a form around everything": (f'<form id="aspnetForm"><div id="content"><p>{LONG}</p><p>{MORE}</p></div><label>Find</label><button>Go</button></form>', f"{LONG} {MORE}"),
    "an article that is called a widget": (f'<article class="post shared-widget"><p>{LONG}</p></article>', LONG),
    "social history": (f'<div class="social-history"><p>{LONG}</p></div>', LONG),
    "steps that are links": (f'<article><p>{LONG}</p><ul><li><a href="#1">Step one</a></li><li><a href="#2">Step two</a></li></ul><p>{MORE}</p></article>', f"{LONG} Step one Step two {MORE}"),
    "a table of numbers at the end": (f"<article><p>{LONG}</p><table><tr><td>1</td><td>20</td></tr><tr><td>3</td><td>40</td></tr></table></article>", f"{LONG} 1 20 3 40"),
    "a title in a box of its own": (f'<div class="title"><h1>My Title</h1></div><div class="text"><p>{LONG}</p></div>', f"My Title {LONG}"),
    "short blocks": ("<div><div>one short block of text here</div></div><div><div>another short block of text that is longer</div></div><div><div>third short block of text</div></div>", "one short block of text here another short block of text that is longer third short block of text"),
    "an article shorter than its footer": ("<article><h1>Two words.</h1></article>", "Two words."),
    "comments longer than the article": (f"<article><p>{LONG}</p></article><div class='comments'><p>{MORE}</p><p>{MORE}</p><p>{MORE}</p></div>", LONG),
}
AROUND = '<html><head><title>x</title><script>var a = 1;</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>{}<footer><p>&copy; 2024 Some company, all rights reserved by the people who made it</p></footer></body></html>'


@pytest.mark.parametrize("name", COMMON_PAGES)
def test_html_of_common_pages(name):
    body, want = COMMON_PAGES[name]
    weights = html_text.shipped_weights()
    assert html_text.extract(f"<html><body>{body}</body></html>", weights) == want
    page = AROUND.format(body)
    assert html_text.extract(page, weights) == want
    bare = "<ul><li><a href='/'>Archive</a></li><li><a href='/m'>March</a></li></ul><table><tr><td><i>here</i></td></tr></table>"  # no name says what it is
    tokens = html_text.parse(AROUND.format(bare + body))
    assert html_text.extract(AROUND.format(bare + body), weights) == want
    assert html_text.text_of(tokens, (0, len(tokens)), weights) != want  # the region alone leaves it out


def test_shipped_weights_are_what_training_gives(weights):
    assert html_text.shipped_weights() == pytest.approx(weights, abs=1e-6)


def test_html_takes_linear_time_on_damage(weights):
    for piece in ("<svg>", "<section></div>", "<script>", '<div class="ad">', "<a href='", "<!--", "<p <p "):
        times = []
        for n in (20_000, 80_000):
            start = time.process_time()
            html_text.extract(piece * n, weights)
            times.append(time.process_time() - start)
        assert times[1] < max(1.0, 8 * times[0]), piece


def test_html(spark, weights):
    page = "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies here</div><article><h1>Head</h1><p>One &amp; two&nbsp;three <b>fo</b>ur<p>Next\n\n line<br>end</p><form><label>Mail</label></form></article><section id=comments><p>First comment by a reader</p></section><footer>&copy; me</footer></body></html>"
    assert html_text.extract(page, weights) == "Head One & two three four Next line end"
    for odd in (None, "", "<", "<p", "<!--", "<script>", "</p></p>", '<p class="x>a', "&bogus;", "<p>" * 5000):
        assert isinstance(html_text.extract(odd, weights), str)
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract_pages(df, weights).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 39, 39] and html_text.extract_pages(df.limit(0), weights).count() == 0
    deep = "<div>" * 3000 + "<p>deep words in the middle</p>" + "</div>" * 3000
    assert html_text.extract(deep, weights) == "deep words in the middle"


# 7


def brute_components(rows, n, threshold):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    top = {i: i for i, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                top[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("n", "threshold", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_shingles(spark, monkeypatch, n, threshold, seed):
    monkeypatch.setattr(blocks, "BUCKET_NAMES", 300)
    monkeypatch.setattr(shingle_join, "COMMON_IN_SLICE", 2)
    rng, rows = random.Random(seed), odd_rows(seed)
    chain = [str(k) for k in range(60)]
    for i in range(600, 640):  # a chain of neighbours that are alike, with ends that aren't
        chain[rng.randrange(len(chain))] = f"w{i}"
        rows.append((i, " ".join(chain)))
    got = shingle_join.near_duplicates(make(spark, rows), n, threshold)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, n, threshold)


def thue_morse(order: int, pair: str) -> list[str]:
    """A word and its complement that differ everywhere and share every polynomial modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(1 << order)]
    return ["".join(pair[b] for b in bits), "".join(pair[1 - b] for b in bits)]


def test_structured_words_have_own_names(spark):
    rows = [(i + 1, w) for i, w in enumerate([*thue_morse(10, "ab"), *thue_morse(6, "ab"), *thue_morse(5, "xy")])]
    got = as_dict(shingle_join.near_duplicates(make(spark, rows)))
    assert {i: r.component_id for i, r in got.items()} == {i: i for i, _ in rows}


def test_shingle_sets_of_few_words():
    for n in (1, 2, 3, 4, 5):
        for total in range(2 * n + 1):
            for cut in range(total + 1):
                parts = [" ".join(f"w{i}" for i in range(cut)), "", " ".join(f"w{i}" for i in range(cut, total))]
                raw = [p.encode() for p in parts]
                at = np.cumsum([0, *map(len, raw)])
                sets = shingle_join.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), at, n)
                assert [len(x) for x in sets] == [0 if not k else max(1, k - n + 1) for k in (cut, 0, total - cut)]


@pytest.mark.parametrize("rows", [[(1, "hello world")], [(1, "one"), (2, "two")], [(1, "a b c"), (2, "a b c")], [*((i, f"w{i} " * 3) for i in range(10_000)), (10_000, "last one")]])
def test_shingles_of_short_tables(spark, rows):
    got = shingle_join.near_duplicates(make(spark, rows, extra=False).coalesce(1))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == (brute_components(rows, 4, 85) if len(rows) < 100 else collections.Counter((i, 1, i) for i, _ in rows))


def crowd(rng, n_copies, n_words, edits):
    """Altered copies of one text, many of them just beyond the threshold, some altered again."""
    base = [f"b{i}" for i in range(n_words)]
    texts = []
    for k in range(n_copies):
        w = list(base if k % 3 or not texts else rng.choice(texts))
        for j in range(rng.choice(edits)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[f"n{k}_{j}"], [], [w[at], f"m{k}_{j}"]])
        texts.append(w)
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize(("n", "threshold", "leaders", "few"), [(4, 85, 2, 64), (5, 80, 1, 5), (4, 85, 1, 0)])
def test_shingles_of_crowds(spark, monkeypatch, n, threshold, leaders, few):
    monkeypatch.setattr(shingle_join, "LEADERS", leaders)
    monkeypatch.setattr(shingle_join, "FEW", few)
    rng, rows = random.Random(n + leaders), []
    for size in (40, 90, 200):
        rows += [(len(rows) + i, t) for i, t in enumerate(crowd(rng, 60, size, (0, size // 60, size // 40, size // 30, size // 25, size // 20)))]
    rows += [(len(rows) + i, " ".join(f"u{i}_{j}" for j in range(9)) + " " + " ".join(f"b{j}" for j in range(40))) for i in range(20)]
    rng.shuffle(rows)
    got = shingle_join.near_duplicates(make(spark, rows, extra=False), n, threshold)
    want = brute_components(rows, n, threshold)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    assert 3 < len({c for _, _, c in want}) < len(rows)


def test_shingles_without_links(spark):
    rows = [(1, "a b c d e"), (2, "f g h i j"), (3, None)]
    got = as_dict(shingle_join.near_duplicates(make(spark, rows)))
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 2, 3: 3}
    assert shingle_join.near_duplicates(make(spark, rows).limit(0)).count() == 0
    kept = shingle_join.keep_first(make(spark, [*rows, (9, "A b c d e"), (None, "q")]))
    assert kept.columns == make(spark, rows).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]


def test_components(spark):
    links = [(i, i + 1) for i in range(8)] + [(100, 200), (200, 100), (100, 100), (7, 300)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(9)} == {0} and got[300] == 0 and got[200] == 100
    assert components.components(spark.createDataFrame([], "a long, b long")) is None


# 8 and 9

SIGNS = [" ", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "a", "b", "'s", "'t", "é", "é", "ß", "1", "½", "!", "...", "😀", "日本", "\r\n", "the", "ing", "İ", "Σ", "<|endoftext|>"]


def odd_texts(n=1500, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["x" * 3000, "ab" * 2000, " " * 500]


def test_bpe_equals_the_library(spark, monkeypatch):
    import tiktoken

    monkeypatch.setattr(bpe, "KEPT_UNITS", 50)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Codec(ranks, T.PATTERN)
    for x in odd_texts():
        ids = own.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(x), repr(x)
        assert own.decode(ids) == x.encode()
    rows = odd_rows()
    for r, (i, t) in zip(sorted(bpe.round_trip(make(spark, rows), BPE, T.PATTERN).collect(), key=lambda r: (str(r.doc_id), r.ids_sha256)), sorted(((i, t) for i, t in rows), key=lambda x: (str(x[0]), hashlib.sha256(np.array(lib.encode_ordinary(x[1] or ""), "<u4").tobytes()).hexdigest())), strict=True):
        assert r.doc_id == i and r.n_tokens == len(lib.encode_ordinary(t or "")) and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(make(spark, rows), BPE, T.PATTERN), BPE, T.PATTERN)
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((i, t or "") for i, t in rows)
    assert bpe.round_trip(make(spark, rows).limit(0), BPE, T.PATTERN).count() == 0


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def test_word_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_UNITS", 40)
    monkeypatch.setattr(token_files, "KEPT_WORDS", 30)
    own, texts = token_files.LibraryEncoder(WORD), [*odd_texts(), "foo <|endoftext|> bar", "x<|ENDOFTEXT|>y", " <|startoftext|>\n.<|endoftext|> ", "<| endoftext |>", "a <|endoftext|><|endoftext|>"]
    got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 100) for x in own.encode(texts[i : i + 100])]
    assert got == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_calls_the_library_for_many_words():
    """Words alone and with any closing signs, joined in one call of the library; words were encoded one by one before."""
    rng = random.Random(4)
    made = ["".join(rng.choice("aeionstrdéñüßÀÎçİΣς") for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    signs = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "###", ".,*", "'s", "'re", ">\u0338", "</w>", "...\"", "_1", "</W>,"]
    texts = [" ".join(w.capitalize() * (rng.random() < 0.2) or w + rng.choice(signs) * (rng.random() < 0.4) for w in rng.choices(made, k=40)) for _ in range(150)]
    own, calls = token_files.LibraryEncoder(WORD), []
    lib = own.word_tokenizer

    class Counted:
        def encode_batch_fast(self, given, **how):
            calls.extend(given)
            return lib.encode_batch_fast(given, **how)

    own.word_tokenizer = Counted()
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert 0 < len(calls) < 20


def test_shards_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, token_files.BLOCK - 1, token_files.BLOCK, token_files.BLOCK + 1, 3 * token_files.BLOCK + 7):
        for high in (0, 1, 300, 50_000, 2**32 - 1):
            x = rng.integers(0, high, n, dtype=np.uint64, endpoint=True).astype(np.uint32)
            x[::97] = min(2**32 - 1, 1000 * high)
            ids, counts, back = token_files.decode_shard(token_files.encode_shard([5, token_files.NO_ID], [x[: n // 2], x[n // 2 :]]))
            assert (back == x).all() and counts.tolist() == [n // 2, n - n // 2] and ids[1] == token_files.NO_ID
    with pytest.raises(ValueError):
        token_files.decode_shard(b"\0" * 16)


def test_token_files(spark, tmp_path, monkeypatch):
    rows = odd_rows()
    got = token_files.write_and_digest(make(spark, rows), WORD).collect()
    lib = library()
    made = sorted(((-1, i) if i is None else (i, i), lib.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    start, want = 0, []
    for (_, i), ids in made:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: x[1]) == want
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(make(spark, rows), path, WORD)
    assert sum(len(r.ids) for r in token_files.read_tokens(spark, path).collect()) == start
    (tmp_path / "plain").mkdir()
    token_files.export(spark, path, str(tmp_path / "plain"))
    assert sum(len(token_files.decode_shard(p.read_bytes())[2]) for p in (tmp_path / "plain").glob("*.pfr")) == start
    assert token_files.write_and_digest(make(spark, rows).limit(0), WORD).count() == 0


def test_query_names():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 14))
