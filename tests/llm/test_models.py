"""Importance resampling, whitening and the language model against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import importance, maxent, whitening

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank, long and repeated texts, repeated rows, and columns with clashing names."""
    long = "word " * 60000 + "x" * 200_000 + " " * 200_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 1), (4, long, "en", "s", 1), (4, long, "en", "s", 1), (None, "abc def", "de", "s", 1), (None, None, None, None, None), (5, "123 !!", None, "s", 1)]
    names = ("n_words", "n_features", "weight", "score", "rank", "row", "word", "n", "tail", "e", "span", "first")
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in names})


# Importance resampling


def brute_draw(docs, target, percent, least, longest=1, n=10_000):
    """doc_id to n_features, weight, score and rank."""

    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    own, t = {i: features(x) for i, x in docs}, Counter(b for x in target for b in features(x)[1])
    s = Counter(b for _, f in own.values() for b in f)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + n) / ((s[b] + 1) * (t.total() + n))))
    out = {}
    for i, (words, f) in own.items():
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words]
    drawn = sorted((i for i in out if out[i][4] >= least), key=lambda i: (-out[i][2], i))
    for k, i in enumerate(drawn[: len(drawn) * percent // 100]):
        out[i][3] = k + 1
    return {i: tuple(x[:4]) for i, x in out.items()}


@pytest.mark.parametrize(("longest", "percent", "span"), [(1, 10, 4096), (2, 40, 7), (3, 100, 100_000)])
def test_importance(spark, monkeypatch, longest, percent, span):
    monkeypatch.setattr(importance, "SPAN", span)
    rng = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(80)] + ["Été", "ÀB", "🙂", "a-b", "x\x00y"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += texts[:40]
    target = [" ".join(rng.choice(vocabulary[:20]) for _ in range(12)) for _ in range(9)]
    got = importance.resample(frame(spark, texts), frame(spark, target), percent, 15, longest).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == brute_draw(list(enumerate(texts)), target, percent, 15, longest)
    monkeypatch.setattr(importance, "BROADCAST_SCORES", 0)
    again = importance.resample(frame(spark, texts), frame(spark, target), percent, 15, longest).collect()
    assert sorted(again) == sorted(got)
    kept = importance.keep_drawn(frame(spark, texts), frame(spark, target), percent=percent, least_words=15, longest=longest)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r["rank"]}


def test_importance_awkward(spark, awkward):
    got = importance.resample(awkward, awkward, percent=100, least_words=1).collect()
    assert len(got) == 8 and sorted(r["rank"] or 0 for r in got) == [0, 0, 0, 0, 1, 2, 3, 4]
    assert {(r.n_features, r.weight) for r in got if r.doc_id in (1, 2, 3)} == {(0, 0)}
    assert sorted(r.n_features for r in got if r.doc_id == 4) == [60001, 60001]
    assert importance.resample(awkward.limit(0), awkward).count() == 0
    assert importance.resample(awkward, awkward.limit(0)).count() == 8


def test_importance_shuffles_counts_only(spark):
    df = importance.score(frame(spark, ["a b"]), np.zeros(10, np.int64))
    assert not re.search("Exchange|Generate|Python|Arrow", df._jdf.queryExecution().executedPlan().toString())


# Whitening


def brute_whiten(rows, k):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    c = np.array([[(n * a - t) / n for a, t in zip(v, s)] for v in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    deviation = [sum((n * a - t) ** 2 for a, t in zip(v, s)) for v in x]
    return kept, deviation, c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    rows = [(i, [float(c) for c in mix @ rng.normal(size=6)]) for i in range(500)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [math.nan] * 6), (503, [math.inf] * 6), (504, rows[0][1]), (505, [1e3, -3e5, 0.0, 0.0, 1e-30, -0.0]), (506, [1.0]), (507, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("component", F.lit(1))
    want, deviation, white, explained = brute_whiten([r for r in rows if r[0] < 506], 4)
    whole = {r.vec_id: r for r in whitening.whiten(df, 4).collect()}
    assert {i: int(r.deviation) for i, r in whole.items()} == {i: d for (i, _), d in zip(want, deviation)}
    got = whitening.by_component(whitening.whiten(df, 4)).collect()
    assert len(got) == 4 * len(want) and {r.n for r in got} == {len(want)}
    at = {i: k for k, (i, _) in enumerate(want)}
    sign = {c: np.sign(white[0, c] * next(r.whitened for r in got if r.vec_id == want[0][0] and r.component == c + 1)) for c in range(4)}
    assert all(abs(r.whitened - sign[r.component - 1] * white[at[r.vec_id], r.component - 1]) < 1e-6 for r in got)
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-6 for r in got)
    assert {r.identity_error < 1e-4 for r in got} == {True} and len({r.identity_error for r in got}) == 1
    assert {r.vec_id for r in got if r.deviation is None} == {i for i, d in zip(at, deviation) if d >= 2**63}


def test_whitening_awkward(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])] * 3, schema))
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one.collect()] == [(3, 0, [], 0.0)] * 3
    assert whitening.by_component(one).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], schema)).collect()
    assert {len(r.whitened) for r in flat} == {1}  # the second direction has no variance


# The language model


def brute_base(docs):
    learnt = Counter()
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            learnt.update([*(t or "").encode().lower().split(), None])
    n, v, out = learnt.total(), len(learnt), []
    for i, t in docs:
        w = [*(t or "").encode().lower().split(), None]
        out.append((i, len(w), sum(learnt[x] > 0 for x in w), n, sum(math.log10((learnt[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


@pytest.mark.parametrize("bound", [300, maxent.HEAD])
def test_language_model(spark, bound):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in maxent.language_model(frame_of(spark, docs), bound=bound).collect()}
    for i, n_tokens, n_known, n, base in brute_base(docs):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    held = [r for r in got.values() if r.held_out]
    per_token = lambda c: sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.7 and sum(r.score > r.base_score for r in held) > (0.95 if bound > 300 else 0.8) * len(held)


def frame_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


def test_model_probabilities_add_up(spark):
    """Over all words and each class's unknown word, after several contexts."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=40)) for _ in range(60)]
    docs = frame_of(spark, list(enumerate(texts)))
    model, rare = maxent.fit(docs, bound=20)
    rest = {r.word: r.n for r in rare.collect()}
    assert len(rest) + 20 == len({w for t in texts for w in t.split()}) and model.total == 60 * 41
    for context in ("", "w0", "w1 w0 w3", "unseen w2"):
        p = maxent.places(model, [context.encode()])
        of_class = maxent.chances(model.weights, p.features)[-1].astype(float)
        inside = np.zeros(maxent.CLASSES)
        np.add.at(inside, model.group, 10.0**model.inside)
        for w, n in rest.items():
            g = model.by_letters(bytes(w))
            inside[g] += (n - model.discount) / 10 ** model.norm[g]
        inside += np.where(np.arange(maxent.CLASSES) > maxent.MARKS, 10.0 ** (model.unknown - model.norm), 0)
        used = np.arange(maxent.CLASSES) <= min(maxent.MARKS, 20)
        assert inside[used | (np.arange(maxent.CLASSES) > maxent.MARKS)] == pytest.approx(1) and of_class.sum() == pytest.approx(1, abs=1e-4)
        # Marks that no word fills have no probability to speak of.
        assert of_class[~used & (np.arange(maxent.CLASSES) <= maxent.MARKS)].sum() < 0.05


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(maxent.BUCKETS + 1, maxent.CLASSES))
    features, group = rng.integers(0, 50, (30, maxent.FEATURES)), rng.integers(0, maxent.CLASSES, 30)
    loss = lambda x: -np.log(maxent.chances(x, features)[range(30), group]).sum()
    after, squares, uses = w.copy(), np.zeros(len(w)), np.zeros(len(w))
    maxent.descend(after, squares, uses, features, group)
    for row in (int(features[0, 0]), len(w) - 1):
        g = np.array([(loss(bump(w, row, c, 1e-5)) - loss(bump(w, row, c, -1e-5))) / 2e-5 for c in range(5)])
        assert (w - after)[row, :5] == pytest.approx(maxent.RATE * g / np.sqrt(squares[row] + 1e-6), rel=1e-4, abs=1e-8)
    assert uses[-1] == 30 and uses[:50].sum() == features.size and loss(after) < loss(w)


def bump(w, row, c, by):
    out = w.copy()
    out[row, c] += by
    return out


def test_features_stay_within_texts():
    ids, length = np.arange(1, 8), np.array([3, 1, 3])
    assert maxent.before(ids, length, 1, 0).tolist() == [0, 1, 2, 0, 0, 5, 6]
    assert maxent.before(ids, length, 2, 0).tolist() == [0, 0, 1, 0, 0, 0, 5]
    assert maxent.before(ids, length, 3, 0).tolist() == [0] * 7
    whole = maxent.hashed(ids, ids, length)
    alone = np.concatenate([maxent.hashed(ids[a:b], ids[a:b], np.array([b - a])) for a, b in ((0, 3), (3, 4), (4, 7))])
    assert (whole == alone).all()


def test_language_model_awkward(spark, awkward):
    got = maxent.language_model(awkward).collect()
    assert len(got) == 8 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.n_tokens for r in got if r.doc_id == 4} == {60002}
    want = {(i, *x) for i, *x, _ in brute_base([(r.doc_id, r.text) for r in awkward.collect()])}
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == want
    assert maxent.language_model(awkward.limit(0)).count() == 0
    nothing = maxent.language_model(awkward.filter("doc_id IS NULL")).collect()  # nothing to learn from
    assert [(r.base_score, r.held_out) for r in nothing] == [(0.0, False)] * 2
