"""The relational differ against the standard library's."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.operators import differ


def cases():
    rng, rows = random.Random(3), []
    for n in range(60):
        letters = "abcdefgh"[: rng.randint(1, 8)] if n % 2 else "abcdefghijklmnopqrstuvwxyz    eeeett"
        a = [rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 60, 199, 200, 260, 350]))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 6))):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.choice(letters + "XYZ"))
        if n % 5 == 0:
            b = [rng.choice(letters) for _ in range(rng.choice([0, 50, 210, 300]))]
        rows.append((n, a, b))
    return rows


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(cases(), "key long, a array<string>, b array<string>").repartition(2)


def test_blocks(pairs):
    got = {}
    for r in differ.blocks(pairs).collect():
        got.setdefault(r.key, []).append((r.i, r.j, r.k))
    popular = 0
    for n, a, b in cases():
        merged = []
        for i, j, k in sorted(got.get(n, [])):
            if merged and (merged[-1][0] + merged[-1][2], merged[-1][1] + merged[-1][2]) == (i, j):
                merged[-1] = (*merged[-1][:2], merged[-1][2] + k)
            else:
                merged.append((i, j, k))
        m = SequenceMatcher(None, a, b)
        assert merged == [tuple(x) for x in m.get_matching_blocks()][:-1]
        popular += bool(m.bpopular)
    assert popular > 10


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_less_alike(pairs, threshold):
    got = {r.key: r.below for r in differ.less_alike(pairs, threshold).collect()}
    assert got == {n: SequenceMatcher(None, a, b).ratio() < threshold for n, a, b in cases()} and len(set(got.values())) == 2


def test_words_and_markup(spark):
    texts = [("one two three four", "one 2 three"), ("", "new words"), ("gone now", ""), ("same text", "same text"), (None, "x"), ("a\xa0b c", "a b c d"), ("p q r s t u v", "P q R s T u V")]
    pairs = differ.distinct_pairs(spark.createDataFrame(texts * 2, "a string, b string"), "a", "b", differ.words)
    assert pairs.count() == len(texts)
    keyed = spark.createDataFrame(texts, "x string, y string").withColumn("key", differ.pair_key(F.col("x"), F.col("y")))
    got = keyed.join(differ.word_changes(pairs), "key").join(differ.word_markup(pairs), "key").collect()
    assert len(got) == len(texts)
    for r in got:
        x, y, edits, out = (r.x or "").split(), (r.y or "").split(), [], []
        for tag, i, j, k, m in SequenceMatcher(None, x, y).get_opcodes():
            old, new = " ".join(x[i:j]), " ".join(y[k:m])
            edits += {"equal": [], "replace": [f"'{old}' → '{new}'"], "delete": [f"Removed: '{old}'"], "insert": [f"Added: '{new}'"]}[tag]
            out += x[i:j] if tag == "equal" else [f"~~{old}~~"] * (j > i) + [f'<span style="color:red">{new}</span>'] * (m > k)
        assert r.details == "; ".join(edits[:5]) and r.markup == " ".join(out)


def test_no_pairs(spark):
    none = spark.createDataFrame([], "key string, a array<string>, b array<string>")
    assert differ.blocks(none).count() == differ.less_alike(none).count() == differ.word_markup(none).count() == 0


@pytest.mark.parametrize(("name", "text"), [("blanks", "x" + " " * 1_000_000 + "y"), ("digits", "1" * 1_000_000), ("matches", " a" * 100_000)])
def test_long_texts_in_linear_time(spark, name, text):
    import time

    from quire.functions.text import match_starts, strip
    from quire.operators.language import RANGE

    began = time.time()
    r = spark.createDataFrame([(text,)], "t string").select(strip(F.col("t")).alias("s"), F.size(match_starts(F.col("t"), RANGE[1])).alias("n"), F.size(match_starts(F.col("t"), " a")).alias("m")).first()
    assert (r.s, r.n, r.m) == (text.strip(), 0, text.count(" a")) and time.time() - began < 30


def test_far_pairs_in_rounds(spark, monkeypatch):
    """Pairs beyond NEAR go through the rounds, beside others that do not."""
    some = [c for c in cases() if c[0] < 12]
    pairs = spark.createDataFrame(some, "key long, a array<string>, b array<string>")
    blocks = lambda: {(r.key, tuple(r.a[r.i : r.i + r.k]), r.j - r.i) for r in differ.blocks(pairs).join(pairs, "key").collect()}
    edits = lambda: {tuple(r) for r in differ.word_changes(pairs, 1_000).collect()}
    below = lambda: {tuple(r) for r in differ.less_alike(pairs).collect()}
    whole = (edits(), below(), sum(len(w) for _, w, _ in blocks()))
    monkeypatch.setattr(differ, "NEAR", 5_000)
    assert (edits(), below(), sum(len(w) for _, w, _ in blocks())) == whole


def test_unrelated_texts_take_no_rounds(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["so", "it", "was", "then", "a", "long", "day"]) + str(rng.randint(0, 9)) for _ in range(150))
    texts = spark.createDataFrame([(text(), text()) for _ in range(20)], "x string, y string")
    pairs = differ.distinct_pairs(texts, "x", "y", differ.words)
    spark.sparkContext.setJobGroup("differ", "differ")
    try:
        assert differ.blocks(pairs).count() > 20 and differ.less_alike(pairs).count() == 20
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("differ")) < 12
    finally:
        spark.sparkContext.setJobGroup("", "")
