"""Comparison of versions at size: what the driver holds, and verdicts within rows."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.functions.text import cosine
from quire.operators import diff, differ


@pytest.fixture
def plans(monkeypatch):
    """The plans of all staged tables, by name."""
    seen = []
    for module in (diff, differ):
        monkeypatch.setattr(module, "staged", lambda df, name, write=module.staged: (seen.append((name, df._jdf.queryExecution().executedPlan().toString())), write(df, name))[1])
    return seen


def test_matches_held_are_not_broadcast(spark, plans):
    v = spark.range(600).select(F.concat(F.lit("d"), F.floor(F.col("id") / 100)).alias("document_id"), "id", F.array(*[F.rand(i) - 0.5 for i in range(8)]).alias("e")).localCheckpoint()
    v1, v2 = v.withColumnsRenamed({"id": "id1", "e": "e1"}), v.withColumnsRenamed({"id": "id2", "e": "e2"})
    assert diff.align_greedy(v1, v2).filter("id1 = id2").count() == 600
    held = [p for name, p in plans if name == "held"]
    assert len(held) > 1 and not any("Broadcast" in p for p in held)


def test_rounds_do_not_broadcast(spark, plans, monkeypatch):
    monkeypatch.setattr(differ, "NEAR", 3_000)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc. XYZ") for _ in range(n)) for n in (90, 120, 260, 300)]
    pairs = spark.createDataFrame([(i, list(a), list(b)) for i, (a, b) in enumerate(zip(texts, texts[1:]))], "key long, a array<string>, b array<string>")
    got = {r.key: r.below for r in differ.less_alike(pairs).collect()}
    assert got == {i: SequenceMatcher(None, a, b).ratio() < 0.5 for i, (a, b) in enumerate(zip(texts, texts[1:]))}
    rounds = [p for name, p in plans if name in ("runs", "round")]
    assert len(rounds) > 1 and not any("Broadcast" in p for p in rounds)


def test_long_texts_are_judged_in_their_rows(spark, plans):
    """Before: texts of over 65,536 characters went in rounds over all equal characters."""
    rng = random.Random(3)
    text = "".join(rng.choice("etaoins   rhldu") if rng.random() < 0.9 else rng.choice("QZ.,\n") for _ in range(70_000))
    aligned = spark.createDataFrame([("d", "s", "modified", 1, 1, text, text[:40_000] + "é" + text[40_000:]), ("d", "t", "modified", 1, 1, text, "\n" * 70_000)], "document_id string, section string, change_type string, page_v1 int, page_v2 int, content_v1 string, content_v2 string")
    got = {r.section: r.significance for r in diff.changes(aligned).collect()}
    assert SequenceMatcher(None, text, text[:40_000] + "é" + text[40_000:]).ratio() > 0.5
    assert got == {"s": "low", "t": "medium"} and {name for name, _ in plans} == {"aligned"}


def test_counts_do_not_compare_words(spark):
    rows = [("d", "s", "modified", 1, 1, "one two", "one 2"), ("d", "s", "removed", 1, None, "gone", None)]
    changed = diff.changes(spark.createDataFrame(rows, "document_id string, section string, change_type string, page_v1 int, page_v2 int, content_v1 string, content_v2 string"))
    plan = diff.by_significance(changed)._jdf.queryExecution().optimizedPlan().toString()
    assert "verdict(" in plan and "details(" not in plan and "_near_blocks" not in plan  # before: words were compared and joined to it
    assert sorted(r.details for r in changed.collect()) == ["'two' → '2'", "Section removed: s"]


@pytest.mark.parametrize("words", [1, 3, 20, 150])
def test_verdicts_and_first_edits(words):
    r = random.Random(words)
    for n in [0, 1, 7, 60, 199, 200, 420] * 4:
        a = [int(words * r.random() ** 2) for _ in range(n)]
        b = [x for w in a for x in r.choice([[w]] * r.choice([1, 8, 40]) + [[], [w, -1], [r.randrange(words)]])]
        for x, y in ((a, b), (b, a), (a, a), (a, b[::-1])):
            m = SequenceMatcher(None, x, y)
            for threshold in (0.0, 0.3, 0.5, m.ratio(), 0.9):
                assert differ.alike_below(x, y, threshold) == (m.ratio() < threshold)
            assert differ.alike_below("".join(chr(500 + w) for w in x), "".join(chr(500 + w) for w in y), 0.5) == (m.ratio() < 0.5)
            edits = {"equal": "", "replace": "'{}' → '{}'", "delete": "Removed: '{}'", "insert": "Added: '{1}'"}
            x, y = [str(w) for w in x], [str(w) for w in y]
            want = [edits[t].format(" ".join(x[i:j]), " ".join(y[k:q])) for t, i, j, k, q in m.get_opcodes() if t != "equal"]
            assert differ._edits(x, y, 5) == "; ".join(want[:5]) and differ._edits(x, y, 10_000) == "; ".join(want)


@pytest.mark.parametrize(("threshold", "block"), [(0.7, 256), (0.7, 3), (-0.2, 3)])
def test_similar_pairs_in_blocks(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(diff, "BLOCK", block)
    rng = random.Random(7)
    odd = [None, [], [0.0] * 3, [1.0], [math.nan, 1.0, 0.0], [1e-170, 0.0, 1e-170], [1e300, 1e300, 0.0], [1.0, None, 0.0]]
    side = lambda: [(f"d{i % 2}" if i else None, i, odd[i % 29] if i % 29 < len(odd) else [rng.gauss(0, 1) for _ in range(3)]) for i in range(90)]
    left, right = (spark.createDataFrame(side(), f"document_id string, id{n} long, e{n} array<double>") for n in (1, 2))
    all_pairs = left.join(right, "document_id").select("document_id", "id1", "id2", F.coalesce(cosine(F.col("e1"), F.col("e2")), F.lit(0.0)).alias("similarity"))
    want, got = (sorted(repr(tuple(r)) for r in df.collect()) for df in (all_pairs.filter(F.col("similarity") >= threshold), diff._alike(left, right, threshold)))
    assert got == want and len(got) > 300
