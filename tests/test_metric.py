"""The metric index against comparing all pairs."""

import random

import numpy as np
import pytest

from quire.operators import metric, vectors


def brute(v, q, k, same=False, skip_self=False):
    out = set()
    for i, x, g in q:
        near = sorted((float(((np.array(y) - np.array(x)) ** 2).sum()), j) for j, y, h in v if y is not None and x is not None and (not same or (g is not None and g == h)) and not (skip_self and i == j))[:k]
        out |= {(i, j, n + 1) for n, (_, j) in enumerate(near)}
    return out


def clustered(rng, n, spread):
    centres = rng.normal(size=(12, 8)) * 10
    return [(i, (centres[i % 12] + rng.normal(size=8) * spread).tolist(), f"g{i % 3}") for i in range(n)]


def frames(spark, v, q, parts=5):
    index = spark.createDataFrame(v, "vec_id long, e array<double>, label string").repartition(parts)
    return index, spark.createDataFrame([(i, x, g) for i, x, g in q], "query_id long, q array<double>, label string")


@pytest.mark.parametrize(("same", "skip_self", "broadcast"), [(False, False, 1 << 20), (True, False, 0), (False, True, 0), (True, True, 1 << 20)])
def test_search_equals_all_pairs(spark, monkeypatch, same, skip_self, broadcast):
    for name, value in (("BLOCK", 9), ("BUFFER", 70), ("BLOCKS_A_KEY", 2), ("SAMPLE", 60), ("BROADCAST_BYTES", broadcast)):
        monkeypatch.setattr(metric, name, value)
    rng = np.random.default_rng(4)
    v = clustered(rng, 300, 1.0)
    v += [(1000 + i, v[5][1], "g1") for i in range(90)]  # a third of them copies
    v += [(2000, None, "g0"), (2001, v[7][1], None)]
    q = v[:40] + [(5000, [100.0] * 8, "g0"), (5001, None, "g1"), (5002, v[9][1], None), (1003, v[5][1], "g1"), (5003, [0.0] * 8, "none")]
    index, queries = frames(spark, v, q)
    found = vectors.search(index if same else index.drop("label"), queries if same else queries.drop("label"), 4, "label" if same else None, skip_self)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect()} == brute(v, q, 4, same, skip_self)


def test_cells_are_pruned(spark):
    rng = np.random.default_rng(5)
    v = clustered(rng, 3000, 0.2)
    index, queries = frames(spark, v, v[::50])
    built = metric.build(index.drop("label"))
    met, every = metric.compared(built, queries.drop("label"), 5)
    assert every == 60 * 3000 and met < 0.2 * every
    got = {(r.query_id, r.vec_id, r["rank"]) for r in metric.search(built, queries.drop("label"), 5).collect()}
    assert got == brute(v, v[::50], 5)


def test_no_pairs_without_a_key(spark):
    rng = np.random.default_rng(6)
    index, queries = frames(spark, clustered(rng, 50, 1.0), clustered(rng, 9, 1.0))
    plan = vectors.search(index.drop("label"), queries.drop("label"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ties_go_by_id_and_empty_tables(spark):
    v = [(i, [float(i % 2), 0.0], "x") for i in random.Random(1).sample(range(40), 40)]
    index, queries = frames(spark, v, [(1, [0.0, 0.0], "x")])
    assert [r.vec_id for r in vectors.search(index.drop("label"), queries.drop("label"), 5).orderBy("rank").collect()] == [0, 2, 4, 6, 8]
    assert vectors.search(index.limit(0).drop("label"), queries.drop("label"), 5).count() == 0
    assert vectors.search(index.drop("label"), queries.limit(0).drop("label"), 5).count() == 0
    assert vectors.search(index.drop("label"), queries.drop("label"), 100).count() == 40
