"""Whitening of embeddings by a covariance in two passes.

Entries become integers, so the first pass sums them exactly. The second sums outer products of the centred vectors: numpy
multiplies each batch with itself, tasks add up their batches, and a tree of tasks adds up theirs, so that the driver merges
a few matrices however many tasks there are. LAPACK's symmetric solver gives the components; the projection, whose size is
that of the dimensions, goes to all tasks. A third pass measures how far the whitened vectors' own covariance is from one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_batches, stage

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components to keep, and the share of the largest eigenvalue at and below which a direction counts as one without variance.
COMPONENTS, LEAST = 32, 1e-12
ROWS = 2000  # vectors that a task holds as integers at a time
DEPTH = 3  # of the tree in which tasks merge their matrices


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and e, the entries as doubles, of the rows whose vector has entries, all of them finite and small enough for a long."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**53)
    e = F.col(vec).cast("array<double>")
    return vectors.filter(F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(e, fits)).select("vec_id", e.alias("e"))


def common_length(vectors: DataFrame) -> int | None:
    """The most frequent length of e (ties: the smallest); null without rows."""
    top = vectors.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return top and top["d"]


def integers(column: pa.ListArray, d: int) -> np.ndarray:
    """A batch's entries as integers, one row for each vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * flat).astype(np.int64) + OFFSET


def sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of every dimension; each batch sends one row for each dimension."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            x = integers(b.column(0), d)
            part = x.sum(axis=0).tolist() if b.num_rows == 0 or np.abs(x).max() < 2**62 // b.num_rows else x.astype(object).sum(axis=0).tolist()
            n, total = n + len(x), [p + q for p, q in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(t) for t in total], pa.string())], ["dim", "n", "s"])

    rows = in_batches(vectors.select("e"), each, "dim int, n long, s string", ROWS).groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["dim"]: r for r in rows.collect()}  # one row for each dimension
    return found[0]["n"], [int(found[k]["s"]) for k in range(d)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly: 64-bit integers where they suffice, else the language's own."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, total)) < 2**63:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def covariance(rows: DataFrame, d: int, each) -> np.ndarray:
    """The sum over all batches of the matrix that ``each`` makes of one, merged by a tree of tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            total += each(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    matrices = in_batches(rows, task, "m binary", ROWS).rdd.map(lambda r: np.frombuffer(r["m"], np.float64))
    return matrices.treeAggregate(np.zeros(d * d), lambda a, b: a + b, lambda a, b: a + b, DEPTH).reshape(d, d)


def solve(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; directions without variance are left out."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > LEAST * max(e[0], 0)).sum()))
    return e[:k], u[:, :k]


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec: str = "embedding") -> DataFrame:
    """vec_id, n, deviation (decimal), whitened (array), explained (array) and identity_error of every usable row of ``vectors``.

    Rows with a null or empty vector, or one with entries that are null, not finite or 2^53 or more in size, go; so do vectors
    that have not the most frequent length. Directions without variance have no component, so a table of one vector, or of
    equal ones, has empty arrays and an identity_error of 0. Null ids and repeated rows count like any other; further columns
    are ignored; an empty table gives an empty result.
    """
    spark, kept = vectors.sparkSession, usable(vectors, vec)
    d = common_length(kept)
    schema = f"vec_id {kept.dtypes[0][1]}, deviation string, whitened array<double>"
    if d is None:
        return kept.select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), *[F.array().cast("array<double>").alias(c) for c in ("whitened", "explained")], F.lit(0.0).alias("identity_error"))
    kept = kept.filter(F.size("e") == d)
    n, total = sums(kept, d)

    def outer(b: pa.RecordBatch) -> np.ndarray:
        c = centred(integers(b.column(0), d), n, total).astype(np.float64) / n
        return c.T @ c

    v = covariance(kept.select("e"), d, outer) / n
    e, u = solve(v, components)
    shared = spark.sparkContext.broadcast(u / np.sqrt(e))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = centred(integers(b.column(1), d), n, total)
            small = c.dtype != object and float(np.abs(c).max(initial=0)) < (2**62 / d) ** 0.5
            deviation = (c * c if small else c.astype(object) ** 2).sum(axis=1)
            w = (c.astype(np.float64) / n) @ shared.value
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([str(x) for x in deviation.tolist()], pa.string()), lists], ["vec_id", "deviation", "whitened"])

    # Read twice, by the third pass and by the result.
    out = stage(in_batches(kept.select("vec_id", "e"), project, schema, ROWS), "whitened")
    k = len(e)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        w = np.ones((b.num_rows, k + 1))
        w[:, :k] = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return w.T @ w

    error = 0.0
    if k:
        m = covariance(out.select("whitened"), k + 1, moments) / n  # the last column has the means, which are 0 but for rounding
        error = float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max())
    explained = F.lit((e / np.trace(v)).tolist()) if k else F.array().cast("array<double>")
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """One row for each vector and component. A deviation beyond a long is null (``whiten`` has it)."""
    each = whitened.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"), "explained", "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
