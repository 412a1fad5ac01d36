"""Exact nearest neighbours by a metric index: cells around pivots, pruned by the triangle inequality.

A bounded sample of the vectors gives the pivots; every vector belongs to its nearest one. Vectors of a cell are packed into
blocks ordered by their distance to the pivot, queries likewise, and blocks meet queries in an equi-join by cell, where each
pair of blocks is one matrix product of which only the nearest vectors leave. Each query first searches its own cell. The
distance that it finds bounds the search: no vector within it lies in a cell whose pivot is further from the query than the
cell's radius and that distance, or whose boundary with the query's own cell is further off than that, or in a block whose
distances to the pivot differ by more from the query's. What the bounds cannot exclude is compared, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quire.functions.staging import staged

#: Vectors from which pivots are made, pivots at most, and passes over the sample.
SAMPLE, CELLS, PASSES = 4096, 256, 6
#: Vectors that a task sorts into blocks at a time, vectors of a block, and blocks of a cell that one join key holds.
BUFFER, BLOCK, BLOCKS_A_KEY = 20_000, 512, 64
#: Bytes of query blocks that a task holds before it hands them on: a query has a copy for each cell that it may reach.
HELD_BYTES = 8 << 20
#: Query blocks of more bytes than this are joined by shuffle instead of broadcast.
BROADCAST_BYTES = 32 << 20
#: Rounding that the bounds allow for, relative to the lengths of the vectors.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """blocks: cell, same, n, low and high (least and greatest distance to the pivot), ids and m (the vectors, one after another)."""

    blocks: DataFrame
    pivots: np.ndarray
    radius: np.ndarray  # of each cell
    keys: np.ndarray  # join keys of each cell
    same: bool
    schema: StructType


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` to all of ``y``, to about SLACK."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0))


def pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """About half the root of ``n`` pivots, at most CELLS: means of a sample's nearest vectors, after PASSES passes."""
    rows = vectors.select("vec_id", "e").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("e").toArrow()
    x = np.concatenate([_lists(c) for c in rows.column("e").chunks if len(c)])
    rng = np.random.default_rng(11)
    p = x[rng.choice(len(x), min(len(x), max(1, min(CELLS, round(math.sqrt(n) / 2)))), replace=False)]
    for _ in range(PASSES):
        near = distances(x, p).argmin(1)
        p = np.stack([x[near == c].mean(0) if (near == c).any() else p[c] for c in range(len(p))])
    return p


def build(vectors: DataFrame, same: str | None = None) -> Index | None:
    """The index of ``vectors`` (vec_id, e, and the column ``same``); none without vectors. Null vectors, and null ``same``, are left out."""
    kept = vectors.filter(F.col("e").isNotNull() & (F.col(same).isNotNull() if same else F.lit(True)))
    kept = staged(kept.select("vec_id", F.col("e").cast("array<double>").alias("e"), (F.col(same).cast("string") if same else F.lit("")).alias("same")), "vectors")
    if not (n := kept.count()):
        return None
    p = pivots(kept, n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(_lists(b.column("e")), p)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))], [*b.schema.names, "cell", "r"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buffered(batches):
            x, group, cell, r = _lists(t.column("e")), t.column("same").to_pylist(), t.column("cell").to_numpy(), t.column("r").to_numpy()
            _, code = np.unique(np.array(group, object).astype(str), return_inverse=True)
            cut = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(cell) != 0)))
            ends = [*cut[1:].tolist(), len(cell)]
            spans = [(lo, min(lo + BLOCK, hi)) for a, hi in zip(cut.tolist(), ends) for lo in range(a, hi, BLOCK)]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(cell[lo]) for lo, _ in spans], pa.int32()), pa.array([group[lo] for lo, _ in spans], pa.string()), pa.array([hi - lo for lo, hi in spans], pa.int32()),
                pa.array([float(r[lo]) for lo, _ in spans], pa.float64()), pa.array([float(r[hi - 1]) for _, hi in spans], pa.float64()),
                pa.array([t.column("vec_id").slice(lo, hi - lo).to_pylist() for lo, hi in spans], pa.list_(t.schema.field("vec_id").type)), pa.array([x[lo:hi].tobytes() for lo, hi in spans], pa.binary()),
            ], ["cell", "same", "n", "low", "high", "ids", "m"])

    kind = kept.dtypes[0][1]
    # Ranges of group, cell and distance fill the blocks: what a task happens to read would leave a few vectors of a group and cell to each.
    order = ["same", "cell", "r", "vec_id"]
    placed = staged(kept.mapInArrow(place, f"vec_id {kind}, e array<double>, same string, cell int, r double"), "placed")
    blocks = staged(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, f"cell int, same string, n int, low double, high double, ids array<{kind}>, m binary"), "index")
    radius, keys = np.zeros(len(p)), np.ones(len(p), int)
    for c in blocks.groupBy("cell").agg(F.max("high").alias("radius"), F.count("*").alias("n")).collect():  # one row for each cell
        radius[c["cell"]], keys[c["cell"]] = c["radius"], -(-c["n"] // BLOCKS_A_KEY)
    return Index(blocks, p, radius, keys, same is not None, kept.schema)


def _buffered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to about BUFFER rows at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for lo in range(0, b.num_rows, BUFFER):
            held.append(b.slice(lo, BUFFER))
            if sum(x.num_rows for x in held) >= BUFFER:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _query_blocks(index: Index, queries: DataFrame, own: bool) -> DataFrame:
    """cell, same, key and packed queries: of each query's own cell, or of all others that may hold a vector within ``reach``."""
    p, radius = index.pivots, index.radius

    def batch_of(t: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), pa.list_(t.schema.field("query_id").type), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["cell", "same", "query_ids", "q", "away", "reach"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buffered(batches):
            x, group, reach = _lists(t.column("q")), np.array(t.column("same").to_pylist(), object).astype(str), t.column("reach").to_numpy()
            d = distances(x, p)
            nearest = d.argmin(1)
            here = np.arange(len(p))[None, :] == nearest[:, None]
            least = np.maximum(d - radius, (d - d[np.arange(len(x)), nearest][:, None]) / 2)
            slack = SLACK * (1 + np.abs(x).max(1, initial=0) + d.max(1, initial=0))
            wanted = here if own else ~here & (least <= (reach + slack)[:, None])
            rows, held = [], 0
            for same in np.unique(group).tolist():
                for c in np.flatnonzero(wanted[group == same].any(0)).tolist():
                    at = np.flatnonzero(wanted[:, c] & (group == same))
                    for lo in range(0, len(at), BLOCK):
                        i = at[lo : lo + BLOCK]
                        rows.append((c, same, t.column("query_id").take(pa.array(i)).to_pylist(), x[i].tobytes(), d[i, c].tolist(), (reach + slack)[i].tolist()))
                        held += len(rows[-1][3])
                        if held >= HELD_BYTES:
                            yield batch_of(t, rows)
                            rows, held = [], 0
            yield batch_of(t, rows)

    packed = queries.select("query_id", "q", "same", "reach").mapInArrow(pack, f"cell int, same string, query_ids array<{queries.select('query_id').dtypes[0][1]}>, q binary, away array<double>, reach array<double>")
    keys = F.element_at(F.lit(index.keys.tolist()), F.col("cell") + 1).cast("int")
    return packed.withColumn("key", F.explode(F.sequence(F.lit(0), keys - 1)))


def _nearest(index: Index, query_blocks: DataFrame, k: int, skip_self: bool, dimension: int) -> DataFrame:
    """query_id, vec_id, square: the ``k`` nearest vectors of each query in each pair of blocks that meet."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = {n: b.column(n)[at].as_py() for n in ("query_ids", "away", "reach", "low", "high", "ids")}
                x, q = (np.frombuffer(b.column(n)[at].as_buffer(), np.float64).reshape(-1, dimension) for n in ("m", "q"))
                away, reach = np.array(row["away"]), np.array(row["reach"])
                left = np.flatnonzero(np.maximum(away - row["high"], row["low"] - away) <= reach)
                if not len(left):
                    continue
                d = distances(q[left], x)
                out: tuple[list, list, list] = ([], [], [])
                want = min(k + skip_self, d.shape[1])
                cut = np.minimum(np.partition(d, want - 1, axis=1)[:, want - 1], reach[left])
                for i, line, most in zip(left.tolist(), d, cut):
                    # The product's rounding may swap near ties, so those near the last place are measured again.
                    close = np.flatnonzero(line <= most + 1e-6 * (1 + most))
                    square = ((x[close] - q[i]) ** 2).sum(1)
                    own = row["query_ids"][i]
                    near = sorted((s, row["ids"][j]) for s, j in zip(square.tolist(), close.tolist()) if not (skip_self and row["ids"][j] == own))[:k]
                    out[0].extend([own] * len(near))
                    out[1].extend(j for _, j in near)
                    out[2].extend(s for s, _ in near)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field("query_ids").type.value_type), pa.array(out[1], b.schema.field("ids").type.value_type), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "square"])

    keys = F.element_at(F.lit(index.keys.tolist()), F.col("cell") + 1).cast("long")
    blocks = index.blocks.withColumn("key", F.pmod(F.xxhash64("ids"), keys).cast("int"))
    size = query_blocks.agg(F.coalesce(F.sum(F.octet_length("q") + 32 * F.size("query_ids")), F.lit(0))).first()[0]
    joined = blocks.join(F.broadcast(query_blocks) if size <= BROADCAST_BYTES else query_blocks, ["cell", "same", "key"])
    kinds = dict(query_blocks.dtypes)["query_ids"].removeprefix("array<")[:-1], dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]
    return joined.select("query_ids", "q", "away", "reach", "low", "high", "ids", "m").mapInArrow(compare, f"query_id {kinds[0]}, vec_id {kinds[1]}, square double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query with their rank; tasks keep k rows of a query before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("square", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, same: str | None = None, skip_self: bool = False) -> DataFrame:
    """query_id, vec_id, square (of the distance) and rank: the ``k`` nearest vectors of every query (query_id, q), ties by vec_id.

    ``same`` names the column that queries share with the index's. Null vectors find nothing; query_ids are distinct.
    """
    first, rest, _ = _phases(index, queries, k, same, skip_self)
    return _best(first.unionByName(rest), k)


def _phases(index: Index, queries: DataFrame, k: int, same: str | None, skip_self: bool) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """What each query finds in its own cell and in the others, and both sets of query blocks."""
    dimension = index.pivots.shape[1]
    asked = queries.filter(F.col("q").isNotNull() & (F.col(same).isNotNull() if same else F.lit(True)))
    asked = asked.select("query_id", F.col("q").cast("array<double>").alias("q"), (F.col(same).cast("string") if same else F.lit("")).alias("same"))
    own = staged(_query_blocks(index, asked.withColumn("reach", F.lit(math.inf)), True), "queries")
    first = staged(_best(_nearest(index, own, k, skip_self, dimension), k).drop("rank"), "nearest")
    bound = first.groupBy("query_id").agg(F.count("*").alias("n"), F.sqrt(F.max("square")).alias("d")).filter(F.col("n") >= k).select("query_id", "d")
    reached = asked.join(bound, "query_id", "left").select("query_id", "q", "same", F.coalesce("d", F.lit(math.inf)).alias("reach"))
    others = staged(_query_blocks(index, reached, False), "queries")
    return first, _nearest(index, others, k, skip_self, dimension), [own, others]


def compared(index: Index, queries: DataFrame, k: int, same: str | None = None, skip_self: bool = False) -> tuple[int, int]:
    """Pairs of queries and vectors whose cells meet in a search, and all pairs."""
    blocks = _phases(index, queries, k, same, skip_self)[2]
    sizes = index.blocks.groupBy("cell", "same").agg(F.sum("n").alias("n"))
    met = sum(b.filter("key = 0").join(sizes, ["cell", "same"]).agg(F.coalesce(F.sum(F.col("n") * F.size("query_ids")), F.lit(0))).first()[0] for b in blocks)
    return met, queries.filter("q IS NOT NULL").count() * index.blocks.agg(F.sum("n")).first()[0]


def empty(spark: SparkSession, query_kind: str, vec_kind: str) -> DataFrame:
    return spark.createDataFrame([], f"query_id {query_kind}, vec_id {vec_kind}, square double, rank int")
