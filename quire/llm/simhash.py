"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints that differ in at most r bits agree on at least two of r + 2 parts, so each distinct fingerprint enters a table
for every two parts, keyed by them (radius 2: six tables with keys of 32 bits; radius 6: 28 tables with keys of 16). Inside a key's block the fingerprints are stored as vertical bit planes: one exclusive-or
and a few carry-save steps update the distances of all of a block's members at once, and a block is abandoned as soon as
every counter is past the radius. Blocks of more than ``MAX_BLOCK`` members are keyed again on their remaining bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_batches, packed, stage, unpacked

#: Larger blocks are keyed again by parts of the bits that are left, once, and up to radius 2 twice.
MAX_BLOCK = 4096
#: Blocks below this size compare pairs in lanes, larger ones compare a member with the whole block's planes.
LANES = 24
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles (XXH64, seed 42; A-Z lower-cased; no words: 0)."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    digest, ends, at = xxhash.xxh64_intdigest, [], -1
    for x in w:
        ends.append(at := at + 1 + len(x))
    starts = [0, *(e + 1 for e in ends[: len(w) - shingle])]
    total, n = np.zeros(64, np.int64), len(starts)
    for lo in range(0, n, 1 << 16):  # bounded memory for texts of any length
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[lo : lo + (1 << 16)], ends[lo + shingle - 1 : lo + (1 << 16) + shingle - 1])), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, h (a hash of the text) and fp (the fingerprint's bits as a long) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("t"))
    return in_batches(taken, each, "doc_id long, h long, fp long")


def count_past(planes: np.ndarray, radius: int) -> np.ndarray:
    """Carry-save count of set bits down the planes (bits x words): a word array whose bits say "more than ``radius``".

    Stops at the first plane after which every lane of the block is past the radius.
    """
    depth = radius.bit_length()
    counters = [np.zeros(planes.shape[1], np.uint64) for _ in range(depth)]
    past = np.zeros(planes.shape[1], np.uint64)
    for x in planes:
        carry = x
        for k in range(depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over = carry  # beyond 2**depth - 1
        if radius + 1 < 1 << depth:  # counts from radius + 1 up to the counters' limit
            reached = np.zeros_like(past)
            for value in range(radius + 1, 1 << depth):
                m = np.full_like(past, FULL)
                for k in range(depth):
                    m &= counters[k] if value >> k & 1 else ~counters[k]
                reached |= m
            over = over | reached
        past |= over
        if (past == FULL).all():
            break
    return past


def to_planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of the values, 64 values to a word; lanes past the end hold zeros."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits = np.pad(bits, ((0, -len(values) % 64), (0, 0)))
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def lanes_of(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def block_links(block: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect all members of the block within the radius of each other: a spanning forest, never all pairs."""
    n, planes = len(block), to_planes(block)
    unseen = np.zeros(planes.shape[1] * 64, np.uint8)
    unseen[:n] = 1
    words, links = np.packbits(unseen, bitorder="little").view(np.uint64), []
    for root in range(n):
        if not words[root >> 6] >> np.uint64(root & 63) & np.uint64(1):
            continue
        words[root >> 6] &= ~(np.uint64(1) << np.uint64(root & 63))
        queue = [root]
        while queue:
            q = queue.pop()
            live = np.flatnonzero(words)  # only words with unvisited lanes
            if not len(live):
                break
            mask = np.where((block[q] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), FULL, np.uint64(0))[:, None]
            near = np.zeros_like(words)
            near[live] = ~count_past(planes[:, live] ^ mask, radius) & words[live]
            found = lanes_of(near, n)
            words &= ~near
            links += [(int(block[q]), int(block[x])) for x in found]
            queue += found.tolist()
    return links


def small_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of all small blocks together: lane i compares member i with the member ``step`` places on."""
    out_a, out_b = [], []
    for step in range(1, LANES):
        if step >= len(fps):
            break
        lanes = np.flatnonzero(group[:-step] == group[step:])
        if not len(lanes):
            break
        past = count_past(to_planes(fps[lanes] ^ fps[lanes + step]), radius)
        hit = lanes[lanes_of(~past, len(lanes))]
        out_a.append(fps[hit])
        out_b.append(fps[hit + step])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _below(fixed: int, radius: int) -> list[int]:
    """The bit sets that fix two more of radius + 2 parts of the bits outside ``fixed``."""
    bits, n = [i for i in range(64) if not fixed >> i & 1], radius + 2
    parts = [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]
    return [fixed | sum(1 << i for p in two for i in p) for two in combinations(parts, 2)]


def _masks(radius: int) -> list[dict[int, list[int]]]:
    """For each round of keying the sets that it leads to from the sets fixed before."""
    rounds = [{0: _below(0, radius)}]
    for _ in range(2 if radius <= 2 else 1):
        rounds.append({m: _below(m, radius) for v in rounds[-1].values() for m in v})
    return rounds


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: dict[int, list[int]], fixed: Column) -> DataFrame:
    table = F.create_map(*[y for k, v in masks.items() for y in (F.lit(_signed(k)), F.array(*[F.lit(_signed(x)) for x in v]))])
    return fps.select("fp", F.explode(table[fixed]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect every pair within ``radius`` bits.

    Keys hold 128 / (radius + 2) bits, so blocks, and the work in them, grow with the radius.
    """
    top, *more = _masks(radius)
    level = _keyed(fps, top, F.lit(0).cast("long"))
    blocks = None
    for below in more:
        heavy = level.groupBy("mask", "key").count().filter(F.col("count") > MAX_BLOCK).select("mask", "key")
        light = level.join(heavy, ["mask", "key"], "left_anti")
        blocks = light if blocks is None else blocks.unionByName(light)
        rest = level.join(heavy, ["mask", "key"], "left_semi").select("fp", F.col("mask").alias("fixed"))
        level = _keyed(rest, below, F.col("fixed"))
    blocks = blocks.unionByName(level)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in (*batches, None):
            t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            key = np.stack([t.column(i).to_numpy() for i in (1, 2)])
            group = np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))])
            done = t.num_rows if b is None else int(np.searchsorted(group, group[-1]))  # the last block may go on
            held = t.slice(done).combine_chunks()
            fps, group = t.column(0).to_numpy()[:done].view(np.uint64), group[:done]
            size = np.bincount(group)[group] if done else group
            a, z = small_links(fps[size < LANES], group[size < LANES], radius)
            pairs = [p for g in np.unique(group[size >= LANES]) for p in block_links(fps[slice(*np.searchsorted(group, [g, g + 1]))], radius)]
            more = np.array(pairs, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in ((a, more[:, 0]), (z, more[:, 1]))], ["a", "b"])

    dealt = blocks.select("fp", "mask", "key").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(each, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches) of every node with a link; edges: a, b.

    Alternates hooking every neighbour to the smallest one seen (large star) and every smaller neighbour to it (small
    star), each a grouped minimum with a join back, until the links are the stars themselves.
    """
    e, before = stage(edges.filter("a <> b"), "links"), None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b")))
        e = stage(small.distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = now


def _grouped(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints, and of each distinct one fp, first: the component's first document as (no_id, doc_id, h)."""
    fp = stage(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h"))
    distinct = stage(fp.groupBy("fp").agg(first.alias("own")), "distinct-fps")
    comp = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("own").alias("first"))
    return fp, rooted.join(least, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text; more columns are ignored).

    Documents link where their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id in reach.
    Null and wordless texts share fingerprint zero; repeated rows give repeated results; a null doc_id gets the smallest
    non-null id of its component, or null if there is none; an empty table gives an empty result.
    """
    fp, first = _grouped(docs, shingle, radius)
    return fp.join(first, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def representatives(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``first`` (column first: no_id, doc_id, h) names, repeated rows once."""
    named = first.select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h")).distinct()
    keyed = packed(docs, "doc_id", "text").withColumn("_key", F.xxhash64("text"))
    kept = keyed.join(named, keyed["doc_id"].eqNullSafe(named["_id"]) & (keyed["_key"] == named["_h"]), "left_semi")
    return unpacked(kept.dropDuplicates(["doc_id", "_key"]), docs.columns)


def keep_representatives(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, with all columns: the smallest doc_id's (null ids last, then by the text's hash)."""
    return representatives(docs, _grouped(docs, shingle, radius)[1])
