"""A hashed maximum-entropy language model, its probabilities of whole texts, and those of word counts alone.

A word's probability is that of its class after the words before it, times that of the word in its class. Classes are the most
frequent words themselves, and for each of those the words that keep its company most; words too rare for that go by their
letters. The class has a softmax over hashed features: the words one, two and three places back and the last two together.
Every task takes gradient steps over its share of the documents, a tree of tasks averages the weights by how often each
feature occurred, and the next round starts from there, so that all rounds together see every learnable document once. Within
a class a word has its discounted share of the class's tokens; what the discount leaves is the probability of an unknown word.
All probabilities of known words and of the classes' unknown ones add up to one.

Counts are exact and cover all words. The most frequent ones go to all tasks, in bounded number and bytes; rarer words meet
their counts in a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out, in_batches, stage

#: Words that all tasks hold, at most, and the bytes that each may have; words with a number of their own as features.
HEAD, HEAD_BYTES, NUMBERED = 200_000, 64, 16_384
#: Most frequent words with a class of their own, each of which also has a class of companions; one more class is for the rest.
MARKS = 24
CLASSES = 2 * MARKS + 2
#: A word's company is what stands up to so many places from it.
NEAR = 4
#: Buckets of hashed features, a power of two, and features of a place besides the constant one.
BITS, FEATURES = 14, 4
BUCKETS = 1 << BITS
#: Rounds of training, tokens of a gradient step, and its size.
ROUNDS, STEP, RATE = 3, 8192, 0.7
#: Distinct words that a task counts before it sends them on.
KEPT_WORDS = 400_000
SHORT = 6  # occurrences of a feature in a step that are added place by place
DEPTH = 3  # of the tree in which tasks merge their weights
#: Odd multipliers whose products' high bits are well mixed.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
MASK = (1 << 64) - 1


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or b"").lower().split()


@dataclass(frozen=True)
class Model:
    """What tasks hold. Word 0 is the end of a text; the others are numbered by falling count."""

    number: dict[bytes | None, int]
    count: np.ndarray  # of each numbered word in the training tokens
    group: np.ndarray  # its class
    letters: dict[bytes, int]  # classes by first and last letters
    total: int = 0  # training tokens
    types: int = 0  # distinct training tokens
    discount: float = 0.5
    inside: np.ndarray | None = None  # log10 probability of each numbered word in its class
    unknown: np.ndarray | None = None  # log10 of each class's weight of unknown words
    norm: np.ndarray | None = None  # log10 of each class's weight
    weights: np.ndarray | None = None  # by bucket and class; the last row is the constant feature's

    def by_letters(self, word: bytes) -> int:
        for key in keys(word):
            if (found := self.letters.get(key)) is not None:
                return found
        return CLASSES - 1

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """The class of every word."""
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        out = self.group[np.maximum(ids, 0)]
        for i in np.flatnonzero(ids < 0).tolist():
            out[i] = self.by_letters(words[i])
        return out


def keys(word: bytes) -> tuple[bytes, ...]:
    """What a rare word may be classed by, the most telling first."""
    return word[:2] + b"\n" + word[-3:], b"\n" + word[-3:], b"\n" + word[-1:]


@dataclass(frozen=True)
class Places:
    """The tokens of some texts one after another, each text with its end."""

    words: list[bytes | None]
    ids: np.ndarray
    group: np.ndarray
    features: np.ndarray
    length: np.ndarray  # tokens of each text


def places(model: Model, texts: list[bytes | None], features: bool = True) -> Places:
    """Words and their numbers; with ``features`` also the classes of words without a number, and the features."""
    flat, length = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = tokens(t)
        length[i] = len(own) + 1
        flat += own
        flat.append(None)
    ids = np.fromiter(map(model.number.get, flat, repeat(-1)), np.int64, len(flat))
    group = model.group[np.maximum(ids, 0)]
    for i in np.flatnonzero(ids < 0).tolist() if features else ():
        group[i] = model.by_letters(flat[i])
    return Places(flat, ids, group, hashed(ids, group, length) if features else np.empty((0, 0)), length)


def before(x: np.ndarray, length: np.ndarray, back: int, none: int) -> np.ndarray:
    """What stands ``back`` places before each place of its text."""
    out = np.full(len(x), none, x.dtype)
    out[back:] = x[:-back]
    start = np.cumsum(length) - length
    for k in range(back):
        out[(start + k)[k < length]] = none
    return out


def hashed(ids: np.ndarray, group: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Buckets of each place's features; words without a number of their own count as their class."""
    seen = np.where((ids >= 0) & (ids < NUMBERED), ids, NUMBERED + group).astype(np.uint64) + np.uint64(1)
    one, two, three = (before(seen, length, k, 0) for k in (1, 2, 3))
    shift, a, b = np.uint64(64 - BITS), np.uint64(MIX[0]), np.uint64(MIX[1])
    salted = lambda x, salt: ((x * a + np.uint64(salt * MIX[2] & MASK)) * b) >> shift
    return np.stack([salted(one, 1), salted(two, 2), salted(three, 3), salted(one * np.uint64(1_000_003) + two, 4)], 1).astype(np.int32)


def chances(w: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The probability of every class at each place."""
    z = w.take(features[:, 0], axis=0)
    z += w[-1]
    for k in range(1, features.shape[1]):
        z += w.take(features[:, k], axis=0)
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def counts(docs: DataFrame) -> DataFrame:
    """word (binary) and n of all words of ``docs`` (text); tasks add up first what they have read."""

    def sent(seen: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(tokens(t.as_py()))
            if len(seen) > KEPT_WORDS:
                yield sent(seen)
                seen = Counter()
        yield sent(seen)

    return in_batches(docs.select(F.col("text").cast("binary").alias("t")), each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head(counted: DataFrame, bound: int) -> tuple[list[tuple[bytes, int]], int]:
    """At most ``bound`` most frequent words, by falling count, then by word; and the count that only they exceed."""
    short = counted.filter(F.octet_length("word") <= HEAD_BYTES)
    # As many distinct counts as words are enough, since each count has a word.
    sizes = short.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(bound + 1).collect()
    floor, taken = 0, 0
    for r in sizes:
        if (taken := taken + r["words"]) > bound:
            floor = r["n"]
            break
    top = short.filter(F.col("n") > floor).toArrow()
    return sorted(zip(top.column("word").to_pylist(), top.column("n").to_pylist()), key=lambda x: (-x[1], x[0])), floor


def company(docs: DataFrame, model: Model) -> np.ndarray:
    """How often each numbered word has each of the marks near it, over all ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = min(NUMBERED, len(model.count))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (MARKS + 1), np.int64)
        for b in batches:
            p = places(shared.value, b.column(0).to_pylist(), False)
            word, mark = np.where(p.ids < size, p.ids, -1), np.where(p.ids <= MARKS, p.ids, -1)
            for back in range(1, NEAR + 1):
                for w, m in ((word, before(mark, p.length, back, -1)), (before(word, p.length, back, -1), mark)):
                    ok = (w >= 0) & (m > 0)
                    at, n = np.unique(w[ok] * (MARKS + 1) + m[ok], return_counts=True)
                    total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    # At most NUMBERED * MARKS rows.
    found = in_batches(docs.select(F.col("text").cast("binary").alias("t")), each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * (MARKS + 1), np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, MARKS + 1)


def classed(model: Model, near: np.ndarray) -> Model:
    """The model with classes for all numbered words and for letters."""
    share = near.sum(axis=0) / max(1, near.sum())
    expected = (near.sum(axis=1, keepdims=True) + 2) * np.maximum(share, 1e-9)
    best = ((near + 2 * share) / expected)[:, 1:].argmax(axis=1) + 1
    group = np.full(len(model.count), -1, np.int64)
    group[: len(near)] = np.where(near.sum(axis=1) > 0, MARKS + best, -1)
    group[: MARKS + 1] = np.arange(min(MARKS + 1, len(group)))
    votes: dict[bytes, Counter[int]] = {}
    for word, i in model.number.items():
        if i > MARKS and group[i] >= 0:
            for key in keys(word):
                votes.setdefault(key, Counter())[int(group[i])] += int(model.count[i])
    model = replace(model, group=group, letters={k: min(v, key=lambda c: (-v[c], c)) for k, v in votes.items()})
    for word, i in model.number.items():
        if group[i] < 0:
            group[i] = model.by_letters(word)
    return model


def weighed(model: Model, counted: DataFrame, texts: int) -> Model:
    """The model with the weights of classes, words in them and unknown words, from all counts."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, 4), np.int64)
        for b in batches:
            g, n = shared.value.of_words(b.column(0).to_pylist()), b.column(1).to_numpy()
            for k, x in enumerate((n, np.ones_like(n), n == 1, n == 2)):
                total[:, k] += np.bincount(g, x, CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), *(pa.array(total[:, k]) for k in range(4))], ["g", "n", "types", "once", "twice"])

    sums = in_batches(counted.select("word", "n"), each, "g int, n long, types long, once long, twice long", 20_000).groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n", "types", "once", "twice")])
    t = np.zeros((CLASSES, 4))
    for r in sums.collect():  # one row for each class
        t[r["g"]] = r[1:]
    t[0] = texts, min(texts, 1), 0, 0
    once, twice = t[:, 2].sum(), t[:, 3].sum()
    d = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.9))
    open_class = np.arange(CLASSES) > MARKS
    unknown = np.where(open_class, np.maximum(d * t[:, 1], 0.5), 0)
    norm = np.where(open_class, t[:, 0] - d * t[:, 1] + unknown, 1)
    inside = np.where(model.group > MARKS, np.log10(np.maximum(model.count - d, 0.1)) - np.log10(norm[model.group]), 0)
    w = np.zeros((BUCKETS + 1, CLASSES), np.float32)
    w[-1] = np.log((t[:, 0] + 0.5) / (t[:, 0].sum() + 0.5 * CLASSES))
    return replace(model, total=int(t[:, 0].sum()), types=int(t[:, 1].sum()), discount=d, inside=inside, unknown=np.log10(np.maximum(unknown, 1e-300)), norm=np.log10(norm), weights=w)


def summed(p: np.ndarray, rows: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The sums of ``p[rows]`` over stretches of ``length`` from ``first`` on; most are short, so these go place by place."""
    out = p.take(rows[first], axis=0)
    for k in range(1, SHORT):
        at = np.flatnonzero(length > k)
        out[at] += p.take(rows[first[at] + k], axis=0)
    for i in np.flatnonzero(length > SHORT).tolist():
        rest = rows[first[i] + SHORT : first[i] + length[i]]
        out[i] += np.ones(len(rest), p.dtype) @ p.take(rest, axis=0)
    return out


def descend(w: np.ndarray, squares: np.ndarray, uses: np.ndarray, features: np.ndarray, group: np.ndarray) -> None:
    """One gradient step on ``w``, scaled for each feature by the gradients that it has had; ``uses`` counts features."""
    p = chances(w, features)
    p[np.arange(len(p)), group] -= 1
    flat = features.ravel().astype(np.uint16)  # sorts faster
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    length = np.diff(np.append(first, len(flat)))
    rows = np.append(flat[first].astype(np.int64), len(w) - 1)
    g = np.concatenate([summed(p, order // features.shape[1], first, length), p.sum(axis=0, keepdims=True)])
    squares[rows] += np.einsum("ij,ij->i", g, g)
    uses[rows] += np.append(length, len(p))
    g *= (RATE / np.sqrt(squares[rows] + 1e-6))[:, None]
    w[rows] -= g


#: What tasks send: for each feature how often it occurred, its weights in half precision, and its squared gradients.
Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def merged(a: Part | None, b: Part | None) -> Part | None:
    """Weights and squares averaged by the occurrences of each feature."""
    if a is None or b is None:
        return b if a is None else a
    n = a[0] + b[0]
    share = np.where(n > 0, b[0] / np.maximum(n, 1), 0).astype(np.float32)
    w = a[1].astype(np.float32)
    w += share[:, None] * (b[1].astype(np.float32) - w)
    return n, w.astype(np.float16), a[2] + share * (b[2] - a[2])


def train(model: Model, docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` over parts of ``docs`` (doc_id, text) that make up the whole."""
    squares = np.zeros(BUCKETS + 1, np.float32)
    for k in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((model, squares))
        part = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == k)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, s = shared.value  # noqa: B023
            w, s, uses, rng = start.weights.copy(), s.copy(), np.zeros(BUCKETS + 1), np.random.default_rng(7)
            for b in batches:
                p = places(start, b.column(0).to_pylist())
                order = rng.permutation(len(p.ids))
                for lo in range(0, len(order), STEP):
                    at = order[lo : lo + STEP]
                    descend(w, s, uses, p.features[at], p.group[at])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (uses, w.astype(np.float16), s)], ["uses", "w", "s"])

        def unpack(r) -> Part:
            return np.frombuffer(r["uses"]), np.frombuffer(r["w"], np.float16).reshape(-1, CLASSES), np.frombuffer(r["s"], np.float32)

        parts = in_batches(part.select(F.col("text").cast("binary").alias("t")), each, "uses binary, w binary, s binary").rdd.map(unpack)
        uses, w, s = parts.treeAggregate(None, merged, merged, DEPTH) or (np.zeros(BUCKETS + 1), model.weights, squares)
        seen = uses > 0
        squares = np.where(seen, s, squares).astype(np.float32)
        model = replace(model, weights=np.where(seen[:, None], w, model.weights).astype(np.float32))
        shared.unpersist()
    return model


def fit(docs: DataFrame, rounds: int = ROUNDS, bound: int = HEAD) -> tuple[Model, DataFrame]:
    """The model of ``docs`` (doc_id, text), and word and n of the words that it does not hold."""
    counted = stage(counts(docs), "lm-counts")
    texts = docs.count()
    top, floor = head(counted, bound)
    number: dict[bytes | None, int] = {None: 0} | {w: i + 1 for i, (w, _) in enumerate(top)}
    model = Model(number, np.array([texts, *(n for _, n in top)], np.int64), np.zeros(len(number), np.int64), {})
    model = classed(model, company(docs, model))
    model = train(weighed(model, counted, texts), docs, rounds)
    return model, counted.filter((F.col("n") <= floor) | (F.octet_length("word") > HEAD_BYTES))


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = float(np.log10(model.total + 0.5 * (model.types + 1)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        flat_share = np.log10(m.count + 0.5)
        for b in batches:
            p = places(m, b.column(1).to_pylist())
            here = np.zeros(len(p.ids))
            for lo in range(0, len(here), STEP):
                at = slice(lo, lo + STEP)
                here[at] = np.take_along_axis(chances(m.weights, p.features[at]), p.group[at, None], axis=1)[:, 0]
            known = p.ids >= 0
            inside = np.where(known, m.inside[np.maximum(p.ids, 0)], -m.norm[p.group])
            share = np.where(known, flat_share[np.maximum(p.ids, 0)], 0) - base
            ends = np.cumsum(p.length)
            starts = ends - p.length
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]  # noqa: B023, E731
            missing = np.flatnonzero(~known)
            tail = pa.StructArray.from_arrays([pa.array([p.words[i] for i in missing.tolist()], pa.binary()), pa.array(p.group[missing], pa.int32())], ["word", "g"])
            tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, np.append(0, ends)), pa.int32()), tail)
            rows = [b.column(0), pa.array(p.length), pa.array(add((m.count[np.maximum(p.ids, 0)] > 0) & known).astype(np.int64)), pa.array(add(share)), pa.array(add(np.log10(np.maximum(here, 1e-30)).astype(np.float64) + inside))]
            yield pa.RecordBatch.from_arrays([*rows, tails], ["doc_id", "n_tokens", "n_known", "base", "score", "tail"])

    taken = docs.select("doc_id", F.col("text").cast("binary").alias("t"))
    # Numbered once and written, so that a row keeps its number.
    rows = stage(in_batches(taken, each, f"doc_id {taken.dtypes[0][1]}, n_tokens long, n_known long, base double, score double, tail array<struct<word: binary, g: int>>").withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    unknown = F.lit(model.unknown.tolist())
    each_word = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.g").join(rare, "word", "left")
    n = F.coalesce("n", F.lit(0))
    found = each_word.groupBy("row").agg(
        F.count_if(n > 0).alias("more_known"),
        F.sum(F.log10(n + 0.5)).alias("more_base"),
        F.sum(F.when(n > 0, F.log10(F.greatest(n - model.discount, F.lit(0.1)))).otherwise(F.element_at(unknown, F.col("g") + 1))).alias("more_score"),
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    out = rows.drop("tail").join(found, "row", "left")
    return out.select("doc_id", "n_tokens", plus("n_known", "more_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score"))


def language_model(docs: DataFrame, rounds: int = ROUNDS, bound: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    Learns from rows whose crc32(doc_id as text) mod 5 is not 1; null doc_ids are scored but not learned from. A null or empty
    text has one token, its end. Repeated rows count as often as they occur. Without rows to learn from, base_score is 0 and
    score takes all classes for equally likely. Weights depend on how the rows lie in partitions, not on their order of arrival.
    Further columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    learnt = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 1))
    model, rare = fit(learnt, rounds, bound)
    out = score(docs, model, rare)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), *out.columns[1:])
