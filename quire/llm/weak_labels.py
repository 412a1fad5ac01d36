"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of all
vote patterns estimates the prior and how often each labeller that votes is wrong on good and on bad documents; the resulting
posterior of a pattern is the training label of a linear scorer over hashed character-shape n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_batches

FEATURES = 1 << 12
#: Bound on the scorer's training sample, in documents.
SAMPLE = 4000
ROWS = 256
LABELLERS = ("symbols", "capitals", "repetition", "sentences", "shouting", "cells", "length", "copied_lines", "word_length")
GOOD, BAD, NONE = 1, 2, 0
#: Where the estimation starts: share of good documents, and how often a voting labeller says bad on good and on bad ones.
#: The order (alarms are rarer on good documents) tells which of the two classes is the good one. PSEUDO votes at these rates
#: are added for each class; they steady tables of a few hundred documents and are nothing against the votes of larger ones.
START, PSEUDO = (0.8, 0.02, 0.25), 10.0

_END = re.compile(rb"[.?!](?=\s|$)")
_shapes: list[np.ndarray] = []


def vote(text: bytes) -> int:
    """The labellers' votes as one base-3 number, the first labeller in the lowest digit."""
    w = text.split()
    n, chars = len(w), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = max(1, len(text.translate(None, b" \t\n\r\x0b\x0c0123456789")))
    symbols = (len(text) - len(text.translate(None, b"#*$%&|<>{}[]^~\\"))) / chars
    capitals = (len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / letters
    repeated = 1 - len(set(w)) / max(1, n)
    ends = len(_END.findall(text)) / max(1, n)
    loud = text.count(b"!!") / max(1, n)
    cells = text.count(b" | ") / max(1, n)
    copied = 1 - len(set(lines)) / max(1, len(lines))
    either = lambda bad, good: BAD if bad else GOOD if good else NONE
    word = chars / max(1, n)
    votes = (
        either(symbols > 0.03, symbols < 0.01), either(capitals > 0.3, capitals < 0.06), either(n >= 20 and repeated > 0.6, repeated < 0.4),
        either(n >= 20 and not 0.03 <= ends <= 0.5, 0.04 < ends < 0.3), either(loud > 0.05, loud == 0), either(cells > 0.05, cells == 0),
        either(n < 8, n >= 30), either(copied > 0.25, copied == 0 and len(lines) > 1), either(not 5 <= word <= 7.5, 5.5 < word < 7.2),
    )
    return sum(v * 3**i for i, v in enumerate(votes))


def estimate(patterns: dict[int, int], rounds: int = 300) -> tuple[float, np.ndarray, dict[int, float]]:
    """Prior of good, alarms [labeller, class (good, bad)] and each pattern's posterior of good; patterns: code to count.

    An alarm is the probability that a labeller which votes says bad. Not voting is no evidence: labellers keep silent on
    short texts together, which says nothing of their worth.
    """
    codes = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[c] for c in codes], float)
    votes = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    bad, good = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    prior, alarm = START[0], np.tile(np.array(START[1:]), (len(LABELLERS), 1))
    post = np.zeros(len(codes))
    for _ in range(rounds):
        log = bad @ np.log(alarm) + good @ np.log(1 - alarm) + np.log([prior, 1 - prior])
        post = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500)))
        weight = np.stack([n * post, n * (1 - post)])
        prior = float((weight[0].sum() + PSEUDO * START[0]) / (n.sum() + PSEUDO))
        alarm = ((weight @ bad + PSEUDO * np.array(START[1:])[:, None]) / (weight @ (bad + good) + PSEUDO)).T
    return prior, alarm, dict(zip(codes.tolist(), post.tolist()))


def shapes() -> np.ndarray:
    """For each code point its class: letter cases, digit and space by one character each, others themselves."""
    if not _shapes:
        s = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isspace() and c != "\n":
                s[i] = 32
            elif c.isalpha():
                s[i] = 65 if c.isupper() else 97
            elif c.isnumeric():
                s[i] = 48
        _shapes.append(s)
    return _shapes[0]


def features(text: str | None) -> np.ndarray:
    """Normalised hashed 1- to 4-grams of the text's shape, runs of a class counted by length up to 3."""
    c = shapes()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    out = np.zeros(FEATURES, np.float32)
    for lo in range(0, len(c), 1 << 20):  # bounded memory for texts of any length
        x = c[lo : lo + (1 << 20) + 3]
        change = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        run = np.minimum(np.diff(np.append(change, len(x))), 3)
        h = (x[change] * np.uint32(4) + run.astype(np.uint32)) * np.uint32(0x9E3779B1)
        for k in range(4):
            if k:
                h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ ((x[change] * np.uint32(0xC2B2AE35))[k:] >> np.uint32(k))
            if not len(h):
                break
            out += np.bincount((h * np.uint32(0x27D4EB2F) + np.uint32(k)) >> np.uint32(20), minlength=FEATURES)
    np.log1p(out, out=out)
    return out / max(1e-12, float(np.sqrt((out * out).sum())))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels y by full-batch Adam with a small ridge; weights and bias."""
    w, b, y = np.zeros(FEATURES, np.float32), np.float32(0), y.astype(np.float32)  # one precision: no second copy of x
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for t in range(1, rounds + 1):
        err = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / max(1, len(y))
        g = np.append(err @ x + 1e-5 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), np.float32(b - step[-1])
    return w, float(b)


def _votes(docs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([vote(t.as_py() or b"") for t in b.column(0)], pa.int64())], ["code"])

    return in_batches(docs.select(F.col("text").cast("binary").alias("t")), each, "code long")


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """posterior (by vote pattern), prior, alarms, weights, bias; pattern counts cover all of ``docs``."""
    patterns = {r["code"]: r["n"] for r in _votes(docs).groupBy("code").agg(F.count("*").alias("n")).collect()}  # at most 3 ** 9
    prior, alarm, posterior = estimate(patterns)
    total = sum(patterns.values())
    key = F.xxhash64("doc_id", "text", F.lit("quality"))
    share = key.cast("double") / F.lit(2.0**64) + 0.5

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), ROWS):
                part = texts[lo : lo + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, ROWS), pa.array([vote((t or "").encode()) for t in part], pa.int64()), pa.array([features(t).astype(np.float16).tobytes() for t in part], pa.binary())], ["key", "code", "x"]
                )

    drawn = docs.filter(share * F.lit(total) < sample).select(key.alias("key"), "text").mapInArrow(each, "key long, code long, x binary")
    got = drawn.dropDuplicates(["key"]).drop("key").toArrow().sort_by([("code", "ascending"), ("x", "ascending")])  # repeated rows are drawn as one
    x = np.stack([np.frombuffer(b.as_py(), np.float16) for b in got.column(1)]).astype(np.float32) if got.num_rows else np.zeros((0, FEATURES), np.float32)
    w, bias = train(x, np.array([posterior[c] for c in got.column(0).to_pylist()]))
    return {"prior": prior, "alarms": alarm, "posterior": posterior, "weights": w, "bias": bias}


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes (the pattern), weak_label (posterior of good), score (0 to 1) and kept of every row of ``docs`` (doc_id, text).

    kept is true where the scorer's probability of good is at least 0.5. A null text is scored as an empty one; repeated rows
    vote as often as they occur; further columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), sample))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                texts = part.column(1).to_pylist()
                codes = [vote((t or "").encode()) for t in texts]
                z = np.stack([features(t) for t in texts]) @ m["weights"] + m["bias"]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(codes, pa.int64()), pa.array([m["posterior"].get(c, m["prior"]) for c in codes], pa.float64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30).astype(float))), pa.float64())],
                    ["doc_id", "votes", "weak_label", "score"],
                )

    taken = docs.select("doc_id", "text")
    out = taken.mapInArrow(each, f"doc_id {taken.dtypes[0][1]}, votes long, weak_label double, score double")
    return out.withColumn("kept", F.col("score") >= 0.5)
