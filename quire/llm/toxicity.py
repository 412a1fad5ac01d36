"""Toxicity scoring by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other sampled document is unlabelled. A logistic scorer over how often a
text has certain words and letter sequences is trained in numpy on the risk that corrects the unlabelled part by the class prior,
with the correction kept non-negative: where a batch's estimate of the negatives' risk falls below zero, the step goes up it
instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out, in_batches, stage

WORD = re.compile(r"[^\W\d_]+")
#: Bounds on the sample: so many confirmed toxic and so many other documents, however many there are.
POSITIVES = 4000
UNLABELLED = 12_000
#: Letters of a sequence inside a word, of which GRAM - 1 may hang over its ends as blanks.
GRAM = 5
#: Features are what positives have so much more often that chance would need exp(-EVIDENCE), the most telling FEATURES of them.
EVIDENCE = 7.0
FEATURES = 1024
#: A feature's value is its share of the text's words in percent, up to MOST, as if the text had SMOOTH more words without any.
MOST, SMOOTH = 5.0, 40
#: Words whose features a worker keeps; beyond that it starts anew.
KEPT_WORDS = 200_000


def words(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


def pieces(word: str) -> set[str]:
    """The word itself and its letter sequences; a blank marks the word's ends."""
    padded = f" {word} "
    return {f"={word}", *(padded[i : i + GRAM] for i in range(len(padded) - GRAM + 1))}


class _Index:
    """Features of texts by number, kept for the words seen."""

    def __init__(self, features: dict[str, int]):
        self.features, self.known = features, {}

    def of(self, text: str | None) -> dict[int, float]:
        """Feature numbers and values, in order of the numbers."""
        found, n = Counter(), SMOOTH
        for w, k in words(text).items():
            n += k
            if (at := self.known.get(w)) is None:
                if len(self.known) >= KEPT_WORDS:
                    self.known.clear()
                at = self.known[w] = tuple(self.features[x] for x in pieces(w) if x in self.features)
            for i in at:
                found[i] += k
        return {i: min(MOST, 100 * found[i] / n) for i in sorted(found)}


def train(positive: list[dict[int, float]], unlabelled: list[dict[int, float]], n: int, prior: float, rounds: int = 400, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the ``n`` features and bias from the documents' features; ``prior`` is the share of positives among the unlabelled."""
    if not positive or not unlabelled:
        return np.zeros(n, np.float32), -10.0
    p, u = (np.zeros((len(rows), n), np.float32) for rows in (positive, unlabelled))
    for table, rows in ((p, positive), (u, unlabelled)):
        for i, row in enumerate(rows):
            table[i, list(row)] = list(row.values())
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    w, b, rng = np.zeros(n, np.float32), np.float32(np.log(prior / (1 - prior))), np.random.default_rng(seed)
    m, v, t, mean = np.zeros(n + 1), np.zeros(n + 1), 0, np.zeros(n + 1)
    for _ in range(rounds):
        xp, xu = (x[rng.choice(len(x), min(1024, len(x)), replace=False)] for x in (p, u))
        zp, zu = xp @ w + b, xu @ w + b
        # Logistic losses: positives as positive, positives as negative, unlabelled as negative.
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gpn, gu = prior * (sigmoid(zp) - 1) / len(zp), prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        down = (lambda x: xu.T @ gu - xp.T @ gpn if x else gu.sum() - gpn.sum())
        g = np.append(xp.T @ gp + down(1) + 1e-3 * w, gp.sum() + down(0)) if negative >= 0 else -np.append(down(1), down(0))
        t += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), np.float32(b - step[-1])
        if 2 * t > rounds:
            mean += np.append(w, b) / (rounds // 2)
    return mean[:-1].astype(np.float32), float(mean[-1])


def _share(bound: int, total: int) -> Column:
    """True for the documents with the smallest hashes of doc_id, about ``bound`` of ``total``."""
    return (F.xxhash64("doc_id", F.lit("toxicity")).cast("double") / F.lit(2.0**64) + 0.5) * F.lit(total) < bound


def sample(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """toxic (0 or 1), h and text: the distinct texts of at most about POSITIVES confirmed toxic and UNLABELLED other documents.

    Only ids are drawn and compared with the labels; the texts meet the drawn ids, a table of bounded size, and stay where
    they are otherwise.
    """
    toxic = marked.filter("toxic = 1").select("doc_id")
    drawn = toxic.filter(_share(POSITIVES, toxic.count()))
    part = _share(UNLABELLED, docs.count())
    others = docs.select("doc_id").filter(part).distinct().join(toxic.filter(part), "doc_id", "left_anti")
    ids = stage(drawn.select("doc_id", F.lit(1).alias("toxic")).unionByName(others.select("doc_id", F.lit(0).alias("toxic"))), "toxicity-ids")
    # Distinct ids, so about POSITIVES + UNLABELLED rows; the check guards against hashes that all lie low.
    near = F.broadcast(ids) if ids.count() <= 2 * (POSITIVES + UNLABELLED) else ids
    texts = docs.join(near, "doc_id").select("toxic", F.xxhash64("text").alias("h"), "text")
    return stage(texts.groupBy("toxic", "h").agg(F.first("text").alias("text")), "toxicity-sample")


def telling(texts: DataFrame, n_p: int, n_u: int) -> list[str]:
    """The FEATURES features with the most evidence in ``texts`` (see ``sample``), by evidence, then by name."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in batches:
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1)):
                seen[toxic].update(set().union(*map(pieces, words(t.as_py()))))
        names = sorted(seen[0].keys() | seen[1].keys())
        counts = [pa.array([seen[k][x] for x in names], pa.int64()) for k in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], ["feature", "p", "u"])

    counted = in_batches(texts.select("toxic", "text"), each, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    chance = F.lit(float(n_p)) * (F.col("u") + 1) / F.lit(float(n_u + 1))
    told = F.col("p") * F.log(F.col("p") / chance) - F.col("p") + chance
    found = counted.filter(F.col("p") > 2 * chance).withColumn("told", told).filter(F.col("told") >= EVIDENCE)
    return [r["feature"] for r in found.orderBy(F.desc("told"), "feature").limit(FEATURES).select("feature").collect()]


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[dict[str, int], np.ndarray, float]:
    """Features by number, weights and bias from ``docs`` and ``labels`` (doc_id, toxic); only toxic = 1 is used as a label.

    ``prior`` is the share of toxic documents, by default that among the labelled rows.
    """
    marked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = marked.agg(F.avg(F.when(F.col("toxic").isNotNull(), (F.col("toxic") == 1).cast("double")))).first()[0] or 0.05
    texts = sample(docs, marked)
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {}, np.zeros(0, np.float32), -10.0
    features = {x: i for i, x in enumerate(telling(texts, sizes[1], sizes[0]))}
    shared = docs.sparkSession.sparkContext.broadcast(features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(index.of(t.as_py()).items()) for t in b.column(2)], pa.map_(pa.int32(), pa.float64()))], ["toxic", "h", "x"])

    rows = in_batches(texts.select("toxic", "h", "text"), each, "toxic int, h long, x map<int,double>").toArrow().sort_by([("toxic", "ascending"), ("h", "ascending")])
    found: tuple[list, list] = ([], [])
    for toxic, x in zip(rows.column("toxic").to_pylist(), rows.column("x")):
        found[toxic].append(dict(x.as_py()))
    weights, bias = train(found[1], found[0], len(features), float(np.clip(prior, 0.001, 0.9)))
    return features, weights, bias


def score(docs: DataFrame, model: tuple[dict[str, int], np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text); an empty or null text has the score of a text without known features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, bias = shared.value
        index = _Index(features)
        for b in batches:
            z = np.array([bias + sum(float(weights[i]) * x for i, x in index.of(t.as_py()).items()) for t in b.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"])

    taken = docs.select("doc_id", "text")
    return in_batches(taken, each, f"doc_id {taken.dtypes[0][1]}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from score 0.5 on) of every row of ``docs`` (doc_id, text).

    Learns from rows whose crc32(doc_id as text) mod 5 is not 0; null doc_ids are scored but not learned from. Repeated label
    rows of a document count once, as toxic if any says so; equal texts are learned from once; without any toxic label every
    score is near 0. Further columns are ignored; an empty table gives an empty result.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False))
    model = fit(docs.select("doc_id", "text").filter(fold), labels.select("doc_id", "toxic").filter(fold), prior)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
