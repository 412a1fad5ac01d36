"""Language identification by the nearest of several TF-IDF centroids per language.

Texts are lower-cased, everything but letters becomes a single space, and character 1- to 3-grams are hashed into a fixed
number of features, weighted log(1 + count) times the inverse document frequency over all learnable documents, and
normalised. Each language gets a few centroids by spherical k-means over a bounded sample; a text takes the language of the
centroid with the largest cosine and is rejected where it lies further from it than the language's own texts of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out, in_batches, packed, unpacked

FEATURES = 1 << 12
#: Bound on the sample for the centroids: about so many documents of each language, however many there are.
SAMPLE_PER_LANG = 1500
#: Centroids of a language, and the languages that can be told apart: all centroids go to every task (256 MB at most).
CENTROIDS = 4
MOST_LANGS = 4096
#: Fewer texts than this, or than this share of a language's texts, are no cluster of their own.
LEAST, LEAST_SHARE = 10, 0.05
#: A text is rejected below this share of the 1st percentile of its language's own cosines at its length.
REJECT_SHARE = 0.7
#: The same where it cannot be told: for texts of fewer than SHORT letters and spaces, or where fewer than KNOWN texts were learned from.
LOOSE_SHARE, SHORT, KNOWN = 0.2, 64, 50
#: Lengths are banded by powers of two; all longer texts share the last band.
BANDS = 16
ROWS = 256  # texts made dense at a time

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once in a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with each run of other characters as one space, spaces at both ends; empty if no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    keep = letters()[c] if len(c) else np.empty(0, bool)
    if not keep.any():
        return np.empty(0, np.uint32)
    c = np.concatenate([[32], np.where(keep, c, 32), [32]]).astype(np.uint32)
    return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]


def counts(c: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts of coded text."""
    out = np.zeros(FEATURES, np.float32)
    for lo in range(0, len(c), 1 << 20):  # bounded memory for texts of any length
        part = c[lo : lo + (1 << 20) + 2]
        h = part * np.uint32(0x9E3779B1)
        two = (h[:-1] ^ (h[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ (h[2:] >> np.uint32(11))) * np.uint32(0xC2B2AE35)
        for n, x in enumerate((h, two, three)):
            own = x[: min(1 << 20, len(x))]
            out += np.bincount((own + np.uint32(n * 0x27D4EB2F)) * np.uint32(0x9E3779B1) >> np.uint32(20), minlength=FEATURES)
    return out


def counted(texts: list[str | None]) -> np.ndarray:
    return np.stack([counts(codes(t)) for t in texts])


def weighted(m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    m = np.log1p(m) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.maximum(norm, 1e-12)[:, None]


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    return weighted(counted(texts), idf)


def band(n_letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_letters, 1)).astype(int), BANDS - 1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with a letter and, for each feature, of those that have it; one small row per feature leaves a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for t in b.column(0):
                c = codes(t.as_py())
                if len(c):
                    df += counts(c) > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES)), pa.array(np.concatenate([[n], df]))], ["feature", "n"])

    found = in_batches(docs.select("text"), each, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    got = {r["feature"]: r["n"] for r in found}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(FEATURES)], np.float64)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by spherical k-means from k-means++ starts with a fixed seed; clusters of few members join the others."""
    rng = np.random.default_rng(0)
    c = x[[rng.integers(len(x))]]
    while len(c) < min(k, len(x)):
        far = np.maximum(1 - np.max(x @ c.T, axis=1), 0.0).astype(float)
        if far.sum() <= 1e-6:
            break
        c = np.concatenate([c, x[[rng.choice(len(x), p=far / far.sum())]]])
    least = max(LEAST, LEAST_SHARE * len(x))
    while True:
        for _ in range(rounds):
            near = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        sizes = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
        if len(c) == 1 or sizes.min() >= least:
            return c
        c = np.delete(c, np.argmin(sizes), axis=0)


def floors(top: np.ndarray, n_letters: np.ndarray) -> list[float]:
    """For each band of length the cosine that a text must reach; bands of few texts are taken with their neighbours, short ones apart."""
    out, own, short = [], band(n_letters), int(np.log2(SHORT))
    for b in range(BANDS):
        least, most = (short, BANDS - 1) if b >= short else (0, short - 1)
        lo = hi = b
        while ((own >= lo) & (own <= hi)).sum() < KNOWN and (lo > least or hi < most):
            lo, hi = max(lo - 1, least), min(hi + 1, most)
        some = top[(own >= lo) & (own <= hi)]
        tight = len(some) >= KNOWN and b >= short
        out.append(float((REJECT_SHARE if tight else LOOSE_SHARE) * np.quantile(some, 0.01)) if len(some) else 0.0)
    return out


def fit(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> dict:
    """idf, langs, centroids and floors from documents with text and lang.

    Document frequencies cover all rows; the centroids come from the texts with the smallest hashes, about
    ``sample_per_lang`` of each language.
    """
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    n, df = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.01)
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    share = F.xxhash64("doc_id", "text", F.lit("sample")).cast("double") / F.lit(2.0**64) + 0.5
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("lang")] if sizes else F.lit(0)
    sample = docs.filter(share * size < sample_per_lang).select("lang", "text").distinct()  # repeated texts are drawn as one

    def train(group: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in group["text"].sort_values() if len(codes(t))]
        if not texts:
            return pd.DataFrame({"lang": [], "centroid": [], "floors": []})
        x = np.concatenate([vectors(texts[i : i + ROWS], idf) for i in range(0, len(texts), ROWS)])
        c = cluster(x, centroids)
        low = floors(np.max(x @ c.T, axis=1), np.array([len(codes(t)) for t in texts]))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": [y.astype(np.float32).tobytes() for y in c], "floors": [low] * len(c)})

    rows = sample.groupBy("lang").applyInPandas(train, "lang string, centroid binary, floors array<double>").orderBy("lang", "centroid").collect()
    return {
        "idf": idf,
        "langs": [r["lang"] for r in rows],
        "centroids": np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]) if rows else np.zeros((0, FEATURES), np.float32),
        "floors": np.array([r["floors"] for r in rows]),
    }


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default) with lang_pred, score and rejected for every row.

    A null text, one without letters, or any text where no language was learned is ``und`` with score 0 and rejected. Equal
    cosines go to the alphabetically first language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id"] if keep is None else keep
    own = keep.index("text") if "text" in keep else len(keep)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, langs, scores, far = b.column(own), [], [], []
            for lo in range(0, b.num_rows, ROWS):
                part = texts.slice(lo, ROWS).to_pylist()
                if not m["langs"]:
                    langs, scores, far = langs + ["und"] * len(part), scores + [0.0] * len(part), far + [True] * len(part)
                    continue
                n = counted(part)
                length = n.sum(axis=1) / 3 + 1  # of 1-, 2- and 3-grams, the latter are one and two fewer
                v = weighted(n, m["idf"])
                cos = v @ m["centroids"].T
                best = np.argmax(cos, axis=1)
                top = cos[np.arange(len(part)), best].astype(float)
                empty = ~v.any(axis=1)
                langs += [None if e else m["langs"][i] for i, e in zip(best, empty)]
                scores += np.where(empty, 0.0, np.clip(top, 0.0, 1.0)).tolist()
                far += (empty | (top < m["floors"][best, band(length)])).tolist()
            pred = pa.array([x or "und" for x in langs], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pred, pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], [*b.schema.names[: len(keep)], "lang_pred", "score", "rejected"])

    taken = docs.select(*keep, *([] if "text" in keep else [F.col("text").alias("_text")]))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in taken.dtypes[: len(keep)]), "lang_pred string, score double, rejected boolean"])
    return in_batches(taken, each, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs`` (doc_id, text, lang; more columns are ignored).

    Learns from rows whose crc32(doc_id as text) mod 3 is not 1; null doc_ids are neither learned from nor held out. Repeated
    rows count as often as they occur. An empty table gives an empty result.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))
    found = predict(docs, fit(docs.filter(out)))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are rejected; all columns stay as they are."""
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False))
    found = predict(packed(docs, "text"), fit(docs.filter(learn)), ["_rest", "text"])
    return unpacked(found.filter("NOT rejected").select("_rest", "text"), docs.columns)
