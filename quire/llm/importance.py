"""Resampling of documents towards a target distribution by hashed n-gram features.

Every feature falls into one of BUCKETS buckets. The corpus and the target are counted by bucket, which is all that scoring
shuffles, and each bucket's gain is the logarithm of its share in the target over its share in the corpus, both smoothed by
one. A document is scored where it is, without exploding it: higher-order functions turn its words into an array of buckets
and add up the gains, looked up in a literal array. A Gumbel variable made from the document's id is added, so that taking the
highest scores draws documents without replacement with odds in proportion to their weights.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import LOWER, UPPER, stage

#: What ends a word, which is all of ASCII but letters and digits.
BREAKS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
BUCKETS = 10_000
#: Scores are ranked within spans of so many values, and the spans among each other.
SPAN = 512
#: Tables of more distinct scores are joined by shuffle instead of broadcast (24 bytes each).
BROADCAST_SCORES = 500_000


def words(text: Column) -> Column:
    """Lower-cased words; everything between them becomes a blank, so that no regular expression runs."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + BREAKS, LOWER + " " * len(BREAKS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def buckets(text: Column, longest: int = 1, n: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``longest`` words, repeats included."""
    w = words(text)
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % n).cast("int")
    if longest == 1:
        return F.transform(w, bucket)
    runs = lambda size: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
    more = [F.when(F.size(w) >= k, runs(k)).otherwise(F.array().cast("array<string>")) for k in range(2, longest + 1)]
    return F.transform(F.concat(w, *more), bucket)


def totals(texts: DataFrame, longest: int = 1, n: int = BUCKETS) -> np.ndarray:
    """Features in each of the ``n`` buckets over all rows; counted in the tasks first, so each sends ``n`` rows at most."""
    counted = texts.select(F.explode(buckets(F.col("text"), longest, n)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    out = np.zeros(n, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of every bucket, from its counts."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: str) -> Column:
    """A Gumbel variable in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def score(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row; nothing is shuffled or exploded."""
    n = len(gain)
    table = F.lit(np.asarray(gain, np.int64))
    each = F.struct(F.size("_b").cast("long").alias("n"), F.aggregate("_b", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1)).alias("weight"))
    n_words = F.col("s.n") if longest == 1 else F.size(words(F.col("text"))).cast("long")
    scored = docs.select("doc_id", "text", buckets(F.col("text"), longest, n).alias("_b")).select("doc_id", "text", each.alias("s"))
    return scored.select("doc_id", n_words.alias("n_words"), F.col("s.n").alias("n_features"), F.col("s.weight").alias("weight"), (F.col("s.weight") + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... for the highest scores of ``percent`` of the documents of ``least_words`` or more, else null.

    Counts by score give the place at which each score begins, so only rows of equal score are ordered among themselves. The
    noise spreads scores over thousands of values: even among equal texts no value holds more than 1 in 2,700 of the ids.
    """
    may = F.col("n_words") >= least_words
    counted = stage(scored.filter(may).groupBy("score").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("score") / SPAN)), "importance-counts")
    take = (counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent) // 100
    higher = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A few thousand spans: their number follows the range of scores, not the number of documents.
    spans = counted.groupBy("span").agg(F.sum("n").alias("n")).select(F.col("span"), higher(Window.orderBy(F.desc("span"))).alias("before"))
    within = counted.select("score", "span", higher(Window.partitionBy("span").orderBy(F.desc("score"))).alias("first"))
    places = stage(within.join(spans, "span").select(F.col("score").alias("_score"), (F.col("first") + F.col("before")).alias("_first")).filter(F.col("_first") < take), "importance-places")
    n_places, lowest = places.agg(F.count("*"), F.min("_score")).first()
    if lowest is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = may & (F.col("score") >= lowest)
    near = F.broadcast(places) if n_places <= BROADCAST_SCORES else places
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "n_words")) + F.col("_first")
    drawn = scored.filter(high).join(near, F.col("score") == F.col("_score")).withColumn("_at", place)
    drawn = drawn.select(*scored.columns, F.when(F.col("_at") <= take, F.col("_at")).cast("long").alias("rank"))
    return drawn.unionByName(scored.filter(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, n: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), drawn to be like ``target`` (text).

    A null or empty text has no features, weighs 0 and is never drawn; a null doc_id counts as an empty one in the noise and
    goes before other ids in ties; repeated rows are drawn one by one, those of the same id with ranks that follow each other.
    An empty target makes every bucket's gain follow the corpus alone, an empty corpus gives an empty result. Further columns
    are ignored.
    """
    docs, target = docs.select("doc_id", "text"), target.select("text")
    gain = gains(totals(docs, longest, n), totals(target, longest, n))
    return ranked(stage(score(docs, gain, longest, seed), "importance-scores"), percent, least_words)


def keep_drawn(docs: DataFrame, target: DataFrame, **kw) -> DataFrame:
    """The columns of ``docs`` for the drawn documents; rows of equal doc_id share the verdict."""
    ids = resample(docs, target, **kw).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_drawn"]), "left_semi")


ORACLE = r"""
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
ew AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM e) GROUP BY ALL),
v AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM ew)),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, y: xor(c // 256, t[xor(c, y) % 256 + 1])), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM ew JOIN b USING (word) GROUP BY bucket),
tot AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS tt),
g AS (SELECT bucket, CAST(floor(1000::DOUBLE * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), tot),
wt AS (SELECT r, sum(n * gain) AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY r),
h AS (SELECT r, CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT)::DOUBLE AS h FROM d),
sc AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d JOIN h USING (r) LEFT JOIN wt USING (r)),
rk AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM sc)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS BIGINT) AS rank FROM rk
"""
