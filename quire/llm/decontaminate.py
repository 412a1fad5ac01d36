"""Benchmark decontamination as a prefix-filtered set join (DataFrame operations only).

An item window must be contained whole, so with its words ordered by rarity the necessary prefix is one word: a text that
holds the window holds the window's rarest word. Corpus positions of such words are the only candidates; offset and length
bounds place the window around them and a comparison of the word slices verifies containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lower_ascii, packed, stage, unpacked

#: Fixed value: a word is a run of ASCII letters, digits and any non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of more words or bytes than this are joined by shuffle instead of broadcast.
BROADCAST_WORDS, BROADCAST_BYTES = 1_000_000, 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _small(df: DataFrame, key: str) -> DataFrame:
    """Hint a broadcast only for a vocabulary whose size has been checked."""
    return F.broadcast(df) if _is_small(df, key) else df


def _is_small(df: DataFrame, key: str) -> bool:
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(key) + 32), F.lit(0))).first()
    return n <= BROADCAST_WORDS and size <= BROADCAST_BYTES


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """One row per distinct window: window_id, gram (array of words), item_ids (sorted strings)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(lower_ascii(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("at")
    grams = w.select("item_id", "w", at).select("item_id", F.slice("w", F.col("at") + 1, F.lit(window)).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item_id").alias("item_ids")).withColumn("window_id", F.xxhash64("gram"))


def prefix_tokens(grams: DataFrame, docs: DataFrame) -> DataFrame:
    """For each word that is the rarest of some window: token, wins (its windows with the word's offset in them)."""
    each = grams.select("gram", "item_ids", F.posexplode("gram").alias("off", "token"))
    vocabulary = each.select("token").distinct()
    # Rarity only orders the words, so the cheaper full lower-casing is good enough for counting.
    hinted = F.broadcast if _is_small(vocabulary, "token") else lambda df: df
    seen = docs.select(F.explode(words(F.lower("text"))).alias("token")).join(hinted(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarity = each.join(hinted(seen), "token", "left")  # no more rows than the vocabulary.withColumn("n", F.coalesce("n", F.lit(0)))
    first = rarity.groupBy("gram", "item_ids").agg(F.min(F.struct("n", "token", "off")).alias("p"))
    return first.groupBy(F.col("p.token").alias("token")).agg(F.collect_list(F.struct(F.col("p.off").alias("off"), "gram", "item_ids")).alias("wins"))


def marked(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Like ``decontaminate``, with h (a hash of the text) besides."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    tokens = stage(prefix_tokens(stage(item_windows(items, window), "windows"), docs), "prefixes")
    split = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("h"), words(lower_ascii(F.col("text"))).alias("w"))
    each = split.select("row", "doc_id", "h", "w", F.posexplode_outer("w").alias("pos", "token"))
    keys = _small(tokens.select("token", F.lit(True).alias("rare")), "token")
    # The first word of each document (or its absence) carries the document itself; all other rows are candidates. A row
    # without a rare word gets a token of its own that matches nothing, so that such rows stay spread out in a shuffle.
    cand = each.join(keys, "token", "left").filter(F.col("rare") | F.coalesce(F.col("pos") == 0, F.lit(True)))
    around = F.slice("w", F.greatest(F.col("pos") - window + 2, F.lit(1)), 2 * window - 1)
    cand = cand.select("row", "doc_id", "h", F.greatest(F.size("w"), F.lit(0)).alias("n_words"), "pos", F.when(F.col("rare"), F.col("token")).otherwise(F.concat(F.lit(" "), F.col("row").cast("string"))).alias("token"), F.when(F.col("rare"), around).alias("near"))
    at = F.least(F.col("pos"), F.lit(window - 1))  # where the rare word stands in near
    fits = F.filter("wins", lambda c: (at >= c["off"]) & (F.slice("near", F.greatest(at - c["off"] + 1, F.lit(1)), F.size(c["gram"])) == c["gram"]))
    found = cand.join(_hinted(tokens), "token", "left").select("row", "doc_id", "h", "n_words", "pos", F.when(F.col("wins").isNotNull(), fits).alias("hits"))
    spans = F.transform("hits", lambda c: F.struct((F.col("pos") - c["off"]).alias("at"), F.size(c["gram"]).alias("n"), c["item_ids"].alias("item_ids")))
    per_doc = found.select("row", "doc_id", "h", "n_words", F.when(F.size("hits") > 0, spans).alias("spans")).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.max("n_words").cast("long").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans")
    )
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.col("spans.item_ids"))))
    out = per_doc.select("doc_id", "h", "n_words", F.size(inside).cast("long").alias("n_hit"), ids.alias("item_ids"))
    return out.select(
        "doc_id", "h", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Mark every document word that lies inside an occurrence of a ``window``-word stretch of a benchmark item.

    docs: doc_id, text (more columns are ignored); items: item_id, text. Returns one row per input row: doc_id, n_words,
    n_hit, n_items, item_ids (sorted strings), items_sha256, contaminated.

    Null or empty texts have no words and are never contaminated; null items have no windows; an item shorter than the window
    is one window of its own length. Null doc_ids and repeated rows are kept, each with its own result. An empty benchmark
    leaves every document clean, an empty corpus gives an empty result.
    """
    return marked(docs, items, window).drop("h")


def _hinted(tokens: DataFrame) -> DataFrame:
    """The windows themselves go to all executors only below BROADCAST_BYTES: their words and item ids, at 16 bytes more each."""
    listed = lambda a: F.octet_length(F.array_join(a, "")) + 16 * F.size(a) + 32
    win = F.aggregate("wins", F.lit(0).cast("long"), lambda n, w: n + listed(w["gram"]) + listed(w["item_ids"]))
    size = tokens.agg(F.coalesce(F.sum(win), F.lit(0))).first()[0]
    return F.broadcast(tokens) if size <= BROADCAST_BYTES else tokens


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, min_hit: int = 1) -> DataFrame:
    """The documents of which fewer than ``min_hit`` words lie in benchmark windows, with all their columns.

    Rows are matched by doc_id and text, so repeated rows share the verdict.
    """
    hit = marked(docs, items, window).filter(F.col("n_hit") >= min_hit).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    keyed = packed(docs, "doc_id", "text").withColumn("_key", F.xxhash64("text"))
    return unpacked(keyed.join(hit, keyed["doc_id"].eqNullSafe(hit["_id"]) & (keyed["_key"] == hit["_h"]), "left_anti"), docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i + 1, i + 10), ' ') AS gram, least(10, len(w)) AS n
      FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
o AS (SELECT r, i, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS gram FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT o.r, o.i, o.n, g.item_id FROM o JOIN g ON o.gram = g.gram AND o.n = g.n),
p AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, unnest(range(0, n)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
