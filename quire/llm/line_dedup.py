"""Line-run deduplication by a distributed suffix array (DataFrame operations only).

A document is a sequence of line ids. Prefix doubling ranks every suffix by its first 1, 2, 4, ... lines: the rank at twice
the length is the rank of the first half, moved on by the suffixes of the same first half that have a smaller second half.
So ranks are positions in the suffix array, and suffixes of equal rank form one interval whose longest common prefix is at
least that long. Suffixes that are alone in their interval are resolved and leave; the doubling ends once intervals are as
long as the longest run that has to be told apart, ``min_words`` lines.

A repeated run holds at least ``min_words`` words. It is the union of its minimal runs: from each of its lines the shortest
run that is long enough, forwards and backwards. Each of those is named by the intervals of its first and its last 2^k
lines, which overlap; runs of one name are equal, and all but the first in corpus order are deleted. A deleted line is thus
one that lies in a maximal repeated run which occurs earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import packed, stage, unpacked

#: A unit is a line with text and the blank lines that follow it.
BREAK = r"\n(?=[^\n]*\S)"
DOC = ["doc_id", "h"]


def _units(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", BREAK)).alias("idx", "line")).withColumn("line", F.regexp_replace("line", r"\s+$", ""))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, h, idx, words, rank of each line that occurs more than once; rank is its interval's start in the suffix array."""
    lines = _units(docs).filter("line <> ''").select(*DOC, "idx", F.size(F.split(F.trim("line"), r"\s+")).alias("words"), F.md5("line").alias("line_id"))
    often = lines.groupBy("line_id").agg(F.count("*").alias("n")).filter("n > 1").withColumn("bucket", F.substring("line_id", 1, 3))
    # Running counts in line order: within 4,096 buckets of the id's first digits, moved on by the buckets before.
    before = Window.partitionBy("bucket").orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    often = stage(often, "lines")
    buckets = often.groupBy("bucket").agg(F.sum("n").alias("size"))
    starts = buckets.withColumn("start", F.coalesce(F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "start")
    ranks = often.withColumn("within", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(starts), "bucket").select("line_id", (F.col("start") + F.col("within")).alias("rank"))
    return lines.join(ranks, "line_id").select(*DOC, "idx", "words", "rank")


def doubled(level: DataFrame, length: int) -> DataFrame:
    """Ranks by 2 * length lines from ranks by length lines, for suffixes that share them with another."""
    exact = Window.partitionBy(*DOC).orderBy("idx").rangeBetween(length, length)
    pairs = level.withColumn("next", F.max("rank").over(exact)).filter("next IS NOT NULL")
    often = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"))
    smaller = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = often.withColumn("moved", F.col("rank") + smaller).filter("n > 1").select("rank", "next", "moved")
    return pairs.join(ranks, ["rank", "next"]).select(*DOC, "idx", F.col("moved").alias("rank"))


def minimal_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, h, start, n: the shortest runs of repeated lines with at least ``min_words`` words, from and to each line."""
    doc = Window.partitionBy(*DOC).orderBy("idx")
    seg = lines.withColumn("seg", F.col("idx") - F.row_number().over(doc))
    upto = F.sum("words").over(Window.partitionBy(*DOC, "seg").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    seg = seg.withColumn("upto", upto).withColumn("since", F.col("upto") - F.col("words"))
    # A line belongs to the run as long as fewer than min_words words lie between the run's first (last) line and it.
    ahead = Window.partitionBy(*DOC, "seg").orderBy("since").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*DOC, "seg").orderBy("upto").rangeBetween(1 - min_words, 0)
    both = seg.select(
        *DOC, "idx", F.count("*").over(ahead).alias("n_ahead"), F.sum("words").over(ahead).alias("w_ahead"),
        F.count("*").over(back).alias("n_back"), F.sum("words").over(back).alias("w_back"),
    )
    forwards = F.when(F.col("w_ahead") >= min_words, F.struct(F.col("idx").alias("start"), F.col("n_ahead").cast("int").alias("n")))
    backwards = F.when(F.col("w_back") >= min_words, F.struct((F.col("idx") - F.col("n_back") + 1).cast("int").alias("start"), F.col("n_back").cast("int").alias("n")))
    return both.select(*DOC, F.explode(F.array_compact(F.array(forwards, backwards))).alias("run")).select(*DOC, "run.start", "run.n").distinct()


def later_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, h, start, n of every minimal run that is a later copy; units are counted from 0."""
    # Rows that repeat doc_id and text are one document; their lines' own counts only leave ranks unused.
    lines = stage(repeated_lines(docs).dropDuplicates([*DOC, "idx"]), "ranks")
    level, length, levels = lines.select(*DOC, "idx", "rank"), 1, None
    while True:
        at = level.withColumn("length", F.lit(length))
        levels = at if levels is None else levels.unionByName(at)
        if 2 * length > min_words:
            break
        level, length = stage(doubled(level, length), "ranks"), 2 * length
    power = F.greatest(F.lit(0), *[F.when(F.col("n") >= 1 << k, 1 << k) for k in range(length.bit_length())])
    runs = minimal_runs(lines, min_words).withColumn("length", power)
    head = levels.select(*DOC, "length", F.col("idx").alias("start"), F.col("rank").alias("head"))
    tail = levels.select(*DOC, "length", F.col("idx").alias("last"), F.col("rank").alias("tail"))
    named = runs.withColumn("last", F.col("start") + F.col("n") - F.col("length"))
    for part, at in ((head, "start"), (tail, "last")):
        named = _joined(named, part, at)
    named = stage(named.select(*DOC, "start", "n", "head", "tail"), "runs")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "start")).alias("first")
    # Staged, so that the join stands in a stage of its own, where a run with very many copies can be split.
    firsts = stage(named.groupBy("n", "head", "tail").agg(first, F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "firsts")
    later = named.join(firsts, ["n", "head", "tail"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    # Within the first copy's own document a later copy starts after the first copy's end.
    return later.filter(~same | (F.col("start") >= F.col("first.start") + F.col("n"))).select(*DOC, "start", "n")


def _joined(runs: DataFrame, part: DataFrame, at: str) -> DataFrame:
    part = part.withColumnsRenamed({c: f"_{c}" for c in ("doc_id", "h", "length", at)})
    on = runs["doc_id"].eqNullSafe(part["_doc_id"]) & (runs["h"] == part["_h"]) & (runs["length"] == part["_length"]) & (runs[at] == part[f"_{at}"])
    return runs.join(part, on).drop("_doc_id", "_h", "_length", f"_{at}")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from text, plus n_lines and n_dropped (lines with text).

    docs: doc_id, text and any further columns, which are kept (columns called n_lines or n_dropped are replaced). Lines are
    compared without trailing white space; blank lines belong to the line before and go with it. Copies are ordered by doc_id
    (null last), then by a hash of the text, then by position. Null texts stay null and have no lines; rows that repeat both
    doc_id and text are one document and get the same result; an empty table gives an empty result.
    """
    runs = later_runs(docs.select("doc_id", "text"), min_words)
    gone = runs.groupBy(*DOC).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("n") - 1))))).alias("_gone"))
    gone = gone.withColumnsRenamed({"doc_id": "_doc_id", "h": "_h"})
    docs = docs.drop("n_lines", "n_dropped")
    keyed = packed(docs, "doc_id", "text").withColumn("_key", F.xxhash64("text"))
    out = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_doc_id"]) & (keyed["_key"] == gone["_h"]), "left")
    units = F.split("text", BREAK)
    kept = F.array_except(F.sequence(F.lit(0), F.size(units) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_units"), i)), "\n"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_units") - (F.trim(F.regexp_replace(F.get("_units", F.lit(0)), r"\s+", "")) == "").cast("int"))
    out = out.withColumn("_units", units).withColumn("n_lines", lines.cast("long")).withColumn("n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    return unpacked(out.withColumn("text", text), docs.columns, "n_lines", "n_dropped")


#: The same rule without ranks: every minimal run as joined text, grouped.
ORACLE = r"""
WITH d AS (SELECT doc_id, text, str_split_regex(regexp_replace(coalesce(text, ''), '\n((?:[^\S\n]*\n)*[^\n]*\S)', chr(1) || '\1', 'g'), chr(1)) AS u FROM documents),
l0 AS (SELECT doc_id, unnest(u) AS raw, unnest(range(0, len(u))) AS i FROM d),
l AS (SELECT doc_id, i, regexp_replace(raw, '\s+$', '') AS line FROM l0),
w AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '\S+')) AS k FROM l WHERE line <> ''),
p AS (SELECT a.doc_id, a.i AS s, b.i AS e, sum(c.k) AS words, string_agg(c.line, chr(10) ORDER BY c.i) AS run, min(c.k) FILTER (c.i = a.i) AS k_first, min(c.k) FILTER (c.i = b.i) AS k_last, count(*) AS n
      FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + 50 JOIN w c ON c.doc_id = a.doc_id AND c.i BETWEEN a.i AND b.i GROUP BY a.doc_id, a.i, b.i),
m AS (SELECT doc_id, s, n, run FROM p WHERE words >= 50 AND n = e - s + 1 AND (words - k_last < 50 OR words - k_first < 50)),
f AS (SELECT *, first_value(doc_id) OVER o AS d0, first_value(s) OVER o AS s0 FROM m WINDOW o AS (PARTITION BY run ORDER BY doc_id, s)),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM f WHERE doc_id <> d0 OR s >= s0 + n),
t AS (SELECT l0.doc_id, string_agg(raw, chr(10) ORDER BY l0.i) FILTER (g.i IS NULL) AS text, count(*) FILTER (l.line <> '') AS n_lines, count(g.i) AS n_dropped
      FROM l0 JOIN l USING (doc_id, i) LEFT JOIN g USING (doc_id, i) GROUP BY l0.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(coalesce(t.text, '')) AS text_sha256 FROM t
"""
