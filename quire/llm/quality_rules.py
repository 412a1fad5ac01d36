"""Quality rules with adaptive thresholds per language and source.

Fixed base rules come first. For the documents that pass them, a mergeable quantile sketch of each ratio is kept per language
and source: counts by logarithmic bucket, so a quantile is off by at most the bucket's width, sketches merge by adding, and
the result doesn't depend on order. A threshold stands in the first gap of a sketch's tail beyond which a minority lies
further from the rest than the rest reaches from its median. A group that is too small, or whose sketch has no such gap, takes
the threshold of its language's merged sketch, or else of everything's, unless that would cut into the bulk of the group. The
thresholds are joined back to the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import in_batches, stage

#: The symbols that count, and the ASCII capitals.
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Each ratio with the count that it is a share of.
RATIOS = {"symbol_ratio": "word_chars", "dup_line_ratio": "n_lines", "repeat_ratio": "n_words", "upper_ratio": "word_chars", "mean_word": "n_words"}
#: A gap counts if it is wider than GAP times the way from the median to it and than UNITS times what one more item makes in a
#: text of median length, and if at least TAIL of the documents, and LEAST_TAIL, but no more than MOST_TAIL lie beyond it.
GAP, UNITS, TAIL, LEAST_TAIL, MOST_TAIL = 1.0, 20.0, 0.005, 5, 0.25
#: Groups of fewer documents, and languages, set no thresholds of their own.
LEAST = 50
#: Width of a sketch's buckets, and the value below which all is zero.
WIDTH, ZERO = 0.01, 1e-6
#: Threshold tables of more rows are joined by shuffle instead of broadcast.
BROADCAST_GROUPS = 100_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: bytes) -> tuple[int, ...]:
    """The base counts of BASE, then lines with a word and ASCII capitals."""
    w = text.split()
    spaces = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    points = len(text) if text.isascii() else len(text.decode())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(w), points - spaces, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(w), len(lines), len(text) - len(text.translate(None, CAPITALS))


def repeated(w: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    n = len(w) - size + 1
    if n < 2:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1).tolist()
    starts = [0, *ends[:-1]]
    windows = [joined[a:b] for a, b in zip(starts[:n], ends[size - 1 :])]
    windows[-1] += b" "  # the others end with the next word's space
    seen = Counter(windows)
    if len(seen) == n:
        return 0
    hit = np.fromiter((seen[x] > 1 for x in windows), bool, n)
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, n_lines, ratios and base_failed of every row."""
    names = [*BASE, "n_lines", "n_upper"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t.as_py() or b"") for t in b.column(3)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(rows[:, i]) for i in range(len(names)))], ["doc_id", "lang", "source", *names])

    taken = docs.select("doc_id", "lang", "source", F.col("text").cast("binary").alias("t"))
    m = in_batches(taken, each, ", ".join([*(f"{n} {t}" for n, t in taken.dtypes[:3]), *(f"{n} long" for n in names)]))
    at_least_one = lambda c: F.greatest(F.col(c), F.lit(1))
    return m.select(
        "doc_id", "lang", "source", *BASE,
        "n_lines",
        (F.col("n_symbols") / at_least_one("word_chars")).alias("symbol_ratio"),
        (F.col("n_dup_lines") / at_least_one("n_lines")).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / at_least_one("n_words")).alias("repeat_ratio"),
        (F.col("n_upper") / at_least_one("word_chars")).alias("upper_ratio"),
        (F.col("word_chars") / at_least_one("n_words")).alias("mean_word"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """level (0: lang and source, 1: lang, 3: everything), lang, source, measure, bucket, n of the documents that pass the base rules."""
    measures = [*RATIOS, *dict.fromkeys(RATIOS.values())]
    bucket = lambda c: F.when(F.col(c) >= ZERO, F.floor(F.log(F.col(c) / ZERO) / float(np.log1p(WIDTH)))).otherwise(-1).cast("int")
    each = measured.filter("NOT base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(m).alias("bucket")) for m in measures])).alias("x")).select("lang", "source", "x.*")
    own = stage(each.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n")), "sketches")
    sets = [["lang", "source", "measure", "bucket"], ["lang", "measure", "bucket"], ["measure", "bucket"]]
    merged = own.groupingSets(sets, "lang", "source", "measure", "bucket").agg((2 * F.grouping("lang") + F.grouping("source")).alias("level"), F.sum("n").alias("n"))
    return merged.select("level", "lang", "source", "measure", "bucket", "n")


def limits(sketched: DataFrame) -> DataFrame:
    """level, lang, source, n, and for each ratio low and high (null where a side has no gap), from and upto (where its bulk lies)."""
    key = ["level", "lang", "source", "measure"]
    at = Window.partitionBy(*key).orderBy("bucket")
    value = F.when(F.col("bucket") < 0, 0.0).otherwise(F.pow(F.lit(1 + WIDTH), F.col("bucket")) * ZERO)
    s = sketched.withColumns({"value": value, "upto": F.sum("n").over(at), "total": F.sum("n").over(Window.partitionBy(*key)), "next": F.lead(value).over(at)})
    s = s.withColumn("median", F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("value"))).over(Window.partitionBy(*key)))
    own = s.filter("bucket IS NOT NULL").select(*key, "value", "next", "upto", "total", "median")
    sizes = own.groupBy("level", "lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"m_{m}") for m in dict.fromkeys(RATIOS.values())]).withColumnsRenamed({c: f"_{c}" for c in ("level", "lang", "source")})
    unit = 1 / F.greatest(F.coalesce(*[F.when(F.col("measure") == r, F.col(f"m_{m}")) for r, m in RATIOS.items()]), F.lit(1.0))
    j = own.filter(F.col("measure").isin(*RATIOS)).join(sizes, (F.col("level") == F.col("_level")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    gap, middle = F.col("next") - F.col("value"), (F.col("next") + F.col("value")) / 2
    enough = lambda n: n.between(F.greatest(F.lit(LEAST_TAIL), TAIL * F.col("total")), MOST_TAIL * F.col("total"))
    wide = lambda reach: (gap > GAP * reach) & (gap > UNITS * unit)
    high = (F.col("value") >= F.col("median")) & enough(F.col("total") - F.col("upto")) & wide(F.col("value") - F.col("median"))
    low = (F.col("next") <= F.col("median")) & enough(F.col("upto")) & wide(F.col("median") - F.col("next"))
    of = lambda r, ok, x: F.when((F.col("measure") == r) & ok, x)
    bulk = lambda q: F.col("upto") >= q * F.col("total")
    return j.groupBy("level", "lang", "source").agg(
        F.max("total").alias("n"),
        *[x for r in RATIOS for x in (F.max(of(r, low, middle)).alias(f"low_{r}"), F.min(of(r, high, middle)).alias(f"high_{r}"))],
        *[x for r in RATIOS for x in (F.min(of(r, bulk(MOST_TAIL), F.col("value"))).alias(f"from_{r}"), F.min(of(r, bulk(1 - MOST_TAIL), F.col("value"))).alias(f"upto_{r}"))],
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source, and for each ratio low_<ratio> and high_<ratio> (null: no threshold) of every group in ``measured``."""
    found = stage(limits(sketches(measured)), "limits")
    part = lambda level, p: found.filter(F.col("level") == level).select(*{0: ["lang", "source"], 1: [F.col("lang").alias("lang_")], 3: [F.lit(1).alias("one")]}[level], F.struct(*found.columns[3:]).alias(p))
    groups = measured.select("lang", "source").distinct().withColumnsRenamed({"lang": "lang__", "source": "source__"})
    own, by_lang, overall = part(0, "o"), part(1, "l"), part(3, "a")
    g = groups.join(own, groups["lang__"].eqNullSafe(own["lang"]) & groups["source__"].eqNullSafe(own["source"]), "left").withColumn("one", F.lit(1))
    g = g.join(by_lang, F.col("lang__").eqNullSafe(F.col("lang_")), "left").join(F.broadcast(overall), "one", "left")  # overall is one row
    large = lambda p: F.coalesce(F.col(f"{p}.n") >= LEAST, F.lit(False))

    def side(name: str, ratio: str) -> Column:
        beyond = (lambda t: t >= F.col(f"o.upto_{ratio}")) if name == "high" else (lambda t: t <= F.col(f"o.from_{ratio}"))
        wider = [F.when(large(p) & (~large("o") | beyond(F.col(f"{p}.{name}_{ratio}"))), F.col(f"{p}.{name}_{ratio}")) for p in ("l", "a")]
        return F.coalesce(F.when(large("o"), F.col(f"o.{name}_{ratio}")), *wider).alias(f"{name}_{ratio}")

    return g.select(F.col("lang__").alias("lang"), F.col("source__").alias("source"), *[side(x, r) for r in RATIOS for x in ("low", "high")])


def judge(docs: DataFrame) -> DataFrame:
    """The base counts, base_failed, kept and the ratios of every row of ``docs`` (doc_id, text, lang, source).

    kept is false for documents that fail the base rules, else true unless a ratio lies beyond a threshold of its group. A null
    text counts as one without words and fails; null languages and sources are groups of their own; repeated rows count as
    often as they occur; further columns are ignored; an empty table gives an empty result.
    """
    measured = stage(metrics(docs), "metrics")
    group = stage(thresholds(measured).withColumnsRenamed({"lang": "_lang", "source": "_source"}), "thresholds")
    if group.count() <= BROADCAST_GROUPS:
        group = F.broadcast(group)
    joined = measured.join(group, measured["lang"].eqNullSafe(group["_lang"]) & measured["source"].eqNullSafe(group["_source"]), "left")
    within = reduce(lambda a, b: a & b, [F.coalesce(F.col(r) >= F.col(f"low_{r}"), F.lit(True)) & F.coalesce(F.col(r) <= F.col(f"high_{r}"), F.lit(True)) for r in RATIOS])
    return joined.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & within).alias("kept"), *RATIOS)
