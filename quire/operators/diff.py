"""Version comparison: alignment by section or meaning, change records, significance and changelog."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.config import DEFAULT
from quire.functions.staging import staged
from quire.functions.text import cosine
from quire.operators import differ

#: Words that make a numeric change important; the mixed-case ones never occur in lower-cased text.
KEYWORDS = ["voltage", "current", "frequency", "temperature", "max", "min", "MHz", "GHz", "mA", "µA", "typical", "maximum", "minimum"]
#: Vectors of a document that are compared together; how far a product may be from the similarity, and norms beyond which it may be further.
BLOCK, SLACK, NORMS = 256, 1e-9, (1e-140, 1e140)


def align_sections(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """document_id, section, change_type and both sides' page and content: a full outer join on the section.

    Text chunks only; the last chunk of a section (by ord) stands for it; equal contents are left out.
    """

    def last(df: DataFrame, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("document_id", "section_hierarchy").orderBy(F.desc("ord")))
        one = df.filter("chunk_type = 'text'").withColumn("_r", rank).filter("_r = 1")
        return one.select("document_id", F.col("section_hierarchy").alias("section"), F.col("page_start").alias(f"page_v{n}"), F.col("content").alias(f"content_v{n}"))

    j = last(v1, 1).join(last(v2, 2), ["document_id", "section"], "full")
    kind = F.when(F.col("content_v1").isNull(), "added").when(F.col("content_v2").isNull(), "removed").when(F.col("content_v1") != F.col("content_v2"), "modified")
    return j.withColumn("change_type", kind).filter("change_type IS NOT NULL")


def numbers_differ(a: Column, b: Column) -> Column:
    numbers = lambda t: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\d+\.?\d*"), F.lit(0))))
    return numbers(a) != numbers(b)


def important(a: Column, b: Column) -> Column:
    """A keyword occurs and the sets of numbers differ."""
    low = F.lower(F.concat(a, b))
    any_word = F.lit(False)
    for k in KEYWORDS:
        any_word = any_word | low.contains(k)
    return any_word & numbers_differ(a, b)


def changes(aligned: DataFrame, threshold: float = 0.5) -> DataFrame:
    """document_id, section, change_type, pages (0 where absent), 200-character previews, significance, details.

    Added is medium, removed high; a modification is high by ``important``, else medium where the differ finds the texts less
    alike than ``threshold``, else low. Its details are the first five word-level edits. A pair of texts is compared where it
    stands; huge ones go in rounds (see ``differ``), equal ones once.
    """
    a, b, kind = F.col("content_v1"), F.col("content_v2"), F.col("change_type")
    modified = kind == "modified"
    far = modified & (differ.are_far(a, b) | differ.letters_far(a, b))
    shown = lambda text: F.when(modified, text).otherwise(F.substring(text, 1, 200))
    held = staged(aligned.withColumns({"high": modified & important(a, b), "far": far, "content_v1": shown(a), "content_v2": shown(b)}), "aligned")
    only = lambda which, text: F.when(which, text)
    low = modified & ~F.col("high")
    judged = held.filter("NOT far").withColumns({"below": differ.near_verdict(only(low, a), only(low, b), threshold), "_words": differ.near_changes(only(modified, a), only(modified, b))})
    rest = held.filter("far")
    if not rest.isEmpty():
        rest = rest.withColumn("key", differ.pair_key(a, b))
        letters = differ.distinct_pairs(rest.filter("NOT high"), "content_v1", "content_v2", lambda text: text)
        worded = differ.distinct_pairs(rest, "content_v1", "content_v2", differ.words)
        found, below = differ.compared(worded, letters, threshold)
        words = differ.word_changes(worded, found=found).withColumnRenamed("details", "_words")
        judged = judged.unionByName(rest.join(below.hint("merge"), "key", "left").join(words.hint("merge"), "key", "left").drop("key"))
    level = F.when(F.col("high"), "high").when(F.col("below"), "medium").otherwise("low")
    return judged.select(
        "document_id", "section", "change_type", F.coalesce("page_v1", F.lit(0)).alias("page_v1"), F.coalesce("page_v2", F.lit(0)).alias("page_v2"),
        F.coalesce(F.substring(a, 1, 200), F.lit("")).alias("content_v1"), F.coalesce(F.substring(b, 1, 200), F.lit("")).alias("content_v2"),
        F.when(kind == "added", "medium").when(kind == "removed", "high").otherwise(level).alias("significance"),
        F.when(kind == "added", F.concat(F.lit("New section added: "), "section")).when(kind == "removed", F.concat(F.lit("Section removed: "), "section")).otherwise(F.col("_words")).alias("details"),
    )


def by_significance(changed: DataFrame) -> DataFrame:
    return changed.groupBy("document_id", "significance").agg(F.count("*").alias("n"))


def changelog(changed: DataFrame, title: Column) -> DataFrame:
    """document_id and the changelog's text: a summary, then high changes in detail, medium as a list, low as a number."""
    c = changed.withColumn("details", F.coalesce("details", F.lit("")))
    sides = F.when(F.col("change_type") == "modified", F.concat(F.lit("**Before:** "), F.substring("content_v1", 1, 100), F.lit("...\n\n**After:** "), F.substring("content_v2", 1, 100), F.lit("...\n\n"))).otherwise("")
    full = F.concat(F.lit("### "), "section", F.lit(" (Page "), F.col("page_v1").cast("string"), F.lit(" → "), F.col("page_v2").cast("string"), F.lit(")\n\n**Type:** "), F.upper("change_type"), F.lit("\n\n**Details:** "), "details", F.lit("\n\n"), sides, F.lit("---\n"))
    item = F.concat(F.lit("- **"), "section", F.lit("**: "), "details", F.lit("\n"))
    pick = lambda level, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("significance") == level, F.struct("section", text.alias("t"))))), lambda x: x["t"]), "\n")
    n = lambda level: F.count_if(F.col("significance") == level)
    g = c.groupBy("document_id").agg(F.count("*").alias("n"), n("high").alias("h"), n("medium").alias("m"), n("low").alias("l"), pick("high", full).alias("hs"), pick("medium", item).alias("ms"))
    s = lambda col: F.col(col).cast("string")
    head = F.concat(
        F.lit("# Document Changelog\n\n**Comparison:** "), title, F.lit("\n---\n\n## Summary\n\n- **Total Changes:** "), s("n"), F.lit("\n- **High Priority:** "), s("h"),
        F.lit(" ⚠️\n- **Medium Priority:** "), s("m"), F.lit("\n- **Low Priority:** "), s("l"), F.lit("\n\n---\n"),
    )
    high = F.when(F.col("h") > 0, F.concat(F.lit("\n## ⚠️ High Priority Changes\n\n"), "hs")).otherwise("")
    medium = F.when(F.col("m") > 0, F.concat(F.lit("\n## Medium Priority Changes\n\n"), "ms")).otherwise("")
    low = F.when(F.col("l") > 0, F.concat(F.lit("\n\n## Low Priority Changes\n\n*"), s("l"), F.lit(" minor changes (rewording, formatting)*\n"))).otherwise("")
    return g.select("document_id", F.concat(head, high, medium, low).alias("changelog"))


def _in_blocks(side: DataFrame, key: str, e: str) -> DataFrame:
    """document_id and arrays of ``BLOCK`` structs (id, e) at most."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(key)) - 1
    rows = side.select("document_id", F.floor(place / BLOCK).alias("block"), F.struct(F.col(key).alias("id"), F.col(e).cast("array<double>").alias("e")).alias("row"))
    return rows.groupBy("document_id", "block").agg(F.collect_list("row").alias(e)).drop("block")


def _vectors(rows: pa.Array, width: int) -> np.ndarray:
    """A block's vectors over their norms, with NaN for all that a product would not tell safely."""
    e = rows.field("e")
    out = np.full((len(rows), width), np.nan)
    sizes = np.diff(e.offsets.to_numpy())
    whole = np.flatnonzero((sizes == width) & e.is_valid().to_numpy(zero_copy_only=False))
    flat = e.values.to_numpy(zero_copy_only=False)
    out[whole] = flat[e.offsets.to_numpy()[whole][:, None] + np.arange(width)]
    with np.errstate(all="ignore"):
        norm = np.sqrt((out * out).sum(1))
        return out / np.where((norm > NORMS[0]) & (norm < NORMS[1]), norm, np.nan)[:, None]


def _alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """document_id, id1, id2, similarity of a document's pairs that are similar enough; left: id1, e1; right: id2, e2.

    Blocks of both sides meet in one matrix product, and what it does not rule out is measured in full.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for at in range(batch.num_rows):
                one, two = (batch.column(c)[at].values for c in ("e1", "e2"))
                width = max(int(np.diff(side.field("e").offsets.to_numpy()).max(initial=0)) for side in (one, two))
                with np.errstate(all="ignore"):
                    far = _vectors(one, width) @ _vectors(two, width).T < threshold - SLACK
                p, q = np.nonzero(~far)
                for lo in range(0, len(p), 4 * BLOCK):
                    x, y = one.take(pa.array(p[lo : lo + 4 * BLOCK])), two.take(pa.array(q[lo : lo + 4 * BLOCK]))
                    document = pa.array([batch.column("document_id")[at].as_py()] * len(x), batch.schema.field("document_id").type)
                    yield pa.RecordBatch.from_arrays([document, x.field("id"), y.field("id"), x.field("e"), y.field("e")], ["document_id", "id1", "id2", "e1", "e2"])

    pairs = _in_blocks(left, "id1", "e1").join(_in_blocks(right, "id2", "e2"), "document_id")
    kinds = [dict(side.dtypes)[c] for side, c in ((left, "document_id"), (left, "id1"), (right, "id2"))]
    found = pairs.mapInArrow(close, f"document_id {kinds[0]}, id1 {kinds[1]}, id2 {kinds[2]}, e1 array<double>, e2 array<double>")
    return found.select("document_id", "id1", "id2", F.coalesce(cosine(F.col("e1"), F.col("e2")), F.lit(0.0)).alias("similarity")).filter(F.col("similarity") >= threshold)


def align_greedy(v1: DataFrame, v2: DataFrame, threshold: float = DEFAULT.align_threshold) -> DataFrame:
    """document_id, id1, id2, similarity: one-to-one matches in v1's order, each taking the best free v2 vector (ties: smallest id2).

    v1: document_id, id1, e1; v2: document_id, id2, e2. Unmatched v1 rows have null id2 (removed), unmatched v2 rows null id1
    (added); a document that one side lacks has no rows. A zero vector is similar to none.

    The order is kept without one row waiting for another: in rounds every v1 row proposes to the best v2 row that no earlier
    one holds, and every v2 row keeps the earliest proposer. What is held only ever passes to earlier rows, and where nothing
    changes any more, the matches are those of going through v1 in order. Only similar pairs take part. What is held is a small
    file of many rows, so it is not broadcast: Spark would go by the size of the file, and the driver would keep all rows.
    """
    both = v1.select("document_id").distinct().join(v2.select("document_id").distinct(), "document_id", "left_semi")
    left, right = (v.join(both, "document_id", "left_semi") for v in (v1, v2))
    pairs = staged(_alike(left, right, threshold), "alike")
    held = pairs.select("document_id", "id2", F.col("id1").alias("holder")).limit(0)
    while True:
        free = pairs.join(held.hint("merge"), ["document_id", "id2"], "left").filter(F.col("holder").isNull() | (F.col("holder") >= F.col("id1")))
        proposed = free.groupBy("document_id", "id1").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "id2")).alias("p")).select("document_id", "p.id2", "id1")
        now = staged(proposed.groupBy("document_id", "id2").agg(F.min("id1").alias("holder")), "held")
        if now.join(held.hint("merge"), ["document_id", "id2", "holder"], "left_anti").isEmpty():
            break
        held = now
    matched = pairs.join(held.hint("merge"), ["document_id", "id2"]).filter(F.col("holder") == F.col("id1")).select("document_id", "id1", "id2", "similarity")
    alone = lambda side, own, other: side.select("document_id", own).join(matched.hint("merge"), ["document_id", own], "left_anti").select("document_id", own, F.lit(None).cast("long").alias(other), F.lit(None).cast("double").alias("similarity"))
    return matched.unionByName(alone(left, "id1", "id2")).unionByName(alone(right, "id2", "id1"))


def align_vectors(v1: DataFrame, v2: DataFrame, threshold: float = DEFAULT.align_threshold) -> DataFrame:
    """The columns of ``align_sections`` by meaning: text chunks (ord, e besides) are matched greedily; equal contents are left out."""
    one, two = (v.filter("chunk_type = 'text'") for v in (v1, v2))
    pairs = align_greedy(one.select("document_id", F.col("ord").alias("id1"), F.col("e").alias("e1")), two.select("document_id", F.col("ord").alias("id2"), F.col("e").alias("e2")), threshold)
    side = lambda df, n: df.select("document_id", F.col("ord").alias(f"id{n}"), F.col("section_hierarchy").alias(f"section{n}"), F.col("page_start").alias(f"page_v{n}"), F.col("content").alias(f"content_v{n}"))
    j = pairs.join(side(one, 1), ["document_id", "id1"], "left").join(side(two, 2), ["document_id", "id2"], "left")
    kind = F.when(F.col("id1").isNull(), "added").when(F.col("id2").isNull(), "removed").when(F.col("content_v1") != F.col("content_v2"), "modified")
    out = j.select("document_id", F.coalesce("section1", "section2").alias("section"), "page_v1", "content_v1", "page_v2", "content_v2", kind.alias("change_type"))
    return out.filter("change_type IS NOT NULL")


def compare(v1: DataFrame, v2: DataFrame, title: Column, semantic: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes, counts by document and changelog of two versions (document_id, section_hierarchy, chunk_type, ord, page_start, content).

    Aligned by meaning where both have vectors (column e) and ``semantic`` is asked for, else by section.
    """
    by_meaning = semantic and "e" in v1.columns and "e" in v2.columns
    changed = changes(align_vectors(v1, v2) if by_meaning else align_sections(v1, v2))
    level = lambda x: F.count_if(F.col("significance") == x).alias(f"{x}_priority")
    counts = changed.groupBy("document_id").agg(F.count("*").alias("total_changes"), level("high"), level("medium"), level("low"))
    return changed, counts, changelog(changed, title)
