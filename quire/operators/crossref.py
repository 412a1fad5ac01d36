"""Cross-references: extraction, targets, validation with a ranked fuzzy match, suggestions and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import bind, running_sums

#: Reference patterns by type, in the order in which references are emitted.
REFERENCES = [
    ("section", r"Section\s+(\d+(?:\.\d+)*)"), ("section", r"section\s+(\d+(?:\.\d+)*)"), ("section", r"§\s*(\d+(?:\.\d+)*)"),
    ("figure", r"Figure\s+(\d+-\d+)"), ("figure", r"Figure\s+(\d+)"), ("figure", r"Fig\.\s+(\d+-\d+)"), ("figure", r"Fig\.\s+(\d+)"),
    ("table", r"Table\s+(\d+-\d+)"), ("table", r"Table\s+(\d+)"), ("table", r"TABLE\s+(\d+-\d+)"),
    ("equation", r"Equation\s+(\d+-\d+)"), ("equation", r"Equation\s+(\d+)"), ("equation", r"Eq\.\s+(\d+-\d+)"),
]
#: Target patterns by chunk type.
TARGETS = {
    "figure": [r"\[Figure\s+(\d+(?:-\d+)?)\]", r"Figure\s+(\d+(?:-\d+)?)[:.]", r"^Figure\s+(\d+(?:-\d+)?)", r"Fig\.\s+(\d+(?:-\d+)?)"],
    "table": [r"\[Table\s+(\d+(?:-\d+)?)\]", r"Table\s+(\d+(?:-\d+)?)[:.]", r"TABLE\s+(\d+(?:-\d+)?)[:.]", r"^Table\s+(\d+(?:-\d+)?)"],
    "section": [r"(?m)^(\d+(?:\.\d+)*)\s+[A-Z]", r"(?m)^(\d+(?:\.\d+)*)\s+[a-z]", r"(?m)(?:^|\n)\s*(\d+(?:\.\d+)*)\s+\w+", r"SECTION\s+(\d+(?:\.\d+)*)", r"Section\s+(\d+(?:\.\d+)*)", r"(?m)^##+\s*(\d+(?:\.\d+)*)"],
}
TYPES = ("section", "figure", "table", "equation")
#: The words that reference patterns start with, their first letters, and such a word with all that a pattern can have behind it.
_WORD = "(?:" + "|".join(dict.fromkeys(p.split("\\s")[0] for _, p in REFERENCES)) + ")"
_FIRST = "".join(sorted({p[0] for _, p in REFERENCES}))
_HEAD = rf"^{_WORD}\s*\d[\d.\-]*"
_FOUND = "array<struct<pattern_no:int,reference_type:string,reference_text:string,target_number:string,position:int>>"


def references_of(content: Column) -> Column:
    """array<struct<pattern_no, type, text, number, position>> in type, pattern and position order; patterns may overlap.

    The text is cut once before every word that a pattern starts with. No match holds such a word but at its start, so each
    pattern is only tried on the pieces' heads: the word, white space, and all digits, dots and hyphens behind it.
    """

    def of(heads: Column, no: int, kind: str, pattern: str) -> Column:
        item = lambda h: F.struct(F.lit(no).alias("pattern_no"), F.lit(kind).alias("reference_type"), F.regexp_extract(h["head"], "^" + pattern, 0).alias("reference_text"), F.regexp_extract(h["head"], "^" + pattern, 1).alias("target_number"), h["position"].alias("position"))
        return F.transform(F.filter(heads, lambda h: h["head"].rlike("^" + pattern)), item)

    def headed(pieces: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), bind(F.transform(pieces, F.length), running_sums))
        each = F.zip_with(pieces, starts, lambda p, at: F.struct(F.regexp_extract(p, _HEAD, 0).alias("head"), at.alias("position")))
        return F.filter(each, lambda h: h["head"] != "")

    pieces = F.split(content, f"(?=[{_FIRST}])(?={_WORD})")
    return F.coalesce(bind(bind(pieces, headed), lambda heads: F.concat(*[of(heads, i, t, p) for i, (t, p) in enumerate(REFERENCES)])), F.array().cast(_FOUND))


def extract_references(chunks: DataFrame, found: Column | None = None) -> DataFrame:
    """One row per reference: ref_id, document_id, chunk_id, reference_text, reference_type, target_number, position, pattern_no, page_number.

    ``found`` has the chunks' references (see ``references_of``) where they are known.
    """
    found = references_of(F.col("content")) if found is None else found
    r = chunks.select("document_id", "chunk_id", F.col("page_start").alias("page_number"), F.inline_outer(found)).filter("pattern_no IS NOT NULL")
    ref_id = F.concat(F.lit("ref_"), F.substring(F.md5(F.concat("reference_text", "chunk_id", F.col("position").cast("string"))), 1, 12))
    return r.select(ref_id.alias("ref_id"), "document_id", "chunk_id", "reference_text", "reference_type", "target_number", "position", "pattern_no", "page_number")


def _document(*parts: DataFrame) -> list[str]:
    """The document's column where all have it: references and targets meet within their document."""
    return ["document_id"] if all("document_id" in p.columns for p in parts) else []


def extract_targets(chunks: DataFrame, from_text: bool = False) -> DataFrame:
    """Distinct (document_id, ref_type, target) that figure and table chunks define; text chunks define sections only if ``from_text``."""
    kind = {"figure": "figure", "table": "table"} | ({"text": "section"} if from_text else {})
    found = F.array().cast("array<struct<ref_type:string,target:string>>")

    def of(ref_type: str) -> Column:
        all_of = F.array_distinct(F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in TARGETS[ref_type]]))
        return F.transform(all_of, lambda t: F.struct(F.lit(ref_type).alias("ref_type"), t.alias("target")))

    for chunk_type, ref_type in kind.items():
        found = F.when(F.col("chunk_type") == chunk_type, of(ref_type)).otherwise(found)
    return chunks.select(*_document(chunks), F.inline_outer(found)).filter("target IS NOT NULL").distinct()


def known_targets(*parts: DataFrame) -> DataFrame:
    """Union of target sets; types other than the four are dropped."""
    return reduce(DataFrame.unionByName, parts).filter(F.col("ref_type").isin(*TYPES) & F.col("target").isNotNull()).distinct()


def similar(a: Column, b: Column) -> Column:
    """Equal length and one character differs, or two neighbours are swapped."""
    n = F.length(a)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i, j = F.get(at, F.lit(0)), F.get(at, F.lit(1))
    swapped = (F.size(at) == 2) & (j == i + 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1))) & (F.substr(a, j, F.lit(1)) == F.substr(b, i, F.lit(1)))
    return (n == F.length(b)) & (n > 0) & ((F.size(at) == 1) | F.coalesce(swapped, F.lit(False)))


def _alike(number: Column) -> tuple[Column, Column]:
    """For a number the forms that similar ones share: one character left open, and two neighbours swapped."""
    at = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))
    left, right = lambda i: F.substr(number, F.lit(1), i - 1), lambda i: F.substr(number, i, F.length(number))
    opened = F.transform(at, lambda i: F.concat(F.lit("?"), left(i), F.lit("*"), right(i + 1)))
    swapped = F.transform(at, lambda i: F.concat(F.lit("="), left(i), F.substr(number, i + 1, F.lit(1)), F.substr(number, i, F.lit(1)), right(i + 2)))
    return opened, F.slice(swapped, F.lit(1), F.greatest(F.length(number) - 1, F.lit(0)))


def _target_keys(target: Column) -> Column:
    return F.concat(F.array(F.concat(F.lit("="), target), F.concat(F.lit("0"), F.rtrim(target, F.lit(".0")))), _alike(target)[0])


#: The rules' confidences and names by rank.
RULES = [(1.0, "exact"), (0.98, "suffix"), (0.97, "numeric"), (0.9, "ancestor"), (0.85, "hyphen"), (0.8, "joined"), (0.7, "similar")]


def validate(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """refs with target_id, is_valid, confidence and match_reason by the first rule that finds a target in the same document.

    Rules in order: the same number; '.0' added; equal after trailing zeros and dots go; the nearest ancestor; the part before
    a hyphen; hyphens removed; a similar number. The smallest target wins ties. Each distinct number of a document gives the
    keys of all rules in one pass and meets the keys of the document's targets in one equi-join.
    """
    doc = _document(refs, targets)
    n = F.col("num")
    num = refs.select(*doc, F.col("reference_type").alias("rt"), F.col("target_number").alias("num")).distinct()
    dotted, hyphened = n.contains("."), n.contains("-")
    one = lambda rank, key: F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("up"), key.alias("key"))
    few = lambda ok, *keys: F.when(ok, F.array(*keys)).otherwise(F.array().cast("array<struct<rank:int,up:int,key:string>>"))
    parts = F.split(n, r"\.")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.struct(F.lit(3).alias("rank"), (-k).alias("up"), F.concat(F.lit("="), F.concat_ws(".", F.slice(parts, F.lit(1), k))).alias("key")))
    keys = F.concat(
        F.array(one(0, F.concat(F.lit("="), n)), one(2, F.concat(F.lit("0"), F.rtrim(n, F.lit(".0"))))), few(~dotted & ~hyphened, one(1, F.concat(F.lit("="), n, F.lit(".0")))),
        F.when(dotted, ancestors).otherwise(few(F.lit(False), one(3, n))), few(hyphened, one(4, F.concat(F.lit("="), F.substring_index(n, "-", 1))), one(5, F.concat(F.lit("="), F.replace(n, F.lit("-"), F.lit(""))))),
        F.transform(F.concat(*_alike(n)), lambda k: one(6, k)),
    )
    left = num.select(*doc, "rt", "num", F.inline(keys))
    right = targets.select(*doc, F.col("ref_type").alias("rt"), "target", F.explode(_target_keys(F.col("target"))).alias("key"))
    best = left.join(right, [*doc, "rt", "key"]).groupBy(*doc, "rt", "num").agg(F.min(F.struct("rank", "up", "target")).alias("m"))
    best = best.withColumnsRenamed({c: f"_{c}" for c in doc})
    on = (F.col("reference_type") == F.col("rt")) & (F.col("target_number") == F.col("num"))
    for c in doc:
        on = on & refs[c].eqNullSafe(F.col(f"_{c}"))
    j = refs.join(best, on, "left")
    conf, reason = (F.get(F.array(*[F.lit(r[i]) for r in RULES]), F.col("m.rank")) for i in (0, 1))
    return j.select(
        *refs.columns, F.when(F.col("m").isNotNull(), F.concat_ws("_", "reference_type", "m.target")).alias("target_id"), F.col("m").isNotNull().alias("is_valid"),
        F.coalesce(conf, F.lit(0.0)).alias("confidence"), F.coalesce(reason, F.lit("No match found")).alias("match_reason"),
    )


def suggestions(refs: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """reference_type, target_number, suggestion, rank: up to ``most`` similar targets of the same type and document for each number."""
    doc = _document(refs, targets)
    num = refs.select(*doc, "reference_type", "target_number").distinct()
    n = num.select("*", F.explode(F.concat(*_alike(F.col("target_number")))).alias("key"))
    t = targets.select(*doc, F.col("ref_type").alias("reference_type"), F.col("target").alias("suggestion"), F.explode(_target_keys(F.col("target"))).alias("key"))
    j = n.join(t, [*doc, "reference_type", "key"]).filter(F.col("suggestion") != F.col("target_number")).drop("key").distinct()
    rank = F.row_number().over(Window.partitionBy(*doc, "reference_type", "target_number").orderBy("suggestion"))
    return j.withColumn("rank", rank).filter(F.col("rank") <= most).select(*doc, "reference_type", "target_number", "suggestion", "rank")


def graph(refs: DataFrame) -> DataFrame:
    """chunk_id and its references, in emission order, as array<struct>."""
    item = F.struct("pattern_no", "position", F.col("reference_type").alias("type"), F.col("target_number").alias("target"), F.col("is_valid").alias("valid"), F.col("reference_text").alias("text"))
    return refs.groupBy("document_id", "chunk_id").agg(F.array_sort(F.collect_list(item)).alias("refs"))


def broken(refs: DataFrame) -> DataFrame:
    return refs.filter(~F.col("is_valid"))


def report(refs: DataFrame) -> DataFrame:
    """One row per reference type and one for all ('total'): counts, validity and confidence buckets."""
    c = F.col("confidence")
    count = lambda cond: F.count_if(cond)
    out = refs.groupingSets([[], ["reference_type"]], "reference_type").agg(
        F.grouping("reference_type").alias("all"), F.count("*").alias("total"), count(F.col("is_valid")).alias("valid"), count(~F.col("is_valid")).alias("invalid"), count(c == 1).alias("exact_match"),
        count((c >= 0.85) & (c < 1)).alias("high_confidence"), count((c >= 0.7) & (c < 0.85)).alias("medium_confidence"), count((c > 0) & (c < 0.7)).alias("low_confidence"),
        count(c == 0).alias("broken"), count((c > 0) & (c < 0.8)).alias("uncertain"),
    )
    return out.withColumn("reference_type", F.when(F.col("all") == 1, "total").otherwise(F.col("reference_type"))).drop("all")


def persist_validity(stored: DataFrame, checked: DataFrame) -> DataFrame:
    """The stored references with the checked validity; a target_id is only overwritten by another one, never by null or ''.

    A ref_id does not say its document, so references meet within theirs where both tables have document_id.
    """
    key = [*_document(stored, checked), "ref_id"]
    new = checked.select(*key, F.col("is_valid").alias("_valid"), F.nullif("target_id", F.lit("")).alias("_target"))
    j = stored.join(new, key, "left")
    return j.withColumn("is_valid", F.coalesce("_valid", "is_valid")).withColumn("target_id", F.coalesce("_target", "target_id")).drop("_valid", "_target")


def reference_prompt(refs: DataFrame, targets: DataFrame, most: int = 20) -> DataFrame:
    """ref_id and the question that asks a model about the reference, with the first ``most`` targets of its type and document."""
    doc = _document(refs, targets)
    rank = F.row_number().over(Window.partitionBy(*doc, "ref_type").orderBy("target"))
    lists = targets.withColumn("rank", rank).filter(F.col("rank") <= most).groupBy(*doc, F.col("ref_type").alias("reference_type")).agg(F.array_join(F.array_sort(F.collect_list("target")), ", ").alias("list"))
    j = refs.join(lists, [*doc, "reference_type"], "left")
    text = F.concat(F.lit('Validate this cross-reference: "'), "reference_text", F.lit('"\n\nAvailable valid targets:\n'), F.coalesce("list", F.lit("")), F.lit("\n"))
    return j.select("ref_id", text.alias("prompt"))


def parse_reference_reply(reply: Column) -> Column:
    """struct<valid, suggested_target, confidence> of a model's answer; one that is no JSON object is invalid, without suggestion."""
    parsed = F.from_json(reply, "valid boolean, suggested_target string, confidence double")
    return F.struct(F.coalesce(parsed["valid"], F.lit(False)).alias("valid"), parsed["suggested_target"].alias("suggested_target"), parsed["confidence"].alias("confidence"))
