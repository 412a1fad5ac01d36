"""The whole review of a corpus as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions.staging import staged
from quire.operators import crossref, language, report, tables, triage
from quire.operators.chunking import split_chunks


@dataclass(frozen=True)
class Review:
    """Results of a review; nothing but the split runs before one of them is read or written."""

    chunks: DataFrame
    reviewed: DataFrame
    issues: DataFrame
    references: DataFrame
    documents: DataFrame


def review_chunks(chunks: DataFrame, config: EngineConfig = DEFAULT, replies: DataFrame | None = None) -> DataFrame:
    """chunks with reviewed_content, changes, confidence by chunk type: text by the language rules, tables and figures by their
    checks, anything else unchanged at confidence 1.

    chunks: document_id, chunk_id, page_start, section_hierarchy, chunk_type, content, rows, caption, image_size, image_index.
    replies: document_id, chunk_id, content, confidence of a model; where the rules are unsure of a text and the reply is
    clearly surer, its text and confidence take their place (asked and accepted say so). Changes stay those of the rules.
    """
    text = F.col("chunk_type") == "text"
    # The rules see texts only; a null content costs them nothing.
    c = language.review(chunks.withColumns({"_whole": F.col("content"), "content": F.when(text, F.col("content"))}), config).withColumn("content", F.col("_whole")).drop("_whole")
    if replies is not None:
        unsure = c.withColumns({"rule_text": F.col("reviewed_content"), "rule_confidence": F.when(text, F.col("confidence"))}).drop("confidence")
        c = triage.gate(unsure, replies, config).withColumns({"reviewed_content": F.col("final_text"), "asked": F.coalesce("asked", F.lit(False))}).drop("rule_text", "rule_confidence", "final_text")
    issues = F.when(F.col("chunk_type") == "table", tables.table_issues(F.col("content"), F.col("rows"))).when(
        F.col("chunk_type") == "figure", tables.figure_issues(F.col("content"), F.col("caption"), F.col("image_size"), F.col("image_index"), config)
    )
    c = c.withColumn("issues", issues)
    return c.withColumns({
        "reviewed_content": F.when(text, F.col("reviewed_content")).otherwise(F.col("content")),
        "changes": F.when(text, F.col("changes")).otherwise(F.slice("changes", 1, 0)),
        "confidence": F.when(text, F.col("confidence")).when(F.col("issues").isNotNull(), tables.chunk_confidence(F.col("issues"))).otherwise(1.0),
    })


def review(chunks: DataFrame, toc_targets: DataFrame, config: EngineConfig = DEFAULT, replies: DataFrame | None = None) -> Review:
    """Split, review, extract and validate references, and count by document. toc_targets: document_id, ref_type, target.

    The split chunks, which all results are made from, are written once; everything else runs when it is read.
    """
    # Dealt out first: the rules would else run in as many tasks as the input has files, or one.
    # References are found in the same pass: a column of its own, which only their readers read.
    both = staged(split_chunks(chunks.repartition("document_id", "chunk_id"), config).withColumn("_refs", crossref.references_of(F.col("content"))), "split")
    split = both.drop("_refs")
    reviewed = review_chunks(split, config, replies)
    targets = crossref.known_targets(crossref.extract_targets(split, config.section_targets_from_text), toc_targets)
    refs = crossref.validate(crossref.extract_references(both, F.col("_refs")), targets)
    cents = F.sum(F.round(F.col("confidence") * 100).cast("long"))  # whole numbers, so that the mean has no order of summation
    per_doc = reviewed.groupBy("document_id").agg(
        F.max("page_start").cast("long").alias("total_pages"), F.count("*").alias("total_chunks"), F.round(cents / (F.count("*") * 100), 4).alias("avg_confidence"),
        F.sum(F.size("changes")).alias("n_changes"), F.sum(F.coalesce(F.size("issues"), F.lit(0))).alias("n_issues"),
    )
    counted = report.reference_rates(refs).select("document_id", F.col("total").alias("n_refs"), F.col("valid").alias("n_valid"))
    issue_rows = tables.issue_rows(reviewed.select("document_id", "chunk_id", "issues"), F.col("issues")).drop("issues")
    return Review(split, reviewed, issue_rows, refs, per_doc.join(counted, "document_id", "left").fillna(0, ["n_refs", "n_valid"]))


def marked_up(reviewed: DataFrame) -> DataFrame:
    """The reviewed chunks with changed texts marked up instead of plainly corrected."""
    c = language.markup(reviewed)
    return c.withColumn("reviewed_content", F.when((F.col("chunk_type") == "text") & (F.size("changes") > 0), F.col("markup")).otherwise(F.col("reviewed_content"))).drop("markup")


def documents_of(result: Review, metadata: DataFrame) -> DataFrame:
    """document_id and its reviewed text with header, contents, marked-up chunks and reference report (see ``report.document``)."""
    return report.document(marked_up(result.reviewed), metadata, result.references)


def save(result: Review, base: str, by: str = "document_id") -> None:
    """Write chunks, reviews, references and document records below ``base``, one folder for each value of ``by``.

    A later run replaces the folders of the values that it has and leaves the others, so a repeated run changes nothing.
    ``by`` should be a coarser column where there are very many documents.
    """
    parts = {"chunks": result.chunks, "reviews": result.reviewed, "cross_references": result.references, "documents": result.documents}
    for name, df in parts.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{base}/{name}")


def broken_by_section(result: Review) -> DataFrame:
    """document_id, section, reference_type, total, broken, valid_pct: which sections have broken references."""
    where = result.chunks.select("document_id", "chunk_id", F.col("section_hierarchy").alias("section")).dropDuplicates(["document_id", "chunk_id"])
    j = result.references.join(where, ["document_id", "chunk_id"])
    g = j.groupBy("document_id", "section", "reference_type").agg(F.count("*").alias("total"), F.count_if(~F.col("is_valid")).alias("broken"))
    return g.withColumn("valid_pct", F.round((F.col("total") - F.col("broken")) / F.col("total") * 100, 2))
