"""Documents and reports: reassembly, contents, change summaries, savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.config import DEFAULT, EngineConfig
from quire.functions.topk import first_k

#: Sections that never enter the table of contents (whole names), and the shortest one that does.
NOT_IN_TOC = r"^Figure\s+\d+$|^Table\s+\d+$|^Unknown Section$|^\[Figure\s+\d+\]$|^\[Table\s+\d+\]$"
TOC_LEAST = 3
_str = lambda c: F.col(c).cast("string")


def assemble(chunks: DataFrame) -> DataFrame:
    """document_id and body: chunks by page and id, a heading where the section changes, a page comment, then the text.

    chunks: document_id, chunk_id, page_start, section_hierarchy, content, reviewed_content. A chunk without section keeps the
    one before. One document's text is gathered in one row.
    """
    order = Window.partitionBy("document_id").orderBy("page_start", "chunk_id")
    section = F.nullif("section_hierarchy", F.lit(""))
    before = F.last(section, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    head = F.when(section.isNotNull() & ~section.eqNullSafe(before), F.concat(F.lit("\n## "), section, F.lit("\n"))).otherwise("")
    page = F.when(F.coalesce("page_start", F.lit(0)) != 0, F.concat(F.lit("<!-- Page "), _str("page_start"), F.lit(" -->\n"))).otherwise("")
    text = F.coalesce(F.nullif("reviewed_content", F.lit("")), "content", F.lit(""))
    # One text goes to a document's task, not the content and its review.
    texts = chunks.select("document_id", "page_start", "chunk_id", "section_hierarchy", text.alias("_text"))
    part = texts.withColumn("_part", F.concat(head, page, "_text", F.lit("\n\n")))
    return part.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_start", "chunk_id", "_part"))), lambda x: x["_part"]), "").alias("body"))


def contents(chunks: DataFrame) -> DataFrame:
    """document_id, place, section, anchor: the distinct sections in order of first appearance."""
    ok = (F.length("section_hierarchy") >= TOC_LEAST) & ~F.col("section_hierarchy").rlike(NOT_IN_TOC)
    first = chunks.filter(ok).groupBy("document_id", F.col("section_hierarchy").alias("section")).agg(F.min(F.struct("page_start", "chunk_id")).alias("at"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("at"))
    anchor = F.replace(F.replace(F.lower("section"), F.lit(" "), F.lit("-")), F.lit("."), F.lit(""))
    return first.select("document_id", place.alias("place"), "section", anchor.alias("anchor"))


def contents_text(toc: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- ["), "section", F.lit("](#"), "anchor", F.lit(")"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n")
    return toc.groupBy("document_id").agg(F.concat(F.lit("## Table of Contents\n\n"), lines, F.lit("\n")).alias("toc"))


def reference_report(refs: DataFrame) -> DataFrame:
    """document_id and the report on its references: totals, a table of broken ones, counts by type."""
    row = F.concat(F.lit("| "), "reference_text", F.lit(" | "), "reference_type", F.lit(" | "), "target_number", F.lit(" | "), _str("page_number"), F.lit(" | "), "chunk_id", F.lit(" |"))
    bad = F.collect_list(F.when(~F.col("is_valid"), F.struct("page_number", "chunk_id", "pattern_no", "position", row.alias("l"))))
    # By type first, so that the references are read once for both.
    by = refs.filter("document_id IS NOT NULL").groupBy("document_id", "reference_type").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("v"), bad.alias("bad"))
    line = F.concat(F.lit("| "), "reference_type", F.lit(" | "), _str("n"), F.lit(" | "), _str("v"), F.lit(" | "), (F.col("n") - F.col("v")).cast("string"), F.lit(" |"))
    bad = F.transform(F.array_sort(F.flatten(F.collect_list("bad"))), lambda x: x["l"])
    g = by.groupBy("document_id").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), bad.alias("bad"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("types"))
    head = F.concat(F.lit("# Cross-Reference Validation Report\n\n**Total References:** "), _str("n"), F.lit("  \n**Valid:** "), _str("v"), F.lit("  \n**Invalid:** "), (F.col("n") - F.col("v")).cast("string"), F.lit("  \n\n"))
    table = F.when(F.size("bad") > 0, F.concat(F.lit("## Broken References\n\n| Reference | Type | Target | Page | Chunk ID |\n|-----------|------|--------|------|----------|\n"), F.array_join("bad", "\n"), F.lit("\n"))).otherwise("")
    tail = F.concat(F.lit("\n## References by Type\n\n| Type | Total | Valid | Invalid |\n|------|-------|-------|---------|\n"), "types", F.lit("\n"))
    return g.select("document_id", F.concat(head, table, tail).alias("report"))


def header(metadata: DataFrame) -> DataFrame:
    """document_id and header; metadata: document_id, title, filename, total_pages, and review_date, which the caller sets."""
    known = lambda c, otherwise: F.coalesce(_str(c), F.lit(otherwise))
    return metadata.select("document_id", F.concat(
        F.lit("# "), known("title", "Untitled Document"), F.lit("\n\n**Source:** "), known("filename", "unknown.pdf"), F.lit("\n**Review Date:** "), known("review_date", ""),
        F.lit("\n**Total Pages:** "), known("total_pages", "N/A"), F.lit("\n\n---\n\n"),
    ).alias("header"))


def document(chunks: DataFrame, metadata: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """document_id and text: header, contents (where a section enters them), chunks, and the report on references where there are some."""
    d = assemble(chunks).join(header(metadata), "document_id", "left").join(contents_text(contents(chunks)), "document_id", "left")
    toc = F.when(F.col("toc").isNotNull(), F.concat("toc", F.lit("\n---\n"))).otherwise("")
    text = F.concat(F.coalesce("header", F.lit("")), toc, "body")
    if refs is not None:
        d = d.join(reference_report(refs), "document_id", "left")
        text = F.concat(text, F.when(F.col("report").isNotNull(), F.concat(F.lit("\n---\n"), "report")).otherwise(""))
    return d.select("document_id", text.alias("text"))


#: Labels of the change summary's header, before and after its line.
SUMMARY_TITLE = "# Review Changes Summary\n\n"
SUMMARY_LABELS = {"filename": "Document", "generated": "Generated", "total_changes": "Total Changes"}
PROCESSING_TITLE = "\n---\n\n## Processing Summary\n\n"
PROCESSING_LABELS = {"total_pages": "Pages Processed", "completed": "Chunks Processed", "time": "Total Time", "speed": "Processing Speed", "avg_confidence": "Average Confidence"}


def change_header(stats: DataFrame, generated: Column) -> DataFrame:
    """document_id and the head of the change summary, from one row of figures for each document.

    stats: document_id, filename, total_changes, total_pages, completed, seconds, avg_confidence; what is null counts as 0, a
    missing file name as N/A. ``generated`` is the time that it states, as text. Without seconds the speed is 0.
    """
    number = lambda c: F.format_number(F.coalesce(c, F.lit(0)).cast("long"), 0)
    plain = lambda places, x: F.format_string(f"%.{places}f", F.coalesce(x, F.lit(0.0)).cast("double"))
    seconds = F.coalesce("seconds", F.lit(0.0))
    values = {
        "filename": F.coalesce("filename", F.lit("N/A")), "generated": generated, **{c: number(c) for c in ("total_changes", "total_pages", "completed")},
        "time": F.concat(plain(1, seconds), F.lit(" seconds ("), plain(1, seconds / 60), F.lit(" minutes)")),
        "speed": F.concat(plain(1, F.try_divide(F.col("total_pages"), seconds)), F.lit(" pages/second")), "avg_confidence": plain(2, F.col("avg_confidence")),
    }
    lines = lambda labels: [x for c, name in labels.items() for x in (F.lit(f"**{name}:** "), values[c], F.lit("\n"))]
    return stats.select("document_id", F.concat(F.lit(SUMMARY_TITLE), *lines(SUMMARY_LABELS), F.lit(PROCESSING_TITLE), *lines(PROCESSING_LABELS), F.lit("\n---\n\n")).alias("header"))


def change_summary(stats: DataFrame, changes: DataFrame, generated: Column) -> DataFrame:
    """document_id and the whole change summary: its header (see ``change_header``) and its sections (see ``change_sections``)."""
    j = change_header(stats, generated).join(change_sections(changes), "document_id", "left")
    return j.select("document_id", F.concat("header", F.coalesce("sections", F.lit(""))).alias("summary"))


def latest_changes(latest: DataFrame) -> DataFrame:
    """document_id, ord, type, original, corrected, reason, severity, description of every change in the latest reviews (changes).

    Table and figure issues are one type, table_issues; other types than these, spelling, grammar and style are left out.
    """
    of = lambda c: F.col(f"c.{c}") if c in latest.schema["changes"].dataType.elementType.names else F.lit(None).cast("string")
    each = latest.select("document_id", "chunk_id", F.posexplode_outer("changes").alias("n", "c")).filter("n IS NOT NULL")
    kind = F.when(of("type").isin("table_issue", "figure_issue"), "table_issues").when(of("type").isin("spelling", "grammar", "style"), of("type"))
    return each.select("document_id", F.struct("chunk_id", "n").alias("ord"), kind.alias("type"), *[of(c).alias(c) for c in ("original", "corrected", "reason", "severity", "description")]).filter("type IS NOT NULL")


def change_sections(changes: DataFrame) -> DataFrame:
    """document_id and the sections of the change summary, as far as there are changes: spelling, grammar, style, tables and figures.

    changes: as from ``latest_changes``. Examples are the first distinct pairs by ord; each section sees only those it shows.
    """
    low = F.lower(F.coalesce("reason", F.lit("")))
    part = F.when(F.col("type") != "grammar", F.col("type")).when(low.contains("space"), "space").when(low.contains("punctuation"), "punctuation").otherwise("other")
    tagged = changes.withColumn("part", F.when((F.col("type") == "table_issues"), F.concat_ws(" ", F.lit("table"), "severity")).otherwise(part))
    both = (F.col("type") == "grammar") & low.contains("space") & low.contains("punctuation")  # such a change is in both lists
    tagged = tagged.withColumn("part", F.explode(F.when(both, F.array(F.lit("space"), F.lit("punctuation"))).otherwise(F.array("part"))))
    most = F.when(F.col("part").isin("spelling", "style"), 5).when(F.col("part").isin("space", "punctuation", "table high"), 3).otherwise(0)
    pair = ["original", "corrected"]
    shown = F.when(F.col("type") == "table_issues", F.col("ord.chunk_id")).otherwise("")  # every issue is an example of its own
    first = tagged.groupBy("document_id", "type", "part", *pair, shown.alias("own"), F.when(F.col("type") == "table_issues", F.col("ord.n")).alias("own_n")).agg(
        F.min(F.struct("ord", "reason", "description")).alias("f"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("document_id", "part").orderBy("f.ord"))
    text = (
        F.when(F.col("part") == "space", F.concat(F.lit("- '"), "original", F.lit("' (extra spaces)\n+ '"), "corrected", F.lit("' (single space)")))
        .when(F.col("part") == "style", F.concat(F.lit("- "), "original", F.lit("\n+ "), "corrected", F.lit("\n  # "), F.coalesce("f.reason", F.lit("Style improvement"))))
        .when(F.col("type") == "table_issues", F.concat(F.lit("  - "), F.coalesce("f.description", F.lit("Unknown issue")))).otherwise(F.concat(F.lit("- "), "original", F.lit("\n+ "), "corrected"))
    )
    ranked = first.withColumns({"_p": place, "_t": text}).withColumn("_t", F.when(F.col("_p") <= most, F.col("_t")))
    one = lambda p, what: F.max(F.when(F.col("part") == p, F.col(what)))
    parts = ["spelling", "space", "punctuation", "other", "style", "table high", "table medium", "table low"]
    by_part = ranked.groupBy("document_id", "type", "part").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_p", "_t")))), lambda x: x["_t"]), "\n").alias("x"))
    g = by_part.groupBy("document_id").agg(*[one(p, w).alias(f"{w}_{p.split()[-1]}") for p in parts for w in ("n", "x")])
    whole = changes.groupBy("document_id").agg(*[F.count_if(F.col("type") == t).alias(f"all_{t}") for t in ("spelling", "grammar", "style", "table_issues")])
    diff = lambda c: F.concat(F.lit("```diff\n"), F.col(c), F.lit("\n```\n"))
    line = lambda name, c: F.when(F.col(c) > 0, F.concat(F.lit(f"**{name}:** "), _str(c), F.lit("\n"))).otherwise("")
    end = F.lit("\n---\n\n")
    section = lambda t, title, what, *body: F.when(F.col(f"all_{t}") > 0, F.concat(F.lit(f"## {title}\n\n**Total{what[0]}:** "), _str(f"all_{t}"), F.lit(f"{what[1]}\n\n"), *body, end)).otherwise("")
    listed = lambda c, *more: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit("".join(more)), diff(c))).otherwise("")
    issues = F.when(F.coalesce("x_high", F.lit("")) != "", F.concat("x_high", F.lit("\n"))).otherwise("")
    return whole.join(g, "document_id", "left").select("document_id", F.concat(
        section("spelling", "Spelling Corrections", ("", " corrections"), listed("x_spelling", "**Examples:**\n")),
        section("grammar", "Grammar & Formatting Fixes", ("", " fixes"), line("Whitespace Corrections", "n_space"), listed("x_space"), line("Punctuation Spacing", "n_punctuation"), listed("x_punctuation"), line("Other Grammar Fixes", "n_other")),
        section("style", "Style Improvements", ("", " improvements"), listed("x_style", "**Examples:**\n")),
        section("table_issues", "Tables & Figures Issues", (" Issues", ""), line("High Severity", "n_high"), issues, line("Medium Severity", "n_medium"), line("Low Severity", "n_low")),
    ).alias("sections"))


def unique_examples(changes: DataFrame, most: int = 5) -> DataFrame:
    """type, place, original, corrected: the first ``most`` distinct pairs of each type in order of ord."""
    first = changes.groupBy("type", "original", "corrected").agg(F.min("ord").alias("ord"))
    return first_k(first, ["type"], ["ord"], most).select("type", "place", "original", "corrected")


def changes_by_type(changes: DataFrame, latest: DataFrame) -> DataFrame:
    """Counts of the latest reviews' changes by reported type; table and figure issues count together, other types are left out."""
    kind = F.when(F.col("type").isin("table_issue", "figure_issue"), "table_issues").when(F.col("type").isin("spelling", "grammar", "style"), F.col("type"))
    return changes.join(latest.select("chunk_id"), "chunk_id", "left_semi").select(kind.alias("type")).filter("type IS NOT NULL").groupBy("type").agg(F.count("*").alias("n"))


def grammar_split(changes: DataFrame) -> DataFrame:
    """Grammar changes whose reason names spaces, punctuation (both may hold), or neither."""
    r = F.lower(F.coalesce("reason", F.lit("")))
    space, punctuation = r.contains("space"), r.contains("punctuation")
    return changes.filter("type = 'grammar'").agg(F.count("*").alias("total"), F.count_if(space).alias("whitespace"), F.count_if(punctuation).alias("punctuation"), F.count_if(~space & ~punctuation).alias("other"))


def issues_by_severity(issues: DataFrame) -> DataFrame:
    """severity and count of table and figure issues, with the descriptions (reason) of the first three high ones."""
    i = issues.filter(F.col("type").isin("table_issue", "figure_issue"))
    text = F.struct("place", F.coalesce("reason", F.lit("Unknown issue")).alias("t"))
    shown = first_k(i.filter("severity = 'high'"), ["severity"], ["ord"], 3).groupBy("severity").agg(F.array_sort(F.collect_list(text)).alias("x"))
    g = i.groupBy("severity").agg(F.count("*").alias("n")).join(F.broadcast(shown), "severity", "left")  # shown is one row
    return g.select("severity", "n", F.coalesce(F.array_join(F.transform("x", lambda e: F.concat(F.lit("  - "), e["t"])), "\n"), F.lit("")).alias("examples"))


def reference_rates(refs: DataFrame) -> DataFrame:
    """document_id, total, valid, invalid, valid_pct, recommendation."""
    g = refs.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"))
    invalid = F.col("total") - F.col("valid")
    advice = F.when(invalid > 100, "High number of invalid references detected - recommend manual verification").when(invalid > 0, "Some invalid references found - spot check recommended")
    return g.select("document_id", "total", "valid", invalid.alias("invalid"), F.round(F.col("valid") / F.col("total") * 100, 1).alias("valid_pct"), advice.alias("recommendation"))


def savings(documents: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """documents (document_id, total_pages, seconds) with manual and saved minutes and efficiency in percent."""
    manual = F.col("total_pages") * config.manual_minutes_per_page
    saved = manual - F.col("seconds") / 60
    return documents.withColumns({"manual_minutes": manual, "saved_minutes": saved, "efficiency_pct": F.when(manual > 0, saved / manual * 100).otherwise(0.0)})


def summary_text(stats: DataFrame) -> DataFrame:
    """document_id and a summary from one row of figures per document."""
    line = lambda name, c: F.concat(F.lit(f"**{name}:** "), c if isinstance(c, Column) else _str(c), F.lit("  \n"))
    return stats.select("document_id", F.concat(
        F.lit("# Review Summary Report\n\n## Document Information\n\n"), line("Filename", "filename"), line("Total Pages", "total_pages"), line("Total Chunks", "total_chunks"),
        F.lit("\n## Processing Statistics\n\n"), line("Completed", "completed"), line("Average Confidence", F.format_number("avg_confidence", 2)),
        F.lit("\n## Language Review\n\n"), line("Total Changes", "n_changes"), F.lit("\n## Cross-Reference Validation\n\n"), line("Total References", "n_refs"), line("Valid", "n_valid"),
    ).alias("summary"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One text file per partition of ``document_id`` below ``path``."""
    df.select("document_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("document_id").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
