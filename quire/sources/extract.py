"""Structured page content to chunks: sections, text, figures and tables.

Pages, lines, images and table cells come as DataFrames; ``read_documents`` makes them from files with a parser that is passed in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import first_group, strip
from quire.operators.chunking import chunk_id

#: What marks a heading line, and the font size above which lines are headings.
HEADING = r"^\d+(?:\.\d+)*\s+[A-Za-z]|^\s*\d+(?:\.\d+)*\s+\w+|^SECTION\s+\d+(?:\.\d+)*|^Section\s+\d+(?:\.\d+)*"
HEADING_SIZE = 12


def read_documents(spark: SparkSession, path: str, parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``parse(path, bytes)`` yields for every file under ``path``; a file that fails gives no rows but fails no others.

    ``schema`` must hold path and error (strings); a failed file is one row with its error.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    rows += [{"path": name, "error": None, **r} for r in parse(name, content)]
                except Exception as e:  # one bad file is a row, not a failed job
                    rows.append({"path": name, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, schema)


def toc_sections(toc: DataFrame) -> DataFrame:
    """Distinct leading section numbers of outline titles (column title)."""
    return toc.select(F.regexp_extract(strip(F.col("title")), r"^(\d+(?:\.\d+)*)", 1).alias("section")).filter("section <> ''").distinct()


def page_sections(lines: DataFrame) -> DataFrame:
    """document_id, page, section: the last heading up to the page's end, '' before the first.

    lines: document_id, page, line, text, font_size (that of the line's first span).
    """
    head = F.when((F.col("font_size") > HEADING_SIZE) & strip(F.col("text")).rlike(HEADING), strip(F.col("text")))
    per_page = lines.groupBy("document_id", "page").agg(F.max(F.when(head.isNotNull(), F.struct("line", head.alias("heading")))).alias("last"))
    upto = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return per_page.select("document_id", "page", F.coalesce(F.last("last.heading", ignorenulls=True).over(upto), F.lit("")).alias("section"))


def text_chunks(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """One text chunk per page with text; pages are numbered from 1, identifiers count from 0."""
    p = pages.filter(strip(F.col("text")) != "").join(sections, ["document_id", "page"], "left")
    return p.select(
        "document_id", chunk_id(F.col("text"), F.col("page") - 1, F.lit("")).alias("chunk_id"), F.col("text").alias("content"), F.col("page").alias("page_start"),
        F.col("page").alias("page_end"), F.lit("text").alias("chunk_type"), F.coalesce("section", F.lit("")).alias("section_hierarchy"),
    )


def figure_caption(page_text: Column, image_index: Column) -> Column:
    """The text after 'Figure n' or 'Fig. n', any case, up to the line's end; n is the image's index plus one."""
    number = (image_index + 1).cast("string")
    found = [F.call_function("regexp_extract", page_text, F.concat(F.lit(start), number, F.lit(r"[:\.]?\s+(.+?)(?:\n|$)")), F.lit(1)) for start in (r"(?i)Figure\s+", r"(?i)Fig\.\s+")]
    return F.coalesce(*[F.nullif(strip(f), F.lit("")) for f in found])


def figure_chunks(figures: DataFrame) -> DataFrame:
    """One chunk per image: document_id, page, image_index, image_format, image_size, xref, page_text."""
    f = figures.withColumn("caption", figure_caption(F.col("page_text"), F.col("image_index")))
    number = (F.col("image_index") + 1).cast("string")
    content = F.concat(F.lit("[Figure "), number, F.lit("]\n"), F.when(F.col("caption").isNotNull(), F.concat(F.lit("Caption: "), "caption", F.lit("\n"))).otherwise(""))
    f = f.withColumn("content", content)
    return f.select(
        "document_id", chunk_id(F.col("content"), F.col("page") - 1, F.concat(F.lit("fig_"), F.col("image_index").cast("string"))).alias("chunk_id"), "content", F.col("page").alias("page_start"),
        F.col("page").alias("page_end"), F.lit("figure").alias("chunk_type"), F.concat(F.lit("Figure "), number).alias("section_hierarchy"), "image_index", "image_format", "image_size", "xref", "caption",
    )


def table_empty(cells: Column) -> Column:
    """Fewer than two rows, or fewer than three cells with text other than '---'."""
    filled = F.filter(F.flatten(cells), lambda c: c.isNotNull() & (strip(c) != "") & (strip(c) != "---"))
    return F.coalesce((F.size(cells) < 2) | (F.size(filled) < 3), F.lit(True))


def table_sparse(cells: Column) -> Column:
    """More than half of the cells are blank, or there are none."""
    flat = F.flatten(cells)
    blank = F.filter(flat, lambda c: c.isNull() | (strip(c) == ""))
    return F.coalesce((F.size(flat) == 0) | (F.size(blank) / F.greatest(F.size(flat), F.lit(1)) > 0.5), F.lit(True))


def best_tables(default: Column, by_lines: Column, by_text: Column) -> Column:
    """The first of three extraction results that has a table with content, else the last."""
    good = lambda t: F.coalesce(F.exists(t, lambda x: ~table_empty(x)), F.lit(False))
    return F.when(good(default), default).when(good(by_lines), by_lines).otherwise(F.coalesce(by_text, F.array().cast("array<array<array<string>>>")))


def table_markdown(cells: Column) -> Column:
    """Header, separator and rows, each padded or cut to the header's width; null cells are blank."""
    clean = F.transform(cells, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    width = F.size(F.get(clean, F.lit(0)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width)
    rows = F.transform(F.slice(clean, F.lit(2), F.greatest(F.size(clean) - 1, F.lit(0))), lambda r: line(fit(r)))
    parts = F.concat(F.array(line(F.get(clean, F.lit(0))), line(F.array_repeat(F.lit("---"), width))), rows)
    return F.when(F.coalesce(F.size(cells), F.lit(0)) <= 0, "").otherwise(F.array_join(parts, "\n"))


def table_caption(page_text: Column, table_index: Column) -> Column:
    """Text after 'Table n', else after any hyphenated table number; over three characters, cut at 200."""
    number = (table_index + 1).cast("string")
    own = strip(F.call_function("regexp_extract", page_text, F.concat(F.lit(r"(?i)Table\s+"), number, F.lit(r"[:\.]?\s+(.+?)(?:\n|$)")), F.lit(1)))
    any_hyphen = strip(F.coalesce(first_group(page_text, r"(?i)Table\s+(\d+-\d+)[:\.]?\s+(.+?)(?:\n|$)", 2), F.lit("")))
    return F.substring(F.coalesce(*[F.when(F.length(c) > 3, c) for c in (own, any_hyphen)]), 1, 200)


def table_chunks(tables: DataFrame) -> DataFrame:
    """One chunk per table with content: document_id, page, table_index, cells, page_text."""
    t = tables.filter((F.size("cells") >= 2) & ~table_empty(F.col("cells"))).withColumn("caption", table_caption(F.col("page_text"), F.col("table_index")))
    number = (F.col("table_index") + 1).cast("string")
    head = F.concat(F.lit("[Table "), number, F.lit("]\n"), F.when(F.col("caption").isNotNull(), F.concat(F.lit("Caption: "), "caption", F.lit("\n\n"))).otherwise(""))
    t = t.withColumn("content", F.concat(head, table_markdown(F.col("cells"))))
    return t.select(
        "document_id", chunk_id(F.col("content"), F.col("page") - 1, F.concat(F.lit("tbl_"), F.col("table_index").cast("string"))).alias("chunk_id"), "content", F.col("page").alias("page_start"),
        F.col("page").alias("page_end"), F.lit("table").alias("chunk_type"), F.concat(F.lit("Table "), number).alias("section_hierarchy"), "table_index", F.size("cells").alias("rows"),
        F.size(F.get("cells", F.lit(0))).alias("columns"), "caption", F.when(table_sparse(F.col("cells")), "sparse").otherwise("good").alias("extraction_quality"),
    )


#: What a file says of itself.
INFO = ("title", "author", "subject", "creator")


def document_metadata(pages: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """document_id, total_pages, filename, title, author, subject, creator of every document.

    info: one row a document with any of the last four, as a parser finds them; what it lacks is ''.
    """
    m = pages.groupBy("document_id").agg(F.max("page").cast("long").alias("total_pages")).withColumn("filename", F.concat("document_id", F.lit(".pdf")))
    if info is not None:
        m = m.join(info.select("document_id", *[c for c in INFO if c in info.columns]), "document_id", "left")
    return m.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in m.columns else F.lit("") for c in INFO})


def stream_reply(body: Column) -> Column:
    """The text of a server-sent-event reply: content deltas of its data lines in order, up to [DONE]; malformed lines are skipped."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.startswith("data: "))
    data = F.transform(lines, lambda x: F.substring(x, 7, 1 << 30))
    stop = F.array_position(data, F.lit("[DONE]"))
    before = F.when(stop > 0, F.slice(data, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(data)
    return F.array_join(F.transform(before, lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.lit(""))), "")
