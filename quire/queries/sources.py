"""Queries of the extraction sources."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from quire.functions.staging import shared_dir
from quire.queries.sql import STRIP
from quire.sources import extract as E
from quire.sources.files import document_source
from quire.sources.seed import cte, frame


def lines(spark, d):
    p = frame(spark, d, "seed_pages").select("document_id", "page", "ord", F.posexplode(F.split("text", "\n")).alias("no", "text"))
    headed = F.when((F.col("no") == 0) & (F.col("ord") % 3 == 0), F.concat((F.col("ord") % 9 + 1).cast("string"), F.lit("."), (F.col("ord") % 4).cast("string"), F.lit(" "), "text")).otherwise(F.col("text"))
    return p.select("document_id", "page", (F.col("ord") * 100_000 + F.col("no")).alias("line"), headed.alias("text"), F.when(F.col("ord") % 6 == 0, 11.0).otherwise(14.0).alias("font_size"))


def _rows(spark, d):
    row = F.array(F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).otherwise("---"), F.col("p_size").cast("string"))
    return frame(spark, d, "seed_cells").withColumn("row", F.when(F.col("p_partkey") % 11 == 0, F.slice(row, 1, 2)).otherwise(row))


def _page_text(k):
    return F.when(k % 3 == 0, F.concat(F.lit("Table "), (k % 2 + 1).cast("string"), F.lit(": Sizes of "), "p_brand", F.lit("\nnext"))).when(k % 3 == 1, F.concat(F.lit("see TABLE 4-2. Parts "), "p_brand")).otherwise("nothing")


def all_tables(spark, d):
    """Every part of every brand: each brand's parts in tables of up to 12 rows; some tables are blank."""
    index = F.floor((F.col("row_no") - 1) / 12).cast("int").alias("table_index")
    t = _rows(spark, d).groupBy("p_brand", index).agg(F.array_sort(F.collect_list(F.struct("row_no", "row"))).alias("r"), F.min("p_partkey").alias("k"))
    k = F.col("k")
    cells = F.when(k % 4 == 0, F.transform("r.row", lambda r: F.array(F.lit("---"), F.lit(None).cast("string")))).otherwise(F.col("r.row"))
    return t.select(F.col("p_brand").alias("document_id"), (k % 90 + 1).cast("int").alias("page"), "table_index", cells.alias("cells"), _page_text(k).alias("page_text"))


def src_toc_sections(spark, d):
    return E.toc_sections(frame(spark, d, "seed_toc"))


def src_page_sections(spark, d):
    return E.page_sections(lines(spark, d))


def src_text_chunks(spark, d):
    return E.text_chunks(frame(spark, d, "seed_pages"), E.page_sections(lines(spark, d))).select("document_id", "chunk_id", "page_start", "section_hierarchy", F.md5("content").alias("content_md5"))


def src_figures(spark, d):
    return E.figure_chunks(frame(spark, d, "seed_figures"))


def src_tables(spark, d):
    return E.table_chunks(all_tables(spark, d)).select("document_id", "chunk_id", "page_start", "section_hierarchy", "rows", "columns", "caption", "extraction_quality", "content")


def src_table_predicates(spark, d):
    return all_tables(spark, d).select("document_id", E.table_empty(F.col("cells")).alias("empty"), E.table_sparse(F.col("cells")).alias("sparse"))


def src_table_strategies(spark, d):
    t = all_tables(spark, d)
    none = F.array().cast("array<array<array<string>>>")
    by_lines = F.when(F.col("page") % 2 == 0, F.array(F.array_repeat(F.array(F.lit("x"), F.lit("y")), 2))).otherwise(none)
    best = E.best_tables(F.array("cells"), by_lines, F.array(F.array(F.array(F.lit("t")))))
    return t.select("document_id", F.get(F.get(F.get(best, F.lit(0)), F.lit(0)), F.lit(1)).alias("cell"), F.size(best).cast("long").alias("n"))


def src_metadata(spark, d):
    pages = frame(spark, d, "seed_pages")
    info = pages.filter("ord % 50 = 0").select("document_id", F.concat(F.lit("Manual "), "document_id").alias("title"), F.when(F.col("ord") % 100 == 0, F.lit("A. Writer")).alias("author"))
    return E.document_metadata(pages, info.groupBy("document_id").agg(F.max("title").alias("title"), F.max("author").alias("author")))


def src_stream_reply(spark, d):
    return frame(spark, d, "seed_sse").select("doc_id", E.stream_reply(F.col("body")).alias("reply"))


def _lines(path, content):
    """A document's pages: a line of JSON for each."""
    for line in content.decode().splitlines():
        page = json.loads(line)
        yield {"kind": "text", "page": page["page"], "content": page.get("html", "")}
        yield {"kind": "structure", "page": page["page"], "content": page.get("url", "")}


def src_files(spark, d):
    """Documents of fifty pages, written to files and read through the data source."""
    base = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    page = F.struct((F.col("page_id") % 50).alias("page"), "url", "html")
    pages = frame(spark, d, "pages").select(F.floor(F.col("page_id") / 50).alias("document"), "page_id", F.to_json(page).alias("value"))
    pages.repartition("document").sortWithinPartitions("document", "page_id").select("document", "value").write.partitionBy("document").text(base)
    spark.dataSource.register(document_source(_lines, "page_documents"))
    rows = spark.read.format("page_documents").option("path", base).load()
    return rows.select(F.regexp_extract("path", "/document=([^/]+)/", 1).alias("document"), "ordinal", "kind", "page", F.md5("content").alias("content_md5"), "error")


QUERIES = {f.__name__: f for f in (src_toc_sections, src_page_sections, src_text_chunks, src_figures, src_tables, src_table_predicates, src_table_strategies, src_metadata, src_stream_reply, src_files)}

_T = STRIP("text")
_LINES = r""", pl AS (SELECT document_id, page, ord, unnest(string_split(text, chr(10))) AS t, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM seed_pages),
ln AS (SELECT document_id, page, ord * 100000 + no AS line, CASE WHEN no = 0 AND ord % 3 = 0 THEN (ord % 9 + 1) || '.' || (ord % 4) || ' ' || t ELSE t END AS text, CASE WHEN ord % 6 = 0 THEN 11.0 ELSE 14.0 END AS font_size FROM pl)"""
_SECTIONS = _LINES + f", hd AS (SELECT document_id, page, max_by({_T}, line) FILTER (font_size > 12 AND regexp_matches({_T}, '{E.HEADING}')) AS h FROM ln GROUP BY ALL), sec AS (SELECT document_id, page, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM hd)"
_FIGCAP = f"coalesce(nullif({STRIP('x1')}, ''), nullif({STRIP('x2')}, ''))"
_TABLES = r""", tr AS (SELECT p_brand, row_no, p_partkey, CASE WHEN p_partkey % 11 = 0 THEN [CASE WHEN p_partkey % 7 <> 0 THEN p_name END, CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE '---' END] ELSE [CASE WHEN p_partkey % 7 <> 0 THEN p_name END, CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE '---' END, CAST(p_size AS VARCHAR)] END AS r FROM seed_cells),
tg AS (SELECT p_brand, CAST(floor((row_no - 1) / 12) AS INT) AS table_index, list(r ORDER BY row_no) AS rs, min(p_partkey) AS k FROM tr GROUP BY ALL),
tb AS (SELECT p_brand AS document_id, CAST(k % 90 + 1 AS INT) AS page, table_index, CASE WHEN k % 4 = 0 THEN list_transform(rs, lambda x: ['---', NULL]) ELSE rs END AS cells, CASE WHEN k % 3 = 0 THEN 'Table ' || (k % 2 + 1) || ': Sizes of ' || p_brand || chr(10) || 'next' WHEN k % 3 = 1 THEN 'see TABLE 4-2. Parts ' || p_brand ELSE 'nothing' END AS page_text FROM tg),
tp AS (SELECT *, len(cells) < 2 OR len(list_filter(flatten(cells), lambda c: c IS NOT NULL AND trim(c) <> '' AND trim(c) <> '---')) < 3 AS empty, len(list_filter(flatten(cells), lambda c: c IS NULL OR trim(c) = '')) / len(flatten(cells)) > 0.5 AS sparse FROM tb)"""
_MD = """'| ' || array_to_string(list_transform(cells[1], lambda c: coalesce(c, '')), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(cells[1], lambda c: '---'), ' | ') || ' |' || chr(10) ||
 array_to_string(list_transform(cells[2:], lambda r: '| ' || array_to_string(list_transform(list_resize(r, len(cells[1]), ''), lambda c: coalesce(c, '')), ' | ') || ' |'), chr(10))"""
_TCAP = r"CASE WHEN length(regexp_extract(page_text, '(?i)Table\s+' || (table_index + 1) || '[:\.]?\s+([^\n]+?)(?:\n|$)', 1)) > 3 THEN regexp_extract(page_text, '(?i)Table\s+' || (table_index + 1) || '[:\.]?\s+([^\n]+?)(?:\n|$)', 1) WHEN length(regexp_extract(page_text, '(?i)Table\s+(\d+-\d+)[:\.]?\s+([^\n]+?)(?:\n|$)', 2)) > 3 THEN regexp_extract(page_text, '(?i)Table\s+(\d+-\d+)[:\.]?\s+([^\n]+?)(?:\n|$)', 2) END"

ORACLES = {
    "src_toc_sections": cte("seed_toc") + r" SELECT DISTINCT regexp_extract(trim(title), '^(\d+(?:\.\d+)*)', 1) AS section FROM seed_toc WHERE regexp_matches(trim(title), '^\d')",
    "src_page_sections": cte("seed_pages") + _SECTIONS + " SELECT * FROM sec",
    "src_text_chunks": cte("seed_pages") + _SECTIONS + f" SELECT p.document_id, 'chunk_' || (p.page - 1) || '_' || left(md5(left(text, 100) || (p.page - 1)), 12) AS chunk_id, p.page AS page_start, section AS section_hierarchy, md5(text) AS content_md5 FROM seed_pages p JOIN sec USING (document_id, page) WHERE {_T} <> ''",
    "src_figures": cte("seed_figures") + rf", x AS (SELECT *, regexp_extract(page_text, '(?i)Figure\s+' || (image_index + 1) || '[:\.]?\s+([^\n]+?)(?:\n|$)', 1) AS x1, regexp_extract(page_text, '(?i)Fig\.\s+' || (image_index + 1) || '[:\.]?\s+([^\n]+?)(?:\n|$)', 1) AS x2 FROM seed_figures), y AS (SELECT *, {_FIGCAP} AS caption FROM x), z AS (SELECT *, '[Figure ' || (image_index + 1) || ']' || chr(10) || CASE WHEN caption IS NOT NULL THEN 'Caption: ' || caption || chr(10) ELSE '' END AS content FROM y) SELECT document_id, 'chunk_' || (page - 1) || '_' || left(md5(left(content, 100) || (page - 1) || 'fig_' || image_index), 12) || '_fig_' || image_index AS chunk_id, content, page AS page_start, page AS page_end, 'figure' AS chunk_type, 'Figure ' || (image_index + 1) AS section_hierarchy, image_index, image_format, image_size, xref, caption FROM z",
    "src_tables": cte("seed_cells") + _TABLES + f", c AS (SELECT *, {_TCAP} AS caption, {_MD} AS md FROM tp WHERE NOT empty), f AS (SELECT *, '[Table ' || (table_index + 1) || ']' || chr(10) || CASE WHEN caption IS NOT NULL THEN 'Caption: ' || caption || chr(10) || chr(10) ELSE '' END || md AS content FROM c) SELECT document_id, 'chunk_' || (page - 1) || '_' || left(md5(left(content, 100) || (page - 1) || 'tbl_' || table_index), 12) || '_tbl_' || table_index AS chunk_id, page AS page_start, 'Table ' || (table_index + 1) AS section_hierarchy, CAST(len(cells) AS INT) AS rows, CAST(len(cells[1]) AS INT) AS columns, caption, CASE WHEN sparse THEN 'sparse' ELSE 'good' END AS extraction_quality, content FROM f",
    "src_table_predicates": cte("seed_cells") + _TABLES + " SELECT document_id, empty, sparse FROM tp",
    "src_table_strategies": cte("seed_cells") + _TABLES + " SELECT document_id, CASE WHEN NOT empty THEN cells[1][2] WHEN page % 2 = 0 THEN 'y' END AS cell, 1::BIGINT AS n FROM tp",
    "src_metadata": cte("seed_pages") + " SELECT document_id, CAST(max(page) AS BIGINT) AS total_pages, document_id || '.pdf' AS filename, coalesce(max('Manual ' || document_id) FILTER (ord % 50 = 0), '') AS title, coalesce(max('A. Writer') FILTER (ord % 100 = 0), '') AS author, '' AS subject, '' AS creator FROM seed_pages GROUP BY document_id",
    "src_stream_reply": cte("seed_sse") + ", a AS (SELECT doc_id, list_transform(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, 'data: ')), lambda x: substr(x, 7)) AS l FROM seed_sse), b AS (SELECT doc_id, CASE WHEN list_position(l, '[DONE]') > 0 THEN l[1:list_position(l, '[DONE]') - 1] ELSE l END AS l FROM a) SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN json_valid(x) THEN coalesce(json_extract_string(x, '$.choices[0].delta.content'), '') ELSE '' END), '') AS reply FROM b",
}
ORACLES["src_files"] = "WITH p AS (SELECT CAST(page_id // 50 AS VARCHAR) AS document, CAST(page_id % 50 AS INT) AS page, url, html FROM pages), r AS (SELECT document, page, 'structure' AS kind, 0 AS k, coalesce(url, '') AS content FROM p UNION ALL SELECT document, page, 'text', 1, coalesce(html, '') FROM p) SELECT document, CAST(row_number() OVER (PARTITION BY document ORDER BY k, page) - 1 AS INT) AS ordinal, kind, page, md5(content) AS content_md5, CAST(NULL AS VARCHAR) AS error FROM r"
