"""Queries of documents, reports and the whole review."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import language as L
from quire.operators import report as R
from quire.operators import state as S
from quire.operators import triage as T
from quire.plans import review as P
from quire.queries import chunking as CQ
from quire.queries import crossref as XQ
from quire.queries import language as LQ
from quire.queries import sources as SQ
from quire.queries import tables as TQ
from quire.sources import extract as E
from quire.sources.seed import SEEDS, cte, frame


def _chunks(spark, d):
    c = frame(spark, d, "seed_chunks")
    section = F.when(F.col("ord") % 6 == 0, "").when(F.col("ord") % 6 == 1, F.concat(F.lit("Figure "), (F.col("ord") % 3).cast("string"))).when(F.col("ord") % 6 == 2, "ab").otherwise(F.col("section_hierarchy"))
    return c.withColumns({"section_hierarchy": section, "reviewed_content": F.when(F.col("ord") % 4 == 0, "").when(F.col("ord") % 4 == 1, F.concat(F.lit("reviewed "), "chunk_id"))})


def doc_assemble(spark, d):
    return R.assemble(_chunks(spark, d)).select("document_id", F.md5("body").alias("body_md5"), F.length("body").alias("n"))


def doc_contents(spark, d):
    return R.contents(_chunks(spark, d))


def doc_contents_text(spark, d):
    return R.contents_text(R.contents(_chunks(spark, d)))


def crossref_report_text(spark, d):
    return R.reference_report(XQ.validated(spark, d))


def crossref_rates(spark, d):
    return R.reference_rates(XQ.validated(spark, d))


def changes_by_type(spark, d):
    latest = S.latest_reviews(frame(spark, d, "seed_reviews")).filter("status <> 'pending'")
    return R.changes_by_type(frame(spark, d, "seed_changes"), latest)


def unique_examples(spark, d):
    return R.unique_examples(frame(spark, d, "seed_changes"))


def grammar_split(spark, d):
    return R.grammar_split(frame(spark, d, "seed_changes"))


def issues_by_severity(spark, d):
    return R.issues_by_severity(frame(spark, d, "seed_changes"))


def savings(spark, d):
    docs = S.document_records(frame(spark, d, "seed_chunks")).select("document_id", "total_pages", (F.col("total_chunks") * F.lit(1.5)).alias("seconds"))
    s = R.savings(docs)
    return s.select("document_id", "total_pages", F.round("manual_minutes", 4).alias("manual_minutes"), F.round("saved_minutes", 4).alias("saved_minutes"), F.round("efficiency_pct", 4).alias("efficiency_pct"))


def doc_output(spark, d):
    """Whole documents: header, contents, text and reference report."""
    meta = E.document_metadata(frame(spark, d, "seed_pages")).withColumn("review_date", F.lit("2024-01-01 00:00:00"))
    out = R.document(_chunks(spark, d), meta, XQ.validated(spark, d))
    return out.select("document_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def review_output(spark, d):
    """Rows only: documents out of the whole review, texts marked up by the standard library's differ where changes are many."""
    meta = E.document_metadata(frame(spark, d, "seed_pages")).withColumn("review_date", F.lit("2024-01-01 00:00:00"))
    return P.documents_of(review_result(spark, d), meta).select("document_id", F.length("text").alias("n"))


def review_gated(spark, d):
    """Chunks whose text a model's reply replaced, by document: replies to every chunk that was not split."""
    c = frame(spark, d, "seed_llm")
    replies = c.select("document_id", "chunk_id", T.parse_reply(F.col("reply")).alias("p")).select("document_id", "chunk_id", "p.content", "p.confidence")
    text = _corpus(spark, d).filter("chunk_type = 'text'")
    g = P.review_chunks(text, replies=replies)
    accepted = F.col("accepted")
    return g.groupBy("document_id").agg(F.count_if("asked").alias("asked"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & F.col("reviewed_content").startswith("fixed")).alias("fixed"))


def review_changes(spark, d):
    """Changes of reviewed chunks by reported type."""
    reviewed = L.review(frame(spark, d, "seed_chunks"))
    return R.latest_changes(reviewed).groupBy("document_id", "type").agg(F.count("*").alias("n"))


def review_sections(spark, d):
    """Rows only: the change summary's sections (a unit test has their text)."""
    return R.change_sections(R.latest_changes(L.review(frame(spark, d, "seed_chunks"))))


def change_header(spark, d):
    """The head of each document's change summary, from its chunks and recorded changes."""
    changes = frame(spark, d, "seed_changes").groupBy("document_id").agg(F.count("*").alias("total_changes"))
    pages = frame(spark, d, "seed_chunks").groupBy("document_id").agg(F.max("page_start").cast("long").alias("total_pages"), F.count("*").alias("completed"))
    figures = {"filename": F.when(F.col("total_pages") % 3 > 0, F.concat("document_id", F.lit(".pdf"))), "seconds": F.col("completed") * 17.3 + 0.13, "avg_confidence": 0.8 + F.col("completed") % 10 * 0.011}
    return R.change_header(pages.join(changes, "document_id", "left").withColumns(figures), F.lit("2024-01-31 12:00:00"))


def _corpus(spark, d):
    """Text, table and figure chunks with the columns of the review plan."""
    text = frame(spark, d, "seed_chunks").select("document_id", "chunk_id", "page_start", "section_hierarchy", "chunk_type", "content")
    keep = [*text.columns, "rows", "caption", "image_size", "image_index"]
    number = F.expr("try_cast(substr(document_id, 7) AS int)") % 10  # of the brand, as in seed_cells
    tables = E.table_chunks(SQ.all_tables(spark, d)).withColumn("document_id", F.concat(F.lit("doc"), number.cast("string")))
    figures = E.figure_chunks(frame(spark, d, "seed_figures"))
    parts = [text, tables, figures]
    kinds = {"rows": "int", "caption": "string", "image_size": "bigint", "image_index": "int"}
    full = [p.select(*[p[c] if c in p.columns else F.lit(None).cast(kinds[c]).alias(c) for c in keep]) for p in parts]
    return full[0].unionByName(full[1]).unionByName(full[2])


def review_result(spark, d):
    return P.review(_corpus(spark, d), XQ.toc_targets(spark, d))


def review_documents(spark, d):
    """The whole review, by document."""
    return review_result(spark, d).documents


def review_broken_sections(spark, d):
    """Flagship: which sections have broken references, by type, with their share of valid ones."""
    return P.broken_by_section(review_result(spark, d))


def summary_text(spark, d):
    docs = review_result(spark, d).documents
    return R.summary_text(docs.withColumns({"filename": F.concat("document_id", F.lit(".pdf")), "completed": F.col("total_chunks")}))


QUERIES = {f.__name__: f for f in (doc_assemble, doc_contents, doc_contents_text, crossref_report_text, crossref_rates, changes_by_type, unique_examples, grammar_split, issues_by_severity, savings, review_documents, review_broken_sections, summary_text, doc_output, review_output, review_gated, review_changes, review_sections, change_header)}

_CK = ", ck AS (SELECT document_id, chunk_id, page_start, content, CASE ord % 6 WHEN 0 THEN '' WHEN 1 THEN 'Figure ' || (ord % 3) WHEN 2 THEN 'ab' ELSE section_hierarchy END AS section, CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN 'reviewed ' || chunk_id END AS reviewed FROM seed_chunks)"
_C = cte("seed_chunks") + _CK
_NL = "chr(10)"
_FT = r", ft AS (SELECT document_id, section, min({p: page_start, c: chunk_id}) AS pos FROM ck WHERE length(section) >= 3 AND NOT regexp_matches(section, '^Figure\s+\d+$|^Table\s+\d+$|^Unknown Section$|^\[Figure\s+\d+\]$|^\[Table\s+\d+\]$') GROUP BY ALL), toc AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY pos) AS INT) AS place, section, replace(replace(lower(section), ' ', '-'), '.', '') AS anchor FROM ft)"
_TOC = _C + _FT
_BODY = f", lg AS (SELECT *, last_value(nullif(section, '') IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ck), bd AS (SELECT document_id, string_agg(CASE WHEN section <> '' AND section IS DISTINCT FROM prev THEN {_NL} || '## ' || section || {_NL} ELSE '' END || '<!-- Page ' || page_start || ' -->' || {_NL} || coalesce(nullif(reviewed, ''), content) || {_NL} || {_NL}, '' ORDER BY page_start, chunk_id) AS body FROM lg GROUP BY document_id)"
_REFS = f", ty AS (SELECT document_id, string_agg('| ' || reference_type || ' | ' || n || ' | ' || v || ' | ' || (n - v) || ' |', {_NL} ORDER BY reference_type) AS types FROM (SELECT document_id, reference_type, count(*) AS n, count(*) FILTER (is_valid) AS v FROM checked GROUP BY ALL) q GROUP BY document_id), tt AS (SELECT document_id, count(*) AS n, count(*) FILTER (is_valid) AS v, string_agg('| ' || reference_text || ' | ' || reference_type || ' | ' || target_number || ' | ' || page_number || ' | ' || chunk_id || ' |', {_NL} ORDER BY page_number, chunk_id, pattern_no, position) FILTER (NOT is_valid) AS bad FROM checked GROUP BY document_id)"
_REPORT = f"'# Cross-Reference Validation Report' || {_NL} || {_NL} || '**Total References:** ' || n || '  ' || {_NL} || '**Valid:** ' || v || '  ' || {_NL} || '**Invalid:** ' || (n - v) || '  ' || {_NL} || {_NL} || CASE WHEN bad IS NOT NULL THEN '## Broken References' || {_NL} || {_NL} || '| Reference | Type | Target | Page | Chunk ID |' || {_NL} || '|-----------|------|--------|------|----------|' || {_NL} || bad || {_NL} ELSE '' END || {_NL} || '## References by Type' || {_NL} || {_NL} || '| Type | Total | Valid | Invalid |' || {_NL} || '|------|-------|-------|---------|' || {_NL} || types || {_NL}"
ORACLES = {
    "doc_assemble": _C + _BODY + " SELECT document_id, md5(body) AS body_md5, CAST(length(body) AS INT) AS n FROM bd",
    "doc_contents": _TOC + " SELECT * FROM toc",
    "doc_contents_text": _TOC + f" SELECT document_id, '## Table of Contents' || {_NL} || {_NL} || string_agg('- [' || section || '](#' || anchor || ')', {_NL} ORDER BY place) || {_NL} AS toc FROM toc GROUP BY document_id",
    "crossref_report_text": XQ._ALL + _REFS + f" SELECT document_id, {_REPORT} AS report FROM tt JOIN ty USING (document_id)",
    "crossref_rates": XQ._ALL + ", g AS (SELECT document_id, count(*) AS total, count(*) FILTER (is_valid) AS valid FROM checked GROUP BY document_id) SELECT document_id, total, valid, total - valid AS invalid, round(valid / total * 100, 1) AS valid_pct, CASE WHEN total - valid > 100 THEN 'High number of invalid references detected - recommend manual verification' WHEN total - valid > 0 THEN 'Some invalid references found - spot check recommended' END AS recommendation FROM g",
    "changes_by_type": cte("seed_changes", "seed_reviews") + ", lr AS (SELECT * FROM seed_reviews QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, review_id DESC) = 1) SELECT CASE WHEN type IN ('table_issue', 'figure_issue') THEN 'table_issues' ELSE type END AS type, count(*) AS n FROM seed_changes WHERE type IN ('table_issue', 'figure_issue', 'spelling', 'grammar', 'style') AND chunk_id IN (SELECT chunk_id FROM lr WHERE status <> 'pending') GROUP BY ALL",
    "unique_examples": cte("seed_changes") + ", f AS (SELECT type, original, corrected, min(ord) AS o FROM seed_changes GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY type ORDER BY o) AS INT) AS place FROM f) SELECT type, place, original, corrected FROM r WHERE place <= 5",
    "grammar_split": cte("seed_changes") + ", g AS (SELECT lower(coalesce(reason, '')) AS r FROM seed_changes WHERE type = 'grammar') SELECT count(*) AS total, count(*) FILTER (contains(r, 'space')) AS whitespace, count(*) FILTER (contains(r, 'punctuation')) AS punctuation, count(*) FILTER (NOT contains(r, 'space') AND NOT contains(r, 'punctuation')) AS other FROM g",
    "issues_by_severity": cte("seed_changes") + f", i AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY ord) AS p FROM seed_changes WHERE type IN ('table_issue', 'figure_issue')) SELECT severity, count(*) AS n, coalesce(string_agg('  - ' || coalesce(reason, 'Unknown issue'), {_NL} ORDER BY p) FILTER (severity = 'high' AND p <= 3), '') AS examples FROM i GROUP BY severity",
    "savings": cte("seed_chunks") + ", r AS (SELECT document_id, CAST(max(page_start) AS BIGINT) AS total_pages, count(*) * CAST(1.5 AS DOUBLE) AS seconds FROM seed_chunks GROUP BY document_id) SELECT document_id, total_pages, CAST(total_pages * 5 AS DOUBLE) AS manual_minutes, round(total_pages * 5 - seconds / 60, 4) AS saved_minutes, round((total_pages * 5 - seconds / 60) / (total_pages * 5) * 100, 4) AS efficiency_pct FROM r",
}

#: The whole review in SQL: pieces of texts, their changes and confidence, tables and figures with their issues, and references.
_PIECES = CQ.ORACLES["chunk_fixed"].split("WITH ", 1)[1].split(", f AS (", 1)[1].split(" SELECT document_id, chunk_id || '_sub_'")[0]
_PC = f""", pc AS (WITH f AS ({_PIECES} SELECT s.document_id, s.chunk_id || '_sub_' || e.i AS chunk_id, s.page_start, s.section_hierarchy AS section, e.content FROM e JOIN seed_chunks s USING (document_id, chunk_id)
UNION ALL SELECT document_id, chunk_id, page_start, section_hierarchy, content FROM seed_chunks WHERE length(content) <= 1500)"""
_over = lambda sql: sql.replace("FROM seed_chunks", "FROM pc")
_LANG = ", lang AS (WITH" + _over(LQ._STEPS + LQ._SC + LQ._REST + LQ._COUNTED).removeprefix(",") + " SELECT chunk_id, coalesce(n, 0) AS n_changes, CASE WHEN n IS NULL THEN 1.0 ELSE round(round(CASE WHEN n > 20 THEN a * 0.85 WHEN n > 10 THEN a * 0.92 ELSE a END, 9), 2) END AS confidence FROM g3 LEFT JOIN n USING (chunk_id))"
_CHECKED = TQ._TBL.split(", tr AS", 1)[1]
_CHECKED = _CHECKED[: _CHECKED.index("b AS (SELECT document_id, nrows, CASE")] + "b AS (SELECT document_id, nrows, content FROM f),\nl AS" + _CHECKED.split("\nl AS", 1)[1]
_ISSUES = "LEFT JOIN (SELECT {0}, count(*) AS n, count(*) FILTER (severity = 'high') AS high FROM iss GROUP BY {0}) i USING ({0})".format
_CONF = "coalesce(i.n, 0) AS n_issues, greatest(0.5, 1.0 - CAST(0.2 AS DOUBLE) * coalesce(i.high, 0)) AS confidence"
_TABS = f""", tabs AS (WITH tr AS{_CHECKED} SELECT 'doc' || (CAST(substr(c.document_id, 7) AS INT) % 10) AS document_id, 'tab ' || f.document_id AS chunk_id, c.page AS page_start, 'Table ' || (c.table_index + 1) AS section, f.content, {_CONF}
FROM f JOIN c ON f.document_id = c.document_id || '/' || c.table_index {_ISSUES('document_id').replace('USING (document_id)', 'ON i.document_id = f.document_id')})"""
_FIGURES = TQ._FIG.split(", x AS", 1)[1]
_FIGURES = _FIGURES[: _FIGURES.index(", b AS (SELECT xref")] + ", b AS (SELECT xref, caption, image_size, image_index, content FROM z)" + _FIGURES[_FIGURES.index(",\niss AS") :]
_FIGS = f", figs AS (WITH x AS{_FIGURES} SELECT z.document_id, 'fig ' || xref AS chunk_id, z.page AS page_start, 'Figure ' || (image_index + 1) AS section, z.content, {_CONF} FROM z {_ISSUES('xref')})"
_ALLC = ", allc AS (SELECT document_id, chunk_id, page_start, section, content FROM pc UNION ALL SELECT document_id, chunk_id, page_start, section, content FROM tabs UNION ALL SELECT document_id, chunk_id, page_start, section, content FROM figs)"
_FOUND = "\nUNION ".join(f"SELECT document_id, '{t}' AS ref_type, unnest(regexp_extract_all(content, '{p}', 1)) AS target FROM {c}" for t, c in (("figure", "figs"), ("table", "tabs")) for p in XQ.X.TARGETS[t])
_SECTIONS = XQ._TARGETS_CTE.split("UNION SELECT DISTINCT document_id, 'section'", 1)[1][:-1]
_CHECK = XQ._REFS_CTE.replace("FROM seed_chunks", "FROM allc") + f", targets AS ({_FOUND} UNION SELECT DISTINCT document_id, 'section'{_SECTIONS})" + XQ._VALID_CTE.removeprefix(XQ._TARGETS_CTE)
_REVIEW = cte("seed_chunks", "seed_cells", "seed_figures", "seed_outline") + _PC + _TABS + _FIGS + _ALLC + _CHECK
_DOCS = _LANG + """, every AS (SELECT document_id, page_start, confidence, n_changes, 0 AS n_issues FROM pc JOIN lang USING (chunk_id) UNION ALL SELECT document_id, page_start, confidence, 0, n_issues FROM tabs UNION ALL SELECT document_id, page_start, confidence, 0, n_issues FROM figs),
rf AS (SELECT document_id, count(*) AS n_refs, count(*) FILTER (is_valid) AS n_valid FROM checked GROUP BY document_id),
docs AS (SELECT document_id, CAST(max(page_start) AS BIGINT) AS total_pages, count(*) AS total_chunks, round(CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100), 4) AS avg_confidence, CAST(sum(n_changes) AS BIGINT) AS n_changes, CAST(sum(n_issues) AS BIGINT) AS n_issues FROM every GROUP BY document_id),
dr AS (SELECT docs.*, coalesce(n_refs, 0) AS n_refs, coalesce(n_valid, 0) AS n_valid FROM docs LEFT JOIN rf USING (document_id))"""
_META = ", mt AS (SELECT document_id, max(page) AS pages FROM seed_pages GROUP BY document_id)"
_HEADER = f"CASE WHEN mt.document_id IS NULL THEN '' ELSE '# ' || {_NL} || {_NL} || '**Source:** ' || mt.document_id || '.pdf' || {_NL} || '**Review Date:** 2024-01-01 00:00:00' || {_NL} || '**Total Pages:** ' || pages || {_NL} || {_NL} || '---' || {_NL} || {_NL} END"
_CONTENTS = f"(SELECT document_id, '## Table of Contents' || {_NL} || {_NL} || string_agg('- [' || section || '](#' || anchor || ')', {_NL} ORDER BY place) || {_NL} AS toc FROM toc GROUP BY document_id)"
_WORDS = f"'# Review Summary Report' || {_NL} || {_NL} || '## Document Information' || {_NL} || {_NL}"
_LINE = lambda name, x: f" || '**{name}:** ' || {x} || '  ' || {_NL}"
_TITLE = lambda name: f" || {_NL} || '## {name}' || {_NL} || {_NL}"
ORACLES |= {
    "review_documents": _REVIEW + _DOCS + " SELECT * FROM dr",
    "review_broken_sections": _REVIEW + " SELECT document_id, section, reference_type, count(*) AS total, count(*) FILTER (NOT is_valid) AS broken, round(count(*) FILTER (is_valid) / count(*) * 100, 2) AS valid_pct FROM checked JOIN allc USING (document_id, chunk_id) GROUP BY ALL",
    "summary_text": _REVIEW + _DOCS + " SELECT document_id, " + _WORDS + _LINE("Filename", "document_id || '.pdf'") + _LINE("Total Pages", "total_pages") + _LINE("Total Chunks", "total_chunks") + _TITLE("Processing Statistics") + _LINE("Completed", "total_chunks") + _LINE("Average Confidence", "printf('%.2f', avg_confidence)") + _TITLE("Language Review") + _LINE("Total Changes", "n_changes") + _TITLE("Cross-Reference Validation") + _LINE("Total References", "n_refs") + _LINE("Valid", "n_valid") + " AS summary FROM dr",
    "doc_output": XQ._ALL.replace("WITH ", f"WITH seed_pages AS ({SEEDS['seed_pages']}),\n", 1) + _CK + _BODY + _FT + _REFS + _META + f", tx AS (SELECT bd.document_id, {_HEADER} || coalesce(t.toc || {_NL} || '---' || {_NL}, '') || body || coalesce({_NL} || '---' || {_NL} || rp.report, '') AS text FROM bd LEFT JOIN mt USING (document_id) LEFT JOIN {_CONTENTS} t USING (document_id) LEFT JOIN (SELECT document_id, {_REPORT} AS report FROM tt JOIN ty USING (document_id)) rp USING (document_id)) SELECT document_id, md5(text) AS text_md5, CAST(length(text) AS INT) AS n FROM tx",
    "review_gated": cte("seed_chunks", "seed_llm") + LQ._STEPS + LQ._SC + LQ._REST + LQ._COUNTED + ", cf AS (SELECT chunk_id, CASE WHEN n IS NULL THEN 1.0 ELSE round(round(CASE WHEN n > 20 THEN a * 0.85 WHEN n > 10 THEN a * 0.92 ELSE a END, 9), 2) END AS c FROM g3 LEFT JOIN n USING (chunk_id)), rp AS (SELECT document_id, chunk_id, doc_id % 4 AS kind, CASE doc_id % 4 WHEN 0 THEN CAST('0.9' || (doc_id % 10) AS DOUBLE) WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 ELSE 0.5 END AS r FROM seed_llm), gt AS (SELECT document_id, c < 0.95 AS asked, c < 0.95 AND r > c + CAST(0.05 AS DOUBLE) AS accepted, kind FROM cf JOIN rp USING (chunk_id)) SELECT document_id, count(*) FILTER (asked) AS asked, count(*) FILTER (accepted) AS accepted, count(*) FILTER (accepted AND kind = 0) AS fixed FROM gt GROUP BY document_id",
    "review_changes": LQ._FULL + " SELECT document_id, type, count(*) AS n FROM (SELECT chunk_id, 'spelling' AS type FROM sc UNION ALL SELECT chunk_id, type FROM oc) x JOIN seed_chunks USING (chunk_id) GROUP BY ALL",
}
_FIGURES = "SELECT document_id, CASE WHEN total_pages % 3 > 0 THEN document_id || '.pdf' ELSE 'N/A' END AS filename, coalesce(total_changes, 0) AS total_changes, total_pages, completed, completed * 17.3::DOUBLE + 0.13::DOUBLE AS seconds, 0.8::DOUBLE + completed % 10 * 0.011::DOUBLE AS avg_confidence FROM (SELECT document_id, CAST(max(page_start) AS BIGINT) AS total_pages, count(*) AS completed FROM seed_chunks GROUP BY document_id) LEFT JOIN (SELECT document_id, count(*) AS total_changes FROM seed_changes GROUP BY document_id) USING (document_id)"
ORACLES["change_header"] = cte("seed_chunks", "seed_changes") + f", f AS ({_FIGURES}) SELECT document_id, replace('# Review Changes Summary~~**Document:** ' || filename || '~**Generated:** 2024-01-31 12:00:00~**Total Changes:** ' || format('{{:,}}', total_changes) || '~~---~~## Processing Summary~~**Pages Processed:** ' || format('{{:,}}', total_pages) || '~**Chunks Processed:** ' || format('{{:,}}', completed) || '~**Total Time:** ' || format('{{:.1f}}', seconds) || ' seconds (' || format('{{:.1f}}', seconds / 60) || ' minutes)~**Processing Speed:** ' || format('{{:.1f}}', total_pages / seconds) || ' pages/second~**Average Confidence:** ' || format('{{:.2f}}', avg_confidence) || '~~---~~', '~', chr(10)) AS header FROM f"
