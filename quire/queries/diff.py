"""Queries of the version comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import diff as D
from quire.queries import vectors as VQ
from quire.queries.sql import CHARACTERS, WORDS, blocks, differs
from quire.sources.seed import cte, frame


def _aligned(spark, d):
    return D.align_sections(frame(spark, d, "seed_v1"), frame(spark, d, "seed_v2"))


def diff_align(spark, d):
    return _aligned(spark, d).select("document_id", "section", "change_type", "page_v1", "page_v2", F.md5("content_v1").alias("md5_v1"), F.md5("content_v2").alias("md5_v2"))


def diff_numbers(spark, d):
    a = _aligned(spark, d).filter("change_type = 'modified'")
    return a.select("document_id", "section", D.numbers_differ(F.col("content_v1"), F.col("content_v2")).alias("differ"), D.important(F.concat(F.lit("max "), "content_v1"), F.col("content_v2")).alias("important"))


def diff_changes(spark, d):
    return D.changes(_aligned(spark, d))


def diff_categories(spark, d):
    return D.by_significance(D.changes(_aligned(spark, d)))


def diff_changelog(spark, d):
    return D.changelog(D.changes(_aligned(spark, d)), F.lit("v1.pdf → v2.pdf"))


def diff_words(spark, d):
    """Significance and word edits of every aligned section."""
    return D.changes(_aligned(spark, d)).select("document_id", "section", "significance", "details")


def diff_greedy(spark, d):
    """One-to-one matches by meaning; fifty vectors make a document."""
    v = VQ.vectors(spark, d)
    doc = F.concat(F.lit("d"), F.floor(F.col("vec_id") / 50).cast("string")).alias("document_id")
    out = D.align_greedy(v.select(doc, F.col("vec_id").alias("id1"), F.col("e").alias("e1")), v.filter("vec_id % 3 > 0").select(doc, F.col("vec_id").alias("id2"), F.col("a").alias("e2")), 0.4)
    return out.select("document_id", "id1", "id2", F.round("similarity", 6).alias("similarity"))


def diff_compare(spark, d):
    """Counts of the comparison by section."""
    return D.compare(frame(spark, d, "seed_v1"), frame(spark, d, "seed_v2"), F.lit("v1.pdf → v2.pdf"))[1]


def diff_compare_vectors(spark, d):
    """Counts of the comparison by meaning; a chunk has the vector of its number, its second version the blended one."""
    v = VQ.vectors(spark, d)
    n = F.broadcast(v.agg(F.count("*").alias("n_vectors")))
    side = lambda name, c: frame(spark, d, name).join(n).withColumn("_v", F.col("ord") % F.col("n_vectors")).join(v.select(F.col("vec_id").alias("_v"), F.col(c).alias("e")), "_v").drop("_v", "n_vectors")
    return D.compare(side("seed_v1", "a"), side("seed_v2", "e"), F.lit("v1.pdf → v2.pdf"))[1]


QUERIES = {f.__name__: f for f in (diff_compare, diff_compare_vectors, diff_align, diff_numbers, diff_changes, diff_categories, diff_changelog, diff_words, diff_greedy)}
_A = cte("seed_v1", "seed_v2") + """, a1 AS (SELECT * FROM seed_v1 QUALIFY row_number() OVER (PARTITION BY document_id, section_hierarchy ORDER BY ord DESC) = 1), a2 AS (SELECT * FROM seed_v2 QUALIFY row_number() OVER (PARTITION BY document_id, section_hierarchy ORDER BY ord DESC) = 1),
al AS (SELECT coalesce(a1.document_id, a2.document_id) AS document_id, coalesce(a1.section_hierarchy, a2.section_hierarchy) AS section, a1.page_start AS page_v1, a2.page_start AS page_v2, a1.content AS content_v1, a2.content AS content_v2, CASE WHEN a1.content IS NULL THEN 'added' WHEN a2.content IS NULL THEN 'removed' WHEN a1.content <> a2.content THEN 'modified' END AS change_type FROM a1 FULL JOIN a2 ON a1.document_id = a2.document_id AND a1.section_hierarchy = a2.section_hierarchy),
al2 AS (SELECT * FROM al WHERE change_type IS NOT NULL)"""
_NUM = r"list_sort(list_distinct(regexp_extract_all({0}, '\d+\.?\d*'))) <> list_sort(list_distinct(regexp_extract_all({1}, '\d+\.?\d*')))".format
_KEY = "regexp_matches(lower({0} || {1}), 'voltage|current|frequency|temperature|max|min|typical|maximum|minimum')".format
_EDIT = "CASE WHEN x.ie > x.i AND x.je > x.j THEN '''' || array_to_string(a[x.i + 1:x.ie], ' ') || ''' → ''' || array_to_string(b[x.j + 1:x.je], ' ') || '''' WHEN x.ie > x.i THEN 'Removed: ''' || array_to_string(a[x.i + 1:x.ie], ' ') || '''' WHEN x.je > x.j THEN 'Added: ''' || array_to_string(b[x.j + 1:x.je], ' ') || '''' END"


def _changes(aligned: str) -> str:
    """``ch``: the change records of an aligned table."""
    high = f"{_KEY('content_v1', 'content_v2')} AND {_NUM('content_v1', 'content_v2')}"
    return (
        f", kal AS MATERIALIZED (SELECT *, row_number() OVER () AS key, change_type = 'modified' AND {high} AS high FROM {aligned}), wsrc AS MATERIALIZED (SELECT key, {WORDS('content_v1')} AS a, {WORDS('content_v2')} AS b FROM kal WHERE change_type = 'modified'), "
        f"csrc AS MATERIALIZED (SELECT key, {CHARACTERS('content_v1')} AS a, {CHARACTERS('content_v2')} AS b FROM kal WHERE change_type = 'modified' AND NOT high), {differs('wsrc', 'w_')}, {blocks('csrc', 'c_')}, "
        "alike AS (SELECT key, 4 * coalesce(n, 0) < len(a) + len(b) AS below FROM csrc LEFT JOIN (SELECT key, sum(m.n) AS n FROM c_rec GROUP BY key) USING (key)), "
        f"edits AS (SELECT key, array_to_string(list_filter(list_transform(g, lambda x: {_EDIT}), lambda t: t IS NOT NULL)[1:5], '; ') AS words FROM w_gaps), "
        "ch AS (SELECT document_id, section, change_type, coalesce(page_v1, 0) AS page_v1, coalesce(page_v2, 0) AS page_v2, coalesce(left(content_v1, 200), '') AS content_v1, coalesce(left(content_v2, 200), '') AS content_v2, "
        "CASE change_type WHEN 'added' THEN 'medium' WHEN 'removed' THEN 'high' ELSE CASE WHEN high THEN 'high' WHEN below THEN 'medium' ELSE 'low' END END AS significance, CASE change_type WHEN 'added' THEN 'New section added: ' || section WHEN 'removed' THEN 'Section removed: ' || section ELSE words END AS details FROM kal LEFT JOIN alike USING (key) LEFT JOIN edits USING (key))"
    )


def _greedy(pairs: str, lefts: str) -> str:
    """``gr`` (doc, n, id1, c): going through ``lefts`` (doc, n, id1) in order, each with the best pair (doc, id1, id2, s) left, if any."""
    return (
        f", cand AS MATERIALIZED (SELECT l.doc, l.n, l.id1, coalesce(list({{'s': -s, 'id2': id2}} ORDER BY s DESC, id2) FILTER (id2 IS NOT NULL), []) AS c FROM {lefts} l LEFT JOIN {pairs} p ON p.doc = l.doc AND p.id1 = l.id1 GROUP BY ALL), "
        "gr AS (SELECT doc, n, id1, c[1] AS c, CASE WHEN len(c) > 0 THEN [c[1].id2] ELSE [] END AS used FROM cand WHERE n = 1 UNION ALL "
        "SELECT doc, n, id1, b AS c, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.id2) END FROM (SELECT y.doc, y.n, y.id1, g.used, list_filter(y.c, lambda x: NOT list_contains(g.used, x.id2))[1] AS b FROM gr g JOIN cand y ON y.doc = g.doc AND y.n = g.n + 1))"
    )


_CH = _A.replace("WITH ", "WITH RECURSIVE ", 1) + _changes("al2")
_DOC = "'d' || (vec_id // 50)"
_GREEDY = f"WITH RECURSIVE {VQ._V}, one AS (SELECT {_DOC} AS doc, vec_id AS id1, e FROM v), two AS (SELECT {_DOC} AS doc, vec_id AS id2, a FROM v WHERE vec_id % 3 > 0), lefts AS (SELECT doc, id1, row_number() OVER (PARTITION BY doc ORDER BY id1) AS n FROM one WHERE doc IN (SELECT doc FROM two)), pairs AS (SELECT one.doc, id1, id2, {VQ._COS('e', 'a')} AS s FROM one JOIN two ON one.doc = two.doc WHERE {VQ._COS('e', 'a')} >= 0.4)"
_COLS = "document_id, ord, section_hierarchy AS section, page_start AS page, content"
_BY_MEANING = (
    cte("seed_v1", "seed_v2").replace("WITH ", "WITH RECURSIVE ", 1) + f", {VQ._V}, nv AS (SELECT count(*) AS n FROM v), one AS MATERIALIZED (SELECT {_COLS}, a FROM seed_v1, nv JOIN v ON v.vec_id = ord % nv.n), two AS MATERIALIZED (SELECT {_COLS}, e FROM seed_v2, nv JOIN v ON v.vec_id = ord % nv.n), "
    f"lefts AS (SELECT document_id AS doc, ord AS id1, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS n FROM one WHERE document_id IN (SELECT document_id FROM two)), pairs AS (SELECT one.document_id AS doc, one.ord AS id1, two.ord AS id2, {VQ._COS('a', 'e')} AS s FROM one JOIN two ON one.document_id = two.document_id WHERE {VQ._COS('a', 'e')} >= 0.7)"
    + _greedy("pairs", "lefts")
    + ", alv AS (SELECT one.document_id, coalesce(one.section, two.section) AS section, one.page AS page_v1, two.page AS page_v2, one.content AS content_v1, two.content AS content_v2, CASE WHEN two.ord IS NULL THEN 'removed' WHEN one.content <> two.content THEN 'modified' END AS change_type FROM gr JOIN one ON one.document_id = gr.doc AND one.ord = gr.id1 LEFT JOIN two ON two.document_id = gr.doc AND two.ord = gr.c.id2"
    " UNION ALL SELECT document_id, section, NULL, page, NULL, content, 'added' FROM two WHERE document_id IN (SELECT document_id FROM one) AND NOT EXISTS (SELECT 1 FROM gr WHERE gr.doc = two.document_id AND gr.c.id2 = two.ord)), alv2 AS (SELECT * FROM alv WHERE change_type IS NOT NULL)" + _changes("alv2")
)
_COUNTS = " SELECT document_id, count(*) AS total_changes, count(*) FILTER (significance = 'high') AS high_priority, count(*) FILTER (significance = 'medium') AS medium_priority, count(*) FILTER (significance = 'low') AS low_priority FROM ch GROUP BY document_id"
_NL = "chr(10)"
_FULL = f"'### ' || section || ' (Page ' || page_v1 || ' → ' || page_v2 || ')' || {_NL} || {_NL} || '**Type:** ' || upper(change_type) || {_NL} || {_NL} || '**Details:** ' || coalesce(details, '') || {_NL} || {_NL} || CASE WHEN change_type = 'modified' THEN '**Before:** ' || left(content_v1, 100) || '...' || {_NL} || {_NL} || '**After:** ' || left(content_v2, 100) || '...' || {_NL} || {_NL} ELSE '' END || '---' || {_NL}"
ORACLES = {
    "diff_align": _A + " SELECT document_id, section, change_type, page_v1, page_v2, md5(content_v1) AS md5_v1, md5(content_v2) AS md5_v2 FROM al2",
    "diff_numbers": _A + f" SELECT document_id, section, {_NUM('content_v1', 'content_v2')} AS differ, {_NUM(chr(39) + 'max ' + chr(39) + ' || content_v1', 'content_v2')} AS important FROM al2 WHERE change_type = 'modified'",
    "diff_changes": _CH + " SELECT * FROM ch",
    "diff_compare": _CH + _COUNTS,
    "diff_compare_vectors": _BY_MEANING + _COUNTS,
    "diff_words": _CH + " SELECT document_id, section, significance, details FROM ch",
    "diff_greedy": _GREEDY + _greedy("pairs", "lefts") + " SELECT doc AS document_id, id1, c.id2 AS id2, round(-c.s, 6) AS similarity FROM gr UNION ALL SELECT doc, NULL, id2, NULL FROM two WHERE doc IN (SELECT doc FROM one) AND NOT EXISTS (SELECT 1 FROM gr WHERE gr.doc = two.doc AND gr.c.id2 = two.id2)",
    "diff_categories": _CH + " SELECT document_id, significance, count(*) AS n FROM ch GROUP BY ALL",
    "diff_changelog": _CH + f", g AS (SELECT document_id, count(*) AS n, count(*) FILTER (significance = 'high') AS h, count(*) FILTER (significance = 'medium') AS m, count(*) FILTER (significance = 'low') AS l, string_agg({_FULL}, {_NL} ORDER BY section) FILTER (significance = 'high') AS hs, string_agg('- **' || section || '**: ' || coalesce(details, '') || {_NL}, {_NL} ORDER BY section) FILTER (significance = 'medium') AS ms FROM ch GROUP BY document_id) SELECT document_id, '# Document Changelog' || {_NL} || {_NL} || '**Comparison:** v1.pdf → v2.pdf' || {_NL} || '---' || {_NL} || {_NL} || '## Summary' || {_NL} || {_NL} || '- **Total Changes:** ' || n || {_NL} || '- **High Priority:** ' || h || ' ⚠️' || {_NL} || '- **Medium Priority:** ' || m || {_NL} || '- **Low Priority:** ' || l || {_NL} || {_NL} || '---' || {_NL} || CASE WHEN h > 0 THEN {_NL} || '## ⚠️ High Priority Changes' || {_NL} || {_NL} || hs ELSE '' END || CASE WHEN m > 0 THEN {_NL} || '## Medium Priority Changes' || {_NL} || {_NL} || ms ELSE '' END || CASE WHEN l > 0 THEN {_NL} || {_NL} || '## Low Priority Changes' || {_NL} || {_NL} || '*' || l || ' minor changes (rewording, formatting)*' || {_NL} ELSE '' END AS changelog FROM g",
}
