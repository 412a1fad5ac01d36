"""Queries of the language rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import language as L
from quire.queries.sql import WORDS, differs, rows
from quire.sources.seed import cte, frame


def _reviewed(spark, d):
    return L.review(frame(spark, d, "seed_chunks"))


def _one(spark, d, apply):
    text, changes = apply(F.col("content"))
    c = frame(spark, d, "seed_chunks")
    return c.select("chunk_id", F.md5(text).alias("text_md5"), F.size(changes).cast("long").alias("n_changes"))


def spell_fix(spark, d):
    return _one(spark, d, L.spelling)


def grammar_spaces(spark, d):
    return _one(spark, d, L.grammar_spaces)


def grammar_punctuation(spark, d):
    return _one(spark, d, L.grammar_punctuation)


def style_ranges(spark, d):
    return _one(spark, d, L.style_ranges)


def spell_changes(spark, d):
    return L.change_rows(_reviewed(spark, d)).filter("type = 'spelling'").select("chunk_id", "ordinal", "original", "corrected", "position", "reason")


def language_changes(spark, d):
    rows = L.change_rows(_reviewed(spark, d)).filter("type <> 'spelling'")
    first = F.min("ordinal").over(L_window())
    return rows.withColumn("ordinal", F.col("ordinal") - first).select("chunk_id", "ordinal", "type", "original", "corrected", "position", "confidence", "reason")


def L_window():
    from pyspark.sql.window import Window

    return Window.partitionBy("chunk_id")


def language_confidence(spark, d):
    return _reviewed(spark, d).select("chunk_id", F.size("changes").cast("long").alias("n_changes"), "confidence", F.md5("reviewed_content").alias("text_md5"))


def change_counts(spark, d):
    return L.change_counts(_reviewed(spark, d))


def change_defaults(spark, d):
    c = frame(spark, d, "seed_changes").select("ord", F.nullif("type", F.lit("figure_issue")).alias("type"), "original", "corrected", "confidence", "reason")
    return L.normalised(c)


def inline_markup(spark, d):
    # As generated columns: a filter on plain ones would be moved before the passes, with all of them inside its condition.
    each = F.inline_outer(F.array(F.struct("content", "reviewed_content", "changes")))
    r = _reviewed(spark, d).select("chunk_id", each).filter(F.size("changes") < 10)
    return r.select("chunk_id", L.inline_markup(F.col("content"), F.col("reviewed_content"), F.col("changes")).alias("markup"))


def word_markup(spark, d):
    return L.markup(_reviewed(spark, d)).select("chunk_id", "markup")


QUERIES = {f.__name__: f for f in (spell_fix, grammar_spaces, grammar_punctuation, style_ranges, spell_changes, language_changes, language_confidence, change_counts, change_defaults, word_markup)}


def _keep(x: str, typo: str, fix: str) -> str:
    rest = f"(?i:{typo[1:]})"
    for pattern, new in ((typo.upper(), fix.upper()), (typo[0].upper() + rest, fix.capitalize()), (typo[0] + rest, fix)):
        x = f"regexp_replace({x}, '\\b{pattern}\\b', '{new}', 'g')"
    return x


_T = list(L.TYPOS.items())
_STEPS = ", s0 AS (SELECT chunk_id, content AS t FROM seed_chunks)" + "".join(f", s{i + 1} AS (SELECT chunk_id, {_keep('t', a, b)} AS t FROM s{i})" for i, (a, b) in enumerate(_T))
_SPELL = "\nUNION ALL ".join(f"SELECT chunk_id, {i} AS k, '{a}' AS typo, '{b}' AS fix, unnest({rows('t', rf'(?i:\b{a}\b)')}) AS m FROM s{i}" for i, (a, b) in enumerate(_T))
_FIXED = "CASE WHEN m.t = upper(m.t) THEN upper(fix) WHEN left(m.t, 1) = upper(left(m.t, 1)) THEN upper(left(fix, 1)) || substr(fix, 2) ELSE fix END"
_SC = f", sc AS (SELECT chunk_id, k, m.p AS p, m.t AS original, {_FIXED} AS corrected FROM ({_SPELL}) x)"
_N = len(_T)
_REST = (
    f", g1 AS (SELECT chunk_id, regexp_replace(t, '  +', ' ', 'g') AS t FROM s{_N}), g2 AS (SELECT chunk_id, regexp_replace(t, '([.!?,;:])([A-Z])', '\\1 \\2', 'g') AS t FROM g1), g3 AS (SELECT chunk_id, regexp_replace(t, '(\\d+)[ \\t]+-[ \\t]+(\\d+)', '\\1-\\2', 'g') AS t FROM g2)"
    f", oc AS (SELECT chunk_id, 0 AS k, 'grammar' AS type, unnest({rows(f't', '  +')}) AS m, 1.0 AS confidence, 'Multiple spaces replaced with single space' AS reason FROM s{_N}"
    f" UNION ALL SELECT chunk_id, 1, 'grammar', unnest({rows('t', '[.!?,;:][A-Z]')}), 0.9, 'Missing space after punctuation' FROM g1"
    f" UNION ALL SELECT chunk_id, 2, 'style', unnest({rows('t', chr(92) + 'd+[ ' + chr(92) + 't]+-[ ' + chr(92) + 't]+' + chr(92) + 'd+')}), 0.85, 'Standardized number range formatting' FROM g2)"
)
_CORRECTED = "CASE k WHEN 0 THEN ' ' WHEN 1 THEN left(m.t, 1) || ' ' || right(m.t, 1) ELSE regexp_replace(m.t, '[ \\t]', '', 'g') END"
_BASE = cte("seed_chunks") + _STEPS
_FULL = _BASE + _SC + _REST
_COUNTED = ", v AS (SELECT chunk_id, 0.95 AS c FROM sc UNION ALL SELECT chunk_id, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.92 ELSE 0.85 END FROM oc), n AS (SELECT chunk_id, count(*) AS n, avg(CAST(c AS DOUBLE)) AS a FROM v GROUP BY chunk_id)"


def _single(text: str, pattern: str) -> str:
    return cte("seed_chunks") + f" SELECT chunk_id, md5({text}) AS text_md5, len(regexp_extract_all(content, '{pattern}')) AS n_changes FROM seed_chunks"


ORACLES = {
    "spell_fix": _BASE + _SC + f" SELECT chunk_id, md5(t) AS text_md5, (SELECT count(*) FROM sc WHERE sc.chunk_id = s{_N}.chunk_id) AS n_changes FROM s{_N}",
    "grammar_spaces": _single("regexp_replace(content, '  +', ' ', 'g')", "  +"),
    "grammar_punctuation": _single(r"regexp_replace(content, '([.!?,;:])([A-Z])', '\1 \2', 'g')", "[.!?,;:][A-Z]"),
    "style_ranges": _single(r"regexp_replace(content, '(\d+)[ \t]+-[ \t]+(\d+)', '\1-\2', 'g')", r"\d+[ \t]+-[ \t]+\d+"),
    "spell_changes": _BASE + _SC + " SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY k, p DESC) - 1 AS INT) AS ordinal, original, corrected, CAST(p AS INT) AS position, 'Common typo: ''' || original || ''' → ''' || corrected || '''' AS reason FROM sc",
    "language_changes": _FULL + " SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY k, m.p DESC) - 1 AS INT) AS ordinal, type, m.t AS original, " + _CORRECTED + " AS corrected, CAST(m.p AS INT) AS position, CAST(confidence AS DOUBLE) AS confidence, reason FROM oc",
    "language_confidence": _FULL + _COUNTED + " SELECT chunk_id, coalesce(n, 0) AS n_changes, CASE WHEN n IS NULL THEN 1.0 ELSE round(round(CASE WHEN n > 20 THEN a * 0.85 WHEN n > 10 THEN a * 0.92 ELSE a END, 9), 2) END AS confidence, md5(t) AS text_md5 FROM g3 LEFT JOIN n USING (chunk_id)",
    "inline_markup": _FULL + f", ch AS (SELECT chunk_id, 0 AS a, k, m_p AS p, original AS o, corrected AS n FROM (SELECT *, p AS m_p FROM sc) y UNION ALL SELECT chunk_id, 1, k, m.p, m.t, {_CORRECTED} FROM oc), li AS (SELECT chunk_id, list({{'t': '', 'o': o, 'n': n, 'p': CAST(p AS BIGINT)}} ORDER BY p DESC, a, k) AS l FROM ch GROUP BY chunk_id HAVING count(*) < 10), ct AS (SELECT chunk_id, count(*) AS n FROM ch GROUP BY chunk_id)"
    " SELECT chunk_id, CASE WHEN content = t THEN t ELSE list_reduce(l, lambda x, c: {'t': CASE WHEN contains(substr(x.t, greatest(c.p - 10, 0) + 1), c.o) THEN left(x.t, greatest(c.p - 10, 0) + strpos(substr(x.t, greatest(c.p - 10, 0) + 1), c.o) - 1) || '~~' || c.o || '~~ <span style=\"color:red\">' || c.n || '</span>' || substr(x.t, greatest(c.p - 10, 0) + strpos(substr(x.t, greatest(c.p - 10, 0) + 1), c.o) + length(c.o)) ELSE x.t END, 'o': '', 'n': '', 'p': CAST(0 AS BIGINT)}, {'t': content, 'o': '', 'n': '', 'p': CAST(0 AS BIGINT)}).t END AS markup FROM seed_chunks JOIN g3 USING (chunk_id) LEFT JOIN li USING (chunk_id) LEFT JOIN ct USING (chunk_id) WHERE coalesce(ct.n, 0) < 10",
    "change_counts": _FULL + " SELECT type, count(*) AS n FROM (SELECT 'spelling' AS type FROM sc UNION ALL SELECT type FROM oc) x GROUP BY type",
    "change_defaults": cte("seed_changes") + " SELECT ord, coalesce(nullif(type, 'figure_issue'), 'unknown') AS type, coalesce(original, '') AS original, coalesce(corrected, '') AS corrected, coalesce(confidence, 0.8) AS confidence, coalesce(reason, '') AS reason, 0 AS position FROM seed_changes",
}
_PIECE = "array_to_string(list_filter([CASE WHEN x.ie > x.i THEN '~~' || array_to_string(a[x.i + 1:x.ie], ' ') || '~~' END, CASE WHEN x.je > x.j THEN '<span style=\"color:red\">' || array_to_string(b[x.j + 1:x.je], ' ') || '</span>' END, CASE WHEN x.n > 0 THEN array_to_string(a[x.ie + 1:x.ie + x.n], ' ') END], lambda t: t IS NOT NULL), ' ')"
_INLINE = ORACLES["inline_markup"]
_AT = _INLINE.rindex(" SELECT chunk_id, CASE WHEN content = t")
ORACLES["word_markup"] = (
    _INLINE[:_AT].replace("WITH ", "WITH RECURSIVE ", 1) + f", src AS MATERIALIZED (SELECT chunk_id AS key, {WORDS('content')} AS a, {WORDS('t')} AS b FROM seed_chunks JOIN g3 USING (chunk_id) JOIN ct USING (chunk_id) WHERE ct.n >= 10 AND content <> t), {differs('src', 'w_')}"
    + _INLINE[_AT:] + f" UNION ALL SELECT key, array_to_string(list_filter(list_transform(g, lambda x: {_PIECE}), lambda t: t <> ''), ' ') FROM w_gaps"
    " UNION ALL SELECT chunk_id, t FROM seed_chunks JOIN g3 USING (chunk_id) JOIN ct USING (chunk_id) WHERE ct.n >= 10 AND content = t"
)
QUERIES["inline_markup"] = inline_markup
