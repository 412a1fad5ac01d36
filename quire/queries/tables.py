"""Queries of the table and figure checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import tables as T
from quire.queries import sources as S
from quire.sources import extract as E
from quire.sources.seed import cte, frame


def _tables(spark, d):
    c = E.table_chunks(S.all_tables(spark, d)).select(F.concat_ws("/", "document_id", "table_index").alias("document_id"), "content", "rows")
    n = F.length("content") % 5
    bent = F.when(n == 0, F.regexp_replace("content", r"\| ---", "| xxx")).when(n == 1, F.regexp_replace("content", "Table", "Tab")).when(n == 2, F.lit("no pipes at all")).when(n == 3, F.substring_index("content", "\n", 4)).otherwise(F.col("content"))
    return c.select("document_id", bent.alias("content"), "rows").withColumn("issues", T.table_issues(F.col("content"), F.col("rows")))


def _figures(spark, d):
    f = E.figure_chunks(frame(spark, d, "seed_figures"))
    bent = F.when(F.col("xref") % 5 == 0, F.replace("content", F.lit("[Figure"), F.lit("[Fig"))).when(F.col("xref") % 5 == 1, F.regexp_replace("content", r"\[Figure \d+\]", "[Figure 99]")).otherwise(F.col("content"))
    f = f.select("xref", bent.alias("content"), "caption", "image_size", "image_index")
    return f.withColumn("issues", T.figure_issues(F.col("content"), F.col("caption"), F.col("image_size"), F.col("image_index")))


def table_issues(spark, d):
    t = _tables(spark, d)
    return T.issue_rows(t.select("document_id", "issues"), F.col("issues")).drop("issues")


def figure_issues(spark, d):
    f = _figures(spark, d)
    return T.issue_rows(f.select("xref", "issues"), F.col("issues")).select("xref", "ordinal", "issue_type", "description", "severity")


def _summary(df, key):
    s = df.select(key, T.summary(F.col("issues")).alias("s"), T.chunk_confidence(F.col("issues")).alias("confidence"))
    types = F.array_join(F.transform(F.array_sort(F.map_entries("s.by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return s.select(key, "confidence", "s.status", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("total_issues", "high", "medium", "low")], types.alias("by_type"))


def table_summary(spark, d):
    return _summary(_tables(spark, d), "document_id")


def figure_summary(spark, d):
    return _summary(_figures(spark, d), "xref")


def table_markdown(spark, d):
    return S.all_tables(spark, d).select("document_id", E.table_markdown(F.col("cells")).alias("markdown"))


QUERIES = {f.__name__: f for f in (table_issues, figure_issues, table_summary, figure_summary, table_markdown)}

_TBL = cte("seed_cells") + S._TABLES + rf""", c AS (SELECT *, {S._TCAP} AS caption, {S._MD} AS md FROM tp WHERE NOT empty),
f AS (SELECT document_id || '/' || table_index AS document_id, len(cells) AS nrows, '[Table ' || (table_index + 1) || ']' || chr(10) || CASE WHEN caption IS NOT NULL THEN 'Caption: ' || caption || chr(10) || chr(10) ELSE '' END || md AS content FROM c),
b AS (SELECT document_id, nrows, CASE length(content) % 5 WHEN 0 THEN regexp_replace(content, '\| ---', '| xxx', 'g') WHEN 1 THEN regexp_replace(content, 'Table', 'Tab', 'g') WHEN 2 THEN 'no pipes at all' WHEN 3 THEN array_to_string(string_split(content, chr(10))[1:4], chr(10)) ELSE content END AS content FROM f),
l AS (SELECT document_id, nrows, content, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '|')) AS ls FROM b),
e AS (SELECT document_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i, len(ls) AS n, ls[1] AS first FROM l),
k AS (SELECT *, length(regexp_replace(regexp_replace(line, '^\|', ''), '\|$', '')) - length(replace(regexp_replace(regexp_replace(line, '^\|', ''), '\|$', ''), '|', '')) + 1 AS cols, length(regexp_replace(regexp_replace(first, '^\|', ''), '\|$', '')) - length(replace(regexp_replace(regexp_replace(first, '^\|', ''), '\|$', ''), '|', '')) + 1 AS want FROM e),
ce AS (SELECT document_id, i, unnest(string_split(line, '|')[2:-2]) AS cell, unnest(range(0, len(string_split(line, '|')) - 2)) AS j FROM e WHERE i >= 2),
iss AS (
SELECT document_id, 0 AS g, 0 AS a, 0 AS bb, 'formatting' AS issue_type, 'No valid table found in content' AS description, NULL AS row, NULL AS col, 'high' AS severity FROM l WHERE len(ls) = 0
UNION ALL SELECT document_id, 1, 0, 0, 'missing_data', 'Table caption is missing', NULL, NULL, 'medium' FROM l WHERE len(ls) > 0 AND NOT regexp_matches(content, '(?:Table|TABLE)\s+\d+[:\.]?\s*(.+)')
UNION ALL SELECT document_id, 2, 0, 0, 'formatting', 'Table has insufficient rows', NULL, NULL, 'high' FROM l WHERE len(ls) BETWEEN 1 AND 2
UNION ALL SELECT document_id, 3, 0, 0, 'formatting', 'Table separator row is malformed', 1, NULL, 'high' FROM l WHERE len(ls) >= 3 AND NOT regexp_matches(ls[2], '^\|\s*[-:]+\s*(\|\s*[-:]+\s*)*\|')
UNION ALL SELECT document_id, 4, i, 0, 'inconsistent_columns', 'Row has ' || cols || ' columns, expected ' || want, i, NULL, 'high' FROM k WHERE n >= 3 AND cols <> want
UNION ALL SELECT document_id, 5, i, j, 'missing_data', 'Empty cell detected', i, j, 'low' FROM ce WHERE trim(cell) = ''
UNION ALL SELECT document_id, 6, i, 0, 'formatting', 'Inconsistent spacing detected', i, NULL, 'low' FROM e WHERE contains(line, '  ')
UNION ALL SELECT document_id, 7, 0, 0, 'inconsistent_columns', 'Row count mismatch: found ' || (len(ls) - 2) || ', expected ' || nrows, NULL, NULL, 'medium' FROM l WHERE len(ls) > 0 AND nrows > 0 AND len(ls) - 2 <> nrows)"""
_FIG = S.ORACLES["src_figures"].rsplit(" SELECT document_id", 1)[0] + r""", b AS (SELECT xref, caption, image_size, image_index, CASE xref % 5 WHEN 0 THEN replace(content, '[Figure', '[Fig') WHEN 1 THEN regexp_replace(content, '\[Figure \d+\]', '[Figure 99]') ELSE content END AS content FROM z),
iss AS (SELECT xref, 0 AS g, 'missing_caption' AS issue_type, 'Figure caption is missing or not detected' AS description, 'high' AS severity FROM b WHERE coalesce(caption, '') = '' AND NOT contains(content, 'Caption:')
UNION ALL SELECT xref, 1, 'low_resolution', 'Figure may be low resolution (small file size)', 'medium' FROM b WHERE image_size < 10000
UNION ALL SELECT xref, 2, 'formatting', 'Figure number not found in expected format', 'medium' FROM b WHERE NOT regexp_matches(content, '\[Figure\s+\d+\]')
UNION ALL SELECT xref, 3, 'formatting', 'Figure numbering inconsistent: content says 99, metadata indicates ' || (image_index + 1), 'medium' FROM b WHERE regexp_matches(content, '\[Figure 99\]'))"""


def _sum(base: str, keys: str, key: str) -> str:
    return (
        base + f", ty AS (SELECT {key}, string_agg(issue_type || '=' || n, ';' ORDER BY issue_type) AS by_type FROM (SELECT {key}, issue_type, count(*) AS n FROM iss GROUP BY ALL) q GROUP BY {key}),"
        f" ag AS (SELECT {key}, count(*) AS n, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM iss GROUP BY {key})"
        f" SELECT a.{key}, greatest(0.5, 1.0 - CAST(0.2 AS DOUBLE) * coalesce(high, 0)) AS confidence, CASE WHEN n IS NULL THEN 'pass' WHEN high > 0 THEN 'fail' ELSE 'warning' END AS status, coalesce(n, 0) AS total_issues, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(by_type, '') AS by_type FROM {keys} a LEFT JOIN ag USING ({key}) LEFT JOIN ty USING ({key})"
    )


ORACLES = {
    "table_issues": _TBL + " SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY g, a, bb) - 1 AS INT) AS ordinal, issue_type, description, CAST(row AS INT) AS row, CAST(col AS INT) AS col, severity FROM iss",
    "figure_issues": _FIG + " SELECT xref, CAST(row_number() OVER (PARTITION BY xref ORDER BY g) - 1 AS INT) AS ordinal, issue_type, description, severity FROM iss",
    "table_summary": _sum(_TBL, "l", "document_id"),
    "figure_summary": _sum(_FIG, "b", "xref"),
    "table_markdown": cte("seed_cells") + S._TABLES + f" SELECT document_id, {S._MD.strip()} AS markdown FROM tp WHERE len(cells) > 1 UNION ALL SELECT document_id, '| ' || array_to_string(list_transform(cells[1], lambda c: coalesce(c, '')), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(cells[1], lambda c: '---'), ' | ') || ' |' FROM tp WHERE len(cells) = 1",
}
