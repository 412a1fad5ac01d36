"""Not-modified revisit resolution for web archive records.

A revisit record says that a URL had not changed since an earlier capture. Each one is joined as of its date to the latest
earlier full response of the same canonical URL; if their validators agree, it takes that response's payload and headers,
brought up to date by the headers that a not-modified answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Headers that describe the stored payload and so are never taken from a not-modified answer.
STORED_ONLY = ["content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type", "transfer-encoding"]
#: Records of a URL are ordered within spans of so many seconds and the last response of each span is carried over to later ones.
SPAN = 3600


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without www., default port, fragment, utm_ parameters, index page or final slash."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"([?&])utm_[^&]*(?=&|$)", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"([?&])&+", "$1"), r"[?&]+$", "")
    head = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0))
    rest = F.substr(u, F.length(head) + 1, F.length(u))
    head = F.regexp_replace(F.regexp_replace(head, r"^https?://(www\.)?", ""), r":(80|443)$", "")
    return F.concat(head, F.regexp_replace(rest, r"(/index\.html?|/)(?=\?|$)", ""))


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """Every row of ``records`` with its resolution.

    records: record_id (long), kind ('response' or 'revisit'; others pass through), url, ts (seconds, long), etag,
    last_modified, headers (map of lower-case names), payload. Adds canonical, status ('full' for responses, 'resolved',
    'mismatch', 'missing' where no earlier response exists, 'other') and refers_to (the response's record_id), replacing
    columns of these names; resolved rows get the response's payload and merged headers. Further columns are kept.

    Earlier means a smaller (ts, record_id), null ids first, and a response before a revisit of the same two; of responses
    alike in these the one with the larger validators counts, and of those alike in validators too the one with the smaller
    hash of payload. Validators: of etag and last_modified, those that both sides have must be equal and at least one must be
    shared. A null url or ts never matches and is missing; repeated and null record_ids are resolved row by row; an empty
    table gives an empty result.
    """
    names = [c for c in records.columns if c not in ("canonical", "status", "refers_to")]
    of = lambda c: F.col(f"row.{c}")
    # Whole rows travel as one struct, so no column of theirs can clash; payloads of responses stay where they are.
    rows = records.select(F.struct(*names).alias("row"), canonical_url(F.col("url")).alias("canonical"))
    is_revisit, is_response = (F.coalesce(of("kind") == k, F.lit(False)) for k in ("revisit", "response"))
    placed = F.col("canonical").isNotNull() & of("ts").isNotNull()
    place = F.struct(of("ts").alias("ts"), of("record_id").alias("id"), of("etag").alias("etag"), of("last_modified").alias("date"))
    keys = rows.filter(placed & (is_revisit | is_response)).select("canonical", F.floor(of("ts") / span).alias("span"), place.alias("at"), F.when(is_revisit, F.col("row")).alias("row"))
    seen, asks = F.when(F.col("row").isNull(), F.col("at")), F.col("row").isNotNull()
    inside = Window.partitionBy("canonical", "span").orderBy("at.ts", "at.id", asks, "at.etag", "at.date").rowsBetween(Window.unboundedPreceding, -1)
    spans = keys.groupBy("canonical", "span").agg(F.max(seen).alias("end"), F.bool_or(asks).alias("asks"))
    earlier = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("end", ignorenulls=True).over(earlier)).filter("asks").select("canonical", "span", "carried")
    own = keys.withColumn("own", F.last(seen, ignorenulls=True).over(inside)).filter(asks)
    found = own.join(carried, ["canonical", "span"], "left").withColumn("found", F.coalesce("own", "carried"))

    def agree(name: str) -> tuple[Column, Column]:
        both = F.col(f"at.{name}").isNotNull() & F.col(f"found.{name}").isNotNull()
        return both, ~both | (F.col(f"at.{name}") == F.col(f"found.{name}"))

    (has_tag, tag), (has_date, date) = agree("etag"), agree("date")
    verdict = F.when(F.col("found").isNull(), "missing").when((has_tag | has_date) & tag & date, "resolved").otherwise("mismatch")
    # One array of strings is the key: nulls in it are equal, and grouping and join need no second shuffle. Rows that refer to
    # nothing get keys of their own that match nothing, so that they stay spread out.
    key_of = lambda x: F.array(F.col("canonical"), *[x[c].cast("string") for c in ("ts", "id", "etag", "date")])
    nothing = F.array(F.monotonically_increasing_id().cast("string"))
    found = found.withColumn("status", verdict).withColumn("key", F.when(F.col("status") == "resolved", key_of(F.col("found"))).otherwise(nothing))
    stored = rows.filter(placed & is_response).select(key_of(place).alias("key"), F.struct(of("payload").alias("payload"), of("headers").alias("headers")).alias("stored"))
    stored = stored.groupBy("key").agg(F.min_by("stored", F.xxhash64("stored.payload")).alias("stored"))
    met = found.join(stored, "key", "left")  # a response's payload moves once, to its revisits
    none = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce(of("headers"), none), lambda k, v: ~k.isin(STORED_ONLY))
    kept = F.map_filter(F.coalesce(F.col("stored.headers"), none), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    resolved = F.col("status") == "resolved"
    new = {"payload": F.when(resolved, F.col("stored.payload")).otherwise(of("payload")), "headers": F.when(resolved, F.map_concat(kept, fresh)).otherwise(of("headers"))}
    done = met.select(*[new.get(c, of(c)).alias(c) for c in names], "canonical", "status", F.when(resolved, F.col("found.id")).cast("long").alias("refers_to"))
    status = F.when(is_response, "full").when(is_revisit, "missing").otherwise("other")
    rest = rows.filter(~(placed & is_revisit)).select("row.*", "canonical", status.alias("status"), F.lit(None).cast("long").alias("refers_to"))
    return rest.unionByName(done)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log from pages: one or two versions of each page, revisits of it under other spellings, and a hot URL.

    By page_id: revisits come before the first version, between or after the versions; they name the first or the second
    version or another one, or have only a date or no validator. Every fiftieth page is also a capture of one portal.
    """
    i, n = F.col("page_id"), F.col("n")
    day = F.lit(1_700_000_000).cast("long") + i * 600
    # n: 0 to 2 are responses (two versions, the portal), 3 to 7 revisits (four of the page, one of the portal).
    there = {0: F.lit(True), 1: i % 2 == 0, 2: i % 50 == 3, **{3 + j: i % 4 >= j for j in range(4)}, 7: i % 50 == 3}
    each = pages.select("page_id", "url", "html", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in there.items()]))).alias("n"))
    first, second = F.coalesce("html", F.lit("")), F.concat(F.coalesce("html", F.lit("")), F.lit("<!-- 2 -->"))
    j, is_response, of_portal = n - 3, n <= 2, n.isin(2, 7)
    ts = day + (
        F.when(n == 0, 0).when(n == 1, 100_000).when(n == 2, 7).when(n == 7, 9)
        .when((n == 3) & (i % 7 == 0), -300).when(i % 2 == 0, 400_000 + j).otherwise(450 + j * 60_000)
    )
    url = F.when(of_portal, F.when(is_response, "http://portal.example/index.html").otherwise("https://www.portal.example/?utm_source=x")).otherwise(F.concat("url", F.when(~is_response & (i % 3 == 0), "#seen").otherwise("")))
    version = F.when((n == 1) | ~is_response & ~of_portal & (j % 2 == 1), second).otherwise(first)
    tag = F.concat(F.lit('"'), F.substr(F.md5(version), F.lit(1), F.lit(12)), F.lit('"'))
    named = F.when(is_response, tag).when(n == 7, F.when(i % 100 == 3, '"other"').otherwise(tag)).when((i + j) % 5 == 0, '"other"').when((i + j) % 5 < 3, tag)
    date = F.concat(F.lit("day "), (i % 9).cast("string"))
    header = lambda *kv: F.map_from_arrays(F.array(*[F.lit(k) for k in kv[::2]]), F.array(*kv[1::2]))
    full = header("content-type", F.lit("text/html"), "content-length", F.octet_length(version).cast("string"), "date", ts.cast("string"), "server", F.concat(F.lit("s"), (i % 3).cast("string")))
    short = header("date", ts.cast("string"), "content-length", F.lit("0"), "cache-control", F.lit("max-age=60"))
    return each.select(
        (i * 8 + n).alias("record_id"), F.when(is_response, "response").otherwise("revisit").alias("kind"), url.alias("url"), ts.alias("ts"), named.alias("etag"),
        F.when(is_response | ~of_portal & ((i + j) % 5 == 3), date).alias("last_modified"), F.when(is_response, full).otherwise(short).alias("headers"), F.when(is_response, version).alias("payload"), "page_id",
    )


def digest(resolved: DataFrame) -> DataFrame:
    """record_id, page_id, status, refers_to, headers as sorted text, payload_sha256."""
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return resolved.select("record_id", "page_id", "canonical", "status", "refers_to", F.array_join(lines, "\n").alias("headers"), F.sha2(F.coalesce("payload", F.lit("")), 256).alias("payload_sha256"))


ORACLE = r"""
WITH c AS (SELECT *, coalesce(html, '') AS t, regexp_replace(trim(url), '#.*$', '') AS u0, 'day ' || (page_id % 9) AS d, 1700000000 + page_id * 600 AS day FROM pages),
g AS (SELECT *, chr(34) || left(md5(t), 12) || chr(34) AS tag0, chr(34) || left(md5(t || '<!-- 2 -->'), 12) || chr(34) AS tag1 FROM c),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(u0 || '&', '([?&])(?:utm_[^&]*&)+', '\1', 'g'), '([?&])&+', '\1', 'g'), '[?&]+$', '') AS u1 FROM g),
h AS (SELECT *, lower(regexp_extract(u1, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) AS head FROM k),
p AS (SELECT *, regexp_replace(regexp_replace(head, '^https?://(www\.)?', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(substr(u1, length(head) + 1), '(/index\.html?|/)(\?|$)', '\2'), '^$', '') AS canonical FROM h),
r AS (SELECT page_id * 8 AS record_id, page_id, canonical, day AS ts, tag0 AS tag, d, t AS body FROM p
      UNION ALL SELECT page_id * 8 + 1, page_id, canonical, day + 100000, tag1, d, t || '<!-- 2 -->' FROM p WHERE page_id % 2 = 0
      UNION ALL SELECT page_id * 8 + 2, page_id, 'portal.example', day + 7, tag0, d, t FROM p WHERE page_id % 50 = 3),
v AS (SELECT page_id * 8 + 3 + j AS record_id, page_id, canonical, day + CASE WHEN j = 0 AND page_id % 7 = 0 THEN -300 WHEN page_id % 2 = 0 THEN 400000 + j ELSE 450 + j * 60000 END AS ts,
        CASE WHEN (page_id + j) % 5 = 0 THEN '"other"' WHEN (page_id + j) % 5 < 3 THEN CASE WHEN j % 2 = 0 THEN tag0 ELSE tag1 END END AS tag, CASE WHEN (page_id + j) % 5 = 3 THEN d END AS d
      FROM p, (SELECT unnest(range(0, 4)) AS j) WHERE page_id % 4 >= j
      UNION ALL SELECT page_id * 8 + 7, page_id, 'portal.example', day + 9, CASE WHEN page_id % 100 = 3 THEN '"other"' ELSE tag0 END, NULL FROM p WHERE page_id % 50 = 3),
j AS (SELECT v.*, r.record_id AS ref, r.page_id AS r_page, r.body, r.tag AS r_tag, r.d AS r_d FROM v LEFT JOIN r ON v.canonical = r.canonical AND (r.ts < v.ts OR (r.ts = v.ts AND r.record_id < v.record_id))
      QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC NULLS LAST, r.record_id DESC) = 1),
x AS (SELECT *, CASE WHEN ref IS NULL THEN 'missing' WHEN coalesce(tag = r_tag, true) AND coalesce(d = r_d, true) AND (coalesce(tag = r_tag, false) OR coalesce(d = r_d, false)) THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT record_id, page_id, canonical, 'full' AS status, CAST(NULL AS BIGINT) AS refers_to,
       'content-length: ' || strlen(body) || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'server: s' || (page_id % 3) AS headers, sha256(body) AS payload_sha256 FROM r
UNION ALL SELECT record_id, page_id, canonical, status, CASE WHEN status = 'resolved' THEN ref END,
       'cache-control: max-age=60' || chr(10) || 'content-length: ' || CASE WHEN status = 'resolved' THEN strlen(body) || chr(10) || 'content-type: text/html' ELSE '0' END || chr(10) || 'date: ' || ts || CASE WHEN status = 'resolved' THEN chr(10) || 'server: s' || (r_page % 3) ELSE '' END,
       sha256(CASE WHEN status = 'resolved' THEN body ELSE '' END) FROM x
"""
