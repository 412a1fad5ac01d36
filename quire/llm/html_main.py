"""Main text of web pages by nearest-URL page differencing.

Each page's markup is cut into lines of text, each with the kind of element that it stands in. Pages of a host are ordered by
URL path; the nearest pages before and after that are no copies are a page's neighbours, and a longest common subsequence
aligns its lines with each of them. Lines outside explicit article elements go where the neighbour of the longer common path
has them. Inside an article real sentences recur, so lines stay there; on request they go from its two ends inwards as long as
the articles of both neighbours begin or end with them too. Lines of elements that are template by their meaning (menus, footers, adverts, forms and so on)
go in any case, since many of them are written anew for every page.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import in_batches

#: Pages in URL order are cut into blocks of about so many pages, but no more than MOST_BLOCKS; each is ordered in one task.
BLOCK_PAGES, MOST_BLOCKS = 2000, 20_000
#: URLs drawn for each block to find where it begins, and the characters of a URL that can begin one.
DRAWN, BEGIN_CHARS = 10, 256

#: Elements whose content is no text, elements that are template, those that end a line, and void elements.
SILENT = ("title", "template", "noscript", "iframe", "svg", "object", "canvas", "select", "textarea", "button")
TEMPLATE = {"nav", "footer", "aside", "form", "menu", "dialog"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words of class, id and role that mark menus, notices, adverts, comments and the like.
MARKED = re.compile(
    r"(?:^|[\s\"'=_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|sidebar|side|widget|menu|navbar|navigation|nav|breadcrumbs?|"
    r"footer|masthead|header|topbar|toolbar|share|sharing|social|related|recommended|comments?|comment-list|replies|reply|disqus|respond|search|login|pagination|pager|copyright|complementary|contentinfo)(?=$|[\s\"'>_-])",
    re.I,
)
# Comments, scripts and styles run to the page's end where they are not closed; other silent elements must be closed.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<(" + "|".join(SILENT) + r")\b[^>]*>.*?</\2\s*>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
ARTICLE, OPEN, CLOSED = 2, 1, 0
#: A neighbour that shares at least this part of a page's lines outside template elements is a copy of it.
COPY = 0.9
#: Cells of an alignment that are kept at once (bits); longer pages are aligned in halves.
CELLS = 1 << 31


def lines(source: str) -> list[tuple[str, int]]:
    """The page's lines of text with white space folded: ARTICLE inside an article or main element, CLOSED inside template, else OPEN."""
    out, part, stack = [], [], []  # stack: (element, is template, is article)

    def end() -> None:
        text = " ".join(html.unescape("".join(part)).split())
        part.clear()
        if text:
            closed, article = any(t for _, t, _ in stack), any(a for _, _, a in stack)
            out.append((text, CLOSED if closed else ARTICLE if article else OPEN))

    at = 0
    for m in _TOKEN.finditer(source):
        part.append(source[at : m.start()])
        at = m.end()
        name = (m[4] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            end()
        if m[3]:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in VOID and not m[5].endswith("/"):
            if name == "p" or name == "li":  # an open one of the same kind ends here
                while stack and stack[-1][0] in (name, "b", "i", "em", "strong", "a", "span", "u", "font", "small") and any(s[0] == name for s in stack):
                    stack.pop()
            article = name in ("article", "main")
            inside = any(a for _, _, a in stack)
            template = name in TEMPLATE or name == "header" and not inside or not article and name not in ("html", "body") and any(MARKED.search(x.strip("\"'")) for x in _NAMED.findall(m[5] or ""))
            stack.append((name, template, article))
    part.append(source[at:])
    end()
    return out


def shared(a: list[int], b: list[int]) -> set[int]:
    """Positions of ``a`` that a longest common subsequence with ``b`` aligns."""
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = set(range(lo)) | set(range(len(a) - hi, len(a)))
    both = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])  # lines of one side only never align
    at = [i for i in range(lo, len(a) - hi) if a[i] in both]
    return out | {at[i] for i in _aligned([a[i] for i in at], [x for x in b[lo : len(b) - hi] if x in both])}


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of ``b`` the lines of ``a`` at which the common subsequence does not grow, as bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > CELLS:
        # In memory of one row: the best cut of ``a`` for the two halves of ``b``.
        half = len(b) // 2
        grow = lambda x, y: np.concatenate([[0], np.cumsum([1 - int(c) for c in format(list(deque(_rows(x, y), 1))[0], f"0{len(x)}b")[::-1]])])
        cut = int(np.argmax(grow(a, b[:half]) + grow(a[::-1], b[half:][::-1])[::-1]))
        return _aligned(a[:cut], b[:half]) + [cut + i for i in _aligned(a[cut:], b[half:])]
    rows, out = list(_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if j and not rows[j - 1] >> (i - 1) & 1:
            continue
        i -= 1
        out.append(i)
    return out[::-1]


def _line_id(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, key (host, path and id: the order of pages) and html."""
    base = F.regexp_replace("url", r"[?#].*$", "")
    host, path = F.lower(F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/]*)", 1)), F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/]*(.*)$", 1)
    taken = pages.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "html")
    key = F.concat_ws("\x01", "host", "path", F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"))
    return taken.select("page_id", "url", "host", "path", key.alias("key"), "html")


def block_starts(keyed: DataFrame) -> list[bytes]:
    """Keys at which blocks begin, from those with the smallest hashes: at most DRAWN * MOST_BLOCKS of BEGIN_CHARS characters come here."""
    n = keyed.count()
    blocks = min(MOST_BLOCKS, n // BLOCK_PAGES)
    if not blocks:
        return []
    share = F.xxhash64("key", F.lit("block")).cast("double") / F.lit(2.0**64) + 0.5
    drawn = keyed.filter(share * n < DRAWN * blocks).select(F.substring("key", 1, BEGIN_CHARS).alias("key")).distinct()
    keys = sorted(r["key"].encode() for r in drawn.collect())
    return sorted({keys[i * len(keys) // (blocks + 1)] for i in range(1, blocks + 1)}) if keys else []


def _parsed(keyed: DataFrame, starts, with_text: bool) -> DataFrame:
    """page_id, url, host, path, key, block, ids (of the lines), ends (of the article among them), and z, the lines, if asked for."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, begins = zstandard.ZstdCompressor(level=3), starts.value
        for b in batches:
            found = [lines(x.as_py() or "") for x in b.column(5)]
            block = pa.array([bisect_right(begins, k.encode()) for k in b.column(4).to_pylist()], pa.int32())
            ids = pa.array([[_line_id(t) for t, _ in page] for page in found], pa.list_(pa.int64()))
            inside = [[i for i, (_, k) in enumerate(page) if k == ARTICLE] for page in found]
            ends = pa.array([[x[0], x[-1]] if x else [] for x in inside], pa.list_(pa.int32()))
            z = [pa.array([press.compress(json.dumps(page).encode()) for page in found], pa.binary())] if with_text else []
            yield pa.RecordBatch.from_arrays([*b.columns[:5], block, ids, ends, *z], [*b.schema.names[:5], "block", "ids", "ends", *["z"] * with_text])

    schema = f"page_id {keyed.dtypes[0][1]}, url string, host string, path string, key string, block int, ids array<long>, ends array<int>" + ", z binary" * with_text
    return in_batches(keyed, each, schema)


def neighbours(pages: DataFrame) -> DataFrame:
    """page_id, url, path, z, ids, and before and after: path, ids and ends of the nearest pages of the host with other lines (null: none).

    Order: host, path, page_id. Blocks of that order are sorted in different tasks; the first and last page of every block are
    carried to the blocks beside it. Where a block begins or ends with copies of the page carried, those have no neighbour on
    that side.
    """
    keyed = _keyed(pages)
    starts = keyed.sparkSession.sparkContext.broadcast(block_starts(keyed))
    other = F.struct("key", "host", "path", F.xxhash64("ids").alias("sig"), "ids", "ends")
    ends = _parsed(keyed, starts, False).groupBy("block").agg(F.min(other).alias("first"), F.max(other).alias("last"))
    beside = Window.orderBy("block")  # one row for each of at most MOST_BLOCKS blocks
    ends = ends.select("block", F.lag("last").over(beside).alias("carried_before"), F.lead("first").over(beside).alias("carried_after"))
    at = Window.partitionBy("block").orderBy("key")
    p = _parsed(keyed, starts, True).withColumn("own", other)
    for side, step, order in (("before", F.lag, at), ("after", F.lead, Window.partitionBy("block").orderBy(F.desc("key")))):
        p = p.withColumn(f"_{side}", step("own").over(at))
        # A run of copies has the page beyond its first row (seen from that side) as its neighbour.
        changes = F.col(f"_{side}.host").eqNullSafe(F.col("host")) & F.col(f"_{side}.sig").eqNullSafe(F.col("own.sig"))
        p = p.withColumn(f"_{side}", F.last(F.when(~changes, F.struct(F.col(f"_{side}").alias("x"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))["x"])
    p = p.join(ends, "block", "left")

    def known(side: str) -> Column:
        x = F.coalesce(f"_{side}", f"carried_{side}")
        return F.when((x["host"] == F.col("host")) & (x["sig"] != F.col("own.sig")), F.struct(*[x[c].alias(c) for c in ("path", "ids", "ends")])).alias(side)

    return p.select("page_id", "url", "path", "z", "ids", known("before"), known("after"))


def kept_lines(kinds: list[int], ids: list[int], path: str, others: list[tuple[str, list[int], list[int]]], article_ends: bool = False) -> list[int]:
    """Positions of a page's main text, from the kinds and ids of its lines and the path, ids and article ends of its neighbours.

    An open line goes where the neighbour with the longer common path (the first on ties) has it; beside an article this holds
    for copies too if there is nothing else. With ``article_ends`` an article's lines go from both ends inwards while the
    articles of two neighbours have the same lines there.
    """
    text = [i for i, k in enumerate(kinds) if k != CLOSED]
    near = sorted(others, key=lambda x: -len(commonprefix([path, x[0]])))
    found = [shared(ids, x[1]) for x in near]
    proper = [k for k, x in enumerate(found) if sum(i in x for i in text) < COPY * len(text)]
    article = [i for i in text if kinds[i] == ARTICLE]
    gone = found[proper[0]] if proper else found[0] if found and article else ()
    out = {i for i in text if kinds[i] == OPEN and i not in gone} | set(article)
    if article_ends and len(proper) == 2 and all(x[2] for x in near):
        bodies = [x[1][x[2][0] : x[2][1] + 1] for x in near]
        for own, beside in ((article, bodies), (article[::-1], [x[::-1] for x in bodies])):
            for i, *same in zip(own, *beside):
                if set(same) != {ids[i]}:
                    break
                out.discard(i)
    return sorted(out)


def main_text(pages: DataFrame, article_ends: bool = False) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html; more columns are ignored).

    Lines are joined by one space. ``article_ends`` suits sites that put bars or notices inside their article elements; where
    articles themselves begin or end with equal sentences it would delete text. A null or empty html has the empty text; a null url counts as the empty URL; a page
    without a neighbour, or without an article and with copies on both sides, loses template elements only; repeated rows are
    copies of each other; an empty table gives an empty result.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for path, z, ids, *beside in zip(*(b.column(i).to_pylist() for i in range(2, 7))):
                page = json.loads(press.decompress(z))
                kept = kept_lines([k for _, k in page], ids, path, [(x["path"], x["ids"], x["ends"]) for x in beside if x], article_ends)
                out.append(" ".join(page[i][0] for i in kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    met = neighbours(pages)
    return in_batches(met, each, f"page_id {met.dtypes[0][1]}, url string, text string, n_chars long")
