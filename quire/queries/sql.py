"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

#: Python-like strip.
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')".format


def starts(text: str, pattern: str) -> str:
    """List of 0-based match starts, found by marking each match."""
    pieces = f"string_split(regexp_replace({text}, '({pattern})', chr(1) || '\\1', 'g'), chr(1))"
    return f"list_transform([{pieces}], lambda q: list_transform(range(1, len(q)), lambda n: list_sum(list_transform(q[1:n], lambda p: length(p)))))[1]"


def rows(text: str, pattern: str, group: int = 0) -> str:
    """List of structs t (the match), v (a group) and p (its start)."""
    return f"list_transform(list_zip(regexp_extract_all({text}, '{pattern}'), regexp_extract_all({text}, '{pattern}', {group}), {starts(text, pattern)}), lambda z: {{'t': z[1], 'v': z[2], 'p': z[3]}})"


#: What separates words for Python.
SPACES = r"[ \t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORDS = (r"list_filter(string_split_regex({0}, '" + SPACES.replace("{", "{{").replace("}", "}}") + "'), lambda w: w <> '')").format
CHARACTERS = "regexp_extract_all({0}, '(?s).')".format


def blocks(source: str, p: str) -> str:
    """Recursive expressions, the last of them ``{p}rec`` (key, alo, ahi, blo, bhi, m: i, j, n), of the differ's blocks for ``source`` (key, a, b)."""
    stretch = lambda most, x, y: f"CASE WHEN {most} > 0 THEN coalesce(list_filter(range(1, {most} + 1), lambda x: a[{x}] <> b[{y}])[1] - 1, {most}) ELSE 0 END"
    back = stretch("least(c.i - alo, c.j - blo)", "c.i - x + 1", "c.j - x + 1")
    on = stretch("least(ahi - c.i - c.n, bhi - c.j - c.n)", "c.i + c.n + x", "c.j + c.n + x")
    grown = lambda boxes: (
        f"SELECT key, alo, ahi, blo, bhi, {{'i': c.i - bk, 'j': c.j - bk, 'n': c.n + bk + fw}} AS m FROM (SELECT key, alo, ahi, blo, bhi, c, CASE WHEN len(b) >= 200 THEN {back} ELSE 0 END AS bk, CASE WHEN len(b) >= 200 THEN {on} ELSE 0 END AS fw FROM "
        f"(SELECT key, alo, ahi, blo, bhi, CASE WHEN k IS NULL THEN {{'i': alo, 'j': blo, 'n': 0::BIGINT}} ELSE {{'i': k.i, 'j': k.j, 'n': -k.n}} END AS c FROM (SELECT x.key, x.alo, x.ahi, x.blo, x.bhi, min(w.k) AS k FROM {boxes} x "
        f"LEFT JOIN (SELECT x.key, x.alo, x.blo, {{'n': greatest(s, x.alo, x.blo - d) - least(s + n, x.ahi, x.bhi - d), 'i': greatest(s, x.alo, x.blo - d), 'j': greatest(s, x.alo, x.blo - d) + d}} AS k FROM {boxes} x JOIN {p}runs r ON r.key = x.key WHERE least(s + n, x.ahi, x.bhi - d) > greatest(s, x.alo, x.blo - d)) w ON w.key = x.key AND w.alo = x.alo AND w.blo = x.blo GROUP BY x.key, x.alo, x.ahi, x.blo, x.bhi)) JOIN {source} USING (key)) WHERE c.n + bk + fw > 0"
    )
    halves = "(SELECT key, h.alo AS alo, h.ahi AS ahi, h.blo AS blo, h.bhi AS bhi FROM (SELECT key, unnest([{{'alo': alo, 'ahi': m.i, 'blo': blo, 'bhi': m.j}}, {{'alo': m.i + m.n, 'ahi': ahi, 'blo': m.j + m.n, 'bhi': bhi}}]) AS h FROM {p}rec) WHERE h.alo < h.ahi AND h.blo < h.bhi)".format(p=p)
    whole = f"(SELECT key, 0::BIGINT AS alo, len(a)::BIGINT AS ahi, 0::BIGINT AS blo, len(b)::BIGINT AS bhi FROM {source} WHERE len(a) > 0 AND len(b) > 0)"
    return (
        f"{p}at AS (SELECT key, w, list(j) AS js FROM (SELECT key, len(b) AS nb, unnest(b) AS w, unnest(range(len(b))) AS j FROM {source}) GROUP BY key, nb, w HAVING nb < 200 OR count(*) <= nb // 100 + 1), "
        f"{p}eq AS (SELECT key, i, unnest(js) AS j FROM (SELECT key, unnest(a) AS w, unnest(range(len(a))) AS i FROM {source}) JOIN {p}at USING (key, w)), "
        f"{p}runs AS (SELECT key, d, min(i) AS s, count(*) AS n FROM (SELECT key, i, j - i AS d, i - row_number() OVER (PARTITION BY key, j - i ORDER BY i) AS g FROM {p}eq) GROUP BY key, d, g), "
        f"{p}rec AS ({grown(whole)} UNION ALL {grown(halves)})"
    )


def differs(source: str, p: str) -> str:
    """``{p}gaps`` (key, a, b, g: list of i, ie, j, je, n) on top of ``blocks``: what differs before each block, and its length."""
    return (
        blocks(source, p) + f", {p}bl AS (SELECT key, list_prepend({{'i': 0::BIGINT, 'j': 0::BIGINT, 'n': 0::BIGINT}}, list_append(coalesce(list_sort(l), []), {{'i': len(a)::BIGINT, 'j': len(b)::BIGINT, 'n': 0::BIGINT}})) AS l, a, b FROM {source} LEFT JOIN (SELECT key, list(m) AS l FROM {p}rec GROUP BY key) USING (key)), "
        f"{p}gaps AS (SELECT key, a, b, list_transform(range(2, len(l) + 1), lambda x: {{'i': l[x - 1].i + l[x - 1].n, 'ie': l[x].i, 'j': l[x - 1].j + l[x - 1].n, 'je': l[x].j, 'n': l[x].n}}) AS g FROM {p}bl)"
    )
