"""The standard differ's matching blocks, as relations.

Two sequences match in the longest run of equal elements, the first one where several are as long; what lies before it on both
sides matches in the same way, and so does what lies behind. In sequences of 200 elements and more, elements that make up over
a hundredth of the second one start no run, but runs go on over them.

Positions at which both sides have the same element lie on diagonals, and gaps-and-islands turns these into runs. A round takes
the best run of every box, clips the other runs of the box to what lies before and behind it, and so gives the boxes of the
next round; rounds go on while a box has a run. All rows are cut at once, and no row is ever in one task as a whole but for its
two arrays.

A round reads all runs that are left, and unrelated texts have thousands of runs and hundreds of rounds. So rounds are for the
pairs beyond ``NEAR`` only: all others are matched within their rows, which are spread over all tasks.

The staged tables of a round are small files of many rows (runs, elements), so joins on them are told not to broadcast: Spark
would go by the size of the files, and the driver would hold all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.staging import staged

#: Second sequences of so many elements have popular ones, which are over 1 / SHARE of it and one more.
LONG, SHARE = 200, 100
#: Places times places of the longest pairs that are matched within their rows (texts of 65,536 words or characters).
NEAR = 1 << 32
#: A place in a has so many equal ones in b at most (b's length, or a SHARE of it where popular elements start no run); pairs whose
#: places have more than NEAR / LETTERS in all are not judged within their rows (texts of 163,000 characters).
LETTERS = 16
#: Fixed value: equal places that are looked at together.
AT_ONCE = 1 << 20
#: Fixed value: the type of a pair's blocks.
FOUND = "array<struct<i:int,j:int,k:int>>"
#: Fixed value: what separates words, which is all that counts as white space in Unicode.
SPACES = r"[ \t-\r\x1c-\x1f\x85\xa0  -     　]+"

BOX = ["key", "alo", "blo"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def pair_key(a: Column, b: Column) -> Column:
    """Equal for equal pairs of texts only."""
    a, b = (F.coalesce(x, F.lit("")) for x in (a, b))
    return F.md5(F.concat(F.octet_length(a).cast("string"), F.lit(":"), a, b))


def distinct_pairs(texts: DataFrame, a: str, b: str, elements) -> DataFrame:
    """key, a and b of the distinct pairs of two text columns, cut into ``elements``; null counts as empty."""
    keyed = texts.select(pair_key(F.col(a), F.col(b)).alias("key"), *[F.coalesce(c, F.lit("")).alias(x) for c, x in ((a, "a"), (b, "b"))])
    return staged(keyed.dropDuplicates(["key"]).select("key", elements(F.col("a")).alias("a"), elements(F.col("b")).alias("b")), "pairs")


def runs(pairs: DataFrame) -> DataFrame:
    """key, d, s and n: stretches of n equal elements from s in a and s + d in b, by all elements that are not popular; of pairs (key, a, b)."""
    b = pairs.select("key", F.size("b").alias("nb"), F.posexplode("b").alias("j", "w"))
    usual = (F.col("nb") < LONG) | (F.size("js") <= F.floor(F.col("nb") / SHARE) + 1)
    at = b.groupBy("key", "w").agg(F.collect_list("j").alias("js"), F.first("nb").alias("nb")).filter(usual).select("key", "w", "js")
    a = pairs.select("key", F.posexplode("a").alias("i", "w"))
    equal = a.join(at.hint("merge"), ["key", "w"]).select("key", "i", F.explode("js").alias("j")).select("key", "i", (F.col("j") - F.col("i")).alias("d"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("key", "d").orderBy("i"))
    return equal.withColumn("island", island).groupBy("key", "d", "island").agg(F.min("i").alias("s"), F.count("*").cast("int").alias("n")).drop("island")


def _stretch(most: str, a: str, b: str) -> str:
    """SQL: how many of the next ``most`` elements are equal before the first, x, for which ``a`` and ``b`` are not."""
    return f"CASE WHEN a IS NULL OR {most} <= 0 THEN 0 ELSE coalesce(get(filter(sequence(1, {most}), x -> NOT get(a, {a}) <=> get(b, {b})), 0) - 1, {most}) END"


def _clipped(alo: str, ahi: str, blo: str, bhi: str) -> str:
    """SQL: what a box has of the run d, s, n; n is 0 and less for nothing."""
    s = f"greatest(s, {alo}, {blo} - d)"
    return f"named_struct('kind', 'run', 'alo', {alo}, 'ahi', {ahi}, 'blo', {blo}, 'bhi', {bhi}, 'd', d, 's', {s}, 'n', least(s + n, {ahi}, {bhi} - d) - {s})"


def _block(i: str, j: str, n: str) -> str:
    return f"named_struct('kind', 'block', 'alo', alo, 'ahi', ahi, 'blo', blo, 'bhi', bhi, 'd', {j} - {i}, 's', {i}, 'n', {n})"


def _round(grown: bool) -> str:
    """SQL of a round: ``{live}`` (the runs of all boxes), and with ``grown`` ``{long}`` (key, a, b of the pairs that have popular elements).

    Every box's block is its longest run, which starts at ``seed``, grown over equal elements at both ends; ``lead`` is how far
    the box's first elements are equal, up to the block. Short pairs have no popular elements, so their runs end where elements
    differ and nothing else is equal there. One text for all rounds: building it from columns would take longer than a round.
    """
    found = "SELECT key, alo, blo, ahi, bhi, min(struct(-n AS m, s AS i, s + d AS j)) AS r FROM {live} GROUP BY key, alo, blo, ahi, bhi"
    best = f"SELECT key, alo, blo, ahi, bhi, r.i AS seed, r.i, r.j, -r.m AS k, 0 AS lead FROM ({found})"
    if grown:
        back = _stretch("least(r.i - alo, r.j - blo)", "r.i - x", "r.j - x")
        on = _stretch("least(ahi - r.i + r.m, bhi - r.j + r.m)", "r.i - r.m + x - 1", "r.j - r.m + x - 1")
        ends = f"SELECT /*+ MERGE(f) */ f.*, a, b, {back} AS back, {on} AS on FROM ({found}) f LEFT JOIN {{long}} USING (key)"
        lead = _stretch("least(r.i - back - alo, r.j - back - blo)", "alo + x - 1", "blo + x - 1")
        best = f"SELECT key, alo, blo, ahi, bhi, r.i AS seed, r.i - back AS i, r.j - back AS j, back + on - r.m AS k, {lead} AS lead FROM ({ends})"
    is_seed = "d = j - i AND s = seed"
    before, behind = _clipped("alo", "i", "blo", "j"), _clipped("i + k", "ahi", "j + k", "bhi")
    cut = f"SELECT /*+ MERGE(best) */ *, {before} AS before, {behind} AS behind FROM {{live}} JOIN ({best}) best USING (key, alo, blo, ahi, bhi)"
    parts = ["before", "behind", f"CASE WHEN {is_seed} THEN {_block('i', 'j', 'k')} END"]
    if grown:
        cut = f"SELECT *, max(before.n) OVER (PARTITION BY key, alo, blo) AS most_before FROM ({cut})"
        parts.append(f"CASE WHEN {is_seed} AND most_before <= 0 THEN {_block('alo', 'blo', 'lead')} END")
    return f"SELECT key, h.* FROM (SELECT key, explode(filter(array({', '.join(parts)}), h -> h.n > 0)) AS h FROM ({cut}))"


def _rounds(pairs: DataFrame):
    """After each round its table, and the runs that live in the boxes of the next; until none does.

    A round's table has kind: a block (from s in a and s + d in b, n elements) or a run of the next round. The first one may
    have key, i, j and k instead: what texts without any run have. The receiver may send back fewer runs to go on with. A box
    without a run still matches as far as its first elements are equal, which are popular then; behind a grown block they
    never are.
    """
    spark = pairs.sparkSession
    long = pairs.filter(F.size("b") >= LONG).select("key", "a", "b")
    grown = not long.isEmpty()
    whole = runs(pairs).join(pairs.select("key", F.size("a").alias("ahi"), F.size("b").alias("bhi")).hint("merge"), "key")
    live = staged(whole.select("key", F.lit(0).alias("alo"), "ahi", F.lit(0).alias("blo"), "bhi", "d", "s", "n"), "runs")
    if grown:
        bare = long.join(live.select("key").distinct().hint("merge"), "key", "left_anti")
        starts = bare.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.expr(_stretch("least(size(a), size(b))", "x - 1", "x - 1")).alias("k")).filter("k > 0")
        live = (yield starts, live) or live
    text = _round(grown)
    while not live.isEmpty():
        done = staged(spark.sql(text, live=live, **({"long": long} if grown else {})), "round")
        live = done.filter("kind = 'run'").drop("kind")
        live = (yield done, live) or live


def _blocks_of(spark, tables: list[DataFrame]) -> DataFrame | None:
    """key, i, j and k of all blocks in the rounds' tables; one scan of all their files instead of one for each."""
    first = [t for t in tables if "kind" not in t.columns]
    rounds = [t for t in tables if "kind" in t.columns]
    if rounds:
        read = spark.read.schema(rounds[0].schema).parquet(*[f for t in rounds for f in t.inputFiles()])
        first.append(read.filter("kind = 'block'").selectExpr("key", "s AS i", "s + d AS j", "n AS k"))
    return reduce(DataFrame.unionByName, first) if first else None


def _in_rounds(words: DataFrame | None, letters: DataFrame | None = None, threshold: float = 0.5) -> tuple[DataFrame | None, DataFrame | None]:
    """The blocks of ``words`` (see ``blocks``) and the verdicts on ``letters`` (see ``less_alike``), found in the same rounds."""
    given = words if words is not None else letters
    spark, kind = given.sparkSession, given.select("key").dtypes[0][1]
    marked = lambda df, mark: df.select(F.concat(F.lit(mark), F.col("key").cast("string")).alias("key"), "a", "b")
    plain = lambda df, mark: df.filter(F.col("key").startswith(mark)).withColumn("key", F.substring("key", 2, 1 << 30).cast(kind))
    decided, left, taking = [], None, []
    under = lambda n: 2.0 * n / F.col("total") < threshold
    if words is not None:
        taking.append(marked(words, "w"))
    if letters is not None:
        decided, left = _bounded(letters, under)
        left = marked(left, "c")
        taking.append(left)
        left = left.select("key", (F.size("a") + F.size("b")).cast("double").alias("total"))
    tables, known, n = [], 0, 0
    rounds = _rounds(reduce(DataFrame.unionByName, taking))
    step = next(rounds, None)
    while step is not None:
        (table, live), n, fewer = step, n + 1, None
        tables.append(table)
        if letters is not None and n & (n - 1) == 0:  # judged after rounds 1, 2, 4, 8 and so on
            could = live.filter("key LIKE 'c%'").selectExpr("key", "alo", "blo", "least(ahi - alo, bhi - blo) AS m").distinct().groupBy("key").agg(F.sum("m").alias("could"))
            verdict = F.when(~under(F.col("matched")), False).when(under(F.col("matched") + F.coalesce("could", F.lit(0))), True)
            judged = staged(_matched(left, tables).join(could.hint("merge"), "key", "left").select("key", "total", verdict.alias("below")), "alike")
            decided.append(plain(judged.filter("below IS NOT NULL").select("key", "below"), "c"))
            left = judged.filter("below IS NULL").select("key", "total")
            fewer = live.join(judged.filter("below IS NOT NULL").select("key").hint("merge"), "key", "left_anti")
        try:
            step = rounds.send(fewer)
        except StopIteration:
            step = None
    found = below = None
    if words is not None:
        all_blocks = _blocks_of(spark, tables)
        found = spark.createDataFrame([], f"key {kind}, i int, j int, k int") if all_blocks is None else plain(all_blocks, "w")
    if letters is not None:
        decided.append(plain(_matched(left, tables).select("key", under(F.col("matched")).alias("below")), "c"))
        below = reduce(DataFrame.unionByName, decided)
    return found, below


def _in_order(a: list, b: list) -> Iterator[tuple[int, int, int]]:
    """The blocks (i, j, k) that the standard differ finds, in order, each as soon as what lies before it is known; neighbours may touch.

    The differ looks through a box's elements again for every block; here all runs of two and more are found in one pass, and a
    box only clips those of the box around it. Where none is left, its first equal elements are a block.
    """
    if a == b:
        if a:
            yield 0, 0, len(a)
        return
    places: dict = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    if len(b) >= LONG:
        most = len(b) // SHARE + 1
        places = {w: js for w, js in places.items() if len(js) <= most}
    # Behind the ends, and for popular elements, two marks that differ.
    x, y = ([*(w if w in places else mark for w in side), mark] for side, mark in ((a, object()), (b, object())))
    runs = []  # (start, end, diagonal)
    for i, w in enumerate(a):
        for j in places.get(w, ()):
            if x[i - 1] != y[j - 1] and x[i + 1] == y[j + 1]:
                k = 2
                while x[i + k] == y[j + k]:
                    k += 1
                runs.append((i, i + k, j - i))
    left: list[tuple] = [(0, len(a), 0, len(b), runs)]  # boxes, and blocks behind the boxes before them
    while left:
        alo, ahi, blo, bhi, runs = left.pop()
        if runs is None:
            yield alo, blo, ahi
            continue
        i, j, k, cut = alo, blo, 0, []
        for s, e, d in runs:
            s = alo if s < alo else s
            s = blo - d if s + d < blo else s
            e = ahi if e > ahi else e
            e = bhi - d if e + d > bhi else e
            if e - s > 1:
                cut.append((s, e, d))
                if e - s > k or e - s == k and (s, s + d) < (i, j):
                    i, j, k = s, s + d, e - s
        if not k:
            one = next(((p, q) for p in range(alo, ahi) for q in places.get(a[p], ()) if blo <= q < bhi), None)
            i, j, k = (*one, 1) if one else (i, j, 0)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        if k:
            if i + k < ahi and j + k < bhi:
                left.append((i + k, ahi, j + k, bhi, [r for r in cut if r[1] > i + k and r[1] + r[2] > j + k]))
            left.append((i, k, j, 0, None))
            if alo < i and blo < j:
                left.append((alo, i, blo, j, [r for r in cut if r[0] < i and r[0] + r[2] < j]))


def matching(a: list, b: list) -> list[tuple[int, int, int]]:
    """The blocks (i, j, k) that the standard differ finds, in order; those that touch are one."""
    out: list[tuple[int, int, int]] = []
    for i, j, k in _in_order(a, b):
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (i, j):
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((i, j, k))
    return out


def _codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers for the elements of two sequences, equal for equal elements."""
    if isinstance(a, str):
        both = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)
        used = np.zeros(int(both.max()) + 1, np.int64)
        used[both] = 1
        both = np.cumsum(used)[both] - 1
    else:
        known: dict = {}
        both = np.array([known.setdefault(w, len(known)) for side in (a, b) for w in side], np.int64)
    return both[: len(a)], both[len(a) :]


def _runs_of_two(x: np.ndarray, y: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and diagonal of all runs of two and more; x and y end in marks, which are negative and differ, as popular elements are."""
    p, q = (np.flatnonzero((side[:-1] >= 0) & (side[1:] >= 0)) for side in (x, y))
    two, other = x[p] * kinds + x[p + 1], y[q] * kinds + y[q + 1]
    order = np.argsort(other, kind="stable")
    lo, hi = (np.searchsorted(other[order], two, side) for side in ("left", "right"))
    q, ends = q[order], np.cumsum(hi - lo)
    found, done = [], 0
    while done < len(p):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, "right")))
        n = (hi - lo)[done:upto]
        i = np.repeat(p[done:upto], n)
        j = q[np.arange(len(i)) - np.repeat(np.cumsum(n) - n - lo[done:upto], n)]
        first = x[i - 1] != y[j - 1]
        i, j = i[first], j[first]
        k, on = np.full(len(i), 2), np.arange(len(i))
        while len(on):
            on = on[x[i[on] + k[on]] == y[j[on] + k[on]]]
            k[on] += 1
        found.append((i, i + k, j - i))
        done = upto
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the first elements are equal."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differ = np.flatnonzero(x[at : min(n, at + step)] != y[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 8
    return n


def alike_below(a, b, threshold: float) -> bool:
    """Whether the standard differ's ratio of two sequences is under ``threshold``; it stops at the block that decides it.

    Blocks are those of ``matching``, found in the largest box first: what is matched so far is the least, and with all that the
    boxes left could add the most that there can be.
    """
    n, m = len(a), len(b)
    under = lambda matched: (2.0 * matched / (n + m) if n + m else 1.0) < threshold
    if not n or not m or a == b or under(min(n, m)):
        return under(min(n, m))
    a, b = _codes(a, b)
    kinds = int(max(a.max(), b.max())) + 1
    ca, cb = (np.bincount(side, minlength=kinds) for side in (a, b))
    if under(int(np.minimum(ca, cb).sum())):
        return True
    starts = (cb > 0) & ((cb <= m // SHARE + 1) | (m < LONG))
    x, y = (np.append(np.where(starts[side], side, mark), mark) for side, mark in ((a, -1), (b, -2)))
    runs = _runs_of_two(x, y, kinds)
    ones = np.flatnonzero(y >= 0)
    ones = np.append(np.sort(y[ones] * (m + 1) + ones), kinds * (m + 1))  # the places of each element of b that starts runs, and an end
    matched, could = 0, min(n, m)
    boxes = [(-could, 0, n, 0, m, runs)]
    while boxes:
        most, alo, ahi, blo, bhi, runs = heappop(boxes)
        could += most
        s, e, d = runs
        s, e = np.maximum(np.maximum(s, alo), blo - d), np.minimum(np.minimum(e, ahi), bhi - d)
        size = e - s
        some = size > 1
        s, e, d, size = s[some], e[some], d[some], size[some]
        i, j, k = alo, blo, 0
        if len(s):
            k = int(size.max())
            i, j = min(zip(s[size == k].tolist(), (s + d)[size == k].tolist()))
        else:
            at, step = alo, 64
            while at < ahi and not k:  # the first element that the other side has in the box
                p = at + np.flatnonzero(x[at : min(ahi, at + step)] >= 0)
                found = ones[np.searchsorted(ones[:-1], x[p] * (m + 1) + blo)]
                hit = np.flatnonzero((found // (m + 1) == x[p]) & (found % (m + 1) < bhi))
                if len(hit):
                    i, j, k = int(p[hit[0]]), int(found[hit[0]] % (m + 1)), 1
                at, step = at + step, step * 8
        back = _equal(a[alo:i][::-1], b[blo:j][::-1])
        i, j, k = i - back, j - back, k + back
        k += _equal(a[i + k : ahi], b[j + k : bhi])
        if not k:
            if under(matched + could):
                return True
            continue
        matched += k
        if not under(matched):
            return False
        for box, inside in (((alo, i, blo, j), (s < i) & (s + d < j)), ((i + k, ahi, j + k, bhi), (e > i + k) & (e + d > j + k))):
            smaller = min(box[1] - box[0], box[3] - box[2])
            if smaller > 0:
                could += smaller
                heappush(boxes, (-smaller, *box, (s[inside], e[inside], d[inside])))
        if under(matched + could):
            return True
    return under(matched)


def _near_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in "ijk"]))
    for batch in batches:
        found = [[dict(zip("ijk", m)) for m in matching(a.as_py() or [], b.as_py() or [])] for a, b in zip(batch.column("a"), batch.column("b"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "found"])


def _markup(x: list[str], y: list[str]) -> str:
    out, i, j = [], 0, 0
    for p, q, n in [*matching(x, y), (len(x), len(y), 0)]:
        out += [f"~~{' '.join(x[i:p])}~~"] * (p > i) + [f'<span style="color:red">{" ".join(y[j:q])}</span>'] * (q > j) + x[p : p + n]
        i, j = p + n, q + n
    return " ".join(out)


def _near_markup(a: pa.Array, b: pa.Array) -> pa.Array:
    # str.split knows the white space of Unicode, as SPACES does.
    return pa.array([None if x is None or y is None else _markup(x.split(), y.split()) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.string())


def near_markup(a: Column, b: Column) -> Column:
    """The markup (see ``word_markup``) of two texts, whose words are matched within their row; null for a null text."""
    return F.arrow_udf(_near_markup, "string")(a, b)


def _edits(x: list[str], y: list[str], most: int) -> str:
    out, i, j = [], 0, 0
    for p, q, n in chain(_in_order(x, y), [(len(x), len(y), 0)]):
        if p > i or q > j:
            old, new = " ".join(x[i:p]), " ".join(y[j:q])
            out.append(f"'{old}' → '{new}'" if p > i and q > j else f"Removed: '{old}'" if p > i else f"Added: '{new}'")
            if len(out) == most:
                break
        i, j = p + n, q + n
    return "; ".join(out)


def _each(a: pa.Array, b: pa.Array, each, kind: pa.DataType) -> pa.Array:
    return pa.array((None if not x.is_valid or not y.is_valid else each(x.as_py(), y.as_py()) for x, y in zip(a, b)), kind)


def near_changes(a: Column, b: Column, most: int = 5) -> Column:
    """The details (see ``word_changes``) of two texts, whose words are matched within their row as far as ``most`` edits go; null for a null text."""

    def details(a: pa.Array, b: pa.Array) -> pa.Array:
        return _each(a, b, lambda x, y: _edits(x.split(), y.split(), most), pa.string())

    return F.arrow_udf(details, "string")(a, b)


def near_verdict(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Whether two texts are less alike than ``threshold`` by their characters (see ``less_alike``), within their row; null for a null text."""

    def verdict(a: pa.Array, b: pa.Array) -> pa.Array:
        return _each(a, b, lambda x, y: alike_below(x, y, threshold), pa.bool_())

    return F.arrow_udf(verdict, "boolean")(a, b)


def are_far(a: Column, b: Column) -> Column:
    """Whether the words of two texts may be beyond ``NEAR``; every second character is a word's at most."""
    places = lambda text: F.floor((F.length(text) + 1) / 2).cast("double")
    return F.coalesce(places(a) * places(b) > NEAR, F.lit(False))


def _too_many(size_a: Column, size_b: Column) -> Column:
    """Whether sequences of these sizes may have more equal places than are judged within a row."""
    places = F.when(size_b < LONG, size_b).otherwise(F.floor(size_b / SHARE) + 1)
    return F.coalesce(size_a.cast("double") * places > NEAR / LETTERS, F.lit(False))


def letters_far(a: Column, b: Column) -> Column:
    """Whether two texts are too long to be judged by their characters within their row."""
    return _too_many(F.length(a), F.length(b))


def _near_verdicts(threshold: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            below = [alike_below(a.as_py() or [], b.as_py() or [], threshold) for a, b in zip(batch.column("a"), batch.column("b"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(below, pa.bool_())], ["key", "below"])

    return each


def compared(words: DataFrame | None, letters: DataFrame | None = None, threshold: float = 0.5) -> tuple[DataFrame | None, DataFrame | None]:
    """``words`` with found, the blocks of each pair in order, and the verdicts on ``letters`` (see ``less_alike``).

    Columns a and b of ``letters`` may be texts instead of arrays. Pairs too long for their row (see ``NEAR``, ``LETTERS``) go
    through their rounds together.
    """

    def parted(pairs: DataFrame | None, beyond) -> tuple[DataFrame, DataFrame] | None:
        if pairs is None:
            return None
        texts = dict(pairs.dtypes)["a"] == "string"
        size = lambda c: F.coalesce((F.length if texts else F.size)(c), F.lit(0))
        far = pairs.filter(beyond(size("a"), size("b"))).select("key", *[(characters(F.col(c)) if texts else F.col(c)).alias(c) for c in ("a", "b")])
        return pairs.filter(~beyond(size("a"), size("b"))).select("key", "a", "b"), far

    worded, lettered = parted(words, lambda p, q: p.cast("double") * q.cast("double") > NEAR), parted(letters, _too_many)
    far = [staged(part[1], "far") if part and not part[1].isEmpty() else None for part in (worded, lettered)]
    blocks_far, below_far = _in_rounds(*far, threshold) if any(f is not None for f in far) else (None, None)
    found = below = None
    if worded:
        kinds = ", ".join(f"`{c}` {t}" for c, t in worded[0].dtypes)
        found = worded[0].mapInArrow(_near_blocks, f"{kinds}, found {FOUND}")
        if blocks_far is not None:
            listed = blocks_far.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "j", "k"))).alias("found"))
            found = found.unionByName(far[0].join(listed.hint("merge"), "key", "left").withColumn("found", F.coalesce("found", F.array().cast(FOUND))))
    if lettered:
        below = lettered[0].mapInArrow(_near_verdicts(threshold), f"key {dict(lettered[0].dtypes)['key']}, below boolean")
        below = below if below_far is None else below.unionByName(below_far)
    return found, below


def blocks(pairs: DataFrame) -> DataFrame:
    """key, i, j and k: ``k`` elements from ``i`` in a equal those from ``j`` in b. pairs: key (distinct), a and b (arrays of strings)."""
    return compared(pairs)[0].select("key", F.explode("found").alias("m")).select("key", "m.*")


def gaps(pairs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """pairs with gaps: in order, what differs before each block (i to ie in a, j to je in b) and the ``k`` equal elements of a behind it.

    ``found`` is ``pairs`` with their blocks (see ``compared``) where these are known.
    """
    j = compared(pairs)[0] if found is None else found
    end = F.struct(F.size("a").alias("i"), F.size("b").alias("j"), F.lit(0).alias("k"))
    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"))
    j = j.withColumn("found", F.concat(F.array(begin), "found", F.array(end)))
    between = lambda p, q: F.struct((p["i"] + p["k"]).alias("i"), q["i"].alias("ie"), (p["j"] + p["k"]).alias("j"), q["j"].alias("je"), q["k"].alias("k"))
    n = F.size("found")
    return j.withColumn("gaps", F.zip_with(F.slice("found", F.lit(1), n - 1), F.slice("found", F.lit(2), n - 1), between)).drop("found")


def _part(side: str, lo: Column, hi: Column) -> Column:
    return F.array_join(F.slice(side, lo + 1, F.greatest(hi - lo, F.lit(0))), " ")


def word_changes(pairs: DataFrame, most: int = 5, found: DataFrame | None = None) -> DataFrame:
    """key and details: the first ``most`` word-level edits from a to b, joined by semicolons; ``found`` as for ``gaps``."""

    def edit(g: Column) -> Column:
        old, new, gone, come = _part("a", g["i"], g["ie"]), _part("b", g["j"], g["je"]), g["ie"] > g["i"], g["je"] > g["j"]
        both = F.concat(F.lit("'"), old, F.lit("' → '"), new, F.lit("'"))
        return F.when(gone & come, both).when(gone, F.concat(F.lit("Removed: '"), old, F.lit("'"))).when(come, F.concat(F.lit("Added: '"), new, F.lit("'")))

    edits = F.filter(F.transform("gaps", edit), lambda t: t.isNotNull())
    return gaps(pairs, found).select("key", F.array_join(F.slice(edits, 1, most), "; ").alias("details"))


def word_markup(pairs: DataFrame) -> DataFrame:
    """key and markup: the words of a, with those that b lacks struck out and those that it has instead in colour."""

    def edit(g: Column) -> Column:
        old, new = F.when(g["ie"] > g["i"], _part("a", g["i"], g["ie"])), F.when(g["je"] > g["j"], _part("b", g["j"], g["je"]))
        kept = F.when(g["k"] > 0, _part("a", g["ie"], g["ie"] + g["k"]))
        return F.array(F.concat(F.lit("~~"), old, F.lit("~~")), F.concat(F.lit('<span style="color:red">'), new, F.lit("</span>")), kept)

    return gaps(pairs).select("key", F.array_join(F.flatten(F.transform("gaps", edit)), " ").alias("markup"))


def _matched(totals: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """key, total and matched: the elements in all blocks found so far."""
    found = _blocks_of(totals.sparkSession, tables)
    sums = totals.select("key", F.lit(0).cast("long").alias("matched")) if found is None else found.groupBy("key").agg(F.sum("k").alias("matched"))
    return totals.join(sums.hint("merge"), "key", "left").select("key", "total", F.coalesce("matched", F.lit(0)).alias("matched"))


def _bounded(pairs: DataFrame, under) -> tuple[list[DataFrame], DataFrame]:
    """What the shorter side's length and the elements common to both sides decide, and the pairs that they do not."""
    total = (F.size("a") + F.size("b")).cast("double")
    sized = pairs.withColumn("total", total).withColumn("verdict", F.when((F.col("total") == 0) | (F.col("a") == F.col("b")), False).when(under(F.least(F.size("a"), F.size("b"))), True))
    open_pairs = sized.filter("verdict IS NULL")
    count = lambda side, n: open_pairs.select("key", F.explode(side).alias("w")).groupBy("key", "w").agg(F.count("*").alias(n))
    common = count("a", "ca").join(count("b", "cb").hint("merge"), ["key", "w"]).groupBy("key").agg(F.sum(F.least("ca", "cb")).alias("common"))
    shared = staged(open_pairs.join(common.hint("merge"), "key", "left").withColumn("verdict", under(F.coalesce("common", F.lit(0)))).drop("common"), "alike")
    decided = [sized.filter("verdict IS NOT NULL").select("key", F.col("verdict").alias("below")), shared.filter("verdict").select("key", F.lit(True).alias("below"))]
    return decided, shared.filter("NOT verdict").select("key", "a", "b")


def less_alike(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """key and below: whether the differ's ratio, twice the matching elements over all elements, is under ``threshold``.

    Bounds decide what they can: the shorter side's length, then what both sides have in common in any order, then after some
    rounds the blocks so far from below, and with all that the boxes left could add from above. Two empty sides have a ratio of 1.
    """
    return compared(None, pairs, threshold)[1]
