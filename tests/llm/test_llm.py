"""The training-text operators against brute force, and on nulls, ties, repeats, empty tables and odd columns."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, html_main, language_id, line_dedup, quality_rules, simhash, toxicity, warc, weak_labels, wide_simhash
from quire.llm.queries import op2_byte_bpe, tokenizer

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", 1) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank, long and repeated texts, repeated rows, and columns with clashing names."""
    long = "word " * 30000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 1), (4, long, "en", "s", 1), (4, long, "en", "s", 1), (None, "abc def", "de", "s", 1), (None, None, None, None, None), (5, "123 !!", None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("n_lines", "fingerprint", "score", "h", "idx", "word", "ids", "pos", "fp")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


# Line dedup


def brute_lines(texts, least=50):
    """Every repeated run by comparing all minimal runs; texts by document order."""
    docs = [[(i, u.rstrip()) for i, u in enumerate(re.split(r"\n(?=[^\n]*\S)", t))] for t in texts]
    seen, gone = {}, set()
    for d, lines in enumerate(docs):
        lines = [x for x in lines if x[1]]
        for s in range(len(lines)):
            for e in range(s, min(len(lines), s + least)):
                run = [x[1] for x in lines[s : e + 1]]
                k = [len(x.split()) for x in run]
                if sum(k) >= least and (sum(k[:-1]) < least or sum(k[1:]) < least):
                    first = seen.setdefault(tuple(run), (d, lines[s][0]))
                    if first[0] != d or lines[s][0] >= first[1] + len(run):
                        gone |= {(d, i) for i, _ in lines[s : e + 1]}
    return ["\n".join(u for i, u in enumerate(re.split(r"\n(?=[^\n]*\S)", t)) if (d, i) not in gone) for d, t in enumerate(texts)]


def test_line_dedup(spark):
    random.seed(5)
    lines = [" ".join(f"w{random.randint(0, 40)}" for _ in range(random.randint(1, 25))) for _ in range(12)]
    texts = ["\n".join(random.choice(lines) for _ in range(random.randint(1, 14))) for _ in range(40)]
    texts.append("own text\n\n" + texts[3] + "\nend")
    got = [r.text for r in line_dedup.dedup_lines(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == brute_lines(texts) and got != texts


def test_line_dedup_awkward(spark, awkward, empty):
    got = line_dedup.dedup_lines(awkward)
    assert got.count() == 8 and set(got.columns) == set(awkward.columns) | {"n_dropped"}
    assert [r.text for r in got.filter("doc_id = 1").collect()] == [None]
    assert {(r.n_lines, r.n_dropped) for r in got.filter("doc_id = 4").collect()} == {(1, 0)}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_repeated_rows(spark):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    texts = ["head\n" + passage, "own\n" + passage + "\nend", "alone\nlines"]
    df = frame(spark, texts)
    got = line_dedup.dedup_lines(df.unionByName(df.filter("doc_id <> 1")).unionByName(df.filter("doc_id = 0"))).collect()
    assert len(got) == 6 and {(r.doc_id, r.text) for r in got} == set(enumerate(brute_lines(texts)))
    got = line_dedup.dedup_lines(df.unionByName(df.filter("doc_id = 1"))).collect()
    assert len(got) == 4 and {(r.doc_id, r.text) for r in got} == set(enumerate(brute_lines(texts)))


# Byte-level BPE


def reference_ids(texts):
    import tiktoken

    path, pattern = tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    return [enc.encode_ordinary(t or "") for t in texts]


def test_bpe_round_trip(spark):
    random.seed(1)
    alphabet = "ab Zé1२²½Ⅷ一中　\xa0\n\t\x1c\x85_-'sÀ́🙂ªº…#\r"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(300)] + [None, "it's  we'll <|endoftext|>", "x" * 20000]
    path, pattern = tokenizer()
    got = bpe.decode(bpe.encode(frame(spark, texts), path, pattern, head_docs=100, head_words=20), path).orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == reference_ids(texts)
    assert [bytes(r.decoded) for r in got] == [(t or "").encode() for t in texts]


def test_bpe_awkward(spark, awkward, empty):
    path, pattern = tokenizer()
    got = bpe.encode(awkward, path, pattern)
    assert got.count() == 8 and got.filter("n_tokens = 0").count() == 3
    assert bpe.encode(empty, path, pattern).count() == 0


def test_bpe_splits_by_the_given_pattern():
    assert bpe.FAST_FOR == tokenizer()[1]
    assert bpe._splitter(r"\p{L}|[^\p{L}]")("ab 1") == ["a", "b", " ", "1"]


def test_bpe_long_words_and_repeated_rows(spark):
    long = "averylongseparator" * 30
    texts = [f"{long} own{i} {long} rare{i % 7} {long}" for i in range(40)]
    df = frame(spark, texts)
    path, pattern = tokenizer()
    got = bpe.encode(df.unionByName(df.filter("doc_id < 5")), path, pattern, head_docs=10, head_words=3, head_bytes=200).collect()
    want = reference_ids(texts)
    assert len(got) == 45 and all(np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id] for r in got)


def test_bpe_one_python_step_encodes_and_decodes(spark, tmp_path):
    texts = ["Hello  world 12345", "naïve 😀", "", None]
    path, pattern = tokenizer()
    for columns in (["doc_id", "ids", "decoded"], ["decoded", "doc_id"]):
        got = bpe.encode(frame(spark, texts), path, pattern, decoded=True).select(*columns).collect()
        assert sorted(bytes(r.decoded) for r in got) == sorted((t or "").encode() for t in texts)
    plan = op2_byte_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    steps = [line.count("MapInArrow") for line in plan.splitlines()]
    assert any(steps) and not any(a and b for a, b in zip(steps, steps[1:]))


def test_bpe_decode_awkward(spark):
    path, _ = tokenizer()
    df = spark.createDataFrame([(1, None, "x"), (2, bytearray(b""), "y")], "doc_id long, ids binary, decoded string")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, path).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and bpe.decode(df.limit(0), path).count() == 0


# Quality rules


def test_quality_rules(spark, docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often, cover, seen, dup = Counter(windows), set(), set(), 0
        for i, x in enumerate(windows):
            if often[x] > 1:
                cover.update(range(i, i + 5))
        for line in t.split("\n"):
            if line.strip():
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert tuple(got[r.doc_id][c] for c in quality_rules.BASE) == want
        assert got[r.doc_id].base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and not got[i].base_failed]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(got[i].kept for i in good) >= 0.95 * len(good) and sum(got[i].kept for i in bad) <= 0.2 * len(bad)


def test_quality_rules_awkward(awkward, empty):
    got = quality_rules.judge(awkward).collect()
    assert len(got) == 8 and not any(r.kept for r in got if r.n_words < 10)
    assert quality_rules.judge(empty).count() == 0


def brute_limits(values, unit):
    """Low and high of one group by the rule on bucketed values."""
    step = lambda x: -1 if x < quality_rules.ZERO else int(np.floor(np.log(x / quality_rules.ZERO) / float(np.log1p(quality_rules.WIDTH))))
    value = lambda b: 0.0 if b < 0 else (1 + quality_rules.WIDTH) ** b * quality_rules.ZERO
    n = Counter(map(step, values))
    at, total, upto = sorted(n), len(values), 0
    cum = [upto := upto + n[b] for b in at]
    v = [value(b) for b in at]
    median = next(x for x, c in zip(v, cum) if 2 * c >= total)
    enough = lambda k: max(quality_rules.LEAST_TAIL, quality_rules.TAIL * total) <= k <= quality_rules.MOST_TAIL * total
    wide = lambda gap, reach: gap > quality_rules.GAP * reach and gap > quality_rules.UNITS * unit
    gaps = list(zip(v, v[1:], cum))
    high = [(a + b) / 2 for a, b, c in gaps if a >= median and enough(total - c) and wide(b - a, a - median)]
    low = [(a + b) / 2 for a, b, c in gaps if b <= median and enough(c) and wide(b - a, median - b)]
    return max(low, default=None), min(high, default=None)


def test_quality_thresholds(spark):
    m = quality_rules.metrics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    rows = [r for r in m.collect() if not r.base_failed]
    got = {(r.level, r.lang, r.source): r for r in quality_rules.limits(quality_rules.sketches(m)).collect()}
    found = 0
    for level, key in ((0, lambda r: (0, r.lang, r.source)), (1, lambda r: (1, r.lang, None)), (3, lambda r: (3, None, None))):
        groups = {}
        for r in rows:
            groups.setdefault(key(r), []).append(r)
        assert set(groups) == {k for k in got if k[0] == level}
        for k, group in groups.items():
            assert got[k].n == len(group)
            for ratio, of in quality_rules.RATIOS.items():
                middle = brute_quantile([r[of] for r in group])
                low, high = brute_limits([r[ratio] for r in group], 1 / max(middle, 1))
                for side, want in (("low", low), ("high", high)):
                    have = got[k][f"{side}_{ratio}"]
                    assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-9)
                    found += want is not None
    assert found > 5  # the method sets thresholds on its own
    kept = {r.doc_id: r for r in quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [i for i in labels if not kept[i].base_failed]
    assert np.mean([kept[i].kept for i in judged if labels[i] == 1]) >= 0.99 and np.mean([kept[i].kept for i in judged if labels[i] == 0]) <= 0.1


def brute_quantile(values):
    """The median as the sketch gives it: the lower edge of the bucket in which it lies."""
    b = sorted(-1 if x < quality_rules.ZERO else int(np.floor(np.log(x / quality_rules.ZERO) / float(np.log1p(quality_rules.WIDTH)))) for x in values)
    b = b[(len(b) + 1) // 2 - 1]
    return 0.0 if b < 0 else (1 + quality_rules.WIDTH) ** b * quality_rules.ZERO


# WARC


def test_revisits(spark):
    schema = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, payload string"
    day = 86_400
    rows = [
        (1, "response", "http://www.A.com/x/", 10, "e1", None, {"etag": "e1", "content-length": "5", "server": "s"}, "one"),
        (2, "response", "https://a.com:443/x#top", 20, "e2", "d2", {"etag": "e2", "content-length": "6", "server": "s"}, "two"),
        (3, "revisit", "http://a.com/x?utm_source=f", 9 * day, "e2", None, {"date": "now", "content-length": "0"}, None),
        (4, "revisit", "http://a.com/x", 15, "e1", None, {}, None), (5, "revisit", "http://a.com/x", 5, "e1", None, {}, None),
        (6, "revisit", "http://a.com/x", 30, "e1", "d2", {}, None), (7, "revisit", "http://a.com/x", 31, None, None, None, None),
        (8, "revisit", None, None, None, None, None, None), (9, "metadata", None, None, None, None, None, "m"), (10, "revisit", "http://a.com/x", 32, None, "d2", {}, None),
    ]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert {i: (r.status, r.refers_to) for i, r in got.items() if i > 2} == {
        3: ("resolved", 2), 4: ("resolved", 1), 5: ("missing", None), 6: ("mismatch", None), 7: ("mismatch", None), 8: ("missing", None), 9: ("other", None), 10: ("resolved", 2),
    }
    assert got[3].payload == "two" and got[3].headers == {"etag": "e2", "content-length": "6", "server": "s", "date": "now"} and got[9].payload == "m"
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_revisits_awkward(spark):
    schema = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, payload string, _status string, _id int, canonical string, row int, key int, found int"
    more = ("s", 1, "c", 1, 1, 1)
    long = "x" * 500_000
    rows = [
        (None, "response", "http://a.com/x", 10, "e1", None, {"server": "s"}, long, *more), (None, "revisit", "http://a.com/x", 20, "e1", None, {}, None, *more),
        (5, "revisit", "http://a.com/x", 30, "e1", None, None, None, *more), (5, "revisit", "http://a.com/x", 30, "e1", None, None, None, *more), (5, "revisit", "http://b.com/x", 30, "e1", None, {}, "own", *more),
        (7, "response", "http://c.com/", 40, "e", None, {}, "two", *more), (7, "response", "http://c.com/", 40, "e", None, {}, "two", *more), (8, "revisit", "http://c.com", 41, "e", None, {}, None, *more),
        (None, None, None, None, None, None, None, None, *more), (9, "revisit", "http://a.com/x", None, "e1", None, {}, None, *more),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, schema))
    assert set(got.columns) == {x.split(" ")[0] for x in schema.split(", ")} | {"status", "refers_to"}
    seen = Counter((r.record_id, r.kind, r.status, r.refers_to, len(r.payload or ""), r.canonical, r._status) for r in got.collect())
    assert seen == Counter({
        (None, "response", "full", None, 500_000, "a.com/x", "s"): 1, (None, "revisit", "resolved", None, 500_000, "a.com/x", "s"): 1, (5, "revisit", "resolved", None, 500_000, "a.com/x", "s"): 2,
        (5, "revisit", "missing", None, 3, "b.com/x", "s"): 1, (7, "response", "full", None, 3, "c.com", "s"): 2, (8, "revisit", "resolved", 7, 3, "c.com", "s"): 1,
        (None, None, "other", None, 0, None, "s"): 1, (9, "revisit", "missing", None, 0, "a.com/x", "s"): 1,
    })


def test_revisits_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["response", "revisit", "revisit"]), f"http://a.com/{rng.randint(0, 3)}", rng.randint(0, 40) * 700, rng.choice(["e1", "e2", None]), rng.choice(["d1", "d2", None]), {"n": str(i)}, f"p{i}") for i in range(300)]
    schema = "record_id long, kind string, url string, ts long, etag string, last_modified string, headers map<string,string>, payload string"
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    for i, kind, url, ts, tag, date, _, own in rows:
        if kind == "response":
            continue
        last = max((r for r in rows if r[1] == "response" and r[2] == url and (r[3], r[0]) < (ts, i)), key=lambda r: (r[3], r[0]), default=None)
        both = [] if last is None else [a == b for a, b in ((tag, last[4]), (date, last[5])) if a and b]
        want = "missing" if last is None else "resolved" if both and all(both) else "mismatch"
        assert (got[i].status, got[i].refers_to, got[i].payload) == (want, last[0] if want == "resolved" else None, last[7] if want == "resolved" else own)


# Quality classifier


def test_weak_labels(spark, docs, awkward, empty):
    got = {r.doc_id: r for r in weak_labels.classify(docs).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].kept for i, q in labels.items() if q == 1]) >= 0.95
    assert np.mean([got[i].kept for i, q in labels.items() if q == 0]) <= 0.5
    assert weak_labels.classify(awkward).count() == 8 and weak_labels.classify(empty).count() == 0


def test_em_recovers_the_labellers():
    rng = np.random.default_rng(11)
    k, n = len(weak_labels.LABELLERS), 20_000
    alarm = np.stack([rng.uniform(0.005, 0.06, k), rng.uniform(0.2, 0.7, k)], axis=1)
    bad = rng.random(n) < 0.2
    votes = np.where(rng.random((n, k)) < alarm[:, 1] * bad[:, None] + alarm[:, 0] * ~bad[:, None], weak_labels.BAD, weak_labels.GOOD)
    votes[rng.random((n, k)) < 0.25] = weak_labels.NONE
    codes = (votes * 3 ** np.arange(k)).sum(axis=1)
    prior, found, posterior = weak_labels.estimate(Counter(codes.tolist()))
    assert abs(prior - 0.8) < 0.02 and np.abs(found - alarm).max() < 0.05
    assert np.mean([(posterior[c] < 0.5) == b for c, b in zip(codes.tolist(), bad)]) > 0.95


def test_em_of_real_labellers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [(weak_labels.vote((r.text or "").encode()), labels.get(r.doc_id)) for r in docs.select("doc_id", "text").collect()]
    _, alarm, _ = weak_labels.estimate(Counter(c for c, _ in rows))
    votes = np.array([[c // 3**i % 3 for i in range(len(weak_labels.LABELLERS))] for c, _ in rows])
    for k, quality in enumerate((1, 0)):
        own = votes[[q == quality for _, q in rows]]
        true = (own == weak_labels.BAD).sum(axis=0) / np.maximum((own != weak_labels.NONE).sum(axis=0), 1)
        assert np.abs(alarm[:, k] - true).max() < (0.03 if quality else 0.2)


# SimHash


def test_count_past():
    rng = np.random.default_rng(0)
    for radius in (0, 1, 2, 3, 5):
        values = rng.integers(0, 2**64, 200, np.uint64) & rng.integers(0, 2**64, 200, np.uint64) & rng.integers(0, 2**64, 200, np.uint64) & rng.integers(0, 2**64, 200, np.uint64)
        past = np.zeros(200, bool)
        past[simhash.lanes_of(simhash.count_past(simhash.to_planes(values), radius), 200)] = True
        assert (past == (np.bitwise_count(values) > radius)).all()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_links_connect_what_is_near(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << i for i in rng.sample(range(20), rng.randint(0, 3))) for b in base for _ in range(60)}
    monkeypatch.setattr(simhash, "MAX_BLOCK", 30)  # so that blocks are keyed again
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    signed = sorted(simhash._signed(v) for v in values)
    parent, u = {v: v for v in signed}, np.array(signed, np.int64).view(np.uint64)
    for i, a in enumerate(signed):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 2):
            x, y = find(parent, a), find(parent, signed[j])
            parent[max(x, y)] = min(x, y)
    assert all(got.get(v, v) == find(parent, v) for v in signed)


@pytest.mark.parametrize("radius", [2, 6])
def test_components_end_to_end(spark, radius):
    rng = random.Random(radius)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(120)] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(5):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "edit"
            texts.append(" ".join(own))
    texts += [None, "", "alone"]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts), radius=radius).collect()}
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]
    parent = {i: i for i in range(len(texts))}
    for i in parent:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    assert {i: r.component_id for i, r in got.items()} == {i: find(parent, i) for i in parent}
    assert len(set(r.component_id for r in got.values())) < len(texts) - 10


def test_fingerprint(spark, docs, awkward, empty):
    def slow(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        n = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * n[b] > len(sh))

    got = simhash.near_duplicates(docs.limit(40)).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(int(r.fingerprint, 16) == slow(r.text) for r in got)
    odd = simhash.near_duplicates(awkward).collect()
    assert len(odd) == 8 and {r.component_id for r in odd if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_representatives(awkward).count() == len({r.component_id for r in odd})


# Language ID


def test_language_id(docs, awkward, empty):
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    odd = language_id.identify(awkward).collect()
    assert len(odd) == 8 and all(r.lang_pred == "und" and r.rejected for r in odd if r.doc_id in (1, 2, 3, 5))
    assert language_id.identify(empty).count() == 0
    assert language_id.keep_identified(docs).count() == docs.count() and language_id.keep_identified(docs).columns == docs.columns


def test_language_clusters_are_no_outliers():
    rng = np.random.default_rng(3)
    x = np.abs(np.concatenate([rng.normal(0, 0.1, (60, 8)) + [1, 0, 0, 0, 0, 0, 0, 0], rng.normal(0, 0.1, (40, 8)) + [0, 1, 0, 0, 0, 0, 0, 0], np.eye(8)[5:]]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sizes = np.bincount(np.argmax(x @ language_id.cluster(x, 4).T, axis=1))
    assert len(sizes) > 1 and sizes.min() >= language_id.LEAST


def test_unlearned_languages_are_rejected(spark):
    rng = random.Random(6)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 1500").select("doc_id", "text", "lang")
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (40, 40, 80, 80, 150, 150)]
    odd = letters + [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        " ".join("%08x" % rng.getrandbits(32) for _ in range(100)), "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    ]
    model = language_id.fit(docs.filter("crc32(cast(doc_id as string)) % 3 != 1"))
    got = language_id.predict(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert [r.doc_id for r in got if not r.rejected] == []
    held = language_id.predict(docs.filter("crc32(cast(doc_id as string)) % 3 = 1 AND lang IS NOT NULL AND text IS NOT NULL"), model).collect()
    assert len(held) > 300 and np.mean([r.rejected for r in held]) < 0.005


# Toxicity


def test_toxicity(spark, awkward, empty):
    rng = random.Random(4)
    plain = lambda: " ".join("".join(rng.choices("abcdefgh", k=3)) for _ in range(60))
    rows, labels = [], []
    for i in range(1200):
        bad = i % 10 == 0
        rows.append((i, plain() + (" nasty vile" if bad else ""), "en", "s", 1))
        if bad and i % 20 == 0 or i % 7 == 0:
            labels.append((i, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(spark.createDataFrame(rows, DOCS), lab, 0.08).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1200 and np.mean([r.predicted == (r.doc_id % 10 == 0) for r in held]) > 0.97
    assert toxicity.toxicity(awkward, lab).count() == 8 and toxicity.toxicity(empty, lab).count() == 0
    assert toxicity.toxicity(awkward, lab.limit(0)).filter("predicted = 1").count() == 0


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.toxicity(docs, labels.unionByName(labels.limit(500))).filter("held_out").join(labels, "doc_id").collect()
    toxic, other = ([r.predicted for r in held if r.toxic == t] for t in (1, 0))
    assert len(toxic) > 80 and np.mean(toxic) >= 0.9 and np.mean(other) <= 0.01


# Decontamination


def test_decontamination(spark, awkward, empty):
    rng = random.Random(9)
    word = lambda: rng.choice("aa bb cc dd ee ff gg é".split())
    bench = [" ".join(word() for _ in range(n)) for n in (12, 10, 3, 25)] + [None, "", "..."]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [bench[3].upper().replace(" ", ", "), "x " + bench[0] + " y", None, ""]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, texts), items(spark, *bench)).collect()}
    for i, t in enumerate(texts):
        w, hit, ids = split(t), set(), set()
        for k, b in enumerate(map(split, bench)):
            for s in range(max(1, len(b) - 9) if b else 0):
                g = b[s : s + 10]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        ids.add(str(k))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    assert decontaminate.decontaminate(awkward, items(spark, *bench)).count() == 8
    assert decontaminate.decontaminate(empty, items(spark, *bench)).count() == 0
    assert decontaminate.decontaminate(awkward, items(spark).limit(0)).filter("contaminated").count() == 0
    assert decontaminate.drop_contaminated(awkward, items(spark, *bench)).count() == 8


# HTML


@pytest.mark.parametrize("a, b", [([1, 2, 3, 4], [1, 9, 3, 4]), ([1, 2, 1, 2, 3], [2, 1, 3, 2]), ([], [1]), ([5, 5, 6], [5, 6, 5])])
def test_shared_lines(a, b):
    def longest(x, y):
        return max(longest(x[1:], y[1:]) + 1 if x and y and x[0] == y[0] else 0, longest(x[1:], y) if x else 0, longest(x, y[1:]) if y else 0)

    assert len(html_main.shared(a, b)) == longest(a, b)


def test_main_text(spark):
    page = "<html><head><title>T</title></head><body><header>Site</header><nav><a>Menu</a></nav><div class='cookie-notice'>We use cookies</div>{}<aside>Side</aside><div id='comments'><p>Nice!</p></div><footer>&copy; X</footer></body></html>"
    pages = [
        (1, "http://a.com/p/1", page.format("<article><header><h1>One</h1></header><p>Al<b>p</b>ha &amp; beta<br>gamma<script>x('</p>')</script></p><div class=share>Share</div></article>")),
        (2, "http://a.com/p/21", page.format("<div><p>Slogan</p><p>Only   two</p></div>")), (3, "http://a.com/p/22", page.format("<div><p>Slogan</p><p>Only three</p></div>")),
        (4, "http://a.com/p/1", page.format("<article><h1>One</h1><p>Alpha</p></article>")), (5, None, None), (6, "http://b.com", ""), (6, "http://b.com", ""),
    ]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_main.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect())
    assert [t for _, t, _ in got] == ["One Alpha & beta gamma", "Only two", "Only three", "One Alpha", "", "", ""] and all(n == len(t) for _, t, n in got)


def test_main_text_outside_a_teaser(spark):
    page = "<body><article><p>Teaser {0}</p></article><div><p>Slogan</p><p>Body {0}</p></div></body>"
    pages = [(i, f"http://a.com/p/{i}", page.format(i)) for i in (1, 2)]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "Teaser 1 Body 1", 2: "Teaser 2 Body 2"}


def test_main_text_of_copies(spark):
    page = "<body><div><p>Slogan</p><p>Body one</p><p>Body two</p></div></body>"
    pages = [(1, "http://a.com/p/1", page), (2, "http://a.com/p/2", page), (3, "http://a.com/p/2b", "<body><div><p>Slogan</p><p>Other</p></div></body>")]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    # The page beyond the copy is the neighbour of both.
    assert got == {1: "Body one Body two", 2: "Body one Body two", 3: "Other"}


def page_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_ends(spark):
    page = "<body><article><p>Share this</p><p>{0}</p><p>Same words</p><p>end {0}</p><p>Subscribe</p></article></body>"
    pages = page_frame(spark, [(i, f"http://a.com/p/{i}", page.format(f"text {i}")) for i in range(4)])
    plain, cut = ({r.page_id: r.text for r in html_main.main_text(pages, ends).collect()} for ends in (False, True))
    assert plain[1] == "Share this text 1 Same words end text 1 Subscribe" and cut[1] == "text 1 Same words end text 1"
    assert cut[0] == plain[0]  # one neighbour only
    alone = html_main.main_text(pages.filter("page_id = 1"), True).collect()
    assert [r.text for r in alone] == [plain[1]]


def lcs(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for a in range(len(x)):
        for b in range(len(y)):
            t[a + 1][b + 1] = t[a][b] + 1 if x[a] == y[b] else max(t[a][b + 1], t[a + 1][b])
    return t[-1][-1]


def test_main_text_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(html_main, "BLOCK_PAGES", 7)
    rng = random.Random(12)
    pages = []
    for i in range(60):
        own = [f"page{i}line{j}" if rng.random() < 0.6 else f"slogan{rng.randint(0, 3)}" for j in range(rng.randint(1, 12))]
        if i and rng.random() < 0.15:
            own = pages[-1][3]
        pages.append((i, f"http://h{i % 2}.com/d{rng.randint(0, 3)}/{rng.randint(0, 99)}", "<body><nav>Menu</nav>" + "".join(f"<p>{x}</p>" for x in own) + "</body>", own))
    got = {r.page_id: r.text.split() for r in html_main.main_text(page_frame(spark, [p[:3] for p in pages])).collect()}
    host, path = lambda u: u.split("/")[2], lambda u: u.split(".com")[1]
    order = sorted(pages, key=lambda p: (host(p[1]), path(p[1]), p[0]))
    differs = 0
    for k, (i, url, _, own) in enumerate(order):
        if any(p[3] == own and p[0] != i for p in pages):
            continue  # copies at a block's end may lack a neighbour
        beside = [next((p for p in side if host(p[1]) == host(url)), None) for side in (order[:k][::-1], order[k + 1 :])]
        beside = sorted((p for p in beside if p), key=lambda p: -len(os.path.commonprefix([path(p[1]), path(url)])))
        proper = [p[3] for p in beside if lcs(own, p[3]) < html_main.COPY * len(own)]
        kept, it = got[i], iter(own)
        assert all(x in it for x in kept)
        gone = Counter(own) - Counter(kept)
        assert len(own) - len(kept) == (lcs(own, proper[0]) if proper else 0) and (not gone or gone <= Counter(proper[0]))
        differs += len(kept) < len(own)
    assert differs > 10


def test_main_text_awkward(spark):
    df = page_frame(spark, [(None, None, None), (1, "", "<p>a</p>"), (1, "", "<p>a</p>"), (2, "http://a.com/" + "x" * 5000, "<p>" + "word " * 200_000 + "</p>"), (3, "http://a.com/t", "<p>tie</p>"), (4, "http://a.com/t", "<p>tie</p>")])
    got = html_main.main_text(df.withColumns({c: F.lit(1) for c in ("block", "path", "z", "ids", "key", "ends", "before")})).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 999_999), (3, 3), (4, 3)]
    assert html_main.main_text(df.limit(0)).count() == 0


def test_alignment_in_halves(monkeypatch):
    rng = random.Random(3)
    cases = [([rng.randint(0, 4) for _ in range(rng.randint(0, 12))], [rng.randint(0, 4) for _ in range(rng.randint(0, 12))]) for _ in range(400)]
    whole = [len(html_main.shared(a, b)) for a, b in cases]
    monkeypatch.setattr(html_main, "CELLS", 10)
    for (a, b), n in zip(cases, whole):
        found, it = sorted(html_main.shared(a, b)), iter(b)
        assert len(found) == n and all(a[i] in it for i in found)


# SimHash by similarity


def bits_apart(a, b):
    return int(np.bitwise_count(a ^ b).sum())


def alike(a, b):
    a, b = (set(zip(*[t.split()[k:] for k in range(5)])) for t in (a, b))
    return len(a & b) / len(a | b)


def test_wide_signature():
    rng = random.Random(4)
    words = [rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(9000)]  # more shingles than one step
    text = " ".join(words).encode()
    slow = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(len(words) - 4)}
    assert wide_simhash.shingles(text).tolist() == sorted(slow)
    h = np.array(sorted(slow), np.uint64)
    spread = [[int(x) for x in wide_simhash.mix(h ^ c)] for c in wide_simhash.SPREAD]
    fp, keys = wide_simhash.signature(text)
    assert [int(x) for x in fp] == [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in column) > len(h)) for column in spread]
    again = wide_simhash.signature(b"  " + text.upper().replace(b" ", b"\n\t "))
    assert (again[0] == fp).all() and (again[1] == keys).all() and len(set(keys.tolist())) == wide_simhash.BANDS
    assert not any(x.any() for x in wide_simhash.signature(b" \n")) and len(wide_simhash.shingles(b"a b c")) == 1


def test_wide_links(spark):
    """Within a block all that lie within the radius are connected, in small blocks and in large ones."""
    rng, rows = np.random.default_rng(3), {}
    for key, size in enumerate((1, 2, 9, 23, 24, 70, 300)):
        base = rng.integers(0, 2**64, (3, wide_simhash.WORDS), np.uint64)
        for i in range(size):
            flips = np.packbits(rng.random((wide_simhash.WORDS, 64)) < 0.09, axis=1).view(np.uint64)[:, 0]
            rows[(base[i % 3] ^ flips).tobytes()] = key
    df = spark.createDataFrame([(k, [v]) for k, v in rows.items()], "fp binary, keys array<long>")
    got = {bytes(r.node): bytes(r.root) for r in simhash.components(wide_simhash.links(df)).collect()}
    parent = {k: k for k in rows}
    fps = {k: np.frombuffer(k, np.uint64) for k in rows}
    for a in rows:
        for b in rows:
            if a < b and rows[a] == rows[b] and bits_apart(fps[a], fps[b]) <= wide_simhash.RADIUS:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    assert all(got.get(k, k) == find(parent, k) for k in rows)
    assert 20 < len({find(parent, k) for k in rows}) < len(rows) - 100


@pytest.mark.parametrize("most", [512, 8])
def test_near_copies_by_similarity(spark, monkeypatch, most):
    """Pairs of similarity 0.8 and more are found (at 8, through blocks keyed again), and texts without a near copy stay."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts, copied = [], set()
    for n in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        for copy in range((1, 1, 4)[n % 3] + 40 * (n == 2)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 80)) if copy else 0):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            copied |= {n} if copy else set()
            texts.append((n, " ".join(own)))
    monkeypatch.setattr(wide_simhash, "MAX_BLOCK", most)
    df = frame(spark, [t for _, t in texts])
    got = {r.doc_id: r.component_id for r in wide_simhash.near_copies(df).collect()}
    pairs = [(i, j) for i, (m, t) in enumerate(texts) for j, (n, u) in enumerate(texts[:i]) if m == n and alike(t, u) >= 0.8]
    found = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 200 and found >= 0.95 * len(pairs)
    assert all(texts[i][0] == texts[root][0] for i, root in got.items())  # no text joins another one's copies
    kept = {r.doc_id for r in wide_simhash.keep_representatives(df).collect()}
    assert kept == set(got.values()) and {i for i, (n, _) in enumerate(texts) if n not in copied} <= kept


def test_wide_awkward(spark, awkward, empty):
    odd = wide_simhash.near_copies(awkward).collect()
    assert len(odd) == 8 and sorted(str(r.component_id) for r in odd) == ["1", "1", "1", "1", "4", "4", "5", "None"]
    kept = wide_simhash.keep_representatives(awkward)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "None"]
    assert wide_simhash.near_copies(empty).count() == wide_simhash.keep_representatives(empty).count() == 0


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    langs = {r.doc_id for r in language_id.identify(spark.read.parquet(f"{DATA}/documents.parquet")).filter("NOT rejected").collect()}
    ids = sorted(langs)
    cut = brute_lines([docs[i].text or "" for i in ids])
    left = {i: t for i, t in zip(ids, cut) if t.strip() or t == (docs[i].text or "")}
    signed = {i: wide_simhash.signature(t.encode()) for i, t in left.items()}
    parent = {i: i for i in left}
    for i in left:
        for j in left:
            if i < j and (signed[i][1] == signed[j][1]).any() and bits_apart(signed[i][0], signed[j][0]) <= wide_simhash.RADIUS:
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if parent[i] == i}
    rows = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    leaks = {r.doc_id for r in decontaminate.decontaminate(rows, spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("contaminated").collect()}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items() if i not in leaks}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]


def test_pipeline_stages_awkward(spark, awkward, empty):
    import corpus_pipeline

    clash = awkward.drop("n_lines", "fingerprint", "score").withColumns({c: F.lit(7) for c in ("lang_pred", "rejected", "_h", "_key", "n_hit", "root")})
    for name, apply in corpus_pipeline.STAGES:
        for df in (clash, empty):
            out = apply(spark, df, DATA)
            rows = out.collect()
            assert name == "byte_bpe" or out.columns == df.columns
            assert len(rows) <= df.count()
            assert name == "language_id" or (len(rows) > 0) == (df is clash)  # so small a table teaches no language
