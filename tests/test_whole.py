"""Queries over whole inputs: what the oracles' SQL cuts or has no words for."""

from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quire.queries import diff, report, sources, vectors
from quire.sources.seed import frame

DATA = "/root/testdata/sf0.001"


def test_tables_hold_every_part(spark):
    parts = Counter(r.p_brand for r in spark.read.parquet(f"{DATA}/part.parquet").collect())
    assert max(parts.values()) > 1
    got = sources.all_tables(spark, DATA).collect()
    assert len({(r.document_id, r.table_index) for r in got}) == len(got)
    held = Counter()
    for r in got:
        held[r.document_id] += len(r.cells)
        assert len(r.cells) <= 12
    assert held == parts


def test_tables_go_past_twelve_rows(spark, monkeypatch):
    cells = spark.range(1, 31).select(F.lit("B").alias("p_brand"), F.col("id").cast("int").alias("row_no"), F.col("id").alias("p_partkey"), F.col("id").cast("string").alias("p_name"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"))
    monkeypatch.setattr(sources, "frame", lambda *a: cells)
    monkeypatch.setattr(report, "frame", lambda s, d, n: frame(s, DATA, n))
    got = {r.table_index: len(r.cells) for r in sources.all_tables(spark, DATA).collect()}
    assert got == {0: 12, 1: 12, 2: 6}
    assert report._corpus(spark, DATA).filter("chunk_type = 'table'").agg(F.sum("rows")).first()[0] == 30


def words(a, b):
    x, y, out = a.split(), b.split(), []
    for tag, i, j, k, m in SequenceMatcher(None, x, y).get_opcodes():
        old, new = " ".join(x[i:j]), " ".join(y[k:m])
        out += {"equal": [], "replace": [f"'{old}' → '{new}'"], "delete": [f"Removed: '{old}'"], "insert": [f"Added: '{new}'"]}[tag]
    return "; ".join(out[:5])


def test_diff_words_of_every_document(spark, monkeypatch):
    schema = "document_id string, section_hierarchy string, chunk_type string, ord long, page_start int, content string"
    one = [("src1", "1", "text", 1, 1, "the cat sat"), ("src7", "1", "text", 2, 1, "alpha beta gamma"), ("src7", "2", "text", 3, 2, "aaaa bbbb"), ("src9", "1", "text", 4, 1, "same")]
    two = [("src1", "1", "text", 1, 1, "the dog sat"), ("src7", "1", "text", 2, 1, "alpha gamma delta"), ("src7", "2", "text", 3, 2, "zzzz yyyy"), ("src9", "1", "text", 4, 1, "same"), ("src9", "2", "text", 5, 2, "new")]
    monkeypatch.setattr(diff, "frame", lambda s, d, n: s.createDataFrame(one if n == "seed_v1" else two, schema))
    got = {(r.document_id, r.section): (r.significance, r.details) for r in diff.diff_words(spark, DATA).collect()}
    want = {("src9", "2"): ("medium", "New section added: 2")}
    for (d, s, *_, a), (*_, b) in zip(one, two):
        if a != b:
            want[d, s] = ("medium" if SequenceMatcher(None, a, b).ratio() < 0.5 else "low", words(a, b))
    assert got == want and {level for level, _ in got.values()} == {"medium", "low"}


def test_library_search_finds_patterns_only(spark):
    library = {r.vec_id: r.pattern_id for r in vectors._library(spark, DATA).collect()}
    assert sorted(library) == list(range(1, len(library) + 1)) and [library[i] for i in sorted(library)] == sorted(library.values())
    v = {r.vec_id: r for r in vectors.vectors(spark, DATA).select("vec_id", "a", "e").collect()}
    want = {}
    for q in (i for i in v if i % 20 == 0):
        near = sorted((sum((x - y) ** 2 for x, y in zip(v[i].a, v[q].e)), i) for i in library)[:3]
        want |= {(q, n + 1): library[i] for n, (_, i) in enumerate(near)}
    got = {(r.query_id, r.rank): r.pattern_id for r in vectors.library_similar(spark, DATA).collect()}
    assert got == want and len(got) == 3 * sum(i % 20 == 0 for i in v)
    assert vectors.library_context(spark, DATA).filter("abs(confidence_boost - 0.15) < 1e-9").count() * 3 == len(got)
