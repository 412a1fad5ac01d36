"""Exact expectations on literal rows."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.operators import chunking, crossref, diff, language, report, severity, state, tables, triage, vectors
from quire.sources import extract


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("text, fixed, n", [("Teh TEH teh tehx", "The THE the tehx", 3), ("", "", 0), ("recieve Wich", "receive Which", 2)])
def test_spelling(spark, text, fixed, n):
    t, c = language.spelling(F.col("t"))
    assert one(spark, t, t=text) == fixed
    changes = one(spark, c, t=text)
    assert len(changes) == n
    if n == 3:
        assert [x.position for x in changes] == [8, 4, 0]


@pytest.mark.parametrize("apply, text, fixed, conf", [
    (language.grammar_spaces, "page  1", "page 1", 1.0), (language.grammar_punctuation, "frequency.The", "frequency. The", 0.9),
    (language.style_ranges, "4 - 0", "4-0", 0.85), (language.style_ranges, "25519\n- 512", "25519\n- 512", None),
])
def test_grammar_and_style(spark, apply, text, fixed, conf):
    t, c = apply(F.col("t"))
    assert one(spark, t, t=text) == fixed
    assert [x.confidence for x in one(spark, c, t=text)] == ([conf] if conf else [])


def test_confidence(spark):
    chunks = spark.createDataFrame([("d", "a", "fine"), ("d", "b", "teh"), ("d", "c", "x  " * 11 + "x"), ("d", "n", None)], "document_id string, chunk_id string, content string")
    got = {r.chunk_id: r.confidence for r in language.review(chunks).collect()}
    assert got == {"a": 1.0, "b": 0.95, "c": 0.92, "n": 1.0}


def test_markup_and_idempotence(spark):
    chunks = spark.createDataFrame([("d", "a", "see teh  page"), ("d", "b", " ".join(["teh"] * 12))], "document_id string, chunk_id string, content string")
    got = {r.chunk_id: r for r in language.markup(language.review(chunks)).collect()}
    assert '~~teh~~ <span style="color:red">the</span>' in got["a"].markup and got["b"].markup.startswith("~~teh")
    again = language.review(spark.createDataFrame([("d", r.chunk_id, r.reviewed_content) for r in got.values()], "document_id string, chunk_id string, content string"))
    assert again.filter("size(changes) > 0").count() == 0


def test_fixed_chunks(spark):
    text = "a" * 800 + "\n\n" + "b" * 800 + "\n\n" + "c" * 100
    pieces = one(spark, chunking.fixed_pieces(F.col("t"), 1500, 200), t=text)
    assert [len(p) for p in pieces] == [800, 200 + 2 + 800 + 2 + 100]
    assert all(p in "\n\n".join(pieces) for p in text.split("\n\n"))


def test_semantic_chunks_keep_every_paragraph(spark):
    paragraphs = [f"{i}.1 Heading {i}" if i % 3 == 0 else f"Sentence {i}. " * 40 for i in range(12)]
    pieces = one(spark, chunking.semantic_pieces(F.col("t"), 500, 2500, 200), t="\n\n".join(paragraphs))
    assert len(pieces) > 1 and all(any(p.strip() in x for x in pieces) for p in paragraphs)


def fixed_by_hand(text, size, overlap):
    cur, out = "", []
    for p in text.split("\n\n"):
        if cur and len(cur) + len(p) > size:
            out.append(cur.strip())
            cur = cur[-overlap:] + "\n\n" + p
        else:
            cur = f"{cur}\n\n{p}" if cur else p
    return out + ([cur.strip()] if cur.strip() else [])


def test_fixed_chunks_by_hand(spark):
    """More pieces than a list takes at a time, empty paragraphs at the ends and between, and texts without any piece."""
    rng = random.Random(1)
    texts = ["", "\n\n\n\n", " \n\n ", "x"] + ["\n\n".join("ab c"[: rng.randint(0, 4)] * rng.randint(0, 4) for _ in range(n)) for n in (5, 50, 700, 3000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.fixed_pieces(F.col("t"), 20, 5)).collect()
    assert {i: p for i, p in got} == {i: fixed_by_hand(t, 20, 5) for i, t in enumerate(texts)}
    assert max(len(p) for _, p in got) > 3 * chunking.BLOCK


@pytest.mark.parametrize("strategy", ["fixed", "semantic"])
def test_chunks_of_a_long_text(spark, strategy):
    """No paragraph of a long text is lost, and other columns stay as they are."""
    text = "\n\n".join(f"paragraph {i} of a long text." for i in range(8000))
    chunks = spark.createDataFrame([("c", "text", text, 7, "kept"), ("t", "table", text, 7, "kept"), ("s", "text", "short", 7, None), ("n", "text", None, 7, None)], "chunk_id string, chunk_type string, content string, sub_chunk int, other string")
    out = chunking.split_chunks(chunks, replace(DEFAULT, chunking_strategy=strategy)).collect()
    assert {int(n) for r in out if r.chunk_id.startswith("c_sub_") for n in re.findall(r"paragraph (\d+) of", r.content)} == set(range(8000))
    assert sorted(r.sub_chunk for r in out if r.chunk_id.startswith("c_sub_")) == list(range(len(out) - 3)) and len(out) > 100
    assert {(r.chunk_id, r.content, r.sub_chunk, r.other) for r in out if not r.chunk_id.startswith("c_")} == {("t", text, None, "kept"), ("s", "short", None, None), ("n", None, None, None)}


@pytest.mark.parametrize("number, targets, want, conf", [
    ("5", ["5.0"], "5.0", 0.98), ("10", ["1"], "1", 0.97), ("3.1.5", ["3", "3.1"], "3.1", 0.9), ("3-4", ["3"], "3", 0.85), ("3-4", ["34"], "34", 0.8),
    ("12", ["21"], "21", 0.7), ("12", ["13"], "13", 0.7), ("12", ["7"], None, 0.0), ("7", ["7"], "7", 1.0),
])
def test_fuzzy_match(spark, number, targets, want, conf):
    refs = spark.createDataFrame([("r", "section", number)], "ref_id string, reference_type string, target_number string")
    known = spark.createDataFrame([("section", t) for t in targets], "ref_type string, target string")
    r = crossref.validate(refs, known).first()
    assert (r.target_id, r.confidence, r.is_valid) == (want and f"section_{want}", conf, want is not None)


def test_references_overlap(spark):
    c = spark.createDataFrame([("d", "c", 1, "Figure 3-3")], "document_id string, chunk_id string, page_start int, content string")
    assert [r.target_number for r in crossref.extract_references(c).orderBy("pattern_no").collect()] == ["3-3", "3"]


def test_table_issues(spark):
    few = one(spark, tables.table_issues(F.col("t"), F.lit(0)), t="[Table 1]\n| a |\n| --- |")
    assert [(i.description, i.severity) for i in few] == [("Table has insufficient rows", "high")]
    gaps = one(spark, tables.table_issues(F.col("t"), F.lit(0)), t="[Table 1]\n| a | b | c |\n| --- | --- | --- |\n| a |  | b |")
    assert [(i.description, i.row, i.col) for i in gaps] == [("Empty cell detected", 2, 1), ("Inconsistent spacing detected", 2, None)]


def test_figure_numbering(spark):
    got = one(spark, tables.figure_issues(F.col("t"), F.lit("cap"), F.lit(20000), F.lit(0)), t="[Figure 2]")
    assert [i.issue_type for i in got] == ["formatting"]


def test_alignment(spark):
    v = lambda *rows: spark.createDataFrame([("d", s, c, 1, i, "text") for i, (s, c) in enumerate(rows)], "document_id string, section_hierarchy string, content string, page_start int, ord int, chunk_type string")
    got = diff.align_sections(v(("A", "x"), ("B", "y")), v(("B", "z"), ("C", "w"))).orderBy("section").collect()
    assert [(r.section, r.change_type) for r in got] == [("A", "removed"), ("B", "modified"), ("C", "added")]
    assert one(spark, diff.important(F.lit("voltage 3.3"), F.col("t")), t="voltage 3.6")
    same = diff.changes(diff.align_sections(v(("A", "x y z")), v(("A", "x q z")))).first()
    assert (same.significance, same.details) == ("low", "'y' → 'q'")


def test_greedy_alignment_is_one_to_one(spark):
    v1 = spark.createDataFrame([("d", 1, [1.0, 0.0]), ("d", 2, [1.0, 0.1])], "document_id string, id1 long, e1 array<double>")
    v2 = spark.createDataFrame([("d", 7, [1.0, 0.0]), ("d", 8, [0.0, 1.0])], "document_id string, id2 long, e2 array<double>")
    got = {(r.id1, r.id2) for r in diff.align_greedy(v1, v2).collect()}
    assert got == {(1, 7), (2, None), (None, 8)}


@pytest.mark.parametrize("a, r, same, source, conf", [
    (0.8, 0.6, True, "hybrid_agreement", 0.77), (0.95, 0.5, False, "api_high_confidence", 0.95), (0.85, 0.95, False, "rule_high_confidence", 0.95), (0.7, 0.7, False, "needs_human", 0.5), (0.85, 0.5, False, "hybrid_moderate", 0.675),
])
def test_merge(spark, a, r, same, source, conf):
    api = spark.createDataFrame([("c", "s", a, "api")], "chunk_id string, suggestion string, confidence double, source string")
    queue = spark.createDataFrame([("c", "s" if same else "t", r)], "chunk_id string, rule_suggestion string, rule_confidence double")
    got = triage.merge(api, queue).first()
    assert got.source == source and abs(got.confidence - conf) < 1e-9 and (got.suggestion is None) == (source == "needs_human")


def test_failing_client_falls_back(spark):
    queue = spark.createDataFrame([("c", "text", "high", "rule", 0.4)], "chunk_id string, content string, lane string, rule_suggestion string, rule_confidence double")

    def broken():
        def call(batch):
            raise RuntimeError("down")

        return call

    got = triage.call_in_batches(queue, broken).first()
    assert (got.suggestion, got.source) == ("rule", "rule_fallback")


def test_retrying():
    tries, pauses = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise ValueError
        return "ok"

    assert triage.retrying(call, sleep=pauses.append)() == "ok" and pauses == [2.0, 4.0]


def test_severity_demo(spark):
    rows = [
        ("grammar", "Double space removed", 1.0, None), ("crossref", "Broken reference", 0.9, False), ("llm_suggestion", "Improved clarity", 0.9, None),
        ("style", "Inconsistent terminology", 0.9, None), ("spelling", "Fixed typo", 0.95, None),
    ]
    c = severity.classify(spark.createDataFrame([(i, "k", "o", "c", *r) for i, r in enumerate(rows)], "ord int, key string, original string, corrected string, type string, reason string, confidence double, valid boolean"))
    b = severity.buckets(c).first()
    assert (b.critical, b.high, b.medium, b.suppressed, b.actionable_changes) == (1, 1, 2, 1, 2)
    assert severity.summary(c, "key").first().actionable == 4


def test_replies(spark):
    got = [one(spark, triage.parse_reply(F.col("t")), t=t) for t in ('{"corrected_text":"a"}', "plain")]
    assert [(g.content, g.confidence) for g in got] == [("a", 0.8), ("plain", 0.7)]


def test_contents_and_savings(spark):
    rows = [("d", f"c{i}", i, s) for i, s in enumerate(["Figure 1", "Unknown Section", "ab", "1.2 Clocks", "1.2 Clocks"])]
    toc = report.contents(spark.createDataFrame(rows, "document_id string, chunk_id string, page_start int, section_hierarchy string")).collect()
    assert [(t.section, t.anchor) for t in toc] == [("1.2 Clocks", "12-clocks")]
    s = report.savings(spark.createDataFrame([("d", 814, 122.0)], "document_id string, total_pages int, seconds double")).first()
    assert s.manual_minutes == 4070 and round(s.efficiency_pct) == 100


def test_duplicate_insert_fails(spark):
    t = spark.createDataFrame([("a",)], "chunk_id string")
    with pytest.raises(Exception, match="duplicate chunk_id"):
        state.insert(t, t, "chunk_id").collect()


def test_failed_file_is_a_row(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ntwo")
    (tmp_path / "b.txt").write_bytes(b"bad")

    def parse(path, content):
        if content == b"bad":
            raise ValueError("unreadable")
        for i, line in enumerate(content.decode().split("\n")):
            yield {"line": i, "text": line}

    got = extract.read_documents(spark, str(tmp_path), parse, "path string, error string, line double, text string").collect()
    assert sorted(r.text for r in got if r.text) == ["one", "two"] and [r.error for r in got if r.error] == ["ValueError: unreadable"]


def test_config():
    assert EngineConfig.from_mapping({"document": {"chunk_size": 99}}).chunk_size == 99 and DEFAULT.overlap == 200
    with pytest.raises(ValueError, match="unknown"):
        EngineConfig.from_mapping({"nope": 1})


def test_stream_reviews_and_windows(spark, tmp_path):
    from quire.streaming import review as stream

    src = str(tmp_path / "in")
    spark.createDataFrame([("d", "c1", "teh  x"), ("d", "c2", "fine")], "document_id string, chunk_id string, content string").write.parquet(src)
    df = spark.readStream.schema("document_id string, chunk_id string, content string").parquet(src)
    q = stream.append_to(stream.reviewed_stream(df).select("chunk_id", "reviewed_content", "confidence"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {r.chunk_id: r.reviewed_content for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"c1": "the x", "c2": "fine"}


def test_targets_count_in_their_own_document(spark):
    refs = spark.createDataFrame([("a", "r1", "table", "12"), ("b", "r2", "table", "12"), ("b", "r3", "table", "3")], "document_id string, ref_id string, reference_type string, target_number string")
    known = spark.createDataFrame([("a", "table", "3"), ("b", "table", "12")], "document_id string, ref_type string, target string")
    got = {r.ref_id: (r.is_valid, r.target_id) for r in crossref.validate(refs, known).collect()}
    assert got == {"r1": (False, None), "r2": (True, "table_12"), "r3": (False, None)}
    own = crossref.suggestions(refs, known.unionByName(spark.createDataFrame([("a", "table", "13"), ("a", "table", "21")], known.schema))).collect()
    assert sorted((r.document_id, r.target_number, r.suggestion) for r in own) == [("a", "12", "13"), ("a", "12", "21")]


@pytest.mark.parametrize("seed", range(3))
def test_similar_numbers_by_keys(spark, seed):
    import random

    rng = random.Random(seed)
    numbers = ["".join(rng.choices("0123.-", k=rng.randint(1, 4))) for _ in range(60)]
    refs = spark.createDataFrame([(f"r{i}", "table", x) for i, x in enumerate(numbers)], "ref_id string, reference_type string, target_number string")
    known = spark.createDataFrame([("table", x) for x in sorted(set(numbers[:30]))], "ref_type string, target string")

    def alike(a, b):
        at = [i for i in range(len(a)) if a[i] != b[i]] if len(a) == len(b) else []
        return len(at) == 1 or len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]]

    got = {(r.target_number, r.suggestion) for r in crossref.suggestions(refs, known, 1000).collect()}
    assert got == {(a, b) for a in numbers for b in numbers[:30] if alike(a, b)}


def test_equal_chunk_ids_of_two_documents(spark):
    chunks = spark.createDataFrame([("a", "c", "one", 1), ("b", "c", "two", 1)], "document_id string, chunk_id string, content string, page_start int")
    reviews = spark.createDataFrame([("a", "c", "r1", "completed", "fixed", 0.99, 1, 0), ("a", "c", "r0", "pending", "old", 0.1, 0, 0)], "document_id string, chunk_id string, review_id string, status string, reviewed_content string, confidence double, updated_at int, n_changes int")
    latest = state.latest_reviews(reviews)
    assert [(r.document_id, r.review_id) for r in latest.collect()] == [("a", "r1")]
    queue = triage.triage(chunks, latest)
    assert {(r.document_id, r.rule_suggestion, r.lane) for r in queue.collect()} == {("a", "fixed", "auto"), ("b", "two", "normal")}
    assert {r.document_id for r in state.pending(chunks, latest).collect()} == {"b"}
    merged = triage.merge(triage.call_in_batches(queue, triage.echo_client), queue)
    assert {(r.document_id, r.source) for r in merged.collect()} == {("a", "rule_high_confidence"), ("b", "hybrid_agreement")}
    assert state.without_embedding(chunks, chunks.filter("document_id = 'a'").select("document_id", "chunk_id")).count() == 1
    assert triage.human_queue(chunks.withColumn("section_hierarchy", F.lit("s")), latest).count() == 0


def test_batches_follow_documents(spark):
    queue = spark.createDataFrame([(f"d{i % 3}", f"c{i:03d}", "t", "high", "r", 0.5) for i in range(50)], "document_id string, chunk_id string, content string, lane string, rule_suggestion string, rule_confidence double")

    def sizes():
        return lambda batch: [{"suggestion": ",".join(x["chunk_id"] for x in batch)} for _ in batch]

    got = {r.suggestion for r in triage.call_in_batches(queue.repartition(5), sizes, EngineConfig(batch_size=7)).collect()}
    want = {d: [f"c{i:03d}" for i in range(50) if i % 3 == d] for d in range(3)}
    assert got == {",".join(x[i : i + 7]) for x in want.values() for i in range(0, len(x), 7)}


def test_marker_in_text(spark):
    from quire.functions.text import match_starts

    assert one(spark, match_starts(F.col("t"), "ab"), t="\x01ab\x01\x01ab") == [1, 5]


def test_gate_and_markup_in_the_plan(spark):
    from quire.plans import review as plan

    schema = "document_id string, chunk_id string, page_start int, section_hierarchy string, chunk_type string, content string, rows int, caption string, image_size bigint, image_index int"
    rows = [("d", "t", 1, "1.1 Intro", "text", "see.The teh page, Figure 7", None, None, None, None), ("d", "f", 2, "Figure 7", "figure", "[Figure 7]\nCaption: x", None, "x", 20000, 6), ("e", "t", 1, "", "text", "fine Figure 7", None, None, None, None), ("d", "o", 3, "", "other", "teh", None, None, None, None)]
    chunks = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "document_id string, ref_type string, target string")
    replies = spark.createDataFrame([("d", "t", "better", 0.999), ("e", "t", "worse", 0.999)], "document_id string, chunk_id string, content string, confidence double")
    result = plan.review(chunks, none, EngineConfig(llm_min_gain=0.01), replies)
    got = {(r.document_id, r.chunk_id): r for r in result.reviewed.collect()}
    assert got["d", "t"].accepted and got["d", "t"].reviewed_content == "better" and got["d", "t"].confidence == 0.999
    assert not got["e", "t"].asked and got["e", "t"].reviewed_content == "fine Figure 7" and got["d", "o"].reviewed_content == "teh" and got["d", "o"].confidence == 1.0
    assert {(r.document_id, r.is_valid) for r in result.references.collect()} == {("d", True), ("e", False)}
    meta = spark.createDataFrame([("d", "Guide", "d.pdf", 3, "today")], "document_id string, title string, filename string, total_pages int, review_date string")
    text = {r.document_id: r.text for r in plan.documents_of(plan.review(chunks, none), meta).collect()}
    assert text["d"].startswith("# Guide\n\n**Source:** d.pdf\n**Review Date:** today\n**Total Pages:** 3\n\n---\n\n## Table of Contents\n\n- [1.1 Intro](#11-intro)\n")
    assert '~~teh~~ <span style="color:red">the</span>' in text["d"] and "# Cross-Reference Validation Report" in text["d"] and text["e"].startswith("<!-- Page 1 -->\nfine Figure 7")


def test_save_replaces_only_its_documents(spark, tmp_path):
    from quire.plans import review as plan

    schema = "document_id string, chunk_id string, page_start int, section_hierarchy string, chunk_type string, content string, rows int, caption string, image_size bigint, image_index int"
    none = spark.createDataFrame([], "document_id string, ref_type string, target string")
    made = lambda d, text: plan.review(spark.createDataFrame([(d, "c", 1, "s", "text", text, None, None, None, None)], schema), none)
    for d, text in (("a", "one"), ("b", "two"), ("b", "three"), ("b", "three")):
        plan.save(made(d, text), str(tmp_path / "out"))
    got = {(r.document_id, r.content) for r in spark.read.parquet(str(tmp_path / "out" / "chunks")).collect()}
    assert got == {("a", "one"), ("b", "three")} and spark.read.parquet(str(tmp_path / "out" / "reviews")).count() == 2


def test_replies_with_changes(spark):
    got = one(spark, triage.parse_reply(F.col("t")), t='{"corrected_text": "a", "confidence": 0.9, "changes": [{"original": "x", "corrected": "y"}, "plain", null]}')
    assert [(c.type, c.original, c.corrected, c.confidence, c.reason) for c in got.changes] == [("llm_suggestion", "x", "y", 0.9, "LLM suggestion"), ("llm_suggestion", "", "plain", 0.9, "LLM suggestion")]
    answers = [one(spark, crossref.parse_reference_reply(F.col("t")), t=t) for t in ('{"valid": true, "suggested_target": "3", "confidence": 0.9}', "no json")]
    assert [(a.valid, a.suggested_target, a.confidence) for a in answers] == [(True, "3", 0.9), (False, None, None)]


def test_change_sections(spark):
    change = "array<struct<type:string,original:string,corrected:string,reason:string,severity:string,description:string>>"
    rows = [("d", "c1", [("spelling", "teh", "the", "r", None, None), ("spelling", "teh", "the", "r", None, None), ("grammar", "  ", " ", "Multiple spaces", None, None), ("grammar", ".A", ". A", "Missing space after punctuation", None, None), ("style", "1 - 2", "1-2", None, None, None)]), ("d", "c2", [("table_issue", None, None, None, "high", "Bad row"), ("figure_issue", None, None, None, "low", "Small"), ("other", "a", "b", "", None, None)])]
    got = report.change_sections(report.latest_changes(spark.createDataFrame(rows, f"document_id string, chunk_id string, changes {change}"))).first().sections
    assert got == (
        "## Spelling Corrections\n\n**Total:** 2 corrections\n\n**Examples:**\n```diff\n- teh\n+ the\n```\n\n---\n\n"
        "## Grammar & Formatting Fixes\n\n**Total:** 2 fixes\n\n**Whitespace Corrections:** 2\n```diff\n- '  ' (extra spaces)\n+ ' ' (single space)\n- '.A' (extra spaces)\n+ '. A' (single space)\n```\n"
        "**Punctuation Spacing:** 1\n```diff\n- .A\n+ . A\n```\n\n---\n\n"
        "## Style Improvements\n\n**Total:** 1 improvements\n\n**Examples:**\n```diff\n- 1 - 2\n+ 1-2\n  # Style improvement\n```\n\n---\n\n"
        "## Tables & Figures Issues\n\n**Total Issues:** 2\n\n**High Severity:** 1\n  - Bad row\n**Low Severity:** 1\n\n---\n\n"
    )


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "one\ntwo"), ("b", "three")], "document_id string, text string")
    report.write_text(df, "text", str(tmp_path / "t"))
    report.write_json(df, str(tmp_path / "j"))
    assert {(r.document_id, r.value) for r in spark.read.text(str(tmp_path / "t")).collect()} == {("a", "one"), ("a", "two"), ("b", "three")}
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert [i.type for i in one(spark, tables.issue_changes("table_issue", tables.table_issues(F.col("t"), F.lit(0))), t="none")] == ["table_issue"]


def test_greedy_alignment_against_brute_force(spark):
    import random

    import numpy as np

    rng = random.Random(5)
    side = lambda n: [(f"d{i % 3}", i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(n)]
    one_, two = side(40), side(35)
    want = set()
    for d in ("d0", "d1", "d2"):
        left, right = ([(i, np.array(e) / np.linalg.norm(e)) for x, i, e in s if x == d] for s in (one_, two))
        free = dict(right)
        for i, e in left:
            best = max(free, key=lambda j: (round(float(e @ free[j]), 12), -j), default=None)
            if best is not None and e @ free[best] >= 0.7:
                want.add((d, i, best))
                del free[best]
            else:
                want.add((d, i, None))
        want |= {(d, None, j) for j in free}
    v1 = spark.createDataFrame(one_, "document_id string, id1 long, e1 array<double>")
    v2 = spark.createDataFrame(two, "document_id string, id2 long, e2 array<double>")
    assert {(r.document_id, r.id1, r.id2) for r in diff.align_greedy(v1, v2).collect()} == want


def test_comparison_by_meaning(spark):
    schema = "document_id string, section_hierarchy string, chunk_type string, ord long, page_start int, content string, e array<double>"
    v1 = spark.createDataFrame([("d", "A", "text", 1, 1, "alpha", [1.0, 0.0]), ("d", "B", "text", 2, 1, "beta", [0.0, 1.0])], schema)
    v2 = spark.createDataFrame([("d", "X", "text", 1, 2, "alphas", [1.0, 0.1]), ("d", "Y", "text", 2, 2, "new", [-1.0, 0.0])], schema)
    changed, counts, log = diff.compare(v1, v2, F.lit("one → two"))
    assert {(r.section, r.change_type) for r in changed.collect()} == {("A", "modified"), ("B", "removed"), ("Y", "added")}
    assert {(r.section, r.change_type) for r in diff.compare(v1, v2, F.lit("t"), semantic=False)[0].collect()} == {("A", "removed"), ("B", "removed"), ("X", "added"), ("Y", "added")}
    assert counts.first().total_changes == 3 and "# Document Changelog" in log.first().changelog
