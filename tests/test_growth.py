"""Steps whose cost grew faster than their input, or cost too much of it."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.operators import crossref, differ, language, metric, report
from quire.plans import review as plan


def marked(a, b):
    x, y, out = a.split(), b.split(), []
    for tag, i, j, k, m in SequenceMatcher(None, x, y).get_opcodes():
        old, new = [f"~~{' '.join(x[i:j])}~~"] * (j > i), [f'<span style="color:red">{" ".join(y[k:m])}</span>'] * (m > k)
        out += [" ".join(x[i:j])] if tag == "equal" else old + new
    return " ".join(out)


@pytest.mark.parametrize("near", [differ.NEAR, 3_000])
def test_markup_compares_words_within_rows(spark, monkeypatch, near):
    monkeypatch.setattr(differ, "NEAR", near)
    texts = ["Teh cat and teh dog.Then  it\xa0slept, teh end. " * 5, "no change", "one teh", " teh\nteh " * 40, "teh é　x.Y " * 12, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "chunk_id long, content string")
    out = language.markup(language.review(rows))
    if near == differ.NEAR == 1 << 32:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "Exchange" not in plan and "Join" not in plan
    got = {r.chunk_id: r for r in out.collect()}
    assert len(got) == len(texts) * 2 and sum(len(r.changes) >= 10 for r in got.values()) == 6
    for r in got.values():
        if len(r.changes) >= 10:
            assert r.markup == marked(r.content, r.reviewed_content)
        elif r.content == r.reviewed_content:
            assert r.markup == r.content


@pytest.fixture(scope="module")
def grouped(spark):
    v = spark.range(0, 4_000, numPartitions=8).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i) for i in range(4)]).alias("e"), (F.col("id") % 10).alias("label"))
    return v.localCheckpoint()


def test_blocks_of_groups_are_filled(spark, grouped):
    index = metric.build(grouped, "label")
    groups = index.blocks.select("cell", "same").distinct().count()
    assert index.blocks.agg(F.sum("n")).first()[0] == 4_000
    assert index.blocks.count() <= groups + 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # before: for each of the eight partitions


def test_query_blocks_leave_before_all_are_made(spark, grouped, monkeypatch):
    queries = grouped.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"), "label")
    monkeypatch.setattr(metric, "HELD_BYTES", 1_000)
    monkeypatch.setattr(metric, "BLOCK", 16)
    got = {(r.query_id, r.rank): r.vec_id for r in metric.search(metric.build(grouped, "label"), queries, 3, "label").collect()}
    rows = [(r.vec_id, r.e, r.label) for r in grouped.collect()]
    want = {}
    for q, x, group in (r for r in rows if r[0] % 20 == 0):
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e, label in rows if label == group)[:3]
        want |= {(q, n + 1): i for n, (_, i) in enumerate(near)}
    assert got == want


def test_typos_are_found_by_their_letters_first(spark):
    rows = [" teh,TEH tehx xteh Teh_ _teh teh\u0301 é😀teh 1teh teh1 tEh", "teh", "adnadn adn nad-nad", "wich occured Occured WICH wich"]
    text, changes = language.spelling(F.col("t"))
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.alias("fixed"), changes.alias("c"))
    assert r"(?i:\b" not in df._jdf.queryExecution().optimizedPlan().toString()  # a look-up at every place of every text
    got = [(r.fixed, len(r.c)) for r in df.collect()]
    assert got[1:] == [("the", 1), ("adnadn and and-and", 3), ("which occurred Occurred WHICH which", 5)]
    assert got[0] == (" the,THE tehx xteh Teh_ _teh teh\u0301 é😀the 1teh teh1 the", 4)


class Word(str):
    """A word that counts how often it is looked up."""

    looked_up = 0

    def __hash__(self):
        Word.looked_up += 1
        return str.__hash__(self)

    __eq__ = str.__eq__


def test_words_are_looked_up_a_fixed_number_of_times():
    text = [Word(f"{i}") for i in range(1_500)]
    other = [Word("x" if i % 5 == 3 else w) for i, w in enumerate(text)]
    Word.looked_up = 0
    assert sum(k for _, _, k in differ.matching(text, other)) == 1_200
    assert Word.looked_up <= 10 * len(text)  # before: again for every block around them


@pytest.mark.parametrize("words", [1, 2, 3, 20, 150])
@pytest.mark.parametrize("n", [0, 1, 7, 40, 199, 200, 330])
def test_matching_finds_the_standard_blocks(words, n):
    r = random.Random(words * 1_000 + n)
    for _ in range(6):
        a = [r.choice([None, *"pqr"]) if r.random() < 0.1 else int(words * r.random() ** 2) for _ in range(n)]
        b = [x for w in a for x in r.choice([[w]] * 8 + [[], [w, -1], [-2], [r.randrange(words)]])]
        for x, y in ((a, b), (b, a), (a, a), (a, b[::-1])):
            assert differ.matching(x, y) == [tuple(m) for m in SequenceMatcher(None, x, y).get_matching_blocks()[:-1]]


def test_references_are_found_once(spark):
    kinds = "document_id string, chunk_id string, page_start int, section_hierarchy string, chunk_type string, content string, rows int, caption string, image_size bigint, image_index int"
    chunks = spark.createDataFrame([("d", f"c{i}", i, "s", "text", f"See Section 1.{i} and Table 2. " * 80, None, None, None, None) for i in range(3)], kinds)
    targets = spark.createDataFrame([("d", "section", "1.1")], "document_id string, ref_type string, target string")
    result = plan.review(chunks, targets)
    text = result.references._jdf.queryExecution().optimizedPlan().toString()
    assert crossref._FIRST not in text and "_refs" in text and "_refs" not in result.chunks.columns  # before: cut out of the text again by each reader
    want = crossref.validate(crossref.extract_references(result.chunks), crossref.known_targets(targets))
    assert sorted(result.references.collect()) == sorted(want.collect()) and want.count() > 400
    refs = spark.createDataFrame(result.references.collect(), result.references.schema)
    assert report.reference_report(refs)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # before: 2


def test_texts_without_matches_are_not_cut(spark):
    rows = ["all right here.", "a\x01b", "a  b\x01c.D", "1111 - 22 - 3 4 -\t5", "", None]
    out = language.review(spark.createDataFrame([(t,) for t in rows], "content string")).collect()
    assert [(r.reviewed_content, len(r.changes)) for r in out] == [("all right here.", 0), ("a\x01b", 0), ("a b\x01c. D", 2), ("1111-22 - 3 4-5", 2), ("", 0), (None, 0)]
