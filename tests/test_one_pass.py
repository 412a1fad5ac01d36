"""Rules and references that pass over a text once, against the standard library; references whose ids are not unique."""

import os
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quire.operators import crossref, language
from quire.queries import ORACLES, QUERIES
from quire.queries import language as LQ
from test_oracles import DATA, TABLES

SPARE = ["Section ", "section\n", "§", "§ ", "Figure ", "Fig. ", "Fig.", "Table\t", "TABLE ", "Equation ", "Eq. ", "1", "2.3", "4-5", "-", ".", " ", "  ", "x", "é😀", "\x01"]


def texts(parts, n=300):
    rng = random.Random(11)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_references(spark):
    rows = texts(SPARE)
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", crossref.references_of(F.col("t")).alias("r")).collect()
    assert sum(len(r.r) for r in got) > 300
    for r in got:
        assert [tuple(x) for x in r.r] == [(n, kind, m[0], m[1], m.start()) for n, (kind, p) in enumerate(crossref.REFERENCES) for m in re.finditer(p, r.t, re.ASCII)]


def test_rules(spark):
    rows = texts(["teh", "Teh", "TEH", "tEH", "adn", "nad", " ", "  ", "   ", ".", ",", "A", "x", "é😀", "1", " - ", "2", "\t-", "\x01"])
    for rule, pattern, fix in (
        (language.grammar_spaces, "  +", " "),
        (language.grammar_punctuation, "([.!?,;:])([A-Z])", r"\1 \2"),
        (language.style_ranges, r"(?<!\d)(\d+)[ \t]+-[ \t]+(\d+)", r"\1-\2"),
    ):
        text, changes = rule(F.col("t"))
        for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.alias("fixed"), changes.alias("c")).collect():
            assert r.fixed == re.sub(pattern, fix, r.t)
            assert [(c.original, c.corrected, c.position) for c in r.c] == [(m[0], m.expand(fix), m.start()) for m in re.finditer(pattern, r.t)][::-1]


def test_markup_filter_stays_behind_the_rules(spark):
    plan = LQ.inline_markup(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp" in line for line in plan.splitlines() if "Filter" in line)


def test_same_id_in_two_documents(spark, tmp_path):
    """chunk_100 at 123 and chunk_1001 at 23 make one id; the number is valid in one document only."""
    for t in set(TABLES) - {"documents"}:
        os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = pq.read_schema(f"{DATA}/documents.parquet")
    made = [{"doc_id": i, "text": "x" * (at - 14) + "Section 3.0"} for i, at in ((100, 123), (1001, 23))]
    pq.write_table(pa.Table.from_pylist(made, docs), tmp_path / "documents.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = QUERIES["xref_persist"](spark, str(tmp_path)).select("ref_id", "chunk_id", "target_id", "is_valid").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(f"SELECT ref_id, chunk_id, target_id, is_valid FROM ({ORACLES['xref_persist']})").fetchall(), key=str)
    assert max(sum(r.ref_id == x.ref_id for x in got) for r in got) == 4
