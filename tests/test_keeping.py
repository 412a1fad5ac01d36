"""State kept by streams and progress kept from changes, against computing both anew."""

import datetime
import random

import pytest

from quire.operators import incremental, state
from quire.streaming import state as kept

REVIEW = "document_id string, chunk_id string, review_id string, status string, updated_at timestamp"
STATUS = ["pending", "completed", "in_progress", "needs_review"]


def reviews(rng, n):
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randint(0, 500))
    return [(f"d{k % 3}", f"c{k}", f"r{i:04d}", rng.choice(STATUS), at()) for i in range(n) for k in [rng.randint(0, 25)]]


@pytest.mark.parametrize("cuts", [[200], [1, 2, 60, 61, 200], [50, 100, 150, 200]])
def test_stream_equals_upsert(spark, tmp_path, cuts):
    rows = reviews(random.Random(len(cuts)), 200)
    whole = spark.createDataFrame(rows, REVIEW)
    want = sorted((r.document_id, r.chunk_id, r.review_id, r.status) for r in state.latest_reviews(whole).collect())
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    assert kept.read_table(spark, table) is None
    start = 0
    for k, end in enumerate(cuts):
        spark.createDataFrame(rows[start:end], REVIEW).coalesce(1).write.mode("append").parquet(source)
        start = end
        if k % 2 == 0 or end == 200:  # else two files wait for the next start
            stream = spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", 1).parquet(source)
            kept.upsert_into(stream, table, checkpoint).awaitTermination()
            so_far = sorted((r.document_id, r.chunk_id, r.review_id, r.status) for r in state.latest_reviews(spark.createDataFrame(rows[:end], REVIEW)).collect())
            assert sorted((r.document_id, r.chunk_id, r.review_id, r.status) for r in kept.read_table(spark, table).collect()) == so_far
    assert so_far == want
    # A batch that runs again replaces its folder.
    again = spark.read.parquet(f"{table}/batch=0")
    again.write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(f"{table}/batch=0")
    assert sorted((r.document_id, r.chunk_id, r.review_id, r.status) for r in kept.read_table(spark, table).collect()) == want


def test_signed_changes_of_a_stream(spark, tmp_path):
    rows = reviews(random.Random(9), 120)
    for lo in (0, 50, 51):
        spark.createDataFrame(rows[lo : {0: 50, 50: 51, 51: 120}[lo]], REVIEW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    kept.signed_changes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.document_id, r.chunk_id, r.status) for r in incremental.netted(spark.read.parquet(out)).collect()}
    want = {(r.document_id, r.chunk_id, r.status) for r in state.latest_reviews(spark.createDataFrame(rows, REVIEW)).collect()}
    assert got == want


def test_progress_from_ten_changes(spark):
    rng = random.Random(4)
    chunks, held = [(f"d{k % 3}", f"c{k}") for k in range(20)], []
    support = spark.createDataFrame([], "document_id string, chunk_id string, status string, n long")
    progress = spark.createDataFrame([], "document_id string, total long, completed long, in_progress long, needs_review long")
    for k in range(10):
        new_chunks = chunks if k == 0 else [(f"d{rng.randint(0, 4)}", f"n{k}x{i}") for i in range(2)]
        chunks = chunks + (new_chunks if k else [])
        gone = rng.sample(held, min(len(held), rng.randint(0, 6)))
        come = [(*rng.choice(chunks), rng.choice(STATUS)) for _ in range(rng.randint(0, 12))]
        held = [h for h in held if all(h is not g for g in gone)] + come
        frame = lambda rows: spark.createDataFrame(rows, "document_id string, chunk_id string, status string")
        delta = incremental.signed(frame(gone), frame(come))
        progress = incremental.advanced(progress, incremental.moved(support, delta, spark.createDataFrame(new_chunks, "document_id string, chunk_id string")))
        support = incremental.folded(support, delta)
        support, progress = (spark.createDataFrame(x.collect(), x.schema) for x in (support, progress))
        want = state.progress(spark.createDataFrame(chunks, "document_id string, chunk_id string"), frame(held))
        cols = ["document_id", "total", "completed", "in_progress", "needs_review", "pending"]
        assert sorted(map(tuple, progress.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert support.filter("n < 0").count() == 0


def test_first_rows_of_groups(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quire.functions import topk

    monkeypatch.setattr(topk, "PARTS", 3)
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else f"g{rng.randint(0, 5)}", x) for x in rng.sample(range(1000), 300)]
    got = topk.first_k(spark.createDataFrame(rows, "g string, x int"), ["g"], ["x"], 4).collect()
    want = {(g, x, n + 1) for g in {g for g, _ in rows} for n, x in enumerate(sorted(x for h, x in rows if h == g)[:4])}
    assert {(r.g, r.x, r.place) for r in got} == want
    df = topk.first_k(spark.createDataFrame(rows, "g string, x int"), ["g"], ["x"], 4)
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    assert topk.first_k(df.limit(0).select("g", F.col("x")), ["g"], ["x"], 2).count() == 0


def test_validity_stays_in_its_document(spark):
    from quire.operators import crossref

    stored = spark.createDataFrame([("d1", "r", None, False), ("d2", "r", "old", True), ("d3", "r", "old", True)], "document_id string, ref_id string, target_id string, is_valid boolean")
    checked = spark.createDataFrame([("d1", "r", "t", True), ("d2", "r", "", False)], "document_id string, ref_id string, target_id string, is_valid boolean")
    got = {r.document_id: (r.target_id, r.is_valid) for r in crossref.persist_validity(stored, checked).collect()}
    assert got == {"d1": ("t", True), "d2": ("old", False), "d3": ("old", True)}
    assert crossref.persist_validity(stored, checked.drop("document_id").filter("is_valid")).filter("is_valid AND target_id = 't'").count() == 3
