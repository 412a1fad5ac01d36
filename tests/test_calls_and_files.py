"""The journal of model calls and the file sources: failures, restarts, order."""

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import journal
from quire.sources import files


def counting(folder, fail=(), die=()):
    """A client that leaves a file for each call; prompts in ``fail`` fail once, those in ``die`` end the worker."""

    def make():
        def call(prompt):
            import os
            import uuid
            from pathlib import Path

            before = len(list(Path(folder).glob(f"{prompt}-*")))
            (Path(folder) / f"{prompt}-{uuid.uuid4().hex}").touch()
            if prompt in die and not before:
                os._exit(1)
            if prompt in fail and not before:
                raise TimeoutError("busy")
            return f"reply to {prompt}"

        return call

    return make


def calls(folder):
    out = {}
    for f in folder.iterdir():
        out[f.name.partition("-")[0]] = out.get(f.name.partition("-")[0], 0) + 1
    return out


def test_each_prompt_is_asked_once(spark, tmp_path):
    (folder := tmp_path / "calls").mkdir()
    prompts = spark.createDataFrame([(i, f"p{i % 30}") for i in range(90)], "id long, prompt string")
    path = str(tmp_path / "journal")
    got = journal.ask(prompts, counting(str(folder), fail=("p3", "p4")), path, block=4)
    assert {(r.id, r.reply) for r in got.collect()} == {(i, f"reply to p{i % 30}") for i in range(90)}
    assert calls(folder) == {f"p{i}": 2 if i in (3, 4) else 1 for i in range(30)}
    assert journal.read(spark, path).filter("error = 'TimeoutError: busy' AND round = 1").count() == 2
    more = prompts.unionByName(spark.createDataFrame([(100, "new"), (101, None)], prompts.schema))
    again = journal.ask(more, counting(str(folder)), path).collect()
    assert len(again) == 92 and sum(calls(folder).values()) == 32 + 2
    never = journal.ask(prompts.limit(3), lambda: lambda p: 1 / 0, str(tmp_path / "none"), rounds=2)
    assert [r.reply for r in never.collect()] == [None] * 3 and journal.read(spark, str(tmp_path / "none")).count() == 2 * never.select("prompt_hash").distinct().count()


def test_a_killed_run_goes_on(spark, tmp_path):
    (folder := tmp_path / "calls").mkdir()
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(40)], "prompt string")
    path = str(tmp_path / "journal")
    with pytest.raises(Exception, match="(?i)worker|exit|crash"):
        journal.ask(prompts, counting(str(folder), die=("p7",)), path, block=2)
    answered = {r.prompt_hash for r in journal.answers(journal.read(spark, path)).collect()}
    first = calls(folder)
    got = journal.ask(prompts, counting(str(folder)), path, block=2).collect()
    assert {r.reply for r in got} == {f"reply to p{i}" for i in range(40)}
    hashes = {r.prompt: r.prompt_hash for r in got}
    for p, n in calls(folder).items():
        assert n == (first[p] if hashes[p] in answered else first.get(p, 0) + 1)  # what the journal had was not asked again
    assert sum(n > 1 for n in calls(folder).values()) <= 2 * 4  # no more than the blocks under way


def test_calls_a_minute_are_bounded(spark, tmp_path):
    (folder := tmp_path / "calls").mkdir()
    now, pauses = [0.0], []

    def sleep(s):
        pauses.append((s, sum(calls(folder).values())))
        now[0] += s

    prompts = spark.createDataFrame([(f"p{i}",) for i in range(30)], "prompt string")
    got = journal.ask(prompts, counting(str(folder)), str(tmp_path / "journal"), per_minute=12, sleep=sleep, clock=lambda: now[0])
    assert got.filter("reply IS NULL").count() == 0
    made = [0, *(n for _, n in pauses)]
    assert all(s == 60 for s, _ in pauses) and all(b - a <= 12 for a, b in zip(made, made[1:])) and sum(calls(folder).values()) == 30


def test_documents_from_files(spark, tmp_path):
    def pages_of(path, content):
        import json

        data = json.loads(content)
        for n, p in enumerate(data["pages"]):
            yield {"kind": "table", "page": n, "content": "t"}
            yield {"kind": "text", "page": n, "content": p}
        yield {"kind": "structure", "page": 0, "content": data["title"]}

    (tmp_path / "a").mkdir()
    for i in range(4):
        (tmp_path / "a" / f"{i}.json").write_text(json.dumps({"title": f"T{i}", "pages": ["one", "two"]}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "_SUCCESS").write_text("")
    spark.dataSource.register(files.document_source(pages_of, "json_documents"))
    df = spark.read.format("json_documents").option("path", str(tmp_path)).load()
    assert df.rdd.getNumPartitions() == 5
    rows = df.collect()
    for i in range(4):
        own = [(r.ordinal, r.kind, r.page, r.content) for r in rows if r.path.endswith(f"/{i}.json")]
        assert own == [(0, "structure", 0, f"T{i}"), (1, "text", 0, "one"), (2, "text", 1, "two"), (3, "table", 0, "t"), (4, "table", 1, "t")]
    assert [r.error.split(":")[0] for r in rows if r.path.endswith("bad.json")] == ["JSONDecodeError"]
    assert spark.read.format("json_documents").option("path", str(tmp_path / "none")).load().count() == 0


def test_replies_as_a_stream(spark, tmp_path):
    spark.dataSource.register(files.ReplySource)
    (source := tmp_path / "in").mkdir()
    event = 'data: {"choices":[{"delta":{"content":"part %d"}}]}\ndata: [DONE]'
    plain = '{"choices":[{"message":{"content":"whole %d"}}]}'
    seen = []
    for start, end in ((0, 3), (3, 3), (3, 7)):
        for i in range(start, end):
            (source / f"r{i:03d}").write_text((event if i % 2 else plain) % i)
        out = spark.readStream.format("reply_files").option("path", str(source)).load().select("name", files.reply_text(F.col("body")).alias("text"))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        seen = sorted((r.name, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert seen == [(f"r{i:03d}", f"{'part' if i % 2 else 'whole'} {i}") for i in range(end)]
    odd = spark.createDataFrame([("",), (None,), ("not json",), ('{"choices":[]}',)], "b string")
    assert [r.t for r in odd.select(files.reply_text(F.col("b")).alias("t")).collect()] == [None] * 4
