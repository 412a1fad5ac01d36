"""The sink for many documents: few files, look-ups, failures."""

import pytest
from pyspark.sql import functions as F

from quire.sources import bundle


def docs(spark, n, mark="text"):
    return spark.range(n).select(F.format_string("d%06d", "id").alias("document_id"), F.concat(F.lit(f"{mark} é "), F.col("id").cast("string")).alias("body"))


def stored(spark, path):
    spark.dataSource.register(bundle.DocumentBundles)
    return {(r.document_id, r.text) for r in spark.read.format("document_bundles").option("path", path).load().collect()}


def test_many_documents_in_few_files(spark, tmp_path):
    path = str(tmp_path / "out")
    assert stored(spark, path) == set()
    bundle.write_documents(docs(spark, 100_000), "body", path, files=6)
    held = bundle.manifest(path)
    assert len(held) <= 6 and sum(b.documents for b in held) == 100_000 and len(list((tmp_path / "out").iterdir())) <= 13
    assert all(a.last < b.first for a, b in zip(held, held[1:]))  # ranges don't overlap
    assert bundle.lookup(path, "d054321") == ["text é 54321"] and bundle.lookup(path, "nothing") == []
    bundle.write_documents(docs(spark, 10, "new"), "body", path, files=2)
    assert stored(spark, path) == {(f"d{i:06d}", f"new é {i}") for i in range(10)}
    assert len(list((tmp_path / "out").iterdir())) <= 5  # what the overwrite replaced is gone
    more = spark.createDataFrame([("d2", None), (None, "x\ny"), ("d2", "again")], "document_id string, body string")
    bundle.write_documents(more, "body", path, files=2, mode="append")
    assert len(stored(spark, path)) == 13 and sorted(bundle.lookup(path, "d2")) == ["", "again"] and bundle.lookup(path, "") == ["x\ny"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bundle.write_documents(docs(spark, 20), "body", path, files=2)
    before, files = stored(spark, path), sorted(f.name for f in (tmp_path / "out").iterdir())
    broken = docs(spark, 2000).withColumn("body", F.when(F.col("document_id") == "d001500", F.raise_error(F.lit("broken"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="broken"):
        bundle.write_documents(broken, "body", path, files=3)
    assert stored(spark, path) == before and sorted(f.name for f in (tmp_path / "out").iterdir()) == files
    bundle.write_documents(docs(spark, 0), "body", path)
    assert stored(spark, path) == set()
