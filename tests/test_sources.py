"""Tables that are changed while others read them, upserts from a stream, literature as a data source."""

import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.operators import history as H
from quillspark.sources import literature, records
from quillspark.streaming import upserts

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SCHEMA = "id string, status string, n int"


def test_json_table_changes(spark, tmp_path):
    folder = f"file://{tmp_path}/table"
    now = lambda: [tuple(r)[1:] for r in records.versioned_table(spark, folder, SCHEMA).orderBy("corpus_pos").collect()]
    put = lambda *rows: records.change_table(spark, folder, SCHEMA, lambda t: records.at_head(t, spark.createDataFrame(rows, SCHEMA).coalesce(1)))
    assert now() == [] and records.json_version(spark, folder) == 0
    assert put(("a", "new", 1)) == 1 and put(("b", None, 2)) == 2 and put(("c", 'q"\n', None)) == 3
    assert now() == [("c", 'q"\n', None), ("b", None, 2), ("a", "new", 1)]
    update = spark.createDataFrame([("a", "done"), ("zz", "done")], "id string, status string")
    touched = lambda t: H.updated(t.withColumn("t", F.lit(0)), update, "id", "t", F.lit(1)).drop("t")
    records.change_table(spark, folder, SCHEMA, touched)
    records.change_table(spark, folder, SCHEMA, lambda t: records.without(t, "id", ["b", "none"]))
    assert now() == [("c", 'q"\n', None), ("a", "done", 1)] and records.json_version(spark, folder) == 5
    table = records.versioned_table(spark, folder, SCHEMA)
    assert records.by_key(table, "id", "a").first()["n"] == 1 and records.by_key(table, "id", "b").count() == 0
    assert H.status_pivot(table, "status", {"done": "done"}).first().asDict() == {"total": 2, "done": 1}
    # a change that fails leaves the old table
    with pytest.raises(Exception, match="no such|UNRESOLVED"):
        records.change_table(spark, folder, SCHEMA, lambda t: t.select("nothing", "corpus_pos"))
    assert len(now()) == 2 and records.json_version(spark, folder) == 5


def test_two_writers_lose_no_row(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/table", []
    row = lambda name: spark.createDataFrame([(name, "x", 1)], SCHEMA)

    def slow(table):
        calls.append(table.count())
        if len(calls) == 1:  # meanwhile another writer publishes
            records.change_table(spark, folder, SCHEMA, lambda t: records.at_head(t, row("other")))
        return records.at_head(table, row("mine"))

    assert records.change_table(spark, folder, SCHEMA, slow) == 2 and calls == [0, 1]
    assert [r["id"] for r in records.versioned_table(spark, folder, SCHEMA).orderBy("corpus_pos").collect()] == ["mine", "other"]
    with pytest.raises(RuntimeError, match="came first"):
        records.change_table(spark, folder, SCHEMA, lambda t: (records.change_table(spark, folder, SCHEMA, lambda x: x), t)[1], attempts=2)


def test_upserts_of_replayed_batches(spark, tmp_path):
    schema, path = "id string, v int, at long", f"file://{tmp_path}/versions"
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(([("a", 1, 1), ("b", 1, 1)], [("a", 2, 5), ("c", 7, 2)], [("a", 3, 4), ("b", 9, 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"file://{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in/*/")
        assert upserts.upsert_stream(stream, path, f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
    now = lambda: sorted(tuple(r) for r in upserts.upserted(spark, path, schema, "id", "at").select("id", "v", "at").collect())
    assert now() == [("a", 2, 5), ("b", 9, 1), ("c", 7, 2)]
    upserts.version_writer(path)(spark.createDataFrame([("a", 99, 99)], schema), 1)  # batch 1 again
    assert now() == [("a", 2, 5), ("b", 9, 1), ("c", 7, 2)]
    assert upserts.upserted(spark, f"file://{tmp_path}/none", schema, "id", "at").count() == 0


def answers(text):
    if text == "slow":
        time.sleep(5)
    if text == "broken":
        return "<not xml"
    if text == "refused":
        raise RuntimeError("503")
    one = "<PubmedArticle><MedlineCitation><PMID>{}</PMID><Article><ArticleTitle>About {}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    return "<PubmedArticleSet>" + "".join(one.format(k, text) for k in range(len(text) % 4)) + "</PubmedArticleSet>"


def test_literature_by_format_name(spark):
    literature.register(spark, {"default": answers})
    texts = ["knee", "hip", "broken", "refused", "slow", "hip", "spine"]
    got = literature.search(spark, texts, timeout=1.0, partitions=3)
    rows = {(r["search"], r["position"]) for r in got.collect()}
    assert rows == {("hip", 0), ("hip", 1), ("hip", 2), ("spine", 0)} and got.rdd.getNumPartitions() == 3
    assert literature.search(spark, []).count() == 0
    with pytest.raises(Exception, match="no transport"):
        literature.search(spark, texts, transport="other").collect()
