"""Memory and task sizes that must not grow with the tables."""

from __future__ import annotations

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from weekpanel.functions.text import canonical, normalize_text, similar
from weekpanel.operators import neighbours as N
from weekpanel.operators import textml
from weekpanel.workload import models, star
from weekpanel.workload.fixtures import Tables


def test_distances_held_at_once_do_not_grow_with_the_training_rows():
    r = np.random.default_rng(3)
    train, test = r.random((60_000, 2)), r.random((512, 2))
    tracemalloc.start()
    found = N._nearest(np.arange(512), test, np.arange(60_000), np.zeros(60_000, int), train, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1536 and peak < 100 << 20
    d = ((train - test[7]) ** 2).sum(axis=1)
    assert found[found.test_id == 7].train_id.tolist() == np.lexsort((np.arange(60_000), d))[:3].tolist()


def test_no_task_gets_more_than_a_block_of_the_test_rows_of_a_bucket(spark, monkeypatch, tmp_path):
    nearest, log = N._nearest, tmp_path / "sizes"
    log.mkdir()

    def watched(test_ids, test, train_ids, *rest):
        (log / f"{min(test_ids)}-{min(train_ids)}-{len(test_ids)}-{len(train_ids)}").touch()
        return nearest(test_ids, test, train_ids, *rest)

    monkeypatch.setattr(N, "_nearest", watched)
    rows = [(i, [float(i % 7), 1.0], i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, v array<double>, label int")
    test, train = df.filter("id % 10 > 0"), df.filter("id % 10 = 0")
    found = N.nearest_in_buckets(test, train, 2, "id", "v", "label", width=50.0, block_rows=30)
    whole = N.nearest(test, train, 2, "id", "v", "label")
    met = found.collect()
    sizes = [int(f.name.split("-")[2]) for f in log.iterdir()]
    assert sizes and max(sizes) < 90
    assert sorted(map(tuple, met)) == sorted(map(tuple, whole.collect()))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_go_to_python_in_small_batches(spark):
    df = spark.createDataFrame([(1, "A &amp; b", "a b"), (2, None, "x"), (3, "same", "same"), (4, "", "")], "id int, s string, h string")
    out = df.select("id", normalize_text("s").alias("s"), similar(F.col("s"), F.col("h"), 0.6).alias("close")).orderBy("id")
    assert "ArrowEvalPython" not in plan(out)
    assert [tuple(r) for r in out.collect()] == [(1, "A & b", False), (2, "", False), (3, "same", True), (4, "", False)]


def test_comparison_form_of_mixed_runs(spark):
    texts = ["a  b", " a1 2b", "x-y  Z", " a  \tb.", "a . b", "...", "", "é e", "http://q a #b"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical("t")).collect()]
    assert found == ["a b", "a b", "x y z", "a b", "a b", "", "", "e", "a b"]


def test_a_cut_of_a_large_table_is_written_by_many_tasks(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    df = spark.range(12_000).repartition(4).withColumn("v", F.col("id") * 2)
    cuts = ["id % 3 = 0", "id < 0", "id % 3 > 0"]
    stream = star._in_files(tables, df, cuts, str(tmp_path))
    seen = []
    star._run(stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(
        lambda batch, _: seen.append((batch.count(), len(batch.inputFiles())))))
    assert [n for n, _ in seen] == [4000, 8000]
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 8


def test_small_cuts_are_one_file_each(spark, tmp_path):
    df, cuts = spark.range(90).repartition(4), ["id < 30", "id >= 200", "id >= 30"]
    star._in_files(Tables(spark, str(tmp_path)), df, cuts, str(tmp_path))
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 3


def test_counts_meet_a_small_vocabulary_without_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["all", f"w{i % 3}", f"only{i}"]) for i in range(30)], "id int, t array<string>")
    found = []
    for most in (textml.SMALL_VOCABULARY, 0):
        monkeypatch.setattr(textml, "SMALL_VOCABULARY", most)
        out = [f(docs, "id", "t", max_df=1.0) for f in (textml.bag_of_words_long, textml.tfidf_long)]
        assert ("SortMergeJoin" in plan(out[0])) == (most == 0)
        found.append([sorted(map(tuple, df.collect())) for df in out])
    assert found[0] == found[1] and len(found[0][0]) == 60


def test_labelled_words_are_cleaned_once(spark, tmp_path):
    spark.createDataFrame([(1, "Gain gain 1"), (2, "the loss")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = models._labelled(Tables(spark, str(tmp_path)))
    assert "parquet" not in plan(docs) and "regexp_replace" not in plan(docs)
    assert sorted((r.doc_id, r.label, list(r.tokens)) for r in docs.collect()) == [(1, 1.0, ["gain", "gain"]), (2, 0.0, ["loss"])]
