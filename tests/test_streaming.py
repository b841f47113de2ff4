"""Streams over files: progress counts and coalesced saves."""

import datetime

from tallyforge.sources.workspace import Workspace
from tallyforge.streaming import progress


def test_autosave_commits_the_newest_state(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    schema = "account_id string, revision long, state string"
    for k, rows in enumerate([[("a", 1, "x"), ("a", 3, "z"), ("b", 1, "p")], [("a", 2, "y"), ("b", 2, "q")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        progress.autosave(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), w, "states", str(tmp_path / "cp"), once=True).awaitTermination()
        assert w.revision() == k + 1
    assert {(r.account_id, r.revision, r.state) for r in w.table("states").collect()} == {("a", 3, "z"), ("b", 2, "q")}


def test_progress_counts_repeats_once(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 0, 5)
    rows = [("t", at, 1, "completed"), ("t", at, 1, "completed"), ("t", at, 2, "failed"), ("t", at + datetime.timedelta(minutes=2), 3, "completed")]
    spark.createDataFrame(rows, "task string, at timestamp, image int, state string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task string, at timestamp, image int, state string").parquet(str(tmp_path / "in"))
    q = progress.progress(stream).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.completed, r.failed) for r in spark.table("seen").collect())
    assert got == [(1, 0), (1, 1)]
