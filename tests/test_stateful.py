"""Undo and redo in batch and stream, progress in order, timed saves and replays."""

import random
import time

import pytest

from tallyforge.operators import undo
from tallyforge.plans import sessions
from tallyforge.sources.workspace import Workspace
from tallyforge.streaming import progress

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHAPE = "session string, seq long, command string, value string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def plain(rows):
    """Two lists per session, one command after another."""
    out, past, future, value, seen = [], {}, {}, {}, set()
    for s, q, command, v in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        if (s, q) in seen:
            continue
        seen.add((s, q))
        p, f, done = past.setdefault(s, []), future.setdefault(s, []), True
        if command == "change":
            p.append(value.get(s))
            if len(p) > 30:
                p.pop(0)
            f.clear()
            value[s] = v
        elif command == "undo" and p:
            f.append(value.get(s))
            value[s] = p.pop()
        elif command == "redo" and f:
            p.append(value.get(s))
            value[s] = f.pop()
        else:
            done = False
        out.append((s, q, value.get(s), len(p), len(f), done))
    return sorted(out)


def made(rng, n):
    return [(f"s{rng.randrange(5)}", k, rng.choice(["change"] * 4 + ["undo"] * 3 + ["redo"] * 2 + [None, "other"]), rng.choice([None, f"v{k}"])) for k in range(n)]


def test_history_keeps_thirty_and_a_change_clears_redo(spark):
    rows = [("a", k, "change", f"v{k}") for k in range(40)] + [("a", 40 + k, "undo", None) for k in range(35)] + [("a", 80, "redo", None), ("a", 81, "change", "new"), ("a", 82, "redo", None)]
    got = {r.seq: r for r in undo.history(spark.createDataFrame(rows, SHAPE)).collect()}
    assert (got[39].undo, got[69].value, got[70].done, got[74].value) == (30, "v9", False, "v9")
    assert (got[80].value, got[81].redo, got[82].done, got[82].value) == ("v10", 0, False, "new")


def test_stream_and_batch_agree(rocks, tmp_path):
    spark, rows = rocks, [*made(random.Random(1), 900), (None, 1, "change", "x"), ("s1", None, "undo", None)]
    batch = sorted(map(tuple, undo.history(spark.createDataFrame(rows + rows[:50], SHAPE).repartition(7)).collect()))
    assert batch == plain(rows)
    for lo in (0, 300, 600):
        spark.createDataFrame(rows[lo : lo + 300] + rows[max(0, lo - 20) : lo], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = undo.history_stream(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))).writeStream.outputMode("update")
        q = q.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == plain(rows[:900])


def test_commands_of_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in sessions.commands(spark, d).collect()]
    assert sorted(map(tuple, sessions.undo_history(spark, d).collect())) == plain(rows) and len(rows) > 5000


def test_progress_in_order(rocks, tmp_path):
    spark, schema = rocks, "task string, image long, state string, detail string"
    batches = [[("t", 2, "completed", "b"), ("t", 4, "failed", None), ("u", 1, "completed", None)], [("t", 1, "failed", "a"), ("t", 2, "completed", "again")], [("t", 3, "cancelled", None), ("t", 1, "failed", "a"), (None, 1, "x", None)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = progress.in_order(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.option("checkpointLocation", str(tmp_path / "cp"))
        q.foreachBatch(lambda b, k: b.write.mode("append").parquet(str(tmp_path / f"out{n}"))).trigger(availableNow=True).start().awaitTermination()  # noqa: B023
    got = [[tuple(r) for r in spark.read.parquet(str(tmp_path / f"out{n}")).orderBy("task", "image").collect()] for n in range(3)]
    assert got[0] == [("u", 1, "completed", None, 1, 0)]
    assert got[1] == [("t", 1, "failed", "a", 0, 1), ("t", 2, "completed", "b", 1, 1)]
    assert got[2] == [("t", 3, "cancelled", None, 1, 1), ("t", 4, "failed", None, 1, 2)]


def rows_of(w, table):
    return sorted((tuple(r) for r in w.table(table).collect()), key=str)


def test_saves_keep_other_tables_and_replays_change_nothing(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    w.commit(0, {"items": spark.createDataFrame([("a", 1), (None, 2)], "account_id string, id int")})
    states = lambda *x: spark.createDataFrame(list(x), "account_id string, revision long, state string")
    assert progress.save(w, "states", states(("a", 1, "x"), ("a", 3, "z"), ("b", 1, "p"), (None, 1, "n")), "s", 0) == 2
    assert rows_of(w, "states") == [("a", 3, "z"), ("b", 1, "p")] and rows_of(w.__class__(spark, w.root), "items") == rows_of(w, "items") and w.table("items").count() == 2
    assert progress.save(w, "states", states(("a", 9, "replayed"), ("b", 9, "replayed")), "s", 0) == 2  # batch 0 again: whatever it holds
    assert progress.save(w, "states", states(("a", 2, "old")), "s", 1) == 2
    assert progress.save(w, "states", states(("a", 4, "y"), ("c", 1, "c")), "s", 2) == 3 and rows_of(w, "states") == [("a", 4, "y"), ("b", 1, "p"), ("c", 1, "c")]
    assert progress.save(w, "states", states(("b", 5, "other")), "t", 0) == 4 and rows_of(w, "states")[1] == ("b", 5, "other")


def test_a_save_is_made_again_after_another_commit(spark, tmp_path, monkeypatch):
    w, other = Workspace(spark, str(tmp_path / "w")), Workspace(spark, str(tmp_path / "w"))
    one = lambda *x: spark.createDataFrame([x], "account_id string, revision long, state string")
    progress.save(w, "states", one("a", 1, "x"), "s", 0)
    write = Workspace._write

    def slow(self, tables):
        if self is w:
            monkeypatch.setattr(Workspace, "_write", write)
            progress.save(other, "states", one("a", 3, "newer"), "t", 0)
        return write(self, tables)

    monkeypatch.setattr(Workspace, "_write", slow)
    progress.save(w, "states", one("a", 2, "older"), "s", 1)
    assert rows_of(w, "states") == [("a", 3, "newer")]


def test_many_accounts_go_through_the_map(spark, tmp_path, monkeypatch):
    from tallyforge.sources import workspace

    monkeypatch.setattr(workspace, "MOST_CHANGES", 5)
    w = Workspace(spark, str(tmp_path / "w"))
    states = lambda lo, hi, r: spark.createDataFrame([(f"u{k}", r, f"{k}-{r}") for k in range(lo, hi)], "account_id string, revision long, state string")
    for n, (lo, hi) in enumerate([(0, 3), (2, 20), (4, 6), (5, 9)]):
        progress.save(w, "states", states(lo, hi, n + 1), "s", n)
    last = {k: n + 1 for n, (lo, hi) in enumerate([(0, 3), (2, 20), (4, 6), (5, 9)]) for k in range(lo, hi)}
    assert rows_of(w, "states") == sorted((f"u{k}", r, f"{k}-{r}") for k, r in last.items()) and w.account_revision("u5") == 3


def test_saves_within_the_pause_are_one(rocks, tmp_path):
    spark, schema = rocks, "account_id string, revision long, state string"
    w = Workspace(spark, str(tmp_path / "w"))
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(("a", 1, "x"), ("b", 1, "p"))
    q = progress.autosave(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), w, "states", str(tmp_path / "cp"), every="100 milliseconds", pause=4000)
    try:
        put(("a", 3, "z"), ("a", 2, "y"))
        until = time.time() + 120
        while time.time() < until and (w.revision() == 0 or len(rows_of(w, "states")) < 2):
            time.sleep(0.5)
        assert {r[0] for r in rows_of(w, "states")} == {"a", "b"}
        put(("b", 2, "q"))
        while time.time() < until and ("b", 2, "q") not in rows_of(w, "states"):
            time.sleep(0.5)
    finally:
        q.stop()
    assert rows_of(w, "states") == [("a", 3, "z"), ("b", 2, "q")] and w.account_revision("a") <= 2
