"""Account commits: types, nulls, broken markers, races, bytes written, restore points, clean-up."""

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import workspace
from tallyforge.sources.workspace import StaleRevision, Workspace


def rows(spark, *x, schema="account_id string, id int"):
    return spark.createDataFrame(list(x), schema)


def data_bytes(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def test_accounts_keep_their_type_and_digits(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    w.commit(0, {"items": rows(spark, ("007", 1), ("7", 2), (None, 3)), "logs": rows(spark, schema="account_id string, at timestamp")})
    assert dict(w.table("items").dtypes) == {"account_id": "string", "id": "int"}
    assert {(r.account_id, r.id) for r in w.table("items").collect()} == {("007", 1), ("7", 2), (None, 3)}
    assert [r.id for r in w.table("items", "7").collect()] == [2] and [r.id for r in w.table("items", None).collect()] == [3]
    assert w.table("logs").count() == 0 and dict(w.table("logs").dtypes)["at"] == "timestamp"
    n = Workspace(spark, str(tmp_path / "n"))
    n.commit(0, {"items": rows(spark, (7, 2), schema="account_id long, id int")})
    assert n.table("items", 7).first().account_id == 7


def test_null_accounts_stay(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    w.commit(0, {"items": rows(spark, ("a", 1), (None, 3))})
    w.delete_account("a")
    assert [(r.account_id, r.id) for r in w.table("items").collect()] == [(None, 3)]
    w.replace_account(2, "b", {"items": rows(spark, ("b", 5))})
    assert sorted(r.id for r in w.table("items").collect()) == [3, 5]
    w.replace_account(3, None, {"items": rows(spark, (None, 9))})
    assert sorted(r.id for r in w.table("items").collect()) == [5, 9]
    w.delete_account(None)
    assert [r.id for r in w.table("items").collect()] == [5]
    with pytest.raises(ValueError, match="other accounts"):
        w.replace_account(5, "b", {"items": rows(spark, ("c", 5))})


def test_broken_markers_are_set_aside(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    w.commit(0, {"items": rows(spark, ("a", 1))})
    (tmp_path / "w/_committed/2").write_bytes(b"")
    (tmp_path / "w/_committed/3").write_bytes(b'{"schema": 2')
    assert w.revision() == 1 and w.revisions() == [1] and w.table("items").count() == 1
    assert w.commit(1, {"items": rows(spark, ("a", 2))}) == 2 and [r.id for r in w.table("items").collect()] == [2]
    assert len(os.listdir(tmp_path / "w/_corrupt")) == 1
    (tmp_path / "w/_committed/4").write_text('{"schema": 9, "tables": {}, "map": null, "changes": {}}')
    with pytest.raises(ValueError, match="schema version"):
        w.table("items")


def test_a_write_that_fails_is_never_seen(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    w.commit(0, {"items": rows(spark, ("a", 1))})
    bad = rows(spark, ("a", 2)).withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("int"))
    with pytest.raises(Exception, match="no"):
        w.replace_account(1, "a", {"items": bad})
    assert w.revision() == 1 and [r.id for r in w.table("items").collect()] == [1]


def test_bytes_of_a_commit_do_not_grow_with_other_accounts(spark, tmp_path):
    wrote = []
    for n in (1, 400):
        root = tmp_path / f"w{n}"
        w = Workspace(spark, str(root))
        w.commit(0, {"items": spark.range(n).select(F.concat(F.lit("x"), "id").alias("account_id"), F.col("id").cast("int").alias("id")).coalesce(1)})
        before = data_bytes(root)
        w.commit_account("me", 0, {"items": rows(spark, ("me", 1)).coalesce(1)})
        wrote.append(data_bytes(root) - before)
        assert w.table("items").count() == n + 1
    assert wrote[0] == wrote[1]


def test_writers_of_other_accounts_do_not_disturb(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "w")
    a, b = Workspace(spark, root), Workspace(spark, root)
    a.commit(0, {"items": rows(spark, ("a", 1), ("b", 1))})
    write = Workspace._write

    def slow(self, tables):
        if self is a:
            monkeypatch.setattr(Workspace, "_write", write)
            b.commit_account("b", 1, {"items": rows(spark, ("b", 7))})
        return write(self, tables)

    monkeypatch.setattr(Workspace, "_write", slow)
    assert a.commit_account("a", 1, {"items": rows(spark, ("a", 5))}) == 2
    assert a.revision() == 3 and {(r.account_id, r.id) for r in a.table("items").collect()} == {("a", 5), ("b", 7)}
    with pytest.raises(StaleRevision):
        b.commit_account("a", 1, {"items": rows(spark, ("a", 6))})
    with pytest.raises(StaleRevision):
        b.replace_account(2, "a", {"items": rows(spark, ("a", 6))})


def test_restore_points_of_an_account(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    with pytest.raises(ValueError, match="restore point needs"):
        w.commit_account("a", 0, {"items": rows(spark, ("a", 0))}, {"restore_point_id": "p", "reason": "r", "created_at": "1"})
    w.commit_account("a", 0, {"items": rows(spark, ("a", 0)), "notes": rows(spark, ("a", 70))})
    w.commit_account("b", 0, {"items": rows(spark, ("b", 100))})
    for k in range(1, 6):
        w.commit_account("a", k, {"items": rows(spark, ("a", k))}, {"restore_point_id": f"p{k}", "reason": "edit", "created_at": f"2024-0{k}"})
    assert [(r.restore_point_id, r.account_revision) for r in w.points("a").collect()] == [("p5", 5), ("p4", 4), ("p3", 3)] and w.points("b").count() == 0
    assert [r.id for r in w.table("notes").collect()] == [70]
    assert w.prune(1, grace=0) == list(range(1, 7)) and [r.id for r in w.table("items", "b").collect()] == [100]
    assert w.restore_account("a", "p4", 6) == 7 and [r.id for r in w.table("items", "a").collect()] == [3]
    assert [r.restore_point_id for r in w.points("a").collect()] == ["p5", "p4", "p3"] and [r.id for r in w.table("notes").collect()] == [70]
    with pytest.raises(ValueError, match="no restore point"):
        w.restore_account("a", "p1", 7)


def test_pruning_removes_what_nothing_points_to(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "MOST_CHANGES", 3)
    w = Workspace(spark, str(tmp_path / "w"))
    for k in range(8):
        w.commit_account(f"u{k % 5}", k // 5, {"items": rows(spark, (f"u{k % 5}", k))})
    w.delete_account("u4")
    size = w.storage_bytes()
    assert sorted(r.id for r in w.table("items").collect()) == [3, 5, 6, 7]
    assert w.prune(1, grace=3600) == list(range(1, 9)) and sorted(r.id for r in w.table("items").collect()) == [3, 5, 6, 7]
    w.prune(1, grace=0)
    assert w.storage_bytes() < size and sorted(r.id for r in w.table("items").collect()) == [3, 5, 6, 7]
    assert w._files().select("store_ver").distinct().count() == 4
    assert w.account_revision("u4") == 2 and w.account_revision("u0") == 2


def test_images_missing_and_unreferenced(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    for n in ("a.png", "b.png", "c.png.tmp"):
        (folder / n).write_bytes(b"x")
    images = spark.createDataFrame([("1", "a.png"), ("2", "gone.png"), ("3", "../images/a.png")], "id string, stored_path string")
    assert {r.id: r.missing for r in workspace.image_files(images, str(folder)).collect()} == {"1": False, "2": True, "3": True}
    assert workspace.delete_orphans(spark, str(folder), images.select(F.col("stored_path").alias("path"))) == ["b.png"]
    assert sorted(x for x in os.listdir(folder) if not x.endswith(".crc")) == ["a.png", "c.png.tmp"]
