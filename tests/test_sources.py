"""Sources and stores on small fixtures."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import commands, draft, overlap, planning
from tallyforge.sources import catalog, images, workspace


def test_catalog_and_aliases(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"stars": [{"name": "a", "kind": "main", "aliases": ["x", "y"]}, {"name": "b", "kind": "main", "aliases": []}]}))
    c = catalog.load_catalog(spark, str(tmp_path / "c.json"))
    assert [(r.order_index, r.name) for r in c.orderBy("order_index").collect()] == [(0, "a"), (1, "b")]
    more = spark.createDataFrame([("z", "b")], "alias string, name string")
    assert {r.alias: r.name for r in catalog.aliases_of(c, more).collect()} == {"x": "a", "y": "a", "z": "b"}
    with pytest.raises(Exception, match="several names: x"):
        catalog.aliases_of(c, spark.createDataFrame([("x", "b")], "alias string, name string")).collect()


def test_header_row(spark):
    cells = spark.createDataFrame([(0, 0, "title"), (1, 1, "name"), (1, 2, "level"), (2, 1, "name")], "row int, column int, value string")
    assert {r.name: r.column for r in catalog.header_row(cells, ["name", "level"]).collect()} == {"name": 1, "level": 2}
    with pytest.raises(Exception, match="missing header kind"):
        catalog.header_row(cells, ["name", "kind"]).collect()


def test_image_sizes(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x02\0\0\0"
    jpg = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xc0\x00\x11\x08" + struct.pack(">HH", 300, 200) + b"\x03" + b"\0" * 20
    for name, data in (("a.png", png), ("b.JPG", jpg), ("c.gif", png), ("d.png", b"nothing")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.rejected) for r in images.uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (640, 480, None), "b.JPG": (200, 300, None), "c.gif": (640, 480, "suffix"), "d.png": (None, None, "unreadable")}


def test_workspace_commits_and_restores(spark, tmp_path):
    w = workspace.Workspace(spark, str(tmp_path / "w"))
    rows = lambda *x: spark.createDataFrame(list(x), "account_id string, id int")
    assert w.revision() == 0 and w.commit(0, {"items": rows(("a", 1), ("b", 2))}) == 1
    with pytest.raises(workspace.StaleRevision):
        w.commit(0, {"items": rows(("a", 9))})
    assert w.commit(1, {"items": rows(("a", 3), ("b", 4))}) == 2
    assert [r.id for r in w.table("items", "a").collect()] == [3]
    assert w.delete_account("a") == 3 and [r.id for r in w.table("items").collect()] == [4]
    assert w.restore(1) == 4 and sorted(r.id for r in w.table("items").collect()) == [1, 2]
    assert [r.revision for r in w.restore_points().collect()] == [4, 3, 2] and w.storage_bytes() > 0
    assert w.prune(3) == [1] and w.revisions() == [2, 3, 4] and sorted(r.id for r in w.table("items").collect()) == [1, 2]


def test_draft_store_and_orphans(spark):
    order = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "draft int, image string")
    meta = spark.createDataFrame([(1, "a"), (1, "c")], "draft int, image string")
    assert {(r.image, r.fault) for r in workspace.draft_faults(order, meta).collect()} == {("a", "listed_twice"), ("b", "no_metadata"), ("c", "not_listed")}
    files = spark.createDataFrame([("x",), ("y",)], "path string")
    assert [r.path for r in workspace.orphans(files, files.limit(0)).orderBy("path").collect()] == ["x", "y"]
    points = spark.createDataFrame([("a", f"p{k}", k) for k in range(5)], "account_id string, restore_point_id string, created_at int")
    kept, rest = workspace.retained(points, {"blobs": points.select("restore_point_id")})
    assert sorted(r.created_at for r in kept.collect()) == [2, 3, 4] and rest["blobs"].count() == 3
    got = workspace.accounts(spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "account_id string, created_at int")).collect()
    assert {r.account_id: r.pos for r in got} == {"c": 1, "a": 2, "b": 3}


def cells(spark, rows):
    """rows: (k, r, names, level, quality)."""
    out = [(1, k, r, c, n, lv, q) for k, r, names, lv, q in rows for c, n in enumerate(names)]
    return spark.createDataFrame(out, "user_id long, k long, r int, c int, name string, level int, quality int")


def test_alignment_takes_any_length_and_vetoes(spark):
    eight = [(k, r, "abcd", r + 1, 0) for k in (0, 1) for r in range(8)]
    assert [r.len for r in overlap.align(cells(spark, eight), "strict").collect()] == [8]
    assert [(r.len, r.confirmed) for r in overlap.align_targeted(cells(spark, eight)).collect()] == [(8, 8)]
    # six rows against six, shifted by one: five in common
    shifted = [(0, r, "abcd", r + 1, 0) for r in range(6)] + [(1, r, "abcd", r + 2, 0) for r in range(6)]
    assert [r.len for r in overlap.align_targeted(cells(spark, shifted)).collect()] == [5]
    one = lambda *b: overlap.align_targeted(cells(spark, [(0, 0, "abcd", 5, 1), (1, 0, *b)])).count()
    assert one("abcd", 5, 1) == 1 and one("abce", 5, 1) == one("abcd", 6, 1) == one("abcd", 5, 2) == 0
    assert one("abcd", None, 1) == 0  # nothing confirmed
    gap = [(0, r, "abcd", r + 1, 0) for r in (0, 2)] + [(1, r, "abcd", 2 * r + 1, 0) for r in (0, 1)]
    assert overlap.align_targeted(cells(spark, gap)).count() == 0  # only the last row is continuous, and it isn't the first of the next


def test_pending_and_base_revision(spark):
    t = spark.createDataFrame([("0",), ("12",), ("012",), ("-1",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(draft.base_revision(F.col("t"))).collect()] == [0, 12, None, None, None, None]


def test_retired_draft_needs_equal_sets(spark):
    ids = lambda *x: spark.createDataFrame([(1, i) for i in x], "draft int, image string")
    got = lambda a, b, c: [r.retired for r in commands.retired(a, b, c).collect()]
    assert got(ids("a", "b"), ids("b", "a"), ids("a", "b")) == [True]
    assert got(ids("a", "b"), ids("a"), ids("a", "b")) == got(ids("a"), ids("a", "b"), ids("a")) == got(ids("a", "a"), ids("a"), ids("a")) == [False]


def test_scope_falls_through(spark):
    x = spark.createDataFrame([(1, False, True), (2, False, False)], "id int, s boolean, f boolean")
    ids = lambda y: sorted(r.id for r in y.collect())
    assert ids(planning.scope(x, F.col("s"), F.col("f"))) == [1]
    assert ids(planning.scope(x, F.col("s"), F.col("s"))) == [1, 2]
    assert ids(planning.scope(x, F.col("id") == 2, F.col("f"))) == [2]


def test_finalize_replaces_one_account(spark, tmp_path):
    w = workspace.Workspace(spark, str(tmp_path / "w"))
    card = "card long, k int, r int, c int, name string, level int, quality int, conf int, manual boolean"
    cards = spark.createDataFrame([(1, 0, 0, 0, "a", 5, 1, 90, False), (2, 1, 0, 0, "a", 5, 2, 95, False), (3, 1, 0, 1, "b", 7, 3, 50, False), (4, 1, 0, 2, None, 7, 3, 50, False)], card)
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "card long, component long")
    assert w.replace_account(0, "me", draft.finalized(cards, groups, "me")) == 1
    assert w.replace_account(1, "you", draft.finalized(cards.where("card = 3"), groups.where("card = 3"), "you")) == 2
    assert {(r.account_id, r.instance, r.name, r.quality) for r in w.table("inventory").collect()} == {("me", 1, "a", 2), ("me", 3, "b", 3), ("you", 3, "b", 3)}
    assert {r.card for r in w.table("evidence", "me").collect()} == {1, 2, 3} and w.table("targets").count() == 0
    with pytest.raises(workspace.StaleRevision):
        w.replace_account(1, "me", {})
