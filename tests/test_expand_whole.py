import uuid

from pyspark.sql import functions as F

from tallyforge.operators import inventory
from tallyforge.plans.queries import QUERIES


def test_every_unit_is_a_copy(spark, tmp_path):
    rows = [(1, 1, 7, 50.0), (1, 2, 8, 4.0), (2, 1, 7, 1.0), (3, 1, 9, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["expand_quantity_whole"](spark, str(tmp_path)).groupBy("l_orderkey", "l_linenumber").agg(F.count("*"), F.max("copy")).collect()
    assert {tuple(r) for r in got} == {(1, 1, 50, 50), (1, 2, 4, 4), (2, 1, 1, 1)}


def test_one_item_of_many_units_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(inventory, "TASK", 5000, raising=False)
    rows = [("a", 20_000), ("b", 1), ("c", 0), ("d", 1024), ("e", 1025), ("f", None), (None, 2)]
    x = inventory.instances(spark.createDataFrame(rows, "id string, quantity long").coalesce(1))
    got = x.select("id", "copy", F.spark_partition_id().alias("p")).collect()
    want = [(i if k == 0 or i is None else str(uuid.uuid5(uuid.NAMESPACE_URL, f"{i}:{k}")), k) for i, n in rows for k in range(n or 0)]
    assert sorted((r.id or "", r.copy) for r in got) == sorted((i or "", k) for i, k in want)
    assert len({r.p for r in got}) == 5 and x.columns == ["id", "copy"]
