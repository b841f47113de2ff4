"""Whole searches and counts, plan summaries, header observations and review rows; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import consensus, inventory, overlap, planning, reconcile, review
from tallyforge.plans import adapters as A
from tallyforge.plans.cards import IMAGES, OCC, _images
from tallyforge.plans.queries import BASE, CELLS, ITEMS
from tallyforge.plans.registry import query
from tallyforge.sources.tables import load


@query(f"WITH {ITEMS}, a AS (SELECT 'rot' AS alias, min(name) AS name FROM items) SELECT instance_id, items.name AS name FROM items, a WHERE kind = 'main' AND quality = 3 AND (contains(items.name, a.name) OR contains(items.name, 'green') OR contains(items.name || '(' || quality || ')', 'e(3)'))")
def inventory_filter_whole(spark, d):
    i = A.items(spark, d)
    aliases = i.agg(F.min("name").alias("name")).select(F.lit("rot").alias("alias"), "name")
    return inventory.search_whole(i, "rot green、e(3)", aliases, kind="main", quality=3).select("instance_id", "name")


@query(f"WITH {ITEMS}, f AS (SELECT * FROM items WHERE quality <> 1) SELECT instance_id, CASE WHEN row_number() OVER (PARTITION BY kind, name ORDER BY level DESC, quality, source_order, row_index, column_index, instance_id) = 1 THEN count(*) OVER (PARTITION BY kind, name) END AS group_count FROM f")
def inventory_group_counts_filtered(spark, d):
    return inventory.filtered_group_counts(A.items(spark, d).where("quality <> 1"), ["-level", "quality", *inventory.STABLE])


@query("SELECT p_partkey AS instance_id FROM part WHERE p_partkey % 3 = 0 OR p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def manual_rows_kept(spark, d):
    k = F.col("p_partkey")
    rows = load(spark, d, "part").select(k.alias("instance_id"), F.when(k % 3 != 0, k).alias("occ"))
    return reconcile.manual_kept(rows, load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("occ"))).select("instance_id")


@query("SELECT o_custkey AS batch, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS pos, o_orderkey AS image FROM orders")
def image_places(spark, d):
    b = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("images"))
    return review.image_places(b)


@query(f"WITH {IMAGES}, r AS (SELECT event_id AS occ_id, count(*) AS relations FROM (SELECT event_id FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id FROM events WHERE event_id % 6 = 0) GROUP BY 1) SELECT occ_id, image, images.pool, images.first AS place, coalesce(relations, 0) AS relations, CASE WHEN occ_id % 9 = 0 THEN 'edit' ELSE 'none' END AS choice FROM occ JOIN images USING (image) LEFT JOIN r USING (occ_id)")
def review_rows(spark, d):
    o = A.occurrences(spark, d)
    ids = o.select("occ_id")
    rel = ids.where("occ_id % 4 = 0").unionByName(ids.where("occ_id % 6 = 0"))
    return review.review_rows(o.select("occ_id", "image"), _images(spark, d).withColumnRenamed("first", "place"), rel, ids.where("occ_id % 9 = 0").withColumn("choice", F.lit("edit")))


@query("""WITH x AS (SELECT user_id % 20 AS batch, event_id % 97 AS decode, event_id % 89 AS detect, CASE event_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'support' ELSE 'experience' END AS page FROM events)
 SELECT batch, count(*) AS images, CAST(sum(decode) AS BIGINT) AS decode, CAST(sum(detect) AS BIGINT) AS detect, 'experience=' || count(CASE WHEN page = 'experience' THEN 1 END) || ';main=' || count(CASE WHEN page = 'main' THEN 1 END) || ';support=' || count(CASE WHEN page = 'support' THEN 1 END) AS pages FROM x GROUP BY 1""")
def performance_report(spark, d):
    e = F.col("event_id")
    x = load(spark, d, "events").select((F.col("user_id") % 20).alias("batch"), (e % 97).alias("decode"), (e % 89).alias("detect"), F.when(e % 3 == 0, "main").when(e % 3 == 1, "support").otherwise("experience").alias("page"))
    r = review.performance(x, "batch", ["decode", "detect"])
    n = lambda k: F.concat(F.lit(f"{k}="), F.coalesce(F.col("pages")[k], F.lit(0)).cast("string"))
    return r.withColumn("pages", F.concat_ws(";", n("experience"), n("main"), n("support")))


@query(f"""{BASE.replace('min(l_orderkey) % 60 + 1', 'min(l_orderkey) % 62 + 1')}, r AS (SELECT count(CASE WHEN raw > 0 THEN 1 END) AS upgrading, CAST(coalesce(sum(rounded), 0) AS BIGINT) AS required FROM cost), s AS (SELECT count(*) AS skipped FROM plan WHERE goal > 60), o AS (SELECT CAST(9 * 500 + 7 * 100 AS BIGINT) AS owned)
 SELECT upgrading, required, skipped, owned, CAST(greatest(0, required - owned) AS BIGINT) AS gap, CAST((greatest(0, required - owned) + 1499) // 1500 AS BIGINT) AS runs, CAST((required + 1499) // 1500 AS BIGINT) AS all_runs, CAST(10 * ((greatest(0, required - owned) + 1499) // 1500) AS BIGINT) AS stamina, CAST(required // 500 AS BIGINT) AS purple, CAST(required % 500 // 100 AS BIGINT) AS white FROM r, s, o""")
def plan_summary(spark, d):
    li = load(spark, d, "lineitem").where("l_partkey % 4 <> 0")
    t = li.groupBy(F.col("l_partkey").alias("instance_id")).agg((F.min("l_orderkey") % 62 + 1).cast("int").alias("target"))
    stock = spark.createDataFrame([(None, 9, 7)], "orange int, purple int, white int")
    return planning.summary(A.items(spark, d), t, planning.level_cost(spark), stock, white=100, purple=500, orange=3000, run_yield=1500, run_cost=10, with_orange=False)


@query("""WITH c AS (SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal, CAST(l_partkey % 3 AS INT) AS current, CAST(l_suppkey % 2 + 1 AS INT) AS capacity, CAST(l_partkey % 100 AS INT) AS conf FROM lineitem),
 b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY conf DESC, ordinal) = 1), k AS (SELECT grp, count(DISTINCT CASE WHEN conf >= 65 THEN 10 * current + capacity END) AS kinds FROM c GROUP BY 1)
 SELECT grp, current, capacity, conf, CASE WHEN conf < 65 THEN 'uncertain' WHEN kinds > 1 THEN 'ambiguous' WHEN current > capacity THEN 'invalid' ELSE 'confirmed' END AS status FROM b JOIN k USING (grp)""")
def header_observation(spark, d):
    from pyspark.sql import Window

    o = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    p = F.col("l_partkey")
    c = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), o.alias("ordinal"), (p % 3).cast("int").alias("current"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("capacity"), (p % 100).cast("int").alias("conf"))
    return consensus.header_observation(c)


@query(f"WITH {OCC} SELECT image, r, count(DISTINCT c) = 4 AND bool_and(complete) AS whole, CAST(count(*) AS BIGINT) AS cells FROM occ GROUP BY 1, 2")
def structural_rows(spark, d):
    return A.occurrences(spark, d).groupBy("image", F.col("r").cast("long").alias("r")).agg(((F.count_distinct("c") == 4) & F.bool_and("complete")).alias("whole"), F.count("*").alias("cells"))


# every length that both images have, not the five of the older queries
_ALL = CELLS.replace("(SELECT unnest(range(1, 6)) AS len) l", "(SELECT unnest(range(1, (SELECT max(n) + 1 FROM nr))) AS len) l")


@query(f"WITH {_ALL}, a AS (SELECT user_id, k, max(len) AS len FROM agg WHERE bad = 0 AND anchors > 0 GROUP BY 1, 2), x AS (SELECT user_id, k, max(len) AS len FROM agg WHERE bad > 0 AND (user_id, k) NOT IN (SELECT (user_id, k) FROM a) GROUP BY 1, 2) SELECT user_id, k, len, 'aligned' AS status FROM a UNION ALL SELECT user_id, k, len, 'conflict' FROM x")
def align_with_evidence(spark, d):
    return overlap.align_with_evidence(A.cells(spark, d))
