"""Queries over commands, image orders, histograms and gates; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import parse
from tallyforge.operators import commands, geometry, loadout, overlap, planning
from tallyforge.plans import adapters as A
from tallyforge.plans.cards import OCC
from tallyforge.plans.entities import SLOTTED, _slotted
from tallyforge.plans.queries import BASE
from tallyforge.plans.registry import query
from tallyforge.sources.tables import load


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= o_custkey * 5 AND o_custkey % 4 = 0 THEN 'cancelled' ELSE o_orderstatus END AS status FROM orders")
def cancel_remaining(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("status"))
    gone = o.where("task % 4 = 0").select("task", (F.col("task") * 5).alias("at")).distinct()
    return commands.cancel_rest(o, gone).select("o_orderkey", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'retry' WHEN o_custkey % 3 = 0 THEN 'waiting' ELSE 'job' END AS queue FROM orders")
def import_queue(spark, d):
    c = F.col("o_custkey") % 3
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("failed"), F.when(c == 1, "main").when(c == 2, "support").alias("pool"))
    return commands.retryable(o).select("o_orderkey", "queue")


@query(f"WITH {SLOTTED}, mv AS (SELECT s_suppkey AS operator, 'main1' AS slot, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey * 3 + 1 + s_suppkey % 2 END AS instance FROM supplier) SELECT mv.operator, mv.slot, mv.instance, CASE WHEN mv.instance IS NULL THEN 'cleared' WHEN held.instance IS NOT NULL AND NOT (held.operator = mv.operator AND held.slot = mv.slot) THEN 'occupied' ELSE 'set' END AS outcome FROM mv LEFT JOIN held ON held.instance = mv.instance")
def loadout_moves(spark, d):
    _, lo = _slotted(spark, d)
    s = F.col("s_suppkey")
    moves = load(spark, d, "supplier").select(s.alias("operator"), F.lit("main1").alias("slot"), F.when(s % 3 != 0, s * 3 + 1 + s % 2).alias("instance"))
    return commands.move_slot(lo, moves, loadout.occupancy(lo))


@query("""WITH it AS (SELECT p_partkey AS instance, p_size + 20 AS level, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'support' ELSE 'main' END AS kind FROM part UNION ALL SELECT p_partkey, 1, p_name, 'main' FROM part WHERE p_partkey % 50 = 0),
 c AS (SELECT p_name AS name, CASE WHEN min(p_partkey) % 2 = 0 THEN 'support' ELSE 'main' END AS kind FROM part WHERE p_name < 'm' GROUP BY 1), t AS (SELECT p_partkey AS instance, 30 AS target FROM part WHERE p_partkey % 4 = 0)
 SELECT instance, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY instance) > 1 THEN 'duplicate_id' END, CASE WHEN NOT level BETWEEN 1 AND 60 THEN 'level_out_of_range' END, CASE WHEN c.kind IS NULL THEN 'unknown_name' WHEN c.kind <> it.kind THEN 'kind_mismatch' END, CASE WHEN target < level THEN 'target_below_level' END) AS codes FROM it LEFT JOIN c USING (name) LEFT JOIN t USING (instance)""")
def snapshot_faults(spark, d):
    k = F.col("p_partkey")
    p = load(spark, d, "part")
    items = p.select(k.alias("instance"), (F.col("p_size") + 20).alias("level"), F.col("p_name").alias("name"), F.when(k % 3 == 0, "support").otherwise("main").alias("kind"))
    items = items.unionByName(p.where("p_partkey % 50 = 0").select(k.alias("instance"), F.lit(1).alias("level"), F.col("p_name").alias("name"), F.lit("main").alias("kind")))
    names = p.where("p_name < 'm'").groupBy(F.col("p_name").alias("name")).agg(F.when(F.min("p_partkey") % 2 == 0, "support").otherwise("main").alias("kind"))
    targets = p.where("p_partkey % 4 = 0").select(k.alias("instance"), F.lit(30).alias("target"))
    return commands.snapshot_faults(items, names, targets).withColumn("codes", F.array_join("codes", ","))


@query("WITH im AS (SELECT o_custkey AS batch, o_orderkey AS image, CASE o_orderkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'support' ELSE 'unknown' END AS pool FROM orders) SELECT a.batch, a.image, b.image AS other FROM im a JOIN im b ON a.batch = b.batch AND a.pool = b.pool AND a.image < b.image WHERE a.pool IN ('main', 'support')")
def image_pairs(spark, d):
    k = F.col("o_orderkey")
    return overlap.unordered_pairs(load(spark, d, "orders").select(F.col("o_custkey").alias("batch"), k.alias("image"), F.when(k % 4 == 0, "main").when(k % 4 == 1, "support").otherwise("unknown").alias("pool")))


# images come in pairs, the later of which precedes; batches divisible by 7 hold a contradiction
@query("WITH im AS (SELECT o_custkey AS batch, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS image FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM im) SELECT batch, image, row_number() OVER (PARTITION BY batch ORDER BY CASE WHEN batch % 7 = 0 AND n >= 2 THEN 0 ELSE (image + 1) // 2 END, CASE WHEN batch % 7 = 0 AND n >= 2 THEN image ELSE -image END) AS pos, batch % 7 = 0 AND n >= 2 AS conflict FROM n")
def image_order(spark, d):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    im = load(spark, d, "orders").select(F.col("o_custkey").alias("batch"), rn.alias("image"))
    e = im.where("image % 2 = 0").select("batch", F.col("image").alias("before"), (F.col("image") - 1).alias("after"))
    back = e.where("batch % 7 = 0").select("batch", F.col("after").alias("before"), F.col("before").alias("after"))
    return overlap.image_order(im, e.unionByName(back))


@query(f"{BASE}, s AS (SELECT count(CASE WHEN kind = 'main' AND level > 100 THEN 1 END) AS a, count(CASE WHEN kind = 'support' THEN 1 END) AS b FROM items) SELECT instance_id FROM items, s WHERE CASE WHEN a > 0 THEN kind = 'main' AND level > 100 WHEN b > 0 THEN kind = 'support' ELSE TRUE END")
def experience_scope(spark, d):
    i = A.items(spark, d)
    return planning.scope(i, (F.col("kind") == "main") & (F.col("level") > 100), F.col("kind") == "support").select("instance_id")


@query(f"WITH {OCC}, p AS (SELECT DISTINCT image FROM occ WHERE pool IN ('main', 'support')), a AS (SELECT DISTINCT image FROM occ WHERE complete AND occ_id % 7 = 0) SELECT image FROM p INTERSECT SELECT image FROM a")
def analysed_pools(spark, d):
    o = A.occurrences(spark, d)
    return o.where("pool in ('main', 'support')").select("image").intersect(o.where("complete and occ_id % 7 = 0").select("image"))


@query("SELECT o_orderkey AS pair, o_custkey % 40 AS before, o_orderkey % 40 AS after FROM orders WHERE o_custkey % 40 % 7 <> 0 AND o_orderkey % 40 % 7 <> 0")
def pairs_without_image(spark, d):
    p = load(spark, d, "orders").select(F.col("o_orderkey").alias("pair"), (F.col("o_custkey") % 40).alias("before"), (F.col("o_orderkey") % 40).alias("after"))
    gone = load(spark, d, "nation").select((F.col("n_nationkey") % 6 * 7).cast("long").alias("image")).distinct()
    return commands.without_image(p, gone).select("pair", "before", "after")


@query("WITH p AS (SELECT user_id AS image, event_id % 256 AS v FROM events), h AS (SELECT image, v // 32 AS bin, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT image, sum(n) AS n FROM h GROUP BY 1) SELECT h.image, round(-sum(h.n / t.n * log2(h.n / t.n)) + 0.0, 6) AS entropy, CAST(count(*) AS BIGINT) AS bins, any_value(m) AS median FROM h JOIN t USING (image) JOIN (SELECT image, median(v) AS m FROM p GROUP BY 1) USING (image) GROUP BY 1")
def pixel_statistics(spark, d):
    p = load(spark, d, "events").select(F.col("user_id").alias("image"), (F.col("event_id") % 256).alias("v"))
    return geometry.pixel_statistics(p, 32)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 70 BETWEEN 1 AND 60 ELSE FALSE END AS level_exit, event_id % 5 = 0 AND event_id % 101 >= 85 AS name_exit, event_id % 3 = event_id % 2 AS agree_exit FROM events")
def exit_gates(spark, d):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat((e % 70).cast("string"), F.lit("级"))).otherwise((e % 70).cast("string"))
    return load(spark, d, "events").select("event_id", parse.strict_level_text(text).alias("level_exit"), parse.name_exit(e % 5 == 0, e % 101, 85).alias("name_exit"), parse.agreement_exit(e % 3, e % 2).alias("agree_exit"))


@query("SELECT user_id, string_agg(CASE WHEN event_id % 2 = 0 THEN '0' ELSE CAST(event_id % 10 AS VARCHAR) END, '' ORDER BY ts, event_id) AS text FROM events GROUP BY 1")
def merged_tokens(spark, d):
    e = load(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 2 == 0, " O").otherwise((F.col("event_id") % 10).cast("string")).alias("token"))
    return parse.merge_tokens(e, "user_id", ["ts", "event_id"], "token")


@query("SELECT l_orderkey AS image, CASE WHEN count(CASE WHEN l_partkey % 5 = 0 THEN 1 END) > count(CASE WHEN l_partkey % 5 = 1 THEN 1 END) THEN 'main' WHEN count(CASE WHEN l_partkey % 5 = 1 THEN 1 END) > count(CASE WHEN l_partkey % 5 = 0 THEN 1 END) THEN 'support' ELSE 'unknown' END AS page FROM lineitem GROUP BY 1")
def page_by_names(spark, d):
    k = F.col("l_partkey") % 5
    return parse.page_by_names(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.when(k == 0, "main").when(k == 1, "support").alias("kind")), "image")
