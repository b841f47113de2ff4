"""The engine's own queries over the driver's tables, each with its DuckDB SQL.

Queries are thin: adapters map a driver table into the observation schemas, operators do the work.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import parse
from tallyforge.operators import components, consensus, inventory, overlap, planning, reconcile, sequence
from tallyforge.plans import adapters as A
from tallyforge.plans.registry import ORACLE_SQL, QUERIES, query
from tallyforge.sources.tables import load

LEVELS = "lv AS (SELECT i AS level, CASE WHEN i <= 30 THEN 100 * i ELSE 4000 END AS xp FROM (SELECT unnest(range(1, 61)) AS i))"
COSTS = "cum AS (SELECT level, CAST(coalesce(sum(xp) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cost FROM lv)"
ITEMS = """items AS (SELECT p_partkey AS instance_id, CASE WHEN p_partkey % 3 = 0 THEN 'support' ELSE 'main' END AS kind, p_name AS name, CAST(p_size AS INT) AS level,
 CAST(substr(p_brand, 7) AS INT) % 5 AS quality, CAST(p_partkey % 20 AS INT) AS source_order, CAST(p_partkey % 7 AS INT) AS row_index, CAST(p_partkey % 4 AS INT) AS column_index FROM part),
targets AS (SELECT l_partkey AS instance_id, CAST(min(l_orderkey) % 60 + 1 AS INT) AS target FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1)"""
CATALOG = "catalog AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT DISTINCT name FROM items))"
PLAN = """plan AS (SELECT i.*, greatest(i.level, coalesce(t.target, i.level)) AS goal FROM items i LEFT JOIN targets t USING (instance_id)),
need AS (SELECT p.*, b.cost - a.cost AS raw FROM plan p JOIN cum a ON a.level = p.level JOIN cum b ON b.level = p.goal),
cost AS (SELECT *, (raw + 99) - ((raw + 99) % 100) AS rounded FROM need)"""
BASE = f"WITH {LEVELS}, {COSTS}, {ITEMS}, {CATALOG}, {PLAN}"


@query(f"{BASE} SELECT count(CASE WHEN raw > 0 THEN 1 END) AS upgrading, CAST(sum(rounded) AS BIGINT) AS required FROM cost")
def plan_requirement(spark, d):
    c = planning.requirement(A.items(spark, d), A.targets(spark, d), planning.level_cost(spark))
    return c.agg(F.count(F.when(F.col("raw") > 0, 1)).alias("upgrading"), F.sum("rounded").alias("required"))


@query(f"""{BASE}, r AS (SELECT CAST(sum(rounded) AS BIGINT) AS required FROM cost), o AS (SELECT 'known' AS stock, 3000 * 1 + 500 * 2 + 100 * 3 AS owned UNION ALL SELECT 'unknown', NULL)
 SELECT stock, required, CAST(owned AS BIGINT) AS owned, CAST(greatest(0, required - owned) + 0 * owned AS BIGINT) AS gap, CAST((greatest(0, required - owned) + 0 * owned + 1499 - ((greatest(0, required - owned) + 0 * owned + 1499) % 1500)) / 1500 AS BIGINT) AS runs FROM r, o""")
def plan_gap_unknown_stock(spark, d):
    c = planning.requirement(A.items(spark, d), A.targets(spark, d), planning.level_cost(spark)).agg(F.sum("rounded").alias("required"))
    stock = spark.createDataFrame([("known", 1, 2, 3), ("unknown", None, 2, 3)], "stock string, orange int, purple int, white int")
    return planning.gap(c, stock, orange=3000, purple=500, white=100, run_yield=1500)


@query(f"{BASE} SELECT kind, name, count(*) AS n, CAST(sum(rounded) AS BIGINT) AS required FROM cost WHERE raw > 0 GROUP BY 1, 2")
def plan_by_group(spark, d):
    c = planning.requirement(A.items(spark, d), A.targets(spark, d), planning.level_cost(spark))
    return c.where("raw > 0").groupBy("kind", "name").agg(F.count("*").alias("n"), F.sum("rounded").alias("required"))


@query(f"WITH {LEVELS} SELECT CAST(level AS INT) AS level, CAST(xp AS BIGINT) AS exp FROM lv")
def rule_interval_expand(spark, d):
    return planning.level_cost(spark)


@query(f"{BASE} SELECT instance_id, (goal - (rounded % 2)) AS goal, rounded, (rounded - rounded % 500) / 500 AS purple, ((rounded % 500) - (rounded % 500) % 100) / 100 AS white FROM cost".replace("(goal - (rounded % 2)) AS goal", "goal").replace("(rounded - rounded % 500) / 500", "CAST((rounded - rounded % 500) / 500 AS BIGINT)").replace("((rounded % 500) - (rounded % 500) % 100) / 100", "CAST(((rounded % 500) - (rounded % 500) % 100) / 100 AS BIGINT)"))
def plan_material_split(spark, d):
    c = planning.requirement(A.items(spark, d), A.targets(spark, d), planning.level_cost(spark))
    return c.select("instance_id", "goal", "rounded", F.expr("rounded div 500").alias("purple"), F.expr("(rounded % 500) div 100").alias("white"))


@query(f"{BASE} SELECT instance_id, goal FROM plan WHERE goal > level AND goal <= 60")
def plan_strict_prune(spark, d):
    return planning.overlay(A.items(spark, d), A.targets(spark, d)).where("goal > level and goal <= 60").select("instance_id", "goal")


@query(f"WITH {ITEMS} SELECT instance_id, name FROM items WHERE kind = 'main' AND (contains(name, 'red') OR contains(name, 'green') OR contains(name || '(' || CAST(quality AS VARCHAR) || ')', '(3)'))")
def inventory_filter_alias(spark, d):
    return inventory.search(A.items(spark, d), "rouge, green；(3)", kind="main", aliases={"rouge": "red"}, display=True).select("instance_id", "name")


@query(f"WITH {ITEMS} SELECT instance_id, name FROM items WHERE contains(name, 'red') OR contains(name, 'green')")
def inventory_filter_plain(spark, d):
    return inventory.search(A.items(spark, d), "red green").select("instance_id", "name")


def _order(name: str, keys: str):
    @query(f"{BASE} SELECT instance_id, row_number() OVER (ORDER BY {keys}) AS pos FROM items JOIN catalog USING (name)")
    def run(spark, d, name=name):
        return inventory.ranked(A.items(spark, d), name)

    QUERIES[f"inventory_order_{name}"], ORACLE_SQL[f"inventory_order_{name}"] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


_order("default", "kind, level DESC, idx, name, quality, source_order, row_index, column_index, instance_id")
_order("catalog_first", "kind, idx, name, level DESC, quality, source_order, row_index, column_index, instance_id")
_order("snapshot", "kind, idx, level DESC, quality, source_order, row_index, column_index, instance_id")


@query(f"WITH {ITEMS} SELECT kind, name, count(*) AS total, count(CASE WHEN quality = 1 THEN 1 END) AS shown FROM items GROUP BY 1, 2 HAVING count(CASE WHEN quality = 1 THEN 1 END) > 0")
def inventory_summary(spark, d):
    return inventory.summary(A.items(spark, d), F.col("quality") == 1)


@query(f"""WITH {ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY level DESC, name, quality, instance_id) AS r FROM items),
 g AS (SELECT *, lag(name) OVER w AS pn, lag(level) OVER w AS pl, lag(quality) OVER w AS pq FROM o WINDOW w AS (PARTITION BY kind ORDER BY r))
 SELECT instance_id, CASE WHEN pn = name AND pl = level AND pq = quality THEN NULL ELSE count(*) OVER (PARTITION BY kind, level, name, quality) END AS group_count FROM g""")
def inventory_group_counts(spark, d):
    return inventory.group_counts(A.items(spark, d))


@query("SELECT l_orderkey, l_linenumber, l_partkey, i AS copy FROM (SELECT *, unnest(range(1, CAST(least(l_quantity, 3) AS BIGINT) + 1)) AS i FROM lineitem)")
def expand_quantity(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.least("l_quantity", F.lit(3)).cast("long").alias("quantity"))
    return inventory.expand(li).withColumnRenamed("copy_index", "copy")


@query("SELECT l_orderkey, l_linenumber, l_partkey, i AS copy FROM (SELECT *, unnest(range(1, CAST(l_quantity AS BIGINT) + 1)) AS i FROM lineitem)")
def expand_quantity_whole(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"))
    return inventory.expand(li).withColumnRenamed("copy_index", "copy")


@query(f"WITH {ITEMS} SELECT kind, name, quality, level, min(instance_id) AS instance_id, count(*) AS quantity FROM items GROUP BY 1, 2, 3, 4")
def merge_identical(spark, d):
    return inventory.merge_identical(A.items(spark, d).withColumn("quantity", F.lit(1).cast("long")))


@query(f"WITH {ITEMS}, e AS (SELECT unnest([NULL, 1, 1999, 10000000]) AS expected), a AS (SELECT count(*) AS actual FROM items) SELECT CAST(expected AS BIGINT) AS expected, actual, CASE WHEN expected IS NULL THEN 'not_provided' WHEN actual = expected THEN 'matched' WHEN actual < expected THEN 'possibly_incomplete' ELSE 'possibly_duplicated' END AS status FROM e, a")
def reconcile_total(spark, d):
    e = spark.createDataFrame([(None,), (1,), (1999,), (10000000,)], "expected long")
    return reconcile.total(A.items(spark, d).withColumn("quantity", F.lit(1).cast("long")), e)


VOTES = "votes AS (SELECT l_orderkey AS grp, l_linenumber AS value, CAST(round(l_discount * 1000) AS BIGINT) + CASE WHEN l_returnflag = 'A' THEN 220 ELSE 0 END AS weight FROM lineitem)"


@query(f"""WITH {VOTES}, s AS (SELECT grp, value, CAST(sum(weight) AS BIGINT) AS w FROM votes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY w DESC, value) AS k FROM s),
 p AS (SELECT grp, max(CASE WHEN k = 1 THEN value END) AS value, max(CASE WHEN k = 1 THEN w END) AS best, coalesce(max(CASE WHEN k = 2 THEN w END), 0) AS second FROM r GROUP BY 1)
 SELECT grp, CASE WHEN best - second >= 150 THEN value END AS value, best, second FROM p""")
def level_consensus(spark, d):
    return consensus.weighted_vote(A.votes(spark, d), margin=150)


OBS = """obs AS (SELECT user_id AS grp, event_id, CAST(event_id % 3 AS INT) AS value, CAST(40 + event_id % 60 AS INT) AS conf FROM events)"""


@query(f"""WITH {OBS}, s AS (SELECT grp, value, CAST(sum(conf) AS BIGINT) AS w, min(event_id) AS f FROM obs GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY w DESC, f) AS k, count(*) OVER (PARTITION BY grp) AS kinds, sum(w) OVER (PARTITION BY grp) AS t FROM s),
 n AS (SELECT grp, count(*) AS c FROM obs GROUP BY 1) SELECT grp, value, least(CAST(99 * c AS BIGINT), w) AS score, kinds > 1 AS conflict FROM r JOIN n USING (grp) WHERE k = 1""")
def bag_consensus(spark, d):
    return consensus.first_seen_vote(A.observations(spark, d))


@query(f"""WITH {OBS}, g AS (SELECT grp, count(DISTINCT CASE WHEN conf >= 65 THEN value END) AS k, min(CASE WHEN conf >= 65 THEN value END) AS v, min(CASE WHEN conf >= 65 THEN conf END) AS c FROM obs GROUP BY 1)
 SELECT grp, CASE WHEN k = 1 THEN v END AS value, CASE WHEN k = 1 THEN c END AS confidence, CASE WHEN k = 0 THEN 'unrecognized' WHEN k > 1 THEN 'conflict' ELSE 'agreed' END AS status FROM g""")
def bag_resolution(spark, d):
    return consensus.agreement(A.observations(spark, d), reliable=65)


@query(f"""WITH {OBS}, g AS (SELECT grp, count(CASE WHEN event_id % 41 = 0 THEN 1 END) AS bad, count(CASE WHEN event_id % 29 = 0 THEN 1 END) AS amb, count(DISTINCT CASE WHEN conf >= 65 THEN value END) AS k, count(CASE WHEN conf >= 65 THEN 1 END) AS n FROM obs GROUP BY 1)
 SELECT grp, CASE WHEN bad > 0 THEN 'invalid' WHEN amb > 0 THEN 'conflict' WHEN n = 0 THEN 'unknown' WHEN k > 1 THEN 'conflict' WHEN n = 1 THEN 'candidate' ELSE 'confirmed' END AS status FROM g""")
def header_status(spark, d):
    o = A.observations(spark, d).withColumn("state", F.when(F.col("event_id") % 41 == 0, "invalid").when(F.col("event_id") % 29 == 0, "ambiguous").otherwise("ok"))
    o = o.withColumn("invalid", F.col("event_id") % 41 == 0).withColumn("ambiguous", F.col("event_id") % 29 == 0)
    return consensus.field_status(o, reliable=65)


SEQ = "seq AS (SELECT conv_id AS image, turn AS pos, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS key, CAST(60 - length(text) % 60 AS INT) AS level FROM conversations)"


@query(f"WITH {SEQ}, g AS (SELECT *, CASE WHEN key IS NULL OR lag(key) OVER w IS DISTINCT FROM key THEN 1 ELSE 0 END AS brk FROM seq WINDOW w AS (PARTITION BY image ORDER BY pos)) SELECT image, pos, CAST(sum(brk) OVER (PARTITION BY image ORDER BY pos) AS BIGINT) AS island FROM g")
def sequence_islands(spark, d):
    return sequence.islands(A.sequence(spark, d)).select("image", "pos", "island")


@query(f"WITH {SEQ} SELECT image, pos, CASE WHEN key IS NULL AND lag(key) OVER w = lead(key) OVER w THEN lag(key) OVER w ELSE key END AS key FROM seq WINDOW w AS (PARTITION BY image ORDER BY pos)")
def sequence_sandwich(spark, d):
    return sequence.sandwich(A.sequence(spark, d)).select("image", "pos", "key")


@query(f"WITH {SEQ} SELECT image, pos, CASE WHEN level > lag(level) OVER w THEN NULL ELSE level END AS level, coalesce(level > lag(level) OVER w, FALSE) AS conflict FROM seq WINDOW w AS (PARTITION BY image ORDER BY pos)")
def sequence_order_conflict(spark, d):
    return sequence.order_conflicts(A.sequence(spark, d)).select("image", "pos", "level", "conflict")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def top3_retention(spark, d):
    return inventory.newest(load(spark, d, "events"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id")


CELLS = """base AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
 occ AS (SELECT user_id, k, event_id, CAST(floor((rn - 12 * k) / 4) AS INT) AS r, CAST((rn - 12 * k) % 4 AS INT) AS c, CASE WHEN event_id % 37 = 0 THEN NULL ELSE event_type END AS name, 1 + CAST(floor(value) AS INT) % 60 AS level
  FROM (SELECT *, unnest(CASE WHEN rn >= 12 AND rn % 12 < 8 THEN [rn // 12 - 1, rn // 12] ELSE [rn // 12] END) AS k FROM base)),
 fullrows AS (SELECT user_id, k, r FROM occ GROUP BY ALL HAVING count(DISTINCT c) = 4), nr AS (SELECT user_id, k, count(*) AS n FROM fullrows GROUP BY ALL), fr AS (SELECT * FROM fullrows JOIN nr USING (user_id, k)),
 cand AS (SELECT a.user_id, a.k, l.len, a.r AS ra, b.r AS rb FROM fr a JOIN fr b ON a.user_id = b.user_id AND b.k = a.k + 1 JOIN (SELECT unnest(range(1, 6)) AS len) l ON l.len <= least(a.n, b.n) WHERE b.r < l.len AND a.r = a.n - l.len + b.r),
 cmp AS (SELECT x.user_id, x.k, x.len, x.ra, x.rb, sum(CASE WHEN a.name <> b.name OR a.level <> b.level THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN a.name = b.name AND a.level = b.level THEN 1 ELSE 0 END) AS same
  FROM cand x JOIN occ a ON a.user_id = x.user_id AND a.k = x.k AND a.r = x.ra JOIN occ b ON b.user_id = x.user_id AND b.k = x.k + 1 AND b.r = x.rb AND b.c = a.c GROUP BY ALL),
 agg AS (SELECT user_id, k, len, sum(CASE WHEN bad > 0 THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN same = 4 THEN 1 ELSE 0 END) AS anchors, min(same) AS least FROM cmp GROUP BY ALL)"""


@query(f"WITH {CELLS} SELECT user_id, k, CAST(r AS INT) AS r FROM fullrows")
def full_rows(spark, d):
    return overlap.full_rows(A.cells(spark, d)).select("user_id", "k", "r")


for _name, _keep in (("align_browser", "bad = 0 AND anchors > 0"), ("align_rebuild", "bad = 0"), ("align_strict", "least = 4")):
    QUERIES[_name] = lambda spark, d, rule=_name: overlap.align(A.cells(spark, d), rule.removeprefix("align_"))
    ORACLE_SQL[_name] = f"WITH {CELLS} SELECT user_id, k, max(len) AS len FROM agg WHERE {_keep} GROUP BY 1, 2"


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative FROM documents")
def exact_duplicates(spark, d):
    return components.exact_duplicates(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


EDGES = f"{CELLS}, al AS (SELECT user_id, k, max(len) AS len FROM agg WHERE bad = 0 AND anchors > 0 GROUP BY 1, 2), ch AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS run FROM al), comp AS (SELECT user_id, k, user_id * 1000000000 + min(k) OVER (PARTITION BY user_id, run) AS component FROM ch), nodes AS (SELECT user_id * 1000000000 + k AS node, component FROM comp UNION SELECT user_id * 1000000000 + k + 1, component FROM comp)"


@query(f"WITH {EDGES} SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM nodes")
def overlap_components(spark, d):
    return components.connected_components(A.edges(overlap.align(A.cells(spark, d), "browser")))


@query(f"WITH {EDGES}, n AS (SELECT node, component, node * 7919 % 100 AS conf, node % 11 = 0 AS manual FROM nodes) SELECT CAST(component AS BIGINT) AS component, CAST(arg_max(node, conf * 1000000000000000 - node) AS BIGINT) AS by_confidence, CAST(min(node) AS BIGINT) AS by_position, CAST(arg_max(node, CAST(manual AS BIGINT) * 1000000000000000000 + conf * 1000000000000000 + node) AS BIGINT) AS by_manual, count(CASE WHEN manual THEN 1 END) > 1 AS vetoed FROM n GROUP BY 1")
def component_survivors(spark, d):
    c = components.connected_components(A.edges(overlap.align(A.cells(spark, d), "browser")))
    return components.survivors(c.withColumn("conf", F.col("node") * 7919 % 100).withColumn("manual", F.col("node") % 11 == 0))


@query("SELECT CAST(l_orderkey AS BIGINT) AS ref FROM lineitem WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def orphan_refs(spark, d):
    return load(spark, d, "lineitem").join(load(spark, d, "part").where("p_size > 25"), F.expr("l_partkey = p_partkey"), "left_anti").where("l_partkey is not null").select(F.col("l_orderkey").alias("ref"))


@query(f"WITH {ITEMS} SELECT instance_id, coalesce(target, level) AS level, target IS NULL AS manual FROM items LEFT JOIN targets USING (instance_id)")
def union_rebuild(spark, d):
    return reconcile.rebuild(A.items(spark, d), A.targets(spark, d))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'task' WHEN o_custkey % 7 = 0 THEN 'account' WHEN o_orderkey % 5 = 0 THEN 'revision' ELSE 'current' END AS gate FROM orders")
def stale_gate(spark, d):
    o = load(spark, d, "orders")
    return reconcile.stale_gate(o, F.col("o_orderstatus") == "P", F.col("o_custkey") % 7 == 0, F.col("o_orderkey") % 5 == 0).select("o_orderkey", "gate")


@query("SELECT user_id, CASE WHEN count(CASE WHEN event_id % 97 = 0 THEN 1 END) > 0 THEN 'cancelled' WHEN count(CASE WHEN event_id % 3 = 0 THEN 1 END) = count(*) THEN 'failed' WHEN count(CASE WHEN event_id % 3 = 0 THEN 1 END) > 0 THEN 'partial' ELSE 'completed' END AS status FROM events GROUP BY 1")
def batch_status(spark, d):
    e = load(spark, d, "events")
    return reconcile.batch_status(e, "user_id", F.col("event_id") % 97 == 0, F.col("event_id") % 3 == 0)


@query("SELECT user_id, count(*) AS detected, count(CASE WHEN event_id % 5 = 0 THEN 1 END) AS excluded, count(CASE WHEN event_id % 7 = 0 THEN 1 END) AS duplicate, count(CASE WHEN event_id % 37 = 0 THEN 1 END) AS pending, CAST(max(CASE WHEN event_id % 37 = 0 THEN 0 ELSE 1 END) AS INT) AS any_resolved FROM events GROUP BY 1")
def review_counts(spark, d):
    e = load(spark, d, "events")
    return reconcile.review_counts(e, "user_id", F.col("event_id") % 5 == 0, F.col("event_id") % 7 == 0, F.col("event_id") % 37 == 0)


@query("SELECT lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS matched FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def audit_buckets(spark, d):
    x = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return x.groupBy("lang", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long").alias("bucket")).agg(F.count("*").alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("matched"))


_L = "'lv ' || CAST(l_linenumber AS VARCHAR) || 'O级'"


@query(f"SELECT l_linenumber, CAST(l_linenumber * 10 AS INT) AS level, count(*) AS n FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1, 2 UNION ALL SELECT l_linenumber, NULL, count(*) FROM lineitem WHERE l_linenumber > 6 GROUP BY 1")
def parse_levels(spark, d):
    li = load(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    return li.select("l_linenumber", parse.level(F.concat(F.lit("lv "), F.col("l_linenumber").cast("string"), F.lit("O级"))).alias("level"), "n")


# the other queries register themselves
from tallyforge.plans import cards, commands, edits, entities, extras, grids, looks, pictures, scalars, sessions, transfer  # noqa: E402, F401
