"""Scalar functions over whole tables, and plans, dimensions and commands; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import parse
from tallyforge.operators import carry, commands, inventory, planning
from tallyforge.plans import adapters as A
from tallyforge.plans.registry import query
from tallyforge.sources import catalog
from tallyforge.sources.tables import load

QUALITY = "CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 0 THEN 'orange' WHEN 1 THEN 'purple' ELSE 'white' END"


def _quality():
    q = F.substring("p_brand", 7, 9).cast("int") % 3
    return F.when(q == 0, "orange").when(q == 1, "purple").otherwise("white")


@query(f"SELECT p_partkey, CASE WHEN {QUALITY} = 'orange' THEN p_name ELSE p_name || '（' || {QUALITY} || '）' END AS shown, CAST(length(p_name) AS INT) + CASE WHEN {QUALITY} = 'orange' THEN 0 ELSE CAST(length({QUALITY}) AS INT) + 4 END AS width FROM part")
def display_names(spark, d):
    shown = parse.display_name(F.col("p_name"), _quality())
    return load(spark, d, "part").select("p_partkey", shown.alias("shown"), parse.display_width(shown).cast("int").alias("width"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(event_id % 100 AS INT) WHEN 2 THEN -CAST(event_id % 100 AS INT) WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CASE WHEN event_id % 2000 <= 1000 THEN CAST(event_id % 2000 AS INT) END END AS value FROM events""")
def strict_integers(spark, d):
    e = F.col("event_id")
    n = (e % 100).cast("string")
    text = F.when(e % 6 == 0, "").when(e % 6 == 1, F.concat(F.lit(" +"), n, F.lit(" "))).when(e % 6 == 2, F.concat(F.lit("-"), n)).when(e % 6 == 3, F.concat(n, F.lit(".0"))).when(e % 6 == 4, "true").otherwise((e % 2000).cast("string"))
    return load(spark, d, "events").select("event_id", parse.strict_int(text, -1000, 1000).alias("value"))


@query("SELECT event_id, event_id % 4 = 0 AND event_id % 70 BETWEEN 1 AND 60 AS strict, CASE WHEN event_id % 4 IN (0, 1) AND event_id % 70 BETWEEN 1 AND 60 THEN CAST(event_id % 70 AS INT) END AS level FROM events")
def level_texts(spark, d):
    e = F.col("event_id")
    n = (e % 70).cast("string")
    text = F.when(e % 4 == 0, F.concat(n, F.lit("级"))).when(e % 4 == 1, F.concat(F.lit("lv "), n)).when(e % 4 == 2, F.concat(F.lit("-"), n)).otherwise(F.concat(n, F.lit(" 7")))
    return load(spark, d, "events").select("event_id", parse.strict_level_text(text).alias("strict"), parse.level(text).alias("level"))


@query("SELECT event_id, regexp_replace(event_type, '[^\\pL\\pN]', '', 'g') || CAST(event_id AS VARCHAR) AS name FROM events")
def clean_names(spark, d):
    return load(spark, d, "events").select("event_id", parse.clean_name(F.concat(F.lit("《"), "event_type", F.lit("·"), F.col("event_id").cast("string"), F.lit(" 级》"))).alias("name"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND user_id <= event_id % 1000 AND user_id < 10000 THEN CAST(user_id AS INT) END AS current, CASE WHEN event_id % 3 = 0 AND user_id <= event_id % 1000 AND user_id < 10000 THEN CAST(event_id % 1000 AS INT) END AS capacity FROM events""")
def bag_fractions(spark, d):
    e = F.col("event_id")
    n, m = F.col("user_id").cast("string"), (e % 1000).cast("string")
    text = F.when(e % 3 == 0, F.concat(F.lit("bag "), n, F.lit(" ／ "), m)).when(e % 3 == 1, F.concat(F.lit("12345/"), F.lit("2000"), m)).otherwise(n)
    return load(spark, d, "events").withColumn("b", parse.bag_fraction(text)).select("event_id", F.col("b.current").alias("current"), F.col("b.capacity").alias("capacity"))


@query("SELECT user_id, CAST(event_id % 10000 AS INT) AS value, CAST(event_id % 61 AS INT) AS conf FROM events WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 61 DESC, event_id) = 1")
def count_texts(spark, d):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat(F.lit(" O"), (e % 10000).cast("string"))).when(e % 3 == 1, "1234567").otherwise("12a")
    x = load(spark, d, "events").withColumn("v", parse.count_text(parse.digits_text(text))).where("v is not null")
    best = x.groupBy("user_id").agg(F.max_by(F.struct(F.col("v").alias("value"), (e % 61).cast("int").alias("conf")), F.struct(e % 61, -e)).alias("t"))
    return best.select("user_id", "t.value", "t.conf")


@query("""WITH h AS (SELECT event_id, event_id % 180 AS h, (event_id % 50) / 50.0 AS s FROM events), c AS (SELECT event_id, s, unnest(['orange', 'purple', 'white']) AS n, unnest([0, 1, 2]) AS k, unnest([least(h, 180 - h), least(abs(h - 140), 180 - abs(h - 140)), abs(h - 90)]) AS dist FROM h),
 b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY dist, k) = 1) SELECT event_id, CASE WHEN dist <= 19 AND s >= 0.34 THEN n END AS quality FROM b""")
def hue_quality(spark, d):
    e = F.col("event_id")
    return load(spark, d, "events").select("event_id", parse.by_hue((e % 180).cast("int"), (e % 50) / 50.0, {"orange": 0, "purple": 140, "white": 90}).alias("quality"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 100 < 50 THEN '<50' WHEN o_custkey % 100 < 65 THEN '50-65' WHEN o_custkey % 100 < 80 THEN '65-80' WHEN o_custkey % 100 < 90 THEN '80-90' ELSE '>=90' END AS bucket, CASE WHEN 400 + o_orderkey % 800 >= 2 * (300 + o_custkey % 600) THEN 'wide' WHEN 2 * (400 + o_orderkey % 800) >= 3 * (300 + o_custkey % 600) THEN 'standard' WHEN 400 + o_orderkey % 800 >= 300 + o_custkey % 600 THEN 'tall_tablet' ELSE 'portrait' END AS layout FROM orders")
def buckets_and_layouts(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return load(spark, d, "orders").select("o_orderkey", parse.confidence_bucket(c % 100).alias("bucket"), parse.layout(400 + k % 800, 300 + c % 600).alias("layout"))


@query("""WITH s AS (SELECT p_partkey, contains(p_name, 'red')::INT + 2 * contains(p_name, 'small')::INT AS a, 2 * contains(p_name, 'green')::INT + contains(p_name, 'large')::INT AS b, contains(p_name, 'blue')::INT AS c FROM part)
 SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'support' WHEN a > b AND a > c THEN 'main' WHEN b > a AND b > c THEN 'support' WHEN c > a AND c > b THEN 'experience' ELSE 'unknown' END AS page FROM s""")
def page_routing(spark, d):
    n = F.col("p_name")
    has = lambda t: F.contains(n, F.lit(t)).cast("int")
    kind = parse.page_kind({"main": has("red") + 2 * has("small"), "support": 2 * has("green") + has("large"), "experience": has("blue")})
    confirmed = F.when(F.col("p_partkey") % 10 == 0, "support")
    return load(spark, d, "part").select("p_partkey", F.coalesce(confirmed, kind).alias("page"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Keep' WHEN 1 THEN 'Needs a look' WHEN 2 THEN 'Ready 7' ELSE 'Other' END AS label FROM events")
def code_labels(spark, d):
    e = F.col("event_id")
    code = F.when(e % 4 == 0, "keep").when(e % 4 == 1, "some_new_code").when(e % 4 == 2, "Ready 7").otherwise("ignored_item")
    return load(spark, d, "events").select("event_id", parse.label(code, {"keep": "Keep", "ignored_item": "Other"}, "Needs a look").alias("label"))


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderstatus || '_code', CASE WHEN o_custkey % 2 = 0 THEN 'even_code' ELSE 'F_code' END, 'F_code'])), '、') AS reasons FROM orders")
def reason_texts(spark, d):
    codes = F.array(F.concat("o_orderstatus", F.lit("_code")), F.when(F.col("o_custkey") % 2 == 0, "even_code").otherwise("F_code"), F.lit("F_code"))
    return load(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(F.array_distinct(codes)), "、").alias("reasons"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS BIGINT) WHEN o_orderkey % 4 = 1 THEN 0 END AS revision, CASE WHEN o_orderkey % 5 > 1 THEN o_totalprice END AS price FROM orders")
def revisions_and_numbers(spark, d):
    from tallyforge.operators.draft import base_revision

    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.col("o_custkey").cast("string")).when(k % 4 == 1, "0").when(k % 4 == 2, F.concat(F.lit("0"), F.col("o_custkey").cast("string"))).otherwise("-1")
    v = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 5 == 1, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    return load(spark, d, "orders").select("o_orderkey", base_revision(text).alias("revision"), parse.finite(v).alias("price"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'account' WHEN 1 THEN 'a_b ' || c_mktsegment WHEN 2 THEN substr(c_name || ' ' || repeat('x', 60), 1, 48) ELSE c_name END AS file FROM customer")
def file_names(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "     ").when(k % 4 == 1, F.concat(F.lit(" a/b   "), "c_mktsegment")).when(k % 4 == 2, F.concat("c_name", F.lit("  "), F.lit("x" * 60))).otherwise(F.col("c_name"))
    return load(spark, d, "customer").select("c_custkey", parse.file_name(text).alias("file"))


@query("""WITH x AS (SELECT p_partkey, unnest(range(0, p_size)) AS i FROM part), h AS (SELECT p_partkey, i, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || CAST('item-' || p_partkey || ':' || i AS BLOB)) AS h FROM x)
 SELECT p_partkey, CAST(i AS INT) AS copy, CASE WHEN i = 0 THEN 'item-' || p_partkey ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS id FROM h""")
def expand_instances(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.concat(F.lit("item-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").alias("quantity"))
    return inventory.instances(p)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'main' ELSE 'support' END AS kind, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE CAST(o_custkey % 60 AS INT) END AS level, CASE WHEN o_custkey % 5 = 0 THEN 'unknown' ELSE o_orderstatus END AS state FROM orders")
def legacy_defaults(spark, d):
    c = F.col("o_custkey")
    r = F.struct(F.when(c % 3 == 0, "main").alias("kind"), F.when(c % 2 != 0, (c % 60).cast("int")).alias("level"), F.when(c % 5 != 0, F.col("o_orderstatus")).alias("state"))
    x = load(spark, d, "orders").withColumn("r", parse.with_defaults(r, {"kind": F.lit("support"), "level": F.lit(1), "state": F.lit("unknown")}))
    return x.select("o_orderkey", "r.kind", "r.level", "r.state")


@query("SELECT o_orderkey, json_extract_string(j, '$.kind') AS kind, CAST(json_extract_string(j, '$.level') AS INT) AS level, NOT (json_extract_string(j, '$.kind') IN ('F', 'O') AND CAST(json_extract_string(j, '$.level') AS INT) BETWEEN 1 AND 60) AS rejected FROM (SELECT o_orderkey, json_object('kind', o_orderstatus, 'level', o_custkey % 70) AS j FROM orders)")
def json_round_trip(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 70).alias("level"))).alias("j"))
    x = o.withColumn("r", F.from_json("j", "kind string, level int")).select("o_orderkey", "r.kind", "r.level")
    return x.withColumn("rejected", ~F.coalesce(F.col("kind").isin("F", "O") & F.col("level").between(1, 60), F.lit(False)))


# dimensions
@query("SELECT p_partkey, coalesce(n_name, p_name) AS name FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 50")
def alias_names(spark, d):
    nation = load(spark, d, "nation")
    aliases = nation.select(F.concat(F.lit("alias "), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("name"))
    k = F.col("p_partkey")
    p = load(spark, d, "part").join(F.broadcast(nation.select("n_nationkey")), F.expr("n_nationkey = p_partkey % 50"), "left")
    text = F.when(F.col("n_nationkey").isNotNull(), F.concat(F.lit("alias "), (k % 50).cast("string"))).otherwise(F.concat(F.lit(" "), "p_name", F.lit("  ")))
    return catalog.canonical(p.select("p_partkey", text.alias("name")), aliases)


@query("SELECT p_partkey, CASE WHEN coalesce(idx, n) < 0 THEN NULL ELSE coalesce(idx, n) END AS idx FROM part LEFT JOIN (SELECT p_name AS nm, row_number() OVER (ORDER BY p_name) - 1 AS idx FROM (SELECT DISTINCT p_name FROM part WHERE p_name < 'm')) ON nm = p_name, (SELECT count(DISTINCT p_name) AS n FROM part WHERE p_name < 'm')")
def catalog_fallback(spark, d):
    p = load(spark, d, "part")
    return catalog.positions(p.select("p_partkey", F.col("p_name").alias("name")), p.where("p_name < 'm'").select(F.col("p_name").alias("name")).distinct()).select("p_partkey", "idx")


@query("SELECT n_regionkey AS alias_key, min(n_name) AS name, count(DISTINCT n_name) > 1 AS conflict FROM nation GROUP BY 1")
def alias_conflicts(spark, d):
    n = load(spark, d, "nation").select(F.col("n_regionkey").alias("alias"), F.col("n_name").alias("name"))
    return catalog.alias_conflicts(n).withColumnRenamed("alias", "alias_key")


@query("SELECT o_custkey AS owner, o_orderstatus AS key, arg_max(o_orderkey, strftime(o_orderdate, '%Y%m%d') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS value FROM orders GROUP BY 1, 2")
def last_key_wins(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("key"), F.col("o_orderkey").alias("value"), "o_orderdate")
    return catalog.last_wins(o, ["owner", "key"], ["o_orderdate", "value"]).select("owner", "key", "value")


@query("SELECT level, CAST(CASE WHEN level <= 30 THEN 100 * level ELSE 4000 END AS BIGINT) AS exp, level % 10 = 0 AS differs FROM (SELECT CAST(unnest(range(1, 61)) AS INT) AS level) WHERE level % 10 = 0")
def cost_mismatches(spark, d):
    costs = planning.level_cost(spark)
    detail = costs.select("level", (F.col("exp") + F.when(F.col("level") % 10 == 0, 1).otherwise(0)).alias("exp"))
    return planning.mismatches(costs, detail)


@query("""WITH t AS (SELECT l_partkey, min(l_orderkey) % 80 - 5 AS target FROM lineitem GROUP BY 1) SELECT p_partkey AS instance_id, CAST(greatest(p_size, target) AS INT) AS target FROM part JOIN t ON l_partkey = p_partkey WHERE target BETWEEN 1 AND 60""")
def plan_repair(spark, d):
    t = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("instance_id")).agg((F.min("l_orderkey") % 80 - 5).cast("int").alias("target"))
    return planning.repair(t, A.items(spark, d))


@query("""WITH x AS (SELECT o_custkey AS grp, sum(o_orderkey % 7 * 500) AS gap FROM orders GROUP BY 1) SELECT grp, CAST((gap + 1499 - (gap + 1499) % 1500) // 1500 AS BIGINT) AS runs, CAST(10 * ((gap + 1499 - (gap + 1499) % 1500) // 1500) AS BIGINT) AS stamina FROM x""")
def stage_runs(spark, d):
    g = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.sum(F.col("o_orderkey") % 7 * 500).alias("gap"))
    return planning.stage_runs(g, 1500, 10).select("grp", "runs", "stamina")


# commands: an event log, from which the rows are rebuilt
LOG = "log AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 3 = 0 THEN 'delete' WHEN l_linenumber = 1 THEN 'add' ELSE 'update' END AS op, l_linenumber AS level, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"


def _log(spark, d):
    n = F.col("l_linenumber")
    op = F.when((F.col("l_partkey") % 3 == 0) & (n == 7), "delete").when(n == 1, "add").otherwise("update")
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + n).alias("seq"), op.alias("op"), n.cast("int").alias("level"))


@query("""WITH log AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 3 = 0 AND l_linenumber = 7 THEN 'delete' WHEN l_linenumber = 1 THEN 'add' ELSE 'update' END AS op, l_linenumber AS level FROM lineitem),
 d AS (SELECT id, max(CASE WHEN op = 'delete' THEN seq END) AS gone, max(seq) AS last FROM log GROUP BY 1), v AS (SELECT id, arg_max(level, seq * 10 + level) AS level, max(seq) AS seq, count(*) AS edits FROM log LEFT JOIN d USING (id) WHERE op <> 'delete' AND seq > coalesce(gone, -1) GROUP BY 1)
 SELECT id, CAST(level AS INT) AS level, seq, edits FROM v""")
def event_sourced_rows(spark, d):
    return commands.rebuild(_log(spark, d), "id", "seq", ["level"])


@query("SELECT o_orderkey, CASE WHEN t > 60 OR t < lv THEN 'rejected' WHEN t = lv THEN 'removed' ELSE 'set' END AS outcome, CAST(CASE WHEN t > lv AND t <= 60 THEN t END AS INT) AS target FROM (SELECT o_orderkey, o_custkey % 60 + 1 AS lv, o_orderkey % 70 AS t FROM orders)")
def plan_level_commands(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 60 + 1).cast("int").alias("level"), (F.col("o_orderkey") % 70).cast("int").alias("target"))
    return commands.set_plan(o).select("o_orderkey", "outcome", "target")


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 3 = 0 THEN 'kind' END, CASE WHEN o_custkey % 2 = 0 THEN 'name' END, CASE WHEN o_custkey % 5 = 0 THEN 'level' END) AS changed, NOT (o_custkey % 3 = 0 AND o_custkey % 2 <> 0) AS legal FROM orders")
def changed_fields(spark, d):
    c = F.col("o_custkey")
    o = load(spark, d, "orders").select(
        "o_orderkey", F.lit("main").alias("kind"), F.lit("x").alias("name"), F.when(c % 5 != 0, 3).alias("level"), F.when(c % 3 == 0, "support").otherwise("main").alias("new_kind"), F.when(c % 2 == 0, "y").otherwise("x").alias("new_name"), F.lit(3).alias("new_level")
    )
    return commands.changed(o, ["kind", "name", "level"]).select("o_orderkey", F.array_join("changed", ",").alias("changed"), "legal")


@query("""WITH s AS (SELECT o_custkey AS draft, count(*) AS n, count(DISTINCT o_orderkey) AS m, count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS a, count(CASE WHEN o_orderkey % 50 <> 0 THEN 1 END) AS b FROM orders GROUP BY 1) SELECT draft, n = m AND n = a AND n = b AS retired FROM s""")
def draft_retirement(spark, d):
    o = load(spark, d, "orders")
    ids = lambda x: x.select(F.col("o_custkey").alias("draft"), F.col("o_orderkey").alias("image"))
    return commands.retired(ids(o), ids(o.where("o_orderstatus <> 'P'")), ids(o.where("o_orderkey % 50 <> 0")))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'main' WHEN o_orderstatus = 'F' THEN 'support' WHEN o_orderstatus = 'O' THEN 'experience' END AS pool, o_custkey % 4 <> 0 AND o_orderstatus <> 'P' AND o_orderkey % 2 = 0 AS drops_pairs FROM orders")
def pool_commands(spark, d):
    c, s = F.col("o_custkey"), F.col("o_orderstatus")
    o = load(spark, d, "orders").select(
        "o_orderkey", F.when(c % 4 == 0, "main").when(F.col("o_orderkey") % 2 != 0, F.when(s == "F", "support").when(s == "O", "experience")).alias("pool"), (c % 4 == 0).alias("confirmed"),
        F.when(s == "F", "support").when(s == "O", "experience").alias("suggested"),
    )
    return commands.suggest_pool(o).select("o_orderkey", "pool", "drops_pairs")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0) GROUP BY 1")
def image_removal(spark, d):
    gone = load(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return commands.cascade({"rows": load(spark, d, "lineitem")}, gone, "l_suppkey")["rows"].groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN r = 1 THEN c_name ELSE NULL END AS name, r > 1 AS rejected FROM (SELECT c_custkey, c_mktsegment || c_nationkey AS c_name, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer)")
def account_names(spark, d):
    x = load(spark, d, "customer").select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"))
    return commands.unique_names(x, "name", "c_custkey")


@query("SELECT o_custkey AS owner, CAST(coalesce(arg_max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), min(o_orderkey)) AS BIGINT) AS value, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) > 0 AS manual FROM orders GROUP BY 1")
def sticky_values(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("value"), (F.col("o_orderstatus") == "F").alias("manual"))
    return commands.sticky(o, "owner")
