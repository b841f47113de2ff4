"""Queries over edit logs, rule sets of many owners, ordered terms and variant audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import edits, review, rules
from tallyforge.plans.registry import query
from tallyforge.sources.tables import load

#: A user is a session, an event a command on one of 30 rows; rows 0 to 9 are there from the start, the even ones with evidence. Catalog: event types, of which "error" is unknown.
LOG = """cat AS (SELECT DISTINCT event_type AS name, CASE WHEN event_type IN ('click', 'view') THEN 'main' ELSE 'support' END AS kind FROM events WHERE event_type <> 'error'),
 log AS (SELECT user_id AS session, event_id + 1 AS seq, CASE WHEN event_id % 211 = 7 THEN 'clear' WHEN event_id % 10 < 3 THEN 'add' WHEN event_id % 10 < 5 THEN 'delete' ELSE 'update' END AS op, (event_id // 7) % 30 AS r,
  CASE WHEN event_id % 13 = 0 THEN 'none' WHEN event_type IN ('click', 'view') THEN 'main' ELSE 'support' END AS kind, event_type AS name, CAST(floor(value) AS INT) % 60 + 1 AS level, CAST(event_id % 5 AS INT) AS quality FROM events),
 ini AS (SELECT s.session, CAST(x.r AS BIGINT) AS r, CASE WHEN x.r % 2 = 0 THEN s.session * 100 + x.r END AS occ, 'main' AS kind, 'first' AS name, 1 AS level, 0 AS quality FROM (SELECT DISTINCT session FROM log) s, (SELECT unnest(range(10)) AS r) x),
 c AS (SELECT log.*, cat.kind AS ck, CASE WHEN op IN ('add', 'update') AND cat.kind IS NULL THEN 'unknown_name' WHEN op IN ('add', 'update') AND log.kind <> cat.kind THEN 'kind_mismatch' END AS fault FROM log LEFT JOIN cat USING (name)),
 e AS (SELECT c.*, occ, greatest(CASE WHEN i.r IS NOT NULL THEN 0 END, (SELECT max(p.seq) FROM c p WHERE p.session = c.session AND p.r = c.r AND p.op = 'add' AND p.fault IS NULL AND p.seq < c.seq)) AS made,
  greatest(coalesce((SELECT max(p.seq) FROM c p WHERE p.session = c.session AND p.r = c.r AND p.op = 'delete' AND p.seq < c.seq), -1), coalesce((SELECT max(p.seq) FROM c p WHERE p.session = c.session AND p.op = 'clear' AND p.seq < c.seq), -1)) AS gone FROM c LEFT JOIN ini i ON i.session = c.session AND i.r = c.r),
 o AS (SELECT e.*, CASE WHEN fault IS NOT NULL THEN fault WHEN op = 'add' AND coalesce(made > gone, FALSE) THEN 'exists' WHEN op IN ('update', 'delete') AND NOT coalesce(made > gone, FALSE) THEN 'not_found' ELSE 'accepted' END AS outcome FROM e)"""


def _edits(spark, d):
    v, t = F.col("event_id"), F.col("event_type")
    e = load(spark, d, "events")
    kind = F.when(t.isin("click", "view"), "main").otherwise("support")
    op = F.when(v % 211 == 7, "clear").when(v % 10 < 3, "add").when(v % 10 < 5, "delete").otherwise("update")
    log = e.select(F.col("user_id").alias("session"), (v + 1).alias("seq"), op.alias("op"), (F.floor(v / 7) % 30).alias("row"), F.when(v % 13 == 0, "none").otherwise(kind).alias("kind"), t.alias("name"), (F.floor("value").cast("int") % 60 + 1).alias("level"), (v % 5).cast("int").alias("quality"))
    catalog = e.where("event_type <> 'error'").select(t.alias("name"), kind.alias("kind")).distinct()
    r = F.col("row")
    first = log.select("session").distinct().select("session", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("row"))
    first = first.select("session", "row", F.when(r % 2 == 0, F.col("session") * 100 + r).alias("occurrence"), F.lit("main").alias("kind"), F.lit("first").alias("name"), F.lit(1).alias("level"), F.lit(0).alias("quality"))
    return edits.row_edits(first, log, catalog)


@query(f"WITH {LOG} SELECT session, seq, op, r AS row, outcome, CASE WHEN occ IS NOT NULL THEN 'evidence' WHEN op <> 'clear' THEN 'row' END AS target FROM o")
def row_edits(spark, d):
    return _edits(spark, d).where("not initial").select("session", "seq", "op", "row", "outcome", "target")


@query(f"""WITH {LOG}, ok AS (SELECT session, seq, op, r, kind, name, level, quality FROM o WHERE outcome = 'accepted' UNION ALL SELECT session, 0, 'add', r, kind, name, level, quality FROM ini),
 x AS (SELECT * FROM ok a WHERE op IN ('add', 'update') AND NOT EXISTS (SELECT 1 FROM ok b WHERE b.session = a.session AND b.seq > a.seq AND (b.op = 'clear' OR (b.op = 'delete' AND b.r = a.r))))
 SELECT session, r AS row, kind, name, level, quality, seq FROM x QUALIFY row_number() OVER (PARTITION BY session, r ORDER BY seq DESC) = 1""")
def edited_rows(spark, d):
    return edits.edited_rows(_edits(spark, d))


@query(f"""WITH {LOG}, ok AS (SELECT * FROM o WHERE outcome = 'accepted' AND occ IS NOT NULL AND op IN ('update', 'delete')), u AS (SELECT * FROM ok WHERE op = 'update' QUALIFY row_number() OVER (PARTITION BY session, occ ORDER BY seq DESC) = 1)
 SELECT l.session, l.occ AS occurrence, u.kind, u.name, u.level, u.quality, u.seq IS NOT NULL AS manual, CASE WHEN l.op = 'delete' THEN 'exclude_false_box' ELSE 'keep' END AS action
 FROM (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY session, occ ORDER BY seq DESC) = 1) l LEFT JOIN u ON u.session = l.session AND u.occ = l.occ""")
def edited_evidence(spark, d):
    return edits.edited_evidence(_edits(spark, d))


PAIRS = """im AS (SELECT s AS session, i AS image, CASE WHEN i % 3 = 0 THEN 'support' ELSE 'main' END AS pool, (s + i) % 7 <> 0 AS confirmed FROM (SELECT DISTINCT user_id AS s FROM events), (SELECT unnest(range(11)) AS i)),
 log AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'remove' ELSE 'add' END AS op, CASE WHEN event_id % 4 = 0 THEN 'support' ELSE 'main' END AS pool, event_id % 12 AS "before", (event_id // 12) % 12 AS "after" FROM events),
 f AS (SELECT log.*, CASE WHEN op = 'remove' THEN NULL WHEN "before" = "after" THEN 'invalid' WHEN NOT coalesce(a.confirmed AND b.confirmed, FALSE) THEN 'unconfirmed' WHEN a.pool <> log.pool OR b.pool <> log.pool THEN 'other_pool' END AS fault
  FROM log LEFT JOIN im a ON a.session = log.session AND a.image = log."before" LEFT JOIN im b ON b.session = log.session AND b.image = log."after"),
 o AS (SELECT f.*, CASE WHEN fault IS NOT NULL THEN fault WHEN op = 'add' AND (SELECT max(p.seq) FROM f p WHERE p.session = f.session AND p.pool = f.pool AND p."before" = f."before" AND p."after" = f."after" AND p.op = 'add' AND p.fault IS NULL AND p.seq < f.seq)
  > coalesce((SELECT max(p.seq) FROM f p WHERE p.session = f.session AND p.pool = f.pool AND p."before" = f."before" AND p."after" = f."after" AND p.op = 'remove' AND p.seq < f.seq), -1) THEN 'exists' ELSE 'accepted' END AS outcome FROM f)"""


def _pairs(spark, d):
    e, v = load(spark, d, "events"), F.col("event_id")
    log = e.select(F.col("user_id").alias("session"), v.alias("seq"), F.when(v % 5 == 0, "remove").otherwise("add").alias("op"), F.when(v % 4 == 0, "support").otherwise("main").alias("pool"), (v % 12).alias("before"), (F.floor(v / 12) % 12).alias("after"))
    i = F.col("image")
    images = log.select("session").distinct().select("session", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("image"))
    images = images.select("session", "image", F.when(i % 3 == 0, "support").otherwise("main").alias("pool"), ((F.col("session") + i) % 7 != 0).alias("confirmed"))
    return edits.pair_edits(log, images)


@query(f'WITH {PAIRS} SELECT session, seq, op, pool, "before", "after", outcome FROM o')
def pair_edits(spark, d):
    return _pairs(spark, d)


@query(f"""WITH {PAIRS} SELECT session, pool, "before", "after" FROM (SELECT *, row_number() OVER (PARTITION BY session, pool, "before", "after" ORDER BY seq DESC) AS k FROM o WHERE outcome = 'accepted') WHERE k = 1 AND op = 'add'""")
def pairs_after_edits(spark, d):
    return edits.pairs_after(_pairs(spark, d))


#: A rule set per brand: intervals between the sizes of its parts; some are cut short, overlap or cost less than nothing.
RULES = """s AS (SELECT DISTINCT p_brand AS owner, CAST(p_size AS INT) AS start_level FROM part UNION SELECT DISTINCT p_brand, 1 FROM part),
 r AS (SELECT owner, start_level, CAST(coalesce(lead(start_level) OVER (PARTITION BY owner ORDER BY start_level) - 1, 60) + CASE WHEN ends_with(owner, '3') AND start_level % 7 = 0 THEN 1 WHEN ends_with(owner, '4') AND start_level % 11 = 0 THEN -2 ELSE 0 END AS INT) AS end_level, CAST(start_level * 100 AS INT) AS first_exp,
  CAST(CASE WHEN ends_with(owner, '5') AND start_level = 1 THEN -200 ELSE start_level END AS INT) AS step FROM s),
 x AS (SELECT owner, level, min(first_exp + step * (level - start_level)) AS exp, count(*) AS rules FROM (SELECT *, unnest(range(greatest(start_level, 1), least(end_level, 60) + 1)) AS level FROM r WHERE start_level <= end_level) GROUP BY 1, 2),
 f AS (SELECT owner, start_level AS level, 'bad_interval' AS fault FROM r WHERE start_level > end_level UNION ALL SELECT owner, level, 'overlap' FROM x WHERE rules > 1 UNION ALL SELECT owner, level, 'negative_cost' FROM x WHERE exp < 0
  UNION ALL SELECT owner, level, 'gap' FROM (SELECT owner, unnest(range(1, 61)) AS level FROM (SELECT DISTINCT owner FROM r)) e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.owner = e.owner AND x.level = e.level))"""


def _rules(spark, d):
    p = load(spark, d, "part").select(F.col("p_brand").alias("owner"), F.col("p_size").cast("int").alias("start_level"))
    s, lv = p.unionByName(p.select("owner", F.lit(1).alias("start_level"))).distinct(), F.col("start_level")
    end = F.coalesce(F.lead("start_level").over(Window.partitionBy("owner").orderBy("start_level")) - 1, F.lit(60))
    odd = F.when(F.endswith("owner", F.lit("3")) & (lv % 7 == 0), 1).when(F.endswith("owner", F.lit("4")) & (lv % 11 == 0), -2).otherwise(0)
    return s.select("owner", "start_level", (end + odd).alias("end_level"), (lv * 100).alias("first_exp"), F.when(F.endswith("owner", F.lit("5")) & (lv == 1), -200).otherwise(lv).alias("step"))


@query(f"WITH {RULES} SELECT owner, CAST(level AS INT) AS level, fault FROM f")
def rule_faults(spark, d):
    return rules.faults(_rules(spark, d))


@query(f"WITH {RULES} SELECT owner, CAST(level AS INT) AS level, CAST(exp AS BIGINT) AS exp FROM x WHERE owner NOT IN (SELECT owner FROM f)")
def rule_levels(spark, d):
    return rules.checked(_rules(spark, d))


@query(f"""WITH {RULES}, g AS (SELECT owner, CAST(level AS INT) AS level, CAST(exp AS BIGINT) AS exp FROM x WHERE owner NOT IN (SELECT owner FROM f)), dt AS (SELECT owner, level + CASE WHEN level = 60 THEN 1 ELSE 0 END AS level, exp + CASE WHEN level % 9 = 0 THEN 5 ELSE 0 END AS exp FROM g WHERE level % 13 <> 0)
 SELECT * FROM (SELECT owner, level, g.exp, dt.exp AS detail, CASE WHEN dt.exp IS NULL THEN 'missing' WHEN g.exp IS NULL THEN 'extra' WHEN g.exp <> dt.exp THEN 'differs' END AS fault FROM g FULL JOIN dt USING (owner, level)) WHERE fault IS NOT NULL""")
def rule_cache_faults(spark, d):
    levels = rules.checked(_rules(spark, d))
    lv = F.col("level")
    detail = levels.where(lv % 13 != 0).select("owner", (lv + F.when(lv == 60, 1).otherwise(0)).alias("level"), (F.col("exp") + F.when(lv % 9 == 0, 5).otherwise(0)).alias("exp"))
    return rules.cache_faults(levels, detail)


@query("""SELECT conv_id, turn, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ' ') AS terms, CAST(len(list_filter(ws, lambda w, i: list_position(ws, w) = i)) AS INT) AS n
 FROM (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\t\\n\\r,;]+'), lambda w: w <> '') AS ws FROM conversations)""")
def ordered_terms(spark, d):
    """The terms of each turn's text, in the order in which they first come."""
    terms = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\t\\n\\r,;]+"), lambda w: w != ""))
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(terms, " ").alias("terms"), F.size(terms).alias("n"))


AUDIT = """v AS (SELECT l_orderkey AS roi, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_returnflag AS text, l_linestatus AS status, l_quantity FROM lineitem),
 fin AS (SELECT roi, max_by(text, l_quantity * 100 + n) AS final, count(*) AS variants, any_value(status ORDER BY n) AS st, max(l_quantity) > 40 AS sharp FROM v GROUP BY 1),
 a AS (SELECT f.*, (SELECT text FROM v WHERE v.roi = f.roi ORDER BY n LIMIT 1) AS one, (SELECT max_by(text, l_quantity * 100 + n) FROM (SELECT * FROM v WHERE v.roi = f.roi ORDER BY n LIMIT 2)) AS two FROM fin f)"""


@query(f"""WITH {AUDIT} SELECT st AS status, sharp, least(variants, 3) AS variants, count(*) AS rois, count(*) FILTER (one <> final) AS v1_mismatches, count(*) FILTER (two <> final) AS v12_mismatches FROM a GROUP BY ALL""")
def variant_audit(spark, d):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = load(spark, d, "lineitem").withColumn("n", n).select(F.col("l_orderkey").alias("roi"), "n", F.col("l_returnflag").alias("text"), (F.col("l_quantity") * 100 + F.col("n")).alias("weight"), F.col("l_linestatus").alias("status"), (F.col("l_quantity") > 40).alias("sharp"))
    return review.variant_audit(li, {"status": F.min_by("status", "n"), "sharp": F.bool_or("sharp"), "variants": F.least(F.count("*"), F.lit(3))})
