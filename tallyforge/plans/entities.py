"""Queries over entities: drafts, alignments, similarity, loadouts, carry-over, geometry; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import parse
from tallyforge.operators import carry, components, consensus, draft, geometry, loadout, overlap, reconcile, review, similarity
from tallyforge.plans import adapters as A
from tallyforge.plans.cards import HEAD, OCC, _header
from tallyforge.plans.registry import query
from tallyforge.sources.tables import Scratch, load, written

CARDS = """base AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
 cards AS (SELECT user_id, k, CAST((rn - 12 * k) // 4 AS INT) AS r, CAST((rn - 12 * k) % 4 AS INT) AS c, event_id, 2 * event_id + CASE WHEN k = rn // 12 THEN 1 ELSE 0 END AS card, CASE WHEN event_id % 37 <> 0 THEN event_type END AS name,
  CASE WHEN event_id % 31 <> 0 THEN 1 + CAST(floor(value) AS INT) % 60 END AS level, CASE WHEN event_id % 29 <> 0 THEN CAST(event_id % 4 AS INT) END AS quality, event_id % 43 <> 0 OR k = rn // 12 AS complete, event_id % 41 = 0 AS review
  FROM (SELECT *, unnest(CASE WHEN rn >= 12 AND rn % 12 < 8 THEN [rn // 12 - 1, rn // 12] ELSE [rn // 12] END) AS k FROM base)),
 rel AS (SELECT user_id, min(k) AS k, event_id AS relation, min(card) AS lhs, max(card) AS rhs, CASE event_id % 7 WHEN 0 THEN 'possible_duplicate' WHEN 1 THEN 'ambiguous' ELSE 'duplicate' END AS status FROM cards GROUP BY user_id, event_id HAVING count(*) = 2),
 cand AS (SELECT *, name IS NULL OR level IS NULL OR quality IS NULL AS problem FROM cards WHERE complete)"""


@query("""SELECT o_orderkey, concat_ws(',', CASE o_orderstatus WHEN 'P' THEN 'partial_requires_retry' WHEN 'O' THEN 'cancelled_result' END, CASE WHEN o_orderkey % 11 = 0 THEN 'failed_result' END, CASE WHEN o_custkey % 3 = 0 THEN 'analysis_blocked' END, CASE WHEN o_orderkey % 5 = 0 THEN 'active_task_mismatch' END,
 CASE WHEN o_custkey % 7 = 0 THEN 'account_mismatch' END, CASE WHEN o_orderkey % 13 = 0 THEN 'invalid_base_revision' WHEN o_orderkey % 17 <> o_custkey % 17 THEN 'revision_mismatch' END) AS codes FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderstatus IN ('P', 'O'))""")
def eligibility_codes(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "P", "partial").when(F.col("o_orderstatus") == "O", "cancelled").when(k % 11 == 0, "failed").otherwise("completed")
    t = load(spark, d, "orders").where("not (o_orderkey % 11 = 0 and o_orderstatus in ('P', 'O'))").select(
        "o_orderkey", status.alias("status"), F.when(c % 3 == 0, "blocked").otherwise("ready").alias("review_status"), F.lit("t").alias("task_id"), F.when(k % 5 == 0, "u").otherwise("t").alias("active_task"), F.lit("a").alias("account_id"),
        F.when(c % 7 == 0, "b").otherwise("a").alias("active_account"), F.when(k % 13 == 0, F.concat(F.lit("0"), (k % 17).cast("string"), F.lit("x"))).otherwise((k % 17).cast("string")).alias("base"), (c % 17).alias("revision"),
    )
    return draft.eligibility(t).select("o_orderkey", F.array_join("codes", ",").alias("codes"))


@query(f"""WITH {CARDS}, e AS (SELECT rel.*, a.card IS NULL OR b.card IS NULL AS gone, a.r AS ra, b.r AS rb, a.k AS ka, b.k AS kb, a.name IS NOT DISTINCT FROM b.name AND a.level IS NOT DISTINCT FROM b.level AS agree FROM rel LEFT JOIN cand a ON a.card = lhs LEFT JOIN cand b ON b.card = rhs),
 p AS (SELECT user_id, count(*) AS pending_rows FROM (SELECT user_id FROM e WHERE status <> 'duplicate' AND NOT gone GROUP BY user_id, ka, ra, kb, rb HAVING count(*) = 4) GROUP BY 1),
 x AS (SELECT user_id, count(CASE WHEN NOT complete THEN 1 END) AS fragments, count(CASE WHEN complete THEN 1 END) AS candidates, count(CASE WHEN complete AND (name IS NULL OR level IS NULL OR quality IS NULL OR review) THEN 1 END) AS review_items FROM cards GROUP BY 1),
 y AS (SELECT user_id, count(CASE WHEN status = 'duplicate' THEN 1 END) AS duplicates, bool_or(status <> 'duplicate' AND gone) AS u, bool_or(status = 'duplicate' AND (gone OR NOT agree)) AS i FROM e GROUP BY 1)
 SELECT user_id, fragments, candidates, review_items, coalesce(duplicates, 0) AS duplicates, coalesce(pending_rows, 0) AS pending_rows, concat_ws(',', CASE WHEN u THEN 'overlap_relation_unavailable' END, CASE WHEN i THEN 'reconcile_duplicate_component_inconsistent' END) AS codes,
 CASE WHEN u OR i THEN 'blocked' WHEN review_items + coalesce(pending_rows, 0) > 0 THEN 'requires_review' ELSE 'ready_to_finalize' END AS status FROM x LEFT JOIN y USING (user_id) LEFT JOIN p USING (user_id)""")
def reconcile_draft(spark, d):
    c = A.cards(spark, d)
    return draft.draft(c, A.relations(c)).withColumn("codes", F.array_join("codes", ","))


@query(f"WITH {CARDS} SELECT card, CASE WHEN problem THEN 'defer' ELSE 'accept_suggested' END AS action FROM cand WHERE problem OR review")
def automatic_resolution(spark, d):
    return draft.automatic(A.cards(spark, d))


def _choices(c):
    v = F.col("card")
    a = F.when(v % 5 == 0, "edit").when(v % 5 == 1, "exclude").when(v % 5 == 2, "accept_suggested")
    x = c.where("(not complete) or review or name is null or level is null or quality is null").select("card", a.alias("action"), F.lit("edited").alias("name"), (v % 60 + 1).cast("int").alias("level"), F.when(v % 3 != 0, (v % 4).cast("int")).alias("quality"))
    return x.where("action is not null")


CHOICES = f"""{CARDS}, choice AS (SELECT card, CASE card % 5 WHEN 0 THEN 'edit' WHEN 1 THEN 'exclude' ELSE 'accept_suggested' END AS action, CAST(card % 60 + 1 AS INT) AS l, CASE WHEN card % 3 <> 0 THEN CAST(card % 4 AS INT) END AS q
  FROM cards WHERE card % 5 < 3 AND (NOT complete OR review OR name IS NULL OR level IS NULL OR quality IS NULL)),
 res AS (SELECT user_id, k, r, c, event_id, card, CASE WHEN action = 'edit' THEN 'edited' ELSE name END AS name, CASE WHEN action = 'edit' THEN l ELSE level END AS level, CASE WHEN action = 'edit' THEN q ELSE quality END AS quality, coalesce(action = 'edit', FALSE) AS manual, action
  FROM cards LEFT JOIN choice USING (card) WHERE action IS DISTINCT FROM 'exclude' AND (complete OR action IS NOT NULL)),
 kept AS (SELECT * FROM res WHERE action IS NULL OR (name IS NOT NULL AND level BETWEEN 1 AND 60 AND quality IS NOT NULL))"""


@query(f"WITH {CHOICES} SELECT card, name, level, quality, manual FROM kept")
def apply_resolutions(spark, d):
    c = A.cards(spark, d)
    return draft.resolved(c, _choices(c)).select("card", "name", "level", "quality", "manual")


@query(f"WITH {CHOICES} SELECT user_id, card FROM cand WHERE (problem OR review) AND card NOT IN (SELECT card FROM choice)")
def resolution_gaps(spark, d):
    c = A.cards(spark, d)
    return draft.unresolved(c, _choices(c))


def _regrouped(spark, d):
    """What is kept and its groups; cards and relations are read several times, so they are tables for so long."""
    with Scratch(spark, "cards") as tmp:
        c = tmp.written(A.cards(spark, d), "cards")
        rel = tmp.written(A.relations(c), "relations")
        rows = rel.select("user_id", "k").distinct().select("*", F.when(F.col("k") % 3 == 0, "keep_separate").when(F.col("k") % 3 == 1, "merge").alias("action"))
        kept = written(draft.resolved(c, _choices(c)), "kept")
        return kept, draft.regrouped(kept, rel, rows)


# every relation joins the two cards of one event, so a component is one card or the two of a relation that holds
GROUPS = f"""{CHOICES}, held AS (SELECT lhs, rhs FROM rel WHERE (status = 'duplicate' AND k % 3 <> 0 OR status <> 'duplicate' AND k % 3 = 1) AND lhs IN (SELECT card FROM kept) AND rhs IN (SELECT card FROM kept)),
 grp AS (SELECT card, coalesce(a.lhs, b.lhs, card) AS component FROM kept LEFT JOIN held a ON a.lhs = card LEFT JOIN held b ON b.rhs = card)"""


@query(f"WITH {GROUPS} SELECT card, component FROM grp")
def regroup_components(spark, d):
    return _regrouped(spark, d)[1]


@query(f"WITH {GROUPS}, o AS (SELECT card, first_value(card) OVER (PARTITION BY component ORDER BY k, r, c, card) AS p FROM kept JOIN grp USING (card)) SELECT card, p AS \"primary\" FROM o WHERE card <> p")
def merged_occurrences(spark, d):
    return draft.merged_ids(*_regrouped(spark, d))


SETTLED = f"""{GROUPS}, m AS (SELECT kept.*, component, card * 31 % 100 AS conf FROM kept JOIN grp USING (card)),
 s AS (SELECT component, arg_min(card, k * 1000000000000 + r * 100000000000 + c * 10000000000 + card) AS "primary", count(*) AS members, count(DISTINCT name) AS names, min(name) AS nm, count(DISTINCT CASE WHEN level BETWEEN 1 AND 60 THEN level END) AS levels, min(CASE WHEN level BETWEEN 1 AND 60 THEN level END) AS lv,
  count(DISTINCT CASE WHEN manual THEN quality END) AS hands, min(CASE WHEN manual THEN quality END) AS hand FROM m GROUP BY 1),
 q AS (SELECT component, quality AS sure FROM m QUALIFY row_number() OVER (PARTITION BY component ORDER BY conf DESC, k, r, c, card) = 1),
 z AS (SELECT *, CASE WHEN hands = 1 THEN hand WHEN hands = 0 THEN sure END AS ql FROM s JOIN q USING (component)), ok AS (SELECT *, names = 1 AND levels = 1 AND ql IS NOT NULL AS ok FROM z)"""


def _settled(spark, d):
    kept, groups = _regrouped(spark, d)
    return kept.withColumn("conf", F.col("card") * 31 % 100), groups


@query(f"WITH {SETTLED} SELECT component, \"primary\", members, ok, hands > 1 AS quality_conflict, CASE WHEN ok THEN nm END AS name, CASE WHEN ok THEN lv END AS level, CASE WHEN ok THEN ql END AS quality FROM ok")
def component_resolution(spark, d):
    return draft.settled(*_settled(spark, d))


@query(f"WITH {SETTLED} SELECT \"primary\" AS instance, nm AS name, lv AS level, ql AS quality FROM ok WHERE ok")
def preview_inventory(spark, d):
    return draft.preview(*_settled(spark, d))


@query(f"WITH {HEAD}, v AS (SELECT grp, CASE WHEN current_status IN ('confirmed', 'candidate') AND current >= 0 THEN current END AS a, CASE WHEN capacity_status IN ('confirmed', 'candidate') AND capacity >= 0 THEN capacity END AS b FROM h) SELECT grp, CASE WHEN a > b THEN NULL ELSE a END AS current, CASE WHEN a > b THEN NULL ELSE b END AS capacity, CASE WHEN a > b THEN 'bag_count_exceeds_capacity' END AS code FROM v")
def bag_draft(spark, d):
    return draft.bag_draft(_header(spark, d))


@query("""WITH o AS (SELECT user_id AS grp, CASE WHEN event_id % 3 = 0 THEN user_id % 9 END AS a, event_id % 2 - 1 AS b, CASE WHEN event_id % 50 = 0 THEN event_id % 4 END AS c FROM events)
 SELECT grp, CASE WHEN count(DISTINCT a) = 1 THEN CAST(min(a) AS INT) END AS orange, CASE WHEN count(DISTINCT CASE WHEN b >= 0 THEN b END) = 1 THEN CAST(min(CASE WHEN b >= 0 THEN b END) AS INT) END AS purple, CASE WHEN count(DISTINCT c) = 1 THEN CAST(min(c) AS INT) END AS white,
 concat_ws(',', CASE WHEN count(DISTINCT a) > 1 THEN 'experience_orange_conflict' END, CASE WHEN count(DISTINCT CASE WHEN b >= 0 THEN b END) > 1 THEN 'experience_purple_conflict' END, CASE WHEN count(DISTINCT c) > 1 THEN 'experience_white_conflict' END) AS codes FROM o GROUP BY 1""")
def experience_draft(spark, d):
    e = F.col("event_id")
    o = load(spark, d, "events").select(F.col("user_id").alias("grp"), F.when(e % 3 == 0, F.col("user_id") % 9).cast("int").alias("orange"), (e % 2 - 1).cast("int").alias("purple"), F.when(e % 50 == 0, e % 4).cast("int").alias("white"))
    return draft.experience_draft(o, ["orange", "purple", "white"]).withColumn("codes", F.array_join("codes", ","))


# alignment by the targeted rule: identified rows, no gap, vetoes of name, level and quality
TARGETED = f"""{CARDS}, fr AS (SELECT user_id, k, r FROM cards GROUP BY ALL HAVING count(DISTINCT c) = 4 AND count(name) >= 2), n AS (SELECT *, r - row_number() OVER (PARTITION BY user_id, k ORDER BY r) AS g, min(r) OVER (PARTITION BY user_id, k) AS lo, max(r) OVER (PARTITION BY user_id, k) AS hi FROM fr),
 ends AS (SELECT *, first_value(g) OVER (PARTITION BY user_id, k ORDER BY r) AS g0, first_value(g) OVER (PARTITION BY user_id, k ORDER BY r DESC) AS g1 FROM n),
 suf AS (SELECT user_id, k, r, row_number() OVER (PARTITION BY user_id, k ORDER BY r DESC) AS back FROM ends WHERE g = g1), pre AS (SELECT user_id, k, r, row_number() OVER (PARTITION BY user_id, k ORDER BY r) AS fore FROM ends WHERE g = g0),
 tries AS (SELECT s.user_id, s.k, len, s.r AS ra, p.r AS rb FROM suf s JOIN pre p ON p.user_id = s.user_id AND p.k = s.k + 1 JOIN (SELECT DISTINCT back AS len FROM suf) ON back <= len AND fore = len - back + 1),
 most AS (SELECT user_id, k, max(back) AS a FROM suf GROUP BY ALL), mostp AS (SELECT user_id, k - 1 AS k, max(fore) AS b FROM pre GROUP BY ALL),
 v AS (SELECT t.user_id, t.k, len, ra, rb, count(CASE WHEN a.name <> b.name OR a.level <> b.level OR a.quality <> b.quality THEN 1 END) AS bad, count(CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN 1 END) AS nn, count(CASE WHEN a.level IS NOT NULL AND b.level IS NOT NULL THEN 1 END) AS nl
  FROM tries t JOIN most USING (user_id, k) JOIN mostp USING (user_id, k) JOIN cards a ON a.user_id = t.user_id AND a.k = t.k AND a.r = ra JOIN cards b ON b.user_id = t.user_id AND b.k = t.k + 1 AND b.r = rb AND b.c = a.c WHERE len <= least(most.a, mostp.b) GROUP BY ALL),
 good AS (SELECT user_id, k, len, count(CASE WHEN nn = 4 AND nl = 4 THEN 1 END) AS confirmed FROM v GROUP BY ALL HAVING count(CASE WHEN bad > 0 OR NOT (nn >= 2 AND nn + nl >= 2) THEN 1 END) = 0 AND count(CASE WHEN nn = 4 AND nl = 4 THEN 1 END) > 0)"""


@query(f"WITH {TARGETED} SELECT user_id, k, len, confirmed FROM good QUALIFY len = max(len) OVER (PARTITION BY user_id, k)")
def align_targeted(spark, d):
    return overlap.align_targeted(A.cards(spark, d))


# the icon of a later card is turned over for some events, so what is seen vetoes their rows
ICON = "event_id * 2654435761"
SEEN = (
    TARGETED.replace("cards AS (SELECT user_id, k,", f"cards AS (SELECT CASE WHEN event_id % 47 = 0 AND k = rn // 12 THEN -1 - {ICON} ELSE {ICON} END AS icon, user_id, k,")
    .replace("count(CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN 1 END) AS nn,", "count(CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN 1 END) AS nn, count(CASE WHEN bit_count(xor(a.icon, b.icon)) >= 32 THEN 1 END) AS apart,")
    .replace("bad > 0 OR NOT (nn >= 2 AND nn + nl >= 2)", "bad > 0 OR apart > 0 OR NOT (nn >= 2 AND nn + nl >= 2)")
)


@query(f"WITH {SEEN} SELECT user_id, k, len, confirmed FROM good QUALIFY len = max(len) OVER (PARTITION BY user_id, k)")
def align_targeted_visual(spark, d):
    icon = F.col("event_id") * 2654435761
    later = F.col("card") % 2 == 1
    return overlap.align_targeted(A.cards(spark, d).withColumn("icon", F.when((F.col("event_id") % 47 == 0) & later, -1 - icon).otherwise(icon)))


PAIRS = f"""{OCC}, pool AS (SELECT image, any_value(pool) AS pool FROM occ GROUP BY 1), pr AS (SELECT o_orderkey AS pair, o_custkey % 40 + 1 AS before, o_orderkey % 40 + 1 AS after FROM orders)"""


@query(f"WITH {PAIRS}, v AS (SELECT pair, before, after, a.pool FROM pr JOIN pool a ON a.image = before JOIN pool b ON b.image = after WHERE a.pool = b.pool AND a.pool IN ('main', 'support') AND before <> after) SELECT * FROM v QUALIFY pair = min(pair) OVER (PARTITION BY least(before, after), greatest(before, after))")
def directed_pairs(spark, d):
    pairs = load(spark, d, "orders").select(F.col("o_orderkey").alias("pair"), (F.col("o_custkey") % 40 + 1).alias("before"), (F.col("o_orderkey") % 40 + 1).alias("after"))
    pools = A.occurrences(spark, d).groupBy("image").agg(F.first("pool").alias("pool"))
    return overlap.directed_pairs(pairs, pools)


@query("SELECT CASE WHEN o_orderkey % 5 < 2 THEN o_custkey ELSE o_orderkey END AS before, CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey ELSE o_custkey END AS after FROM orders WHERE o_orderkey % 5 <> 2")
def edge_directions(spark, d):
    k = F.col("o_orderkey")
    return overlap.edge_direction(load(spark, d, "orders").select(F.col("o_custkey").alias("a"), k.alias("b"), (k % 5 - 2).alias("offset")))


EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"WITH {EMB} SELECT a.vec_id AS a, b.vec_id AS b, round(CAST(greatest(0, least(1, (list_cosine_similarity(a.v, b.v) + 1) / 2)) AS DOUBLE), 4) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 WHERE round((list_cosine_similarity(a.v, b.v) + 1) / 2, 4) >= 0.62")
def similarity_topk(spark, d):
    e = load(spark, d, "embeddings").select(F.col("label").alias("bucket"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    s = similarity.similar(e.where("id % 2 = 0"), e.where("id % 2 = 1"), 0.6199)
    return s.select("a", "b", F.round("score", 4).alias("score")).where("score >= 0.62")


@query("SELECT l_orderkey, l_partkey, l_suppkey, round(0.46 * (1 - bit_count(xor(l_partkey, l_suppkey)) / 64) + 0.34 * (1 - bit_count(xor(l_orderkey, l_partkey)) / 64) + 0.15 * (1 - bit_count(xor(l_orderkey, l_suppkey)) / 64) + 0.05 * (0.25 + 0.5), 8) AS score FROM lineitem")
def card_similarity(spark, d):
    p, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    hist = lambda *v: F.array(*[F.lit(x) for x in v])
    x = F.struct(p.alias("icon"), o.alias("name"), o.alias("level"), hist(0.25, 0.75).alias("hist"))
    y = F.struct(s.alias("icon"), p.alias("name"), s.alias("level"), hist(0.5, 0.5).alias("hist"))
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", x.alias("x"), y.alias("y"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", F.round(similarity.card_similarity("x", "y"), 8).alias("score"))


# an order's lines and days as the two sides; scores are distinct within an order but for ties that the ids settle
MATCH = "SELECT DISTINCT l_orderkey % 500 AS key, l_linenumber AS a, CAST(l_partkey % 4 AS INT) AS b, (l_partkey * 7 + l_linenumber) % 101 AS score FROM lineitem"


@query(f"""WITH RECURSIVE m AS (SELECT key, a, b, max(score) AS score FROM ({MATCH}) GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, a, b) AS n FROM m),
 g AS (SELECT key, 0 AS n, CAST([] AS INT[]) AS sa, CAST([] AS INT[]) AS sb FROM (SELECT DISTINCT key FROM o)
  UNION ALL SELECT g.key, o.n, CASE WHEN list_contains(sa, o.a) OR list_contains(sb, o.b) THEN sa ELSE list_append(sa, o.a) END, CASE WHEN list_contains(sa, o.a) OR list_contains(sb, o.b) THEN sb ELSE list_append(sb, o.b) END FROM g JOIN o ON o.key = g.key AND o.n = g.n + 1),
 f AS (SELECT key, sa, sb FROM g QUALIFY n = max(n) OVER (PARTITION BY key)), u AS (SELECT key, unnest(sa) AS a, unnest(sb) AS b FROM f) SELECT key, a, b, score FROM u JOIN m USING (key, a, b)""")
def greedy_matches(spark, d):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    x = load(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("key"), n.alias("a"), (p % 4).cast("int").alias("b"), ((p * 7 + n) % 101).alias("score"))
    return similarity.greedy_match(x.groupBy("key", "a", "b").agg(F.max("score").alias("score")), "key")


@query("""WITH m AS (SELECT l_orderkey AS pair, CAST(l_linenumber AS INT) AS "row", CAST(l_partkey % 4 AS INT) AS col, CAST(l_suppkey % 40 AS INT) AS "offset" FROM lineitem), d AS (SELECT pair, median("offset") AS md FROM m GROUP BY 1), n AS (SELECT m.*, md FROM m JOIN d USING (pair) WHERE abs("offset" - md) <= 14),
 r AS (SELECT pair, "row", count(*) AS n, count(DISTINCT col) AS cols, max(col) - min(col) AS span FROM n GROUP BY 1, 2), g AS (SELECT pair, CAST(sum(n) AS BIGINT) AS cards, (count(*) >= 2 AND sum(n) >= 6) OR bool_or(cols >= 3 AND span >= 2) AS ok FROM r GROUP BY 1)
 SELECT pair, md AS median, coalesce(cards, 0) AS cards, coalesce(ok, FALSE) AS confirmed FROM d LEFT JOIN g USING (pair)""")
def image_pair_match(spark, d):
    m = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").cast("int").alias("row"), (F.col("l_partkey") % 4).cast("int").alias("col"), (F.col("l_suppkey") % 40).cast("int").alias("offset"))
    return similarity.pair_verdict(m, "pair")


SLOTTED = """inv AS (SELECT p_partkey AS instance, CASE WHEN p_partkey % 3 = 0 THEN 'support' ELSE 'main' END AS kind, p_name AS name, CAST(p_size AS INT) AS level, CAST(substr(p_brand, 7) AS INT) % 5 AS quality FROM part WHERE p_size > 5),
 lo AS (SELECT s_suppkey AS operator, s_suppkey * 3 + 1 AS main1, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 3 + 4 END AS main2, s_suppkey * 5 AS main3, s_suppkey * 3 AS support1, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 6 + 3 END AS support2, CAST(NULL AS BIGINT) AS support3 FROM supplier),
 held AS (SELECT * FROM (UNPIVOT lo ON main1, main2, main3, support1, support2, support3 INTO NAME slot VALUE instance))"""


def _slotted(spark, d):
    k = F.col("p_partkey")
    inv = load(spark, d, "part").where("p_size > 5").select(k.alias("instance"), F.when(k % 3 == 0, "support").otherwise("main").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("level"), (F.substring("p_brand", 7, 9).cast("int") % 5).alias("quality"))
    s = F.col("s_suppkey")
    lo = load(spark, d, "supplier").select(
        s.alias("operator"), (s * 3 + 1).alias("main1"), F.when(s % 4 == 0, s * 3 + 4).alias("main2"), (s * 5).alias("main3"), (s * 3).alias("support1"), F.when(s % 2 == 0, s * 6 + 3).alias("support2"), F.lit(None).cast("long").alias("support3")
    )
    return inv, lo


@query(f"WITH {SLOTTED} SELECT operator, slot, instance FROM held")
def loadout_occupancy(spark, d):
    return loadout.occupancy(_slotted(spark, d)[1])


@query(f"WITH {SLOTTED}, x AS (SELECT held.*, kind, count(*) OVER (PARTITION BY held.instance) AS n FROM held LEFT JOIN inv USING (instance)) SELECT operator, slot, instance, CASE WHEN kind IS NULL THEN 'dangling' WHEN NOT starts_with(slot, kind) THEN 'wrong_kind' ELSE 'equipped_twice' END AS fault FROM x WHERE kind IS NULL OR NOT starts_with(slot, kind) OR n > 1")
def loadout_faults(spark, d):
    inv, lo = _slotted(spark, d)
    return loadout.faults(lo, inv)


_KEEP = ", ".join(f"CASE WHEN {s} IN (SELECT instance FROM inv) THEN {s} END AS {s}" for s in loadout.SLOTS)


@query(f"WITH {SLOTTED} SELECT operator, {_KEEP} FROM lo")
def loadout_repair(spark, d):
    inv, lo = _slotted(spark, d)
    return loadout.without_missing(lo, inv)


REQ = f"{SLOTTED}, req AS (SELECT operator, CAST(i AS INT) AS ordinal, kind, name FROM (SELECT l.operator, i, v.kind, v.name FROM lo l, (SELECT unnest(range(0, 5)) AS i) JOIN inv v ON v.instance = l.operator * 3 + CASE i WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 7 ELSE 10 END))"


@query(f"""WITH RECURSIVE {REQ}, worn AS (SELECT operator, instance, min(slot) AS slot, any_value(kind) AS kind, any_value(name) AS name FROM held JOIN inv USING (instance) GROUP BY 1, 2),
 own AS (SELECT r.operator, r.ordinal, w.instance, w.slot FROM (SELECT *, row_number() OVER (PARTITION BY operator, kind, name ORDER BY ordinal) AS n FROM req) r JOIN (SELECT *, row_number() OVER (PARTITION BY operator, kind, name ORDER BY slot) AS n FROM worn) w USING (operator, kind, name, n)),
 rq AS (SELECT r.*, own.instance AS own, row_number() OVER (PARTITION BY r.operator ORDER BY r.ordinal) AS k FROM req r LEFT JOIN own USING (operator, ordinal)),
 pool AS (SELECT kind, name, list(instance ORDER BY level DESC, quality DESC, instance) AS ids FROM inv WHERE instance NOT IN (SELECT instance FROM held) GROUP BY 1, 2),
 steps AS (SELECT rq.*, coalesce(pool.ids, []) AS ids FROM rq LEFT JOIN pool USING (kind, name)),
 st AS (SELECT l.operator, CAST(0 AS BIGINT) AS k, CAST(NULL AS INT) AS ordinal, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS name, CAST([] AS BIGINT[]) AS used, 3 - count(slot) FILTER (starts_with(slot, 'main')) AS m, 3 - count(slot) FILTER (starts_with(slot, 'support')) AS s, CAST(NULL AS BIGINT) AS instance, CAST(NULL AS BOOLEAN) AS full_ FROM lo l LEFT JOIN own USING (operator) GROUP BY l.operator
  UNION ALL SELECT operator, k, ordinal, kind, name, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, m - CASE WHEN pick IS NOT NULL AND kind = 'main' THEN 1 ELSE 0 END, s - CASE WHEN pick IS NOT NULL AND kind <> 'main' THEN 1 ELSE 0 END, coalesce(own, pick), own IS NULL AND room = 0
   FROM (SELECT *, CASE WHEN own IS NULL AND room > 0 THEN list_filter(ids, lambda i: NOT list_contains(used, i))[1] END AS pick FROM (SELECT p.operator, p.k, p.ordinal, p.kind, p.name, p.own, p.ids, st.used, st.m, st.s, CASE WHEN p.kind = 'main' THEN st.m ELSE st.s END AS room FROM st JOIN steps p ON p.operator = st.operator AND p.k = st.k + 1)))
 SELECT operator, ordinal, instance, CASE WHEN instance IS NOT NULL THEN NULL WHEN full_ THEN 'no_slot' WHEN EXISTS (SELECT 1 FROM held JOIN inv USING (instance) WHERE inv.kind = st.kind AND inv.name = st.name AND held.operator <> st.operator) THEN 'occupied' ELSE 'missing' END AS reason FROM st WHERE k > 0""")
def loadout_suggestion(spark, d):
    inv, lo = _slotted(spark, d)
    at = F.posexplode(F.array(F.lit(1), F.lit(1), F.lit(0), F.lit(7), F.lit(10))).alias("ordinal", "_d")
    req = lo.select("operator", at).select("operator", "ordinal", (F.col("operator") * 3 + F.col("_d")).alias("instance")).join(inv.select("instance", "kind", "name"), "instance")
    return loadout.suggest(req.select("operator", "ordinal", "kind", "name"), inv, lo)


# carry-over of ids and manual values when cards are read anew
OLD = "old AS (SELECT l_partkey AS occ, min(l_orderkey) AS instance, min(l_linenumber) % 2 = 0 AS manual, max(l_linenumber) AS level FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1)"


def _old(spark, d):
    n = F.col("l_linenumber")
    return load(spark, d, "lineitem").where("l_partkey % 3 <> 0").groupBy(F.col("l_partkey").alias("occ")).agg(F.min("l_orderkey").alias("instance"), (F.min(n) % 2 == 0).alias("manual"), F.max(n).cast("int").alias("level"))


@query(f"WITH {OLD} SELECT p_partkey AS occ, coalesce(CAST(instance AS VARCHAR), 'new-' || sha256('instance:' || CAST(p_partkey AS VARCHAR))) AS instance FROM part LEFT JOIN old ON occ = p_partkey")
def carry_ids(spark, d):
    return carry.ids(load(spark, d, "part").select(F.col("p_partkey").alias("occ")), _old(spark, d).select("occ", F.col("instance").cast("string").alias("instance")))


@query(f"WITH {OLD} SELECT p_partkey AS occ, CAST(CASE WHEN manual THEN level ELSE p_size END AS INT) AS level, coalesce(manual, FALSE) AS manual FROM part LEFT JOIN old ON occ = p_partkey")
def carry_manual_fields(spark, d):
    new = load(spark, d, "part").select(F.col("p_partkey").alias("occ"), F.col("p_size").cast("int").alias("level"))
    return carry.manual_fields(new, _old(spark, d).select("occ", "manual", "level"), ["level"])


@query("""WITH comp AS (SELECT p_partkey AS component, [p_partkey, p_partkey + 1] AS members, p_partkey + p_partkey % 2 AS "primary" FROM part WHERE p_partkey % 2 = 0),
 old AS (SELECT 'i' || CAST(l_partkey AS VARCHAR) AS instance, CASE WHEN l_partkey % 4 = 0 THEN [l_partkey, l_partkey + 1] ELSE [l_partkey] END AS members, l_partkey + CASE WHEN l_partkey % 4 IN (1, 3) THEN 0 ELSE 1 END AS owner FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey % 5 <> 0)),
 r1 AS (SELECT component, min(instance) AS instance FROM comp JOIN old ON old.members = comp.members GROUP BY 1),
 o AS (SELECT component, instance, owner = "primary" AS p FROM (SELECT component, "primary", unnest(members) AS m FROM comp WHERE component NOT IN (SELECT component FROM r1)) JOIN (SELECT * FROM old WHERE instance NOT IN (SELECT instance FROM r1)) ON owner = m),
 r2 AS (SELECT component, instance FROM o QUALIFY row_number() OVER (PARTITION BY component ORDER BY p DESC, instance) = 1)
 SELECT component, coalesce(r1.instance, r2.instance, 'new-' || sha256('component:' || CAST(component AS VARCHAR))) AS instance FROM comp LEFT JOIN r1 USING (component) LEFT JOIN r2 USING (component)""")
def instance_allocation(spark, d):
    k, p = F.col("p_partkey"), F.col("l_partkey")
    comp = load(spark, d, "part").where("p_partkey % 2 = 0").select(k.alias("component"), F.array(k, k + 1).alias("members"), (k + k % 2).alias("primary"))
    old = load(spark, d, "lineitem").where("l_partkey % 5 <> 0").select("l_partkey").distinct()
    old = old.select(F.concat(F.lit("i"), p.cast("string")).alias("instance"), F.when(p % 4 == 0, F.array(p, p + 1)).otherwise(F.array(p)).alias("members"), (p + F.when((p % 4).isin(1, 3), 0).otherwise(1)).alias("owner"))
    return carry.allocate(comp, old)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 9 AS r, l_linenumber - 1 AS c FROM lineitem")
def position_parse(spark, d):
    text = F.concat(F.lit("r"), (F.col("l_orderkey") % 9 + 1).cast("string"), F.lit("c"), F.col("l_linenumber").cast("string"))
    x = load(spark, d, "lineitem").withColumn("at", parse.position(text))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.col("at.row").cast("long").alias("r"), F.col("at.column").alias("c"))


# votes on merges: several distinct values set by hand keep a component apart
@query(f"WITH {OCC}, g AS (SELECT image AS component, count(DISTINCT CASE WHEN manual THEN quality END) > 1 AS vetoed FROM occ GROUP BY 1) SELECT occ_id, CASE WHEN vetoed THEN occ_id ELSE min(occ_id) OVER (PARTITION BY component) END AS \"group\", vetoed AS flagged FROM occ JOIN g ON component = image")
def manual_conflict_veto(spark, d):
    return components.manual_veto(A.occurrences(spark, d).select(F.col("occ_id").alias("node"), F.col("image").alias("component"), "manual", F.col("quality").alias("value"))).select(F.col("node").alias("occ_id"), "group", "flagged")


@query(f"WITH {OCC} SELECT r % 7 AS row_id, count(*) AS n FROM occ WHERE NOT EXISTS (SELECT 1 FROM occ t WHERE t.occ_id % 500 = 0 AND t.image = occ.image AND t.r = occ.r) GROUP BY 1")
def invalidated_rows(spark, d):
    o = A.occurrences(spark, d)
    return carry.without_tombstones(o, o.where("occ_id % 500 = 0").select("image", "r"), ["image", "r"]).groupBy((F.col("r") % 7).cast("long").alias("row_id")).agg(F.count("*").alias("n"))


@query(f"WITH {CARDS}, rows AS (SELECT DISTINCT user_id, k, r FROM cards), ids AS (SELECT 'main:' || user_id || '-' || k || ':' || r || '->' || user_id || '-' || (k + 1) || ':' || (r % 2) AS row_id, user_id, k, r FROM rows) SELECT row_id, CASE WHEN k % 2 = 0 THEN 'merge' ELSE 'pending' END AS resolution FROM ids")
def prior_resolutions(spark, d):
    rows = A.cards(spark, d).select("user_id", "k", "r").distinct()
    image = lambda k: F.concat_ws("-", "user_id", k)
    ids = rows.select("k", carry.row_id(F.lit("main"), image(F.col("k")), F.col("r"), image(F.col("k") + 1), F.col("r") % 2).alias("row_id"))
    prior = ids.where("k % 2 = 0").select("row_id", F.lit("merge").alias("resolution"))
    return carry.with_prior(ids.select("row_id"), prior)


# summaries and reports
@query(f"""WITH {OCC}, s AS (SELECT image, any_value(pool) AS pool, count(*) AS detected, count(CASE WHEN action = 'keep' AND NOT (complete AND name IS NOT NULL AND coalesce(level, 0) <> 0 AND quality IS NOT NULL) THEN 1 END) AS pending, count(CASE WHEN action <> 'keep' THEN 1 END) AS excluded,
 count(CASE WHEN action = 'keep' AND duplicate THEN 1 END) AS duplicates, count(CASE WHEN occ_id % 203 = 0 THEN 1 END) AS warnings FROM occ GROUP BY 1)
 SELECT image, coalesce(pool, 'unknown') AS page_type, detected, pending, excluded, duplicates, warnings, row_number() OVER (ORDER BY CASE WHEN pending > 0 THEN 0 ELSE 1 END, CASE WHEN warnings > 0 THEN 0 ELSE 1 END, image) AS pos FROM s""")
def image_summary(spark, d):
    return review.image_summaries(A.occurrences(spark, d).withColumn("warned", F.col("occ_id") % 203 == 0))


@query(f"""WITH {OCC}, s AS (SELECT image, count(CASE WHEN conf < 45 AND action = 'keep' THEN 1 END) AS pending, count(CASE WHEN action <> 'keep' THEN 1 END) AS excluded, count(DISTINCT CASE WHEN duplicate THEN occ_id END) AS duplicates, count(CASE WHEN NOT complete THEN 1 END) AS fragments, count(CASE WHEN manual THEN 1 END) AS edits FROM occ WHERE pool IS DISTINCT FROM 'experience' GROUP BY 1)
 SELECT image, pending, excluded + duplicates + fragments + edits AS tier2, excluded, duplicates, CAST(CASE WHEN pending > 0 THEN 0 WHEN excluded + duplicates + fragments + edits > 0 THEN 1 ELSE 2 END AS INT) AS priority FROM s""")
def product_image_summary(spark, d):
    o = A.occurrences(spark, d).where("pool is null or pool <> 'experience'")
    return review.product_summaries(o.withColumn("pending", (F.col("conf") < 45) & (F.col("action") == "keep")))


@query(f"WITH {OCC} SELECT count(*) AS total, count(CASE WHEN complete THEN 1 END) AS complete, count(name) AS named, count(level) AS levelled, count(CASE WHEN manual THEN 1 END) AS manual, count(CASE WHEN duplicate THEN 1 END) AS duplicate, count(CASE WHEN quality = 0 THEN 1 END) AS quality_0, count(CASE WHEN quality = 1 THEN 1 END) AS quality_1, count(CASE WHEN quality = 2 THEN 1 END) AS quality_2, count(CASE WHEN quality = 3 THEN 1 END) AS quality_3, count(CASE WHEN quality IS NULL THEN 1 END) AS quality_unknown, image % 20 AS batch FROM occ GROUP BY image % 20")
def analysis_metrics(spark, d):
    return review.metrics(A.occurrences(spark, d).withColumn("batch", F.col("image") % 20), "batch", 4)


@query("SELECT o_custkey AS batch, count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS completed, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS failed, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS cancelled, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 10 END), 0) AS BIGINT) AS ordinary, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS peak FROM orders GROUP BY 1")
def batch_summary(spark, d):
    s = F.col("o_orderstatus")
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.when(s == "F", "completed").when(s == "P", "failed").otherwise("cancelled").alias("status"), (F.col("o_orderkey") % 10).alias("ordinary"))
    return review.batch_summary(o, "batch")


STAGES = ["decode", "detect", "recognise", "match"]


@query("""WITH s AS (SELECT user_id % 20 AS batch, CAST(sum(event_id % 97) AS BIGINT) AS decode, CAST(sum(event_id % 89) AS BIGINT) AS detect, CAST(sum(event_id % 83) AS BIGINT) AS recognise, CAST(sum(event_id % 97) AS BIGINT) AS match, CAST(sum(400) AS BIGINT) AS wall FROM events GROUP BY 1),
 u AS (SELECT batch, wall, unnest(['decode', 'detect', 'recognise', 'match']) AS stage, unnest([decode, detect, recognise, match]) AS ms FROM s) SELECT batch, stage, ms, CAST(10000 * ms // wall AS BIGINT) AS basis_points, CAST(row_number() OVER (PARTITION BY batch ORDER BY ms DESC, stage) AS INT) AS place FROM u QUALIFY place <= 3""")
def stage_topk(spark, d):
    e = F.col("event_id")
    x = load(spark, d, "events").select((F.col("user_id") % 20).alias("batch"), (e % 97).alias("decode"), (e % 89).alias("detect"), (e % 83).alias("recognise"), (e % 97).alias("match"), F.lit(400).alias("wall"))
    return review.top_stages(x, "batch", STAGES, "wall", 3)


@query("SELECT lang, count(*) AS fields, CAST(sum(3) AS BIGINT) AS all_calls, CAST(sum(CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 3 END) AS BIGINT) AS strict_calls, CAST(sum(CASE WHEN n_chars % 5 = 0 OR n_chars % 3 = 0 THEN 1 WHEN n_chars % 3 = 1 THEN 2 ELSE 3 END) AS BIGINT) AS agree_calls, CAST(10000 * (sum(3) - sum(CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 3 END)) // sum(3) AS BIGINT) AS strict_saved FROM documents GROUP BY 1")
def strategy_estimate(spark, d):
    n = F.col("n_chars")
    x = load(spark, d, "documents").select("lang", (n % 5 == 0).alias("strict"), (n % 3 == 0).alias("agree1"), (n % 3 == 1).alias("agree2"))
    return review.strategy(x, "lang", 3)


@query("SELECT o_custkey AS batch, CASE WHEN bool_or(o_orderstatus = 'P' AND o_orderkey % 3 = 0) THEN 'blocked' WHEN bool_or(o_orderstatus = 'P' OR o_orderkey % 11 = 0) THEN 'needs_review' ELSE 'ready' END AS status, count(CASE WHEN o_orderstatus = 'P' OR o_orderkey % 11 = 0 THEN 1 END) AS reasons FROM orders GROUP BY 1")
def reason_rollup(spark, d):
    k = F.col("o_orderkey")
    p = F.col("o_orderstatus") == "P"
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.when(p & (k % 3 == 0), "error").when(p | (k % 11 == 0), "warning").alias("severity"))
    return review.rollup(o, "batch")


@query(f"WITH {OCC} SELECT pool, name, quality, level, conf % 3 AS target, count(*) AS quantity FROM occ WHERE pool IN ('main', 'support') GROUP BY ALL")
def export_aggregate(spark, d):
    o = A.occurrences(spark, d).where("pool in ('main', 'support')").withColumn("target", F.col("conf") % 3)
    return review.export_rows(o, ["pool", "name", "quality", "level", "target"])


# geometry: a box per line item
BOX = "box AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, CAST(l_partkey % 300 AS INT) AS x, CAST(l_suppkey % 200 AS INT) AS y, CAST(20 + l_partkey % 7 AS INT) AS rad FROM lineitem)"


def _boxes(spark, d):
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), i.cast("long").alias("id"), (F.col("l_partkey") % 300).cast("int").alias("x"), (F.col("l_suppkey") % 200).cast("int").alias("y"), (20 + F.col("l_partkey") % 7).cast("int").alias("rad"))


@query(f"WITH {BOX} SELECT image, min(x - rad) - 4 AS x0, min(y - rad) - 4 AS y0, max(x + rad) + 4 AS x1, max(y + rad) + 4 AS y1, count(*) AS n FROM box GROUP BY 1")
def row_crops(spark, d):
    return geometry.crops(_boxes(spark, d), "image", 4)


@query(f"""WITH {BOX}, p AS (SELECT a.image, a.id AS a, b.id AS b, greatest(0, least(a.x + a.rad, b.x + b.rad) - greatest(a.x - a.rad, b.x - b.rad)) * greatest(0, least(a.y + a.rad, b.y + b.rad) - greatest(a.y - a.rad, b.y - b.rad)) AS inter, 4 * a.rad * a.rad + 4 * b.rad * b.rad AS areas FROM box a JOIN box b ON a.image = b.image AND a.id < b.id)
 SELECT image, a, b, CAST(10000 * inter // (areas - inter) AS BIGINT) AS iou FROM p WHERE inter > 0""")
def box_iou(spark, d):
    return geometry.overlaps(_boxes(spark, d))


@query(f"""WITH RECURSIVE {BOX}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY rad DESC, id) AS n FROM box),
 k AS (SELECT image, 0 AS n, CAST([] AS STRUCT(id BIGINT, x INT, y INT, rad INT)[]) AS kept FROM (SELECT DISTINCT image FROM box)
  UNION ALL SELECT k.image, o.n, CASE WHEN len(list_filter(kept, lambda q: 10000 * ((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y)) <= 3025 * least(q.rad, o.rad) * least(q.rad, o.rad)
   OR 100 * (greatest(0, least(q.x + q.rad, o.x + o.rad) - greatest(q.x - q.rad, o.x - o.rad)) * greatest(0, least(q.y + q.rad, o.y + o.rad) - greatest(q.y - q.rad, o.y - o.rad))) >= 58 * (4 * q.rad * q.rad + 4 * o.rad * o.rad - greatest(0, least(q.x + q.rad, o.x + o.rad) - greatest(q.x - q.rad, o.x - o.rad)) * greatest(0, least(q.y + q.rad, o.y + o.rad) - greatest(q.y - q.rad, o.y - o.rad))))) > 0
   THEN kept ELSE list_append(kept, {{'id': o.id, 'x': o.x, 'y': o.y, 'rad': o.rad}}) END FROM k JOIN o ON o.image = k.image AND o.n = k.n + 1)
 SELECT image, unnest(list_transform(kept, lambda q: q.id)) AS id FROM (SELECT * FROM k QUALIFY n = max(n) OVER (PARTITION BY image))""")
def box_nms(spark, d):
    return geometry.nms(_boxes(spark, d).where("true"))


@query(f"WITH {BOX}, n AS (SELECT a.image, a.rad AS centre, count(*) AS members FROM (SELECT DISTINCT image, rad FROM box) a JOIN box b ON a.image = b.image AND abs(a.rad - b.rad) <= 2 GROUP BY 1, 2) SELECT image, centre, members FROM n QUALIFY row_number() OVER (PARTITION BY image ORDER BY members DESC, centre) = 1")
def radius_mode(spark, d):
    return geometry.radius_mode(_boxes(spark, d), 2)


@query(f"WITH {BOX}, g AS (SELECT image, id, y, CASE WHEN y - lag(y) OVER (PARTITION BY image ORDER BY y, id) <= 15 THEN 0 ELSE 1 END AS b FROM box) SELECT image, id, CAST(sum(b) OVER (PARTITION BY image ORDER BY y, id) AS BIGINT) AS row_no FROM g")
def row_clusters(spark, d):
    return geometry.gap_clusters(_boxes(spark, d), 15)


@query(f"WITH {BOX} SELECT image, id, CAST(CASE WHEN x < 75 THEN 0 WHEN x < 150 THEN 1 WHEN x < 225 THEN 2 ELSE 3 END AS INT) AS col, abs(x - (37 + 75 * CASE WHEN x < 75 THEN 0 WHEN x < 150 THEN 1 WHEN x < 225 THEN 2 ELSE 3 END)) <= 30 AS fits FROM box WHERE x <> 299 AND x % 75 NOT IN (74, 0)")
def lattice_columns(spark, d):
    b = _boxes(spark, d).where("x <> 299 and x % 75 not in (74, 0)")
    return geometry.nearest_column(b, [37, 112, 187, 262], 30)


@query(f"""WITH {BOX}, e AS (SELECT *, y - rad < 5 OR y + rad > 195 AS at_edge, CAST(y // 40 AS INT) AS r FROM box), g AS (SELECT image, r, bool_or(at_edge) AS any_edge, max(y - rad) - min(y - rad) AS top, max(y + rad) - min(y + rad) AS low, count(*) AS n, median(rad) AS mr FROM e GROUP BY 1, 2)
 SELECT image, id, at_edge OR (n = 4 AND any_edge AND top <= greatest(2, 0.25 * mr) AND low <= greatest(2, 0.25 * mr)) AS excluded FROM e JOIN g USING (image, r)""")
def edge_fragments(spark, d):
    b = _boxes(spark, d)
    return geometry.edge_fragments(b.withColumn("r", F.expr("cast(y div 40 as int)")).withColumn("at_edge", (F.col("y") - F.col("rad") < 5) | (F.col("y") + F.col("rad") > 195)))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN NULL ELSE o_custkey % 60 + 1 END AS level, o_orderstatus = 'F' AS manual FROM orders")
def manual_overrides(spark, d):
    s, c = F.col("o_orderstatus"), F.col("o_custkey")
    o = load(spark, d, "orders")
    rows = o.select("o_orderkey", (c % 60 + 1).alias("level"))
    hand = o.where("o_orderstatus <> 'O'").select("o_orderkey", F.when((s == "P") & (c % 2 == 0), "unknown").when(s == "F", (c % 60 + 1).cast("string")).alias("value"))
    return reconcile.override(rows, hand, "o_orderkey", "level")
