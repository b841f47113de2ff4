"""Queries over observed cards: predicates, votes, neighbour repairs, orders; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import consensus, inventory, predicates, sequence
from tallyforge.plans import adapters as A
from tallyforge.plans.registry import query
from tallyforge.sources.tables import load

OCC = """occ AS (SELECT event_id AS occ_id, user_id AS image, rn AS ord, rn // 4 AS r, rn % 4 AS c, event_id % 11 <> 0 AS complete, CASE WHEN event_id % 37 <> 0 THEN event_type END AS name,
 CASE WHEN event_id % 23 <> 0 THEN 1 + CAST(floor(value) AS INT) % 12 END AS level, CASE WHEN event_id % 29 <> 0 THEN CAST(event_id % 4 AS INT) END AS quality, CAST(40 + event_id % 60 AS INT) AS conf,
 CASE event_id % 13 WHEN 0 THEN 'exclude_fragment' WHEN 1 THEN 'ignore' ELSE 'keep' END AS action, event_id % 17 = 0 AS duplicate, event_id % 19 = 0 AS manual,
 CASE event_id % 3 WHEN 0 THEN 'equipped' WHEN 1 THEN 'unequipped' ELSE 'unknown' END AS equipped, CASE user_id % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'support' WHEN 2 THEN 'experience' WHEN 3 THEN 'unknown' END AS pool
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events))"""
IMAGES = f"{OCC}, images AS (SELECT image, any_value(pool) AS pool, min(occ_id) AS first FROM occ GROUP BY image)"


def _images(spark, d):
    return A.occurrences(spark, d).groupBy("image").agg(F.first("pool").alias("pool"), F.min("occ_id").alias("first"))


@query(f"WITH {OCC} SELECT occ_id, name, level, quality FROM occ WHERE complete AND name IS NOT NULL AND level IS NOT NULL AND quality IS NOT NULL AND action = 'keep' AND NOT duplicate")
def usable_occurrences(spark, d):
    return predicates.usable(A.occurrences(spark, d)).select("occ_id", "name", "level", "quality")


@query(f"""WITH {OCC} SELECT occ_id, level IS NOT NULL AND quality IS NOT NULL AND conf >= 65 AS reliable, complete AND action = 'keep' AND coalesce(pool, '') IN ('main', 'support') AS active,
 action = 'keep' AND NOT (complete AND name IS NOT NULL AND coalesce(level, 0) <> 0 AND quality IS NOT NULL) AS needs_review,
 concat_ws(',', CASE WHEN name IS NULL THEN 'ordinary_name_unresolved' END, CASE WHEN level IS NULL OR level < 1 OR level > 60 THEN 'ordinary_level_unresolved' END, CASE WHEN quality IS NULL THEN 'ordinary_quality_unresolved' END) AS codes FROM occ""")
def occurrence_flags(spark, d):
    return predicates.flags(A.occurrences(spark, d)).select("occ_id", "reliable", "active", "needs_review", F.array_join("codes", ",").alias("codes"))


@query(f"WITH {IMAGES} SELECT image % 50 AS batch, count(*) > 0 AND count(CASE WHEN coalesce(pool, 'unknown') = 'unknown' THEN 1 END) = 0 AND count(CASE WHEN first % 9 = 0 THEN 1 END) = 0 AS confirmable FROM images GROUP BY 1")
def bulk_confirm(spark, d):
    x = _images(spark, d).withColumn("batch", F.col("image") % 50)
    return predicates.confirmable(x, "batch", F.col("first") % 9 == 0)


@query(f"WITH {IMAGES} SELECT image, row_number() OVER (ORDER BY first) AS queue FROM images WHERE pool IS NULL OR pool = 'unknown'")
def unclassified_queue(spark, d):
    return predicates.unclassified(_images(spark, d), "first").select("image", "queue")


@query(f"WITH {OCC}, t AS (SELECT *, CASE WHEN manual THEN 3 WHEN duplicate THEN 2 WHEN conf < 60 THEN 1 ELSE 4 END AS tier FROM occ) SELECT occ_id, CAST(tier AS INT) AS tier FROM t QUALIFY tier = min(tier) OVER (PARTITION BY image)")
def default_tier(spark, d):
    tier = F.when(F.col("manual"), 3).when(F.col("duplicate"), 2).when(F.col("conf") < 60, 1).otherwise(4)
    return predicates.default_tier(A.occurrences(spark, d).withColumn("tier", tier)).select("occ_id", "tier")


@query("SELECT user_id, event_id, depth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS depth FROM events WHERE event_id % 100 >= 10) WHERE depth <= 30")
def undo_stack(spark, d):
    h = load(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 100).alias("revision"), F.lit(10).alias("base"))
    return predicates.undo_stack(h, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "depth")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name AS name, CASE WHEN p_partkey IS NULL THEN 'recognition_missing' END AS warning FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25 WHERE l_linenumber <> 3")
def cards_with_stars(spark, d):
    cards = load(spark, d, "lineitem").where("l_linenumber <> 3").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("card"))
    stars = load(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("card"), F.col("p_name").alias("name"))
    return predicates.with_stars(cards, stars).select("l_orderkey", "l_linenumber", "l_partkey", "name", "warning")


VOTE = "v AS (SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal, l_linenumber AS value, 500 + CAST(round(l_discount * 4000) AS BIGINT) AS conf, l_returnflag = 'A' AS \"full\" FROM lineitem)"


@query(f"""WITH {VOTE}, s AS (SELECT grp, value, CAST(sum(conf + CASE WHEN "full" THEN 220 ELSE 0 END) AS BIGINT) AS w, count(*) AS n FROM v GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY w DESC, value DESC) AS k, lead(w) OVER (PARTITION BY grp ORDER BY w DESC, value DESC) AS second, count(*) OVER (PARTITION BY grp) AS kinds FROM s),
 b AS (SELECT grp, value, conf AS bc, "full" AS bf FROM v QUALIFY row_number() OVER (PARTITION BY grp, value ORDER BY conf DESC, ordinal) = 1),
 d AS (SELECT k.*, bc, kinds > 1 AND NOT (bf AND bc >= 850) AND w - coalesce(second, 0) < 150 AS doubtful FROM k JOIN b USING (grp, value) WHERE k = 1)
 SELECT grp, CASE WHEN NOT doubtful THEN value END AS value, CASE WHEN doubtful THEN 0 ELSE least(99000, 82 * bc + 6000 * least(n, 3)) END AS score, CASE WHEN doubtful THEN 'level_strategy_conflict' WHEN kinds > 1 THEN 'level_weighted_consensus' END AS warning FROM d""")
def level_consensus_whole(spark, d):
    li = load(spark, d, "lineitem")
    # the order of texts within a group decides ties of confidence
    o = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    v = li.select(F.col("l_orderkey").alias("grp"), o.cast("long").alias("ordinal"), F.col("l_linenumber").alias("value"), (500 + F.round(F.col("l_discount") * 4000).cast("long")).alias("conf"), (F.col("l_returnflag") == "A").alias("full"))
    return consensus.level_vote(v)


PAIR = "o AS (SELECT user_id AS grp, event_id AS ord, CAST(event_id % 3 AS INT) AS current, CAST(event_id % 2 AS INT) AS capacity, CAST(40 + event_id % 60 AS INT) AS conf FROM events)"


@query(f"""WITH {PAIR}, s AS (SELECT grp, current, capacity, sum(conf) AS w, min(ord) AS f FROM o GROUP BY ALL), n AS (SELECT grp, count(*) AS n FROM o GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY w DESC, f) AS k, count(*) OVER (PARTITION BY grp) AS kinds FROM s)
 SELECT grp, current, capacity, CAST(least(99, w // n) AS BIGINT) AS score, kinds > 1 AS conflict FROM r JOIN n USING (grp) WHERE k = 1""")
def bag_pair_consensus(spark, d):
    e = F.col("event_id")
    o = load(spark, d, "events").select(F.col("user_id").alias("grp"), e.alias("ord"), (e % 3).cast("int").alias("current"), (e % 2).cast("int").alias("capacity"), (40 + e % 60).cast("int").alias("conf"))
    return consensus.pair_vote(o)


@query("""WITH u AS (SELECT user_id AS grp, 40 + event_id % 60 AS conf, UNNEST(['orange', 'purple', 'white']) AS colour, UNNEST([CASE WHEN event_id % 3 <> 0 THEN event_id % 2 END, event_id % 4, CASE WHEN event_id % 5 = 0 THEN 7 END]) AS value FROM events),
 g AS (SELECT grp, colour, count(DISTINCT CASE WHEN conf >= 90 THEN value END) AS k, min(CASE WHEN conf >= 90 THEN value END) AS v, min(CASE WHEN conf >= 90 THEN conf END) AS c FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
 SELECT grp, colour, CAST(CASE WHEN k = 1 THEN v END AS INT) AS value, CAST(CASE WHEN k = 1 THEN c END AS INT) AS confidence, CASE WHEN k = 0 THEN 'unrecognized' WHEN k > 1 THEN 'conflict' ELSE 'agreed' END AS status FROM g""")
def experience_resolution(spark, d):
    e = F.col("event_id")
    o = load(spark, d, "events").select(
        F.col("user_id").alias("grp"), (40 + e % 60).cast("int").alias("conf"), F.when(e % 3 != 0, e % 2).cast("int").alias("orange"), (e % 4).cast("int").alias("purple"), F.when(e % 5 == 0, 7).alias("white")
    )
    return consensus.per_colour(o, ["orange", "purple", "white"], 90)


HEAD = """o AS (SELECT user_id AS grp, event_id, CAST(40 + event_id % 60 AS INT) AS conf, CASE WHEN event_id % 211 = 0 THEN 'invalid' WHEN event_id % 97 = 0 THEN 'ambiguous' WHEN event_id % 2 = 0 THEN 'confirmed' ELSE 'candidate' END AS state, user_id % 5 AS cur, CASE WHEN user_id % 3 = 0 THEN event_id % 2 ELSE user_id % 7 END AS cap FROM events),
 f AS (SELECT grp, max(state = 'invalid') AS bad, max(state = 'ambiguous') AS amb, count(CASE WHEN state = 'confirmed' AND conf >= 65 AND event_id % 3 <> 0 THEN 1 END) AS n, min(CASE WHEN state = 'confirmed' AND conf >= 65 AND event_id % 3 <> 0 THEN cur END) AS lo, max(CASE WHEN state = 'confirmed' AND conf >= 65 AND event_id % 3 <> 0 THEN cur END) AS hi,
  count(CASE WHEN state = 'confirmed' AND conf >= 65 THEN cap END) AS n2, min(CASE WHEN state = 'confirmed' AND conf >= 65 THEN cap END) AS lo2, max(CASE WHEN state = 'confirmed' AND conf >= 65 THEN cap END) AS hi2 FROM o GROUP BY 1),
 s AS (SELECT *, CASE WHEN bad THEN 'invalid' WHEN amb THEN 'conflict' WHEN n = 0 THEN 'unknown' WHEN lo <> hi THEN 'conflict' WHEN n = 1 THEN 'candidate' ELSE 'confirmed' END AS s1, CASE WHEN bad THEN 'invalid' WHEN amb THEN 'conflict' WHEN n2 = 0 THEN 'unknown' WHEN lo2 <> hi2 THEN 'conflict' WHEN n2 = 1 THEN 'candidate' ELSE 'confirmed' END AS s2 FROM f),
 h AS (SELECT grp, CAST(CASE WHEN s1 IN ('candidate', 'confirmed') THEN lo END AS INT) AS current, s1 AS current_status, CAST(CASE WHEN s2 IN ('candidate', 'confirmed') THEN lo2 END AS INT) AS capacity, s2 AS capacity_status FROM s)"""


def _header(spark, d):
    e = F.col("event_id")
    state = F.when(e % 211 == 0, "invalid").when(e % 97 == 0, "ambiguous").when(e % 2 == 0, "confirmed").otherwise("candidate")
    o = load(spark, d, "events").select(F.col("user_id").alias("grp"), "event_id", (40 + e % 60).cast("int").alias("conf"), state.alias("state"), (F.col("user_id") % 5).cast("int").alias("cur"), F.when(F.col("user_id") % 3 == 0, e % 2).otherwise(F.col("user_id") % 7).cast("int").alias("cap"))
    cur = consensus.field_value(o.withColumn("value", F.when(e % 3 != 0, F.col("cur"))), 65).select("grp", F.col("value").alias("current"), F.col("status").alias("current_status"))
    cap = consensus.field_value(o.withColumn("value", F.col("cap")), 65).select("grp", F.col("value").alias("capacity"), F.col("status").alias("capacity_status"))
    return cur.join(cap, "grp")


@query(f"""WITH {HEAD}, z AS (SELECT *, CASE WHEN current > capacity THEN 'invalid' ELSE current_status END AS c2 FROM h)
 SELECT grp, current, c2 AS current_status, capacity, capacity_status, CASE WHEN 'invalid' IN (c2, capacity_status) THEN 'invalid' WHEN 'conflict' IN (c2, capacity_status) THEN 'conflict' WHEN c2 = 'confirmed' AND capacity_status = 'confirmed' THEN 'confirmed' WHEN c2 = 'unknown' AND capacity_status = 'unknown' THEN 'unknown' ELSE 'partial' END AS status FROM z""")
def header_summary(spark, d):
    return consensus.header_summary(_header(spark, d))


NAMES = """t AS (SELECT user_id AS grp, event_id AS ordinal, CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN ' ' || event_type || '级!' WHEN event_id % 10 = 2 THEN 'odd' ELSE event_type END AS text, CAST(40 + event_id % 60 AS BIGINT) AS conf FROM events),
 a AS (SELECT DISTINCT event_type AS name FROM events), m AS (SELECT min(name) AS first FROM a)"""


@query(f"""WITH {NAMES}, n AS (SELECT grp, ordinal, conf, regexp_replace(text, '[^\\pL\\pN]|[级級]', '', 'g') AS raw FROM t), x AS (SELECT *, CASE WHEN raw = 'odd' THEN (SELECT first FROM m) ELSE raw END AS norm FROM n WHERE raw <> ''),
 b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY grp ORDER BY conf DESC, ordinal) = 1), g AS (SELECT grp, norm, count(*) AS agree FROM x GROUP BY 1, 2)
 SELECT grp, raw, CASE WHEN ok THEN norm END AS name, CASE WHEN ok THEN least(9900, 85 * conf + 500 * least(agree, 3)) ELSE 50 * conf END AS score, CASE WHEN NOT ok THEN 'name_unknown' END AS warning
 FROM (SELECT b.*, agree, norm IN (SELECT regexp_replace(name, '[^\\pL\\pN]', '', 'g') FROM a) AS ok FROM b JOIN g USING (grp, norm))""")
def name_consensus(spark, d):
    from tallyforge.functions.parse import clean_name

    e = load(spark, d, "events")
    i = F.col("event_id")
    text = F.when(i % 10 == 0, "").when(i % 10 == 1, F.concat(F.lit(" "), "event_type", F.lit("级!"))).when(i % 10 == 2, "odd").otherwise(F.col("event_type"))
    allowed = e.select(clean_name(F.col("event_type")).alias("name")).distinct()
    aliases = e.agg(F.min("event_type").alias("name")).select(F.lit("odd").alias("alias"), "name")
    t = e.select(F.col("user_id").alias("grp"), i.alias("ordinal"), text.alias("text"), (40 + i % 60).cast("long").alias("conf"))
    return consensus.name_vote(t, aliases, allowed)


KINDS = "o AS (SELECT user_id AS page, CASE event_id % 4 WHEN 0 THEN 'orange' WHEN 1 THEN 'purple' WHEN 2 THEN 'white' END AS kind, CAST(event_id % 1000 AS INT) AS value, CAST(event_id % 101 AS INT) AS k1, CAST(event_id % 89 AS INT) AS k2, event_id % 53 <> 0 AS complete FROM events)"


@query(f"""WITH {KINDS}, w AS (SELECT page, bool_and(complete) AS whole FROM o GROUP BY 1), b AS (SELECT page, kind, value FROM o WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, kind ORDER BY least(k1, k2) DESC, value) = 1),
 p AS (SELECT page, max(CASE WHEN kind = 'orange' THEN value END) AS orange, max(CASE WHEN kind = 'purple' THEN value END) AS purple, max(CASE WHEN kind = 'white' THEN value END) AS white FROM b GROUP BY 1)
 SELECT page, CASE WHEN orange IS NULL AND whole THEN 0 ELSE orange END AS orange, CASE WHEN purple IS NULL AND whole THEN 0 ELSE purple END AS purple, CASE WHEN white IS NULL AND whole THEN 0 ELSE white END AS white FROM w LEFT JOIN p USING (page)""")
def experience_aggregate(spark, d):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "orange").when(e % 4 == 1, "purple").when(e % 4 == 2, "white")
    o = load(spark, d, "events").select(F.col("user_id").alias("page"), kind.alias("kind"), (e % 1000).cast("int").alias("value"), (e % 101).cast("int").alias("kind_conf"), (e % 89).cast("int").alias("count_conf"), (e % 53 != 0).alias("complete"))
    return consensus.best_per_kind(o, ["orange", "purple", "white"])


W = "WINDOW w AS (PARTITION BY image ORDER BY r, c)"


@query(f"WITH {OCC} SELECT occ_id, coalesce(lag(quality) OVER w < quality OR (lag(quality) OVER w = quality AND lag(level) OVER w < level), FALSE) AS boundary FROM occ WHERE complete {W}")
def equipped_boundary(spark, d):
    return sequence.equipped_boundary(A.occurrences(spark, d)).select("occ_id", "boundary")


@query(f"WITH {OCC} SELECT occ_id, coalesce(lag(equipped) OVER w = 'unequipped' AND equipped = 'equipped', FALSE) AS reversal FROM occ WHERE complete {W}")
def equipped_reversal(spark, d):
    return sequence.equipped_reversal(A.occurrences(spark, d)).select("occ_id", "reversal")


ISLES = f"""{OCC}, b AS (SELECT *, CASE WHEN equipped = 'unknown' OR quality IS NULL OR lag(equipped) OVER w IS DISTINCT FROM equipped OR lag(quality) OVER w IS DISTINCT FROM quality THEN 1 ELSE 0 END AS brk FROM occ WHERE complete {W}),
 isle AS (SELECT *, CAST(sum(brk) OVER w AS BIGINT) AS island FROM b {W})"""


@query(f"WITH {ISLES} SELECT occ_id, island FROM isle")
def card_islands(spark, d):
    return sequence.card_islands(A.occurrences(spark, d)).select("occ_id", "island")


@query(f"""WITH {ISLES}, n AS (SELECT *, lag(level) OVER i AS a, lead(level) OVER i AS z FROM isle WINDOW i AS (PARTITION BY image, island ORDER BY r, c)),
 s AS (SELECT *, CASE WHEN manual AND a < level THEN 'manual_override' WHEN a < level THEN 'conflict' WHEN level IS NULL AND NOT manual AND a = z THEN 'inferred' ELSE 'kept' END AS level_state FROM n)
 SELECT occ_id, CASE level_state WHEN 'conflict' THEN NULL WHEN 'inferred' THEN a ELSE level END AS level, level_state FROM s""")
def level_order_islands(spark, d):
    return sequence.island_levels(sequence.card_islands(A.occurrences(spark, d))).select("occ_id", "level", "level_state")


# few values, so that neighbours agree often enough
FEW = f"{OCC}, few AS (SELECT occ_id, image, r, c, complete, conf, CASE WHEN occ_id % 3 <> 0 THEN CASE WHEN image % 2 = 0 THEN 'x' ELSE name END END AS name, 'equipped' AS equipped, CAST(image % 4 AS INT) AS quality, CASE WHEN occ_id % 7 <> 0 THEN CAST(image % 9 + 1 + (occ_id % 11) // 10 AS INT) END AS level FROM occ)"


def _few(spark, d):
    i, o = F.col("image"), F.col("occ_id")
    x = A.occurrences(spark, d)
    return x.select(
        "occ_id", "image", "r", "c", "complete", "conf", F.when(o % 3 != 0, F.when(i % 2 == 0, "x").otherwise(F.col("name"))).alias("name"), F.lit("equipped").alias("equipped"), (i % 4).cast("int").alias("quality"),
        F.when(o % 7 != 0, (i % 9 + 1 + F.expr("occ_id % 11 div 10")).cast("int")).alias("level"),
    )


@query(f"""WITH {FEW}, n AS (SELECT *, name IS NULL AND lag(name) OVER w = lead(name) OVER w AND lag(r) OVER w = r AND lead(r) OVER w = r AND lag(c) OVER w = c - 1 AND lead(c) OVER w = c + 1 AND lag(quality) OVER w = quality AND lead(quality) OVER w = quality
  AND lag(level) OVER w = level AND lead(level) OVER w = level AS fits, lag(name) OVER w AS a FROM few WHERE complete {W}) SELECT occ_id, CASE WHEN fits THEN a ELSE name END AS name, coalesce(fits, FALSE) AS inferred FROM n""")
def name_sandwich(spark, d):
    return sequence.name_sandwich(_few(spark, d)).select("occ_id", "name", "inferred")


@query(f"""WITH {FEW}, n AS (SELECT *, name IS NULL AND complete AND lag(complete) OVER w AND lead(complete) OVER w AND lag(4 * r + c) OVER w = 4 * r + c - 1 AND lead(4 * r + c) OVER w = 4 * r + c + 1 AND lag(name) OVER w = lead(name) OVER w
  AND lag(conf) OVER w >= 72 AND lead(conf) OVER w >= 72 AND lag(level) OVER w = level AND lead(level) OVER w = level AS fits, lag(name) OVER w AS a FROM few {W}) SELECT occ_id, CASE WHEN fits THEN a ELSE name END AS name, coalesce(fits, FALSE) AS inferred FROM n""")
def name_sandwich_reading(spark, d):
    return sequence.reading_sandwich(_few(spark, d)).select("occ_id", "name", "inferred")


@query(f"""WITH {OCC}, n AS (SELECT *, coalesce(lag(level) OVER w, 60) AS u, coalesce(lead(level) OVER w, 1) AS l, complete AND coalesce(lag(complete) OVER w AND lag(4 * r + c) OVER w = 4 * r + c - 1, lag(r) OVER w IS NULL) AND coalesce(lead(complete) OVER w AND lead(4 * r + c) OVER w = 4 * r + c + 1, lead(r) OVER w IS NULL) AS t FROM occ {W}),
 s AS (SELECT *, CASE WHEN NOT t THEN 'untouched' WHEN u < l THEN 'conflict' WHEN level >= l AND level <= u THEN 'kept' WHEN u = l THEN 'inferred' ELSE 'conflict' END AS level_state FROM n)
 SELECT occ_id, CASE level_state WHEN 'inferred' THEN u WHEN 'conflict' THEN NULL ELSE level END AS level, level_state FROM s""")
def level_intervals(spark, d):
    return sequence.level_intervals(A.occurrences(spark, d)).select("occ_id", "level", "level_state")


@query(f"WITH {OCC}, y AS (SELECT image, r, 40 * r + image % 7 + (r * r) % 5 AS y FROM (SELECT DISTINCT image, r FROM occ)), g AS (SELECT image, y - lag(y) OVER (PARTITION BY image ORDER BY y) AS gap FROM y) SELECT image, CAST(2 * median(gap) AS BIGINT) AS gap2, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1")
def row_gaps(spark, d):
    rows = A.occurrences(spark, d).select("image", "r").distinct()
    return sequence.row_gaps(rows.select("image", (40 * F.col("r") + F.col("image") % 7 + (F.col("r") * F.col("r")) % 5).alias("y")))


def _positions(name: str, sql_keys: str, keys: list[str], rows, sql: str):
    """A named order as positions, so that the order itself is compared."""

    def run(spark, d):
        x = rows(spark, d)
        return inventory.numbered(x, inventory.ordered(x, keys), "pos").select("id", "pos")

    run.__name__ = name
    query(f"WITH {sql} SELECT id, row_number() OVER (ORDER BY {sql_keys}) AS pos FROM x")(run)


_RANKED = f"""{OCC}, x AS (SELECT occ_id AS id, CASE pool WHEN 'main' THEN 0 WHEN 'support' THEN 1 ELSE 99 END AS kr, CASE equipped WHEN 'equipped' THEN 0 WHEN 'unequipped' THEN 1 ELSE 2 END AS er, coalesce(quality, 0) AS qr, coalesce(level, -1) AS lr,
 CASE WHEN name IS NULL THEN (SELECT count(DISTINCT name) FROM occ) ELSE (SELECT count(DISTINCT n.name) FROM occ n WHERE n.name < occ.name) END AS cr, coalesce(name, '') AS nm, image, r, c FROM occ)"""


def _ranks(spark, d):
    """Ranks of unknown names follow all known ones."""
    o = A.occurrences(spark, d)
    names = inventory.catalog(o.where("name is not null"))
    n = names.agg(F.count("*").alias("_n"))
    x = o.join(F.broadcast(names), "name", "left").crossJoin(F.broadcast(n))  # one row: the number of names
    return x.select(
        F.col("occ_id").alias("id"), F.when(F.col("pool") == "main", 0).when(F.col("pool") == "support", 1).otherwise(99).alias("kr"), F.when(F.col("equipped") == "equipped", 0).when(F.col("equipped") == "unequipped", 1).otherwise(2).alias("er"),
        F.coalesce("quality", F.lit(0)).alias("qr"), F.coalesce("level", F.lit(-1)).alias("lr"), F.coalesce("idx", "_n").alias("cr"), F.coalesce("name", F.lit("")).alias("nm"), "image", "r", "c",
    )


_positions("order_web_records", "kr, er, qr DESC, lr DESC, cr, nm, image, r, c, id", ["kr", "er", "-qr", "-lr", "cr", "nm", "image", "r", "c", "id"], _ranks, _RANKED)
_positions("order_game_page", "er, qr DESC, lr DESC, cr, nm, id", ["er", "-qr", "-lr", "cr", "nm", "id"], _ranks, _RANKED)
_positions("order_unique_records", "kr, lr DESC, nm, id", ["kr", "-lr", "nm", "id"], _ranks, _RANKED)
_positions("order_view_name", "nm, lr DESC, id", ["nm", "-lr", "id"], _ranks, _RANKED)
_positions("order_view_level", "lr DESC, nm, id", ["-lr", "nm", "id"], _ranks, _RANKED)
_positions("order_summary", "kr, cr, nm, lr DESC, qr, id", ["kr", "cr", "nm", "-lr", "qr", "id"], _ranks, _RANKED)

_TIERS = f"{OCC}, x AS (SELECT occ_id AS id, CASE WHEN manual THEN 3 WHEN duplicate THEN 2 WHEN conf < 60 THEN 1 ELSE 4 END AS tier, CASE WHEN name IS NULL THEN 0 WHEN level IS NULL THEN 1 ELSE 2 END AS second, image, r, c FROM occ)"


def _tiers(spark, d):
    tier = F.when(F.col("manual"), 3).when(F.col("duplicate"), 2).when(F.col("conf") < 60, 1).otherwise(4)
    second = F.when(F.col("name").isNull(), 0).when(F.col("level").isNull(), 1).otherwise(2)
    return A.occurrences(spark, d).select(F.col("occ_id").alias("id"), tier.alias("tier"), second.alias("second"), "image", "r", "c")


_positions("order_candidates", "tier, second, image, r, c, id", ["tier", "second", "image", "r", "c", "id"], _tiers, _TIERS)

_IMPORT = f"{IMAGES}, x AS (SELECT image AS id, CASE WHEN first % 7 = 0 THEN 0 WHEN first % 7 = 1 THEN 1 WHEN coalesce(pool, 'unknown') = 'unknown' THEN 2 ELSE 3 END AS priority, first FROM images)"


def _import(spark, d):
    f = F.col("first")
    p = F.when(f % 7 == 0, 0).when(f % 7 == 1, 1).when(F.coalesce("pool", F.lit("unknown")) == "unknown", 2).otherwise(3)
    return _images(spark, d).select(F.col("image").alias("id"), p.alias("priority"), "first")


_positions("order_import", "priority, first", ["priority", "first"], _import, _IMPORT)

_REASONS = f"{OCC}, x AS (SELECT occ_id AS id, CASE WHEN occ_id % 3 = 0 THEN 'batch' WHEN occ_id % 3 = 1 THEN 'image' ELSE 'occurrence' END AS scope, action AS code, image FROM occ)"


def _reasons(spark, d):
    o = F.col("occ_id")
    return A.occurrences(spark, d).select(o.alias("id"), F.when(o % 3 == 0, "batch").when(o % 3 == 1, "image").otherwise("occurrence").alias("scope"), F.col("action").alias("code"), "image")


_positions("order_reasons", "scope, code, image, id", ["scope", "code", "image", "id"], _reasons, _REASONS)
