"""Queries over pixels and page overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import parse
from tallyforge.operators import pixels
from tallyforge.plans.registry import query
from tallyforge.sources.tables import load

#: A line item is a pixel of its part's picture.
PIX = """px AS (SELECT l_partkey AS image, l_orderkey * 7 % 256 AS b, l_suppkey * 31 % 256 AS g, l_linenumber * 40 % 256 AS r, CASE WHEN l_partkey % 4 = 0 THEN l_orderkey % 180 ELSE 140 + l_orderkey % 9 END AS h, CASE WHEN l_partkey % 3 = 0 THEN l_orderkey % 60 ELSE 40 + l_orderkey % 90 END AS s, 120 + l_orderkey % 130 AS v FROM lineitem),
 e AS (SELECT image, sum(n) AS pixels, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT image, count(*) AS n, sum(count(*)) OVER (PARTITION BY image) AS t FROM px GROUP BY image, b // 32, g // 32, r // 32) GROUP BY 1),
 st AS (SELECT image, CAST(pixels AS BIGINT) AS pixels, entropy, saturated, colourful, neutral, hue FROM e JOIN (SELECT image, avg((s >= 48)::INT) AS saturated, avg((s >= 52)::INT) AS colourful, avg((s <= 45 AND v >= 150)::INT) AS neutral, median(CASE WHEN s >= 52 THEN h END) AS hue FROM px GROUP BY 1) USING (image))"""


def _pixels(spark, d):
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    return load(spark, d, "lineitem").select(
        p.alias("image"), (o * 7 % 256).alias("b"), (F.col("l_suppkey") * 31 % 256).alias("g"), (F.col("l_linenumber") * 40 % 256).alias("r"), F.when(p % 4 == 0, o % 180).otherwise(140 + o % 9).alias("h"),
        F.when(p % 3 == 0, o % 60).otherwise(40 + o % 90).alias("s"), (120 + o % 130).alias("v"),
    )


@query(f"WITH {PIX} SELECT image, pixels, round(entropy, 6) + 0.0 AS entropy, round(saturated, 6) AS saturated, round(colourful, 6) AS colourful, round(neutral, 6) AS neutral, hue FROM st")
def colour_statistics(spark, d):
    s = pixels.statistics(_pixels(spark, d))
    return s.select("image", "pixels", (F.round("entropy", 6) + 0.0).alias("entropy"), *[F.round(c, 6).alias(c) for c in ("saturated", "colourful", "neutral")], "hue")


_HUES = {"orange": 15, "purple": 140, "blue": 110, "green": 60}
_FAR = ", ".join(f"{{'d': least(abs(hue - {h}), 180 - abs(hue - {h})), 'k': {k}, 'n': '{n}'}}" for k, (n, h) in enumerate(_HUES.items()))


@query(f"""WITH {PIX}, q AS (SELECT *, list_min([{_FAR}]) AS near FROM st), c AS (SELECT image, CASE WHEN neutral >= 0.56 AND colourful <= 0.24 THEN 'w' WHEN colourful < 0.16 THEN 'l' WHEN near.d > 19 OR colourful < 0.34 THEN 'c' ELSE 'q' END AS t, neutral, colourful, near FROM q)
 SELECT image, CASE t WHEN 'w' THEN 'white' WHEN 'q' THEN near.n END AS quality, round(CASE t WHEN 'w' THEN least(0.92, 0.55 + neutral * 0.42) WHEN 'q' THEN least(0.93, 0.40 + colourful * 0.38 + (19 - near.d) / 19 * 0.25) ELSE 0 END, 6) AS confidence, CASE t WHEN 'l' THEN 'quality_low_saturation' WHEN 'c' THEN 'quality_visual_conflict' END AS reason FROM c""")
def pixel_quality(spark, d):
    s = pixels.statistics(_pixels(spark, d))
    q = pixels.quality(F.col("colourful"), F.col("neutral"), F.col("hue"), _HUES)
    return s.select("image", q.alias("q")).select("image", "q.quality", F.round("q.confidence", 6).alias("confidence"), "q.reason")


@query(f"""WITH {PIX}, t AS (SELECT *, image % 90 AS texture, CASE WHEN entropy >= 4.05 THEN 'e' WHEN entropy > 3.95 THEN 'x' WHEN least(0.92, 0.62 + (3.95 - entropy) * 0.12 + saturated * 0.08) < 0.72 THEN 'l' ELSE 'u' END AS k FROM (SELECT * REPLACE (round(entropy, 6) AS entropy, round(saturated, 6) AS saturated) FROM st))
 SELECT image, CASE k WHEN 'e' THEN 'equipped' WHEN 'u' THEN 'unequipped' ELSE 'unknown' END AS state, round(CASE k WHEN 'e' THEN least(0.94, 0.62 + (entropy - 4.05) * 0.18 + least(texture, 80) / 500) WHEN 'u' THEN least(0.92, 0.62 + (3.95 - entropy) * 0.12 + saturated * 0.08) ELSE 0.45 END, 5) AS confidence,
 CASE k WHEN 'x' THEN 'equipped_colour_entropy_conflict' WHEN 'l' THEN 'equipped_unequipped_low_confidence' END AS reason FROM t""")
def pixel_equipped(spark, d):
    s = pixels.statistics(_pixels(spark, d)).withColumns({"entropy": F.round("entropy", 6), "saturated": F.round("saturated", 6)})
    e = pixels.equipped(F.col("entropy"), F.col("saturated"), (F.col("image") % 90).cast("double"))
    return s.select("image", e.alias("e")).select("image", "e.state", F.round("e.confidence", 5).alias("confidence"), "e.reason")


@query("""WITH x AS (SELECT p_partkey AS k, CASE WHEN contains(p_name, 'a') THEN 'main' WHEN contains(p_name, 'o') THEN 'support' ELSE 'unknown' END AS auto, CASE WHEN p_partkey % 2 = 0 THEN 0.75 ELSE 0.2 END AS conf, CASE WHEN p_partkey % 11 = 0 THEN 'w' END AS warning, p_partkey % 13 = 0 AS review,
  CASE p_partkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'support' END AS pool, CASE p_partkey % 3 WHEN 0 THEN 'experience' WHEN 1 THEN 'unknown' END AS expected FROM part)
 SELECT k AS p_partkey, CASE WHEN pool IS NOT NULL THEN pool WHEN auto = 'unknown' AND expected <> 'unknown' THEN expected ELSE auto END AS page,
  CASE WHEN pool IS NOT NULL THEN CASE WHEN auto NOT IN ('unknown', pool) THEN least(conf, 0.5) ELSE greatest(conf, 0.95) END WHEN auto = 'unknown' AND expected <> 'unknown' THEN 0.2 ELSE conf END::DOUBLE AS confidence,
  CASE WHEN pool IS NOT NULL THEN CASE WHEN auto NOT IN ('unknown', pool) THEN 'confirmed_pool_conflict' ELSE warning END WHEN auto = 'unknown' AND expected <> 'unknown' THEN 'expected_page_type_used' ELSE warning END AS warning,
  CASE WHEN pool IS NOT NULL THEN auto NOT IN ('unknown', pool) OR review WHEN auto = 'unknown' AND expected <> 'unknown' THEN TRUE ELSE review END AS review FROM x""")
def page_overrides(spark, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    auto = F.when(F.contains(n, F.lit("a")), "main").when(F.contains(n, F.lit("o")), "support").otherwise("unknown")
    x = parse.page_override(auto, F.when(k % 2 == 0, 0.75).otherwise(0.2), F.when(k % 11 == 0, "w"), k % 13 == 0, F.when(k % 5 == 0, "main").when(k % 5 == 1, "support"), F.when(k % 3 == 0, "experience").when(k % 3 == 1, "unknown"))
    return load(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.page", "x.confidence", "x.warning", "x.review")
