"""Queries over boxes: grids of images, one box per event, and boxes of all radii."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import geometry, grid
from tallyforge.plans.registry import query
from tallyforge.sources.tables import Scratch, load

PROFILE, GAPS = [0.15, 0.38, 0.62, 0.85], (0.05, 0.16)
EVENT_BOX = """box AS (SELECT user_id AS image, event_id AS id, CAST(event_id % 4 * 110 + 72 + event_id % 13 - 6 AS INT) AS x,
 CAST(event_id // 4 % 12 * 80 + 40 + event_id % 11 - 5 + CASE WHEN event_id % 17 = 0 THEN 37 ELSE 0 END AS INT) AS y, CAST(20 + event_id % 5 + CASE WHEN event_id % 7 = 0 THEN CAST(floor(value) AS BIGINT) % 90 ELSE 0 END AS INT) AS rad FROM events)"""


def event_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box per event on the image of its user: four columns, twelve rows, ornaments beside the rows, and rings of other sizes."""
    e = F.col("event_id")
    row = F.floor(e / 4) % 12 * 80 + 40 + e % 11 - 5 + F.when(e % 17 == 0, 37).otherwise(0)
    rad = 20 + e % 5 + F.when(e % 7 == 0, F.floor("value") % 90).otherwise(0)
    return load(spark, d, "events").select(F.col("user_id").alias("image"), e.alias("id"), (e % 4 * 110 + 72 + e % 13 - 6).cast("int").alias("x"), row.cast("int").alias("y"), rad.cast("int").alias("rad"))


@query()
def grid_rows(spark, d):
    return grid.grid_rows(event_boxes(spark, d)).select("image", "row_no", F.explode("members.id").alias("id"))


@query(f"""WITH {EVENT_BOX}, n AS (SELECT a.image, a.rad AS seed, count(*) AS n, median(b.rad) AS centre FROM (SELECT DISTINCT image, rad FROM box) a JOIN box b ON a.image = b.image AND abs(b.rad - a.rad) <= greatest(3, CAST(a.rad AS DOUBLE) * CAST(0.09 AS DOUBLE)) GROUP BY 1, 2),
 m AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC, centre, seed) = 1)
 SELECT image, id, rad FROM box JOIN m USING (image) WHERE n >= 2 AND abs(rad - centre) <= greatest(3, centre * CAST(0.1 AS DOUBLE))""")
def main_radius(spark, d):
    return grid.main_radius(event_boxes(spark, d)).select("image", "id", "rad")


@query()
def lattice_rows(spark, d):
    lo, hi = GAPS
    with Scratch(spark, "boxes") as tmp:
        boxes = tmp.written(grid.main_radius(event_boxes(spark, d)), "boxes")
        views = boxes.select("image").distinct().select("image", F.lit(0).alias("vx"), F.lit(480).alias("vw"), F.lit(1000).alias("vh"), F.array(*map(F.lit, PROFILE)).alias("profile"), F.lit(lo).alias("gap_lo"), F.lit(hi).alias("gap_hi"))
        return grid.lattice(boxes, views)


WIDE = "box AS (SELECT o_custkey AS image, o_orderkey AS id, CAST(o_orderkey * 7919 % 40000 AS INT) AS x, CAST(o_orderkey * 104729 % 40000 AS INT) AS y, CAST(1 + floor(o_totalprice) % 10000 AS INT) AS rad FROM orders)"


def _wide(spark, d):
    o = F.col("o_orderkey")
    return load(spark, d, "orders").select(F.col("o_custkey").alias("image"), o.alias("id"), (o * 7919 % 40000).cast("int").alias("x"), (o * 104729 % 40000).cast("int").alias("y"), (1 + F.floor("o_totalprice") % 10000).cast("int").alias("rad"))


@query(f"""WITH {WIDE}, p AS (SELECT a.image, a.id AS a, b.id AS b, CAST(greatest(0, least(a.x + a.rad, b.x + b.rad) - greatest(a.x - a.rad, b.x - b.rad)) AS BIGINT) * greatest(0, least(a.y + a.rad, b.y + b.rad) - greatest(a.y - a.rad, b.y - b.rad)) AS inter, 4 * CAST(a.rad AS BIGINT) * a.rad + 4 * CAST(b.rad AS BIGINT) * b.rad AS areas FROM box a JOIN box b ON a.image = b.image AND a.id < b.id)
 SELECT image, a, b, CAST(10000 * inter // (areas - inter) AS BIGINT) AS iou FROM p WHERE inter > 0""")
def box_iou_any_radius(spark, d):
    return geometry.overlaps(_wide(spark, d))


@query("""WITH b AS (SELECT event_id AS id, CAST(event_id % 97 * 5 AS INT) AS x, CAST(event_id // 97 % 89 * 11 AS INT) AS y, CAST(5 + floor(value) % 60 AS INT) AS r FROM events),
 p AS (SELECT *, least(x - r, CAST(trunc(x - r * 0.92::DOUBLE) AS BIGINT), CAST(trunc(x + r * 0.02::DOUBLE) AS BIGINT)) AS l, least(y - r, CAST(trunc(y + r * 1.08::DOUBLE) AS BIGINT), CAST(trunc(y - r * 1.06::DOUBLE) AS BIGINT)) AS t,
  greatest(x + r, CAST(trunc(x - r * 0.92::DOUBLE) AS BIGINT) + CAST(trunc(r * 1.84::DOUBLE) AS BIGINT), CAST(trunc(x + r * 0.02::DOUBLE) AS BIGINT) + CAST(trunc(r * 1.08::DOUBLE) AS BIGINT)) AS rt,
  greatest(y + r, CAST(trunc(y + r * 1.08::DOUBLE) AS BIGINT) + greatest(12, CAST(trunc(r * 0.62::DOUBLE) AS BIGINT)), CAST(trunc(y - r * 1.06::DOUBLE) AS BIGINT) + greatest(12, CAST(trunc(r * 0.58::DOUBLE) AS BIGINT))) AS bt FROM b)
 SELECT id, CASE WHEN l < 10 OR rt > 470 THEN 'invalid' WHEN t < 60 THEN 'partial_top' WHEN bt > 900 THEN 'partial_bottom' ELSE 'complete' END AS completeness FROM p""")
def card_completeness(spark, d):
    e = F.col("event_id")
    b = load(spark, d, "events").select(e.alias("id"), (e % 97 * 5).cast("int").alias("x"), (F.floor(e / 97) % 89 * 11).cast("int").alias("y"), (5 + F.floor("value") % 60).cast("int").alias("rad"))
    return b.select("id", geometry.completeness(F.col("x"), F.col("y"), F.col("rad"), *[F.lit(v) for v in (10, 60, 470, 900)]).alias("completeness"))
