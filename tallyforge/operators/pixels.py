"""Statistics of pictures whose pixels are rows (image, b, g, r, h, s, v; 0 to 255, hues 0 to 179): aggregates alone, so a picture of any size is spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.parse import hue_distance

#: Fixed values of the two classifiers.
SATURATED, COLOURFUL, NEUTRAL_S, NEUTRAL_V = 48, 52, 45, 150
EQUIPPED_FROM, UNEQUIPPED_TO, RELIABLE = 4.05, 3.95, 0.72
WHITE, MOST_COLOUR, LEAST_COLOUR, SHARE, WITHIN = 0.56, 0.24, 0.16, 0.34, 19


def statistics(pixels: DataFrame, step: int = 32) -> DataFrame:
    """image, pixels, entropy (bits, of the colours in steps of `step`), saturated, colourful and neutral (shares of the pixels), hue (median of the colourful, or null)."""
    colour = [F.floor(F.col(c) / step).alias(c) for c in "bgr"]
    n = pixels.groupBy("image", *colour).agg(F.count("*").alias("n"))
    e = n.groupBy("image").agg(F.sum("n").alias("pixels"), F.sum(F.col("n") * F.log2("n")).alias("_s"))
    e = e.select("image", "pixels", (F.log2("pixels") - F.col("_s") / F.col("pixels")).alias("entropy"))
    mean = lambda c: F.avg(c.cast("double"))
    m = pixels.groupBy("image").agg(
        mean(F.col("s") >= SATURATED).alias("saturated"), mean(F.col("s") >= COLOURFUL).alias("colourful"), mean((F.col("s") <= NEUTRAL_S) & (F.col("v") >= NEUTRAL_V)).alias("neutral"),
        F.median(F.when(F.col("s") >= COLOURFUL, F.col("h"))).alias("hue"),
    )
    return e.join(m, "image")


def equipped(entropy: Column, saturated: Column, texture: Column) -> Column:
    """struct<state, confidence, reason>: many colours are a portrait, few an empty place; in between, or with little confidence, it's unknown."""
    yes = F.least(F.lit(0.94), 0.62 + (entropy - EQUIPPED_FROM) * 0.18 + F.least(texture, F.lit(80.0)) / 500)
    no = F.least(F.lit(0.92), 0.62 + (UNEQUIPPED_TO - entropy) * 0.12 + saturated * 0.08)
    made = lambda state, conf, why: F.struct(F.lit(state).alias("state"), conf.alias("confidence"), F.lit(why).cast("string").alias("reason"))
    low = F.when(no < RELIABLE, made("unknown", F.lit(0.45), "equipped_unequipped_low_confidence")).otherwise(made("unequipped", no, None))
    odd = F.when(entropy.isNull(), made("unknown", F.lit(0.0), "equipped_roi_missing")).otherwise(made("unknown", F.lit(0.45), "equipped_colour_entropy_conflict"))
    return F.when(entropy >= EQUIPPED_FROM, made("equipped", yes, None)).when(entropy <= UNEQUIPPED_TO, low).otherwise(odd)


def quality(colourful: Column, neutral: Column, hue: Column, hues: dict[str, int], white: str = "white") -> Column:
    """struct<quality, confidence, reason> by the share of neutral light pixels, else by the nearest hue (the first in order on ties), which must be near and have a share of its own."""
    near = F.array_min(F.array(*[F.struct(hue_distance(hue, F.lit(c)).cast("double").alias("d"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, c) in enumerate(hues.items())]))
    made = lambda q, conf, why: F.struct(q.cast("string").alias("quality"), conf.cast("double").alias("confidence"), F.lit(why).cast("string").alias("reason"))
    sure = F.least(F.lit(0.93), 0.40 + colourful * 0.38 + (WITHIN - near.d) / WITHIN * 0.25)
    none = F.lit(None)
    return (
        F.when(colourful.isNull(), made(none, F.lit(0.0), "quality_unknown")).when((neutral >= WHITE) & (colourful <= MOST_COLOUR), made(F.lit(white), F.least(F.lit(0.92), 0.55 + neutral * 0.42), None))
        .when(colourful < LEAST_COLOUR, made(none, F.lit(0.0), "quality_low_saturation")).when((near.d > WITHIN) | (colourful < SHARE), made(none, F.lit(0.0), "quality_visual_conflict")).otherwise(made(near.n, sure, None))
    )
