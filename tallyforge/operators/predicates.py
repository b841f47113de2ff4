"""Predicates over observed cards, and the small views that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELIABLE = 65


def known() -> Column:
    """Name, level and quality are there; level 0 counts as missing."""
    return F.col("name").isNotNull() & (F.coalesce("level", F.lit(0)) != 0) & F.col("quality").isNotNull()


def reliable(low: int = RELIABLE) -> Column:
    return F.col("level").isNotNull() & F.col("quality").isNotNull() & (F.coalesce("conf", F.lit(0)) >= low)


def active() -> Column:
    """Evidence counts: whole, kept, and of a pool that holds items."""
    return F.col("complete") & (F.col("action") == "keep") & F.coalesce(F.col("pool").isin("main", "support"), F.lit(False))


def usable(occ: DataFrame) -> DataFrame:
    return occ.where(F.col("complete") & F.col("name").isNotNull() & F.col("level").isNotNull() & F.col("quality").isNotNull() & (F.col("action") == "keep") & ~F.col("duplicate"))


def problems(legal: int = 60) -> Column:
    """Codes of what is unresolved, in a fixed order."""
    bad = F.coalesce(~F.col("level").between(1, legal), F.lit(True))
    return F.array_compact(
        F.array(F.when(F.col("name").isNull(), "ordinary_name_unresolved"), F.when(bad, "ordinary_level_unresolved"), F.when(F.col("quality").isNull(), "ordinary_quality_unresolved"))
    )


def flags(occ: DataFrame) -> DataFrame:
    """occ with reliable, active, needs_review and codes."""
    review = (F.col("action") == "keep") & ~(F.col("complete") & known())
    return occ.select("*", reliable().alias("reliable"), active().alias("active"), review.alias("needs_review"), problems().alias("codes"))


def confirmable(images: DataFrame, key: str, processing: Column) -> DataFrame:
    """Per group of images: it has some, all pools are known and none is being processed."""
    unknown = F.coalesce(F.col("pool"), F.lit("unknown")) == "unknown"
    return images.groupBy(key).agg(((F.count("*") > 0) & ~F.bool_or(unknown) & ~F.bool_or(processing)).alias("confirmable"))


def unclassified(images: DataFrame, order: str) -> DataFrame:
    """Images without a pool with their place in the upload order, by counts of range blocks so that no task sorts them all."""
    from tallyforge.operators.inventory import numbered

    return numbered(images.where(F.coalesce(F.col("pool"), F.lit("unknown")) == "unknown"), [F.asc(order)], "queue")


def default_tier(candidates: DataFrame) -> DataFrame:
    """Of each image the candidates of its lowest tier."""
    low = candidates.groupBy("image").agg(F.min("tier").alias("low"))
    return candidates.join(low, "image").where("tier = low").drop("low")


def undo_stack(history: DataFrame, key: str, order: list[str], keep: int = 30) -> DataFrame:
    """The newest `keep` changes that no change of an older base has made stale; depth 1 is undone first."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return history.where("revision >= base").withColumn("depth", F.row_number().over(w)).where(F.col("depth") <= keep)


def with_stars(cards: DataFrame, stars: DataFrame) -> DataFrame:
    """Every card with its star; a card without one says so."""
    out = cards.join(stars.withColumn("_there", F.lit(True)), "card", "left")
    return out.withColumn("warning", F.when(F.col("_there").isNull(), "recognition_missing")).drop("_there")
