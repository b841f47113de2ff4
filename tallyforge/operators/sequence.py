"""Repairs of ordered sequences with neighbour windows (image, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _w():
    return Window.partitionBy("image").orderBy("pos")


def islands(seq: DataFrame) -> DataFrame:
    """Runs of equal keys; a NULL key stands alone."""
    brk = F.col("key").isNull() | ~F.lag("key").over(_w()).eqNullSafe(F.col("key")) | (F.row_number().over(_w()) == 1)
    return seq.withColumn("_b", brk.cast("long")).withColumn("island", F.sum("_b").over(_w())).drop("_b")


def sandwich(seq: DataFrame) -> DataFrame:
    """A NULL between two equal neighbours takes their key; filled values don't fill others."""
    before, after = F.lag("key").over(_w()), F.lead("key").over(_w())
    return seq.withColumn("key", F.when(F.col("key").isNull() & (before == after), before).otherwise(F.col("key")))


def order_conflicts(seq: DataFrame) -> DataFrame:
    """Levels fall along a sequence: a rise makes the later one unknown and flags it."""
    rise = F.coalesce(F.col("level") > F.lag("level").over(_w()), F.lit(False))
    return seq.withColumn("conflict", rise).withColumn("level", F.when(~F.col("conflict"), F.col("level")))


def _over():
    return Window.partitionBy("image").orderBy("r", "c")


def equipped_boundary(cards: DataFrame) -> DataFrame:
    """Whole cards in reading order with `boundary`: quality rises from the one before, or stays while the level rises."""
    q, l = F.lag("quality").over(_over()), F.lag("level").over(_over())
    rises = (q < F.col("quality")) | ((q == F.col("quality")) & (l < F.col("level")))
    return cards.where("complete").withColumn("boundary", F.coalesce(rises, F.lit(False)))


def equipped_reversal(cards: DataFrame) -> DataFrame:
    """Flags an equipped card right after an unequipped one."""
    before = F.lag("equipped").over(_over())
    return cards.where("complete").withColumn("reversal", F.coalesce((before == "unequipped") & (F.col("equipped") == "equipped"), F.lit(False)))


def card_islands(cards: DataFrame) -> DataFrame:
    """Runs of equal (equipped, quality) among whole cards; an unknown one stands alone."""
    uncertain = (F.col("equipped") == "unknown") | F.col("quality").isNull()
    same = F.lag("equipped").over(_over()).eqNullSafe(F.col("equipped")) & F.lag("quality").over(_over()).eqNullSafe(F.col("quality"))
    x = cards.where("complete").withColumn("_b", (uncertain | ~same | (F.row_number().over(_over()) == 1)).cast("long"))
    return x.withColumn("island", F.sum("_b").over(_over())).drop("_b")


def island_levels(cards: DataFrame) -> DataFrame:
    """Levels fall along an island (image, island, r, c, level, manual).

    A level above the one to its left is a conflict and becomes unknown; an unknown level between two equal neighbours is inferred;
    manual values stay, with a flag where they rise. Neighbours are compared as they were before any repair.
    """
    w = Window.partitionBy("image", "island").orderBy("r", "c")
    left, right = F.lag("level").over(w), F.lead("level").over(w)
    rise = F.coalesce(left < F.col("level"), F.lit(False))
    fill = F.coalesce(F.col("level").isNull() & ~F.col("manual") & (left == right), F.lit(False))
    state = F.when(F.col("manual") & rise, "manual_override").when(rise, "conflict").when(fill, "inferred").otherwise("kept")
    x = cards.withColumn("_left", left).withColumn("level_state", state)
    return x.withColumn("level", F.when(F.col("level_state") == "inferred", F.col("_left")).when(F.col("level_state") != "conflict", F.col("level"))).drop("_left")


def _adjacent_in_row(k: int):
    step = F.lag if k < 0 else F.lead
    return (step("r").over(_over()) == F.col("r")) & (step("c").over(_over()) == F.col("c") + k)


def name_sandwich(cards: DataFrame) -> DataFrame:
    """A nameless whole card between two neighbours in its row that share one direct name and all of equipped, quality and level with it takes the name."""
    same = F.lit(True)
    for f in ("equipped", "quality", "level"):
        same = same & (F.lag(f).over(_over()) == F.col(f)) & (F.lead(f).over(_over()) == F.col(f))
    before = F.lag("name").over(_over())
    fits = F.col("name").isNull() & (F.col("equipped") != "unknown") & same & _adjacent_in_row(-1) & _adjacent_in_row(1) & (before == F.lead("name").over(_over()))
    fits = F.coalesce(fits, F.lit(False))
    x = cards.where("complete").withColumn("inferred", fits).withColumn("_n", before)
    return x.withColumn("name", F.when(F.col("inferred"), F.col("_n")).otherwise(F.col("name"))).drop("_n")


def reading_sandwich(cards: DataFrame, width: int = 4, low: int = 72) -> DataFrame:
    """The earlier rule: neighbours in reading order, so the end of a row meets the start of the next; names of confidence `low` or more, equal levels."""
    at = F.col("r") * width + F.col("c")
    near = (F.lag(at).over(_over()) == at - 1) & (F.lead(at).over(_over()) == at + 1) & F.lag("complete").over(_over()) & F.lead("complete").over(_over()) & F.col("complete")
    before, after = F.lag("name").over(_over()), F.lead("name").over(_over())
    sure = (F.lag("conf").over(_over()) >= low) & (F.lead("conf").over(_over()) >= low)
    level = (F.lag("level").over(_over()) == F.col("level")) & (F.lead("level").over(_over()) == F.col("level"))
    fits = F.coalesce(F.col("name").isNull() & near & (before == after) & sure & level, F.lit(False))
    x = cards.withColumn("inferred", fits).withColumn("_n", before)
    return x.withColumn("name", F.when(F.col("inferred"), F.col("_n")).otherwise(F.col("name"))).drop("_n")


def level_intervals(cards: DataFrame, width: int = 4, most: int = 60) -> DataFrame:
    """The earlier one-pass rule: a level must lie between its right and left neighbours' in reading order, as they were observed.

    A level outside of it is filled if the interval is one value, else unknown and a conflict; a card beside a gap or a partial card is left alone.
    """
    at = F.col("r") * width + F.col("c")
    has_l, has_r = F.lag("r").over(_over()).isNotNull(), F.lead("r").over(_over()).isNotNull()
    ok_l = ~has_l | (F.lag("complete").over(_over()) & (F.lag(at).over(_over()) == at - 1))
    ok_r = ~has_r | (F.lead("complete").over(_over()) & (F.lead(at).over(_over()) == at + 1))
    upper, lower = F.coalesce(F.lag("level").over(_over()), F.lit(most)), F.coalesce(F.lead("level").over(_over()), F.lit(1))
    x = cards.withColumn("_t", F.col("complete") & ok_l & ok_r).withColumn("_u", upper).withColumn("_l", lower)
    fine = F.coalesce(F.col("level").between(F.col("_l"), F.col("_u")), F.lit(False))
    state = F.when(~F.col("_t"), "untouched").when(F.col("_u") < F.col("_l"), "conflict").when(fine, "kept").when(F.col("_u") == F.col("_l"), "inferred").otherwise("conflict")
    x = x.withColumn("level_state", state)
    return x.withColumn("level", F.when(F.col("level_state") == "inferred", F.col("_u")).when(F.col("level_state") != "conflict", F.col("level"))).drop("_t", "_u", "_l")


def row_gaps(rows: DataFrame) -> DataFrame:
    """(image, y) -> per image the median gap between neighbouring rows, doubled so that it stays an integer."""
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("image").orderBy("y"))
    return rows.withColumn("gap", gap).where("gap is not null").groupBy("image").agg((2 * F.median("gap")).cast("long").alias("gap2"), F.count("*").alias("n"))
