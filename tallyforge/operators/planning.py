"""Cost-to-target planning: exact integers, unknown stock stays unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.parse import round_up

#: (start, end, first cost, step per level): the synthetic rule set.
RULES = [(1, 30, 100, 100), (31, 60, 4000, 0)]


def expand_rules(rules: DataFrame, last: int = 60) -> DataFrame:
    """(start_level, end_level, first_exp, step) -> (level, exp); raises on overlaps and gaps."""
    out = rules.select("start_level", "first_exp", "step", F.explode(F.sequence("start_level", "end_level")).alias("level"))
    out = out.groupBy("level").agg(F.count("*").alias("n"), F.max(F.col("first_exp") + F.col("step") * (F.col("level") - F.col("start_level"))).cast("long").alias("exp"))
    every = rules.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("level")).join(out, "level", "left")
    fault = F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("no rule for level "), "level"))).when(F.col("n") > 1, F.raise_error(F.concat(F.lit("rules overlap at level "), "level")))
    return every.select("level", F.coalesce(fault.cast("long"), "exp").alias("exp"))


def level_cost(spark: SparkSession) -> DataFrame:
    return expand_rules(spark.createDataFrame(RULES, "start_level int, end_level int, first_exp int, step int"))


def overlay(items: DataFrame, targets: DataFrame) -> DataFrame:
    """items with goal, the target where there is one and it isn't below the level."""
    return items.join(targets, "instance_id", "left").withColumn("goal", F.greatest("level", F.coalesce("target", "level")))


def requirement(items: DataFrame, targets: DataFrame, costs: DataFrame, granule: int = 100) -> DataFrame:
    """Adds raw and rounded cost per instance; rounding is before any sum. Levels outside the table are left out."""
    # costs has a row per level (60), so the single-partition window and the broadcast have a fixed bound
    cum = costs.select("level", F.coalesce(F.sum("exp").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cost"))
    p = overlay(items, targets)
    p = p.join(F.broadcast(cum.withColumnRenamed("cost", "c0")), "level")
    p = p.join(F.broadcast(cum.select(F.col("level").alias("goal"), F.col("cost").alias("c1"))), "goal")
    return p.withColumn("raw", F.col("c1") - F.col("c0")).withColumn("rounded", round_up(F.col("raw"), granule)).drop("c0", "c1")


def gap(required: DataFrame, stock: DataFrame, orange: int, purple: int, white: int, run_yield: int) -> DataFrame:
    """One-row required x a few stock rows: owned, gap and runs, NULL if any stock is unknown."""
    owned = (F.col("orange") * orange + F.col("purple") * purple + F.col("white") * white).cast("long")
    out = stock.select("stock", owned.alias("owned")).join(F.broadcast(required), F.lit(True), "left")
    g = F.when(F.col("owned").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("required") - F.col("owned")))
    return out.select("stock", "required", "owned", g.alias("gap"), F.floor((g + (run_yield - 1)) / run_yield).alias("runs"))


def mismatches(costs: DataFrame, detail: DataFrame) -> DataFrame:
    """Levels whose cached detail differs from the cost table."""
    x = costs.join(detail.select("level", F.col("exp").alias("_d")), "level")
    return x.where("exp <> _d").select("level", "exp", F.lit(True).alias("differs"))


def repair(targets: DataFrame, items: DataFrame, most: int = 60) -> DataFrame:
    """Targets of items that are there, from 1 to `most`, and not below the level."""
    x = targets.where(F.col("target").between(1, most)).join(items.select("instance_id", "level"), "instance_id")
    return x.select("instance_id", F.greatest("target", "level").cast("int").alias("target"))


def stage_runs(gaps: DataFrame, run_yield: int, cost: int) -> DataFrame:
    """Runs that close a gap, and the stamina they take; unknown gaps stay unknown."""
    runs = F.expr(f"(gap + {run_yield - 1}) div {run_yield}")
    return gaps.withColumn("runs", runs).withColumn("stamina", (F.col("runs") * cost).cast("long"))


def scope(items: DataFrame, selected: Column, shown: Column) -> DataFrame:
    """The selected rows if there are any, else the shown ones, else all."""
    n = items.agg(F.count(F.when(selected, 1)).alias("_s"), F.count(F.when(shown, 1)).alias("_f"))
    x = items.join(F.broadcast(n), F.lit(True), "left")  # one row
    return x.where(F.when(F.col("_s") > 0, selected).when(F.col("_f") > 0, shown).otherwise(True)).drop("_s", "_f")


def summary(items: DataFrame, targets: DataFrame, costs: DataFrame, stock: DataFrame, white: int, purple: int, orange: int, run_yield: int, run_cost: int, with_orange: bool = True) -> DataFrame:
    """One row: plans that upgrade, plans that can't be (levels outside the table), what they need, split, owned, gap, runs and stamina, runs for all of it.

    stock is one row (orange, purple, white); an unknown number makes owned, gap, runs and stamina unknown, not the need.
    """
    c = requirement(items, targets, costs)
    need = c.agg(F.count(F.when(F.col("raw") > 0, 1)).alias("upgrading"), F.coalesce(F.sum("rounded"), F.lit(0).cast("long")).alias("required"))
    bad = overlay(items, targets).join(F.broadcast(costs.select(F.col("level").alias("goal"))), "goal", "left_anti").agg(F.count("*").alias("skipped"))
    owned = F.col("purple") * purple + F.col("white") * white + (F.col("orange") * orange if with_orange else F.lit(0))
    # three tables of one row
    x = need.join(F.broadcast(bad), F.lit(True)).join(F.broadcast(stock.select(owned.cast("long").alias("owned"))), F.lit(True))
    x = x.withColumn("gap", F.when(F.col("owned").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("required") - F.col("owned"))))
    runs = lambda f: F.expr(f"({f} + {run_yield - 1}) div {run_yield}")
    x = x.withColumn("runs", runs("gap")).withColumn("all_runs", runs("required")).withColumn("stamina", (F.col("runs") * run_cost).cast("long"))
    return x.withColumn("purple", F.expr(f"required div {purple}")).withColumn("white", F.expr(f"required % {purple} div {white}"))
