"""Loadouts: slots of an operator that refer to instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = ["main1", "main2", "main3", "support1", "support2", "support3"]


def occupancy(loadouts: DataFrame) -> DataFrame:
    """(operator, slot, instance) of every filled slot."""
    return loadouts.unpivot("operator", SLOTS, "slot", "instance").where("instance is not null")


def faults(loadouts: DataFrame, inventory: DataFrame) -> DataFrame:
    """(operator, slot, instance, fault): dangling references, instances of the wrong kind, and those that several slots hold."""
    held = occupancy(loadouts)
    twice = held.groupBy("instance").agg(F.count("*").alias("_n")).where("_n > 1")
    x = held.join(inventory.select("instance", "kind"), "instance", "left").join(twice, "instance", "left")
    fault = F.when(F.col("kind").isNull(), "dangling").when(~F.startswith(F.col("slot"), F.col("kind")), "wrong_kind").when(F.col("_n").isNotNull(), "equipped_twice")
    return x.select("operator", "slot", "instance", fault.alias("fault")).where("fault is not null")


def without_missing(loadouts: DataFrame, inventory: DataFrame) -> DataFrame:
    """Loadouts whose slots of vanished instances are empty."""
    held = occupancy(loadouts).join(inventory.select("instance"), "instance", "left_semi")
    kept = held.groupBy("operator").agg(*[F.max(F.when(F.col("slot") == s, F.col("instance"))).alias(s) for s in SLOTS])
    return loadouts.select("operator").join(kept, "operator", "left")


def suggest(requirements: DataFrame, inventory: DataFrame, loadouts: DataFrame) -> DataFrame:
    """(operator, ordinal, kind, name) -> the instance that each requirement of an operator would get, or why it gets none.

    What an operator wears already serves its first requirements of that kind and name, in the slot it is in. The others get, in their order, the free instances of
    their kind and name, by level, quality and id; those that another operator wears aren't free. A kind has three slots, of which those that what is kept
    stands in are taken; a requirement that finds nothing takes no slot, and one that comes when all are taken gets none. Each operator's suggestion stands for itself.
    """
    held = occupancy(loadouts)
    # an instance in several slots of an operator counts in its first
    worn = held.groupBy("operator", "instance").agg(F.min("slot").alias("slot")).join(inventory.select("instance", "kind", "name"), "instance")
    by = Window.partitionBy("operator", "kind", "name")
    need = requirements.select("operator", "ordinal", "kind", "name").withColumn("_n", F.row_number().over(by.orderBy("ordinal")))
    own = worn.withColumn("_n", F.row_number().over(by.orderBy("slot"))).select("operator", "kind", "name", "_n", F.col("instance").alias("_own"), F.col("slot").alias("_in"))
    need = need.join(own, ["operator", "kind", "name", "_n"], "left")
    for k in ("main", "support"):
        need = need.withColumn(f"_{k}", F.count(F.when(F.startswith("_in", F.lit(k)), 1)).over(Window.partitionBy("operator")))
    # what is left is numbered within its kind and name, as the free instances are
    open_ = F.col("_own").isNull()
    left = need.withColumn("_k", F.when(open_, F.row_number().over(by.orderBy(F.col("_own").isNotNull().cast("int"), "ordinal"))))
    taken = held.groupBy("instance").agg(F.min("operator").alias("_lo"), F.max("operator").alias("_hi"))
    free = inventory.join(taken, "instance", "left_anti")
    free = free.withColumn("_k", F.row_number().over(Window.partitionBy("kind", "name").orderBy(F.desc("level"), F.desc("quality"), "instance")))
    others = inventory.join(taken, "instance").groupBy("kind", "name").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    x = left.join(free.select("kind", "name", "_k", F.col("instance").alias("_free")), ["kind", "name", "_k"], "left").join(others, ["kind", "name"], "left")
    before = Window.partitionBy("operator", "kind").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(F.col("kind") == "main", F.col("_main")).otherwise(F.col("_support")) + F.count(F.when(open_ & F.col("_free").isNotNull(), 1)).over(before)
    full = open_ & (filled >= 3)
    got = F.coalesce("_own", F.when(~full, F.col("_free")))
    elsewhere = F.coalesce((F.col("_lo") != F.col("operator")) | (F.col("_hi") != F.col("operator")), F.lit(False))
    why = F.when(got.isNotNull(), F.lit(None)).when(full, "no_slot").when(elsewhere, "occupied").otherwise("missing")
    return x.select("operator", "ordinal", got.alias("instance"), why.alias("reason"))
