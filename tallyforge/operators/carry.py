"""What a new reading takes over from the old one: ids, manual values, resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(kind: str, key: Column) -> Column:
    """A new id that a retried task gives again."""
    return F.concat(F.lit("new-"), F.sha2(F.concat(F.lit(f"{kind}:"), key.cast("string")), 256))


def ids(new: DataFrame, old: DataFrame) -> DataFrame:
    """(occ) with the instance of the same occurrence before, or a fresh one."""
    return new.join(old, "occ", "left").select("occ", F.coalesce("instance", fresh("instance", F.col("occ"))).alias("instance"))


def manual_fields(new: DataFrame, old: DataFrame, fields: list[str], key: str = "occ") -> DataFrame:
    """Values set by hand before replace what was read anew."""
    o = old.select(key, "manual", *[F.col(f).alias(f"_{f}") for f in fields])
    x = new.drop("manual").join(o, key, "left").withColumn("manual", F.coalesce("manual", F.lit(False)))
    return x.select(key, *[F.when(F.col("manual"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields], "manual")


def allocate(components: DataFrame, old: DataFrame) -> DataFrame:
    """(component, members, primary) and (instance, members, owner) -> the instance of each component, one-to-one.

    First the least instance of just the same members; of the rest, an instance whose owner is the primary, then the least whose owner is
    any member; else a fresh one. An owner belongs to one component, so no instance is given twice.
    """
    same = components.select("component", "members").join(old.select("instance", "members"), "members").groupBy("component").agg(F.min("instance").alias("first"))
    left = components.join(same, "component", "left_anti").select("component", "primary", F.explode("members").alias("owner"))
    rest = old.join(same.select(F.col("first").alias("instance")), "instance", "left_anti")
    owned = left.join(rest.select("instance", "owner"), "owner").groupBy("component").agg(F.min_by("instance", F.struct((F.col("owner") != F.col("primary")).alias("o"), "instance")).alias("second"))
    x = components.select("component").join(same, "component", "left").join(owned, "component", "left")
    return x.select("component", F.coalesce("first", "second", fresh("component", F.col("component"))).alias("instance"))


def without_tombstones(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no later edit has invalidated."""
    return rows.join(tombstones, keys, "left_anti")


def row_id(pool: Column, before: Column, before_row: Column, after: Column, after_row: Column) -> Column:
    """pool:image:row->image:row, the same in every run."""
    return F.concat(pool, F.lit(":"), before, F.lit(":"), before_row.cast("string"), F.lit("->"), after, F.lit(":"), after_row.cast("string"))


def with_prior(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """Rows with what the user said of the same row id before, else pending."""
    return rows.join(prior, "row_id", "left").withColumn("resolution", F.coalesce("resolution", F.lit("pending")))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event per key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
