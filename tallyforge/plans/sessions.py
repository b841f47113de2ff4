"""Queries over sessions: undo and redo, and registries of accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import accounts, undo
from tallyforge.plans.registry import query
from tallyforge.sources.tables import load


def commands(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as commands: errors undo, signups redo, others change the session's value."""
    e = load(spark, d, "events")
    command = F.when(F.col("event_type") == "error", "undo").when(F.col("event_id") % 6 == 0, "redo").otherwise("change")
    return e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), command.alias("command"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("value"))


@query()
def undo_history(spark, d):
    return undo.history(commands(spark, d))


VERSIONS = ["one", "two"]


def account_commands(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as commands on a registry of at most 12 accounts, whose names and versions clash now and then."""
    e, v = load(spark, d, "events"), F.col("event_id")
    command = F.when(v % 9 < 3, "create").when(v % 9 < 5, "rename").when(v % 9 < 6, "metadata").when(v % 9 < 7, "activate").when(v % 9 < 8, "delete").otherwise(F.when(v % 2 == 0, "create").otherwise("other"))
    name = F.when(v % 17 == 0, "  ").when(v % 19 == 0, None).otherwise(F.concat(F.lit(" "), F.col("event_type"), (v % 4).cast("string")))
    version = F.when(v % 23 == 0, "three").when(v % 2 == 0, "one").otherwise("two")
    return e.select(F.col("user_id").cast("string").alias("registry"), v.alias("seq"), command.alias("command"), (F.floor(v / 9) % 12).cast("string").alias("account"), name.alias("name"), version.alias("version"))


@query()
def account_registry(spark, d):
    return accounts.registry_log(account_commands(spark, d), VERSIONS)
