"""Reconciliation: totals, gates, statuses, rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(items: DataFrame, expected: DataFrame) -> DataFrame:
    """Actual against each expected total (a few rows)."""
    a = items.where("kind in ('main', 'support')").agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("actual"))
    e, n = F.col("expected"), F.col("actual")
    status = F.when(e.isNull(), "not_provided").when(n == e, "matched").when(n < e, "possibly_incomplete").otherwise("possibly_duplicated")
    return expected.join(F.broadcast(a), F.lit(True), "left").select("expected", "actual", status.alias("status"))


def stale_gate(rows: DataFrame, task: Column, account: Column, revision: Column) -> DataFrame:
    return rows.withColumn("gate", F.when(task, "task").when(account, "account").when(revision, "revision").otherwise("current"))


def batch_status(rows: DataFrame, key: str, cancelled: Column, failed: Column) -> DataFrame:
    f = F.count(F.when(failed, 1))
    s = F.when(F.count(F.when(cancelled, 1)) > 0, "cancelled").when((f == F.count("*")) & (f > 0), "failed").when(f > 0, "partial").otherwise("completed")
    return rows.groupBy(key).agg(s.alias("status"))


def review_counts(rows: DataFrame, key: str, excluded: Column, duplicate: Column, pending: Column) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(key).agg(F.count("*").alias("detected"), n(excluded).alias("excluded"), n(duplicate).alias("duplicate"), n(pending).alias("pending"), F.max(F.when(pending, 0).otherwise(1)).alias("any_resolved"))


def rebuild(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows without evidence are kept as manual; the others are rebuilt from it."""
    manual = items.join(evidence, "instance_id", "left_anti").select("instance_id", "level", F.lit(True).alias("manual"))
    built = items.select("instance_id").join(evidence, "instance_id").select("instance_id", F.col("target").alias("level"), F.lit(False).alias("manual"))
    return manual.unionByName(built)


def override(rows: DataFrame, hand: DataFrame, key: str, field: str) -> DataFrame:
    """Rows with what was set by hand (key, value as text): "unknown" clears the field, NULL leaves it."""
    x = rows.join(hand.select(key, F.col("value").alias("_v")), key, "left")
    kind = dict(rows.dtypes)[field]
    value = F.when(F.col("_v") == "unknown", F.lit(None)).when(F.col("_v").isNotNull(), F.col("_v").try_cast(kind)).otherwise(F.col(field))
    return x.withColumn(field, value).withColumn("manual", F.coalesce(F.col("_v").isNotNull() & (F.col("_v") != "unknown"), F.lit(False))).drop("_v")


def manual_kept(rows: DataFrame, detected: DataFrame) -> DataFrame:
    """Rows without an occurrence, and those whose occurrence isn't detected (a null is never detected)."""
    return rows.join(detected.select("occ").distinct(), "occ", "left_anti")
