"""Connected components and survivors by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.tables import Scratch, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component), component the smallest node reachable.

    Each round takes the least label of all neighbours (a partial aggregate, so a hub costs
    one row per task) and then follows labels once; the labels of each round are a written table, of which
    only the last two are on disk at a time. Null ends are ignored.
    """
    with Scratch(edges.sparkSession, "components") as tmp:
        e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
        both = tmp.written(e.union(e.select(F.col("b"), F.col("a"))).distinct(), "edges")
        last = labels = tmp.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
        while True:
            near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            step = tmp.written(labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label"), "step")
            # a label that many nodes share is looked up once and joined back by rows of one per label
            used = step.select("next").distinct()
            up = used.join(step.select(F.col("node").alias("next"), F.col("next").alias("jump")), "next").where("jump < next")
            new = tmp.written(step.join(up, "next", "left").select("node", F.coalesce("jump", "next").alias("label"), F.col("label").alias("old")), "labels")
            done = new.where("label <> old").limit(1).count() == 0
            tmp.drop(last, step)
            if done:
                return written(new.select("node", F.col("label").alias("component")), "components")
            last, labels = new, new.select("node", "label")


def exact_duplicates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key and the least key of its group of equal contents (by SHA-256)."""
    h = rows.select(key, F.sha2(F.col(content), 256).alias("_h"))
    first = h.groupBy("_h").agg(F.min(key).alias("representative"))
    return h.join(first, "_h").select(key, "representative")


def survivors(members: DataFrame) -> DataFrame:
    """Per component (node, component, conf, manual): the survivor by each rule, and whether several manual nodes veto a merge."""
    best = lambda *c: F.max_by("node", F.struct(*c))
    return members.groupBy("component").agg(
        best("conf", (-F.col("node")).alias("o")).alias("by_confidence"), F.min("node").alias("by_position"), best("manual", "conf", "node").alias("by_manual"),
        (F.count(F.when(F.col("manual"), 1)) > 1).alias("vetoed"),
    )


def manual_veto(members: DataFrame) -> DataFrame:
    """(node, component, manual, value) -> group, the least node of the component, and flagged.

    A component whose manual values are several distinct ones isn't merged: each of its members stands alone and is flagged.
    """
    g = members.groupBy("component").agg(F.count_distinct(F.when(F.col("manual"), F.col("value"))).alias("_k"), F.min("node").alias("_first"))
    x = members.join(g, "component").withColumn("flagged", F.col("_k") > 1)
    return x.select("node", F.when(F.col("flagged"), F.col("node")).otherwise(F.col("_first")).alias("group"), "flagged")
