"""Inventory: search, order, grouping, expansion, retention."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.parse import uuid5_hash, uuid5_text
from tallyforge.sources.tables import written

#: Named orders; idx is the catalog position.
ORDERS = {
    "default": ["kind", "-level", "idx", "name", "quality"],
    "catalog_first": ["kind", "idx", "name", "-level", "quality"],
    "snapshot": ["kind", "idx", "-level", "quality"],
}
STABLE = ["source_order", "row_index", "column_index", "instance_id"]
#: Units of an item that stay together, and units of a task.
RUN, TASK = 1024, 1 << 18


def terms(text: str, aliases: dict[str, str] | None = None) -> list[str]:
    found = [x for x in re.split(r"[\s,，、;；]+", text) if x]
    return list(dict.fromkeys((aliases or {}).get(x, x) for x in found))


def search(items: DataFrame, text: str, kind: str | None = None, aliases: dict[str, str] | None = None, display: bool = False) -> DataFrame:
    """Rows whose name (or display name) contains one of the terms; no terms means no predicate."""
    keep: Column = F.lit(True) if kind is None else F.col("kind") == kind
    shown = F.concat("name", F.lit("("), F.col("quality").cast("string"), F.lit(")"))
    hits = [F.contains("name", F.lit(t)) | (F.contains(shown, F.lit(t)) if display else F.lit(False)) for t in terms(text, aliases)]
    if hits:
        any_hit = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        keep = keep & any_hit
    return items.where(keep)


def catalog(items: DataFrame) -> DataFrame:
    """Distinct names with their position (from 0), numbered by range blocks, so names may be as many as items."""
    return numbered(items.select("name").distinct(), [F.asc("name")], "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))


def numbered(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in the order of keys, without one global sort task.

    The rows of each range block are counted, then numbered within the block. The blocks are written first, as both uses must see the same bounds.
    """
    block = written(rows.repartitionByRange(*keys).withColumn("_block", F.spark_partition_id()), "range-blocks")
    sums = block.groupBy("_block").agg(F.count("*").alias("_n"))
    # one row per block
    before = sums.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(*keys))
    return block.withColumn("_own", own).join(F.broadcast(before), "_block").withColumn(name, F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")


def ordered(rows: DataFrame, keys: list[str]) -> list[Column]:
    return [F.desc(k[1:]) if k[0] == "-" else F.asc(k) for k in keys]


def ranked(items: DataFrame, order: str) -> DataFrame:
    """instance_id and its position in a named order."""
    x = items.join(catalog(items), "name")
    return numbered(x, ordered(x, ORDERS[order] + STABLE), "pos").select("instance_id", "pos")


def summary(items: DataFrame, shown: Column) -> DataFrame:
    s = F.count(F.when(shown, 1))
    return items.groupBy("kind", "name").agg(F.count("*").alias("total"), s.alias("shown")).where("shown > 0")


def group_counts(items: DataFrame) -> DataFrame:
    """The size of a (kind, level, name, quality) group on the first row of its run, else NULL."""
    g = ["kind", "level", "name", "quality"]
    first = items.groupBy(*g).agg(F.min("instance_id").alias("instance_id"), F.count("*").alias("group_count"))
    return items.select("instance_id").join(first.select("instance_id", "group_count"), "instance_id", "left")


def expand(items: DataFrame) -> DataFrame:
    return items.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "quantity")).alias("copy_index")).where("quantity >= 1").drop("quantity")


def merge_identical(items: DataFrame) -> DataFrame:
    return items.groupBy("kind", "name", "quality", "level").agg(F.min("instance_id").alias("instance_id"), F.sum("quantity").alias("quantity"))


def newest(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def instances(items: DataFrame) -> DataFrame:
    """One row per unit: the first keeps the id, the others get the version 5 id of "id:index".

    Units are dealt in runs of RUN, so a small table of items, or one item of a large quantity, is many tasks.
    """
    x = items.where("quantity >= 1").withColumn("quantity", F.col("quantity").cast("int"))
    runs = x.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("quantity") - 1) / RUN).cast("int"))).alias("_run"))
    units = items.where("quantity >= 1").agg(F.sum(F.col("quantity").cast("long"))).first()[0] or 0
    runs = runs.repartition(max(1, math.ceil(units / TASK)))
    first, last = F.col("_run") * RUN, F.least(F.col("quantity") - 1, F.col("_run") * RUN + (RUN - 1))
    each = runs.withColumn("copy", F.explode(F.sequence(first, last)))
    # a column of its own, as what stands in a condition is taken anew each time it is named
    each = each.withColumn("_hash", uuid5_hash(F.concat(F.col("id"), F.lit(":"), F.col("copy").cast("string"))))
    return each.withColumn("id", F.when(F.col("copy") == 0, F.col("id")).otherwise(uuid5_text(F.col("_hash")))).drop("quantity", "_run", "_hash")


def search_whole(items: DataFrame, text: str, aliases: DataFrame, kind: str | None = None, quality: int | None = None) -> DataFrame:
    """Rows of a kind and quality that one of the terms fits: as a part of the name or display name, or by its canonical name.

    The terms are few and aliases (alias, name) is a dimension, so what is matched against the rows is a table of some terms.
    """
    found = terms(text)
    keep: Column = F.lit(True)
    if kind is not None:
        keep = keep & (F.col("kind") == kind)
    if quality is not None:
        keep = keep & (F.col("quality") == quality)
    rows = items.where(keep)
    if not found:
        return rows
    t = items.sparkSession.createDataFrame([(x,) for x in found], "term string").join(aliases.select(F.col("alias").alias("term"), F.col("name").alias("canon")), "term", "left")
    t = t.agg(F.collect_set(F.coalesce("canon", "term")).alias("_terms"))  # one row, of at most as many terms as were typed
    shown = F.concat("name", F.lit("("), F.col("quality").cast("string"), F.lit(")"))
    x = rows.join(F.broadcast(t), F.lit(True), "left")
    return x.where(F.exists("_terms", lambda w: F.contains(F.col("name"), w) | F.contains(shown, w) | (F.col("name") == w))).drop("_terms")


def filtered_group_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """With a filter on, groups are (kind, name): their size stands on the first row of each in the given order, else NULL."""
    w = Window.partitionBy("kind", "name")
    first = F.row_number().over(w.orderBy(*ordered(items, keys))) == 1
    return items.select("instance_id", F.when(first, F.count("*").over(w)).alias("group_count"))
