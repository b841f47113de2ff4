"""Catalog, aliases and rule sheets: dimensions of known size, and joins against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.inventory import numbered


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON catalog {"stars": [{"name", "kind", "aliases", ...}]} as rows with their place in it."""
    j = spark.read.schema("stars array<struct<name: string, kind: string, aliases: array<string>, usage_tags: array<string>, experience_per_item: int>>").json(path, multiLine=True)
    return j.select(F.posexplode("stars").alias("order_index", "s")).select("order_index", "s.*")


def aliases_of(entries: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(alias, name) of a catalog and of a further alias table; an alias of two names raises."""
    a = entries.select(F.explode("aliases").alias("alias"), "name")
    a = a.unionByName(more.select("alias", "name")) if more is not None else a
    g = alias_conflicts(a)
    fault = F.when(F.col("conflict"), F.raise_error(F.concat(F.lit("alias of several names: "), "alias")))
    return g.select("alias", F.coalesce(fault.cast("string"), F.col("name")).alias("name"))


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Each alias with its (least) name, and whether it has several."""
    return aliases.groupBy("alias").agg(F.min("name").alias("name"), (F.count_distinct("name") > 1).alias("conflict"))


def canonical(rows: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Names trimmed and replaced by what they are an alias of; unknown ones stay."""
    x = rows.withColumn(name, F.trim(name)).join(aliases.select(F.col("alias").alias(name), F.col("name").alias("_canon")), name, "left")
    return x.withColumn(name, F.coalesce("_canon", name)).drop("_canon").select(*rows.columns)


def positions(rows: DataFrame, ordered: DataFrame, name: str = "name") -> DataFrame:
    """Rows with the catalog place of their name; names outside of it come after all: their place is the number of ordered names."""
    # names are numbered by range blocks; their number is one row
    idx = numbered(ordered.select(name).distinct(), [F.asc(name)], "_i").withColumn("_i", (F.col("_i") - 1).cast("long"))
    n = ordered.agg(F.count_distinct(name).alias("_n"))
    return rows.join(idx, name, "left").join(F.broadcast(n), F.lit(True), "left").withColumn("idx", F.coalesce("_i", "_n")).drop("_i", "_n")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the last in order."""
    rest = [c for c in rows.columns if c not in keys]
    t = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_t"))
    return t.select(*keys, *[F.col(f"_t.{c}").alias(c) for c in rest])


def header_row(cells: DataFrame, expected: list[str]) -> DataFrame:
    """(row, column, value) of a sheet -> (name, column) by its first row that has any expected header; a missing one raises."""
    hit = cells.where(F.col("value").isin(expected))
    first = hit.agg(F.min("row").alias("row"))
    found = hit.join(F.broadcast(first), "row", "left_semi").groupBy(F.col("value").alias("name")).agg(F.min("column").alias("column"))
    want = cells.sparkSession.createDataFrame([(x,) for x in expected], "name string")
    fault = F.when(F.col("column").isNull(), F.raise_error(F.concat(F.lit("missing header "), "name")))
    return want.join(found, "name", "left").select("name", F.coalesce(fault.cast("int"), F.col("column")).alias("column"))
