"""Views that map the driver's tables into the observation schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.sources.tables import load


def items(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(spark, d, "part").select(
        k.alias("instance_id"), F.when(k % 3 == 0, "support").otherwise("main").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("level"),
        (F.substring("p_brand", 7, 9).cast("int") % 5).alias("quality"), (k % 20).cast("int").alias("source_order"), (k % 7).cast("int").alias("row_index"), (k % 4).cast("int").alias("column_index"),
    )


def targets(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").where("l_partkey % 4 <> 0")
    return li.groupBy(F.col("l_partkey").alias("instance_id")).agg((F.min("l_orderkey") % 60 + 1).cast("int").alias("target"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Weights are scaled integers, so sums don't depend on the order of addition."""
    w = F.round(F.col("l_discount") * 1000).cast("long") + F.when(F.col("l_returnflag") == "A", 220).otherwise(0)
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("value"), w.alias("weight"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return load(spark, d, "events").select(F.col("user_id").alias("grp"), "event_id", (e % 3).cast("int").alias("value"), (40 + e % 60).cast("int").alias("conf"))


def sequence(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("image"), F.col("turn").alias("pos"), F.when(F.col("turn") % 5 != 4, F.col("role")).alias("key"), (60 - F.length("text") % 60).cast("int").alias("level"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Image k of a user holds the events [12k, 12k + 20) as rows of 4, so neighbours share 2 rows."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = load(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts").withColumn("rn", rn)
    k = F.expr("cast(rn div 12 as int)")
    e = e.withColumn("k", F.explode(F.when((F.col("rn") >= 12) & (F.col("rn") % 12 < 8), F.array(k - 1, k)).otherwise(F.array(k))))
    at = F.col("rn") - 12 * F.col("k")
    return e.select("user_id", F.col("k").cast("long").alias("k"), F.floor(at / 4).cast("int").alias("r"), (at % 4).cast("int").alias("c"), F.when(F.col("event_id") % 37 != 0, F.col("event_type")).alias("name"), (1 + F.floor("value").cast("int") % 60).alias("level"))


def edges(aligned: DataFrame) -> DataFrame:
    # an image number is below the factor, so no two users share a node
    a = F.col("user_id") * 1_000_000_000 + F.col("k")
    return aligned.select(a.alias("a"), (a + 1).alias("b"))


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    """One observed card per event: an image per user, cells in the order of time, unknown values by modulus."""
    e = F.col("event_id")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    x = load(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts").withColumn("rn", rn)
    case = lambda n, *v: F.element_at(F.array(*[F.lit(s) for s in v]), (n + 1).cast("int"))
    return x.select(
        e.alias("occ_id"), F.col("user_id").alias("image"), F.col("rn").cast("long").alias("ord"), F.expr("cast(rn div 4 as int)").alias("r"), (F.col("rn") % 4).cast("int").alias("c"),
        (e % 11 != 0).alias("complete"), F.when(e % 37 != 0, F.col("event_type")).alias("name"), F.when(e % 23 != 0, 1 + F.floor("value").cast("int") % 12).alias("level"),
        F.when(e % 29 != 0, (e % 4).cast("int")).alias("quality"), (40 + e % 60).cast("int").alias("conf"),
        F.when(e % 13 == 0, "exclude_fragment").when(e % 13 == 1, "ignore").otherwise("keep").alias("action"), (e % 17 == 0).alias("duplicate"), (e % 19 == 0).alias("manual"),
        case(e % 3, "equipped", "unequipped", "unknown").alias("equipped"), case(F.col("user_id") % 5, "main", "support", "experience", "unknown", None).alias("pool"),
    )


def cards(spark: SparkSession, d: str) -> DataFrame:
    """The cells of overlapping images as cards: an event in two images is a card in each; id 2 e in the earlier image, 2 e + 1 in the later."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = load(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts").withColumn("rn", rn)
    k = F.expr("cast(rn div 12 as int)")
    e = e.withColumn("k", F.explode(F.when((F.col("rn") >= 12) & (F.col("rn") % 12 < 8), F.array(k - 1, k)).otherwise(F.array(k))))
    at, v = F.col("rn") - 12 * F.col("k"), F.col("event_id")
    later = (F.col("k") == F.expr("cast(rn div 12 as int)")).cast("long")
    return e.select(
        "user_id", F.col("k").cast("long").alias("k"), F.floor(at / 4).cast("int").alias("r"), (at % 4).cast("int").alias("c"), "event_id", (2 * v + later).alias("card"),
        F.when(v % 37 != 0, F.col("event_type")).alias("name"), F.when(v % 31 != 0, 1 + F.floor("value").cast("int") % 60).alias("level"), F.when(v % 29 != 0, (v % 4).cast("int")).alias("quality"),
        ((v % 43 != 0) | (later == 1)).alias("complete"), (v % 41 == 0).alias("review"),
    )


def relations(cards_: DataFrame) -> DataFrame:
    """(user_id, k, relation, lhs, rhs, status): what two images that share an event say of its cards."""
    b = cards_.groupBy("user_id", "event_id").agg(F.min("k").alias("k"), F.min("card").alias("lhs"), F.max("card").alias("rhs"), F.count("*").alias("n")).where("n = 2")
    e = F.col("event_id")
    return b.select("user_id", "k", e.alias("relation"), "lhs", "rhs", F.when(e % 7 == 0, "possible_duplicate").when(e % 7 == 1, "ambiguous").otherwise("duplicate").alias("status"))
