"""Summaries and reports over observed cards and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.inventory import numbered
from tallyforge.operators.predicates import known


def _n(c: Column) -> Column:
    return F.count(F.when(c, 1))


def image_summaries(occ: DataFrame) -> DataFrame:
    """One row per image with its counts and its place: pending ones first, then those with warnings, then by image."""
    kept = F.col("action") == "keep"
    s = occ.groupBy("image").agg(
        F.coalesce(F.max("pool"), F.lit("unknown")).alias("page_type"), F.count("*").alias("detected"), _n(kept & ~(F.col("complete") & known())).alias("pending"), _n(~kept).alias("excluded"),
        _n(kept & F.col("duplicate")).alias("duplicates"), _n(F.col("warned")).alias("warnings"),
    )
    return numbered(s, [F.asc(F.when(F.col("pending") > 0, 0).otherwise(1)), F.asc(F.when(F.col("warnings") > 0, 0).otherwise(1)), F.asc("image")], "pos")


def product_summaries(occ: DataFrame) -> DataFrame:
    """Per image what needs a look now (priority 0), what is worth one (1), or nothing (2); a duplicate counts once."""
    s = occ.groupBy("image").agg(
        _n(F.col("pending")).alias("pending"), _n(F.col("action") != "keep").alias("excluded"), F.count_distinct(F.when(F.col("duplicate"), F.col("occ_id"))).alias("duplicates"), _n(~F.col("complete")).alias("_f"), _n(F.col("manual")).alias("_m"),
    )
    tier2 = F.col("excluded") + F.col("duplicates") + F.col("_f") + F.col("_m")
    return s.select("image", "pending", tier2.alias("tier2"), "excluded", "duplicates", F.when(F.col("pending") > 0, 0).when(tier2 > 0, 1).otherwise(2).alias("priority"))


def metrics(occ: DataFrame, key: str, qualities: int) -> DataFrame:
    """Counts of an analysis, with a histogram of qualities."""
    return occ.groupBy(key).agg(
        F.count("*").alias("total"), _n(F.col("complete")).alias("complete"), F.count("name").alias("named"), F.count("level").alias("levelled"), _n(F.col("manual")).alias("manual"), _n(F.col("duplicate")).alias("duplicate"),
        *[_n(F.col("quality") == q).alias(f"quality_{q}") for q in range(qualities)], _n(F.col("quality").isNull()).alias("quality_unknown"),
    )


def batch_summary(images: DataFrame, key: str) -> DataFrame:
    s = F.col("status")
    return images.groupBy(key).agg(
        F.count("*").alias("total"), _n(s == "completed").alias("completed"), _n(s == "failed").alias("failed"), _n(s == "cancelled").alias("cancelled"),
        F.coalesce(F.sum(F.when(s == "completed", F.col("ordinary"))), F.lit(0).cast("long")).alias("ordinary"), F.when(F.count("*") > 0, 1).otherwise(0).alias("peak"),
    )


def top_stages(timings: DataFrame, key: str, stages: list[str], wall: str, n: int) -> DataFrame:
    """The n stages of a batch that took longest (ties by name), with their share of the wall clock in hundredths of a percent."""
    s = timings.groupBy(key).agg(*[F.sum(c).alias(c) for c in stages], F.sum(wall).alias("_w")).unpivot([key, "_w"], stages, "stage", "ms")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ms"), "stage"))
    return s.withColumn("place", place).where(F.col("place") <= n).select(key, "stage", "ms", F.expr("10000 * ms div _w").alias("basis_points"), "place")


def strategy(fields: DataFrame, key: str, variants: int) -> DataFrame:
    """Recognition calls under three policies: all variants, stop at a strict first result, stop at agreement as well; and what the second saves."""
    strict = F.when(F.col("strict"), 1).otherwise(variants)
    agree = F.when(F.col("strict") | F.col("agree1"), 1).when(F.col("agree2"), 2).otherwise(variants)
    g = fields.groupBy(key).agg(F.count("*").alias("fields"), F.sum(F.lit(variants)).alias("all_calls"), F.sum(strict).alias("strict_calls"), F.sum(agree).alias("agree_calls"))
    return g.withColumn("strict_saved", F.expr("10000 * (all_calls - strict_calls) div all_calls"))


def rollup(reasons: DataFrame, key: str) -> DataFrame:
    """(key, severity): blocked with any error, else needs_review with any reason, else ready."""
    s = F.col("severity")
    status = F.when(_n(s == "error") > 0, "blocked").when(F.count(s) > 0, "needs_review").otherwise("ready")
    return reasons.groupBy(key).agg(status.alias("status"), F.count(s).alias("reasons"))


def export_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Identical rows as one with a quantity."""
    return rows.groupBy(*keys).agg(F.count("*").alias("quantity"))


def performance(images: DataFrame, key: str, timings: list[str]) -> DataFrame:
    """Per batch the sums of its stages, and how many images of each page type it has, as a map."""
    s = images.groupBy(key).agg(F.count("*").alias("images"), *[F.sum(t).alias(t) for t in timings])
    kinds = images.groupBy(key, "page").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("page", "n")))).alias("pages"))
    return s.join(kinds, key)


def review_rows(occ: DataFrame, images: DataFrame, relations: DataFrame, choices: DataFrame) -> DataFrame:
    """Everything a reviewer sees of a card: its image's place and pool, how many relations it has, and what was chosen."""
    n = relations.groupBy("occ_id").agg(F.count("*").alias("relations"))
    x = occ.join(images, "image").join(n, "occ_id", "left").join(choices, "occ_id", "left")
    return x.withColumn("relations", F.coalesce("relations", F.lit(0).cast("long"))).withColumn("choice", F.coalesce("choice", F.lit("none")))


def image_places(batches: DataFrame) -> DataFrame:
    """(batch, images) -> the place of each image in its batch's list."""
    return batches.select("batch", F.posexplode("images").alias("pos", "image"))


def variant_audit(variants: DataFrame, features: dict[str, Column]) -> DataFrame:
    """(roi, n, text, weight) -> per bucket of features the regions, and those whose first variant, or whose best of the first two, isn't the final text (the one of the greatest weight).

    features: aggregates over a region's variants, which make the buckets.
    """
    first_two = F.when(F.col("_k") <= 2, F.col("weight"))
    x = variants.withColumn("_k", F.row_number().over(Window.partitionBy("roi").orderBy("n")))
    a = x.groupBy("roi").agg(F.max_by("text", "weight").alias("_final"), F.min_by("text", "n").alias("_one"), F.max_by("text", first_two).alias("_two"), *[c.alias(k) for k, c in features.items()])
    wrong = lambda c, n: F.count(F.when(~F.col(c).eqNullSafe(F.col("_final")), 1)).alias(n)
    return a.groupBy(*features).agg(F.count("*").alias("rois"), wrong("_one", "v1_mismatches"), wrong("_two", "v12_mismatches"))
