"""Similarity of fingerprints, and one-to-one matching of what is similar."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.tables import Scratch, written

PART = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine01(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """(cosine + 1) / 2 within 0..1; 0 for empty vectors, zeros or different lengths."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm_a > 0) & (norm_b > 0)
    return F.when(fits, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) / (norm_a * norm_b) + 1) / 2))).otherwise(0.0)


def six_digits(score: Column) -> Column:
    """F.round(score, 6) for scores within 0..1, in plain doubles but next to a tie: F.round makes a decimal of each, which is most of the work where pairs are many."""
    m = score * 1e6
    return F.when(F.abs(m - F.floor(m) - 0.5) < 1e-3, F.round(score, 6)).otherwise(F.rint(m) / 1e6)


def hash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 64-bit hashes."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def card_similarity(x: str, y: str) -> Column:
    """0.46 icon + 0.34 name + 0.15 level hash similarity + 0.05 intersection of the histograms (which sum to 1)."""
    part = lambda f: hash_similarity(F.col(f"{x}.{f}"), F.col(f"{y}.{f}"))
    both = F.aggregate(F.zip_with(F.col(f"{x}.hist"), F.col(f"{y}.hist"), lambda a, b: F.least(a, b)), F.lit(0.0), lambda s, v: s + v)
    return 0.46 * part("icon") + 0.34 * part("name") + 0.15 * part("level") + 0.05 * both


def _scored(least: float):
    def run(t: pa.Table) -> pa.Table:
        right, n = t["right"].to_numpy(zero_copy_only=False).astype(bool), t["n"].to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        l_, r_ = np.flatnonzero(~right), np.flatnonzero(right)
        with np.errstate(all="ignore"):
            s = (v[l_] @ v[r_].T / np.outer(n[l_], n[r_]) + 1) / 2
        s = np.where(np.isnan(s), 1.0, np.clip(s, 0.0, 1.0))  # as in SQL, where NaN is above all numbers
        x, y = np.nonzero(s >= least)
        ids = t["id"].combine_chunks()
        return pa.table({"a": ids.take(pa.array(l_[x])), "b": ids.take(pa.array(r_[y])), "score": s[x, y]})

    return run


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(bucket, id, v) x (bucket, id, v) -> (a, b, score) of a score of `least` or more within equal buckets: the column a card stands in.

    Norms are taken once per row. Both sides of a bucket are dealt in parts of PART rows, and each pair of parts is one matrix product, so a bucket of any size is many tasks of bounded memory.
    """
    if least <= 0:
        raise ValueError("every pair has a similarity of 0 or more")
    v = F.col("v").cast("array<double>")
    side = lambda x, r: x.select("bucket", F.size("v").alias("dim"), F.lit(r).alias("right"), "id", v.alias("v"), F.sqrt(dot(v, v)).alias("n"))
    rows = side(left, False).unionByName(side(right, True)).where("bucket is not null and dim > 0 and n > 0")
    parts = lambda r: F.ceil(F.count(F.when(F.col("right") == r, 1)) / PART).cast("int")
    sizes = rows.groupBy("bucket", "dim").agg(parts(False).alias("of_left"), parts(True).alias("of_right")).where("of_left > 0 and of_right > 0")
    own = lambda of: F.array(F.pmod(F.xxhash64("id"), F.col(of)).cast("int"))
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    x = rows.join(sizes, ["bucket", "dim"])
    x = x.withColumn("l", F.explode(F.when(F.col("right"), every("of_left")).otherwise(own("of_left")))).withColumn("r", F.explode(F.when(F.col("right"), own("of_right")).otherwise(every("of_right"))))
    kind = left.schema["id"].dataType.simpleString()
    return x.select("bucket", "dim", "l", "r", "right", "id", "v", "n").groupBy("bucket", "dim", "l", "r").applyInArrow(_scored(least), f"a {kind}, b {kind}, score double")


def greedy_match(scored: DataFrame, key: str) -> DataFrame:
    """(key, a, b, score) -> one-to-one pairs, the best score first, on ties the least a, then the least b.

    Each round takes the pairs that are the best of both of their ends, which are those that taking pairs one by one would take,
    and leaves out the pairs that touch them; every round ends at least one pair of each key that has any left. Pairs with a null in any column are no pairs.
    """
    order = F.struct("score", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
    taken = None
    with Scratch(scored.sparkSession, "match") as tmp:
        rest = last = tmp.written(scored.select(key, "a", "b", "score").dropna(), "scored")
        while True:
            best_a = rest.groupBy(key, "a").agg(F.max(order).alias("o")).select(key, "a", (-F.col("o.nb")).alias("b"))
            best_b = rest.groupBy(key, "b").agg(F.max(order).alias("o")).select(key, (-F.col("o.na")).alias("a"), "b")
            got = tmp.written(rest.join(best_a, [key, "a", "b"], "left_semi").join(best_b, [key, "a", "b"], "left_semi"), "taken")
            taken = got if taken is None else taken.unionByName(got)
            rest = tmp.written(rest.join(got.select(key, "a"), [key, "a"], "left_anti").join(got.select(key, "b"), [key, "b"], "left_anti"), "rest")
            tmp.drop(last)
            last = rest
            if rest.limit(1).count() == 0:
                return written(taken, "matches")


def pair_verdict(matches: DataFrame, key: str, within: int = 14) -> DataFrame:
    """Matches (key, row, col, offset) -> per key the median offset, how many lie within `within` of it, and whether they confirm an overlap.

    Confirmed: at least two rows and six cards, or a row with three columns that span two or more.
    """
    mid = matches.groupBy(key).agg(F.median("offset").alias("median"))
    near = matches.join(mid, key).where(F.abs(F.col("offset") - F.col("median")) <= within)
    row = near.groupBy(key, "row").agg(F.count("*").alias("n"), F.count_distinct("col").alias("cols"), (F.max("col") - F.min("col")).alias("span"))
    got = row.groupBy(key).agg(F.sum("n").alias("cards"), F.count("*").alias("rows"), F.bool_or((F.col("cols") >= 3) & (F.col("span") >= 2)).alias("wide"))
    verdict = ((F.col("rows") >= 2) & (F.col("cards") >= 6)) | F.col("wide")
    return mid.join(got, key, "left").select(key, "median", F.coalesce("cards", F.lit(0).cast("long")).alias("cards"), F.coalesce(verdict, F.lit(False)).alias("confirmed"))
