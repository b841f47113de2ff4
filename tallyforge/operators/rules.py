"""Rule sets of many owners: intervals of levels with a first cost and a step, read from rows, checked and expanded.

A rule set is a table, as large as it is; each owner's rules are expanded to levels by an explode whose length is the interval's, and checked by counts per level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(rules: DataFrame, first: int = 1, last: int = 60) -> DataFrame:
    """(owner, start_level, end_level, first_exp, step) -> (owner, level, exp, rules): each level of the rules within first..last, with how many rules have it; the cost is the least of theirs."""
    lo, hi = F.greatest(F.col("start_level"), F.lit(first)), F.least(F.col("end_level"), F.lit(last))
    each = rules.where("start_level <= end_level").where(lo <= hi).select("owner", "start_level", "first_exp", "step", F.explode(F.sequence(lo, hi)).alias("level"))
    exp = F.col("first_exp").cast("long") + F.col("step") * (F.col("level") - F.col("start_level"))
    return each.groupBy("owner", "level").agg(F.min(exp).alias("exp"), F.count("*").alias("rules"))


def faults(rules: DataFrame, first: int = 1, last: int = 60) -> DataFrame:
    """(owner, level, fault): every fault of a rule set. bad_interval (ends before it starts, or a null; level is its start), negative_cost, overlap and gap of levels within first..last."""
    bad = rules.where("start_level is null or end_level is null or first_exp is null or step is null or start_level > end_level").select("owner", F.col("start_level").alias("level"), F.lit("bad_interval").alias("fault"))
    x = expand(rules.dropna(subset=["start_level", "end_level", "first_exp", "step"]), first, last)
    over = x.where("rules > 1").select("owner", "level", F.lit("overlap").alias("fault"))
    low = x.where("exp < 0").select("owner", "level", F.lit("negative_cost").alias("fault"))
    every = rules.select("owner").distinct().select("owner", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level"))
    gap = every.join(x.select("owner", "level"), ["owner", "level"], "left_anti").select("owner", "level", F.lit("gap").alias("fault"))
    return bad.unionByName(over).unionByName(low).unionByName(gap)


def checked(rules: DataFrame, first: int = 1, last: int = 60) -> DataFrame:
    """(owner, level, exp) of the owners whose rule set has no fault."""
    return expand(rules, first, last).join(faults(rules, first, last).select("owner").distinct(), "owner", "left_anti").select("owner", "level", "exp")


def cache_faults(levels: DataFrame, detail: DataFrame) -> DataFrame:
    """(owner, level, exp, detail, fault): where a cached detail table says another cost than the rules (differs), lacks a level (missing) or has one that the rules don't (extra)."""
    x = levels.select("owner", "level", "exp", F.lit(True).alias("_a")).join(detail.select("owner", "level", F.col("exp").alias("detail"), F.lit(True).alias("_b")), ["owner", "level"], "full_outer")
    fault = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("exp").eqNullSafe(F.col("detail")), "differs")
    return x.select("owner", "level", "exp", "detail", fault.alias("fault")).where("fault is not null")
