"""Votes over repeated observations; weights are scaled integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_vote(votes: DataFrame, margin: int) -> DataFrame:
    """grp, value (NULL below the margin), best and second weight; ties go to the smaller value."""
    s = votes.groupBy("grp", "value").agg(F.sum("weight").alias("w"))
    r = s.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("m"), "value"))).alias("v"))
    best, second = -F.get("v", F.lit(0)).m, F.coalesce(-F.get("v", F.lit(1)).m, F.lit(0).cast("long"))
    return r.select("grp", F.when(best - second >= margin, F.get("v", F.lit(0)).value).alias("value"), best.alias("best"), second.alias("second"))


def first_seen_vote(obs: DataFrame) -> DataFrame:
    """Most confidence wins, the earliest observation breaks ties; conflict says that values differ."""
    s = obs.groupBy("grp", "value").agg(F.sum("conf").alias("w"), F.min("event_id").alias("f"), F.count("*").alias("c"))
    top = F.max(F.struct("w", (-F.col("f")).alias("f"), "value"))
    g = s.groupBy("grp").agg(top.alias("t"), F.sum("c").alias("c"), (F.count("*") > 1).alias("conflict"))
    return g.select("grp", "t.value", F.least(99 * F.col("c"), F.col("t.w")).alias("score"), "conflict")


def agreement(obs: DataFrame, reliable: int) -> DataFrame:
    """None reliable: unrecognized; several values: conflict, NULL; one: agreed, with the least confidence."""
    ok = F.col("conf") >= reliable
    g = obs.groupBy("grp").agg(F.min(F.when(ok, F.col("value"))).alias("lo"), F.max(F.when(ok, F.col("value"))).alias("hi"), F.min(F.when(ok, F.col("conf"))).alias("c"))
    one = F.col("lo") == F.col("hi")
    return g.select("grp", F.when(one, F.col("lo")).alias("value"), F.when(one, F.col("c")).alias("confidence"), F.when(F.col("lo").isNull(), "unrecognized").when(~one, "conflict").otherwise("agreed").alias("status"))


def field_status(obs: DataFrame, reliable: int) -> DataFrame:
    """Precedence: invalid, ambiguous (conflict), nothing reliable, several values, one source, confirmed."""
    ok = F.when(F.col("conf") >= reliable, F.col("value"))
    g = obs.groupBy("grp").agg(F.max("invalid").alias("bad"), F.max("ambiguous").alias("amb"), F.count(ok).alias("n"), F.min(ok).alias("lo"), F.max(ok).alias("hi"))
    s = F.when(F.col("bad"), "invalid").when(F.col("amb"), "conflict").when(F.col("n") == 0, "unknown").when(F.col("lo") != F.col("hi"), "conflict").when(F.col("n") == 1, "candidate").otherwise("confirmed")
    return g.select("grp", s.alias("status"))


def level_vote(votes: DataFrame, margin: int = 150, bonus: int = 220, sure: int = 850) -> DataFrame:
    """(grp, ordinal, value, conf, full): the level with the most weight, in thousandths; ties go to the greater value.

    A margin below `margin` makes the level unknown, but for a best text that is complete and of confidence `sure` or more.
    """
    f = F.col("full").cast("int")
    s = votes.groupBy("grp", "value").agg(F.sum(F.col("conf") + bonus * f).alias("w"), F.count("*").alias("n"), F.max_by(F.struct("conf", "full"), F.struct("conf", -F.col("ordinal"))).alias("best"))
    # the two heaviest alone matter: the second is the greatest among the others
    top = s.groupBy("grp").agg(F.max(F.struct("w", "value", "n", "best")).alias("t"), F.count("*").alias("kinds"))
    rest = s.join(top.select("grp", F.col("t.value").alias("tv")), "grp").where("value <> tv").groupBy("grp").agg(F.max("w").alias("second"))
    x = top.join(rest, "grp", "left").withColumn("second", F.coalesce("second", F.lit(0).cast("long")))
    doubtful = (F.col("kinds") > 1) & ~(F.col("t.best.full") & (F.col("t.best.conf") >= sure)) & (F.col("t.w") - F.col("second") < margin)
    # 0.82 of the best confidence and 0.06 for each of up to three texts that agree, at most 0.99; in hundred-thousandths
    score = F.least(F.lit(99_000).cast("long"), 82 * F.col("t.best.conf") + 6000 * F.least(F.col("t.n"), F.lit(3).cast("long")))
    warning = F.when(doubtful, "level_strategy_conflict").when(F.col("kinds") > 1, "level_weighted_consensus")
    return x.select("grp", F.when(~doubtful, F.col("t.value")).alias("value"), F.when(doubtful, F.lit(0).cast("long")).otherwise(score).alias("score"), warning.alias("warning"))


def pair_vote(obs: DataFrame) -> DataFrame:
    """(grp, ord, current, capacity, conf): the pair with the most confidence, the earliest on ties; score is the mean over all, at most 99."""
    s = obs.groupBy("grp", "current", "capacity").agg(F.sum("conf").alias("w"), F.min("ord").alias("o"), F.count("*").alias("n"))
    g = s.groupBy("grp").agg(F.max(F.struct("w", (-F.col("o")).alias("o"), "current", "capacity")).alias("t"), F.sum("n").alias("n"), (F.count("*") > 1).alias("conflict"))
    return g.select("grp", "t.current", "t.capacity", F.least(F.lit(99).cast("long"), F.expr("t.w div n")).alias("score"), "conflict")


def per_colour(obs: DataFrame, colours: list[str], reliable_at: int) -> DataFrame:
    """Unpivots one count per colour and settles each by `agreement`."""
    long = obs.unpivot(["grp", "conf"], colours, "colour", "value")
    return agreement(long.where("value is not null").withColumn("grp", F.struct("grp", "colour")), reliable_at).select("grp.grp", "grp.colour", "value", "confidence", "status")


def header_summary(fields: DataFrame) -> DataFrame:
    """(grp, current, current_status, capacity, capacity_status) -> the same with current over capacity made invalid, and the overall status."""
    over = F.coalesce(F.col("current") > F.col("capacity"), F.lit(False))
    x = fields.withColumn("current_status", F.when(over, "invalid").otherwise(F.col("current_status")))
    a, b = F.col("current_status"), F.col("capacity_status")
    any_, all_ = (lambda v: (a == v) | (b == v)), (lambda v: (a == v) & (b == v))
    return x.withColumn("status", F.when(any_("invalid"), "invalid").when(any_("conflict"), "conflict").when(all_("confirmed"), "confirmed").when(all_("unknown"), "unknown").otherwise("partial"))


def field_value(obs: DataFrame, reliable_at: int) -> DataFrame:
    """(grp, value, conf, state) -> value where one is settled, and status, by the precedence of `field_status`; only confirmed states are reliable."""
    ok = F.when((F.col("conf") >= reliable_at) & (F.col("state") == "confirmed"), F.col("value"))
    has = lambda s: F.bool_or(F.col("state") == s)
    g = obs.groupBy("grp").agg(has("invalid").alias("bad"), has("ambiguous").alias("amb"), F.count(ok).alias("n"), F.min(ok).alias("lo"), F.max(ok).alias("hi"))
    s = F.when(F.col("bad"), "invalid").when(F.col("amb"), "conflict").when(F.col("n") == 0, "unknown").when(F.col("lo") != F.col("hi"), "conflict").when(F.col("n") == 1, "candidate").otherwise("confirmed")
    return g.withColumn("status", s).select("grp", F.when(F.col("status").isin("candidate", "confirmed"), F.col("lo")).alias("value"), "status")


def name_vote(texts: DataFrame, aliases: DataFrame, allowed: DataFrame) -> DataFrame:
    """(grp, ordinal, text, conf): the cleaned text of the highest confidence decides (the first on ties); texts that agree with it raise the score, in hundredths of a percent.

    aliases (alias, name) and allowed (name) are dimensions.
    """
    from tallyforge.functions.parse import clean_name

    t = texts.withColumn("raw", clean_name(F.col("text"))).where("raw <> ''")
    t = t.join(aliases.withColumnRenamed("alias", "raw"), "raw", "left").withColumn("norm", F.coalesce("name", "raw")).drop("name")
    best = t.groupBy("grp").agg(F.max_by(F.struct("raw", "norm", "conf"), F.struct("conf", -F.col("ordinal"))).alias("b"))
    agree = t.groupBy("grp", "norm").agg(F.count("*").alias("agree"))
    x = best.select("grp", "b.*").join(agree, ["grp", "norm"]).join(allowed.select(F.col("name").alias("norm"), F.lit(True).alias("ok")), "norm", "left")
    known = F.coalesce("ok", F.lit(False))
    score = F.when(known, F.least(F.lit(9900).cast("long"), 85 * F.col("conf") + 500 * F.least("agree", F.lit(3).cast("long")))).otherwise(50 * F.col("conf")).cast("long")
    return x.select("grp", "raw", F.when(known, F.col("norm")).alias("name"), score.alias("score"), F.when(~known, "name_unknown").alias("warning"))


def best_per_kind(obs: DataFrame, kinds: list[str]) -> DataFrame:
    """(page, kind, value, kind_conf, count_conf, complete): per page and kind the observation with the greatest lesser confidence.

    A kind that isn't seen is 0 if the whole page is complete, else unknown.
    """
    sure = F.least("kind_conf", "count_conf")
    out = [F.max_by("value", F.when(F.col("kind") == k, F.struct(sure, -F.col("value")))).alias(f"_{k}") for k in kinds] + [F.bool_or(F.col("kind") == k).alias(f"_has_{k}") for k in kinds]
    g = obs.groupBy("page").agg(F.bool_and("complete").alias("whole"), *out)
    return g.select("page", *[F.when(F.col(f"_has_{k}"), F.col(f"_{k}")).when(F.col("whole"), F.lit(0)).alias(k) for k in kinds])


def header_observation(candidates: DataFrame, reliable_at: int = 65) -> DataFrame:
    """(grp, ordinal, current, capacity, conf): the best candidate's values and status.

    ambiguous if another reliable candidate says otherwise, invalid if the best has more than the capacity, uncertain below `reliable_at`, else confirmed.
    """
    best = candidates.groupBy("grp").agg(F.max_by(F.struct("current", "capacity", "conf"), F.struct("conf", -F.col("ordinal"))).alias("b"))
    ok = F.when(F.col("conf") >= reliable_at, F.struct("current", "capacity"))
    kinds = candidates.groupBy("grp").agg(F.count_distinct(ok).alias("kinds"))
    status = F.when(F.col("b.conf") < reliable_at, "uncertain").when(F.col("kinds") > 1, "ambiguous").when(F.col("b.current") > F.col("b.capacity"), "invalid").otherwise("confirmed")
    return best.join(kinds, "grp").select("grp", "b.current", "b.capacity", "b.conf", status.alias("status"))
