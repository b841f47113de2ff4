"""Names by similarity ratio against a dictionary, without all pairs, and the resolution of read names that rests on it.

The ratio of two texts is 2 * matched / (length + length), with the characters that difflib's SequenceMatcher matches. It is at least r only if
the texts have r / 2 * (both lengths) characters in common, which bounds their lengths and, by prefix filtering, lets the join work on rare characters: of a text whose overlap
must be t or more, one of its length - t + 1 rarest characters (counted ones: the second "a" is another than the first) is among those of its partner. What is left is checked exactly.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: What confirms a fuzzy name, and what another name must stay below.
CONFIRMS, MARGIN, LEAST_CONFIDENCE, LEAST_AGREEMENT = 0.86, 0.05, 0.72, 2


def _characters(text: Column) -> Column:
    """The characters of a text as (character, how many of it came before)."""
    cs = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(cs, lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice(cs, F.lit(1), i), lambda d: d == c)).alias("n")))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out, last, m = [], None, SequenceMatcher(None)
    for x, y in zip(a, b):
        if y != last:
            m.set_seq2(y)
            last = y
        m.set_seq1(x)
        out.append(m.ratio())
    return pd.Series(out)


def ratio_join(texts: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(text) x (name) -> (text, name, ratio) of distinct texts and names whose ratio is `least` or more; nulls and empty texts have no partner."""
    t = texts.select(F.lit(0).alias("side"), F.col("text").alias("x"))
    n = names.select(F.lit(1).alias("side"), F.col("name").alias("x"))
    every = t.unionByName(n).where("x is not null and x <> ''").distinct()
    size = F.char_length("x")
    # lengths a <= b of a pair: a is at least least / 2 * (a + b), and so at least least / (2 - least) * b
    need = F.ceil(F.lit(least / 2 - 1e-12) * (size + F.ceil(size * (least / (2 - least)) - 1e-9)))
    each = every.select("side", "x", size.alias("size"), (size - need + 1).cast("int").alias("prefix"), F.explode(_characters(F.col("x"))).alias("t"))
    weight = each.groupBy("t").agg(F.count("*").alias("rows"))
    order = F.row_number().over(Window.partitionBy("side", "x").orderBy("rows", "t.c", "t.n"))
    kept = each.join(weight, "t").withColumn("k", order).where("k <= prefix").select("side", "x", "size", "t")
    a, b = kept.where("side = 0").alias("a"), kept.where("side = 1").alias("b")
    both = F.col("a.size") + F.col("b.size")
    near = a.join(b, "t").where(F.least("a.size", "b.size") >= F.lit(least / 2 - 1e-12) * both).select(F.col("a.x").alias("text"), F.col("b.x").alias("name")).distinct()
    return near.withColumn("ratio", _ratio("text", "name")).where(F.col("ratio") >= least)


def resolve_names(readings: DataFrame, names: DataFrame) -> DataFrame:
    """(grp, pos, raw, text, confidence) x (name) -> grp, raw, name, confidence, reason: what the readings of a card say its name is.

    text is the reading cleaned and put through the aliases; empty ones say nothing. The most confident reading decides (the first on ties). If it is in the dictionary it is the name;
    else the nearest name is, if its ratio is 0.86 or more, no other name comes within 0.05 of it, the reading's confidence is 0.72 or more and two readings or more are that near to it.
    """
    r = readings.where("text is not null and text <> ''")
    best = r.groupBy("grp").agg(F.max_by(F.struct("raw", "text", "confidence"), F.struct("confidence", (-F.col("pos")).alias("p"))).alias("b")).select("grp", "b.*")
    known = names.select("name").where("name is not null").distinct()
    exact = best.join(known, best.text == known.name, "left_semi").select("grp", "text")
    agree = r.join(exact, ["grp", "text"]).groupBy("grp").agg(F.count("*").alias("same"))
    # only cards whose best reading isn't a name need the search
    open_ = r.join(exact.select("grp"), "grp", "left_anti")
    near = ratio_join(open_.select("text"), known, CONFIRMS - MARGIN)
    top = near.groupBy("text").agg(F.slice(F.sort_array(F.collect_list(F.struct("ratio", "name")), False), 1, 2).alias("t"))
    top = top.select("text", F.get("t", 0).ratio.alias("ratio"), F.get("t", 0)["name"].alias("name"), F.get("t", 1).ratio.alias("second"))
    fuzzy = best.join(top, "text").where((F.col("ratio") >= CONFIRMS) & (F.col("confidence") >= LEAST_CONFIDENCE) & ~F.coalesce(F.col("second") >= F.col("ratio") - MARGIN, F.lit(False)))
    votes = open_.select("grp", "text").join(near.where(F.col("ratio") >= CONFIRMS).select("text", "name"), "text").join(fuzzy.select("grp", "name"), ["grp", "name"]).groupBy("grp").agg(F.count("*").alias("near"))
    fuzzy = fuzzy.join(votes, "grp").where(F.col("near") >= LEAST_AGREEMENT).select("grp", "name", "ratio")
    every = readings.select("grp").distinct().join(best, "grp", "left").join(agree, "grp", "left").join(fuzzy, "grp", "left")
    confidence = (
        F.when(F.col("same").isNotNull(), F.least(F.lit(0.99), F.col("confidence") * 0.85 + F.least(F.col("same"), F.lit(3)) * 0.05))
        .when(F.col("name").isNotNull(), F.least(F.lit(0.88), (F.col("confidence") + F.col("ratio")) / 2)).when(F.col("text").isNotNull(), F.col("confidence") * 0.5).otherwise(0.0)
    )
    reason = F.when(F.col("text").isNull(), "name_ocr_empty").when(F.col("same").isNotNull(), None).when(F.col("name").isNotNull(), "name_fuzzy_confirmed").otherwise("name_unknown")
    return every.select("grp", "raw", F.when(F.col("same").isNotNull(), F.col("text")).otherwise(F.col("name")).alias("name"), confidence.alias("confidence"), reason.alias("reason"))
