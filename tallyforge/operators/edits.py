"""Logs of edits that may be refused: rows with a catalog check, evidence behind rows, and pairs of images.

Whether a thing is there when a command comes follows from the newest accepted addition, deletion and clearing before it. A refused command changes nothing, and a deletion
of what isn't there leaves it so, hence each command's outcome is a function of its predecessors of the same key and no fold over the log is needed: two window sums, by key and by session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ["kind", "name", "level", "quality"]


def _there(log: DataFrame, key: list[str], made) -> DataFrame:
    """log (session, seq, op, key) with `there`: whether the key exists just before the command. made: which commands make it."""
    seq = F.col("seq")
    clears = Window.partitionBy("session").orderBy("seq", "op").rowsBetween(Window.unboundedPreceding, -1)
    x = log.withColumn("_cleared", F.max(F.when(F.col("op") == "clear", seq)).over(clears))
    own = Window.partitionBy("session", *key).orderBy("seq", "op").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_made", F.max(F.when(made, seq)).over(own)).withColumn("_gone", F.max(F.when(F.col("op").isin("delete", "remove"), seq)).over(own))
    there = F.col("_made").isNotNull() & (F.col("_made") > F.greatest(F.coalesce("_gone", F.lit(-(2**62))), F.coalesce("_cleared", F.lit(-(2**62)))))
    return x.withColumn("there", there).drop("_cleared", "_made", "_gone")


def row_edits(initial: DataFrame, log: DataFrame, catalog: DataFrame) -> DataFrame:
    """(session, row, occurrence, fields) x (session, seq, op, row, fields) x (name, kind) -> every command with its outcome and what it edits.

    op: add, update, delete or clear (of a whole session). outcome: accepted, unknown_name, kind_mismatch (add and update, against the catalog), exists (add), not_found (update, delete).
    target: evidence for a row that an occurrence backs, else row. seq is unique in a session and above 0; initial rows come as additions of seq 0.
    """
    start = initial.select("session", F.lit(0).cast("long").alias("seq"), F.lit("add").alias("op"), "row", *FIELDS, F.lit(True).alias("initial"), "occurrence")
    every = start.unionByName(log.select("session", "seq", "op", "row", *FIELDS).withColumn("initial", F.lit(False)).withColumn("occurrence", F.lit(None).cast(initial.schema["occurrence"].dataType)))
    known = catalog.groupBy("name").agg(F.min("kind").alias("_kind"))
    x = every.join(known, "name", "left")
    checked = F.col("op").isin("add", "update") & ~F.col("initial")
    legal = F.when(checked & F.col("_kind").isNull(), "unknown_name").when(checked & (F.col("kind") != F.col("_kind")), "kind_mismatch")
    x = x.withColumn("_fault", legal)
    x = _there(x, ["row"], (F.col("op") == "add") & F.col("_fault").isNull())
    # what backs a row is known since it was made
    x = x.withColumn("_occ", F.last("occurrence", True).over(Window.partitionBy("session", "row").orderBy("seq", "op")))
    fault = F.coalesce("_fault", F.when((F.col("op") == "add") & F.col("there"), "exists").when(F.col("op").isin("update", "delete") & ~F.col("there"), "not_found"))
    target = F.when(F.col("_occ").isNotNull(), "evidence").when(F.col("op") != "clear", "row")
    return x.select("session", "seq", "op", "row", *FIELDS, "initial", F.col("_occ").alias("occurrence"), F.coalesce(fault, F.lit("accepted")).alias("outcome"), target.alias("target"))


def edited_rows(edits: DataFrame) -> DataFrame:
    """The rows that are there at the end, with their newest accepted values."""
    ok = edits.where("outcome = 'accepted'")
    cleared = ok.where("op = 'clear'").groupBy("session").agg(F.max("seq").alias("_c"))
    gone = ok.where("op = 'delete'").groupBy("session", "row").agg(F.max("seq").alias("_d"))
    x = ok.where("op in ('add', 'update')").join(cleared, "session", "left").join(gone, ["session", "row"], "left")
    x = x.where("seq > greatest(coalesce(_c, -1), coalesce(_d, -1))")
    return x.groupBy("session", "row").agg(F.max_by(F.struct(*FIELDS, "seq"), "seq").alias("t")).select("session", "row", *[F.col(f"t.{f}").alias(f) for f in FIELDS], F.col("t.seq").alias("seq"))


def edited_evidence(edits: DataFrame) -> DataFrame:
    """Evidence that was edited through its row: (session, occurrence, fields, manual, action). A deletion excludes it as a false box, an update keeps it by hand; clearing rows leaves evidence as it is."""
    ok = edits.where("outcome = 'accepted' and target = 'evidence' and op in ('update', 'delete')")
    last = ok.groupBy("session", "occurrence").agg(F.max_by(F.struct(*FIELDS), F.when(F.col("op") == "update", F.col("seq"))).alias("t"), F.max_by("op", "seq").alias("op"), F.bool_or(F.col("op") == "update").alias("manual"))
    action = F.when(F.col("op") == "delete", "exclude_false_box").otherwise("keep")
    return last.select("session", "occurrence", *[F.col(f"t.{f}").alias(f) for f in FIELDS], "manual", action.alias("action"))


def pair_edits(log: DataFrame, images: DataFrame) -> DataFrame:
    """(session, seq, op: add or remove, pool, before, after) x (session, image, pool, confirmed) -> every command with its outcome.

    accepted, or for additions invalid (an image with itself), unconfirmed, other_pool, exists; a removal of what isn't there is accepted and changes nothing.
    """
    one = lambda s: images.select("session", F.col("image").alias(s), F.col("pool").alias(f"_{s}_pool"), F.col("confirmed").alias(f"_{s}_ok"))
    x = log.join(one("before"), ["session", "before"], "left").join(one("after"), ["session", "after"], "left")
    ok = F.coalesce(F.col("_before_ok") & F.col("_after_ok"), F.lit(False))
    same = F.coalesce((F.col("_before_pool") == F.col("pool")) & (F.col("_after_pool") == F.col("pool")), F.lit(False))
    x = x.withColumn("_fault", F.when(F.col("op") == "add", F.when(F.col("before") == F.col("after"), "invalid").when(~ok, "unconfirmed").when(~same, "other_pool")))
    x = _there(x, ["pool", "before", "after"], (F.col("op") == "add") & F.col("_fault").isNull())
    fault = F.coalesce("_fault", F.when((F.col("op") == "add") & F.col("there"), "exists"))
    return x.select("session", "seq", "op", "pool", "before", "after", F.coalesce(fault, F.lit("accepted")).alias("outcome"))


def pairs_after(edits: DataFrame) -> DataFrame:
    """The pairs that are there at the end."""
    ok = edits.where("outcome = 'accepted'").groupBy("session", "pool", "before", "after").agg(F.max_by("op", "seq").alias("op"))
    return ok.where("op = 'add'").drop("op")
