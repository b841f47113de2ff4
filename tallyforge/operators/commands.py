"""Commands as events: each is appended, and the affected rows are rebuilt from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rebuild(log: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """(key, seq, op, fields): rows as the log leaves them. Events up to the last delete of a key are void; `edits` counts those since.

    The newest event has the values (the greater values on ties of seq).
    """
    gone = log.where("op = 'delete'").groupBy(key).agg(F.max(seq).alias("_gone"))
    x = log.where("op <> 'delete'").join(gone, key, "left").where(F.col("_gone").isNull() | (F.col(seq) > F.col("_gone")))
    last = x.groupBy(key).agg(F.max(F.struct(seq, *fields)).alias("_t"), F.count("*").alias("edits"))
    return last.select(key, *[F.col(f"_t.{f}").alias(f) for f in fields], F.col(f"_t.{seq}").alias(seq), "edits")


def set_plan(rows: DataFrame, most: int = 60) -> DataFrame:
    """A target below the level or above `most` is rejected; one equal to it removes the override."""
    t, lv = F.col("target"), F.col("level")
    outcome = F.when((t > most) | (t < lv) | t.isNull(), "rejected").when(t == lv, "removed").otherwise("set")
    return rows.withColumn("outcome", outcome).withColumn("target", F.when(F.col("outcome") == "set", t))


def changed(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fields that differ from their new_ values, and whether the edit is legal: a new kind needs a new name."""
    diff = {f: ~F.col(f).eqNullSafe(F.col(f"new_{f}")) for f in fields}
    return rows.withColumn("changed", F.array_compact(F.array(*[F.when(c, f) for f, c in diff.items()]))).withColumn("legal", ~diff["kind"] | diff["name"])


def retired(draft: DataFrame, images: DataFrame, results: DataFrame) -> DataFrame:
    """(draft, image) x 3: a draft is retired if its images, none of them twice, are just those of both committed sets."""
    side = lambda x, n: x.select("draft", "image", F.lit(n).alias("_s"))
    every = side(draft, 0).unionByName(side(images, 1)).unionByName(side(results, 2))
    per = every.groupBy("draft", "image").agg(*[F.count(F.when(F.col("_s") == k, 1)).alias(f"n{k}") for k in range(3)])
    ok = F.bool_and((F.col("n0") == 1) & (F.col("n1") == 1) & (F.col("n2") == 1))
    return per.groupBy("draft").agg(ok.alias("retired"), F.sum("n0").alias("_n")).where("_n > 0").drop("_n")


def suggest_pool(images: DataFrame) -> DataFrame:
    """A suggestion replaces an unconfirmed pool; a pool that changes drops its overlap pairs."""
    new = F.when(F.col("confirmed"), F.col("pool")).otherwise(F.coalesce("suggested", "pool"))
    return images.withColumn("drops_pairs", ~F.col("pool").eqNullSafe(new)).withColumn("pool", new)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows that belong to what is gone."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def without_image(pairs: DataFrame, image: DataFrame) -> DataFrame:
    """Pairs (before, after) that don't mention a removed image."""
    out = pairs
    for side in ("before", "after"):
        out = out.join(image.select(F.col("image").alias(side)), side, "left_anti")
    return out


def unique_names(accounts: DataFrame, name: str, order: str) -> DataFrame:
    """Of accounts that want one name the first gets it; the others are rejected."""
    first = F.row_number().over(Window.partitionBy(name).orderBy(order)) == 1
    return accounts.withColumn("rejected", ~first).withColumn(name, F.when(~F.col("rejected"), F.col(name)))


def sticky(values: DataFrame, key: str) -> DataFrame:
    """(key, value, manual): the greatest manual value stays whatever is resolved anew; without one, the least resolved value."""
    g = values.groupBy(key).agg(F.max(F.when(F.col("manual"), F.col("value"))).alias("_m"), F.min("value").alias("_v"))
    return g.select(key, F.coalesce("_m", "_v").alias("value"), F.col("_m").isNotNull().alias("manual"))


def cancel_rest(images: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Images of a task from the cancelled place on are cancelled; those before keep their state."""
    x = images.join(cancelled, "task", "left")
    return x.withColumn("status", F.when(F.col("pos") >= F.col("at"), "cancelled").otherwise(F.col("status"))).drop("at")


def retryable(images: DataFrame) -> DataFrame:
    """The import queue: a failed image may be tried again, an unknown pool waits for its user, the others make up the job in their order."""
    s = F.when(F.col("failed"), "retry").when(F.coalesce("pool", F.lit("unknown")) == "unknown", "waiting").otherwise("job")
    return images.withColumn("queue", s)


def move_slot(loadouts: DataFrame, moves: DataFrame, held: DataFrame) -> DataFrame:
    """(operator, slot, instance) wishes: an instance that another slot holds isn't taken from it; a NULL clears the slot."""
    h = held.select("instance", F.col("operator").alias("_o"), F.col("slot").alias("_s"))
    x = moves.join(h, "instance", "left")
    taken = F.col("_o").isNotNull() & ~((F.col("_o") == F.col("operator")) & (F.col("_s") == F.col("slot")))
    return x.select("operator", "slot", "instance", F.when(F.col("instance").isNull(), "cleared").when(taken, "occupied").otherwise("set").alias("outcome"))


def snapshot_faults(items: DataFrame, catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """Per item the codes of what a snapshot must not have: ids twice, levels out of range, names of another kind, targets below the level."""
    twice = items.groupBy("instance").agg((F.count("*") > 1).alias("_twice"))
    x = items.join(twice, "instance").join(catalog.select("name", F.col("kind").alias("_k")), "name", "left").join(targets, "instance", "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col("_twice"), "duplicate_id"), F.when(~F.coalesce(F.col("level").between(1, 60), F.lit(False)), "level_out_of_range"),
            F.when(F.col("_k").isNull(), "unknown_name").when(F.col("_k") != F.col("kind"), "kind_mismatch"), F.when(F.col("target") < F.col("level"), "target_below_level"),
        )
    )
    return x.select("instance", codes.alias("codes"))
