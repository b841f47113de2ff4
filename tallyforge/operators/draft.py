"""From observed cards to an inventory: eligibility, draft, resolutions, regrouping, finalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.components import connected_components
from tallyforge.operators.predicates import problems


def base_revision(text: Column) -> Column:
    """A legal base revision: 0, or digits that don't start with 0."""
    return F.when(text.rlike(r"^(?:0|[1-9]\d*)$"), text.try_cast("long"))


def eligibility(tasks: DataFrame) -> DataFrame:
    """Adds `codes`, every reason why a result can't be reconciled, in a fixed order.

    Reads status, review_status, task_id, active_task, account_id, active_account, base (text) and revision.
    """
    base = base_revision(F.col("base"))
    why = F.array(
        F.when(F.col("status") == "partial", "partial_requires_retry"), F.when(F.col("status") == "cancelled", "cancelled_result"), F.when(F.col("status") == "failed", "failed_result"),
        F.when(F.col("review_status") == "blocked", "analysis_blocked"), F.when(F.col("task_id") != F.col("active_task"), "active_task_mismatch"),
        F.when(F.col("account_id") != F.col("active_account"), "account_mismatch"), F.when(base.isNull(), "invalid_base_revision").when(base != F.col("revision"), "revision_mismatch"),
    )
    return tasks.withColumn("codes", F.array_compact(why))


def candidates(cards: DataFrame) -> DataFrame:
    """Whole cards with the codes of what needs review, sorted and distinct."""
    extra = F.when(F.col("review"), F.array(F.lit("occurrence_requires_review"))).otherwise(F.array().cast("array<string>"))
    return cards.where("complete").withColumn("codes", F.array_sort(F.array_distinct(F.concat(problems(), extra))))


def draft(cards: DataFrame, relations: DataFrame) -> DataFrame:
    """Per task (user_id): candidates, fragments, review items, duplicate relations, pending rows, codes that block, and the status.

    A pending row counts only with exactly four relations between four cards of one row on either side. A relation to a card that isn't whole,
    and a duplicate whose two ends disagree, block.
    """
    c = candidates(cards)
    n = lambda cond: F.count(F.when(cond, 1))
    per = c.groupBy("user_id").agg(F.count("*").alias("candidates"), n(F.size("codes") > 0).alias("review_items"))
    fragments = cards.groupBy("user_id").agg(n(~F.col("complete")).alias("fragments"))
    end = c.select(F.col("card"), F.struct("k", "r", "name", "level", "quality").alias("x"))
    rel = relations.join(end.select(F.col("card").alias("lhs"), F.col("x").alias("a")), "lhs", "left").join(end.select(F.col("card").alias("rhs"), F.col("x").alias("b")), "rhs", "left")
    missing = F.col("a").isNull() | F.col("b").isNull()
    agree = F.col("a.name").eqNullSafe(F.col("b.name")) & F.col("a.level").eqNullSafe(F.col("b.level"))
    dup = F.col("status") == "duplicate"
    codes = rel.groupBy("user_id").agg(
        n(dup).alias("duplicates"), F.bool_or(~dup & missing).alias("unavailable"), F.bool_or(dup & (missing | ~F.coalesce(agree, F.lit(False)))).alias("inconsistent")
    )
    rows = rel.where(~dup & ~missing).groupBy("user_id", "a.k", "a.r", F.col("b.k").alias("k2"), F.col("b.r").alias("r2"))
    rows = rows.agg(F.count("*").alias("m"), F.count_distinct("lhs").alias("l"), F.count_distinct("rhs").alias("q")).where("m = 4 and l = 4 and q = 4")
    pending = rows.groupBy("user_id").agg(F.count("*").alias("pending_rows"))
    x = fragments.join(per, "user_id", "left").join(codes, "user_id", "left").join(pending, "user_id", "left")
    zero = lambda f: F.coalesce(f, F.lit(0).cast("long")).alias(f)
    no = lambda f: F.coalesce(f, F.lit(False))
    block = F.array_compact(F.array(F.when(no("unavailable"), "overlap_relation_unavailable"), F.when(no("inconsistent"), "reconcile_duplicate_component_inconsistent")))
    x = x.select("user_id", "fragments", zero("candidates"), zero("review_items"), zero("duplicates"), zero("pending_rows"), block.alias("codes"))
    status = F.when(F.size("codes") > 0, "blocked").when(F.col("review_items") + F.col("pending_rows") > 0, "requires_review").otherwise("ready_to_finalize")
    return x.withColumn("status", status)


def automatic(cards: DataFrame) -> DataFrame:
    """(card, action) for each review item: accept what can be resolved, defer the rest."""
    return candidates(cards).where(F.size("codes") > 0).select("card", F.when(F.size(problems()) > 0, "defer").otherwise("accept_suggested").alias("action"))


def resolved(cards: DataFrame, choices: DataFrame) -> DataFrame:
    """Cards after the user's choices (card, action, name, level, quality): edits replace values, exclusions and deferrals go, an accepted or edited fragment is rescued.

    `manual` marks edits; an accepted or edited card that still has problems isn't kept.
    """
    ch = choices.select("card", F.col("action").alias("_a"), F.col("name").alias("_n"), F.col("level").alias("_l"), F.col("quality").alias("_q"))
    edit, take = F.col("_a") == "edit", F.coalesce(F.col("_a").isin("edit", "accept_suggested"), F.lit(False))
    x = cards.join(ch, "card", "left").where(F.when(F.col("_a").isin("exclude", "defer"), False).otherwise(F.col("complete") | take))
    for f, new in (("name", "_n"), ("level", "_l"), ("quality", "_q")):
        x = x.withColumn(f, F.when(edit, F.col(new)).otherwise(F.col(f)))
    return x.withColumn("manual", F.coalesce(edit, F.lit(False))).where(~take | (F.size(problems()) == 0)).drop("_a", "_n", "_l", "_q")


def regrouped(cards: DataFrame, relations: DataFrame, choices: DataFrame) -> DataFrame:
    """(card, component) of every card: duplicate relations hold unless their row (user_id, k) is kept separate, pending ones where it is merged; both ends must be there."""
    r = relations.join(choices, ["user_id", "k"], "left")
    on = ((F.col("status") == "duplicate") & ~F.col("action").eqNullSafe(F.lit("keep_separate"))) | ((F.col("status") != "duplicate") & F.col("action").eqNullSafe(F.lit("merge")))
    here = cards.select("card")
    e = r.where(on).join(here.withColumnRenamed("card", "lhs"), "lhs", "left_semi").join(here.withColumnRenamed("card", "rhs"), "rhs", "left_semi")
    comp = connected_components(e.select(F.col("lhs").alias("a"), F.col("rhs").alias("b")))
    return here.join(comp.withColumnRenamed("node", "card"), "card", "left").select("card", F.coalesce("component", "card").alias("component"))


def primaries(cards: DataFrame, groups: DataFrame) -> DataFrame:
    """(component, primary): the first card by image, row, column and id."""
    return cards.join(groups, "card").groupBy("component").agg(F.min_by("card", F.struct("k", "r", "c", "card")).alias("primary"))


def merged_ids(cards: DataFrame, groups: DataFrame) -> DataFrame:
    """Cards that another one of their group stands for."""
    return groups.join(primaries(cards, groups), "component").where("card <> primary").select("card", "primary")


def settled(cards: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per component: one name, one legal level, and a quality (that of the manual members, else of the greatest confidence, then the first card).

    Reads card, k, r, c, name, level, quality, conf, manual. Components with several names, levels or manual qualities, or without one, have `ok` false.
    """
    legal = F.when(F.col("level").between(1, 60), F.col("level"))
    hand = F.when(F.col("manual"), F.col("quality"))
    least, most = F.min, F.max  # one distinct value is a least that is the greatest, which takes no copy of a row for each column counted
    g = cards.join(groups, "card").groupBy("component").agg(
        least("name").alias("name"), most("name").alias("name2"), least(legal).alias("level"), most(legal).alias("level2"), least(hand).alias("hand"), most(hand).alias("hand2"),
        least(F.struct((-F.col("conf")).alias("o"), "k", "r", "c", "card", "quality")).alias("sure"), least(F.struct("k", "r", "c", "card")).alias("first"), F.count("*").alias("members"),
    ).withColumn("primary", F.col("first.card"))
    same = lambda f: F.coalesce(F.col(f) == F.col(f"{f}2"), F.lit(False))
    quality = F.when(same("hand"), F.col("hand")).when(F.col("hand").isNull(), F.col("sure.quality"))
    ok = same("name") & same("level") & quality.isNotNull()
    show = lambda f: F.when(F.col("ok"), F.col(f)).alias(f)
    x = g.withColumn("quality", quality).withColumn("ok", ok).withColumn("quality_conflict", F.col("hand").isNotNull() & ~same("hand"))
    return x.select("component", "primary", "members", "ok", "quality_conflict", show("name"), show("level"), show("quality"))


def preview(cards: DataFrame, groups: DataFrame) -> DataFrame:
    """The inventory that the groups give; those that can't be settled are left out."""
    return settled(cards, groups).where("ok").select(F.col("primary").alias("instance"), "name", "level", "quality")


def bag_draft(fields: DataFrame) -> DataFrame:
    """(grp, current, current_status, capacity, capacity_status): only confirmed or candidate values of 0 or more; more than the capacity makes both unknown."""
    use = lambda f: F.when(F.col(f"{f}_status").isin("confirmed", "candidate") & (F.col(f) >= 0), F.col(f))
    x = fields.select("grp", use("current").alias("current"), use("capacity").alias("capacity"))
    over = F.coalesce(F.col("current") > F.col("capacity"), F.lit(False))
    return x.select("grp", F.when(~over, F.col("current")).alias("current"), F.when(~over, F.col("capacity")).alias("capacity"), F.when(over, "bag_count_exceeds_capacity").alias("code"))


def experience_draft(counts: DataFrame, colours: list[str]) -> DataFrame:
    """Per grp and colour the one value that all images agree on, or a conflict."""
    out = []
    for c in colours:
        v = F.when(F.col(c) >= 0, F.col(c))
        out += [F.count_distinct(v).alias(f"_n_{c}"), F.min(v).alias(f"_v_{c}")]
    g = counts.groupBy("grp").agg(*out)
    values = [F.when(F.col(f"_n_{c}") == 1, F.col(f"_v_{c}")).alias(c) for c in colours]
    codes = F.array_compact(F.array(*[F.when(F.col(f"_n_{c}") > 1, f"experience_{c}_conflict") for c in colours]))
    return g.select("grp", *values, codes.alias("codes"))


def unresolved(cards: DataFrame, choices: DataFrame) -> DataFrame:
    """Review items without a choice; none means that the resolution is complete."""
    return candidates(cards).where(F.size("codes") > 0).join(choices.select("card"), "card", "left_anti").select("user_id", "card")


def finalized(cards: DataFrame, groups: DataFrame, account: str) -> dict[str, DataFrame]:
    """The tables of a workspace that a resolved draft gives: the inventory, the members of each instance as evidence, and no plan targets."""
    done = settled(cards, groups).where("ok")
    mine = F.lit(account).alias("account_id")
    inventory = done.select(mine, F.col("primary").alias("instance"), "name", "level", "quality")
    evidence = groups.join(done.select("component", F.col("primary").alias("instance")), "component").select(mine, "instance", "card")
    targets = inventory.select("account_id", "instance", F.col("level").alias("target")).limit(0)
    return {"inventory": inventory, "evidence": evidence, "targets": targets}
