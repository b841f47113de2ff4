import pytest
from pyspark.sql import functions as F

from tallyforge.functions import parse
from tallyforge.operators import components, consensus, draft, inventory, planning, sequence
from tallyforge.plans import entities


def col(df, name, key):
    return [r[name] for r in df.orderBy(key).collect()]


@pytest.mark.parametrize("text,want", [("1级", 1), ("60级", 60), ("0级", None), ("61级", None), ("-1级", None), ("6O级", 60), ("1 2", None), (None, None)])
def test_parse_level(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parse.level(F.col("t"))).first()[0] == want


def test_rules_expand(spark):
    got = {r.level: r.exp for r in planning.level_cost(spark).collect()}
    assert (got[1], got[30], got[31], got[60]) == (100, 3000, 4000, 4000)


@pytest.mark.parametrize("rules,word", [([(1, 59, 1, 0)], "60"), ([(1, 40, 1, 0), (40, 60, 1, 0)], "overlap")])
def test_rules_refuse(spark, rules, word):
    with pytest.raises(Exception, match=word):
        planning.expand_rules(spark.createDataFrame(rules, "start_level int, end_level int, first_exp int, step int")).collect()


def test_rounding_is_per_instance(spark):
    costs = spark.createDataFrame([(k, 955 if 10 <= k < 20 else 1) for k in range(1, 61)], "level int, exp long")
    items = spark.createDataFrame([("a", 10), ("b", 10)], "instance_id string, level int")
    goals = spark.createDataFrame([("a", 20), ("b", 20)], "instance_id string, target int")
    got = planning.requirement(items, goals, costs)
    assert got.agg(F.sum("rounded")).first()[0] == 19200
    stock = spark.createDataFrame([("k", 1, 2, 3), ("u", None, 2, 3)], "stock string, orange int, purple int, white int")
    rows = {r.stock: r for r in planning.gap(got.agg(F.sum("rounded").alias("required")), stock, 1000, 500, 100, 1500).collect()}
    assert rows["k"].owned == 2300 and rows["k"].gap == 16900 and rows["k"].runs == 12
    assert rows["u"].required == 19200 and rows["u"].gap is None and rows["u"].runs is None


def test_vote_margin(spark):
    v = spark.createDataFrame([(1, 60, 960), (1, 50, 200), (2, 5, 500), (2, 6, 450)], "grp long, value int, weight long")
    assert col(consensus.weighted_vote(v, 150), "value", "grp") == [60, None]


def test_sandwich_does_not_chain(spark):
    s = spark.createDataFrame([(1, k, v) for k, v in enumerate(["X", None, "X", None])], "image long, pos int, key string")
    assert col(sequence.sandwich(s), "key", "pos") == ["X", "X", "X", None]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 9), (7, 8), (None, 1)] + [(k, k + 1) for k in range(100, 160)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {4: 4, 5: 4, 9: 4, 7: 7, 8: 7} | {k: 100 for k in range(100, 161)}


def test_expand_and_terms(spark):
    x = spark.createDataFrame([(1, 2), (2, 0), (3, 3)], "id long, quantity long")
    assert inventory.expand(x).count() == 5
    assert inventory.terms(" a,b；a、c", {"c": "b"}) == ["a", "b"]


def test_image_orders_go_to_python_many_at_a_time(spark):
    from tallyforge.operators import overlap

    images = spark.createDataFrame([(b, i) for b in (1, 2, None) for i in (1, 2, 3)] + [(1, 3), (4, 9)], "batch long, image long")
    edges = spark.createDataFrame([(1, 3, 1), (1, 3, 1), (2, 1, 2), (2, 2, 1)], "batch long, before long, after long")
    x = overlap.image_order(images, edges)
    assert "FlatMapGroups" not in x._jdf.queryExecution().executedPlan().toString()
    got = {(r.batch, r.pos): (r.image, r.conflict) for r in x.collect()}
    want = {1: ([2, 3, 1], False), 2: ([1, 2, 3], True), None: ([1, 2, 3], False), 4: ([9], False)}
    assert got == {(b, k): (i, c) for b, (order, c) in want.items() for k, i in enumerate(order, 1)}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_kept_cards_are_a_table(spark):
    kept, groups = entities._regrouped(spark, "/root/testdata/sf0.001")
    assert "Window" not in plan_of(kept) and "Window" not in plan_of(groups)  # the cards of a user are not put in order anew for each use
    assert kept.count() == groups.count() > 100


def test_settled_takes_one_row_per_card(spark):
    rows = [
        (1, 1, 0, 0, "a", 3, 1, 50, False, 1), (2, 1, 0, 1, "a", 99, 2, 60, False, 1), (3, 1, 1, 0, "a", 3, 0, 60, False, 2), (4, 1, 1, 1, "b", 3, 0, 60, False, 2),
        (5, 0, 0, 0, None, 3, 0, 60, False, 5), (6, 2, 0, 0, "c", 4, 1, 60, True, 6), (7, 3, 0, 0, "c", 4, 2, 10, True, 6), (8, 2, 0, 0, "c", 4, 1, 60, True, 8), (9, 3, 0, 0, None, None, 2, 90, False, 8),
        (10, 3, 0, 0, "d", 5, None, 90, False, 10), (11, 3, 0, 0, "d", 5, None, 90, False, 11), (12, 2, 9, 9, "d", 5, 3, 90, False, 11), (13, 1, 0, 0, "e", 0, 1, 50, False, 13), (14, 1, 0, 0, "f", 6, None, None, True, 14), (15, 0, 0, 0, "f", 6, 2, None, False, 14),
    ]
    t = spark.createDataFrame(rows, "card long, k long, r int, c int, name string, level int, quality int, conf long, manual boolean, component long")
    got = draft.settled(t.drop("component"), t.select("card", "component"))
    want = {
        (1, 1, 2, True, False, "a", 3, 2), (2, 3, 2, False, False, None, None, None), (5, 5, 1, False, False, None, None, None), (6, 6, 2, False, True, None, None, None), (8, 8, 2, True, False, "c", 4, 1),
        (10, 10, 1, False, False, None, None, None), (11, 12, 2, True, False, "d", 5, 3), (13, 13, 1, False, False, None, None, None), (14, 15, 2, True, False, "f", 6, 2),
    }
    assert {tuple(r) for r in got.collect()} == want
    assert "Expand" not in plan_of(got)
