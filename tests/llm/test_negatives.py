"""The search against every pair: ties, nulls, repeated ids, several lengths, several slices and rounds, and sums beyond doubles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import negatives

SHAPE = "vec_id long, embedding array<float>, label int, a int, block long, id long"


def plain(rows, pos=5, neg=10):
    part = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            part[i, label, tuple(math.floor(256 * x) for x in e)] = None
    out = []
    for i, label, e in (x for x in part if x[0] % 100 == 0):
        s = sorted((-sum(x * y for x, y in zip(e, f)), j, m) for j, m, f in part if j != i and len(e) == len(f))
        for p, j, m in [x for x in s if x[2] == label][:pos]:
            fit = [(q, n) for q, n, m in s if m != label and 30 * -p <= 100 * -q <= 90 * -p][:neg]
            out += [(i, j, r, n, -p, -q) for r, (q, n) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SHAPE).repartition(3)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0).collect()))


def made(rng, n, dim, scale):
    f = lambda x: float(__import__("numpy").float32(x))
    return [(k, [f(rng.gauss(0, 1) * scale(k)) for _ in range(dim)], rng.randrange(3)) for k in range(n)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BUCKET", 16), ("SLICE", 2), ("BLOCK", 3)):
        monkeypatch.setattr(negatives, name, value)


def test_slices_rounds_and_odd_rows(spark, small):
    rng = random.Random(2)
    rows = made(rng, 700, 8, lambda k: 0.2 * (1 + k % 9))
    rows += [(1000 + k, rows[5][1], 1) for k in range(40)]  # ties
    rows += [rows[100], rows[7], (200, rows[9][1], 2), (7, rows[3][1], 0), (None, rows[1][1], 1), (2001, None, 1), (2002, [1.0, None], 1), (2003, [float("nan")] * 8, 1), (2004, [float("inf")] * 8, 1), (2100, rows[2][1], None)]
    rows += [(3000 + k, [rng.random() for _ in range(3)], k % 2) for k in range(0, 240, 4)]
    rows += [(5000, [], 1), (5001, [], 1), (5002, [], 0), (5100, [0.0] * 8, 1)]
    got = run(spark, rows)
    assert got == plain(rows) and len(got) > 200


def test_large_components(spark, small):
    rng = random.Random(3)
    rows = made(rng, 150, 4, lambda k: 10.0**5 if k % 3 else 1.0)
    assert run(spark, rows) == plain(rows)


def test_pruning_is_by_the_bound(spark, small):
    """A slice whose norms are too short for any window is not searched: its rows aren't even unpacked."""
    rng = random.Random(4)
    rows = made(rng, 400, 6, lambda k: 4.0 if k % 100 == 0 or k < 60 else 0.001)
    assert run(spark, rows) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(100, [1.0], 1)]) == []
