"""Rows, main radius and lattice against plain versions over whole tables; overlaps and suppression at any radius against all pairs."""

import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import geometry, grid
from tallyforge.plans import grids

SHAPE = "image long, id long, x int, y int, rad int"


def images(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.image].append((r.id, r.x, r.y, r.rad))
    return out


def plain_mode(boxes):
    best = []
    for seed in sorted(boxes, key=lambda b: b[3]):
        near = [b for b in boxes if abs(b[3] - seed[3]) <= max(3, seed[3] * 0.09)]
        if len(near) > len(best) or len(near) == len(best) and median(b[3] for b in near) < median(b[3] for b in best):
            best = near
    if len(best) < 2:
        return []
    centre = median(b[3] for b in best)
    return [b for b in boxes if abs(b[3] - centre) <= max(3, centre * 0.10)]


def plain_rows(boxes):
    reach, rows = max(12, median(b[3] for b in boxes) * 0.65) if boxes else 0, []
    for b in sorted(boxes, key=lambda b: (b[2], b[0])):
        if rows and abs(b[2] - median(r[2] for r in rows[-1])) <= reach:
            rows[-1].append(b)
        else:
            rows.append([b])
    return rows


def plain_lattice(boxes, vx, vw, vh, profile, lo, hi):
    """Lists of lists, and rows taken out one at a time from the top."""
    rows = plain_rows(boxes)
    centres, least = [vx + vw * p for p in profile], None
    for r in rows:
        xs = sorted(b[1] for b in r)[:4]
        if len(r) >= 4:
            gaps = [xs[1] - xs[0], xs[2] - xs[1], xs[3] - xs[2]]
            if least is None or max(gaps) - min(gaps) < least:
                centres, least = [float(x) for x in xs], max(gaps) - min(gaps)
    made = []
    for r in rows:
        radius, found = median(b[3] for b in r), {}
        for b in r:
            far = [abs(b[1] - c) for c in centres]
            col = far.index(min(far))
            if radius * 0.82 <= b[3] <= radius * 1.2 and far[col] <= vw * 0.075 and (col not in found or abs(b[3] - radius) < abs(found[col][3] - radius)):
                found[col] = b
        if found:
            made.append((median(b[2] for b in found.values()), [(c, found[c][0]) for c in sorted(found)]))
    if len(made) < 2:
        return []
    full = [y for y, s in made if len(s) == 4]
    gaps = [b - a for a, b in zip(full, full[1:]) if b > a]
    if len(full) >= 3 and gaps:
        fit = gaps if lo is None else [g for g in gaps if vh * lo <= g <= vh * hi]
        gap, at = median(fit or gaps), {}
        for row in made:
            k = round((row[0] - full[0]) / gap)
            if abs(row[0] - full[0] - k * gap) <= gap * 0.18 and len(row[1]) > len(at.get(k, (0, []))[1]):
                at[k] = row
        made = [at[k] for k in sorted(at)]
        if len(made) < 2:
            return []
    gaps = sorted(b[0] - a[0] for a, b in zip(made, made[1:]) if b[0] > a[0])
    typical = median(gaps[len(gaps) // 2 :]) if gaps else 0
    while typical:
        close = next((k for k in range(len(made) - 1) if made[k + 1][0] - made[k][0] < typical * 0.6), None)
        if close is None:
            break
        a, b = len(made[close][1]), len(made[close + 1][1])
        gone = close if a < b else close + 1
        if a == b and 0 < close < len(made) - 2:
            before, after = made[close][0] - made[close - 1][0], made[close + 2][0] - made[close + 1][0]
            gone = close if abs(before - typical) < abs(after - typical) else close + 1
        del made[gone]
    out = []
    for k, (y, s) in enumerate(made):
        gap = made[1][0] - y if k == 0 else y - made[k - 1][0] if k == len(made) - 1 else 0
        if len(s) >= 2 or typical and typical * 0.75 <= gap <= typical * 1.45:
            out.append(s)
    return [(k, c, i) for k, s in enumerate(out) for c, i in s]


def grid_like(rng, image):
    """A grid with jitter, missing cells, rings of other sizes and ornaments between the rows."""
    r, gap = rng.randrange(14, 40), rng.randrange(70, 140)
    out, y = [], 60
    for _ in range(rng.randrange(1, 9)):
        out += [(100 + 90 * c + rng.randrange(-6, 7), y + rng.randrange(-5, 6), r + rng.randrange(-2, 3)) for c in range(4) if rng.random() < 0.85]
        if rng.random() < 0.3:
            out += [(100 + 90 * rng.randrange(4), y + gap // rng.choice([2, 3, 4]), r + rng.randrange(-1, 2)) for _ in range(rng.randrange(1, 4))]
        y += gap * (2 if rng.random() < 0.12 else 1) + rng.randrange(-4, 5)
    out += [(rng.randrange(500), rng.randrange(900), rng.randrange(5, 120)) for _ in range(rng.randrange(5))]
    return [(image, k, *b) for k, b in enumerate(out)]


VIEW = (20, 480, 900, [0.2, 0.4, 0.6, 0.8])


def test_lattice_on_grids(spark):
    rng = random.Random(6)
    rows = [b for image in range(250) for b in grid_like(rng, image)]
    boxes = spark.createDataFrame([*rows, (None, 1, 2, 3, 4), (1, None, 2, 3, 4)], SHAPE)
    limits = lambda i: (0.08, 0.16) if i % 2 else (None, None)
    views = spark.createDataFrame([(i, *VIEW[:3], VIEW[3], *limits(i)) for i in range(250)], "image long, vx int, vw int, vh int, profile array<double>, gap_lo double, gap_hi double")
    got = defaultdict(list)
    for r in grid.lattice(grid.main_radius(boxes), views).collect():
        got[r.image].append((r.row_no, r.col, r.id))
    want = {i: plain_lattice(plain_mode(b), VIEW[0], VIEW[1], VIEW[2], VIEW[3], *limits(i)) for i, b in images(boxes.where("image is not null and id is not null")).items()}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert sum(len(x) for x in want.values()) > 2000


def test_a_drifting_chain_is_cut_by_the_median(spark):
    boxes = [(1, k, 10, 10 * k, 20) for k in range(12)]  # each gap is within reach, the chain as a whole isn't
    rows = grid.grid_rows(spark.createDataFrame(boxes, SHAPE)).orderBy("row_no").collect()
    assert [[b.id for b in r.members] for r in rows] == [[b[0] for b in r] for r in plain_rows([b[1:] for b in boxes])] and len(rows) > 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    boxes = grids.event_boxes(spark, d)
    plain = images(boxes)
    rows = defaultdict(list)
    for r in grids.grid_rows(spark, d).collect():
        rows[r.image].append((r.row_no, r.id))
    assert {i: sorted(x) for i, x in rows.items()} == {i: sorted((k, b[0]) for k, row in enumerate(plain_rows(bs)) for b in row) for i, bs in plain.items()}
    kept = defaultdict(set)
    for r in grids.main_radius(spark, d).collect():
        kept[r.image].add(r.id)
    assert kept == {i: {b[0] for b in m} for i, bs in plain.items() if (m := plain_mode(bs))}
    got = defaultdict(list)
    for r in grids.lattice_rows(spark, d).collect():
        got[r.image].append((r.row_no, r.col, r.id))
    want = {i: plain_lattice(plain_mode(bs), 0, 480, 1000, grids.PROFILE, *grids.GAPS) for i, bs in plain.items()}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x} and got


def clashes(a, b):
    side = lambda k: max(0, min(a[k] + a[3], b[k] + b[3]) - max(a[k] - a[3], b[k] - b[3]))
    cut, both = side(1) * side(2), 4 * a[3] ** 2 + 4 * b[3] ** 2
    gap = (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
    return cut, both, 10_000 * gap <= 3025 * min(a[3], b[3]) ** 2 or cut > 0 and 100 * cut >= 58 * (both - cut)


def test_boxes_of_any_radius(spark):
    rng = random.Random(8)
    rows = [(i, k, rng.randrange(-30_000, 30_000), rng.randrange(-30_000, 30_000), int(10 ** rng.uniform(0, 4))) for i in range(2) for k in range(250)]
    rows += [(2, k, rng.randrange(100), rng.randrange(100), rng.choice([0, 1, 7, 8, 9, 63, 64, 65, 10_000])) for k in range(120)]
    rows += [(3, 0, 0, 0, 200), (3, 1, 250, 0, 200), (4, 0, 0, 0, 30_000), (4, 1, 1, 1, 30_000)]
    df = spark.createDataFrame(rows, SHAPE)
    got = {(r.image, r.a, r.b): r.iou for r in geometry.overlaps(df).collect()}
    want, kept = {}, set()
    for i, bs in images(df).items():
        for m, a in enumerate(bs):
            for b in bs[m + 1 :]:
                a, b = sorted((a, b))
                cut, both, _ = clashes(a, b)
                if cut:
                    want[i, a[0], b[0]] = 10_000 * cut // (both - cut)
        stay = []
        for b in sorted(bs, key=lambda b: (-b[3], b[0])):
            if not any(clashes(s, b)[2] for s in stay):
                stay.append(b)
        kept |= {(i, b[0]) for b in stay}
    assert got == want
    assert {(r.image, r.id) for r in geometry.nms(df).collect()} == kept


def test_completeness(spark):
    rows = [(100, 100, 20), (10, 100, 20), (100, 15, 20), (100, 290, 20), (100, 100, 3), (22, 100, 20), (100, 262, 20), (100, 263, 20)]
    bounds = [F.lit(v) for v in (0, 0, 200, 300)]
    df = spark.createDataFrame(rows, "x int, y int, rad int").select(geometry.completeness(F.col("x"), F.col("y"), F.col("rad"), *bounds))

    def plain(x, y, r):
        parts = [(x - r, y - r, 2 * r, 2 * r), (int(x - r * 0.92), int(y + r * 1.08), int(r * 1.84), max(12, int(r * 0.62))), (int(x + r * 0.02), int(y - r * 1.06), int(r * 1.08), max(12, int(r * 0.58)))]
        if any(p[0] < 0 or p[0] + p[2] > 200 for p in parts):
            return "invalid"
        return "partial_top" if any(p[1] < 0 for p in parts) else "partial_bottom" if any(p[1] + p[3] > 300 for p in parts) else "complete"

    got = [r[0] for r in df.collect()]
    assert got == [plain(*r) for r in rows] and set(got) == {"complete", "invalid", "partial_top", "partial_bottom"}


def pairs_of(df):
    return sorted((r.image, r.a.id, r.b.id) for r in geometry._neighbours(df).where("a.x + b.x + a.rad + b.rad is not null").select("image", "a", "b").collect() if max(abs(r.a.x - r.b.x), abs(r.a.y - r.b.y)) < r.a.rad + r.b.rad)


def test_small_images_need_no_cells(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, k, rng.randrange(300), rng.randrange(300), rng.randrange(1, 60)) for i in range(6) for k in range(geometry.FEW - 2 + i)]
    df = spark.createDataFrame([*rows, (None, 1, 2, 3, 4), (1, 900, 2, 3, None), (0, 901, None, 3, 4)], SHAPE)
    both = pairs_of(df)
    for few in (0, 1000):
        monkeypatch.setattr(geometry, "FEW", few)
        assert pairs_of(df) == both and len(both) > 1500


@pytest.mark.parametrize("made", [geometry.overlaps, geometry._neighbours])
def test_boxes_are_never_broadcast(spark, tmp_path, made):
    spark.createDataFrame([(i // 4, i, i % 50, i % 60, 1 + i % 9) for i in range(400)], SHAPE).write.parquet(str(tmp_path / "boxes"))
    plan = made(spark.read.parquet(str(tmp_path / "boxes")))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_slots_take_medians_once_per_row(spark):
    boxes = spark.createDataFrame([(1, k, 110 * (k % 4) + 72, 80 * (k // 4), 20) for k in range(12)], SHAPE)
    views = spark.createDataFrame([(1, 0, 480, [0.15, 0.38, 0.62, 0.85])], "image long, vx int, vw int, profile array<double>")
    s = grid.slots(grid.grid_rows(boxes), views)
    assert s._jdf.queryExecution().optimizedPlan().toString().count("array_sort") < 10  # a filter on computed slots brings in all they are made of, per box
    assert sorted((r.row_no, len(r.slots)) for r in s.collect()) == [(0, 4), (1, 4), (2, 4)]


def test_radius_mode_keeps_a_row_per_radius(spark):
    rng = random.Random(9)
    rows = [(k % 30 if k % 41 else None, k, 0, 0, rng.randrange(1, 40) if k % 37 else None) for k in range(900)]
    got = geometry.radius_mode(spark.createDataFrame(rows, SHAPE), 2)
    radii = defaultdict(list)
    for i, *_, r in rows:
        if i is not None and r is not None:
            radii[i].append(r)
    want = {(i, *min(((-sum(abs(x - c) <= 2 for x in rs), c) for c in set(rs)))[::-1]) for i, rs in radii.items()}
    assert {(r.image, r.centre, -r.members) for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no copies of a radius for each one near it
