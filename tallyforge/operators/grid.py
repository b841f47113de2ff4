"""Grid rows from boxes (image, id, x, y, rad): the main radius, rows by running median, columns and a regular cadence.

An image is the unit of order: its rows are found by folds over its boxes in order of y. What is before the fold (radius counts) and after
it (slots, columns) is per radius or per row. Boxes with a null in any of the five columns are no boxes; ids tell equal places apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.tables import Scratch, written

#: Fixed shares, which decide what counts as one row, one radius or one column.
ROW_REACH, LEAST_ROW_REACH = 0.65, 12
SEED_REACH, MODE_REACH, LEAST_REACH = 0.09, 0.10, 3
SLOT_RADII, COLUMN_REACH = (0.82, 1.20), 0.075
CADENCE_REACH, CLOSE, EDGE_GAPS = 0.18, 0.60, (0.75, 1.45)
WIDTH = 4


def real(boxes: DataFrame) -> DataFrame:
    return boxes.dropna(subset=["image", "id", "x", "y", "rad"])


def middle(xs: Column) -> Column:
    """The median of an array of numbers."""
    s, n = F.array_sort(xs), F.size(xs)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def _mode(radii: np.ndarray, counts: np.ndarray) -> float | None:
    """The median radius of the largest set of boxes around one radius (the lesser median on ties, then the lesser radius); radii ascend."""
    before = np.concatenate([[0], np.cumsum(counts)])
    reach = np.floor(np.maximum(LEAST_REACH, radii * SEED_REACH))  # radii are whole numbers
    lo, hi = before[np.searchsorted(radii, radii - reach, "left")], before[np.searchsorted(radii, radii + reach, "right")]
    at = lambda k: radii[np.searchsorted(before, k, "right") - 1]
    centre = (at((lo + hi - 1) // 2) + at((lo + hi) // 2)) / 2
    best = np.lexsort((radii, centre, lo - hi))[0]
    return float(centre[best]) if hi[best] - lo[best] >= 2 else None


def _modes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        each = [_mode(np.array([x["rad"] for x in h]), np.array([x["n"] for x in h])) for h in f["h"]]
        yield pd.DataFrame({"key": f["key"], "centre": pd.array(each, "Float64")})


def main_radius(boxes: DataFrame) -> DataFrame:
    """The boxes of each image's main radius: those within a tenth (3 at least) of the median of the largest cluster.

    A cluster is what lies within 9 % (3 at least) of a box's radius; an image whose clusters are single boxes has none. Radii are whole numbers.
    Only counts per radius are gathered per image, so copies of a radius cost nothing.
    """
    b = real(boxes)
    h = b.groupBy("image", "rad").agg(F.count("*").alias("n")).groupBy("image").agg(F.sort_array(F.collect_list(F.struct("rad", "n"))).alias("h"))
    centres = h.select(F.col("image").cast("string").alias("key"), "h").mapInPandas(_modes, "key string, centre double")
    near = F.abs(F.col("rad") - F.col("centre")) <= F.greatest(F.lit(float(LEAST_REACH)), F.col("centre") * MODE_REACH)
    return b.withColumn("key", F.col("image").cast("string")).join(centres, "key").where(near).select(*boxes.columns)


def grid_rows(boxes: DataFrame) -> DataFrame:
    """image, row_no (from 0, downwards), members (y, id, x, rad) in order of y: a box is in the row if it is within reach of the median y of the row so far.

    The reach is 0.65 of the image's median radius, 12 at least. A gap of more than the reach to the box above always begins a row, so an image is
    cut there first and each stretch is folded by itself. As boxes come by y, the median so far is the middle of a slice, which needs no sorting.
    """
    b = real(boxes)
    reach = b.groupBy("image").agg(F.greatest(F.lit(float(LEAST_ROW_REACH)), F.median("rad") * ROW_REACH).alias("reach"))
    w = Window.partitionBy("image").orderBy("y", "id")
    cut = F.when(F.col("y") - F.lag("y").over(w) <= F.col("reach"), 0).otherwise(1)
    stretch = b.join(reach, "image").withColumn("cut", cut).withColumn("stretch", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = stretch.groupBy("image", "stretch").agg(F.first("reach").alias("reach"), F.sort_array(F.collect_list(F.struct("y", "id", "x", "rad"))).alias("m"))

    def step(starts: Column, i: Column) -> Column:
        first, y = F.element_at(starts, -1), lambda k: F.get("m", k).y
        so_far = (y(F.floor((first + i - 1) / 2).cast("int")) + y(F.floor((first + i) / 2).cast("int"))) / 2.0
        return F.when(F.abs(y(i) - so_far) <= F.col("reach"), starts).otherwise(F.concat(starts, F.array(i)))

    starts = F.when(F.size("m") == 1, F.array(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(1), F.size("m") - 1), F.array(F.lit(0)), step))
    m = m.select("image", "stretch", "m", starts.alias("starts"))
    cuts = F.transform("starts", lambda s, k: F.slice("m", s + 1, F.coalesce(F.get("starts", k + 1), F.size("m")) - s))
    each = m.select("image", "stretch", F.posexplode(cuts).alias("k", "members"))
    at = F.row_number().over(Window.partitionBy("image").orderBy("stretch", "k")) - 1
    return each.select("image", at.alias("row_no"), "members")


def column_centres(rows: DataFrame, views: DataFrame) -> DataFrame:
    """image, centres: the four leftmost x of the evenest row that has four (the upper one on ties), else where the profile has columns.

    views: image, vx, vw (left and width of the view) and profile (four shares of the width).
    """
    xs = F.slice(F.array_sort(F.transform("members", lambda b: b.x)), 1, WIDTH)
    full = rows.where(F.size("members") >= WIDTH).select("image", "row_no", xs.alias("xs"))
    gaps = F.transform(F.sequence(F.lit(1), F.lit(WIDTH - 1)), lambda k: F.get("xs", k) - F.get("xs", k - 1))
    evenest = full.groupBy("image").agg(F.min(F.struct((F.array_max(gaps) - F.array_min(gaps)).alias("odd"), "row_no", "xs")).alias("t"))
    given = F.transform("profile", lambda p: F.col("vx") + F.col("vw") * p)
    return views.join(evenest, "image", "left").select("image", F.coalesce(F.transform("t.xs", lambda x: x.cast("double")), given).alias("centres"))


def slots(rows: DataFrame, views: DataFrame) -> DataFrame:
    """image, row_no, y (the median of the slots'), slots (col, id, y): of each row and column the box nearest to the row's median radius, if it is near the column."""
    x = rows.join(column_centres(rows, views), "image").join(views.select("image", "vw"), "image")
    x = x.select("image", "row_no", "centres", "vw", middle(F.transform("members", lambda b: b.rad)).alias("radius"), F.posexplode("members").alias("k", "b"))
    near = F.array_min(F.transform("centres", lambda c, j: F.struct(F.abs(F.col("b.x") - c).alias("far"), j.alias("col"))))
    x = x.where(F.col("b.rad").between(F.col("radius") * SLOT_RADII[0], F.col("radius") * SLOT_RADII[1])).withColumn("near", near).where(F.col("near.far") <= F.col("vw") * COLUMN_REACH)
    best = x.groupBy("image", "row_no", F.col("near.col").alias("col")).agg(F.min(F.struct(F.abs(F.col("b.rad") - F.col("radius")).alias("odd"), "k", "b.id", "b.y")).alias("s"))
    each = best.groupBy("image", "row_no").agg(F.sort_array(F.collect_list(F.struct("col", "s.id", "s.y"))).alias("slots"))
    return each.select("image", "row_no", middle(F.transform("slots", lambda s: s.y)).alias("y"), "slots")


def _on_cadence(ys: Sequence[float], ns: Sequence[int], lo: float | None, hi: float | None) -> list[int]:
    """Rows near a multiple of the gap of full rows, the fullest of each multiple (the upper one on ties); all rows if under three are full."""
    full = [y for y, n in zip(ys, ns) if n == WIDTH]
    gaps = [b - a for a, b in zip(full, full[1:]) if b > a]
    if len(full) < 3 or not gaps:
        return list(range(len(ys)))
    gap = median([g for g in gaps if lo is None or lo <= g <= hi] or gaps)
    best: dict[int, int] = {}
    for k, (y, n) in enumerate(zip(ys, ns)):
        step = round((y - full[0]) / gap)
        if abs(y - (full[0] + step * gap)) <= gap * CADENCE_REACH and (step not in best or n > ns[best[step]]):
            best[step] = k
    return [best[s] for s in sorted(best)]


def _apart(rows: list[int], ys: Sequence[float], ns: Sequence[int], typical: float) -> list[int]:
    """One pass with a stack: of two rows too close to each other the one with fewer slots goes, or the one farther from the cadence, till all that are kept are apart."""
    kept: list[int] = []
    for place, row in enumerate(rows):
        while kept and ys[row] - ys[kept[-1]] < typical * CLOSE:
            above, ahead = kept[-1], rows[place + 1 : place + 2]
            upper_goes = ns[above] < ns[row]
            if ns[above] == ns[row] and len(kept) > 1 and ahead:
                upper_goes = abs(ys[above] - ys[kept[-2]] - typical) < abs(ys[ahead[0]] - ys[row] - typical)
            if not upper_goes:
                break
            kept.pop()
        else:
            kept.append(row)
    return kept


def regular(ys: Sequence[float], ns: Sequence[int], lo: float | None = None, hi: float | None = None) -> list[int]:
    """Which of an image's rows (their y and number of slots, downwards) are grid rows. lo, hi: the gaps that the profile allows."""
    rows = _on_cadence(ys, ns, lo, hi) if len(ys) > 1 else []
    if len(rows) < 2:
        return []
    gaps = sorted(b - a for a, b in zip((ys[r] for r in rows), (ys[r] for r in rows[1:])) if b > a)
    typical = median(gaps[len(gaps) // 2 :]) if gaps else 0.0
    if typical:
        rows = _apart(rows, ys, ns, typical)
    last = len(rows) - 1

    def stays(k: int) -> bool:
        if ns[rows[k]] >= 2:
            return True
        if not typical or not last or k not in (0, last):
            return False
        a, b = (rows[0], rows[1]) if k == 0 else (rows[k - 1], rows[k])
        return typical * EDGE_GAPS[0] <= ys[b] - ys[a] <= typical * EDGE_GAPS[1]

    return [r for k, r in enumerate(rows) if stays(k)]


def _regular(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        some = lambda x: None if pd.isna(x) else float(x)
        kept = [[r[k]["row_no"] for k in regular([float(x["y"]) for x in r], [int(x["n"]) for x in r], some(lo), some(hi))] for r, lo, hi in zip(f["rows"], f["lo"], f["hi"])]
        yield pd.DataFrame({"key": f["key"], "kept": kept})


def lattice(boxes: DataFrame, views: DataFrame) -> DataFrame:
    """image, row_no (from 0 among the rows kept), col, id: the boxes that make up each image's regular grid.

    views: image, vx, vw, vh, profile (four shares of the width), gap_lo and gap_hi (shares of the height between which row gaps lie, or null). Images without a view have no grid.
    Rows are gathered per image for the last step alone, as (row_no, y, number of slots): a row is at least 12 high, so they are few. Boxes and views are read more than once.
    """
    with Scratch(boxes.sparkSession, "lattice") as tmp:
        s = tmp.written(slots(tmp.written(grid_rows(boxes), "rows"), views), "slots")
        key = F.col("image").cast("string").alias("key")
        each = s.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("row_no", "y", F.size("slots").alias("n")))).alias("rows")).join(views.select("image", (F.col("vh") * F.col("gap_lo")).alias("lo"), (F.col("vh") * F.col("gap_hi")).alias("hi")), "image")
        kept = each.select(key, "rows", "lo", "hi").mapInPandas(_regular, "key string, kept array<int>").select("key", F.posexplode("kept").alias("at", "row_no"))
        x = s.withColumn("key", F.col("image").cast("string")).join(kept, ["key", "row_no"])
        return written(x.select("image", F.col("at").alias("row_no"), F.explode("slots").alias("s")).select("image", "row_no", "s.col", "s.id"), "lattice")
