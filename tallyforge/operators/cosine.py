"""Exact join of vectors by cosine, without all pairs.

On the unit sphere angles obey the triangle inequality. Each bucket has pivots (rows of it, chosen by hash; they decide only how much is pruned), and a row's cell is its
nearest pivot and a ring of RINGS to a reach of angles around it. A row within `reach` of a row of another cell must be within reach of that cell's ring, the span of angles its rows have to their pivot, and its
angle to that pivot is at most 2 * reach above the angle to its own. So a row is compared with its own cell and with the cells after it that pass both tests, and only there are cosines taken.

A bucket's cells stand one after another and are cut into blocks of PART rows; a cell that holds a third of the rows is many blocks. A task has two blocks with their ids and given vectors, so a row is
shuffled once for each block that pivots don't rule out, not for each cell or row it is compared with, and the task gives the pairs with their scores. Pairs, which may be all of a bucket's, are neither
joined nor written: the result reads the blocks and takes them anew each time it is read.

Rows with a null bucket, id or vector, with a length of zero or one that overflows, or with a component that is null or not finite have no similarity and take part in no pair; vectors of different lengths
aren't compared. Rows of one id are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.operators.similarity import dot
from tallyforge.sources.tables import Scratch, written

PIVOTS, PART, RINGS = 256, 8192, 4
#: Angles are known to about 1e-7; those between pivots, without scaling, to 5e-4 near 0, where the arc cosine is steep.
_SLACK, _PIVOT_SLACK = 1e-6, 1e-3
#: So many cosines are taken at a time, with so many rows of the later block at most.
_AT_ONCE, _WIDE = 1 << 18, 1 << 9


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _utc(t: pa.Table) -> pa.Table:
    """Timestamps come in the session's time zone and go back in UTC, the same instants."""
    zoned = lambda f: f.with_type(pa.timestamp(f.type.unit, "UTC")) if pa.types.is_timestamp(f.type) and f.type.tz else f
    return t.cast(pa.schema([zoned(f) for f in t.schema]))


def _angles(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    v, p = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (v, p))
    return np.arccos(np.clip(v @ p.T, -1.0, 1.0))


def _homes(width: float):
    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        dim, pivots = rows["dim"][0].as_py(), pivots.sort_by("k")
        a = _angles(_matrix(rows["v"], dim), _matrix(pivots["u"], dim))
        pivot = a.argmin(1)
        r = a[np.arange(len(a)), pivot]
        out = _utc(rows.select(_ROW)).append_column("k", pivots["k"].take(pa.array(pivot)))
        return out.append_column("ring", pa.array((r // width).astype(np.int32))).append_column("r", pa.array(r))

    return run


_ROW = ["bucket", "dim", "row", "id", "v", "n"]
#: What a row of a task is: of the earlier block, of the later one (or of both, if they are one), or a pivot of the later one.
_LEFT, _RIGHT, _PIVOT = 0, 1, 2


class _Blocks:
    """The rows of a task: `left` and `right` are their places in it, the latter by cell; `one`: both are one block, in which a pair's left place is the lesser."""

    def __init__(self, t: pa.Table, reach: float):
        dim, side, self.cell, self.r, self.k = t["dim"][0].as_py(), *(t[c].to_numpy() for c in ("side", "cell", "r", "k"))
        right, pivot = np.flatnonzero(side == _RIGHT), np.flatnonzero(side == _PIVOT)
        self.reach, self.v, self.pivot, self.one = reach, _matrix(t["v"], dim), pivot[np.argsort(self.k[pivot])], not (side == _LEFT).any()
        self.right = right[np.argsort(self.cell[right], kind="stable")]
        self.left = self.right if self.one else np.flatnonzero(side == _LEFT)

    def tiles(self) -> Iterator[tuple[np.ndarray, int, int]]:
        """(x, lo, hi): the left rows x are to be compared with the right ones from lo to hi. Cells that the same rows are near to are taken together."""
        r, k, reach = self.r, self.k, self.reach
        cells, start = np.unique(self.cell[self.right], return_index=True)
        end = np.append(start[1:], len(self.right))
        least, most = np.minimum.reduceat(r[self.right], start), np.maximum.reduceat(r[self.right], start)
        at = np.searchsorted(k[self.pivot], k[self.right[start]])
        a, far = np.ascontiguousarray(_angles(self.v[self.left], self.v[self.pivot]).T), r[self.left] + 2 * reach
        near = lambda c: ((a[at[c]] <= most[c] + reach) & (a[at[c]] >= least[c] - reach) & (a[at[c]] <= far)).tobytes()
        for mask, run in groupby(range(len(cells)), near):
            run, mask = list(run), np.frombuffer(mask, bool)
            for lo in range(start[run[0]], stop := end[run[-1]], _WIDE):
                hi = min(lo + _WIDE, stop)
                x = np.flatnonzero(mask[:hi] if self.one else mask)
                yield from ((xs, lo, hi) for xs in np.array_split(x, max(1, len(x) * (hi - lo) // _AT_ONCE)) if len(xs))


def _pairs(reach: float):
    """(a, b, compared): two blocks, and how many cosines are taken between them."""

    def run(t: pa.Table) -> pa.Table:
        blocks = _Blocks(t, reach)
        of = lambda x, lo, hi: int(np.maximum(hi - np.maximum(lo, x + 1), 0).sum()) if blocks.one else len(x) * (hi - lo)
        return pa.table({"a": t["p"].slice(0, 1), "b": t["q"].slice(0, 1), "compared": [sum(of(*tile) for tile in blocks.tiles())]})

    return run


def _in_order(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of x[i] and y[j], summed from first to last as SQL does; a matrix product's order is its own."""
    total = np.zeros(len(i))
    for c in range(x.shape[1]):
        total += x[i, c] * y[j, c]
    return total


def _scored(least: float, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _utc(pa.Table.from_batches(batches))
        blocks, ids, n = _Blocks(t, reach), t["id"].combine_chunks(), t["n"].to_numpy()
        out = lambda i, j, s: pa.RecordBatch.from_arrays([pa.repeat(t["bucket"][0], len(i)), ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s)], names=["bucket", "a", "b", "score"])
        left, right, slack = blocks.left, blocks.right, (blocks.v.shape[1] + 8) * 2.3e-16
        vl, vr, nl, nr = blocks.v[left], blocks.v[right], n[left], n[right]
        yield out(left[:0], right[:0], n[:0])
        for x, lo, hi in blocks.tiles():
            v, norms = vl[x], nl[x, None] * nr[lo:hi]
            s = (v @ vr[lo:hi].T / norms + 1) / 2
            found = s >= least - slack
            if blocks.one:
                found &= x[:, None] < np.arange(lo, hi)
            i, j = np.nonzero(found)
            s = s[found]
            close = np.flatnonzero(s < least + slack)
            s[close] = (_in_order(v, vr[lo:hi], i[close], j[close]) / norms[i[close], j[close]] + 1) / 2
            s = np.clip(s, 0.0, 1.0)
            if not (over := s >= least).all():
                i, j, s = i[over], j[over], s[over]
            if len(i):
                yield out(left[x[i]], right[lo + j], s)

    return run


def _links(home: DataFrame, chosen: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(bucket, dim, p, q): blocks that may hold rows within reach of each other, p <= q; and the pivots (bucket, dim, q, k, u) of each block."""
    key = ["bucket", "dim"]
    ends = home.groupBy(*key, "block", "k").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    ends = written(ends.join(chosen, [*key, "k"]), "ends")
    far = ends.select(*key, F.col("block").alias("p"), F.col("hi").alias("far"), F.col("u").alias("v"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("u"), F.col("v")))))
    some = far.join(ends.withColumnRenamed("block", "q"), key).where("p < q").withColumn("angle", angle)
    near = F.col("angle") <= F.least(F.col("hi") + F.col("far"), 2 * F.col("far") + reach) + reach + _PIVOT_SLACK
    some = some.where(near & (F.col("lo") <= F.col("angle") + F.col("far") + reach + _PIVOT_SLACK)).select(*key, "p", "q")
    own = ends.select(*key, F.col("block").alias("p"), F.col("block").alias("q"))
    return written(some.unionByName(own).distinct(), "links"), ends.select(*key, F.col("block").alias("q"), "k", "u")


def join(rows: DataFrame, least: float, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(bucket, id, v) -> pairs (bucket, a, b, score) of rows of one bucket whose similarity (cosine + 1) / 2 is `least` or more, a's id before b's; and the
    number of cosines taken beside the number of all pairs, as one row (compared, pairs). Both are taken when they are read.
    """
    if least <= 0:
        raise ValueError("every pair has a similarity of 0 or more")
    cos = 2 * least - 1
    reach = math.acos(max(-1.0, min(1.0, cos))) + _SLACK
    with Scratch(rows.sparkSession, "cosine") as tmp:
        # written as it comes, as what v is made by may be dear and is needed many times below
        given = tmp.written(rows.select("bucket", "id", F.transform("v", lambda x: x.cast("double")).alias("v")).withColumn("row", F.monotonically_increasing_id()), "rows")
        x = given.where("bucket is not null and id is not null and size(v) > 0").where(F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < F.lit(math.inf)) & ~F.isnan(e)))
        x = x.withColumn("n", F.sqrt(dot(F.col("v"), F.col("v")))).where((F.col("n") > 0) & (F.col("n") < F.lit(math.inf))).withColumn("dim", F.size("v")).select(*_ROW)
        key = ["bucket", "dim"]
        sizes = written(x.groupBy(*key).agg(F.count("*").alias("rows")), "sizes")
        first = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row"), "row"))
        chosen = x.withColumn("k", first).where(F.col("k") <= pivots).join(sizes, key).where(F.col("k") <= F.ceil(F.sqrt("rows")))
        chosen = tmp.written(chosen.select(*key, "k", F.transform("v", lambda e: e / F.col("n")).alias("u")), "pivots")
        parts = F.ceil(F.col("rows") / PART).cast("int")
        dealt = x.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("row"), parts)).drop("rows")
        copies = lambda t: t.join(sizes, key).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).drop("rows")
        by = [*key, "part"]
        kinds = StructType([x.schema[c] for c in _ROW]).add("k", "integer").add("ring", "integer").add("r", "double")
        home = dealt.groupBy(*by).cogroup(copies(chosen).groupBy(*by)).applyInArrow(_homes(reach / RINGS), kinds)
        # a cell's number only has to tell it apart and give the cells of a bucket an order
        home = tmp.written(home.withColumn("cell", F.col("k") * F.lit(1 << 32) + F.col("ring")), "homes")
        tmp.drop(given)
        cells = home.groupBy(*key, "cell").agg(F.count("*").alias("n_cell"))
        before = F.sum("n_cell").over(Window.partitionBy(*key).orderBy("cell")) - F.col("n_cell")
        block = F.floor((F.col("before") + F.pmod(F.xxhash64("row"), F.col("n_cell"))) / PART)
        home = written(home.join(cells.withColumn("before", before), [*key, "cell"]).select(*key, "id", "v", "n", "k", "cell", "r", block.alias("block")), "blocks")
        links, pivots_of = _links(home, chosen, reach)
    task = [*key, "id", "v", "n", "k", "cell", "r", "p", "q", "side"]
    one = lambda at, side: home.withColumnRenamed("block", at).join(links if side == _RIGHT else links.where("p < q"), [*key, at]).withColumn("side", F.lit(side)).select(*task)
    none = {"id": F.lit(None).cast(home.schema["id"].dataType), "n": F.lit(1.0), "cell": F.lit(-1).cast("long"), "r": F.lit(0.0), "side": F.lit(_PIVOT)}
    theirs = pivots_of.join(links, [*key, "q"]).withColumnRenamed("u", "v").withColumns(none).select(*task)
    both = one("p", _LEFT).unionByName(one("q", _RIGHT)).unionByName(theirs).groupBy(*key, "p", "q")
    kinds = StructType([home.schema["bucket"]]).add("a", home.schema["id"].dataType).add("b", home.schema["id"].dataType).add("score", "double")
    pairs = both.applyInArrow(_scored(least, reach), kinds).select("bucket", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    zero = F.lit(0).cast("long")
    work = both.applyInArrow(_pairs(reach), "a long, b long, compared long").select("compared", zero.alias("pairs"))
    work = work.unionByName(sizes.select(zero.alias("compared"), F.expr("rows * (rows - 1) div 2").cast("long").alias("pairs")))
    return pairs, work.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("compared", "pairs")])
