"""Hard negatives by norm-bucketed search: for an anchor and each of its positives, the best rows of other labels within a window of scores.

Candidates stand by norm, longest first, in buckets of BUCKET rows; SLICE buckets are a slice, which one task reads for one block of BLOCK anchors.
By Cauchy-Schwarz no row of a bucket scores above |anchor| * (longest norm of the bucket). A bucket is left out for a window if that
bound is under the window's lower limit or under its running k-th score, and a whole slice if it is so for all windows of a block. Slices are
searched in rounds of 1, 4, 16, ... from the longest norms down; between rounds the best rows of all slices are merged, so later rounds start
from the running k-th scores of the earlier ones. What is pruned can't be in the result, so the search is exact.
Anchors are a fixed share of the rows and meet the others in blocks; buckets and blocks hold a bounded number of rows whatever the labels or norms.

A component x counts as floor(256 * x), scores are integers: sums are exact in doubles while |a| * |b| < 2**53, and else done in 64-bit integers. Rows with a null id,
label, vector or component, a component that is not finite, or a squared norm of 2**62 or more (whose scores no long holds) take no part; wholly
repeated rows count once; rows of one id that differ are rows of their own, of which none is another's positive or negative. Ties go to the smaller id.
Only vectors of one length are compared. Columns besides the three named aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.places import placed
from tallyforge.sources.tables import Scratch, written

BUCKET, SLICE, BLOCK = 1024, 16, 1024
SCALE, GROW = 256, 4
POSITIVES, NEGATIVES = 5, 10
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
LIMIT = 2.0**62
_EXACT = 2.0**53
_PACK = "dim int, part long, top double, n int, ids binary, labels binary, matrix binary, kind string"
_WIN = np.dtype([("a", "<i4"), ("w", "<i4"), ("need", "<i8"), ("hi", "<i8")])
_BOTTOM, _TOP = -(2**63), 2**63 - 1


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, v (scaled components), n2 (squared norm), dim; each distinct row that takes part once."""
    part = rows.select("vec_id", "label", "embedding").where("vec_id is not null and label is not null and embedding is not null")
    x = F.transform("embedding", lambda e: F.floor(F.lit(float(SCALE)) * e.cast("double")))
    part = part.where(F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < 2.0**31)))
    part = part.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("v"))
    n2 = F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double"))
    return part.withColumn("n2", n2).where(F.col("n2") < LIMIT).withColumn("dim", F.size("v")).distinct()


def _pack(key: tuple, t: pa.Table) -> pa.Table:
    """The rows of a bucket or block as one row."""
    t = t.sort_by("i")
    n, dim = t.num_rows, key[0].as_py()
    m = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dim)
    most = int(np.abs(m).max(initial=0))
    m = m.astype(next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max))
    ids, labels = (t[c].to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label"))
    return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "top": [float(t["n2"][0].as_py())], "n": pa.array([n], pa.int32()), "ids": [ids], "labels": [labels], "matrix": [m.tobytes()], "kind": [m.dtype.str]})


def _packed(rows: DataFrame, size: int) -> DataFrame:
    return rows.select("dim", F.floor(F.col("i") / size).alias("part"), "i", "vec_id", "label", "v", "n2").groupBy("dim", "part").applyInArrow(_pack, _PACK)


def _pack_windows(key: tuple, t: pa.Table) -> pa.Table:
    w = np.empty(t.num_rows, _WIN)
    for c in _WIN.names:
        w[c] = t[c].to_numpy()
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "win": [w.tobytes()]})


def _best(w: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each window, by score and then id."""
    order = np.lexsort((ids, -score, w))
    ws = w[order]
    first = np.searchsorted(ws, ws)
    return order[np.arange(len(ws)) - first < k]


def _search(k: int, same: bool):
    """The function of one block and one slice: its row `place` = -1 is the block with its windows, the others are buckets, longest first."""

    def matrix(r: dict) -> np.ndarray:
        return np.frombuffer(r["matrix"], r["kind"]).reshape(r["n"], r["dim"])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        own, *buckets = t.sort_by("place").to_pylist()
        a, aid, alabel = matrix(own), np.frombuffer(own["ids"], "<i8"), np.frombuffer(own["labels"], "<i8")
        win = np.frombuffer(own["win"], _WIN)
        need, wa = win["need"].copy(), win["a"]
        n2 = (a.astype(np.float64) ** 2).sum(1)
        gw, gs, gi = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for r in buckets:
            lower = np.maximum(need.astype(np.float64), 0)
            alive = np.flatnonzero(lower**2 <= n2[wa] * r["top"] * (1 + 1e-9))
            if not len(alive):
                break
            c, cid, clabel = matrix(r), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8")
            kind = np.float64 if (n2.max(initial=0) * r["top"]) ** 0.5 < _EXACT / 2 else np.int64
            cols = c.astype(kind).T
            for lo in range(0, len(alive), BLOCK):
                part = alive[lo : lo + BLOCK]
                rows, at = np.unique(wa[part], return_inverse=True)
                s = (a[rows].astype(kind) @ cols)[at]
                anchor = wa[part]
                ok = (s >= need[part, None]) & (s <= win["hi"][part, None]) & ((clabel == alabel[anchor, None]) == same) & (cid != aid[anchor, None])
                x, y = np.nonzero(ok)
                gw, gs, gi = np.concatenate([gw, part[x]]), np.concatenate([gs, s[x, y].astype(np.int64)]), np.concatenate([gi, cid[y]])
            keep = _best(gw, gs, gi, k)
            gw, gs, gi = gw[keep], gs[keep], gi[keep]
            full = np.flatnonzero(np.bincount(gw, minlength=len(win)) == k)
            if len(full):
                last = np.searchsorted(gw, full, "right") - 1  # gw is in order, the k-th of a full window is its last
                need[full] = np.maximum(need[full], gs[last])
        names = ("dim", "block")
        return pa.table({n: pa.array([v.as_py()] * len(gw), ty) for n, v, ty in zip(names, key, (pa.int32(), pa.int64()))} | {"a": win["a"][gw], "w": win["w"][gw], "id": gi, "score": gs})

    return run


def search(tmp: Scratch, blocks: DataFrame, buckets: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """dim, block, a, w, id, score: the k best rows of each window (dim, block, a, w, n2, lo, hi) whose label is (same) or isn't the anchor's."""
    slices = tmp.written(buckets.groupBy("dim", F.floor(F.col("part") / SLICE).alias("slice")).agg(F.max("top").alias("top")), "slices")
    n = (slices.agg(F.max("slice")).first()[0] or 0) + 1
    keys, best, lo, width = ["dim", "block", "a", "w"], None, 0, 1
    own = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    while lo < n or best is None:
        now = windows.select(*keys, "n2", "hi", F.col("lo").alias("need"))
        if best is not None:
            kth = best.groupBy(*keys).agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
            now = now.join(kth, keys, "left").withColumn("need", F.greatest("need", F.coalesce("kth", "need"))).drop("kth")
        now = tmp.written(now, "windows-of-round")
        # the least squared norm with which a candidate can matter to any window of the block
        lower = F.when(F.col("need") <= 0, 0.0).otherwise(F.col("need").cast("double") * F.col("need").cast("double") / F.col("n2"))
        state = now.groupBy("dim", "block").agg(F.min(lower).alias("least"))
        due = slices.where((F.col("slice") >= lo) & (F.col("slice") < lo + width))
        pairs = tmp.written(state.join(due, "dim").where("least <= top * (1 + 1e-9)").select("dim", "block", "slice"), "pairs")
        win = now.select("dim", F.col("block").alias("part"), "a", "w", "need", "hi").groupBy("dim", "part").applyInArrow(_pack_windows, "dim int, part long, win binary")
        anchors = blocks.join(win, ["dim", "part"]).withColumn("block", F.col("part")).join(pairs, ["dim", "block"]).withColumn("place", F.lit(-1).cast("long"))
        others = buckets.withColumn("slice", F.floor(F.col("part") / SLICE)).join(pairs, ["dim", "slice"]).withColumn("place", F.col("part")).withColumn("win", F.lit(None).cast("binary"))
        columns = ["dim", "block", "slice", "place", "top", "n", "ids", "labels", "matrix", "kind", "win"]
        found = anchors.select(*columns).unionByName(others.select(*columns)).groupBy("dim", "block", "slice")
        found = found.applyInArrow(_search(k, same), "dim int, block long, a int, w int, id long, score long")
        found = found if best is None else found.unionByName(best)
        best = tmp.written(found.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).drop("r"), "best")
        lo, width = lo + width, width * GROW
    return best


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, label, embedding; is_anchor is asked of vec_id."""
    with Scratch(rows.sparkSession, "negatives") as tmp:
        v = tmp.written(vectors(rows), "vectors")
        order = [F.desc("n2"), F.asc("vec_id"), F.asc("label"), F.asc("v")]
        buckets = tmp.written(_packed(placed(tmp, v, ["dim"], order, "i", "of"), BUCKET), "packed-buckets")
        anchors = tmp.written(placed(tmp, v.where(is_anchor), ["dim"], order, "i", "of"), "anchors")
        blocks = tmp.written(_packed(anchors, BLOCK), "packed-blocks")
        at = anchors.select("dim", F.floor(F.col("i") / BLOCK).alias("block"), (F.col("i") % BLOCK).cast("int").alias("a"), "n2", F.col("vec_id").alias("anchor_id"))
        every = at.select("*", F.lit(0).alias("w"), F.lit(_BOTTOM).alias("lo"), F.lit(_TOP).alias("hi"))
        found = search(tmp, blocks, buckets, every, positives, True)
        rank = F.row_number().over(Window.partitionBy("dim", "block", "a").orderBy(F.desc("score"), F.asc("id")))
        found = found.select("dim", "block", "a", rank.alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")
        p = F.col("positive_score").cast("decimal(38,0)")
        limits = {"lo": F.ceil(p * LOW / 100).cast("long"), "hi": F.floor(p * HIGH / 100).cast("long")}
        windows = tmp.written(found.join(at, ["dim", "block", "a"]).withColumns(limits), "windows")
        best = search(tmp, blocks, buckets, windows, negatives, False)
        rank = F.row_number().over(Window.partitionBy("dim", "block", "a", "w").orderBy(F.desc("score"), F.asc("id")))
        out = best.withColumn("rank", rank).join(windows, ["dim", "block", "a", "w"])
        return written(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")


def relabelled(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding; where 7 divides vec_id, the label is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), "embedding")


#: DuckDB SQL of mine over relabelled embeddings, by every anchor's score with every row.
SQL = f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
