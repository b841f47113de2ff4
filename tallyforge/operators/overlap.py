"""Alignment of overlapping images by the longest suffix/prefix of full rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_rows(cells: DataFrame) -> DataFrame:
    """One row per grid row with all four columns, and its cells in column order."""
    cell = F.struct("c", "name", "level")
    return cells.groupBy("user_id", "k", "r").agg(F.count_distinct("c").alias("w"), F.sort_array(F.collect_list(cell)).alias("cells")).where("w = 4").drop("w")


def align(cells: DataFrame, rule: str) -> DataFrame:
    """(user_id, k, len) of the longest alignment of image k's last rows with the first of image k + 1.

    browser: no known mismatch and one row equal throughout; rebuild: no known mismatch; strict: all cells equal.
    """
    image = full_rows(cells).groupBy("user_id", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "cells"))), lambda x: x.cells).alias("rows"))
    after = image.select("user_id", (F.col("k") - 1).alias("k"), F.col("rows").alias("next"))
    p = image.join(after, ["user_id", "k"])

    def row(x, y):
        same = lambda a, b: (a["name"] == b["name"]) & (a["level"] == b["level"])
        z = F.zip_with(x, y, lambda a, b: F.struct(F.coalesce((a["name"] != b["name"]) | (a["level"] != b["level"]), F.lit(False)).alias("bad"), F.coalesce(same(a, b), F.lit(False)).alias("same")))
        return F.struct(F.exists(z, lambda q: q.bad).alias("bad"), F.forall(z, lambda q: q.same).alias("same"))

    def valid(n):
        z = F.zip_with(F.slice("rows", F.size("rows") - n + 1, n), F.slice("next", F.lit(1), n), row)
        clean, anchor, equal = ~F.exists(z, lambda q: q.bad), F.exists(z, lambda q: q.same), F.forall(z, lambda q: q.same)
        return {"browser": clean & anchor, "rebuild": clean, "strict": equal}[rule]

    # every length that both images have
    lengths = F.filter(F.sequence(F.lit(1), F.least(F.size("rows"), F.size("next"))), valid)
    return p.select("user_id", "k", F.array_max(lengths).cast("long").alias("len")).where("len is not null")


def identified_rows(cells: DataFrame, names: int = 2) -> DataFrame:
    """Full rows in which at least `names` cells have a confirmed name: (user_id, k, r, cells), cells of (c, name, level, quality), and icon, a 64-bit hash of what is seen, where there is one."""
    cell = F.struct("c", "name", "level", "quality", *[x for x in ("icon",) if x in cells.columns])
    rows = cells.groupBy("user_id", "k", "r").agg(F.count_distinct("c").alias("w"), F.count("name").alias("known"), F.sort_array(F.collect_list(cell)).alias("cells"))
    return rows.where(f"w = 4 and known >= {names}").select("user_id", "k", "r", "cells")


def continuous(rows: DataFrame) -> DataFrame:
    """Per image its rows without a gap in r: `suffix` from the last row up, `prefix` from the first down, both in order."""
    all_ = F.sort_array(F.collect_list(F.struct("r", "cells")))
    x = rows.groupBy("user_id", "k").agg(all_.alias("rows"))
    # a row belongs to the prefix if its number less its place is the first's, to the suffix if it is the last's
    step = F.transform("rows", lambda v, i: v.r - i)
    x = x.withColumn("_s", step)
    pick = lambda which: F.filter("rows", lambda v, i: F.get("_s", i) == which)
    return x.select("user_id", "k", pick(F.get("_s", F.lit(0))).alias("prefix"), pick(F.element_at("_s", -1)).alias("suffix"))


def row_verdict(a, b, visual: bool = False):
    """How two rows of four cells compare: a known name, level or quality that differs is no overlap; all names and levels known and equal confirm it;
    two agreements, two of them names, leave it pending; else the rows say nothing.

    visual: icons that agree in half of their bits or less veto a confirmed or pending row.
    """

    def cell(x, y):
        name, level, quality = (x[f].isNotNull() & y[f].isNotNull() for f in ("name", "level", "quality"))
        differ = (name & (x["name"] != y["name"])) | (level & (x["level"] != y["level"])) | (quality & (x["quality"] != y["quality"]))
        apart = F.bit_count(x["icon"].bitwiseXOR(y["icon"])) >= 32 if visual else F.lit(False)
        return F.struct(F.coalesce(differ, F.lit(False)).alias("differ"), name.alias("name"), level.alias("level"), F.coalesce(apart, F.lit(False)).alias("apart"))

    z = F.zip_with(a, b, cell)
    count = lambda f: F.size(F.filter(z, f))
    names, levels = count(lambda q: q["name"]), count(lambda q: q["level"])
    ignored = ~((names + levels >= 2) & (names >= 2))
    veto = F.exists(z, lambda q: q["differ"]) | (~ignored & F.exists(z, lambda q: q["apart"]))
    return F.when(veto, "no_overlap").when((names == 4) & (levels == 4), "confirmed").when(~ignored, "pending").otherwise("ignored")


def align_targeted(cells: DataFrame) -> DataFrame:
    """(user_id, k, len, confirmed): the longest end of image k that is the start of image k + 1, over continuous identified rows.

    It has at least one confirmed row and none that differs or says nothing. With a column icon, what is seen may veto a row.
    """
    visual = "icon" in cells.columns
    image = continuous(identified_rows(cells))
    after = image.select("user_id", (F.col("k") - 1).alias("k"), F.col("prefix").alias("next"))
    p = image.select("user_id", "k", F.col("suffix").alias("rows")).join(after, ["user_id", "k"])

    def verdicts(n):
        return F.zip_with(F.slice("rows", F.size("rows") - n + 1, n), F.slice("next", F.lit(1), n), lambda x, y: row_verdict(x.cells, y.cells, visual))

    def valid(n):
        v = verdicts(n)
        return ~F.exists(v, lambda q: q.isin("no_overlap", "ignored")) & F.exists(v, lambda q: q == "confirmed")

    best = F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.size("rows"), F.size("next"))), valid))
    x = p.withColumn("len", best).where("len is not null")
    return x.select("user_id", "k", F.col("len").cast("long").alias("len"), F.size(F.filter(verdicts(F.col("len")), lambda q: q == "confirmed")).cast("long").alias("confirmed"))


def align_with_evidence(cells: DataFrame) -> DataFrame:
    """(user_id, k, len, status): the browser alignment, or where there is none, the longest attempt in which a row differs, as evidence of a conflict."""
    found = align(cells, "browser").select("user_id", "k", "len", F.lit("aligned").alias("status"))
    image = full_rows(cells).groupBy("user_id", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "cells"))), lambda x: x.cells).alias("rows"))
    after = image.select("user_id", (F.col("k") - 1).alias("k"), F.col("rows").alias("next"))

    def differs(n):
        pair = F.zip_with(F.slice("rows", F.size("rows") - n + 1, n), F.slice("next", F.lit(1), n), lambda x, y: F.exists(F.zip_with(x, y, lambda a, b: F.coalesce((a["name"] != b["name"]) | (a["level"] != b["level"]), F.lit(False))), lambda q: q))
        return F.exists(pair, lambda q: q)

    tried = F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.size("rows"), F.size("next"))), differs))
    rest = image.join(after, ["user_id", "k"]).join(found.select("user_id", "k"), ["user_id", "k"], "left_anti")
    conflict = rest.select("user_id", "k", tried.cast("long").alias("len"), F.lit("conflict").alias("status")).where("len is not null")
    return found.unionByName(conflict)


def directed_pairs(pairs: DataFrame, pools: DataFrame) -> DataFrame:
    """(pair, before, after): the valid ones among pairs of images: both of one confirmed pool, not itself, and the first of those that repeat it either way."""
    a, b = pools.select(F.col("image").alias("before"), F.col("pool").alias("_p")), pools.select(F.col("image").alias("after"), F.col("pool").alias("_q"))
    x = pairs.join(a, "before").join(b, "after").where("_p = _q and _p in ('main', 'support') and before <> after")
    first = x.groupBy(F.least("before", "after").alias("lo"), F.greatest("before", "after").alias("hi")).agg(F.min("pair").alias("pair"))
    return x.join(first, "pair", "left_semi").select("pair", "before", "after", F.col("_p").alias("pool"))


def edge_direction(matches: DataFrame) -> DataFrame:
    """(a, b, offset): the image that is further up comes first; no offset, no edge."""
    up = F.col("offset") < 0
    return matches.where("offset <> 0").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("before"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("after"))


def unordered_pairs(images: DataFrame) -> DataFrame:
    """All pairs of images of one pool that can hold items, within one batch: a batch is what a user uploads at once."""
    a = images.where("pool in ('main', 'support')")
    b = a.select("batch", "pool", F.col("image").alias("other"))
    return a.join(b, ["batch", "pool"]).where("image < other").select("batch", "image", "other")


def _order(ids: list[int], links: list[dict]) -> tuple[list[int], bool]:
    into, out = dict.fromkeys(ids, 0), {i: [] for i in ids}
    for link in links:
        out[link["image"]].append(link["after"])
        into[link["after"]] += 1
    free, done = [i for i in ids if not into[i]], []
    while free:
        i = heapq.heappop(free)
        done.append(i)
        for b in out[i]:
            into[b] -= 1
            if not into[b]:
                heapq.heappush(free, b)
    return (ids, True) if len(done) < len(ids) else (done, False)


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.schema([("batch", pa.int64()), ("image", pa.int64()), ("pos", pa.int64()), ("conflict", pa.bool_())])
    for b in batches:
        out: list[list] = [[], [], [], []]
        for batch, ids, links in zip(*(c.to_pylist() for c in b.columns)):
            order, conflict = _order(ids, links)
            for column, values in zip(out, ([batch] * len(ids), order, range(1, len(ids) + 1), [conflict] * len(ids))):
                column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape)], schema=shape)


def image_order(images: DataFrame, edges: DataFrame) -> DataFrame:
    """(batch, image), (batch, before, after) -> the place of each image, and whether its batch's edges contradict each other.

    Of the images that nothing left precedes, the least id is next; a batch with a cycle is in the order of ids. A batch is what a user uploads
    at once, and its order is sequential, so each batch is one row; rows go to Python many at a time, as batches are many and small.
    """
    batch, image, after = (F.col(c).cast("long").alias(c) for c in ("batch", "image", "after"))
    rows = images.select(batch, image, F.lit(None).cast("long").alias("after")).unionByName(edges.select(batch, F.col("before").cast("long").alias("image"), after))
    ids = F.sort_array(F.collect_set(F.when(F.col("after").isNull(), F.col("image"))))
    links = F.collect_set(F.when(F.col("after").isNotNull(), F.struct("image", "after")))
    return rows.groupBy("batch").agg(ids.alias("ids"), links.alias("links")).mapInArrow(_orders, "batch long, image long, pos long, conflict boolean")
