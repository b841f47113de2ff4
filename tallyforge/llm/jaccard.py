"""N-gram Jaccard join by parity sketches.

Every shingle is XORed into one of m pieces of 64 bits, so sketches differ in at most as many pieces as the sets do in
shingles. Size bands bound that number by d for every pair that can link; with m = d + 1 + e a linked pair agrees in e + 1
pieces at least. So every document may leave out its e most frequent pieces, in an order that all share: the rarest piece that
two linked documents have in common has e more frequent ones, which both have, and stays in both. Equal sets are one class first.
In each shared piece the classes are tried with one leader, then those still in different components with each other, where a
folded sketch's Hamming distance drops what cannot link; the rest is verified on whole sets.
No words, null text or null id: linked with nothing. Rows of one doc_id count as one document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.text import mapped, mix, shingles, word_hashes
from tallyforge.operators.components import connected_components
from tallyforge.sources.tables import Scratch, written

FOLD = 16  # longs


def bands(t: int, most: int) -> list[int]:
    """Starts of the size bands: a partner of a set in band k is in band k - 1, k or k + 1."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // t + 1)
    return out


def differing(t: int, low: int) -> int:
    """The most shingles by which linked sets differ, the smaller of at most `low` shingles."""
    return (100 - t) * (low + low * 100 // t) // (100 + t)


def spare(d: int) -> int:
    """Pieces beyond d + 1, and how many of its most frequent pieces a document leaves out."""
    return 1 + d // 8


def sketch(s: np.ndarray, t: int) -> tuple[list[int], list[int], list[int]]:
    """Keys of all pieces of both bands' sketches, the lowest bit the band's parity; the number to leave out by that bit; the folded parity sketch."""
    starts = bands(t, len(s))
    band = len(starts) - 2 if len(starts) > 1 else 0
    m = mix(s)
    keys, out = [], [0, 0]
    for k in (band - 1, band):
        if k < 0 or (d := differing(t, starts[k + 1] - 1)) == 0:
            continue
        n = d + 1 + spare(d)
        piece = ((m >> np.uint64(8)) % np.uint64(n)).astype(np.int16 if n < 1 << 15 else np.int64)
        order = np.argsort(piece, kind="stable")
        at = np.flatnonzero(np.diff(piece[order], prepend=-1))
        value = np.zeros(n, np.uint64)
        value[piece[order[at]]] = np.bitwise_xor.reduceat(m[order], at)
        key = mix(mix(value) ^ (np.arange(n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) ^ (np.uint64(k + 1) << np.uint64(40)))
        keys += (key & ~np.uint64(1) | np.uint64(k & 1)).view(np.int64).tolist()
        out[k & 1] = spare(d)
    fold = np.packbits((np.bincount((m >> np.uint64(44)) % np.uint64(64 * FOLD), minlength=64 * FOLD) & 1).astype(np.uint8)).view(np.int64)
    return keys, out, fold.tolist()


def sketched(docs: DataFrame, n: int, t: int) -> DataFrame:
    """(doc_id, n, f1, f2, keys, spare, fold): the set's size and two fingerprints, its pieces and its folded sketch."""

    def make():
        def work(texts):
            rows = []
            for text in texts:
                s = np.unique(shingles(word_hashes(text, lower=True), n))
                keys, out, fold = sketch(s, t) if len(s) else ([], [0, 0], [0] * FOLD)
                m = mix(s)
                f1, f2 = m.sum(keepdims=True).view(np.int64)[0], np.bitwise_xor.reduce(mix(s ^ np.uint64(977)), keepdims=True).view(np.int64)[0]
                rows.append((len(s), f1, f2, keys, out, fold))
            return None, list(zip(*rows))

        return work

    return mapped(docs, make, "n long, f1 long, f2 long, keys array<long>, spare array<int>, fold array<long>")


def sets(docs: DataFrame, n: int) -> DataFrame:
    def make():
        return lambda texts: (None, [[np.unique(shingles(word_hashes(x, lower=True), n)).view(np.int64) for x in texts]])

    return mapped(docs, make, "s array<long>")


def verified(pairs: DataFrame, docs: DataFrame, n: int, t: int, tmp: Scratch) -> DataFrame:
    """Those of the (a, b) pairs whose whole sets link."""
    ids = tmp.written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ends")
    s = tmp.written(sets(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), n), "sets")
    both = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    i = F.size(F.array_intersect("sa", "sb"))
    links = tmp.written(both.where(100 * i >= t * (F.size("sa") + F.size("sb") - i)).select("a", "b"), "links")
    tmp.drop(ids, s)
    return links


def jaccard_components(docs: DataFrame, n: int = 3, t: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; two sets link if 100 * |intersection| >= t * |union|."""
    with Scratch(docs.sparkSession, "jaccard") as tmp:
        sk = tmp.written(sketched(docs.select("doc_id", "text"), n, t), "sketches")
        real = sk.where("n > 0 and doc_id is not null")
        classes = tmp.written(real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").drop("k"), "classes")
        # few rows as a rule: a table of known size, so Catalyst broadcasts it while it is small and else joins by shuffle
        copies = tmp.written(real.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2", "n"]).where("doc_id <> rep").select("doc_id", "f1", "f2", "rep").distinct(), "copies")
        tmp.drop(classes)
        reps = real.join(copies.select("doc_id", "f1"), ["doc_id", "f1"], "left_anti")
        every = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
        shared = tmp.written(every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared-keys")
        info = tmp.written(reps.select(F.col("doc_id").alias("rep"), "n", "fold", "spare").distinct(), "reps")
        # rows of one id with different texts: the least number leaves out no piece that a row needs
        least = info.groupBy("rep").agg(F.array(F.min(F.get("spare", F.lit(0))), F.min(F.get("spare", F.lit(1)))).alias("spare"))
        met = tmp.written(every.join(shared, "key").distinct(), "met")
        tmp.drop(shared)
        ranked = met.join(least, "rep").withColumn("bit", F.col("key").bitwiseAND(1).cast("int"))
        rank = F.row_number().over(Window.partitionBy("rep", "bit").orderBy(F.desc("c"), "key"))
        keyed = tmp.written(ranked.withColumn("rank", rank).where(F.col("rank") > F.get("spare", F.col("bit"))).select("rep", "key", "c"), "keys")
        sizes = tmp.written(sk.select("doc_id", F.col("n").alias("n_shingles")), "sizes")
        tmp.drop(sk, met)
        weighted = keyed.join(keyed.groupBy("rep").agg(F.sum("c").alias("w")), "rep")
        leader = weighted.groupBy("key").agg(F.max_by("rep", F.struct("w", -F.col("rep"))).alias("lead"))
        stars = tmp.written(keyed.join(leader, "key").where("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct(), "stars")
        links = verified(stars, docs, n, t, tmp)
        comp = connected_components(links)
        open_ = keyed.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        rest = tmp.written(open_.join(mixed, "key", "left_semi").join(info, "rep"), "open")
        tmp.drop(keyed, info)
        a, b = rest.alias("a"), rest.alias("b")
        apart = sum((F.bit_count(F.get("a.fold", F.lit(k)).bitwiseXOR(F.get("b.fold", F.lit(k)))) for k in range(FOLD)), F.lit(0))
        can = (F.col("a.rep") < F.col("b.rep")) & (F.col("a.component") != F.col("b.component")) & (apart * (100 + t) <= (100 - t) * (F.col("a.n") + F.col("b.n")))
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & can).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
        pairs = tmp.written(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
        tmp.drop(rest, stars)
        more = verified(pairs, docs, n, t, tmp)
        # rows of one id are one document: their classes are linked through it
        own = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        final = connected_components(links.union(more).union(own))
        out = sizes.join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        return written(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "components-of")
