"""Cross-entropy difference of two n-gram models over words.

Target and background share vocabulary, classes, order and smoothing: the target is counted over the documents of `target`, the
background over every document. A word's class is the word itself if it is one of the FREQUENT most frequent ones, else one class of
all rarer words. p(word | word before) = p(class | class before) * p(word | class); class bigrams are smoothed towards the class's share,
words by ALPHA over the shared vocabulary, which has every word of the corpus and one more for those unseen. A document is scored by
counts that leave out its own, so what occurs nowhere else is a loss to it. Per document: mean loss per word in bits under each model,
and their difference (lower: more like the target).

Counts are tables that grow with the corpus. Documents fall into blocks of about BLOCK_BYTES by a hash of their id; a block has its own
counts at hand and gets, by a join on the n-gram, the totals of those n-grams alone that occur outside it too.
Null and empty texts have no words and losses of 0; without target documents the target model knows the vocabulary alone; repeated rows
count each time and rows of one id share a block; a null id is never a target; counts cover whole texts of any length; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.text import word_hashes
from tallyforge.sources.tables import Scratch, written

FREQUENT, BLOCK_BYTES, ALPHA, PRIOR = 4096, 16 << 20, 0.1, 50.0
WORD, PAIR, TARGET = 0, 1, 2
CHUNK = 128  # documents that are scored at once


class Texts:
    """The words of a block's documents: hashes `h`, the document `d` of each, and whether that is a target document."""

    def __init__(self, ids: list, texts: list, targets: set):
        parts = [word_hashes(x, lower=True) for x in texts]
        self.n = np.array([len(p) for p in parts], np.int64)
        self.h = np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)
        self.d = np.repeat(np.arange(len(parts)), self.n)
        self.target = np.array([i in targets for i in ids], bool)
        self.first = np.ones(len(self.h), bool)
        self.first[1:] = self.d[1:] != self.d[:-1]

    def pairs(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word, and the pair it ends (of no use for first words)."""
        if not len(frequent) or not len(self.h):
            c = np.zeros(len(self.h), np.int64)
        else:
            at = np.minimum(np.searchsorted(frequent, self.h), len(frequent) - 1)
            c = np.where(frequent[at] == self.h, at, len(frequent))
        before = np.zeros(len(c), np.int64)
        before[1:] = c[:-1]
        return c, before * (len(frequent) + 1) + c

    def counted(self, gram: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct grams with their target and background counts."""
        mine = self.target[self.d]
        if keep is not None:
            gram, mine = gram[keep], mine[keep]
        values, at = np.unique(gram, return_inverse=True)
        return values, np.bincount(at, mine, len(values)).astype(np.int64), np.bincount(at, minlength=len(values))


def _targets(right: pa.Table) -> set:
    kind, gram = right.column("kind").to_numpy(), right.column("gram").to_numpy()
    return set(gram[kind == TARGET].tolist())


def _counts(blocks: DataFrame, targets: DataFrame, kind: int, frequent: np.ndarray | None) -> DataFrame:
    """(block, kind, gram, t, b): each block's own counts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = Texts(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), _targets(right))
        block = (left if len(left) else right).column("block")[0].as_py()
        gram, t, b = x.counted(x.h) if kind == WORD else x.counted(x.pairs(frequent)[1], ~x.first)
        n = len(gram)
        return pa.table({"block": pa.array(np.full(n, block, np.int32)), "kind": pa.array(np.full(n, kind, np.int32)), "gram": pa.array(gram), "t": pa.array(t), "b": pa.array(b)})

    return blocks.groupBy("block").cogroup(targets.groupBy("block")).applyInArrow(run, "block int, kind int, gram long, t long, b long")


def _share(own: np.ndarray, n: int) -> np.ndarray:
    """How often each value occurs, at each of its places."""
    _, at, c = np.unique(own, return_inverse=True, return_counts=True)
    return c[at] if n else own


class Model:
    """One of the two models: totals of words, pairs and contexts, as arrays over what a block knows."""

    def __init__(self, n: int, kinds: int, frequent: int, rare: int, contexts: np.ndarray):
        self.n, self.kinds, self.frequent, self.rare, self.contexts = n, kinds, frequent, rare, contexts

    def loss(self, c, before, first, word, pair, own_n, own_word, own_rare, own_pair, own_context) -> np.ndarray:
        """Bits of each word; own_* are the counts that its document has itself, word and pair the totals."""
        total = self.n - own_n + ALPHA * (self.kinds + 1)
        p1 = (word - own_word + ALPHA) / total
        rare = c == self.frequent
        share = np.where(rare, (self.rare - own_rare + ALPHA * (self.kinds + 1 - self.frequent)) / total, p1)
        given = (pair - own_pair + PRIOR * share) / (self.contexts[before] - own_context + PRIOR)
        return -np.log2(np.where(first, p1, given * p1 / share))


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, difference."""
    d = docs.select("doc_id", "text")
    blocks_n = max(1, math.ceil((d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))

    def block(c: Column) -> Column:
        return F.pmod(c, F.lit(blocks_n)).cast("int").alias("block")

    blocks = d.select("doc_id", "text", block(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))))
    targets = target.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    targets = targets.select(block(F.xxhash64("doc_id")), F.lit(TARGET).alias("kind"), F.col("doc_id").alias("gram"), F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("b"))
    with Scratch(docs.sparkSession, "lm") as tmp:
        total = lambda k: k.groupBy("kind", "gram").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
        word_keys = tmp.written(_counts(blocks, targets, WORD, None), "word-keys")
        words = tmp.written(total(word_keys), "words")
        kinds, n_t, n_b = (x or 0 for x in words.agg(F.count("*"), F.sum("t"), F.sum("b")).first())
        # at most FREQUENT rows
        top = words.orderBy(F.desc("b"), "gram").limit(FREQUENT).select("gram", "t", "b").toPandas().sort_values("gram")
        frequent = top["gram"].to_numpy(np.int64)
        size = len(frequent)
        pair_keys = tmp.written(_counts(blocks, targets, PAIR, frequent), "pair-keys")
        pairs = tmp.written(total(pair_keys), "pairs")
        # at most FREQUENT + 1 rows
        ctx = pairs.groupBy(F.floor(F.col("gram") / (size + 1)).cast("int").alias("c")).agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toPandas()
        seen = {k: np.zeros(size + 1) for k in "tb"}
        for k in "tb":
            seen[k][ctx["c"].to_numpy(int)] = ctx[k].to_numpy(float)
        models = {k: Model(n, kinds, size, n - int(top[k].sum()), seen[k]) for k, n in (("t", n_t), ("b", n_b))}
        keys = word_keys.unionByName(pair_keys).select("block", "kind", "gram", F.col("b").alias("own"))
        every = words.unionByName(pairs)
        shared = written(keys.join(every.hint("merge"), ["kind", "gram"]).where("b > own").select("block", "kind", "gram", "t", "b").unionByName(targets), "lm-counts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = Texts(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), _targets(right))
        c, pair = x.pairs(frequent)
        kind = right.column("kind").to_numpy()

        def totals(which: int, gram: np.ndarray, keep: np.ndarray | None):
            values, t, b = x.counted(gram, keep)
            r = right.filter(pa.array(kind == which))
            at = np.searchsorted(values, r.column("gram").to_numpy())
            t[at], b[at] = r.column("t").to_numpy(), r.column("b").to_numpy()
            return values, {"t": t, "b": b}

        words_, word_n = totals(WORD, x.h, None)
        pairs_, pair_n = totals(PAIR, pair, ~x.first)
        loss = {k: np.zeros(len(x.n)) for k in "tb"}
        ends = np.concatenate([[0], np.cumsum(x.n)])
        for lo in range(0, len(x.n), CHUNK):
            hi = min(len(x.n), lo + CHUNK)
            s = slice(ends[lo], ends[hi])
            n = ends[hi] - ends[lo]
            if not n:
                continue
            dd, first, cc = x.d[s], x.first[s], c[s]
            w = np.searchsorted(words_, x.h[s])
            p = np.minimum(np.searchsorted(pairs_, pair[s]), max(0, len(pairs_) - 1))
            before = pair[s] // (size + 1)
            # what the document has itself
            own_word = _share(dd * len(words_) + w, n)
            own_pair = np.where(first, 0, _share(np.where(first, -1 - dd, dd * max(1, len(pairs_)) + p), n))
            context = np.where(first, -1 - dd, dd * (size + 1) + before)
            own_context = np.where(first, 0, _share(context, n))
            own_rare = np.bincount(dd[cc == size] - lo, minlength=hi - lo)[dd - lo]
            for k in "tb":
                mine = x.target[dd] if k == "t" else 1
                pair_total = pair_n[k][p] if len(pairs_) else np.zeros(n)
                bits = models[k].loss(cc, before, first, word_n[k][w], np.where(first, 0, pair_total), mine * x.n[dd], mine * own_word, mine * own_rare, mine * own_pair, mine * own_context)
                loss[k][lo:hi] = np.bincount(dd - lo, bits, hi - lo)
        mean = {k: loss[k] / np.maximum(x.n, 1) for k in "tb"}
        return pa.table({"doc_id": left.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(x.n), "loss_target": pa.array(mean["t"]), "loss_background": pa.array(mean["b"]), "difference": pa.array(mean["t"] - mean["b"])})

    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, loss_target double, loss_background double, difference double")
