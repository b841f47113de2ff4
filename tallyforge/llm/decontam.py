"""Benchmark decontamination by SimHash of item-sized windows.

A span of a text holds an item if the multiset Jaccard of their five-word shingles reaches SIMILARITY; the span may be of any length, so added and lost words count as well as replaced ones.

Candidates: the features of a window are its words, each as often as it is there, so one changed word of a window of n moves about acos(1 - 1/n) / pi of the BITS bits. Windows have
the lengths of `window_length`, steps of about an eighth. A text is fingerprinted at every `step`-th word (an eighth of the length) for each length that items have; an item has windows at that many
consecutive words from its head on and up to its tail, so one of each is in step with a copy wherever it is, and an edit near one end leaves the windows at the other whole. Fingerprints are cut into BLOCKS blocks; two within RADIUS differ in one of the blocks by ERRORS bits at most, so the items' blocks are indexed with
all their neighbours of that many bits, and a window that meets none of them is farther than RADIUS from all items: the index loses no fingerprint within the radius.
Verification: around each candidate, the span with the greatest Jaccard is found exactly, so nothing is reported that isn't there.

The benchmark is taken in parts of PART items by item_id, each a broadcast of some ten MB at any size of the benchmark; an item with several texts has its best similarity. Texts are whole, in pieces that
overlap by the longest window. Null texts and items have no words and match nothing; items of under five words match as one shingle; repeated rows give a row each; ties have the same similarity.
`Items` is the exact search without fingerprints, by which recall is measured.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.text import U, mapped, mix, shingles, word_hashes

SIMILARITY, N = 0.8, 5
BITS, BLOCKS, ERRORS, STEPS = 64, 3, 2, 8
RADIUS = BLOCKS * (ERRORS + 1) - 1
PART, PIECE = 500, 1 << 14


def best(text: np.ndarray, item: np.ndarray) -> float:
    """The greatest multiset Jaccard of a span of `text` with `item`, both as shingles; 0 if it is below SIMILARITY."""
    values, bag = np.unique(item, return_counts=True)
    longest = math.floor(len(item) / SIMILARITY + 1e-9)
    k = np.minimum(np.searchsorted(values, text), len(values) - 1)
    ours = values[k] == text
    if ours.sum() < SIMILARITY * len(item) - 1e-9:
        return 0.0
    # before[q]: from which start on q still counts, as its value isn't used up; where the text isn't the item's, never
    before = np.where(ours, -1, len(text))
    spare = np.ones(len(text), bool)
    at = np.flatnonzero(ours)
    at = at[np.argsort(k[at], kind="stable")]
    lo = np.searchsorted(k[at], np.arange(len(values) + 1))
    for v in np.flatnonzero(np.diff(lo) > bag):
        q = at[lo[v] : lo[v + 1]]
        before[q[bag[v] :]] = q[: -bag[v]]
        spare[q] = False
    top = 0.0
    # a span that could grow to the left by a shingle that counts isn't the best
    for s in np.flatnonzero(ours & ~np.r_[False, (ours & spare)[:-1]]):
        both = np.cumsum(before[s : s + longest] < s)
        top = max(top, float((both / (np.arange(1, len(both) + 1) + len(item) - both)).max()))
        if top == 1:
            break
    return top if top >= SIMILARITY else 0.0


class Windows:
    """The items' windows of one length: sorted shingles with the items of each."""

    def __init__(self, pairs: list[tuple[np.ndarray, int]]):
        value, item = np.concatenate([v for v, _ in pairs]), np.concatenate([np.full(len(v), i) for v, i in pairs])
        order = np.argsort(value, kind="stable")
        self.items = item[order]
        self.values, self.first = np.unique(value[order], return_index=True)
        self.first = np.append(self.first, len(value))
        # a bit table leaves out most of a text before the search
        self.mask = np.uint64((1 << max(16, len(value).bit_length() + 4)) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[self.values & self.mask] = True

    def meet(self, text: np.ndarray) -> dict[int, list[int]]:
        """item: places in the text where one of its windows is."""
        out: dict[int, list[int]] = defaultdict(list)
        for p in np.flatnonzero(self.table[text & self.mask]).tolist():
            k = np.searchsorted(self.values, text[p])
            if k < len(self.values) and self.values[k] == text[p]:
                for j in self.items[self.first[k] : self.first[k + 1]].tolist():
                    out[j].append(p)
        return out


class Items:
    def __init__(self, rows: list[tuple[int, str]]):
        hs = [(i, h) for i, t in rows if len(h := word_hashes(t, lower=True))]
        self.ids = [i for i, _ in hs]
        self.sets = [shingles(h, N) for _, h in hs]
        known, often = np.unique(np.concatenate([*self.sets, np.empty(0, np.uint64)]), return_counts=True)
        by: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for j, (_, h) in enumerate(hs):
            x = self.sets[j]
            rare = x[np.argsort(often[np.searchsorted(known, x)], kind="stable")]
            by[min(N, len(h))].append((np.unique(rare[: len(x) - math.ceil(SIMILARITY * len(x) - 1e-9) + 1]), j))
        self.windows = {n: Windows(pairs) for n, pairs in by.items()}

    def find(self, text: str | None) -> dict[int, float]:
        """item_id: similarity, of the items in the text."""
        h = word_hashes(text, lower=True)
        out: dict[int, float] = {}
        for n, windows in self.windows.items():
            if len(h) < n:
                continue
            x = shingles(h, n)
            for j, places in windows.meet(x).items():
                item, reach = self.sets[j], math.floor(len(self.sets[j]) / SIMILARITY + 1e-9)
                top, k = 0.0, 0
                while k < len(places) and top < 1:
                    lo, hi = max(0, places[k] - reach + 1), places[k] + reach
                    while k < len(places) and places[k] - reach < hi:
                        hi = places[k] + reach
                        k += 1
                    top = max(top, best(x[lo:hi], item))
                if top:
                    out[self.ids[j]] = max(top, out.get(self.ids[j], 0.0))
        return out


def window_length(words: int) -> int:
    """The greatest of 1, 2, ... 16, 18, 20, ... (steps of about an eighth) that leaves room for its windows in an item of that many words."""
    n = best = 1
    while n + step(n) - 1 <= words:
        best, n = n, n + max(1, n // 8)
    return best


def step(length: int) -> int:
    """Texts are fingerprinted at every step-th word; items have windows at that many consecutive words, so one of them is always in step with a copy."""
    return max(1, length // STEPS)


def word_bits(h: np.ndarray) -> np.ndarray:
    """(words, BITS) of 0 and 1: the word's hash, mixed anew for each 64 bits."""
    both = np.stack([mix(h ^ U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(both.view(np.uint8)).reshape(len(h), BITS)


class Sums:
    """Running counts of set bits, from which the fingerprint of any window comes; 16 bits wrap, but differences don't for windows below 2**15."""

    def __init__(self, h: np.ndarray):
        self.s = np.zeros((len(h) + 1, BITS), np.int16)
        self.s[1:] = word_bits(h)
        np.cumsum(self.s, axis=0, out=self.s)

    def fingerprints(self, n: int, step: int = 1) -> np.ndarray:
        """(windows, BITS / 64) of 64 bits, for every step-th window: a bit is set if more than half of the window's words have it."""
        more = (self.s[n::step] - self.s[:-n:step]) > n // 2
        return np.packbits(more).view(U).reshape(-1, BITS // 64)


_CUTS = [(round(k * BITS / BLOCKS), round((k + 1) * BITS / BLOCKS)) for k in range(BLOCKS)]


def blocks(f: np.ndarray, k: int) -> np.ndarray:
    """The k-th block of each fingerprint, as a number."""
    lo, hi = _CUTS[k]
    word, at, wide = lo // 64, lo % 64, U((1 << (hi - lo)) - 1)
    x = f[:, word] >> U(at)
    if at + hi - lo > 64:
        x = x | (f[:, word + 1] << U(64 - at))
    return x & wide


def _near(width: int) -> np.ndarray:
    """All masks of ERRORS set bits at most."""
    return np.array([sum(1 << b for b in c) for e in range(ERRORS + 1) for c in combinations(range(width), e)], U)


class Block:
    """Numbers of one block with the windows that have them or a neighbour of them."""

    def __init__(self, values: np.ndarray, width: int):
        near = _near(width)
        keys = (values[:, None] ^ near).ravel()
        owner = np.repeat(np.arange(len(values), dtype=np.int32), len(near))
        order = np.argsort(keys, kind="stable")
        self.owner = owner[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.mask = U((1 << max(16, len(keys).bit_length() + 3)) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[mix(self.keys) & self.mask if width > 26 else self.keys & self.mask] = True
        self.mixed = width > 26

    def meet(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x and, with each, the windows that are near in this block."""
        at = np.flatnonzero(self.table[(mix(x) if self.mixed else x) & self.mask])
        k = np.minimum(np.searchsorted(self.keys, x[at]), len(self.keys) - 1)
        hit = self.keys[k] == x[at]
        at, k = at[hit], k[hit]
        n = self.first[k + 1] - self.first[k]
        return np.repeat(at, n), self.owner[np.repeat(self.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]


class Fingerprints:
    """The fingerprints of items, and the search of texts for them."""

    def __init__(self, rows: list[tuple[int, str]]):
        hs = [(i, h) for i, t in rows if len(h := word_hashes(t, lower=True))]
        self.ids = [i for i, _ in hs]
        self.sets = [shingles(h, N) for _, h in hs]
        self.words = [len(h) for _, h in hs]
        own: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for j, (_, h) in enumerate(hs):
            n = window_length(len(h))
            # head and tail, each at as many words as a text's windows are apart
            at = {*range(step(n)), *range(len(h) - n - step(n) + 1, len(h) - n + 1)}
            own[n] += [(j, h[p : p + n]) for p in sorted(at)]
        self.lengths = {}
        for n, windows in sorted(own.items()):
            f = np.concatenate([Sums(h).fingerprints(n) for _, h in windows])
            self.lengths[n] = (f, np.array([j for j, _ in windows]), [Block(blocks(f, k), hi - lo) for k, (lo, hi) in enumerate(_CUTS)])
        self.longest = max(self.lengths, default=0)

    def candidates(self, h: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Window length, places and items of all windows within RADIUS of an item's. inside: for each word, where its text ends in h."""
        sums = Sums(h)
        for n, (known, item, index) in self.lengths.items():
            if len(h) < n:
                continue
            f = sums.fingerprints(n, step(n))
            places, owners = zip(*[b.meet(blocks(f, k)) for k, b in enumerate(index)])
            pair = np.unique(np.concatenate(places).astype(np.int64) * len(known) + np.concatenate(owners))
            at, own = pair // len(known), pair % len(known)
            near = np.bitwise_count(f[at] ^ known[own]).sum(1) <= RADIUS
            at, own = at[near] * step(n), own[near]
            whole = inside[at] >= at + n
            yield n, at[whole], item[own[whole]]

    def find(self, texts: list[str | None]) -> list[dict[int, float]]:
        """item_id: similarity, of the items in each text."""
        hs = [word_hashes(t, lower=True) for t in texts]
        h = np.concatenate([*hs, np.empty(0, U)])
        ends = np.cumsum([len(x) for x in hs])
        text = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        inside = np.repeat(ends, [len(x) for x in hs])
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        # a window of a piece's first words is in step from the piece's own beginning on
        for lo in range(0, len(h), PIECE):
            hi = min(len(h), lo + PIECE + self.longest - 1 + step(self.longest))
            for n, at, items in self.candidates(h[lo:hi], inside[lo:hi] - lo):
                for p, j in zip((at + lo).tolist(), items.tolist()):
                    spans[text[p], j].append((p, n))
        out: list[dict[int, float]] = [{} for _ in texts]
        for (t, j), places in spans.items():
            item, n = self.sets[j], min(N, self.words[j])
            begin, end = ends[t] - len(hs[t]), ends[t]
            reach, top, k = math.floor(len(item) / SIMILARITY + 1e-9) + n - 1, 0.0, 0
            places.sort()
            while k < len(places) and top < 1:
                # any span that meets the window
                lo, hi = max(begin, places[k][0] - reach), places[k][0] + places[k][1] + reach
                while k < len(places) and places[k][0] - reach <= hi:
                    hi = places[k][0] + places[k][1] + reach
                    k += 1
                part = h[lo : min(end, hi)]
                if len(part) >= n:
                    top = max(top, best(shingles(part, n), item))
            if top:
                out[t][self.ids[j]] = max(top, out[t].get(self.ids[j], 0.0))
        return out


def load_items(benchmark: DataFrame) -> list:
    """Broadcasts of Fingerprints of PART items each, about; all texts of an item are in one."""
    b = benchmark.where("text is not null").select("item_id", "text")
    parts = max(1, math.ceil(b.count() / PART))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    each = ([(r.item_id, r.text) for r in b.where(part == k).orderBy("item_id", "text").toLocalIterator()] for k in range(parts))
    return [benchmark.sparkSession.sparkContext.broadcast(Fingerprints(rows)) for rows in each]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity) of each item that a document holds."""

    def maker(items):
        def make():
            def work(texts):
                found = [(k, i, s) for k, own in enumerate(items.value.find(texts)) for i, s in own.items()]
                return [x[0] for x in found], [[x[1] for x in found], [x[2] for x in found]]

            return work

        return make

    out = [mapped(docs, maker(items), "item_id long, similarity double") for items in load_items(benchmark)]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no item; columns as they were."""

    def maker(items):
        def make():
            return lambda texts: ([k for k, own in enumerate(items.value.find(texts)) if not own], [])

        return make

    for items in load_items(benchmark):
        docs = mapped(docs, maker(items), "", keep=docs.columns)
    return docs
