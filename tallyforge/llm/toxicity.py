"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a fixed lexicon and of one learned from labels, second-person words near either, capitals, punctuation and obfuscation.
Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2, from at most SAMPLE of them (those with the
least hash of the id): from one half of the sample the lexicon of words and word beginnings, from the other half the trees, and from a
fifth of that, kept apart, the calibration. Null and empty texts have all-zero features and get a score too; null ids are held out of
training; of rows that repeat an id, the text of the least hash teaches, and the id is toxic if any label says so; repeated rows score alike;
equal scores are possible; texts are read whole however long; extra columns are ignored; without labels of both kinds every score is the
label's mean (0 without labels).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.text import mapped, utf8
from tallyforge.sources.tables import Scratch

#: The bound on labelled rows that fit; a learned word or beginning is in LEAST toxic texts, and in TIMES as many as in clean ones.
SAMPLE, LEAST, TIMES = 6_000, 4, 12
TREES, DEPTH, RATE, BINS, NEAR = 40, 3, 0.2, 32, 3
# fixed values: common insults in English, German, French and Spanish
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers trash scum clown pathetic worthless disgusting dumb ugly fool jerk hate kill shut"
    " dumm dumme dummkopf trottel abschaum versager widerlich hässlich arschloch schwachkopf idiotisch"
    " imbécile imbéciles crétin débile abruti ordure connard stupide minable dégoûtant racaille"
    " idiota imbécil estúpido estúpida tonto basura escoria patético asqueroso inútil gilipollas".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted vosotros".split())
INSULT, LEARNED, ADDRESS, OBFUSCATED = 1, 2, 4, 8
_WORD = re.compile(r"[^\W_]+(?:[@$*!013457][^\W_]+)*")
_SIGNS, _LETTER = re.compile(r"[@$*!013457]"), re.compile(r"[^\W\d_]")
_LEET = str.maketrans("013457@$!", "oieastasi")
_CAPITALS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def stems_of(w: str) -> list[str]:
    """The word, and its beginnings of 3 to 10 letters, marked as such."""
    return [w, *(w[:j] + "*" for j in range(3, min(11, len(w))))]


class Flags(dict):
    """word -> what it is; a cache of bounded size."""

    def __init__(self, stems: frozenset[str]):
        self.stems = stems

    def __missing__(self, w: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        odd = bool(_SIGNS.search(w) and _LETTER.search(w))
        insult = w in INSULTS or (odd and w.translate(_LEET) in INSULTS)
        hit = self[w] = INSULT * insult | LEARNED * (not self.stems.isdisjoint(stems_of(w))) | ADDRESS * (w in SECOND) | OBFUSCATED * odd
        return hit


def features(text: str | None, flags: Flags) -> list[float]:
    text = text or ""
    ws = tokens(text)
    n, chars = max(1, len(ws)), max(1, len(text))
    f = np.fromiter(map(flags.__getitem__, ws), np.uint8, len(ws))
    insults, learned, odd = (int(np.count_nonzero(f & k)) for k in (INSULT, LEARNED, OBFUSCATED))
    near = 0
    if insults or learned:
        address = np.flatnonzero(f & ADDRESS)
        hit = np.flatnonzero(f & (INSULT | LEARNED))
        near = int((np.searchsorted(address, hit + NEAR, "right") > np.searchsorted(address, hit - NEAR)).sum())
    raw = np.frombuffer(utf8(text), np.uint8)
    upper = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    caps = len(_CAPITALS.findall(text)) if upper >= 3 else 0
    return [insults, insults / n, learned, learned / n, near, near / n, caps / n, upper / chars, text.count("!") / n, text.count("?") / n, odd / n, float(np.log1p(len(ws)))]


class Model:
    """Logistic gradient boosting of oblivious trees on quantile bins, then isotonic calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, stems: frozenset[str] = frozenset()):
        self.stems, self.trees, self.base = stems, [], 0.0
        self.mean = float(y.mean()) if len(y) else 0.0
        self.knots = (np.array([0.0]), np.array([self.mean]))
        if not 0 < self.mean < 1:
            return
        cal = np.arange(len(y)) % 5 == 4
        xt, yt = x[~cal], y[~cal]
        if not 0 < yt.mean() < 1:
            return
        self.base = float(np.log(yt.mean() / (1 - yt.mean())))
        cuts = [np.unique(np.quantile(xt[:, j], np.linspace(0, 1, BINS)))[:-1] for j in range(x.shape[1])]
        m = np.full(len(yt), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-m))
            g, h = yt - p, p * (1 - p)
            leaf, splits = np.zeros(len(yt), int), []
            for _ in range(DEPTH):
                best = (-1.0, 0, 0.0)
                size = 2 << len(splits)
                for j, cs in enumerate(cuts):
                    for c in cs:
                        at = leaf * 2 + (xt[:, j] > c)
                        gain = float((np.bincount(at, g, size) ** 2 / (np.bincount(at, h, size) + 1)).sum())
                        if gain > best[0]:
                            best = (gain, j, float(c))
                splits.append(best[1:])
                leaf = leaf * 2 + (xt[:, best[1]] > best[2])
            value = RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
            self.trees.append((splits, value))
            m += value[leaf]
        s, yc = self.margin(x[cal]), y[cal].astype(float)
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # weight, sum, largest margin
        for a, b in zip(s[order], yc[order]):
            if blocks and blocks[-1][2] == a:
                blocks[-1][0] += 1
                blocks[-1][1] += b
            else:
                blocks.append([1.0, b, a])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
                w, t, top = blocks.pop()
                blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + t, top]
        if blocks:
            self.knots = np.array([b[2] for b in blocks]), np.array([b[1] / b[0] for b in blocks])

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for splits, value in self.trees:
            leaf = np.zeros(len(x), int)
            for j, c in splits:
                leaf = leaf * 2 + (x[:, j] > c)
            out += value[leaf]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated function, linear between its knots, with a share of 1 % of the raw margin so that ties keep their order."""
        if not self.trees:
            return np.full(len(x), self.mean)
        m = self.margin(x)
        at, value = self.knots
        return np.clip(0.99 * np.interp(m, at, value) + 0.01 / (1 + np.exp(-m)), 0, 1)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, half, text) of at most SAMPLE labelled ids."""
    y = labels.where("toxic is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("y"))
    pick = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # at most SAMPLE ids, so the broadcast has a fixed bound; of rows that repeat an id one stays
    rows = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    half = F.expr("crc32(cast(concat('l', cast(doc_id as string)) as binary)) % 2 = 0")
    return one.select("doc_id", "y", half.alias("half"), F.col("t.text").alias("text"))


def learned_stems(sample: DataFrame) -> frozenset[str]:
    """Words and beginnings of longer words that stand in toxic texts alone or nearly."""

    def make():
        return lambda texts: (None, [[sorted({s for w in tokens(t or "") for s in stems_of(w)}) for t in texts]])

    each = mapped(sample.where("half"), make, "stems array<string>", ["y"]).select("y", F.explode("stems").alias("stem"))
    count = each.groupBy("stem").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return frozenset(r.stem for r in count.where(f"pos >= {LEAST} and pos >= {TIMES} * neg").select("stem").toLocalIterator())


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    with Scratch(docs.sparkSession, "toxicity") as tmp:
        sample = tmp.written(_sample(docs, labels), "sample")
        stems = learned_stems(sample)

        def make():
            known = Flags(stems)
            return lambda texts: (None, [[features(t, known) for t in texts]])

        # the lexicon must not have seen the rows that teach the trees how far to trust it
        f = mapped(sample.where("not half"), make, "x array<double>", ["doc_id", "y"]).toPandas().sort_values("doc_id")
    x = np.array(f["x"].tolist(), float).reshape(len(f), -1) if len(f) else np.zeros((0, 12))
    return Model(x, f["y"].to_numpy(), stems)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs, labels)

    def make():
        known = Flags(model.stems)

        def work(texts):
            s = model.score(np.array([features(t, known) for t in texts], float).reshape(len(texts), -1))
            return None, [s, (s >= threshold).astype(np.int32)]

        return work

    out = mapped(docs, make, "score double, predicted int")
    return out.select("doc_id", F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, true)").alias("held_out"), "score", "predicted")
