"""Losses of the word models against a brute-force version; nulls, repeated rows, long texts, clashing columns, empty tables."""

import random
from collections import Counter
from math import log2

import pytest

from tallyforge.llm import lm

DOC = "doc_id long, text string, gram long, kind int"


def brute(rows, target, frequent):
    """doc_id and losses, straight from the definition, by counting everything anew for each document."""
    words = [(t or "").lower().split() for _, t in rows]
    top = {w for w, _ in sorted(Counter(w for ws in words for w in ws).items(), key=lambda x: -x[1])[:frequent]}
    kinds = len({w for ws in words for w in ws})
    cls = lambda w: w if w in top else None
    out = []
    for k, ws in enumerate(words):
        loss = []
        for mine in (True, False):
            others = [x for j, x in enumerate(words) if j != k and (not mine or rows[j][0] in target)]
            c1 = Counter(w for x in others for w in x)
            n = sum(c1.values())
            c2 = Counter((cls(a), cls(b)) for x in others for a, b in zip(x, x[1:]))
            before = Counter()
            for (a, _), c in c2.items():
                before[a] += c
            total = n + lm.ALPHA * (kinds + 1)
            p1 = lambda w: (c1[w] + lm.ALPHA) / total
            rare = (sum(c for w, c in c1.items() if w not in top) + lm.ALPHA * (kinds + 1 - len(top))) / total
            bits = 0.0
            for i, w in enumerate(ws):
                if i == 0:
                    bits -= log2(p1(w))
                    continue
                share = p1(w) if w in top else rare
                given = (c2[cls(ws[i - 1]), cls(w)] + lm.PRIOR * share) / (before[cls(ws[i - 1])] + lm.PRIOR)
                bits -= log2(given * p1(w) / share)
            loss.append(bits / max(1, len(ws)))
        out.append((rows[k][0], len(ws), *loss))
    return out


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_losses_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "FREQUENT", 5)
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "CHUNK", 3)
    rng = random.Random(5)
    # powers of two keep the order of the frequent words without ties
    vocabulary = [w for k, w in enumerate("abcdefghij") for _ in range(2 ** max(0, 8 - k))]
    rows = [(2**60 + i if i else None, " ".join(rng.choice(vocabulary) + ("" if rng.random() < 0.9 else str(rng.randrange(9))) for _ in range(rng.randrange(1, 60)))) for i in range(30)]
    rows += [(7, rows[3][1]), (8, None), (9, ""), (10, "Only"), (11, "A b  A\tb")]
    target = spark.createDataFrame([(r[0],) for r in rows[::3]] + [(12345,), (None,)], "doc_id long")
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], DOC).repartition(3)
    got = {(r.doc_id, r.n_tokens): (r.loss_target, r.loss_background, r.difference) for r in lm.score(docs, target).collect()}
    want = brute(rows, {r[0] for r in rows[::3] if r[0] is not None}, 5)
    assert len(got) == len(want)
    for i, n, t, b in want:
        assert got[i, n] == pytest.approx((t, b, t - b), abs=1e-9), (i, n)


def test_target_text_is_preferred(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd" if k % 2 else "wxyz") for _ in range(80)) for k in range(20)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.difference for r in lm.score(docs, spark.createDataFrame([(k,) for k in range(1, 12, 2)], "doc_id long")).collect()}
    assert max(got[k] for k in range(1, 20, 2)) < min(got[k] for k in range(0, 20, 2))


def test_without_target_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2), (1, "a b", 1, 2), (2, "a " * 30000, 1, 2)], DOC)
    none = spark.createDataFrame([], "doc_id long")
    got = lm.score(docs, none).collect()
    assert sorted(r.n_tokens for r in got) == [2, 2, 30000] and all(r.loss_target > 0 for r in got)
    assert lm.score(docs.limit(0), none).count() == 0
