"""The manifest against a plain tree, for several fanouts and bucket heights, with null, repeated and tied rows."""

import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import merkle

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, g long, node string, before int"


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(r, plus=0):
    values = [r[0], r[1], r[2], None if r[3] is None else r[3] + plus, r[4]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """The root and each node's siblings (left, right), level by level."""
    proofs, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, q in enumerate(own):
            lo = q - q % fanout
            proofs[j].append((nodes[lo:q], nodes[q + 1 : lo + fanout]))
        nodes = [h(*nodes[q : q + fanout]) for q in range(0, len(nodes), fanout)]
        own = [q // fanout for q in own]
    return nodes[0] if nodes else None, proofs


def plain(rows, fanout):
    rows = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in itertools.groupby(rows, key=lambda r: r[2])]
    trees = [climb([leaf(r) for r in g], fanout) for g in groups]
    root, high = climb([t[0] for t in trees], fanout)
    out = []
    for g, (sub, low), up in zip(groups, trees, high):
        for r, own in zip(g, low):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = leaf(r, int(bad))
            for left, right in own + up:
                acc = h(*left, acc, *right)
            siblings = [x for left, right in own + up for x in left + right]
            out.append((r[0], leaf(r), sub, root, h(*siblings), acc, acc == root))
    return sorted(out, key=str)


ROWS = [(k, f"s{k % 3}", ["en", "de", None, "Zü", "en"][k % 5], None if k % 11 == 0 else k * 7, None if k % 13 == 0 else "x" * (k % 9) + "ß\U0001f600\n") for k in range(70)]
ROWS += [(None, None, None, None, None), (None, "a", "en", 3, ""), (5, "other", "en", 1, "tie"), ROWS[4], ROWS[4], (2**60 + 1, "s", "alone", 5, "y" * 300_000)]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 12), (2, 1), (2, 3), (3, 2), (5, 1)])
def test_equals_plain_tree(spark, fanout, levels):
    docs = spark.createDataFrame([(*r, 1, "c", 2) for r in ROWS], SHAPE).repartition(3)
    m = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), merkle.leaf_text([F.col(c) for c in merkle.COLUMNS]), None, fanout, levels)
    got = m.select("key", F.lower(F.hex("leaf")), F.lower(F.hex("subroot")), F.lower(F.hex("root")), F.sha2(F.encode(merkle.proof_text(), "utf-8"), 256), merkle.folded(F.col("leaf")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(*r[:5], r[3]) for r in plain(ROWS, fanout)], key=str)


def test_audit(spark):
    docs = spark.createDataFrame([(*r, 1, "c", 2) for r in ROWS], SHAPE)
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    got = sorted(map(tuple, merkle.audit(docs).select(*names).collect()), key=str)
    assert got == plain(ROWS, 2)
    assert {r[6] for r in got} == {True, False}


def test_small_tables(spark):
    assert merkle.audit(spark.createDataFrame([], SHAPE)).count() == 0
    one = merkle.audit(spark.createDataFrame([(1, "a", "en", 2, "t", 1, "c", 2)], SHAPE)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h()
