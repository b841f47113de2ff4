"""Edited copies of benchmark items against every span of the text."""

import random
from collections import Counter

from tallyforge.llm import decontam


def grams(w):
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(text, item):
    """The best multiset Jaccard of a span with the item."""
    top, bag, n = 0.0, grams(item), min(5, len(item))
    g = [tuple(text[i : i + n]) for i in range(len(text) - n + 1)]
    for a in range(len(g)):
        own, both = Counter(), 0
        for b in range(a, len(g) if len(item) >= 5 else a + 1):
            own[g[b]] += 1
            both += own[g[b]] <= bag[g[b]]
            top = max(top, both / (b - a + 1 + sum(bag.values()) - both))
    return top


def word(rng):
    return f"{rng.choice('abcdefghij')}{rng.randrange(300)}"


def edited(rng, item, edits):
    w = list(item)
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.choice(["replace", "add", "lose", "twice"])
        w[at : at + (kind in ("replace", "lose"))] = {"replace": [word(rng)], "add": [word(rng)], "lose": [], "twice": w[max(0, at - 6) : at]}[kind]
    return w


def test_edited_copies_are_found():
    rng = random.Random(6)
    items = [[word(rng) for _ in range(n)] for n in [*range(1, 16), *(rng.randrange(16, 61) for _ in range(12)), 90, 110, 120, 130]]
    items.append([word(rng) for _ in range(8)] * 5)
    found = Counter()
    known = decontam.Items([(i, " ".join(w)) for i, w in enumerate(items)])
    for i, item in enumerate(items):
        for edits in range(4):
            around = [[word(rng) for _ in range(rng.randrange(20))] for _ in range(2)]
            text = around[0] + edited(rng, item, edits) + around[1]
            got, want = known.find(" ".join(text)).get(i, 0.0), brute(text, item)
            assert abs(got - want * (want >= 0.8)) < 1e-12, (i, edits, got, want)
            found[edits] += want >= 0.8
    assert min(found[k] for k in range(4)) >= 3


def test_one_replaced_word_is_always_found():
    rng = random.Random(7)
    for n in (50, 55, 59, 60):
        item = [word(rng) for _ in range(n)]
        known = decontam.Items([(1, " ".join(item))])
        for at in range(n):
            text = [word(rng) for _ in range(at % 9)] + item[:at] + ["other"] + item[at + 1 :] + [word(rng) for _ in range(30)]
            assert known.find(" ".join(text)), (n, at)


def test_fingerprints_within_the_radius_are_never_lost():
    """Every window within RADIUS of an item's window, by comparing all pairs, is a candidate."""
    rng = random.Random(8)
    items = [[word(rng) for _ in range(rng.choice([4, 12, 17, 30, 44, 59]))] for _ in range(60)]
    known = decontam.Fingerprints([(i, " ".join(w)) for i, w in enumerate(items)])
    text = [x for i in rng.choices(range(60), k=300) for x in edited(rng, items[i], rng.randrange(7)) + [word(rng)] * rng.randrange(4)]
    h = decontam.word_hashes(" ".join(text))
    got = {(n, int(p), int(j)) for n, at, own in known.candidates(h, decontam.np.full(len(h), len(h))) for p, j in zip(at, own)}
    want = set()
    for n, (f, item, _) in known.lengths.items():
        mine = decontam.Sums(h).fingerprints(n, decontam.step(n))
        far = decontam.np.bitwise_count(mine[:, None] ^ f[None]).sum(2)
        want |= {(n, int(p) * decontam.step(n), int(item[o])) for p, o in zip(*decontam.np.nonzero(far <= decontam.RADIUS))}
    assert got == want and len(want) > 200


def recall(rng, items, edits, texts=1):
    exact, known = (kind([(i, " ".join(w)) for i, w in enumerate(items)]) for kind in (decontam.Items, decontam.Fingerprints))
    docs = [" ".join([word(rng) for _ in range(rng.randrange(30))] + edited(rng, w, edits) + [word(rng) for _ in range(rng.randrange(30))]) for _ in range(texts) for w in items]
    found = known.find(docs)
    want = [exact.find(d) for d in docs]
    assert all(w.get(i) == s for own, w in zip(found, want) for i, s in own.items())  # nothing but what is there, with its similarity
    return sum(i in own for own, w in zip(found, want) for i in w), sum(map(len, want))


def test_recall_of_edited_copies():
    """Against the exact search: all copies without edits, nine in ten or more of those with one to three."""
    rng = random.Random(9)
    items = [[word(rng) for _ in range(n)] for n in range(4, 200)]
    for edits in range(4):
        hit, want = recall(rng, items, edits, 3)
        assert want > 50 and hit >= (1.0 if edits == 0 else 0.9) * want, (edits, hit, want)


def test_recall_on_the_benchmark():
    import duckdb

    rng = random.Random(10)
    items = [r[0].split() for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/benchmark.parquet' ORDER BY item_id").fetchall()]
    for edits in range(4):
        hit, want = recall(rng, items, edits, 4)
        assert want > 20 and hit >= (1.0 if edits == 0 else 0.9) * want, (edits, hit, want)


def test_pieces_of_long_texts_and_of_batches(monkeypatch):
    rng = random.Random(11)
    items = [[word(rng) for _ in range(n)] for n in (3, 20, 59, 300)]
    known = decontam.Fingerprints([(i, " ".join(w)) for i, w in enumerate(items)] + [(1, "a second text of the first item")])
    texts = [" ".join([word(rng) for _ in range(k)] + items[k % 4] + [word(rng) for _ in range(200)]) for k in range(0, 400, 7)]
    texts += [None, "", " ".join(items[2][:30]), " ".join(items[2][30:]), " ".join(word(rng) for _ in range(40_000)) + " " + " ".join(items[3])]
    whole = known.find(texts)
    monkeypatch.setattr(decontam, "PIECE", 64)
    assert known.find(texts) == whole and [known.find([t])[0] for t in texts] == whole
    assert all(k % 4 in own for k, own in zip(range(0, 400, 7), whole)) and whole[-5:-1] == [{}] * 4 and whole[-1] == {3: 1.0}


def test_rows_do_not_depend_on_the_number_of_parts(spark, monkeypatch):
    rng = random.Random(12)
    items = [[word(rng) for _ in range(25)] for _ in range(9)]
    bench = spark.createDataFrame([(k % 5, " ".join(w)) for k, w in enumerate(items)] + [(None, " ".join(items[0])), (7, None)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(items[k % 9] + items[(k + 5) % 9])) for k in range(20)] + [(None, None)], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, decontam.matches(docs, bench).collect()), key=str)
    one, kept = rows(), decontam.clean(docs, bench).count()
    monkeypatch.setattr(decontam, "PART", 2)
    assert rows() == one and len(one) == len({r[:2] for r in one}) and decontam.clean(docs, bench).count() == kept == 1
