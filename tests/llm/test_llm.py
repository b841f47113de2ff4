"""The text operators against brute force on small tables; nulls, empty and repeated rows, clashing columns, empty tables."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import decontam, html, jaccard, licenses, line_dedup, lm, packing, quality, toxicity, warc
from tallyforge.llm.queries import TOKENIZER

DOC = "doc_id long, text string, row long, n long"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, 7, 8) for i, t in enumerate(texts)], DOC)


def prose(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n))


def sets(text, n):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, n, t):
    s = [sets(x, n) for x in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(s)):
            for b in range(a):
                if s[a] and s[b] and 100 * len(s[a] & s[b]) >= t * len(s[a] | s[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [(i, len(s[i]), label[i]) for i in range(len(s))]


@pytest.mark.parametrize("n,t", [(3, 90), (5, 80)])
def test_jaccard(spark, n, t):
    rng = random.Random(n)
    texts = [None, "", "  ", "One", "one", "a b", "A b"]
    for size in (5, 12, 40, 90, 300):
        base = prose(rng, size).split()
        for k in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(w))
    texts += [prose(rng, 60) for _ in range(20)]
    got = jaccard.jaccard_components(docs(spark, texts), n, t).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, n, t)


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard.jaccard_components(docs(spark, []).limit(0)).count() == 0
    rows = [(None, "a b c d", 1, 1), (None, "a b c d", 1, 1), (3, "a b c d", 1, 1), (3, "a b c d", 1, 1)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.component_id or -1) for r in got) == [-1, -1, 3, 3]


def test_warc_round_trip(spark):
    fake = f"x{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\ny"
    long = "ä" * 600
    rows = [(1, "u", long), (2, "u\r\nX: y", long), (3, None, None), (4, "u", ""), (5, "u", fake), (6, "u", warc.MAGIC), (7, "u", "t\r\n\r\n\r\n\r\n"), (8, "u", long), (9, "u", fake * 50), (10, "u", "short"), (11, "u", "short")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    import hashlib

    assert set(got) == set(range(1, 12))
    for i, _, h in rows:
        raw = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest()), i
        assert (r.record_type, r.refers_to) == (("revisit", 8) if i in (1, 2) else ("response", None)), i


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|>"] + [prose(rng, rng.randrange(1, 900)) for _ in range(40)]
    got = packing.pack(docs(spark, texts), TOKENIZER).collect()
    seqs, seen = defaultdict(list), defaultdict(list)
    for r in got:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
        seqs[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.start, r.length))
    for parts, total in [*((v, None) for v in seqs.values()), *((seen[i], len(t.encode(texts[i] or "").ids) + 1) for i in range(len(texts)))]:
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == total if total else at <= 1024
    assert sum(sum(n for _, n in v) < 1024 for v in seqs.values()) <= 1
    assert packing.pack(docs(spark, []).limit(0), TOKENIZER).count() == 0


def test_hilbert_visits_neighbours():
    at = {packing.hilbert([x, y], 3): (x, y) for x in range(8) for y in range(8)}
    assert sorted(at) == list(range(64))
    assert all(sum(abs(a - b) for a, b in zip(at[k], at[k + 1])) == 1 for k in range(63))


def test_quality(spark):
    rng = random.Random(2)
    good = ". ".join(prose(rng, 9) for _ in range(5))
    nav = " | ".join(prose(rng, 1) for _ in range(30))
    texts = [good, nav, None, "", "short one", " ".join(["same"] * 50), good + "\n" + good, "### ".join(prose(rng, 40).split())]
    rows = {r.doc_id: r for r in quality.score(docs(spark, texts)).collect()}
    assert [rows[i].kept for i in range(8)] == [True, False, False, False, False, False, False, False]
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        g = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if g[tuple(w[k : k + 8])] > 1 for j in range(8)}
        assert (rows[i].n_words, rows[i].n_repeat_words, rows[i].word_chars) == (len(w), len(covered), sum(len(x.decode()) for x in w))
    assert quality.clean(docs(spark, texts)).columns == ["doc_id", "text", "row", "n"]


def test_line_dedup(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", None, "", "b\nc\nd", "q\nq\nq\nq\nq", "a\nb"]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[i].text for i in range(7)] == ["a\nb\nc\nd", "x\ny", None, "", "", "q", "a\nb"]
    assert got[1].n_removed == 3 and got[4].n_removed == 3 and got[0].n_removed == 0
    assert "PythonUDF" not in line_dedup.dedup_lines(docs(spark, texts))._jdf.queryExecution().toString()


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(3, 60))) for i in range(30)] + [(98, None), (99, "")]
    texts, want = [None, ""], set()
    for k in range(60):
        text = prose(rng, rng.randrange(1, 400)).split()
        if k % 2:
            at = rng.randrange(len(text) + 1)
            i, t = items[rng.randrange(30)]
            text[at:at] = t.split()
            want.add((len(texts), i))
        texts.append(" ".join(text))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs(spark, texts), bench).collect()} == want
    assert decontam.clean(docs(spark, texts), bench).count() == len(texts) - len({d for d, _ in want})


def test_html(spark):
    page = lambda x: f"<head><title>t</title><script>var a='</p>'</script></head><body><nav>menu</nav><div class='box'>same text</div><article><h1>T &amp; {x}</h1><p>one {x}<br>two<p>three\n {x}</article><div class=comments>hi</div><footer>f</footer>"
    rows = [(i, "http://h/x", page(i)) for i in range(30)] + [(90, None, None), (91, "http://solo/", page(91)), (92, "u", "")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "T & 3\none 3 two\nthree 3" and got[3].n_chars == len(got[3].text)
    assert got[91].text.startswith("same text\nT & 91") and got[90].text == got[92].text == ""


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    texts = [prose(rng, 40) + (" " + rng.choice(["idiot", "grubblug", "grubblat"]) + " you " + prose(rng, 5) if i % 3 == 0 else "") for i in range(600)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id long, toxic int")
    rows = toxicity.score(docs(spark, texts), labels).collect()
    held = [r for r in rows if r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 602
    assert {r.score for r in toxicity.score(docs(spark, ["a"]), labels.limit(0)).collect()} == {0.0}


def test_licenses(spark):
    texts = ["x\nReleased under the MIT License.", "licensed under the apache license, version 2.0", "this licence talk is of other things altogether", None, "Licensed under CC BY-NC 4.0."]
    got = {(r.doc_id, r.line, r.license, r.exact) for r in licenses.find(docs(spark, texts)).collect()}
    assert got == {(0, 1, "MIT", True), (1, 0, "Apache-2.0", True), (4, 0, "CC-BY-NC-4.0", True)}


def test_encoder_gives_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    whole.encode_special_tokens = True
    pick = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "a", "a,", ".b", "!!", "it's", "'s", "9", "\u00e9", "e\u0301", "<|endoftext|>", "\u4e2d", "\U0001f600", "\x00"]
    for text in ["", "x" * 500, "a" * 100_000, " " * 100_000, "\n" * 100_000 + "b"] + [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}  {chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000] + ["".join(pick.choices(bits, k=pick.randint(1, 9))) for _ in range(5000)]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
