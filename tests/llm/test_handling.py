"""Ids and long columns beside nulls, clashing columns, repeated rows, ties, long texts and empty tables, for every text operator."""

import hashlib
import random

import pytest

from tallyforge.llm import decontam, html, jaccard, licenses, line_dedup, lm, packing, quality, toxicity, warc
from tallyforge.llm.queries import TOKENIZER

BIG = 2**60 + 1
DOC = "doc_id long, text string, ps long, _ls string, _kept long, key long, h long, n long, row long, block int, component long, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n))


def table(spark, texts, ids):
    rows = [(i, t, None if k % 2 else BIG + k, "z", BIG, 1, 2, 3, 4, 5, 6, len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOC).coalesce(1)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    text = ". ".join(prose(rng, 9) for _ in range(8)) + "."
    other = "! ".join(prose(rng, 11) for _ in range(9)) + " Released under the MIT License."
    return table(spark, [text, other, None, "", other, text], [BIG, None, BIG + 2, BIG + 4, None, BIG])


OPERATORS = {
    "lm": lambda d: lm.score(d, d.select("doc_id").limit(1)),
    "licenses": licenses.find,
    "line_dedup": line_dedup.dedup_lines,
    "packing": lambda d: packing.pack(d, TOKENIZER),
    "quality": quality.score,
    "quality_clean": quality.clean,
    "toxicity": lambda d: toxicity.score(d, d.sparkSession.createDataFrame([(BIG, 1), (BIG, 0), (None, 1)], "doc_id long, toxic int")),
    "jaccard": jaccard.jaccard_components,
    "decontam": lambda d: decontam.matches(d, d.sparkSession.createDataFrame([(BIG, d.first().text), (None, d.first().text)], "item_id long, text string")),
    "decontam_clean": lambda d: decontam.clean(d, d.sparkSession.createDataFrame([(1, "not there at all today")], "item_id long, text string")),
}
IDS = {"licenses": [None, None], "packing": [BIG, BIG, None, None, BIG + 2, BIG + 4], "quality_clean": [BIG, BIG, None, None], "decontam": [BIG, BIG, BIG, BIG]}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_beside_nulls(docs, name):
    got = OPERATORS[name](docs).collect()
    want = IDS.get(name, [BIG, None, BIG + 2, BIG + 4, None, BIG])
    assert sorted((r.doc_id for r in got), key=str) == sorted(want, key=str)
    if name in ("quality_clean", "decontam_clean", "line_dedup"):
        assert {r.ps for r in got} <= {None, BIG, BIG + 2, BIG + 4} and {r._kept for r in got} == {BIG}
        assert OPERATORS[name](docs).columns[:1] == ["doc_id"]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, name):
    if name == "decontam":
        assert decontam.matches(docs.limit(0), docs.sparkSession.createDataFrame([], "item_id long, text string")).count() == 0
    else:
        assert OPERATORS[name](docs.limit(0)).count() == 0


def test_components_keep_big_ids(docs):
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(BIG, BIG), (None, None), (BIG + 2, BIG + 2), (BIG + 4, BIG + 4), (None, None), (BIG, BIG)], key=str)


def test_rows_of_one_id_do_not_cut_each_other(spark):
    rows = [(1, "u1\nu2\nu3\nu4"), (1, "x\nu1\nu2\nu3\ny"), (1, "u1\nu2\nu3\nu4")]
    got = sorted(r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # one of the two texts loses the shared lines, the other keeps all of its own; equal rows share one fate
    assert got in (["u1\nu2\nu3\nu4", "u1\nu2\nu3\nu4", "x\ny"], sorted(["u4", "u4", "x\nu1\nu2\nu3\ny"]))


def test_special_tokens_are_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    texts = ["<|endoftext|>", "a<|endoftext|> b", "plain text", "<|endoftext|><|endoftext|>x", " <|endof text|>"]
    got = {r.doc_id: r.doc_tokens for r in packing.pack(table(spark, texts, range(5)), TOKENIZER, size=1 << 20, special=True).collect()}
    assert got == {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in enumerate(texts)}
    e = packing.Encoder(TOKENIZER, special=True)
    assert all(list(e.ids(x)) == t.encode(x, add_special_tokens=False).ids for x in texts)


PAGE = "page_id long, url string, html string, host string, content long, n long, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", BIG, 1, "y") for i, u, h in rows], PAGE).coalesce(1)


def test_pages_beside_nulls_and_repeated(spark):
    long = "<p>" + "word " * 400 + "</p>"
    p = pages(spark, [(BIG, "http://a/1", long), (None, "http://a/1", long), (BIG, "http://a/1", long), (BIG + 2, None, None), (3, "http://a/2", "")])
    assert sorted((r.page_id for r in html.extract(p).collect()), key=str) == sorted([BIG, None, BIG, BIG + 2, 3], key=str)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(p).collect())
    one, none = hashlib.sha1(long.encode()).hexdigest(), hashlib.sha1(b"").hexdigest()
    assert got == sorted([(str(BIG), len(long), one, "response", None), (str(BIG), len(long), one, "response", None), ("None", len(long), one, "revisit", BIG), (str(BIG + 2), 0, none, "response", None), ("3", 0, none, "response", None)])
    assert html.extract(p.limit(0)).count() == 0 and warc.round_trip(p.limit(0)).count() == 0


def test_broken_chains_are_reported(spark, tmp_path):
    warc.write(pages(spark, [(k, "http://a", f"<p>{k}</p>") for k in range(100)]), f"{tmp_path}/a")
    lines = "".join(r.value + warc.END for r in spark.read.option("lineSep", warc.END).text(f"{tmp_path}/a").collect())
    assert warc.read(spark, f"{tmp_path}/a").count() == 100
    at = lines.index("Content-Length: ", lines.index("X-Page-ID: 34\r"))
    broken = lines[:at] + "Content-Length: 9" + lines[at + len("Content-Length: ") + 1 :]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(broken.encode())
    with pytest.raises(ValueError, match="break in 1 files"):
        warc.read(spark, f"{tmp_path}/b")
    assert 0 < warc.read(spark, f"{tmp_path}/b", on_defect="skip").count() < 100
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.warc").write_bytes(lines.encode())
    # an archive that isn't compressed is split; records come out alike
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert warc.read(spark, f"{tmp_path}/c").count() == 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_html_quirks(spark):
    cases = {
        "<article><header><h1>Head</h1></header><p>x y</p></article>": "Head\nx y",
        '<div class="article-header">kept</div><section class="research-form">too</section>': "kept\ntoo",
        "<p title=it's>hello</p><p>don't stop</p>": "hello\ndon't stop",
        '<p>a <span class="ad">buy</span>b</p><p hidden>no</p><div aria-hidden="true">no</div>': "a b",
        '<header>site</header><div id="main-nav">m</div><div class="siteHeader">h</div><div role="navigation">r</div><p>text': "text",
        "1 < 2 & 3 &lt; 4 &#x41; <!-- c --> <?x y> </3> end": "1 < 2 & 3 < 4 A end",
        "<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>": "one\ntwo\na\nb",
        "<script>var a='</p>'</script><style>p{}</style><textarea>t</textarea><p>done</p><title>x</title>": "done",
        '<p class="comments">c</p><p data-x="a>b">d</p><p class=\'x\' id=y>e</p>': "d\ne",
    }
    got = [r.text for r in html.extract(pages(spark, [(k, f"http://h{k}/", h) for k, h in enumerate(cases)])).orderBy("page_id").collect()]
    assert got == list(cases.values())


def test_html_is_linear(spark):
    import time

    for part in ("<a ", "<p x='", "<!--", "</", "<div>", "</div>", '<p a="', "<b class=ad>", "<script>"):
        took = []
        for n in (20_000, 80_000):
            t = time.perf_counter()
            html.blocks("start " + part * n)
            took.append(time.perf_counter() - t)
        assert took[1] < 12 * took[0] + 0.3, (part, took)


def test_low_branches_go_whole(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(12):
        article = [prose(rng, 25) for _ in range(4)]
        # tags and names say nothing of the box; part of it differs from page to page
        box = f"<div class=q7><h4>Sections here</h4><ul><li>One</li><li>Two</li></ul><dl><dt>You are at {prose(rng, 2)}</dt></dl></div>"
        rows.append((k, f"http://tree/{k}", f"<body>{box}<div class=q8>{''.join(f'<p>{a}</p>' for a in article)}</div></body>"))
        want[k] = "\n".join(article)
    assert {r.page_id: r.text for r in html.extract(pages(spark, rows)).collect()} == want
