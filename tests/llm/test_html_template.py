"""The template by the tree alone and with evidence; entropies and importance against plain sums; articles that names once emptied."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tallyforge.llm import html

PAGE = "page_id long, url string, html string"
D = "/root/testdata/sf0.1"


def texts(spark, rows, **kw):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGE), **kw).collect()}


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(300)}" for _ in range(n))


def lines(fragment):
    page = html.Page(fragment)
    return [t for _, t in page.blocks]


@pytest.fixture(scope="module")
def given(spark):
    """page_id -> (blocks of the article, characters of all others) of the given pages, whose articles stand in <article>."""
    out = {}
    for r in spark.read.parquet(f"{D}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)
        inside = lines(article[1])
        out[r.page_id] = (inside, sum(map(len, lines(r.html))) - sum(map(len, inside)))
    return out


@pytest.mark.parametrize("names", [True, False])
def test_given_pages(spark, given, names):
    got = {r.page_id: r.text for r in html.extract(spark.read.parquet(f"{D}/pages.parquet"), names).collect()}
    left = planted = 0
    for k, (article, other) in given.items():
        mine = got[k].split("\n")
        kept = Counter(mine)
        assert not Counter(article) - kept, k  # nothing of the article went
        planted += other
        left += sum(map(len, mine)) - sum(map(len, article))
    assert planted > 300_000 and abs(left) <= (0 if names else 0.1 * planted), (left, planted)


PROBES = ['<div class="social-science">{}</div>', '<div class="restaurant-menu-review">{}</div>', '<section id="related-work">{}</section>', '<div class="post has-comments">{}</div>', '<div class="layout-no-sidebar">{}</div>', '<form id="aspnetForm"><main>{}</main></form>']


def test_names_never_empty_a_page(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for hosts in (1, 2, 12):
        for n, shape in enumerate([*PROBES, None]):
            for k in range(hosts):
                article = [prose(rng, 25) for _ in range(4)]
                body = shape.format("".join(f"<p>{a}</p>" for a in article)) if shape else "".join(f'<p class="share-price">{a}</p>' for a in article)
                i = len(rows)
                rows.append((i, f"http://h{hosts}-{n}/{k}", f'<body><nav><a>Home</a></nav><div class="ad-slot">{prose(rng, 5)}</div>{body}<div class="comment-list"><p>{prose(rng, 20)}</p></div><footer>Imprint</footer></body>'))
                want[i] = "\n".join(article)
    assert texts(spark, rows) == want


def test_a_section_with_much_text_stays_whatever_its_name(spark):
    rng = random.Random(3)
    rows = []
    for k in range(6):
        one, two = [prose(rng, 30) for _ in range(4)], [prose(rng, 30) for _ in range(3)]
        inner = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
        rows.append((k, f"http://papers/{k}", f'<body><article><h1>T {k}</h1><section id="method">{inner(one)}</section><section id="related-work">{inner(two)}</section></article></body>', "\n".join([f"T {k}", *one, *two])))
    assert texts(spark, [r[:3] for r in rows]) == {r[0]: r[3] for r in rows}


def test_hosts_of_two_pages_are_weighed(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(2):
        article = [prose(rng, 25) for _ in range(4)]
        rows.append((k, f"http://two/{k}", f"<body><div class=x><div class=y>The strip that both pages of the host share, word by word</div></div><article>{''.join(f'<p>{a}</p>' for a in article)}</article></body>"))
        want[k] = "\n".join(article)
    assert texts(spark, rows) == want


def site(rng, n):
    """Pages of one host: some elements on all of them in one shape, some in many shapes, some rare."""
    out = []
    for k in range(n):
        side = "".join(f"<div class=w{rng.randrange(4)}>{prose(rng, rng.randrange(2, 6))}</div>" for _ in range(rng.randrange(1, 5)))
        rare = f"<div class=rare>{prose(rng, 6)}</div>" if k % 4 == 0 else ""
        out.append(f"<body><div class=strip>{prose(rng, 5)}</div><div class=side>{side}</div>{rare}<div class=a><div class=b>{''.join(f'<p>{prose(rng, 22)}</p>' for _ in range(rng.randrange(2, 6)))}</div></div></body>")
    return out


def plain_template(pages):
    """ids of template branches of each page, from sums over the pages, path by path, without any evidence."""
    m, has, shapes, text, count, own = len(pages), Counter(), defaultdict(Counter), Counter(), Counter(), Counter()
    parsed = [html.Page(p) for p in pages]
    for p in parsed:
        for q in {q for path, _ in p.blocks for q in html._up(path)}:
            has[q] += 1
            shapes[q][tuple(sorted(p.styles.get(q, ())))] += 1
        for path, t in p.blocks:
            own[path] += len(t)
            for q in html._up(path):
                text[q] += len(t)
                count[q] += 1
    held = max(own, key=own.get)
    importance = {}
    for q in has:
        n = has[q]
        shares = [c / n for s, c in shapes[q].items() if s]
        varied = -sum(s * math.log(s) for s in shares) / math.log(n) if n > 1 and shares else 0.0
        weight = min(1, max(text[q] / own[held], text[q] / count[q] / (own[held] / count[held])))
        importance[q] = weight + (1 - weight) * (1 - n / m * (1 - varied) * (1 - 1 / m))
    line = html._up(held)
    tag = lambda q: re.match(r"\w*", q.rpartition("/")[2])[0]
    low = {q for q in has if q not in line and importance[q] < html.LEAST and tag(q) not in html.PROSE}
    return [["\n".join(t for path, t in p.blocks if path in line or not any(q in low for q in html._up(path) if q not in line))][0] for p in parsed], low


def test_importance_against_plain_sums(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 9, 40):
        pages = site(rng, n)
        want, low = plain_template(pages)
        got = texts(spark, [(k, "http://site/x", p) for k, p in enumerate(pages)], names=False)
        assert [got[k] for k in range(n)] == want
        assert n < 9 or ({q.rpartition("/")[2] for q in low} >= {"div.strip"} and "body/div.rare" not in low)
