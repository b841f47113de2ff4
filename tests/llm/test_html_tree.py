"""The style tree on hosts of copies, small hosts and notices among an article's paragraphs."""

import random

from tallyforge.llm import html

PAGE = "page_id long, url string, html string"


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(300)}" for _ in range(n))


def texts(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, PAGE)).collect()}


def page(k, article, notice="All rights reserved by us."):
    return f"<body><script>track({k})</script><nav>{k}</nav><article>{''.join(f'<p>{p}</p>' for p in article)}<p>{notice}</p></article><div class=box>Read all news</div>"


def test_copies_of_few_articles_stay(spark):
    rng = random.Random(8)
    articles = [[prose(rng, 12) for _ in range(4)] for _ in range(5)]
    got = texts(spark, [(k, f"http://copies/{k}", page(0 if k % 2 else k, articles[k % 5])) for k in range(1000)])
    assert all(got[k] == "\n".join(articles[k % 5]) for k in range(1000))


def test_notice_goes_on_hosts_of_any_size(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for n in (3, 4, 19, 20, 40):
        for k in range(n):
            article = [prose(rng, 12) for _ in range(4)]
            want[100 * n + k] = "\n".join(article)
            rows.append((100 * n + k, f"http://host{n}/{k}", page(k, article)))
    assert texts(spark, rows) == want


def test_near_copies_stay(spark):
    rng = random.Random(10)
    article = [prose(rng, 12) for _ in range(9)]
    rows, want = [], {}
    for n in (2, 3, 30):
        for k in range(n):
            own = article[:4] + [prose(rng, 12)] + article[5:]
            want[100 * n + k] = own
            rows.append((100 * n + k, f"http://near{n}/{k}", page(k, own)))
    got = texts(spark, rows)
    assert all(got[k].startswith("\n".join(own)) for k, own in want.items())


def test_shared_passages_of_articles_stay(spark):
    rng = random.Random(13)
    rows, want = [], {}
    passage = prose(rng, 9)
    for k in range(30):
        own = [prose(rng, 12) for _ in range(4)] + ([passage] if k % 3 == 0 else [])
        box = "Some of all pages have this" if k % 2 else "The rest of them have that"
        rows.append((k, f"http://shared/{k}", f"<body><article>{''.join(f'<p>{p}</p>' for p in own)}</article><div class=a><div class=b>{box}</div></div></body>"))
        want[k] = "\n".join(own)
    assert texts(spark, rows) == want
