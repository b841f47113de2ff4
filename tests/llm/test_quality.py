"""Base figures of the quality rules against a plain version over whole tables, and what each line rule is for."""

import re
from collections import Counter

from tallyforge.llm import quality

SF = "/root/testdata/sf0.001"


def plain(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    base = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), base


def test_base_figures_of_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = ["", None, "\x0b a\x0c\x1c b\u3000c\n\n \n\u00a0\n" * 9, "ä€😀 " * 25, "a b c d e f g h " * 4, "#*$%&|<>" * 5, "w " * 200_000]
    more = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    texts = {r.doc_id: r.text for r in every.collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score(every).collect()}
    assert got == {k: plain(t) for k, t in texts.items()}


def test_line_rules():
    prose = "a line of plain words, which ends as it should."
    cases = {
        prose: None,
        "": None,
        "All rights reserved.": "boilerplate",
        "Home | About | Contact": "navigation",
        "a## b$$ c%% d&&": "symbols",
        "buy!! now!! cheap?! here??": "shouting",
        "one .... ,,, !!! -- end ;;": "punctuation",
        " ".join(f"w{k}" for k in range(200)): "punctuation",
        "THIS WHOLE LINE IS IN CAPITALS AND SHOUTS": "capitals",
        "again again again again again again again again again again, again": "repeats",
    }
    assert {k: quality.line_fails(k) for k in cases} == cases
