"""Quality rules, line first: lines that fail a rule go, then documents that lose too much text.

Null texts have no words and fail the base rules; empty lines are neutral; very long texts are read
whole; repeated rows are judged alike; further columns are kept by `clean`, whatever their names; a line that fails several rules goes
by the first. An empty table gives an empty one.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.text import SPACES, mapped, shingles, span_hashes, utf8, word_spans

#: A document goes if over this share of its words stood on failed lines.
MAX_LOST = 0.3
SYMBOLS = "#*$%&|<>"
#: Marks of sentences and clauses; a line of BARE words without any isn't prose.
MARKS, BARE = re.compile(r"[.!?…:;,。！？、，；：]"), 200
BOILERPLATE = re.compile(
    r"(?i)all rights reserved|privacy policy|terms of (?:use|service)|cookie (?:policy|settings)|we use cookies|enable javascript"
    r"|sign in|log in|subscribe (?:now|to)|read more|click here|share this|skip to content|back to top"
)


def line_fails(line: str) -> str | None:
    """The rule by which a line fails, or None."""
    ws = line.split()
    n = len(ws)
    if not n:
        return None
    if n <= 12 and BOILERPLATE.search(line):
        return "boilerplate"
    bars = sum(w in ("|", "»", "›", ">", "•", "·") for w in ws)
    if bars >= 1 and 3 * bars >= n - bars:
        return "navigation"
    if 10 * sum(line.count(c) for c in SYMBOLS) > 3 * n and n > 1:
        return "symbols"
    if n >= 4 and 2 * sum(w[-1] in "!?" and w[-2:-1] in ("!", "?") for w in ws) > n:
        return "shouting"
    if n >= 4 and 2 * sum(not w[0].isalnum() and not any(map(str.isalnum, w)) for w in ws) > n:
        return "punctuation"
    letters = [c for c in line if c.isalpha()]
    if n >= 6 and 10 * sum(c.isupper() for c in letters) > 7 * len(letters) and letters:
        return "capitals"
    if n >= BARE and not MARKS.search(line):
        return "punctuation"
    if n >= 10 and 10 * sum(a == b for a, b in zip(ws, ws[1:])) > 3 * n:
        return "repeats"
    return None


def judge(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, cleaned text."""
    text = text or ""
    raw = utf8(text)
    starts, ends = word_spans(raw)
    n = len(starts)
    # code points are bytes that don't continue one; white space is ASCII
    chars = int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)) - sum(raw.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = text.split("\n")
    full = [x for x in lines if x.strip(" \t\r\x0b\x0c")]
    repeat = 0
    if n >= 8:
        g = shingles(span_hashes(raw, starts, ends), 8)
        _, inverse, counts = np.unique(g, return_inverse=True, return_counts=True)
        if len(counts) < len(g):
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(counts[inverse] > 1)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 8, -1)
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    base = n < 20 or 100 * repeat > 30 * n
    keep, lost = [], 0
    for x in lines:
        if line_fails(x):
            lost += len(utf8(x).split())
        else:
            keep.append(x)
    return n, chars, symbols, len(full) - len(set(full)), repeat, base, not base and lost <= MAX_LOST * n, lost, "\n".join(keep)


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long"


def score(docs: DataFrame) -> DataFrame:
    """doc_id and the figures and verdict of each whole text."""

    def make():
        return lambda texts: (None, list(zip(*(judge(t)[:-1] for t in texts))))

    return mapped(docs, make, _FIGURES)


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents with their failed lines gone; same columns (n_chars, where there, is that of the new text)."""
    rest = [c for c in docs.columns if c != "text"]

    def make():
        def work(texts):
            got = [(k, g[-1]) for k, g in enumerate(map(judge, texts)) if g[6]]
            return [k for k, _ in got], [[t for _, t in got]]

        return work

    out = mapped(docs, make, "text string", keep=rest)
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
