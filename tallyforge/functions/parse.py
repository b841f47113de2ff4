"""Strict parsing of numbers and names as Column expressions (NULL means unknown, never zero)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level(text: Column, most: int = 60) -> Column:
    """Exactly one run of digits within 1..most, letter O read as 0; a minus sign makes it unknown."""
    runs = F.regexp_extract_all(F.translate(text, "Oo", "00"), F.lit(r"(\d+)"))
    value = F.get(runs, F.lit(0)).try_cast("int")
    return F.when((F.size(runs) == 1) & ~text.rlike("[-负]") & value.between(1, most), value)


def strict_int(text: Column, low: int, high: int) -> Column:
    value = F.trim(text).try_cast("int")
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$") & value.between(low, high), value)


def clean_name(text: Column) -> Column:
    """Letters and digits only, without the level suffix."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]|[级級]", "")


def bag_count(text: Column) -> Column:
    """struct<current, capacity> of 'n/m' with n <= m, else NULL."""
    t = F.translate(text, "Oo", "00")
    n, m = (F.regexp_extract(t, r"(\d+)\s*[/／]\s*(\d+)", k).try_cast("int") for k in (1, 2))
    return F.when(n <= m, F.struct(n.alias("current"), m.alias("capacity")))


def display_name(name: Column, quality: Column, plain: str = "orange") -> Column:
    return F.when(quality == plain, name).otherwise(F.concat(name, F.lit("（"), quality, F.lit("）")))


def round_up(raw: Column, granule: int) -> Column:
    return (raw + (granule - 1)) - ((raw + (granule - 1)) % granule)


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 180
    return F.least(d, 180 - d)


def safe_file_name(text: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|\x00-\x1f]', " "), r"\s+", " ")), F.lit(48))


def strict_level_text(text: Column) -> Column:
    """Whether a text is just a level from 1 to 60 with its suffix."""
    return text.rlike(r"^(?:[1-9]|[1-5][0-9]|60)[级級]$")


def digits_text(text: Column) -> Column:
    """Letter O read as 0, white space gone."""
    return F.regexp_replace(F.translate(text, "Oo", "00"), r"\s+", "")


def count_text(text: Column, digits: int = 6) -> Column:
    """A whole text of 1 to `digits` digits."""
    return F.when(text.rlike(rf"^[0-9]{{1,{digits}}}$"), text.try_cast("int"))


def bag_fraction(text: Column) -> Column:
    """struct<current, capacity> of 'n/m', at most four digits each, with n <= m; else NULL."""
    t = F.translate(text, "Oo", "00")
    n, m = (F.regexp_extract(t, r"(?<![0-9])([0-9]{1,4})\s*[/／]\s*([0-9]{1,4})(?![0-9])", k).try_cast("int") for k in (1, 2))
    return F.when(n <= m, F.struct(n.alias("current"), m.alias("capacity")))


def position(text: Column) -> Column:
    """struct<row, column> from 0 of 'r{n}c{m}', which counts from 1."""
    n, m = (F.regexp_extract(text, r"^r([0-9]{1,9})c([0-9]{1,9})$", k).try_cast("int") - 1 for k in (1, 2))
    return F.when(n.isNotNull() & m.isNotNull(), F.struct(n.alias("row"), m.alias("column")))


def file_name(text: Column, fallback: str = "account", most: int = 48) -> Column:
    """Forbidden characters become "_", runs of white space one space; the trimmed text is cut, and the fallback if it is empty."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]', "_"), r"\s+", " ")
    t = F.left(F.trim(t), F.lit(most))
    return F.when(t == "", fallback).otherwise(t)


def by_hue(hue: Column, share: Column, centres: dict[str, int], within: int = 19, least: float = 0.34) -> Column:
    """The name whose hue (0..179, a circle) is nearest, if it is near enough and covers enough; ties go to the first."""
    best = F.array_min(F.array(*[F.struct(hue_distance(hue, F.lit(c)).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, (n, c) in enumerate(centres.items())]))
    return F.when((best["d"] <= within) & (share >= least), best["n"])


def confidence_bucket(conf: Column) -> Column:
    """Percent in steps: below 50, 65, 80, 90, and above."""
    return F.when(conf.isNull(), "unknown").when(conf < 50, "<50").when(conf < 65, "50-65").when(conf < 80, "65-80").when(conf < 90, "80-90").otherwise(">=90")


def layout(width: Column, height: Column) -> Column:
    """Profile by aspect ratio, in integers."""
    return F.when(100 * width >= 200 * height, "wide").when(100 * width >= 150 * height, "standard").when(100 * width >= 100 * height, "tall_tablet").otherwise("portrait")


def page_kind(scores: dict[str, Column]) -> Column:
    """The page type with the most points; none, or a tie for the first place, is unknown."""
    every = F.array(*[F.struct(v.cast("int").alias("s"), F.lit(k).alias("k")) for k, v in scores.items()])
    top = F.array_max(F.transform(every, lambda x: x.s))
    winners = F.filter(every, lambda x: x.s == top)
    return F.when((top > 0) & (F.size(winners) == 1), F.get(winners, F.lit(0))["k"]).otherwise("unknown")


def page_override(auto: Column, confidence: Column, warning: Column, review: Column, confirmed: Column, expected: Column) -> Column:
    """struct<page, confidence, warning, review, source>: a confirmed pool decides, with a warning and a review if the page was taken for another; an expected type stands in for an unknown page alone."""
    made = lambda page, conf, warn, rev, source: F.struct(page.alias("page"), conf.cast("double").alias("confidence"), warn.cast("string").alias("warning"), rev.alias("review"), F.lit(source).alias("source"))
    conflict = (auto != "unknown") & (auto != confirmed)
    sure = F.when(conflict, F.least(confidence, F.lit(0.5))).otherwise(F.greatest(confidence, F.lit(0.95)))
    given = made(confirmed, sure, F.when(conflict, "confirmed_pool_conflict").otherwise(warning), conflict | review, "confirmed_pool")
    guess = made(expected, F.lit(0.2), F.lit("expected_page_type_used"), F.lit(True), "expected_page_type")
    return F.when(confirmed.isNotNull(), given).when((auto == "unknown") & expected.isNotNull() & (expected != "unknown"), guess).otherwise(made(auto, confidence, warning, review, "page"))


def display_width(text: Column) -> Column:
    """Columns on a screen: two for wide characters, one for others."""
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[ᄀ-ᅟ⺀-〾ぁ-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦]"))


def label(code: Column, labels: dict[str, str], other: str) -> Column:
    """A code's label; unknown codes in snake case get a general text, anything else stays as it is."""
    out = F.when(code.rlike(r"^[a-z]+(?:_[a-z]+)+$"), other).otherwise(code)
    for k, v in labels.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def finite(value: Column) -> Column:
    """NaN and infinities aren't safe in JSON."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def uuid5_hash(text: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """The SHA-1 that a version 5 id is made of, in hex."""
    return F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(text, "utf-8")))


def uuid5_text(h: Column) -> Column:
    part = lambda a, n: F.substring(h, a, n)
    fourth = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), fourth, part(18, 3), F.lit("-"), part(21, 12))


def uuid5(text: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """RFC 4122 version 5 id (default namespace: URL)."""
    return uuid5_text(uuid5_hash(text, namespace))


def with_defaults(record: Column, defaults: dict[str, Column]) -> Column:
    """A struct whose absent fields are filled."""
    for k, v in defaults.items():
        record = record.withField(k, F.coalesce(record[k], v))
    return record


def name_exit(known: Column, conf: Column, least: int) -> Column:
    """A known name of enough confidence needs no further variant."""
    return known & (conf >= least)


def agreement_exit(a: Column, b: Column) -> Column:
    """Two variants that say the same need no third."""
    return F.coalesce(a == b, F.lit(False))


def merge_tokens(rows, key: str, order: list[str], token: str):
    """The tokens of a line as one normalised text, in their order; a line has few tokens."""
    parts = F.sort_array(F.collect_list(F.struct(*order, digits_text(F.col(token)).alias("_t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), "").alias("text"))


def page_by_names(rows, key: str):
    """The page type whose names an image shows more of; equal numbers say nothing."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    g = rows.groupBy(key).agg(n("main").alias("_a"), n("support").alias("_b"))
    return g.select(key, F.when(F.col("_a") > F.col("_b"), "main").when(F.col("_b") > F.col("_a"), "support").otherwise("unknown").alias("page"))
