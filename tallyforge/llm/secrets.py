"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans are found by pattern alone: assignments of passwords, secrets, tokens and API keys (values of 6 characters or more), access identifiers and
long hexadecimal runs; per kind leftmost and non-overlapping. Three kinds of weak candidates come besides: identifiers (labelled users,
clients, accounts), keys (labelled passes and signatures, assignments of short values, long runs that mix cases and digits) and
endpoints (URLs, labelled hosts). None of them is reported by itself. Within a scope, the text between two blank lines, every part's
interval, widened by REACH on both sides, is joined with those of the complementary parts: an identifier or an endpoint is reported
if a key or a base secret lies in reach, a key if an identifier, an endpoint or a base access identifier does. Weak candidates that overlap a base span are
dropped, as what they say is reported already.

The interval join is a sweep: of all parts of a text in order of start, the greatest end before a part and the least start after it say
whether a complementary interval is in reach, so a scope with m identifiers and n keys costs m + n rows and not m * n pairs.

Positions are code points, ends exclusive. Null and empty texts have no spans; texts are read whole, whatever their length; rows of a null id and repeated rows
each get their row; equal spans of several kinds are told apart by kind. An empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.tables import Scratch, written

REACH = 300
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: In the order in which spans of one start are told.
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
_CHUNK = 256


def either_case(word: str) -> str:
    """The letters of a pattern in either case, spelt out: no engine folds others than A-Z then."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _labels(*names: str) -> str:
    return "(?:" + "|".join(either_case(n) for n in names) + ")"


_IS = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = _labels("password", "passwd", "secret", "token", "api_?key") + _IS + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4)
HEX = "[0-9a-f]{%d,}" % LEAST_HEX
IDENTIFIER = _labels("user_?name", "user_?id", "user", "login", "client_?id", "account_?id", "access_?key_?id") + _IS + "[A-Za-z0-9+/_.=@-]{3,}|A(?:SIA|ROA|IDA)[A-Z0-9]{12,}"
LABELLED = _labels("passphrase", "pass", "pwd", "private_?key", "access_?key", "auth", "bearer", "credential", "signature") + _IS + "[A-Za-z0-9+/_.=-]{4,}"
MIXED = "[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|""" + _labels("hostname", "host", "server", "endpoint") + _IS + "[A-Za-z0-9_.:-]{3,}"
BLANK = r"\n[\x20\t\r]*\n"
_SPAN = "array<struct<s:int,k:int,e:int>>"


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body with x as a variable: computed once, wherever body uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _running(xs: Column) -> Column:
    """Running sums of an array, chunk by chunk, so that long arrays don't cost the square of their length."""
    grow = lambda xs, zero: F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _CHUNK).cast("int")), lambda c: F.slice(xs, c * _CHUNK + 1, F.lit(_CHUNK)))

    def body(c: Column) -> Column:
        starts = grow(F.transform(c, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)), F.lit(0))
        return _let(starts, lambda at: F.flatten(F.transform(c, lambda x, i: F.slice(grow(x, F.get(at, i)), F.lit(2), F.size(x)))))

    return _let(chunks, body)


def spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """(s, k, e) of the matches of a pattern, of those only whose group `keep` accepts. The pieces between matches tell where they are."""
    none = F.array().cast(_SPAN)

    def found(m: Column) -> Column:
        steps = _let(F.split(text, pattern, -1), lambda pieces: F.transform(m, lambda x, i: F.char_length(F.get(pieces, i)) + F.char_length(x)))
        each = _let(_running(steps), lambda ends: F.transform(m, lambda x, i: F.struct((F.get(ends, i) - F.char_length(x)).alias("s"), F.lit(kind).alias("k"), F.get(ends, i).alias("e"))))
        if keep is None:
            return each
        kept = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m, lambda g: F.transform(g, keep))
        return F.transform(F.filter(F.arrays_zip(each.alias("x"), kept.alias("y")), lambda z: z.y), lambda z: z.x)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(found(m).cast(_SPAN)))


def _mixed(x: Column) -> Column:
    return F.rlike(x, F.lit("[A-Z]")) & F.rlike(x, F.lit("[a-z]")) & F.rlike(x, F.lit("[0-9]"))


def told(spans: Column) -> Column:
    """kind:start:end of each span, by start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x.k), x.s, x.e)), ",")


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts that have a complementary part in reach and scope.

    parts: text (any key columns named t1, t2), s, k, e; k as in KINDS, -1 for the end of a scope. One sort of each text's parts; see the module's notes on the sweep.
    """
    way = Window.partitionBy("t1", "t2").orderBy("s", "k", "e")
    back, ahead = way.rowsBetween(Window.unboundedPreceding, -1), way.rowsBetween(1, Window.unboundedFollowing)
    secret, public, base, gap = F.col("k").isin(0, 2, 4), F.col("k").isin(1, 3, 5), F.col("k").between(0, 2), F.col("k") == -1

    def both(name: str, what: Column) -> dict[str, Column]:
        return {f"{name}_end": F.max(F.when(what, F.col("e"))).over(back), f"{name}_start": F.min(F.when(what, F.col("s"))).over(ahead)}

    around = parts.withColumns(both("secret", secret) | both("public", public) | both("base", base) | both("gap", gap))

    def near(name: str) -> Column:
        before = (F.col(f"{name}_end") >= F.col("s") - reach) & (F.col(f"{name}_end") > F.coalesce("gap_end", F.lit(-1)))
        after = (F.col(f"{name}_start") <= F.col("e") + reach) & (F.col(f"{name}_start") < F.coalesce("gap_start", F.lit(2**31 - 1)))
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    covered = F.coalesce(F.col("base_end") > F.col("s"), F.lit(False)) | F.coalesce(F.col("base_start") < F.col("e"), F.lit(False))
    weak = around.where(F.col("k") >= 3).where(~covered)
    return weak.where(F.when(F.col("k") == 4, near("public")).otherwise(near("secret"))).select("t1", "t2", "s", "k", "e")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; and base and linked, the spans themselves as (s, k, e) arrays."""
    long_value = lambda g: F.char_length(g) >= LEAST_VALUE
    with Scratch(docs.sparkSession, "secrets") as tmp:
        text = F.coalesce("text", F.lit(""))
        key = {"t1": F.xxhash64("doc_id", "text"), "t2": F.xxhash64(F.lit("salt"), F.col("text"), F.col("doc_id"))}
        each = docs.select(
            "doc_id", *[v.alias(k) for k, v in key.items()],
            spans(text, ASSIGN, 0, long_value, 1).alias("assign"), spans(text, ACCESS, 1).alias("access"), spans(text, HEX, 2).alias("hex"),
            spans(text, IDENTIFIER, 3).alias("identifier"), spans(text, ENDPOINT, 5).alias("endpoint"),
            F.concat(spans(text, LABELLED, 4), spans(text, ASSIGN, 4, lambda g: ~long_value(g), 1), spans(text, MIXED, 4, _mixed)).alias("key"),
            spans(text, BLANK, -1).alias("gaps"),
        )
        base, weak = F.concat("assign", "access", "hex"), F.concat("identifier", "key", "endpoint")
        each = tmp.written(each.select("doc_id", "t1", "t2", base.alias("base"), *[F.size(c).cast("long").alias(f"n_{c}") for c in KINDS[:3]], weak.alias("weak"), F.when(F.size(weak) > 0, F.col("gaps")).alias("gaps")), "spans")
        # a pair of complementary parts needs two; most texts have none
        parts = each.where("size(weak) > 0 and size(base) + size(weak) > 1").select("t1", "t2", F.explode(F.concat("base", "weak", "gaps")).alias("x"))
        parts = parts.select("t1", "t2", "x.s", "x.k", "x.e").distinct()
        more = linked(parts, reach).groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e"))).alias("linked"))
        none = F.array().cast(_SPAN)
        out = each.join(more, ["t1", "t2"], "left").withColumn("linked", F.coalesce("linked", none))
        out = out.select("doc_id", *[f"n_{c}" for c in KINDS[:3]], F.sha2(F.encode(told(F.col("base")), "utf-8"), 256).alias("base_sha256"), told(F.concat("base", "linked")).alias("spans"), "base", "linked")
        return written(out, "secret-spans")


def _sql() -> str:
    def one(kind: int, pattern: str, group: int = 0, keep: str = "true") -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT t, {kind} AS k, m, g, sum(length(piece) + length(m)) OVER (PARTITION BY t ORDER BY j) AS e FROM (SELECT t, unnest(f) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS g,
 unnest(regexp_split_to_array(text, '{p}')[:len(f)]) AS piece, unnest(range(len(f))) AS j FROM (SELECT t, text, regexp_extract_all(text, '{p}') AS f FROM d)) QUALIFY {keep}"""

    mixed = "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"
    parts = [one(0, ASSIGN, 1, f"length(g) >= {LEAST_VALUE}"), one(1, ACCESS), one(2, HEX), one(3, IDENTIFIER), one(4, LABELLED), one(4, ASSIGN, 1, f"length(g) < {LEAST_VALUE}"), one(4, MIXED, 0, mixed), one(5, ENDPOINT), one(-1, BLANK)]
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    told = f"coalesce(string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e), '')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS t, doc_id, coalesce(text, '') AS text FROM documents),
p AS MATERIALIZED (SELECT DISTINCT t, CAST(e - length(m) AS BIGINT) AS s, k, CAST(e AS BIGINT) AS e FROM ({" UNION ALL ".join(f"({x})" for x in parts)})),
w AS (SELECT * FROM p WHERE k >= 3 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.t = p.t AND b.k BETWEEN 0 AND 2 AND b.s < p.e AND b.e > p.s)),
near AS (SELECT DISTINCT w.* FROM w JOIN p c ON c.t = w.t AND CASE WHEN w.k = 4 THEN c.k IN (1, 3, 5) ELSE c.k IN (0, 2, 4) END AND c.e >= w.s - {REACH} AND c.s <= w.e + {REACH}
  AND NOT EXISTS (SELECT 1 FROM p g WHERE g.t = w.t AND g.k = -1 AND g.s >= least(w.e, c.e) AND g.e <= greatest(w.s, c.s))),
b AS (SELECT t, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {told} AS base FROM p WHERE k BETWEEN 0 AND 2 GROUP BY t),
a AS (SELECT t, {told} AS spans FROM (SELECT * FROM p WHERE k BETWEEN 0 AND 2 UNION ALL SELECT * FROM near) GROUP BY t)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (t) LEFT JOIN a USING (t)
"""


SQL = _sql()
