"""Strict import of JSON: every node of a document with its path, and every fault against a set of rules, one row each.

Documents are parsed once, as variants; each level of nesting is one generator, so a document of any depth is walked without a schema and without Python. Null texts, texts that are no JSON
and objects with a key twice are `not_json`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.tables import Scratch, written


@dataclass(frozen=True)
class Rule:
    """What stands at a path such as bag.capacity or inventory[].name (the root is "").

    kind: object, array, text (not blank), whole (a whole number) or number; values: the only ones allowed, as text. least_of names a sibling that a number may not be below.
    """

    path: str
    kind: str
    nullable: bool = False
    least: float | None = None
    most: float | None = None
    values: tuple[str, ...] | None = None
    least_of: str | None = None


def _kind(v: Column) -> Column:
    """object, array, text, number, boolean, null or other of a variant."""
    s = F.schema_of_variant(v)
    return (
        F.when(F.startswith(s, F.lit("OBJECT")), "object").when(F.startswith(s, F.lit("ARRAY")), "array").when(s == "STRING", "text").when(s.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number")
        .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("other")
    )


def nodes(docs: DataFrame, tmp: Scratch) -> DataFrame:
    """(doc, text) -> doc, path (a.b[2].c), pattern (a.b[].c), parent (path), key, kind, v of every node, the root's path being "". kind is not_json for texts that are none."""
    v = F.try_parse_json("text")
    root = docs.select("doc", F.lit("").alias("path"), F.lit("").alias("pattern"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("key"), F.when(v.isNull(), "not_json").otherwise(_kind(v)).alias("kind"), v.alias("v"))
    level, every = tmp.written(root, "root"), None
    while True:
        every = level if every is None else every.unionByName(level)
        inner = level.where("kind in ('object', 'array')").select("doc", F.col("path").alias("p"), F.col("pattern").alias("pp"), F.col("v").alias("c"))
        child = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("c").outer())).where("pos is not null").select("doc", "p", "pp", "pos", "key", F.col("value").alias("v"))
        joined = lambda base, step: F.when(F.col("key").isNull(), F.concat(F.col(base), step)).when(F.col(base) == "", F.col("key")).otherwise(F.concat(F.col(base), F.lit("."), F.col("key")))
        at, pattern = joined("p", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))), joined("pp", F.lit("[]"))
        level = tmp.written(child.select("doc", at.alias("path"), pattern.alias("pattern"), F.col("p").alias("parent"), "key", _kind(F.col("v")).alias("kind"), "v"), "level")
        if level.isEmpty():
            return every


def faults(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc, text) -> doc, path, fault: every place where a document breaks a rule.

    not_json; missing (the object above lacks the key); not_<kind>; empty; too_small; too_large; not_allowed; below_<sibling>; not_finite (a number beyond doubles anywhere).
    What is below a node of the wrong kind isn't asked for. Keys without a rule are allowed.
    """
    with Scratch(docs.sparkSession, "strict") as tmp:
        every = nodes(docs, tmp)
        number = lambda v: F.try_variant_get(v, "$", "double")
        out = [every.where("kind = 'not_json'").select("doc", "path", F.lit("not_json").alias("fault"))]
        odd = (F.col("kind") == "number") & (F.abs(number(F.col("v"))) > F.lit(1.7976931348623157e308))
        out.append(every.where(odd).select("doc", "path", F.lit("not_finite").alias("fault")))
        ruled = every.where(F.col("pattern").isin([r.path for r in rules]) & (F.col("kind") != "not_json") & ~odd)
        text, value, fault = F.try_variant_get("v", "$", "string"), number(F.col("v")), F.lit(None).cast("string")
        for r in rules:
            fits = {"object": F.col("kind") == "object", "array": F.col("kind") == "array", "text": F.col("kind") == "text", "number": F.col("kind") == "number", "whole": (F.col("kind") == "number") & (value == F.floor(value))}[r.kind]
            why = F.when(~fits, f"not_{r.kind}")
            if r.kind == "text":
                why = why.when(F.trim(text) == "", "empty")
            if r.least is not None:
                why = why.when(value < r.least, "too_small")
            if r.most is not None:
                why = why.when(value > r.most, "too_large")
            if r.values is not None:
                why = why.when(~text.isin(list(r.values)), "not_allowed")
            if r.nullable:
                why = F.when(F.col("kind") != "null", why)
            fault = F.when(F.col("pattern") == r.path, why).otherwise(fault)
        out.append(ruled.select("doc", "path", fault.alias("fault")).where("fault is not null"))
        # what an object lacks, or has in the wrong order, is asked of the object itself
        above: dict[str, list[Rule]] = {}
        for r in rules:
            if r.path and not r.path.endswith("[]"):
                parent, _, _ = r.path.rpartition(".")
                above.setdefault(parent, []).append(r)
        for parent, own in above.items():
            key = lambda r: r.path.rpartition(".")[2]
            get = lambda k, t: F.try_variant_get("v", f"$['{k}']", t)
            place = lambda k: F.concat("path", F.when(F.col("path") == "", F.lit("")).otherwise(F.lit(".")), F.lit(k))
            each = [F.when(get(key(r), "variant").isNull(), F.struct(place(key(r)).alias("path"), F.lit("missing").alias("fault"))) for r in own]
            each += [F.when(get(key(r), "double") < get(r.least_of, "double"), F.struct(place(key(r)).alias("path"), F.lit(f"below_{r.least_of}").alias("fault"))) for r in own if r.least_of]
            at = every.where((F.col("pattern") == parent) & (F.col("kind") == "object")).select("doc", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
            out.append(at.select("doc", "x.path", "x.fault"))
        found = out[0]
        for x in out[1:]:
            found = found.unionByName(x)
        return written(found, "faults")


#: The export of an account: what an import asks of it.
EXPORT = (
    Rule("", "object"), Rule("schemaVersion", "whole", least=1, most=1), Rule("exportedAt", "text"), Rule("gameVersion", "text"), Rule("accountDisplayName", "text"), Rule("bag", "object"), Rule("bag.currentCount", "whole", True, 0), Rule("bag.capacity", "whole", True, 1),
    Rule("experience", "object"), Rule("experience.orange", "whole", True, 0), Rule("experience.purple", "whole", True, 0), Rule("experience.white", "whole", True, 0), Rule("inventory", "array"), Rule("inventory[]", "object"),
    Rule("inventory[].kind", "text", values=("main", "support")), Rule("inventory[].name", "text"), Rule("inventory[].quality", "text", values=("orange", "purple", "blue", "green", "white")),
    Rule("inventory[].currentLevel", "whole", least=1, most=60), Rule("inventory[].targetLevel", "whole", least=1, most=60, least_of="currentLevel"),
)
