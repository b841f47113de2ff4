"""Merkle manifest of a dataset: a root per group of rows, a root of those roots, and a proof for each row.

H is the lower-case hex SHA-256 of its inputs' text put together. A leaf is H of the row's columns, each `-` if null, else the
number of its UTF-8 bytes, `:` and the value. Within a group leaves stand by key; every `fanout` consecutive nodes become their H
(the last run may be shorter, down to one) until one node remains, the group's subroot; subroots in the order of the group
column (null first, by bytes) become the root in the same way.

Superblock reduction: places are divided by fanout**levels, one grouped function collapses `levels` levels of such a bucket,
which gives each row the lower part of its proof and the bucket one node; bucket nodes are reduced by the same step until a group has
one bucket, and the proofs of a bucket are put behind those of its rows. A bucket has at most fanout**levels rows, whatever the group.

Null keys come first in their group; rows of one key are ordered by leaf; repeated rows are leaves of their own, one per copy. A null in the group column is a group. Texts are hashed
whole, by Spark's own functions. An empty table gives an empty manifest. Columns besides those named are not looked at, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.places import placed
from tallyforge.sources.tables import Scratch, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, LEVELS = 2, 12
TAMPER_DIVISOR = 7


def leaf_text(columns: Sequence[Column]) -> Column:
    """What a leaf is the H of."""
    parts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts])


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _collapse(fanout: int, levels: int):
    """The function of one bucket: the siblings of each row, level by level, left and right of its own node, and the bucket's node."""

    def h(nodes: list[bytes]) -> bytes:
        return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        nodes, rest, step = [bytes(x) for x in pdf["node"]], int(pdf["n"].iloc[0]), 1
        before, after = [[] for _ in nodes], [[] for _ in nodes]
        for _ in range(levels):
            if rest == 1:
                break
            left = [b"".join(nodes[q - q % fanout : q]) for q in range(len(nodes))]
            right = [b"".join(nodes[q + 1 : q - q % fanout + fanout]) for q in range(len(nodes))]
            for j in range(len(before)):
                before[j].append(left[j // step])
                after[j].append(right[j // step])
            nodes = [h(nodes[q : q + fanout]) for q in range(0, len(nodes), fanout)]
            rest, step = -(-rest // fanout), step * fanout
        return pdf.assign(before=before, after=after, top=[nodes[0]] * len(pdf)).drop(columns="bucket")

    return run


def _climb(tmp: Scratch, nodes: DataFrame, most: int, fanout: int, levels: int) -> DataFrame:
    """nodes (g, i, n, node and string columns; n the size of group g, `most` the greatest n) with before, after: all siblings up to the group's node, and top, that node."""
    size, steps = fanout**levels, []
    while True:
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", before array<binary>, after array<binary>, top binary"
        bucket = nodes.withColumn("bucket", F.floor(F.col("i") / size))
        steps.append(tmp.written(bucket.groupBy("g", "bucket").applyInPandas(_collapse(fanout, levels), shape), "buckets"))
        if most <= size:
            break
        most = -(-most // size)
        nodes = steps[-1].where(F.col("i") % size == 0).select("g", F.floor(F.col("i") / size).alias("i"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"))
    out = steps.pop()
    while steps:
        up = out.select("g", F.col("i").alias("bucket"), F.col("before").alias("b"), F.col("after").alias("a"), F.col("top").alias("t"))
        low = steps.pop().withColumn("bucket", F.floor(F.col("i") / size))
        out = low.join(up, ["g", "bucket"]).withColumns({"before": F.concat("before", "b"), "after": F.concat("after", "a"), "top": F.col("t")}).drop("bucket", "b", "a", "t")
    return out


def manifest(rows: DataFrame, group: Column, key: Column, leaf: Column, changed: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """key, grp, leaf, changed, before, after, subroot, root per row; digests are binary.

    before and after have an array entry per level from the leaf up, groups' levels first: the siblings left and right of the row's own node.
    leaf and changed are the texts of the row's leaf and of what is to be checked against the manifest in its place (null: the same).
    """
    with Scratch(rows.sparkSession, "merkle") as tmp:
        digest = lambda c: F.unhex(F.sha2(F.encode(c, "utf-8"), 256))
        each = rows.select(group.cast("string").alias("grp"), key.alias("key"), digest(leaf).alias("node"), digest(changed if changed is not None else F.lit(None).cast("string")).alias("changed"))
        copies = each.groupBy("grp", "key", "node", "changed").agg(F.count("*").alias("c")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c")))).drop("c")
        copies = tmp.written(copies, "leaves")
        groups = placed(tmp, tmp.written(copies.select("grp").distinct(), "groups"), [], [F.asc_nulls_first("grp")], "g", "of")
        groups = tmp.written(groups, "numbered-groups")
        at = placed(tmp, copies, ["grp"], [F.asc_nulls_first("key"), F.asc("node"), F.asc_nulls_first("changed"), F.asc("copy")], "i", "n").alias("a")
        numbered = at.join(groups.alias("g"), F.col("a.grp").eqNullSafe(F.col("g.grp")))
        # the key travels as text: pandas keeps no 64-bit integers beside nulls
        nodes = tmp.written(numbered.select("g.g", "a.i", "a.n", "a.node", "a.changed", F.col("a.key").cast("string").alias("key")), "nodes")
        low = _climb(tmp, nodes, nodes.agg(F.max("n")).first()[0] or 1, fanout, levels)
        subroots = low.where("i = 0").select("g", "top").join(groups, "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.col("of").alias("n"), F.col("top").alias("node"))
        high = _climb(tmp, subroots, groups.agg(F.max("of")).first()[0] or 1, fanout, levels)
        high = high.select(F.col("i").alias("g"), F.col("before").alias("b"), F.col("after").alias("a"), F.col("top").alias("root")).join(groups.select("g", "grp"), "g")
        out = low.join(high, "g").select(
            F.col("key").cast(rows.select(key).schema[0].dataType).alias("key"), "grp", F.col("node").alias("leaf"), F.coalesce("changed", "node").alias("changed"),
            F.concat("before", "b").alias("before"), F.concat("after", "a").alias("after"), F.col("top").alias("subroot"), "root",
        )
        return written(out, "manifest")


def folded(leaf: Column) -> Column:
    """The root, in hex, that a leaf and the siblings of a manifest's row give."""
    return F.aggregate(F.arrays_zip("before", "after"), _hex(leaf), lambda acc, s: F.sha2(F.encode(F.concat(_hex(s.before), acc, _hex(s.after)), "utf-8"), 256))


def proof_text() -> Column:
    """The siblings of a manifest's row from the leaf up, left to right."""
    return F.array_join(F.transform(F.arrays_zip("before", "after"), lambda s: F.concat(_hex(s.before), _hex(s.after))), "")


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, checked against a copy in which n_chars is one more where 7 divides the CRC-32 of the decimal doc_id; rows of a null doc_id aren't tampered with."""
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % TAMPER_DIVISOR == 0
    columns = {c: F.col(c) for c in COLUMNS}
    other = columns | {"n_chars": F.col("n_chars") + 1}
    m = manifest(docs, F.col("lang"), F.col("doc_id"), leaf_text([*columns.values()]), F.when(tampered, leaf_text([*other.values()])))
    out = m.select(
        F.col("key").alias("doc_id"), F.col("grp").alias("lang"), _hex("leaf").alias("leaf"), _hex("subroot").alias("subroot"), _hex("root").alias("root"),
        F.sha2(F.encode(proof_text(), "utf-8"), 256).alias("proof_sha256"), folded(F.col("changed")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB SQL of audit, level by level; CRC-32 bit by bit, folds as list_reduce over `side digest` texts.
SQL = """
WITH RECURSIVE
part AS (SELECT *, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: (ord(c) >> b) & 1)))),
    lambda x, b: xor(x >> 1, CASE WHEN xor(x, b) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc FROM documents),
txt AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS m_chars FROM part),
leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(m_chars AS VARCHAR)) || ':' || m_chars, '-') || tail) AS other FROM txt),
place AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (SELECT lang, 0 AS l, i, n, leaf AS h FROM place
  UNION ALL SELECT lang, any_value(l) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, i // 2),
subs AS (SELECT lang, h AS subroot, l AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS l, i, n, subroot AS h FROM subs
  UNION ALL SELECT any_value(l) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY i // 2),
low AS (SELECT a.lang, a.i, list(coalesce(CASE WHEN t.i % 2 = 0 THEN 'L' ELSE 'R' END || t.h, 'N') ORDER BY x.l) AS p
  FROM place a JOIN subs s ON s.lang IS NOT DISTINCT FROM a.lang JOIN (SELECT unnest(range(64)) AS l) x ON x.l < s.height
  LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM a.lang AND t.l = x.l AND t.i = xor(a.i >> x.l, 1) GROUP BY a.lang, a.i),
high AS (SELECT s.lang, list(coalesce(CASE WHEN t.i % 2 = 0 THEN 'L' ELSE 'R' END || t.h, 'N') ORDER BY x.l) AS p
  FROM subs s JOIN (SELECT unnest(range(64)) AS l) x ON x.l < (SELECT max(l) FROM top) LEFT JOIN top t ON t.l = x.l AND t.i = xor(s.i >> x.l, 1) GROUP BY s.lang),
proofs AS (SELECT a.*, s.subroot, (SELECT h FROM top WHERE n = 1) AS root, list_concat(coalesce(low.p, []), coalesce(high.p, [])) AS p
  FROM place a JOIN subs s ON s.lang IS NOT DISTINCT FROM a.lang LEFT JOIN low ON low.lang IS NOT DISTINCT FROM a.lang AND low.i = a.i LEFT JOIN high ON high.lang IS NOT DISTINCT FROM a.lang),
done AS (SELECT doc_id, lang, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(p, lambda x: substr(x, 2)), ''), '')) AS proof_sha256,
  list_reduce(list_prepend(other, p), lambda acc, x: sha256(CASE x[1] WHEN 'L' THEN substr(x, 2) || acc ELSE acc || substr(x, 2) END)) AS folded_root FROM proofs)
SELECT *, folded_root = root AS verified FROM done
"""
