"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines are one window, known by two 64-bit hashes. Of a window that occurs
more than once anywhere, the first occurrence (least doc_id, then position) stays; lines that any later
occurrence covers go. Texts of under three lines, null texts and null ids are left as they are; repeated
rows of one id and text share one fate, rows of one id with other texts are told apart by a hash of the text. Texts may be of any length;
extra columns are kept, but for n_lines and n_removed, which are made anew; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, h, p) of every later occurrence of a repeated window; h is the hash of the text, so rows of one id with other texts are told apart.

    The first occurrence is a partial aggregate, so a window in a third of all rows is one row per task there;
    the join back is a plain equi-join, whose hot side adaptive execution splits.
    """
    lines = F.split("text", "\n", -1)
    h = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), lines.alias("ls")).where(f"size(ls) >= {WINDOW}")
    keys = F.transform(
        F.sequence(F.lit(1), F.size("ls") - (WINDOW - 1)),
        lambda i: F.struct(
            F.xxhash64(*[F.get("ls", i - 1 + k) for k in range(WINDOW)]).alias("w1"),
            F.xxhash64(F.lit("salt"), *[F.get("ls", i - 1 + k) for k in range(WINDOW)]).alias("w2"),
        ),
    )
    at = h.select("doc_id", "h", F.posexplode(keys).alias("p", "w")).select("doc_id", "h", "p", "w.w1", "w.w2")
    first = at.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "h", "p")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return at.join(first, ["w1", "w2"]).where("struct(doc_id, h, p) <> first").select("doc_id", "h", "p").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut, plus n_lines and n_removed.

    Covered positions are merged into a set of gaps per document, so a text is put together from slices in linear time.
    The row travels in a struct, so its columns clash with none used here.
    """
    covered = repeated_starts(docs.select("doc_id", "text")).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(row.alias("d"), F.col("doc_id"), F.xxhash64("text").alias("h")).join(covered, ["doc_id", "h"], "left").withColumn("ls", F.split("d.text", "\n", -1))
    # a kept stretch lies between the end of a covered start and the next covered start
    size = F.size("ls")
    bounds = F.transform(
        F.sequence(F.lit(0), F.size("ps")),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.least(F.coalesce(F.get("ps", i - 1), F.lit(0)) + WINDOW, size)).alias("a"),
            F.when(i == F.size("ps"), size).otherwise(F.get("ps", i)).alias("b"),
        ),
    )
    kept = F.flatten(F.transform(F.filter(bounds, lambda g: g.b > g.a), lambda g: F.slice("ls", g.a + 1, g.b - g.a)))
    out = out.withColumn("kept", F.when(F.col("ps").isNotNull(), kept).otherwise(F.col("ls")))
    text = F.when(F.col("ps").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("d.text"))
    return out.select(
        *[F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")],
        text.alias("text"),
        F.coalesce(size, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(size - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
    )


#: DuckDB SQL over a relation `src` (doc_id, text): doc_id, text, n_lines, n_removed. Windows are compared by their wording.
SQL = """
ls AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM {src}),
ln AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS p FROM ls WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, p, x || chr(10) || lead(x, 1) OVER d || chr(10) || lead(x, 2) OVER d AS k FROM ln WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w WHERE k IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1),
kept AS (SELECT ln.doc_id, string_agg(x, chr(10) ORDER BY ln.p) AS text, count(*) AS k FROM ln LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY ln.doc_id),
cut AS (SELECT ls.doc_id, CASE WHEN ls.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - coalesce(k, 0), 0) AS BIGINT) AS n_removed FROM ls LEFT JOIN kept USING (doc_id))
"""
