"""Places of rows in an order, by range blocks: no task sees more than a block of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.tables import Scratch

_IN_BLOCK = 33  # monotonically_increasing_id: the partition above this bit, the row in it below


def placed(tmp: Scratch, rows: DataFrame, groups: list[str], keys: list, name: str, size: str) -> DataFrame:
    """rows, with their place (from 0) among the rows of equal groups in the order of keys as `name`, and the number of those rows as `size`.

    Rows are dealt by ranges of (groups, keys), so a group of any size is spread; keys should tell the rows of a group apart.
    The blocks are written, as their counts and their rows must see the same bounds. Counts are one row per block and group.
    Null groups are a group. The columns _at and _block are used in here.
    """
    order = [F.asc_nulls_first(g) for g in groups] + list(keys)
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    block = tmp.written(at, "range-blocks").withColumn("_block", F.shiftright("_at", _IN_BLOCK))
    sums = block.groupBy("_block", *groups).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("_before", F.sum("_n").over(group.orderBy("_block")) - F.col("_n")).withColumn(size, F.sum("_n").over(group))
    own, sums = block.alias("b"), sums.alias("s")
    same = F.col("b._block") == F.col("s._block")
    for g in groups:
        same = same & F.col(f"b.{g}").eqNullSafe(F.col(f"s.{g}"))
    place = (F.col("s._before") + F.col("b._at") - F.col("s._first")).alias(name)
    return own.join(sums, same).select(*[F.col(f"b.{c}") for c in rows.columns], place, F.col(f"s.{size}"))
