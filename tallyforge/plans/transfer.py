"""Queries over imports and exports: strict JSON, workbooks written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import strict
from tallyforge.plans.registry import query
from tallyforge.sources import workbook
from tallyforge.sources.tables import load, written

#: Each conversation as an export with planted faults; its turns are the inventory.
CONV = """t AS (SELECT conv_id AS c, turn AS t, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, (conv_id * 7 + turn * 13) % 97 AS m FROM conversations), d AS (SELECT c FROM t GROUP BY c)"""


def exports(spark: SparkSession, d: str) -> DataFrame:
    c, t, m = F.col("conv_id"), F.col("turn"), (F.col("conv_id") * 7 + F.col("turn") * 13) % 97
    js = lambda x: F.expr(f"substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2)")
    level = m % 63
    item = F.concat(
        F.lit('{"kind":'), F.when(m % 17 == 0, "5").when(m % 17 == 1, '"other"').otherwise('"main"'), F.lit(',"name":'), js("substring(text, 1, 20)"), F.when(m % 19 == 0, "").otherwise(',"quality":"blue"'),
        F.lit(',"currentLevel":'), F.when(m % 23 == 0, F.concat(level.cast("string"), F.lit(".5"))).otherwise(level.cast("string")), F.lit(',"targetLevel":'), F.when(m % 29 == 0, "null").otherwise((level + m % 4 - 1).cast("string")), F.lit("}"),
    )
    item = F.when(m % 31 == 0, "[1,[2]]").otherwise(item)
    rows = load(spark, d, "conversations").select("conv_id", "turn", item.alias("item"))
    inv = rows.groupBy("conv_id").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"])).alias("inv"))
    text = F.concat(
        F.lit('{"schemaVersion":'), F.when(c % 7 == 0, "2").otherwise("1"), F.lit(',"exportedAt":'), F.when(c % 11 == 0, '"  "').otherwise('"2024"'), F.when(c % 13 == 0, "").otherwise(',"gameVersion":"one"'), F.lit(',"accountDisplayName":"a"'),
        F.lit(',"bag":'), F.when(c % 17 == 0, "[]").otherwise(F.concat(F.lit('{"currentCount":'), F.when(c % 5 == 0, "-1").otherwise("null"), F.lit(',"capacity":'), F.when(c % 3 == 0, '"x"').otherwise("150"), F.lit("}"))),
        F.lit(',"experience":{"orange":1,"purple":2e0,"white":'), F.when(c % 19 == 0, "1e999").otherwise("3"), F.lit('},"inventory":['), F.col("inv"), F.when(c % 23 == 0, "").otherwise("]"), F.lit("}"),
    )
    return inv.select(F.col("conv_id").alias("doc"), text.alias("text"))


def _at(cond: str, path: str, fault: str) -> str:
    return f"SELECT c AS doc, '{path}' AS path, '{fault}' AS fault FROM d WHERE c % 23 <> 0 AND ({cond})"


def _in(cond: str, path: str, fault: str) -> str:
    return f"SELECT c, 'inventory[' || i || ']{path}', '{fault}' FROM t WHERE c % 23 <> 0 AND {'' if not path else 'm % 31 <> 0 AND'} ({cond})"


_LV, _HALF, _TG = "m % 63", "m % 23 = 0", "m % 63 + m % 4 - 1"
_FAULTS = [
    "SELECT c AS doc, '' AS path, 'not_json' AS fault FROM d WHERE c % 23 = 0", _at("c % 7 = 0", "schemaVersion", "too_large"), _at("c % 11 = 0", "exportedAt", "empty"), _at("c % 13 = 0", "gameVersion", "missing"), _at("c % 17 = 0", "bag", "not_object"),
    _at("c % 17 <> 0 AND c % 5 = 0", "bag.currentCount", "too_small"), _at("c % 17 <> 0 AND c % 3 = 0", "bag.capacity", "not_whole"), _at("c % 19 = 0", "experience.white", "not_finite"),
    _in("m % 31 = 0", "", "not_object"), _in("m % 17 = 0", ".kind", "not_text"), _in("m % 17 = 1", ".kind", "not_allowed"), _in("trim(coalesce(substr(text, 1, 20), ''), ' ') = ''", ".name", "empty"), _in("m % 19 = 0", ".quality", "missing"),
    _in(_HALF, ".currentLevel", "not_whole"), _in(f"NOT {_HALF} AND {_LV} < 1", ".currentLevel", "too_small"), _in(f"NOT {_HALF} AND {_LV} > 60", ".currentLevel", "too_large"), _in("m % 29 = 0", ".targetLevel", "not_whole"),
    _in(f"m % 29 <> 0 AND {_TG} < 1", ".targetLevel", "too_small"), _in(f"m % 29 <> 0 AND {_TG} > 60", ".targetLevel", "too_large"), _in(f"m % 29 <> 0 AND {_TG} < {_LV} + CASE WHEN {_HALF} THEN 0.5 ELSE 0 END", ".targetLevel", "below_currentLevel"),
]


@query(f"WITH {CONV} " + " UNION ALL ".join(_FAULTS))
def import_faults(spark, d):
    return strict.faults(exports(spark, d), strict.EXPORT)


QUALITIES = ["orange", "purple", "blue", "green", "white"]
_SHEETS = {"about": ["field", "value"], "stars": [*workbook.INVENTORY.values()]}


def books(spark: SparkSession, d: str) -> DataFrame:
    """A workbook per brand: a sheet about it, and one of its parts, some with faults (brands that end in 3 have only whole rows)."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    bad = (k % 40 == 0) & ~F.endswith("p_brand", F.lit("3"))
    cells = F.array(F.when(k % 3 == 0, "support").otherwise("main"), F.col("p_name"), F.when(bad, "pink").otherwise("blue"), size.cast("string"), (size + k % 5 - F.when(bad, 3).otherwise(0)).cast("string"), F.when(bad & (k % 3 == 0), "many").otherwise((k % 4 + 1).cast("string")))
    p = load(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("book"), F.lit("stars").alias("sheet"), k.alias("pos"), cells.alias("cells"))
    about = p.groupBy("p_brand").agg(F.count("*").alias("n")).select(F.col("p_brand").alias("book"), F.lit("about").alias("sheet"), F.lit(0).alias("pos"), F.array(F.lit("parts"), F.col("n").cast("string")).alias("cells"))
    return workbook.books(rows.unionByName(about), _SHEETS)


def _catalog(spark, d):
    return load(spark, d, "part").where("p_partkey % 50 <> 1 or p_brand like '%3'").select(F.when(F.col("p_partkey") % 3 == 0, "support").otherwise("main").alias("kind"), F.col("p_name").alias("name"))


PARTS = """c AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'support' ELSE 'main' END AS kind, p_name AS name FROM part WHERE p_partkey % 50 <> 1 OR ends_with(p_brand, '3')),
 p AS (SELECT p_partkey AS k, p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS INT) AS row, CASE WHEN p_partkey % 3 = 0 THEN 'support' ELSE 'main' END AS kind, p_name AS name, CAST(p_size AS INT) AS level, p_partkey % 40 = 0 AND NOT ends_with(p_brand, '3') AS bad FROM part),
 q AS (SELECT p.*, CASE WHEN bad THEN 'pink' ELSE 'blue' END AS quality, CAST(level + k % 5 - CASE WHEN bad THEN 3 ELSE 0 END AS INT) AS target, CASE WHEN bad AND k % 3 = 0 THEN NULL ELSE CAST(k % 4 + 1 AS INT) END AS quantity, c.name IS NOT NULL AS known FROM p LEFT JOIN c USING (kind, name)),
 f AS (SELECT path, row, kind, name, quality, CASE WHEN level BETWEEN 1 AND 60 THEN level END AS level, CASE WHEN target BETWEEN 1 AND 60 THEN target END AS target, quantity, concat_ws(',', CASE WHEN level NOT BETWEEN 1 AND 60 THEN 'level_invalid' END, CASE WHEN target NOT BETWEEN 1 AND 60 THEN 'target_invalid' END, CASE WHEN quantity IS NULL THEN 'quantity_invalid' END,
  CASE WHEN level BETWEEN 1 AND 60 AND target BETWEEN 1 AND 60 AND target < level THEN 'target_below_level' END, CASE WHEN quality = 'pink' THEN 'quality_unknown' END, CASE WHEN NOT known THEN 'not_in_catalog' END) AS faults FROM q)"""


@query(f"WITH {PARTS} SELECT * FROM f")
def workbook_rows(spark, d):
    return workbook.inventory_rows(books(spark, d), _catalog(spark, d), QUALITIES).withColumn("faults", F.array_join("faults", ","))


@query(f"""WITH {PARTS} SELECT path, row_number() OVER (PARTITION BY path ORDER BY row, i) AS pos, kind, name, quality, level, target FROM (SELECT *, unnest(range(quantity)) AS i FROM f WHERE path NOT IN (SELECT path FROM f WHERE faults <> ''))""")
def workbook_items(spark, d):
    return workbook.inventory_items(workbook.inventory_rows(books(spark, d), _catalog(spark, d), QUALITIES))


#: A customer is an account, and its orders are items.
ACC = """acc AS (SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_nationkey % 2 = 0 THEN 'one' ELSE 'two' END AS version, c_name AS display, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 40 END AS current, 100 + c_nationkey AS capacity, c_custkey % 9 AS orange, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS purple, 7 AS white FROM customer),
 it AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' THEN 'support' ELSE 'main' END AS kind, o_orderpriority AS name, 'blue' AS quality, o_orderkey % 3 + 1 AS level, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 3 + 2 END AS target FROM orders),
 n AS (SELECT path, kind, name, quality, level, coalesce(target, level) AS target, count(*) AS quantity, min(pos) AS pos FROM it GROUP BY ALL),
 stars AS (SELECT path, 'stars' AS sheet, CAST(row_number() OVER (PARTITION BY path ORDER BY pos) + 1 AS INT) AS row, concat_ws('|', version, display, kind, name, quality, level, target, quantity) AS cells FROM n JOIN acc USING (path))"""


def _accounts(spark, d):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    a = load(spark, d, "customer").select(c.cast("string").alias("account_id"), F.when(n % 2 == 0, "one").otherwise("two").alias("version"), F.col("c_name").alias("display"), F.when(c % 5 != 0, c % 40).alias("current"), (100 + n).alias("capacity"), (c % 9).alias("orange"), F.when(c % 4 != 0, n).alias("purple"), F.lit(7).alias("white"), F.lit("2024-01-02").alias("imported_at"), F.lit(3).alias("images"), F.lit("by hand").alias("note"))
    k = F.col("o_orderkey")
    i = load(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("account_id"), k.alias("pos"), F.when(F.col("o_orderstatus") == "F", "support").otherwise("main").alias("kind"), F.col("o_orderpriority").alias("name"), F.lit("blue").alias("quality"), (k % 3 + 1).alias("level"), F.when(k % 4 != 0, k % 3 + 2).alias("target"))
    return a, i


def _back(files, sheets):
    """Every row below the headers, as read back; empty cells are left out of the text."""
    x = workbook.sheets(written(files, "books"), list(sheets)).where("row > 1")
    return x.select("path", "sheet", "row", F.concat_ws("|", "cells").alias("cells"))


@query(f"""WITH {ACC} SELECT * FROM stars UNION ALL SELECT path, 'experience', 2, concat_ws('|', 'orange', orange) FROM acc UNION ALL SELECT path, 'experience', 3, concat_ws('|', 'purple', purple) FROM acc UNION ALL SELECT path, 'experience', 4, 'white|7' FROM acc
 UNION ALL SELECT path, 'account', 2, concat_ws('|', 'game version', version) FROM acc UNION ALL SELECT path, 'account', 3, concat_ws('|', 'account', display) FROM acc UNION ALL SELECT path, 'account', 4, concat_ws('|', 'bag count', current) FROM acc UNION ALL SELECT path, 'account', 5, concat_ws('|', 'bag capacity', capacity) FROM acc""")
def export_books(spark, d):
    return _back(workbook.exports(*_accounts(spark, d)), workbook.EXPORT)


@query(f"""WITH {ACC}, c AS (SELECT path, count(*) AS actual FROM it GROUP BY 1), x AS (SELECT acc.*, coalesce(actual, 0) AS actual FROM acc LEFT JOIN c USING (path)) SELECT * FROM stars UNION ALL SELECT path, 'experience', 2, concat_ws('|', version, display, 'orange', orange, 1000) FROM acc UNION ALL SELECT path, 'experience', 3, concat_ws('|', version, display, 'purple', purple, 500) FROM acc
 UNION ALL SELECT path, 'audit', 2, concat_ws('|', '2024-01-02', 3, current, capacity, actual, actual - current, CASE WHEN current IS NULL THEN 'unknown' WHEN actual = current THEN 'matched' WHEN actual < current THEN 'missing' ELSE 'surplus' END, 'by hand') FROM x""")
def audited_export_books(spark, d):
    return _back(workbook.audited_exports(*_accounts(spark, d), {"orange": 1000, "purple": 500}), workbook.AUDITED)
