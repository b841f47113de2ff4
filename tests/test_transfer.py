"""Strict JSON and workbooks on hand-made cases."""

import io
import zipfile

from tallyforge.functions import strict
from tallyforge.sources import workbook
from tallyforge.sources.tables import Scratch

DOC = "doc long, text string, path string, kind string"
GOOD = '{"schemaVersion":1,"exportedAt":"x","gameVersion":"g","accountDisplayName":"a","bag":{"currentCount":null,"capacity":5},"experience":{"orange":0,"purple":1.0,"white":null},"inventory":[{"kind":"main","name":"n","quality":"blue","currentLevel":1,"targetLevel":60}]}'


def found(spark, *texts):
    df = spark.createDataFrame([(k, t, "p", "k") for k, t in enumerate(texts)], DOC)
    return sorted((r.doc, r.path, r.fault) for r in strict.faults(df, strict.EXPORT).collect())


def test_strict_import(spark):
    item = '{"kind":"main","name":"n","quality":"blue","currentLevel":1,"targetLevel":60}'
    bad = [GOOD[:-1], None, "", "[]", "null", GOOD.replace(item, ""), GOOD.replace('"bag"', '"Bag"'), GOOD.replace('"name":"n"', '"name":" "'), GOOD.replace('"currentLevel":1', '"currentLevel":61'), GOOD.replace("60}", "0}"), GOOD.replace("1.0", "1.5"), GOOD.replace("[{", "[3,{")]
    got = found(spark, GOOD, *bad, GOOD.replace('"a"', '{"b":[[{"c":1e400}]]}'))
    assert got == sorted([
        (1, "", "not_json"), (2, "", "not_json"), (3, "", "not_json"), (4, "", "not_object"), (5, "", "not_object"), (7, "bag", "missing"), (8, "inventory[0].name", "empty"),
        (9, "inventory[0].currentLevel", "too_large"), (9, "inventory[0].targetLevel", "below_currentLevel"), (10, "inventory[0].targetLevel", "below_currentLevel"), (10, "inventory[0].targetLevel", "too_small"),
        (11, "experience.purple", "not_whole"), (12, "inventory[0]", "not_object"), (13, "accountDisplayName", "not_text"), (13, "accountDisplayName.b[0][0].c", "not_finite"),
    ])


def test_nodes_of_any_depth(spark):
    deep = "[" * 30 + "1" + "]" * 30
    with Scratch(spark, "test") as tmp:
        got = strict.nodes(spark.createDataFrame([(1, deep, "p", "k"), (2, '{"a":{},"b":[]}', "p", "k")], DOC), tmp).select("doc", "path", "kind").collect()
    assert sorted((r.path, r.kind) for r in got if r.doc == 1)[-1] == ("[0]" * 30, "number") and len([r for r in got if r.doc == 1]) == 31
    assert sorted((r.path, r.kind) for r in got if r.doc == 2) == [("", "object"), ("a", "object"), ("b", "array")]
    assert strict.faults(spark.createDataFrame([], DOC), strict.EXPORT).count() == 0


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def by_hand(sheet, shared="<si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>"):
    """A book of another writer: shared strings, gaps, rows without cells or numbers, absolute targets."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return zipped({
        "xl/workbook.xml": f'<workbook {MAIN} xmlns:r="{rel}"><sheets><sheet name="one" sheetId="1" r:id="a"/><sheet name="two &amp; 3" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {MAIN}>{shared}</sst>", "xl/worksheets/s1.xml": f"<worksheet {MAIN}><sheetData/></worksheet>", "xl/worksheets/s2.xml": f"<worksheet {MAIN}><sheetData>{sheet}</sheetData></worksheet>",
    })


def test_reading_a_book_of_another_writer(spark, tmp_path):
    rows = '<row r="2"><c r="B2" t="s"><v>0</v></c><c t="inlineStr"><is><t>level</t></is></c></row><row r="3"/><row><c r="B4" t="s"><v>1</v></c><c r="C4"><v>7</v></c><c r="AA4" t="b"><v>1</v></c></row><row r="9"><c r="C9" t="str"><v>x</v></c></row>'
    (tmp_path / "in").mkdir()
    files = {"a.xlsx": by_hand(rows), "b.xlsx": b"nothing", "c.xlsx": by_hand("<row><c"), "d.xlsx": by_hand('<row r="1"><c t="s"><v>9</v></c></row>'), "e.txt": b"x"}
    for n, data in files.items():
        (tmp_path / "in" / n).write_bytes(data)
    x = workbook.read(spark, str(tmp_path / "in"), "two & 3", True)
    got = {(r.path.rsplit("/", 1)[1], r.row): (r.cells, r.fault) for r in x.collect()}
    assert got[("a.xlsx", 2)] == ([None, "name", "level"], None) and got[("a.xlsx", 9)] == ([None, None, "x"], None)
    assert got[("a.xlsx", 4)][0] == [None, "rich", "7", *[None] * 23, "TRUE"] and len([k for k in got if k[0] == "a.xlsx"]) == 3
    assert got[("b.xlsx", None)][1] == "not_a_workbook" and got[("c.xlsx", None)][1] == got[("d.xlsx", None)][1] == "broken_sheet"
    t = workbook.table(x.where("fault is null").drop("fault"), {"n": "name", "lv": "level"})
    assert sorted((r.row, r.n, r.lv) for r in t.collect()) == [(4, "rich", "7"), (9, None, "x")]
    assert {r.fault for r in workbook.read(spark, str(tmp_path / "in"), "three", True).collect()} == {"no_such_sheet", "not_a_workbook"}


def test_books_come_back_as_they_were(spark):
    texts = [["1", "01", "-2.50", "1e5", "", None, " a <b> & \"c\" ", "zwei\nZeilen\r", "é\U0001f600", "=1+1", "\x01x"], ["only"]]
    rows = [("x", "s", k, c) for k, c in enumerate(texts)] + [("y", "s", 0, ["z"]), (None, "s", 0, ["lost"])]
    b = workbook.books(spark.createDataFrame(rows, "book string, sheet string, pos int, cells array<string>"), {"empty": [], 'q"uote': ["h"], "s": ["head"]})
    got = {(r.path, r.row): r.cells for r in workbook.sheet(b, "s").collect()}
    want = list(texts[0])
    want[-1] = "x"
    assert got == {("x", 1): ["head"], ("x", 2): want, ("x", 3): ["only"], ("y", 1): ["head"], ("y", 2): ["z"]} or got[("x", 2)] == [w if w != "" else None for w in want]
    assert [r.cells for r in workbook.sheet(b, 'q"uote').where("path = 'y'").collect()] == [["h"]] and workbook.sheet(b, None).count() == 0
    assert workbook.sheet(b, None, header="h").count() == 2


def test_sheets_are_read_in_one_pass_and_written_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(workbook, "PIECE", 500)
    rows = [(k, "s", i, [f"v{k}", str(i), "x" * 40]) for k in "ab" for i in reversed(range(60))] + [("c", "other", 0, ["lost"])]
    b = workbook.books(spark.createDataFrame(rows, "book string, sheet string, pos int, cells array<string>"), {"s": ["head"], "t": ["none"]})
    w = workbook.Writer({"s": ["head"], "t": ["none"]})
    for _, _, i, cells in rows[:60]:
        w.row(0, cells)
        assert w.held <= 500
    assert [r[:2] for r in workbook.rows_of(w.close(), ["s", "t"])] == [("s", k + 1) for k in range(61)] + [("t", 1)]
    x = workbook.sheets(b, ["s", "t", "none"], True)
    assert x._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2  # one that writes, one that reads
    got = {(r.path, r.sheet, r.row): r.cells for r in x.where("fault is null").collect()}
    want = {(k, "s", i + 2): [f"v{k}", str(i), "x" * 40] for k in "ab" for i in range(60)} | {(k, "s", 1): ["head"] for k in "abc"} | {(k, "t", 1): ["none"] for k in "abc"}
    assert got == want and x.where("fault = 'no_such_sheet' and sheet = 'none'").count() == 3
