"""Workbooks (xlsx): named sheets read from their own XML, and workbooks built from rows.

Files are read by Spark (binaryFile), so any store works; a file is one row, whose sheet is streamed cell by cell in the task that has it. Values come as texts, as the sheet holds them;
booleans as TRUE and FALSE, errors as their code. A workbook that can't be read gives no rows, or one fault, as asked for.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from functools import lru_cache
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.parse import file_name

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384  # of the format
ROWS = 4096
PIECE = 1 << 20  # of text or of bytes held before they are passed on
_ROW = "row int, cells array<string>, fault string"


def _texts(node: ElementTree.Element) -> str:
    """The text of a string item, without the readings that may stand beside it."""
    return "".join(t.text or "" for part in node if part.tag in (f"{_MAIN}t", f"{_MAIN}r") for t in ([part] if part.tag == f"{_MAIN}t" else part.findall(f"{_MAIN}t")))


def _place(reference: str | None, before: int) -> int:
    """The column (from 0) of a cell's reference; the one after the cell before if it has none."""
    n = 0
    for c in re.match(r"[A-Z]*", reference or "")[0]:
        n = n * 26 + ord(c) - 64
    return n - 1 if n else before + 1


def _index(book: zipfile.ZipFile) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """The targets by their ids, and (name, id) of each sheet."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    return rels, [(s.get("name"), s.get(_REL)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def _sheet(index: tuple[dict[str, str], list[tuple[str, str]]], name: str | None) -> str | None:
    """The part of the named sheet (of the first one, if no name is given)."""
    for own, key in index[1]:
        if name is None or own == name:
            target = index[0][key]
            return target[1:] if target.startswith("/") else f"xl/{target}"
    return None


def _by_header(book: zipfile.ZipFile, header: str, shared: list[str]) -> str | None:
    """The part of the first sheet whose first row has a cell of that text."""
    index = _index(book)
    for name, _ in index[1]:
        part = _sheet(index, name)
        first = next(_read_cells(book, part, shared), None)
        if first and header in [(c or "").strip() for c in first[1]]:
            return part
    return None


def _shared(book: zipfile.ZipFile) -> list[str]:
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, node in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if node.tag == f"{_MAIN}si":
                shared.append(_texts(node))
                node.clear()
    return shared


def _row_nodes(book: zipfile.ZipFile, part: str) -> Iterator[ElementTree.Element]:
    """Small parts are parsed at once, large ones (and what stands before a fault) as they are read."""
    if book.getinfo(part).file_size <= PIECE:
        try:
            yield from list(ElementTree.fromstring(book.read(part)).iter(f"{_MAIN}row"))
            return
        except ElementTree.ParseError:
            pass
    for _, node in ElementTree.iterparse(book.open(part)):
        if node.tag == f"{_MAIN}row":
            yield node


def _read_cells(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    at = 0
    for node in _row_nodes(book, part):
        at, values, k = int(node.get("r") or at + 1), [], -1
        for c in node.findall(f"{_MAIN}c"):
            k = _place(c.get("r"), k)
            kind, v, inline = c.get("t"), c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
            text = v.text if v is not None else None
            if kind == "s" and text is not None:
                text = shared[int(text)]
            elif kind == "inlineStr":
                text = _texts(inline) if inline is not None else None
            elif kind == "b" and text is not None:
                text = "TRUE" if text == "1" else "FALSE"
            values += [None] * (k + 1 - len(values))
            values[k] = text
        node.clear()
        if values:
            yield at, values


_WRONG = (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError)


def rows_of(content: bytes, names: list[str | None], header: str | None = None) -> Iterator[tuple[str | None, int | None, list[str | None] | None, str | None]]:
    """(sheet, row number, values, fault) of the named sheets' rows that have cells; what can't be read gives a row with its fault. The file is opened once."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        shared = _shared(book)
        index = _index(book) if header is None else ({}, [])
    except _WRONG:
        yield from ((n, None, None, "not_a_workbook") for n in names)
        return
    for name in names:
        try:
            part = _sheet(index, name) if header is None else _by_header(book, header, shared)
        except _WRONG:
            yield name, None, None, "not_a_workbook"
            continue
        if part is None:
            yield name, None, None, "no_such_sheet"
            continue
        try:
            for row, values in _read_cells(book, part, shared):
                yield name, row, values, None
        except _WRONG:
            yield name, None, None, "broken_sheet"


_ROWS = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("fault", pa.string())])


def sheets(files: DataFrame, names: list[str | None], faults: bool = False, header: str | None = None) -> DataFrame:
    """(path, content) -> path, sheet (as named), row, cells of each of the named sheets, in one pass over the files; null names and header as in `sheet`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                for name, row, cells, fault in rows_of(content.as_py() or b"", names, header):
                    out.append((path, name, row, cells, fault))
                    if len(out) == ROWS:
                        yield made()
                        out = []
        if out:
            yield made()

    x = files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, f"path string, sheet string, {_ROW}")
    return x if faults else x.where("fault is null").drop("fault")


def sheet(files: DataFrame, name: str | None = None, faults: bool = False, header: str | None = None) -> DataFrame:
    """(path, content) -> path, row, cells of the named sheet, of the first whose first row has the header, or of the first. With faults, files that can't be read give a row with their fault instead."""
    return sheets(files, [name], faults, header).drop("sheet")


def read(spark: SparkSession, path: str, name: str | None = None, faults: bool = False) -> DataFrame:
    """The rows of a sheet of all workbooks below a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path)
    return sheet(f.select("path", "content"), name, faults)


def table(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(path, row, cells) -> path, row and the given columns: the first row of a file that has all headers (trimmed) is its header, and what is below it its content.

    columns: name -> header. Files without such a row give none, nor do rows whose asked cells are all empty.
    """
    trimmed = F.transform("cells", lambda c: F.trim(c))
    at = F.struct(*[F.array_position(trimmed, h).cast("int").alias(n) for n, h in columns.items()])
    has = rows.select("path", "row", at.alias("at")).where(" and ".join(f"at.`{n}` > 0" for n in columns))
    head = has.groupBy("path").agg(F.min(F.struct("row", "at")).alias("h"))
    x = rows.join(head, "path").where(F.col("row") > F.col("h.row"))
    cell = lambda n: F.get("cells", F.col(f"h.at.`{n}`") - 1)
    x = x.select("path", "row", *[F.when(F.trim(cell(n)) != "", cell(n)).alias(n) for n in columns])
    return x.dropna(how="all", subset=list(columns))


@lru_cache(maxsize=MOST_COLUMNS)
def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


#: Characters that XML can't hold.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]+)?\Z")


def _cell(place: str, v: str | None) -> str:
    if v is None:
        return ""
    if _NUMBER.match(v):
        return f'<c r="{place}"><v>{v}</v></c>'
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", v)).replace(chr(13), "&#13;")}</t></is></c>'


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


@lru_cache(maxsize=64)
def _frame(sheets: tuple[str, ...]) -> dict[str, str]:
    """The parts of a workbook beside its sheets."""
    kind, main, rel = "http://schemas.openxmlformats.org", _MAIN[1:-1], _REL[1:].split("}")[0]
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{kind}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{kind}/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kind}/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    return {name: _XML + text for name, text in parts.items()}


class Writer:
    """A workbook written row by row, sheet after sheet: what is held is the archive so far and a piece of the sheet at hand. Texts that are plain numbers become numbers."""

    def __init__(self, sheets: dict[str, list[str]]):
        self.sheets, self.at, self.out = list(sheets.items()), -1, io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        for name, text in _frame(tuple(sheets)).items():
            self.zip.writestr(name, text)

    def row(self, sheet: int, cells: Sequence[str | None]) -> None:
        """A row of a sheet (from 0), which is the one at hand or a later one."""
        while self.at < sheet:
            self._end()
            self.at += 1
            self.part, self.piece, self.held, self.rows = None, [f'{_XML}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'], 0, 0
            self._add(self.sheets[self.at][1])
        self._add(cells)

    def close(self) -> bytes:
        while self.at < len(self.sheets) - 1:
            self.row(self.at + 1, ())
            self.piece.pop()
        self._end()
        self.zip.close()
        return self.out.getvalue()

    def _add(self, cells: Sequence[str | None]) -> None:
        self.rows += 1
        if self.rows > MOST_ROWS or len(cells) > MOST_COLUMNS:
            raise ValueError(f"sheet {self.sheets[self.at][0]} is larger than the format allows")
        self.piece.append(f'<row r="{self.rows}">' + "".join([_cell(f"{_letters(j)}{self.rows}", v) for j, v in enumerate(cells)]) + "</row>")
        self.held += len(self.piece[-1])
        if self.held > PIECE:
            self.part = self.part or self.zip.open(self._name(), "w", force_zip64=True)
            self.part.write("".join(self.piece).encode())
            self.piece, self.held = [], 0

    def _name(self) -> str:
        return f"xl/worksheets/sheet{self.at + 1}.xml"

    def _end(self) -> None:
        if self.at < 0:
            return
        rest = "".join(self.piece) + "</sheetData></worksheet>"
        if self.part is None:
            self.zip.writestr(self._name(), rest)
        else:
            self.part.write(rest.encode())
            self.part.close()


def books(rows: DataFrame, sheets: dict[str, list[str]]) -> DataFrame:
    """(book, sheet, pos, cells array<string>) -> (path, content): one workbook per book, with the given sheets (name -> headers) and below them the rows in order of pos.

    A book is what one user exports; larger ones than the format allows are refused. Rows stream over partitions sorted by book, so a task holds the archive of one book at a time, not its rows.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer, done, held = None, None, [], 0
        shape = pa.schema([("path", pa.string()), ("content", pa.binary())])
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), shape)], schema=shape)
        for b in batches:
            cells = b.column(2)
            ends, texts = cells.offsets.to_pylist(), cells.values.to_pylist()
            for book, sheet, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends, ends[1:]):
                if book != name:
                    if writer:
                        done.append((name, writer.close()))
                        held += len(done[-1][1])
                    if held > PIECE:
                        yield made()
                        done, held = [], 0
                    name, writer = book, Writer(sheets)
                if sheet is not None:
                    writer.row(sheet, texts[lo:hi])
        if writer:
            done.append((name, writer.close()))
            yield made()

    number = F.coalesce(*[F.when(F.col("sheet") == n, k) for k, n in enumerate(sheets)]) if sheets else F.lit(None).cast("int")
    r = rows.select(F.col("book").cast("string").alias("book"), number.alias("sheet"), "cells", F.col("pos").cast("long").alias("pos")).where("book is not null")
    r = r.repartition("book").sortWithinPartitions("book", "sheet", F.asc_nulls_last("pos"), "cells")
    return r.select("book", "sheet", "cells").mapInArrow(make, "path string, content binary")


def export_name(account: Column, day: Column) -> Column:
    """A safe file name of an account's export."""
    return F.concat(F.lit("export_"), file_name(account), F.lit("_"), F.date_format(day, "yyyyMMdd"), F.lit(".xlsx"))


#: The sheets of an account's export and their headers.
EXPORT = {"stars": ["game version", "account", "kind", "name", "quality", "current level", "target level", "quantity"], "experience": ["type", "quantity"], "account": ["field", "value"]}
#: The same for an export that also says how the numbers came about.
AUDITED = {"stars": EXPORT["stars"], "experience": ["game version", "account", "type", "quantity", "experience each"], "audit": ["imported at", "images", "current count", "capacity", "actual count", "difference", "status", "note"]}


def _cells(*columns: str | Column) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def _stars(accounts: DataFrame, items: DataFrame) -> DataFrame:
    keys = ["account_id", "kind", "name", "quality", "level", "target"]
    n = items.withColumn("target", F.coalesce("target", "level")).groupBy(*keys).agg(F.count("*").alias("quantity"), F.min("pos").alias("pos"))
    x = n.join(accounts.select("account_id", "version", "display"), "account_id")
    return x.select(F.col("account_id").alias("book"), F.lit("stars").alias("sheet"), "pos", _cells("version", "display", "kind", "name", "quality", "level", "target", "quantity").alias("cells"))


def _lines(accounts: DataFrame, name: str, rows: list[Column]) -> DataFrame:
    return accounts.select(F.col("account_id").alias("book"), F.lit(name).alias("sheet"), F.posexplode(F.array(*rows)).alias("pos", "cells")).withColumn("pos", F.col("pos").cast("long"))


def exports(accounts: DataFrame, items: DataFrame) -> DataFrame:
    """(account_id, version, display, current, capacity, orange, purple, white) x (account_id, pos, kind, name, quality, level, target) -> (path, content): a workbook per account.

    Identical items are one row with their quantity, in the order of the first of them; an item without a target has its level. Unknown numbers are empty cells.
    """
    kinds = [_cells(F.lit(k), k) for k in ("orange", "purple", "white")]
    fields = [_cells(F.lit(n), c) for n, c in (("game version", "version"), ("account", "display"), ("bag count", "current"), ("bag capacity", "capacity"))]
    return books(_stars(accounts, items).unionByName(_lines(accounts, "experience", kinds)).unionByName(_lines(accounts, "account", fields)), EXPORT)


def audited_exports(accounts: DataFrame, items: DataFrame, each: dict[str, int]) -> DataFrame:
    """The same with a sheet of the import instead of the account's fields: what was expected, what is there, and whether they agree (matched, missing, surplus, or unknown without a number).

    accounts also has imported_at, images and note; each: the experience of one item of a type.
    """
    actual = items.groupBy("account_id").agg(F.count("*").alias("actual"))
    a = accounts.join(actual, "account_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    gap = F.col("actual") - F.col("current")
    status = F.when(gap.isNull(), "unknown").when(gap == 0, "matched").when(gap < 0, "missing").otherwise("surplus")
    kinds = [_cells("version", "display", F.lit(k), k, F.lit(v)) for k, v in each.items()]
    audit = [_cells("imported_at", "images", "current", "capacity", "actual", gap, status, "note")]
    return books(_stars(a, items).unionByName(_lines(a, "experience", kinds)).unionByName(_lines(a, "audit", audit)), AUDITED)


#: Columns of an inventory sheet, by which it is known too: the sheet to import is the first whose first row has the header of `name`.
INVENTORY = {"kind": "kind", "name": "name", "quality": "quality", "level": "current level", "target": "target level", "quantity": "quantity"}
_NUMBERS = {"level": (1, 60), "target": (1, 60), "quantity": (1, 2**31 - 1)}


def inventory_rows(files: DataFrame, catalog: DataFrame, qualities: list[str], headers: dict[str, str] = INVENTORY) -> DataFrame:
    """(path, content) -> path, row, kind, name, quality, level, target, quantity, faults of each row of the inventory sheet.

    faults has every fault of a row: `<column>_empty`, `<column>_invalid` (no whole number in its range), `target_below_level`, `quality_unknown`, `not_in_catalog` (kind, name); none if the
    row can be imported. Files without such a sheet, or that are no workbooks, give one row whose fault says so.
    """
    every = sheet(files, None, True, headers["name"])
    broken = every.where("fault is not null").select("path", F.array("fault").alias("faults"))
    rows = table(every.where("fault is null").drop("fault"), headers)
    number = lambda c: F.trim(c).try_cast("double")
    whole = {c: F.when((number(c) == F.floor(number(c))) & number(c).between(lo, hi), number(c).cast("int")) for c, (lo, hi) in _NUMBERS.items()}
    faults = [F.when(F.col(c).isNull(), f"{c}_empty") for c in headers]
    faults += [F.when(F.col(c).isNotNull() & whole[c].isNull(), f"{c}_invalid") for c in _NUMBERS]
    faults += [F.when(whole["target"] < whole["level"], "target_below_level"), F.when(~F.trim("quality").isin(qualities), "quality_unknown")]
    known = catalog.select(F.col("kind").alias("_k"), F.col("name").alias("_n")).distinct().withColumn("_known", F.lit(True))
    x = rows.join(known, (F.trim("kind") == F.col("_k")) & (F.trim("name") == F.col("_n")), "left")
    faults.append(F.when(F.col("kind").isNotNull() & F.col("name").isNotNull() & F.col("_known").isNull(), "not_in_catalog"))
    texts = [F.trim(c).alias(c) for c in ("kind", "name", "quality")]
    x = x.select("path", "row", *texts, *[v.alias(c) for c, v in whole.items()], F.filter(F.array(*faults), lambda f: f.isNotNull()).alias("faults"))
    return x.unionByName(broken, allowMissingColumns=True)


def inventory_items(rows: DataFrame) -> DataFrame:
    """path, pos, kind, name, quality, level, target: each row repeated quantity times, of the files of which no row has a fault; pos counts a file's items from 1."""
    bad = rows.where("size(faults) > 0").select("path").distinct()
    good = rows.join(bad, "path", "left_anti")
    before = F.sum(F.col("quantity").cast("long")).over(Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    each = good.withColumn("_b", F.coalesce(before, F.lit(0))).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("quantity"))))
    return each.select("path", (F.col("_b") + F.col("_i")).alias("pos"), "kind", "name", "quality", "level", "target")
