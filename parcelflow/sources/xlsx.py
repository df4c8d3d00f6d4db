"""xlsx workbooks as a data source: spark.read.format("xlsx") and df.write.format("xlsx"), after register(spark).

Reading. A sheet (option `sheet`, else the first) of each workbook under `path`. The first row names the columns, all of
which are texts; a schema given by the user picks columns by name. A sheet's XML is cut at every `bytes` uncompressed
bytes, and a task reads the rows that begin in its part: it inflates what comes before without parsing it, then parses row
by row, so its memory follows a batch of rows and the workbook's shared texts. All workbooks are expected to have the
first one's header; columns that a workbook lacks are null in it.

Writing. A task writes its rows in order into workbooks of up to `rows` rows on one sheet (option `sheet`), as a stream.
They are written beside the target and moved there when all tasks have succeeded; otherwise nothing stays. Without any
rows there is one workbook with a note (option `note`).

Paths are those that pyarrow's file systems open (local and shared folders, object stores). For stores that only Spark
opens, `uploads.read_xlsx` reads whole workbooks from the binaryFile source.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "application/vnd.openxmlformats"
#: Rows of a workbook (the format allows 1,048,576), bytes of XML of a part, rows of a batch, and characters of a sheet's name.
SHEET_ROWS, PART_BYTES, BATCH, NAME = 1_000_000, 32 << 20, 4096, 31
_ROW = re.compile(rb"<(?:\w+:)?row(?=[\s/>])")
_END = re.compile(rb"</(?:\w+:)?sheetData\s*>")
_CHUNK = 1 << 20
#: How sheets and cells are written here; rows of just that form are read without the parser.
_HEAD = f'<worksheet xmlns="{MAIN}"><sheetData>'.encode()
_CELL, _CELL_END = '<c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


# Writing


def write_workbook(out, sheets: Iterable[tuple[str, list[str], Iterable]], note: str = "No rows") -> None:
    """Writes an xlsx file of sheets (name, columns, rows) to a stream, row by row; an empty sheet has a note."""
    names = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, columns, rows) in enumerate(sheets, 1):
            names.append(name)
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(_HEAD)
                held, empty = [columns], True
                for row in rows:
                    empty = False
                    held.append(row)
                    if len(held) >= BATCH:
                        f.write(_rows_xml(held).encode("utf-8", "replace"))
                        held = []
                if empty:
                    held = [["note"], [note]]
                f.write(_rows_xml(held).encode("utf-8", "replace") + b"</sheetData></worksheet>")
        ids = range(1, len(names) + 1)
        parts = "".join(f'<sheet name="{escape(n[:NAME], {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in zip(ids, names, strict=True))
        relations = "".join(f'<Relationship Id="r{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in ids)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_TYPES}-officedocument.spreadsheetml.worksheet+xml"/>' for k in ids)
        main = f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPES}-officedocument.spreadsheetml.sheet.main+xml"/>'
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{parts}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{relations}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r0" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="{_TYPES}-package.relationships+xml"/>{main}{types}</Types>')


_UNFIT = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_UNFIT_BESIDES = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1d￾￿]")


def _xml(row: Iterable) -> str:
    """A row of text cells; characters that XML can't hold become U+FFFD, and a carriage return keeps its code."""
    text = lambda v: _UNFIT.sub("�", escape("" if v is None else str(v), {"\r": "&#13;"}))
    return "<row>" + "".join(f"{_CELL}{text(v)}{_CELL_END}" for v in row) + "</row>"


def _rows_xml(rows: list) -> str:
    """As _xml of each row, for many rows at once: cells are joined by two characters that no cell may hold."""
    texts = [["" if v is None else str(v) for v in row] for row in rows]
    joined = "\x1e".join(map("\x1f".join, texts))
    if not all(texts) or joined.count("\x1f") + joined.count("\x1e") != sum(map(len, texts)) - 1:
        return "".join(map(_xml, rows))
    joined = escape(_UNFIT_BESIDES.sub("�", joined), {"\r": "&#13;"})
    return f"<row>{_CELL}" + joined.replace("\x1f", _CELL_END + _CELL).replace("\x1e", f"{_CELL_END}</row><row>{_CELL}") + f"{_CELL_END}</row>"


def _plain_rows(data: bytes) -> list[list[str]] | None:
    """The cells of whole rows that are written as here; None if anything else is among them, which is for the parser.

    The number of tags tells that there are no others: two a row and six a cell.
    """
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    rows = text.split("</row>")
    begin, end = f"<row>{_CELL}", _CELL_END
    if rows.pop() or "\r" in text or _UNFIT.search(text) or text.count("&") != sum(map(text.count, ("&lt;", "&gt;", "&#13;", "&amp;"))):
        return None
    if not all(r.startswith(begin) and r.endswith(end) for r in rows):
        return None
    cells = [r[len(begin) : -len(end)].split(end + _CELL) for r in rows]
    if text.count("<") != 2 * len(rows) + 6 * sum(map(len, cells)):
        return None
    if "&" in text:
        cells = [[c.replace("&lt;", "<").replace("&gt;", ">").replace("&#13;", "\r").replace("&amp;", "&") if "&" in c else c for c in row] for row in cells]
    return cells


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class XlsxWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, rows: int, sheet: str, note: str):
        self.path, self.names, self.overwrite, self.rows, self.sheet, self.note = path, schema.names, overwrite, rows, sheet, note
        self.beside = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, rows = [], (row for batch in iterator for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            store, folder = opened(self.beside)
            store.create_dir(folder, recursive=True)
            files.append(f"part-{uuid.uuid4().hex}.xlsx")
            following: list = []

            def some(first=row, following=following):
                yield tuple(first)
                for k, one in enumerate(rows, 2):
                    if k > self.rows:
                        following.append(one)
                        return
                    yield tuple(one)

            with store.open_output_stream(f"{folder}/{files[-1]}") as out:
                write_workbook(out, [(self.sheet, self.names, some())])
            row = following[0] if following else None
        return Written(files)

    def commit(self, messages: list) -> None:
        store, folder = opened(self.path)
        if self.overwrite and store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir_contents(folder)
        store.create_dir(folder, recursive=True)
        _, beside = opened(self.beside)
        for m in messages:
            for f in m.files if m is not None else []:
                store.move(f"{beside}/{f}", f"{folder}/{f}")
        if not any(m is not None and m.files for m in messages):
            with store.open_output_stream(f"{folder}/part-{uuid.uuid4().hex}.xlsx") as out:
                write_workbook(out, [(self.sheet, self.names, [])], self.note)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        store, beside = opened(self.beside)
        if store.get_file_info(beside).type == fs.FileType.Directory:
            store.delete_dir(beside)


# Reading


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/(?!/)", path):
        path = path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def workbooks(path: str) -> list[str]:
    """The workbooks under a path, by name."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in files if f.type == fs.FileType.File and f.base_name.lower().endswith(".xlsx") and f.base_name[0] not in "._~")


def sheet_files(z: zipfile.ZipFile) -> dict[str, str]:
    """The files of a workbook's sheets by the sheets' names, in the workbook's order."""
    held = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= held:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        listed = [(s.get("name"), targets.get(s.get(f"{{{OFFICE}}}id"), "")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")]
        return {n: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for n, t in listed}
    return {n: n for n in sorted((n for n in held if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))}


class SharedTexts:
    """The workbook's shared texts, read when the first cell asks for one."""

    def __init__(self, z: zipfile.ZipFile):
        self.z, self.texts = z, None

    def __getitem__(self, k: int) -> str:
        if self.texts is None:
            self.texts = []
            if "xl/sharedStrings.xml" in self.z.namelist():
                with self.z.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if e.tag == f"{{{MAIN}}}si":
                            self.texts.append("".join(t.text or "" for t in e.iter(f"{{{MAIN}}}t")))
                            e.clear()
        return self.texts[k]


def cells_of(row: ElementTree.Element | list[str], shared) -> list[str]:
    """A row's cells as texts, each at its own column."""
    if isinstance(row, list):
        return row
    cells: list[str] = []
    for cell in row.iter(f"{{{MAIN}}}c"):
        at = 0
        for x in cell.get("r", ""):
            at = at * 26 + ord(x) - 64 if x.isalpha() else at
        cells += [""] * (max(at, len(cells) + 1) - len(cells))
        value = cell.find(f"{{{MAIN}}}v")
        text = "".join(t.text or "" for t in cell.iter(f"{{{MAIN}}}t")) if cell.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
        cells[(at or len(cells)) - 1] = shared[int(text)] if cell.get("t") == "s" and text else text
    return cells


def rows_between(f, first: int, last: int) -> Iterator[tuple[int, ElementTree.Element | list[str]]]:
    """Number (from 1) and element (or cells, if they are written as here) of the rows of a sheet's XML that begin within bytes first to last (exclusive).

    Bytes before the first are searched for beginnings of rows only. What is parsed is the sheet's own head, which names
    its namespaces, and then the rows.
    """
    parser, head, seen, at, tail, inside = ElementTree.XMLPullParser(["start", "end"]), b"", 0, 0, b"", False
    parent, number, quick, rest = None, 0, False, b""
    while True:
        chunk = f.read(_CHUNK)
        if not chunk and not tail:
            return
        data, end = tail + chunk, not chunk
        # A beginning may be cut by the chunk's end: what follows the last "<" waits for the next one.
        keep = len(data) if end else max(data.rfind(b"<"), 0)
        part, tail = data[:keep], data[keep:]
        feed = b""
        if not inside:
            for m in _ROW.finditer(part):
                if not seen and not head:
                    head = part[: m.start()] if at == 0 else head
                if at + m.start() >= first:
                    if at + m.start() >= last:
                        return
                    inside, feed, number = True, part[m.start() :], seen
                    break
                seen += 1
            if not inside:
                if at == 0 and not head:
                    head = part
                if end or _END.search(part):
                    return
            elif head or at == 0:
                quick = head == _HEAD
                if not quick:
                    parser.feed(head)
        else:
            feed = part
        if inside and feed:
            begin = at + len(part) - len(feed)
            stop = _END.search(feed)
            over = next((m.start() for m in _ROW.finditer(feed) if begin + m.start() >= last), None)
            limit = min(x for x in (stop.start() if stop else None, over, len(feed)) if x is not None)
            data = rest + feed[:limit]
            if quick:
                whole = data.rfind(b"</row>") + 6 if b"</row>" in data else 0
                rows = _plain_rows(data[:whole])
                if rows is None:
                    quick, rest = False, b""
                    parser.feed(head)
                else:
                    rest = data[whole:]
                    for cells in rows:
                        number += 1
                        yield number, cells
            if not quick:
                parser.feed(data)
            for event, e in parser.read_events():
                if event == "start":
                    parent = e if e.tag == f"{{{MAIN}}}sheetData" else parent
                elif e.tag == f"{{{MAIN}}}row":
                    number = int(e.get("r") or number + 1)
                    yield number, e
                    if parent is not None:
                        parent.clear()
            if limit < len(feed):
                return
        at += len(part)
        if end:
            return


@dataclass
class Part(InputPartition):
    file: str
    member: str
    first: int
    last: int


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, sheet: str | None, part_bytes: int):
        if any(not isinstance(f.dataType, StringType) for f in schema.fields):
            raise ValueError("cells are texts: all columns of an xlsx schema must be strings")
        self.path, self.names, self.sheet, self.bytes = path, schema.names, sheet, part_bytes

    def partitions(self) -> list[Part]:
        parts = []
        for file in workbooks(self.path):
            store, _ = opened(self.path)
            with store.open_input_file(file) as raw, zipfile.ZipFile(raw) as z:
                member = _chosen(z, self.sheet)
                if member is not None:
                    size = z.getinfo(member).file_size
                    parts += [Part(file, member, a, a + self.bytes) for a in range(0, max(size, 1), self.bytes)]
        return parts or [Part("", "", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.file) as raw, zipfile.ZipFile(raw) as z:
            shared = SharedTexts(z)
            place = {n: k for k, n in reversed(list(enumerate(_header(z, partition.member, shared))))}
            at, held = [place.get(n) for n in self.names], []
            with z.open(partition.member) as f:
                for number, row in rows_between(f, partition.first, partition.last):
                    if number > 1:
                        held.append(cells_of(row, shared))
                    if len(held) >= BATCH:
                        yield self._batch(held, at)
                        held = []
            if held:
                yield self._batch(held, at)

    def _batch(self, rows: list[list[str]], at: list[int | None]) -> pa.RecordBatch:
        columns = [pa.array([None if k is None else r[k] if k < len(r) else "" for r in rows], pa.string()) for k in at]
        return pa.RecordBatch.from_arrays(columns, names=self.names)


def _chosen(z: zipfile.ZipFile, sheet: str | None) -> str | None:
    files = sheet_files(z)
    return files.get(sheet[:NAME]) if sheet else next(iter(files.values()), None)


def _header(z: zipfile.ZipFile, member: str, shared) -> list[str]:
    with z.open(member) as f:
        first = next(rows_between(f, 0, 1 << 62), None)
    return cells_of(first[1], shared) if first and first[0] == 1 else []


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        for file in workbooks(self.options["path"]):
            store, _ = opened(self.options["path"])
            with store.open_input_file(file) as raw, zipfile.ZipFile(raw) as z:
                member = _chosen(z, self.options.get("sheet"))
                names = _header(z, member, SharedTexts(z)) if member else []
            if any(names):
                return StructType([StructField(n, StringType()) for n in dict.fromkeys(names) if n])
        raise ValueError(f"no header in {self.options['path']}: name the columns with schema()")

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self.options["path"], schema, self.options.get("sheet"), int(self.options.get("bytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        rows = int(self.options.get("rows", SHEET_ROWS))
        if not 1 <= rows <= 1_048_575:
            raise ValueError("a sheet holds 1 to 1,048,575 rows besides its header")
        return XlsxWriter(self.options["path"], schema, overwrite, rows, self.options.get("sheet", "Sheet1"), self.options.get("note", "No rows"))
