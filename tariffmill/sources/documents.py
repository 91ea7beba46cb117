"""Documents of several formats as cells, text blocks and catalogue items.

``binaryFile`` gives bytes; one Arrow pass over them, with the standard library's parsers, gives
one row per document with arrays, so a document is the unit of work and no shuffle is needed.
What can't be read has an error code in place of contents.  Limits keep a document within a task's
memory; what they cut off is told by ``truncated``, and larger ones can be given (see ``Limits``).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .schemas import EXTRACTED

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = ("br", "img", "input", "hr", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr")


@dataclass
class Limits:
    """What is read of one document at most: rows and columns of a table, characters of a cell, sheets or pages, bytes unpacked from an archive."""

    rows: int = 10_000
    columns: int = 100
    cell: int = 10_000
    sheets: int = 50
    unpacked: int = 100_000_000
    #: Whether anything was left out; one object serves one document.
    cut: bool = False

    def first(self, items: list, most: int) -> list:
        self.cut |= len(items) > most
        return items[:most]

    def tidy(self, text: str) -> str:
        text = " ".join(text.split())
        self.cut |= len(text) > self.cell
        return text[: self.cell]


class TooLarge(RuntimeError):
    """An archive that unpacks to more than the limit."""


class _Archive:
    """A ZIP archive whose members are read only while their unpacked sizes together keep within the limit."""

    def __init__(self, content: bytes, limits: Limits):
        self.zip, self.left = zipfile.ZipFile(io.BytesIO(content)), limits.unpacked

    def names(self) -> set[str]:
        return set(self.zip.namelist())

    def read(self, name: str) -> bytes:
        with self.zip.open(name) as f:
            data = f.read(self.left + 1)  # the stated size may lie
        self.left -= len(data)
        if self.left < 0:
            raise TooLarge(name)
        return data


def _number(text: str | None) -> int:
    return int(text) if text and text.strip().isdigit() and int(text) > 0 else 1


class _Page(HTMLParser):
    """Tables as grids, paragraphs and headings as blocks, elements with a code as items; open tags may be left unclosed."""

    def __init__(self, limits: Limits) -> None:
        super().__init__(convert_charrefs=True)
        self.limits = limits
        self.cells: list[dict] = []
        self.blocks: list[dict] = []
        self.items: list[dict] = []
        self.tables: list[dict] = []  # open ones, innermost last
        self.count, self.heading = 0, None
        self.open_blocks: list[dict] = []
        self.marks: list[tuple[str, str]] = []  # open tags and their classes
        self.item: dict | None = None
        self.skip = 0

    # cells

    def _end_cell(self, table: dict) -> None:
        if cell := table.pop("cell", None):
            text = self.limits.tidy("".join(cell["parts"]))
            row = table["row"]
            row.append({"table": table, "row_index": table["r"], "col_index": cell["at"], "text": text, "colspan": cell["colspan"], "rowspan": cell["rowspan"], "is_header": cell["head"]})

    def _end_row(self, table: dict) -> None:
        self._end_cell(table)
        row = table.pop("row", None)
        if row:
            head = any(c["is_header"] for c in row)
            table["done"] += [c | {"row_is_header": head} for c in row]
        if row is not None:
            table["r"] += 1

    def _end_table(self) -> None:
        table = self.tables.pop()
        self._end_row(table)
        if table["done"]:
            for c in table["done"]:
                c.pop("table")
                self.cells.append(c | {"table_index": self.count, "page_or_sheet": "html", "heading": table["heading"]})
            self.count += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "table":
            self.tables.append({"done": [], "r": 0, "taken": set(), "heading": self.heading})
        elif tag == "tr" and self.tables:
            self._end_row(self.tables[-1])
            if self.tables[-1]["r"] < self.limits.rows:
                self.tables[-1]["row"] = []
                self.tables[-1]["c"] = 0
            else:
                self.limits.cut = True
        elif tag in ("td", "th") and self.tables and "row" in self.tables[-1]:
            t = self.tables[-1]
            self._end_cell(t)
            while (t["r"], t["c"]) in t["taken"]:
                t["c"] += 1
            if t["c"] >= self.limits.columns:
                self.limits.cut = True
            else:
                across, down = min(_number(a.get("colspan")), self.limits.columns), min(_number(a.get("rowspan")), self.limits.rows)
                t["taken"].update((t["r"] + i, t["c"] + j) for i in range(down) for j in range(across))
                t["cell"] = {"at": t["c"], "colspan": across, "rowspan": down, "head": tag == "th", "parts": []}
                t["c"] += across
        if tag == "p" or tag in HEADINGS:
            if tag == "p":
                self._end_block("p")
            self.open_blocks.append({"tag": tag, "parts": []})
        if tag == "div" and "data-code" in a and self.item is None:
            self.item = {"code": a["data-code"], "depth": len(self.marks), "name": [], "price": [], "any_price": [], "fee": []}
        if tag not in VOID:
            self.marks.append((tag, a.get("class", "")))

    def _end_block(self, tag: str) -> None:
        for k in range(len(self.open_blocks) - 1, -1, -1):
            if self.open_blocks[k]["tag"] == tag:
                block = self.open_blocks.pop(k)
                text = self.limits.tidy("".join(block["parts"]))
                if tag in HEADINGS and text:
                    self.heading = text
                if len(text) >= 5:
                    self.blocks.append({"block_index": len(self.blocks), "block_type": tag, "text": text, "page_or_sheet": "html"})
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "table" and self.tables:
            self._end_table()
        elif tag == "tr" and self.tables:
            self._end_row(self.tables[-1])
        elif tag in ("td", "th") and self.tables:
            self._end_cell(self.tables[-1])
        if tag == "p" or tag in HEADINGS:
            self._end_block(tag)
        for k in range(len(self.marks) - 1, -1, -1):
            if self.marks[k][0] == tag:
                del self.marks[k:]
                break
        if self.item is not None and len(self.marks) <= self.item["depth"]:
            self._end_item()

    def _end_item(self) -> None:
        i, self.item = self.item, None
        text = lambda parts: self.limits.tidy("".join(parts))
        self.items.append({"item_index": len(self.items), "code": i["code"], "name": text(i["name"]), "price_raw": text(i["price"]) or text(i["any_price"]), "fee_raw": text(i["fee"])})

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        for t in self.tables:
            if "cell" in t:
                t["cell"]["parts"].append(data)
        for b in self.open_blocks:
            b["parts"].append(data)
        if self.item is not None:
            inside = " ".join(c for _, c in self.marks[self.item["depth"] :])
            if "fee-value" in inside:
                self.item["fee"].append(data)
            elif "price-value" in inside:
                self.item["price" if "price-standard" in inside else "any_price"].append(data)
            elif re.search(r"\b(?:item-)?(?:name|title)\b", inside):
                self.item["name"].append(data)

    def close(self) -> None:
        super().close()
        while self.tables:
            self._end_table()
        while self.open_blocks:
            self._end_block(self.open_blocks[-1]["tag"])
        if self.item is not None:
            self._end_item()


def html(content: bytes, limits: Limits) -> dict:
    page = _Page(limits)
    page.feed(content.decode("utf-8", "replace"))
    page.close()
    return {"cells": page.cells, "blocks": page.blocks, "items": page.items}


def text(content: bytes, limits: Limits) -> dict:
    """Lines that aren't blank, stripped."""
    lines = ["".join(limits.first(x.strip(), limits.cell)) for x in content.decode("utf-8").splitlines()]
    return {"blocks": [{"block_index": k, "block_type": "line", "text": x, "page_or_sheet": "text"} for k, x in enumerate(x for x in lines if x)]}


def _grid(rows: list[list[str]], table: int, sheet: str, header: bool, limits: Limits) -> list[dict]:
    kept = limits.first([r for r in rows if any(x.strip() for x in r)], limits.rows)
    return [
        {"table_index": table, "row_index": i, "col_index": j, "text": limits.tidy(x), "colspan": 1, "rowspan": 1, "is_header": header and i == 0, "row_is_header": header and i == 0, "page_or_sheet": sheet, "heading": None}
        for i, r in enumerate(kept)
        for j, x in enumerate(limits.first(r, limits.columns))
    ]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx(content: bytes, limits: Limits) -> dict:
    """Tables, and paragraphs of three characters or more outside them."""
    body = ElementTree.fromstring(_Archive(content, limits).read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    cells, blocks, n = [], [], 0
    for e in body if body is not None else []:
        if e.tag == f"{_W}tbl":
            cells += _grid([[words(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")], n, "docx", True, limits)
            n += 1
        elif e.tag == f"{_W}p" and len(x := limits.tidy(words(e))) >= 3:
            blocks.append({"block_index": len(blocks), "block_type": "p", "text": x, "page_or_sheet": "docx"})
    return {"cells": cells, "blocks": blocks}


def xlsx(content: bytes, limits: Limits) -> dict:
    """All sheets, each a table whose first row is its header; numbers as their text, blank rows dropped."""
    book = _Archive(content, limits)
    names = book.names()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    cells = []
    for n, sheet in enumerate(limits.first(list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet")), limits.sheets)):
        target = links[sheet.get(f"{_R}id")].lstrip("/")
        rows = []
        for r in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
            row: dict[int, str] = {}
            for k, c in enumerate(r.iter(f"{_S}c")):
                letters = re.match("[A-Z]*", c.get("r") or "")[0]
                at = k
                if letters:
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                v = c.find(f"{_S}v")
                if c.get("t") == "inlineStr":
                    row[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif v is not None and v.text is not None:
                    row[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
            rows.append([row.get(k, "") for k in range(max(row, default=-1) + 1)])
        cells += _grid(rows, n, sheet.get("name") or str(n), True, limits)
    return {"cells": cells}


def pdf(content: bytes, limits: Limits) -> dict:
    """PDF needs a library that may be absent; without it documents go to manual review."""
    try:
        import pdfplumber
    except ImportError:
        return {"error": "UNSUPPORTED_FORMAT"}
    cells, blocks, size = [], [], 0
    with pdfplumber.open(io.BytesIO(content)) as book:
        for page in limits.first(book.pages, limits.sheets):
            name = f"page {page.page_number}"
            for table in page.extract_tables():
                cells += _grid([[x or "" for x in r] for r in table], len({c["table_index"] for c in cells}), name, True, limits)
            for line in (page.extract_text() or "").splitlines():
                size += len(line)
                if line.strip():
                    blocks.append({"block_index": len(blocks), "block_type": "line", "text": limits.tidy(line), "page_or_sheet": name})
    return {"cells": cells, "blocks": blocks} if size >= 50 or cells else {"error": "MANUAL_REVIEW_REQUIRED"}


def kind_of(path: str, content: bytes) -> str:
    """The format by what the bytes are, and by name where those don't tell."""
    end = path.rsplit(".", 1)[-1].lower()
    if content[:4] == b"PK\x03\x04":
        return end if end in ("docx", "xlsx") else "zip"
    if content[:5] == b"%PDF-":
        return "pdf"
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "xls"
    if end in ("html", "htm") or re.match(rb"\s*<(?:!doctype|html)", content[:200], re.I):
        return "html"
    return "text"


READERS = {"html": html, "text": text, "docx": docx, "xlsx": xlsx, "pdf": pdf}


def extract_one(path: str, content: bytes | None, limits: Limits | None = None) -> dict:
    """A row of EXTRACTED."""
    limits = replace(limits or Limits(), cut=False)
    content = content or b""
    kind = kind_of(path, content)
    out = {"doc_id": path, "format": kind, "error": None, "truncated": False, "cells": [], "blocks": [], "items": []}
    if kind not in READERS:
        return out | {"error": "UNSUPPORTED_FORMAT"}
    try:
        found = READERS[kind](content, limits)
        return out | found | {"truncated": limits.cut}
    except TooLarge:
        return out | {"error": "ZIP_BOMB_DETECTED"}
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, UnicodeDecodeError, RuntimeError) as e:
        return out | {"error": "PASSWORD_PROTECTED" if "password" in str(e) else "MALFORMED_DOCUMENT"}


def extract(documents: DataFrame, doc_id: str = "path", content: str = "content", limits: Limits | None = None) -> DataFrame:
    """Documents (id, bytes or text) as rows of EXTRACTED."""
    schema = to_arrow_schema(_parse_datatype_string(EXTRACTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):  # a few documents' cells at a time
                part = batch.slice(at, 32)
                yield pa.RecordBatch.from_pylist([extract_one(*row, limits) for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], schema)

    return documents.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(content).cast("binary").alias("content")).mapInArrow(run, EXTRACTED)


def read_documents(spark: SparkSession, path: str, limits: Limits | None = None) -> DataFrame:
    return extract(spark.read.format("binaryFile").load(path), limits=limits)


def cells(extracted: DataFrame) -> DataFrame:
    return extracted.select("doc_id", F.inline("cells"))


def blocks(extracted: DataFrame) -> DataFrame:
    return extracted.select("doc_id", F.inline("blocks"))


def items(extracted: DataFrame) -> DataFrame:
    return extracted.select("doc_id", F.inline("items"))


def metadata(extracted: DataFrame) -> DataFrame:
    """Per document its format, error, whether limits cut anything off, and numbers of tables, rows, blocks and items."""
    tables = F.array_distinct(F.transform("cells", lambda c: c["table_index"]))
    rows = F.array_distinct(F.transform("cells", lambda c: F.struct(c["table_index"], c["row_index"])))
    return extracted.select("doc_id", "format", "error", "truncated", F.size(tables).alias("table_count"), F.size(rows).alias("row_count"), F.size("blocks").alias("text_block_count"), F.size("items").alias("item_count"))


def row_cells(cells_: DataFrame) -> DataFrame:
    """Rows of tables as arrays of texts in column order; a row has at most ``Limits.columns`` cells."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("col_index", "text"))), lambda x: x["text"])
    return cells_.groupBy("doc_id", "table_index", "row_index").agg(F.bool_or("is_header").alias("is_header"), F.first("heading", ignorenulls=True).alias("heading"), packed.alias("cells"))


def read_catalog_workbook(spark: SparkSession, path: str, sheet: str | None, category: str, name: str) -> DataFrame:
    """(category, name) of a workbook's rows, from the named sheet or else the first, by heading; blank names and those that begin with ``#`` are left out."""
    all_cells = cells(read_documents(spark, path))
    chosen = F.coalesce(F.max(F.when(F.col("page_or_sheet") == sheet, F.col("table_index"))).over(_by_doc()) if sheet else F.lit(None).cast("int"), F.lit(0))
    own = all_cells.withColumn("_want", chosen).where("table_index = _want")
    head = own.where("row_is_header").select("doc_id", "col_index", F.trim("text").alias("role")).where(F.col("role").isin(category, name))
    body = own.where("not row_is_header").join(head, ["doc_id", "col_index"])
    wide = body.groupBy("doc_id", "row_index").agg(F.max(F.when(F.col("role") == category, F.trim("text"))).alias("category"), F.max(F.when(F.col("role") == name, F.trim("text"))).alias("name"))
    return wide.where("coalesce(name, '') <> '' and not startswith(name, '#')").select("category", "name")


def _by_doc():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")
