"""Cells of HTML tables, nested ones and spans included."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

# comments and scripts, which are no content, and the tags that make tables
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)(table|tr|td|th)\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.I | re.S)
SPAN = {name: re.compile(rf"""(?:^|\s){name}\s*=\s*["']?\s*(\d+)""", re.I) for name in ("colspan", "rowspan")}
MOST = {"colspan": 1000, "rowspan": 65534}  # of HTML
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}  # types of page_id


class Table:
    """A table that is open: its number and depth, the grid's free places, the cell that is being read."""

    def __init__(self, number: int, depth: int):
        self.number, self.depth, self.row, self.column = number, depth, -1, 0
        self.taken: dict[int, list] = {}  # column -> [rows still covered, the cell that covers it]
        self.below: dict[int, list] = {}  # spans that begin in this row
        self.held: set[int] = set()  # columns of this row that cells of earlier rows cover
        self.cell: list | None = None
        self.cells: list[list] = []

    def next_row(self) -> None:
        self.cell, self.row, self.column = None, self.row + 1, 0
        self.taken |= self.below
        self.below, self.held = {}, set(self.taken)
        for column, rest in list(self.taken.items()):
            self.cells.append([self.row, column, rest[1], False])
            rest[0] -= 1
            if not rest[0]:
                del self.taken[column]

    def next_cell(self, head: bool, attributes: str) -> None:
        if self.row < 0:
            self.next_row()
        span = {n: min(max(int(m[1]), 1), MOST[n]) if (m := p.search(attributes)) and len(m[1]) < 9 else 1 for n, p in SPAN.items()}
        while self.column in self.held:
            self.column += 1
        self.cell = [[], head]
        for column in range(self.column, self.column + span["colspan"]):
            self.cells.append([self.row, column, self.cell, column == self.column])
            if span["rowspan"] > 1:
                self.below[column] = [span["rowspan"] - 1, self.cell]
        self.column += span["colspan"]


def table_cells(html: str) -> Iterator[tuple[int, int, int, int, str, bool, bool]]:
    """(table_no, depth, row_no, col_no, body, head, origin): every place of every table's grid.

    Tables are numbered as they open. A cell with spans is at every place that it covers, `origin` at its first; a text
    belongs to the innermost table's cell only. Tables and cells that are never closed end with the page.
    """
    open_, at, made = [], 0, []
    for found in TAG.finditer(html):
        if open_ and open_[-1].cell is not None:
            open_[-1].cell[0].append(html[at : found.start()])
        at = found.end()
        closing, tag = bool(found[2]), (found[3] or "").lower()
        if tag == "table" and not closing:
            open_.append(Table(len(made), len(open_)))
            made.append(open_[-1])
        elif not tag or not open_:
            continue
        elif tag == "table":
            open_.pop()
        elif tag == "tr":
            if closing:
                open_[-1].cell = None
            else:
                open_[-1].next_row()
        elif closing:
            open_[-1].cell = None
        else:
            open_[-1].next_cell(tag == "th", found[4])
    if open_ and open_[-1].cell is not None:
        open_[-1].cell[0].append(html[at:])
    for table in made:
        for row, column, cell, origin in sorted(table.cells, key=lambda c: c[:2]):
            yield table.number, table.depth, row, column, " ".join(cell[0]), cell[1], origin


def batches_of_cells(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["table_no", "depth", "row_no", "col_no", "body", "head", "origin"]
    types = [pa.int32()] * 4 + [pa.string(), pa.bool_(), pa.bool_()]
    for batch in batches:
        for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if rows := list(table_cells(html or "")):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([page_id] * len(rows), kind), *columns], ["page_id", *names])


def grid(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, depth, row_no, col_no, body, head, origin) of all pages; one pass, no shuffle. NULL pages have no rows."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "html")
    arrow = ARROW[kind]
    return rows.mapInArrow(lambda b: batches_of_cells(b, arrow), f"page_id {kind}, table_no int, depth int, row_no int, col_no int, body string, head boolean, origin boolean")


LINE = pa.struct([("row_no", pa.int32()), ("cells", pa.list_(pa.string()))])
TABLE = pa.struct([("table_no", pa.int32()), ("depth", pa.int32()), ("lines", pa.list_(LINE))])


def spanned_lines(html: str) -> list[tuple[int, int, list]]:
    """As `table_lines`, of any page: a cell that spans places stands at all of them, where two meet the first does."""
    out: list[tuple[int, int, list]] = []
    for number, depth, row, column, body, _, _ in table_cells(html):
        if not out or out[-1][0] != number:
            out.append((number, depth, []))
        lines = out[-1][2]
        if not lines or lines[-1][0] != row:
            lines.append((row, []))
        cells = lines[-1][1]
        if column >= len(cells):
            cells.extend([None] * (column - len(cells)))
            cells.append(body)
    return out


BARE = [(tag, f"{tag}>") for tag in ("<table", "</table", "<tr", "</tr", "<td", "</td", "<th", "</th")]


def bare_lines(html: str) -> list[tuple[int, int, list]] | None:
    """As `table_lines`, by whole-string steps; None unless all tags that make tables are bare, in lower case and not nested, and nothing hides any."""
    lower = html.lower()
    if any(x in lower for x in ("<!--", "<script", "<style", "<\u017f")):
        return None
    for begin, tag in BARE:
        if lower.count(begin) - (lower.count(f"{begin}ead") if begin.endswith("th") else 0) != html.count(tag):
            return None
    before, *bodies = html.replace("<th>", "<td>").replace("</th>", "</td>").replace("</tr>", "</td>").split("<table>")
    if "</table>" in before:
        return None
    made = []
    for number, body in enumerate(bodies):
        inside, end, after = body.partition("</table>")
        if not end or "</table>" in after:
            return None
        first, *rows = inside.split("<tr>")
        if "<td>" in first:
            return None
        lines = []
        for k, row in enumerate(rows):
            cells = row[4:-10].split("</td><td>")
            n = len(cells)
            # any closing tag ends a cell; most rows are cells only
            if row.count("<td>") != n or row.count("</td>") != n + 1 or not row.startswith("<td>") or not row.endswith("</td></td>"):
                cells = [c.partition("</td>")[0] for c in row.split("<td>")[1:]]
            if cells:
                lines.append((k, cells))
        if lines:
            made.append((number, 0, lines))
    return made


def table_lines(html: str) -> list[tuple[int, int, list]]:
    """(table_no, depth, [(row_no, cells)]) of the grid's tables that have cells; a row's cells stand at their columns, NULL where it has none.

    Without spans a cell's column is its place in its row, so no grid is kept; a page with spans is read by `table_cells`.
    """
    if (found := bare_lines(html)) is not None:
        return found
    made: list[tuple[int, int, list]] = []
    around: list[tuple] = []  # (lines, row, line, cell) of the tables around the open one
    lines = line = cell = None
    row = at = 0
    for found in TAG.finditer(html):
        if cell is not None:
            cell.append(html[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.group(2, 3, 4)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "table":
            if not closing:
                around.append((lines, row, line, cell))
                lines, row, line, cell = [], -1, None, None
                made.append((len(made), len(around) - 1, lines))
            elif around:
                lines, row, line, cell = around.pop()
        elif lines is None:
            continue
        elif closing:
            cell = None
        elif tag == "tr":
            row, line, cell = row + 1, None, None
        else:
            if attributes and "span" in attributes.lower():
                return spanned_lines(html)
            if line is None:
                row, line = max(row, 0), []
                lines.append((row, line))
            cell = []
            line.append(cell)
    if cell is not None:
        cell.append(html[at:])
    return [(number, depth, [(row, [c[0] if len(c) == 1 else " ".join(c) for c in cells]) for row, cells in lines]) for number, depth, lines in made if lines]


def tables_of(html: str) -> list[dict]:
    """The tables of `table_lines` as Arrow takes them."""
    return [{"table_no": number, "depth": depth, "lines": [{"row_no": row, "cells": cells} for row, cells in lines]} for number, depth, lines in table_lines(html)]


def named_lines(lines: list, known: dict[str, list[int]], n: int, fold, header_rows: int) -> Iterator[tuple[int, tuple]]:
    """(row_no, cells of `n` columns by number): the rows after the last header that have any of them; known: folded header -> columns."""
    place: list = [None] * n
    last, missing = -1, n
    for row, cells in lines:
        if row >= header_rows or not missing:
            break
        for k, body in enumerate(cells):
            for column in known.get(fold(body), ()) if body is not None else ():
                if place[column] is None:
                    place[column], last, missing = k, row, missing - 1
    if last < 0:
        return
    known_places = [-1 if k is None else k for k in place]
    most, picked = max(known_places), itemgetter(*known_places, -1)  # two at least, so that it gives a tuple
    for row, cells in lines:
        if row > last:
            if len(cells) > most:
                found = picked([*cells, None])
            else:
                found = (*(None if k < 0 or k >= len(cells) else cells[k] for k in known_places), None)
            if found.count(None) <= n:
                yield row, found[:-1]


ROWS_AT_ONCE = 20_000


def named_batches(known: dict[str, list[int]], names: list[str], fold, header_rows: int, largest: bool, kind: pa.DataType):
    """(page_id, table_no, row_no, the named columns' HTML) of the rows of all tables, or of the one with most rows."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind, pa.int32(), pa.int32(), *[pa.string()] * len(names)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "table_no", "row_no", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tables = table_lines(html or "")
                if largest and tables:
                    tables = [max(tables, key=lambda t: len(t[2]))]  # the first of those
                for number, _, lines in tables:
                    rows += [(page_id, number, row, *cells) for row, cells in named_lines(lines, known, len(names), fold, header_rows)]
                    if len(rows) >= ROWS_AT_ONCE:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    return run


def batches_of_tables(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if found := tables_of(html or ""):
                yield pa.RecordBatch.from_arrays([pa.array([page_id], kind), pa.array([found], pa.list_(TABLE))], ["page_id", "tables"])


def page_tables(pages: DataFrame) -> DataFrame:
    """(page_id, tables): the cells of `grid` as one row a page; pages without cells have none."""
    kind = pages.schema["page_id"].dataType.simpleString()
    arrow = ARROW[kind]
    shape = "array<struct<table_no:int,depth:int,lines:array<struct<row_no:int,cells:array<string>>>>>"
    return pages.select("page_id", "html").mapInArrow(lambda b: batches_of_tables(b, arrow), f"page_id {kind}, tables {shape}")
