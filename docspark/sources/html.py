"""Tables from HTML markup: cells on a grid, with spans."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.sources.texts import CELLS

#: Fixed value: the largest span; and how raised and lowered runs are marked.
MAX_SPAN, SCRIPTS = 1000, {"sup": "^", "sub": "_"}
TABLE = f"struct<rows:int,cols:int,cells:{CELLS}>"


def _span(attributes: list, name: str) -> int:
    out = 1
    for key, value in attributes:
        text = (value or "").strip()
        if key == name and text.lstrip("+").isascii() and text.lstrip("+").isdigit() and int(text) >= 1:
            out = min(int(text), MAX_SPAN)
    return out


class TableReader(HTMLParser):
    """Collects cells; what stands outside of one is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.row, self.col = -1, 0
        self.cells: list[dict] = []
        self.open: dict | None = None
        self.words: list[str] = []
        self.spanned: dict[int, list[tuple[int, int]]] = {}
        self.rows = self.cols = 0

    def close_cell(self) -> None:
        if self.open is not None:
            self.open["text"] = " ".join("".join(self.words).split())
            self.cells.append(self.open)
        self.open, self.words = None, []

    def _free(self, col: int) -> int:
        """The first column from col on that no span from above covers."""
        for a, z in sorted(self.spanned.get(self.row, [])):
            if a <= col < z:
                col = z
        return col

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.close_cell()
            self.row, self.col = self.row + 1, 0
        elif tag in ("td", "th"):
            self.close_cell()
            self.row = max(self.row, 0)
            self.col = self._free(self.col)
            down, across = _span(attrs, "rowspan"), _span(attrs, "colspan")
            self.open = {"row": self.row, "col": self.col, "row_span": down, "col_span": across, "header": tag == "th", "text": ""}
            for r in range(self.row, self.row + down):
                self.spanned.setdefault(r, []).append((self.col, self.col + across))
            self.rows, self.cols = max(self.rows, self.row + down), max(self.cols, self.col + across)
            self.col += across
        elif tag == "br":
            self.words.append(" ")
        elif tag in SCRIPTS and self.open is not None:
            self.words.append(SCRIPTS[tag])

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.close_cell()

    def handle_data(self, data):
        if self.open is not None:
            self.words.append(data)


def read_table(markup: str | None) -> dict | None:
    """rows, cols and cells of the markup's cells; None without a cell."""
    if not markup or not markup.strip():
        return None
    reader = TableReader()
    reader.feed(markup)
    reader.close()
    reader.close_cell()
    return {"rows": reader.rows, "cols": reader.cols, "cells": reader.cells} if reader.cells else None


def table_from_html(markup: Column) -> Column:
    @F.pandas_udf(TABLE)
    def parse(texts: pd.Series) -> pd.DataFrame:
        found = [read_table(t) or {"rows": None, "cols": None, "cells": None} for t in texts]
        return pd.DataFrame(found, columns=["rows", "cols", "cells"], dtype=object)

    return parse(markup)
