"""Blocks from Word and spreadsheet packages, read with the standard library within fixed bounds."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.sources.office import BUILTIN, area, number_format, place, shown_number
from docspark.sources.texts import CELLS

#: Bounds of a package: entries, bytes of a part and in all, blocks, cells, hops of a style chain, depth of elements.
MAX_ENTRIES, MAX_PART, MAX_TOTAL, MAX_BLOCKS, MAX_CELLS, MAX_HOPS, MAX_DEPTH = 10_000, 64 << 20, 128 << 20, 500_000, 1 << 20, 16, 256
PAGE_BLOCK = f"struct<page:int,ord:int,kind:string,level:int,text:string,table:struct<rows:int,cols:int,cells:{CELLS}>>"


class Corrupt(ValueError):
    """A package that can't be read."""


class Package:
    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise Corrupt(str(e)) from e
        if len(self.zip.infolist()) > MAX_ENTRIES:
            raise Corrupt("too many entries")
        self.left = MAX_TOTAL

    def has(self, name: str) -> bool:
        return name in self.zip.NameToInfo

    def xml(self, name: str) -> ET.Element:
        with self.zip.open(name) as f:
            raw = f.read(min(MAX_PART, self.left) + 1)
        if len(raw) > min(MAX_PART, self.left):
            raise Corrupt("a part is too large")
        self.left -= len(raw)
        if b"<!DOCTYPE" in raw[:1024]:
            raise Corrupt("a part declares a document type")
        depth = 0
        try:
            for event, e in ET.iterparse(io.BytesIO(raw), ("start", "end")):
                depth += 1 if event == "start" else -1
                if depth > MAX_DEPTH:
                    raise Corrupt("elements are nested too deep")
        except ET.ParseError as e:
            raise Corrupt(str(e)) from e
        return e

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, target part) of a part; "" is the package."""
        folder, _, base = part.rpartition("/")
        name = f"{folder}/_rels/{base}.rels" if part else "_rels/.rels"
        name = name.lstrip("/")
        if not self.has(name):
            return {}
        out = {}
        for r in self.xml(name):
            target = r.get("Target", "")
            path = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}".lstrip("/")
            while re.search(r"[^/]+/\.\./", path):
                path = re.sub(r"[^/]+/\.\./", "", path, count=1)
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], path)
        return out

    def main(self, default: str) -> str:
        return next((t for kind, t in self.relations("").values() if kind == "officeDocument" and self.has(t)), default)


def local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if local(c.tag) == name), None) if e is not None else None
    return e


def children(e: ET.Element, name: str) -> list[ET.Element]:
    """What stands below a child of that name."""
    found = child(e, name)
    return list(found) if found is not None else []


# --- Word ----------------------------------------------------------------------------------------------------------

#: Elements that are no part of the text, what in a drawing shows something, and the most columns of a span.
DROPPED = frozenset("del moveFrom delText instrText delInstrText rt pPrChange rPrChange sectPr sdtPr sdtEndPr tblPr tblPrEx customXmlPr Fallback rPr pPr".split())
PICTURED = frozenset("blip imagedata chart relIds OLEObject contentPart".split())
MAX_SPAN = 1000
#: What a raised and a lowered run in a cell are marked with, so that km2 with a raised 2 isn't read as km2.
MARKS = {"superscript": "^", "subscript": "_"}


def found(e: ET.Element, names: frozenset[str] | set[str], dropped: frozenset[str] = DROPPED) -> Iterator[ET.Element]:
    """The outermost elements below e with such names, in their order; what is dropped isn't looked into."""
    todo = [iter(e)]
    while todo:
        c = next(todo[-1], None)
        if c is None:
            todo.pop()
        elif (name := local(c.tag)) in names:
            yield c
        elif name not in dropped:
            todo.append(iter(c))


def switched(e: ET.Element | None) -> bool:
    return e is not None and attribute(e, "val") not in ("0", "false", "off")


def count_of(e: ET.Element | None, least: int) -> int:
    """A number that is written on an element, held to MAX_SPAN."""
    raw = (attribute(e, "val") or "") if e is not None else ""
    return min(max(int(raw), least), MAX_SPAN) if re.fullmatch(r"[+-]?[0-9]{1,18}", raw) else least


class Text:
    """A paragraph's text in the making, its figures, and the blocks of text boxes in it."""

    def __init__(self):
        self.parts: list[str] = []
        self.figures, self.inside = 0, []


class Document:
    def __init__(self, package: Package):
        self.package = package
        self.part = package.main("word/document.xml")
        self.styles: dict[str, dict] = {}
        self.cited: dict[tuple[str, str], None] = {}
        # Cells around the text at hand, cells of all tables, blocks in blocks, and runs whose mark is set.
        self.depth = self.cells = self.nested = 0
        self.marked: set[ET.Element] = set()
        targets = package.relations(self.part).values()
        self.targets = {kind: path for kind, path in targets}
        if package.has(self.targets.get("styles", "")):
            for s in package.xml(self.targets["styles"]):
                if local(s.tag) == "style":
                    own = self.properties(child(s, "pPr"))
                    name, base = child(s, "name"), child(s, "basedOn")
                    own |= {"name": (attribute(name, "val") or "") if name is not None else "", "style": attribute(base, "val") if base is not None else None}
                    self.styles[attribute(s, "styleId") or ""] = own

    @staticmethod
    def properties(p: ET.Element | None) -> dict:
        style, level, number = child(p, "pStyle"), child(p, "outlineLvl"), child(p, "numPr", "numId")
        return {
            "style": attribute(style, "val") if style is not None else None,
            "outline": int(attribute(level, "val") or 9) if level is not None else None,
            "list": attribute(number, "val") != "0" if number is not None else None,
        }

    def kind(self, own: dict) -> tuple[str, int]:
        """The kind that a paragraph's style chain gives it: a telling name first, then outline level, then list."""
        outline, listed, name, style = own["outline"], own["list"], None, own["style"]
        for _ in range(MAX_HOPS):
            if not style:
                break
            held = self.styles.get(style, {"name": style, "outline": None, "list": None, "style": None})
            plain = held["name"].lower().replace(" ", "")
            if name is None and re.fullmatch(r"title|subtitle|caption|heading[1-9]", plain):
                name = plain
            outline = held["outline"] if outline is None else outline
            listed = held["list"] if listed is None else listed
            style = held["style"]
        if name in ("title", "subtitle", "caption"):
            return {"title": ("title", 1), "subtitle": ("heading", 2), "caption": ("caption", 0)}[name]
        if name:
            return "heading", min(int(name[7:]), 6)
        if outline is not None and outline < 9:
            return "heading", min(outline + 1, 6)
        return ("list_item", 0) if listed else ("text", 0)

    def _text(self, e: ET.Element, run: ET.Element | None, into: Text) -> None:
        said = e.text or ""
        place = child(run, "rPr", "vertAlign") if run is not None and self.depth else None
        if said and place is not None and run not in self.marked:
            said = MARKS.get(attribute(place, "val") or "", "") + said
            self.marked.add(run)
        into.parts.append(said)

    def _break(self, e: ET.Element, run: ET.Element | None, into: Text) -> None:
        into.parts.append("\n" if attribute(e, "type") in (None, "textWrapping") else "")

    def _note(self, e: ET.Element, run: ET.Element | None, into: Text) -> None:
        self.cited.setdefault((local(e.tag).removesuffix("Reference"), attribute(e, "id") or ""))

    def _graphic(self, e: ET.Element, run: ET.Element | None, into: Text) -> None:
        kinds = [local(x.tag) for x in found(e, PICTURED | {"txbxContent"}, frozenset({"Fallback"}))]
        into.figures += any(k in PICTURED for k in kinds)
        for box in found(e, {"txbxContent"}, frozenset({"Fallback"})):
            into.inside += self.blocks(box)

    def paragraph(self, p: ET.Element) -> list[dict]:
        into = Text()
        todo: list[tuple[ET.Element | None, Iterator[ET.Element]]] = [(None, iter(p))]
        while todo:
            run, below = todo[-1]
            c = next(below, None)
            if c is None:
                todo.pop()
                continue
            name = local(c.tag)
            if name in HANDLERS:
                HANDLERS[name](self, c, run, into)
            elif name not in DROPPED:
                todo.append((c if name == "r" else run, iter(c)))
        text = "".join(into.parts).strip()
        kind, level = self.kind(self.properties(child(p, "pPr")))
        out = [{"kind": kind, "level": level, "text": text, "table": None}] if text else []
        return out + [_figure() for _ in range(into.figures)] + into.inside

    def row(self, tr: ET.Element) -> Iterator[tuple[int, int, bool, str | None, str, int]]:
        """(column, columns, header, merge, text, figures) of a row's cells; none of a row that a tracked change deleted."""
        own = child(tr, "trPr")
        if child(own, "del") is not None:
            return
        col, header = count_of(child(own, "gridBefore"), 0), switched(child(own, "tblHeader"))
        for tc in found(tr, {"tc"}, DROPPED | {"trPr"}):
            merge = child(tc, "tcPr", "vMerge")
            width = count_of(child(tc, "tcPr", "gridSpan"), 1)
            self.depth += 1
            inner = self.blocks(tc)
            self.depth -= 1
            text = "\n".join(b["text"] for b in inner if b["text"])
            yield col, width, header, None if merge is None else "new" if attribute(merge, "val") == "restart" else "more", text, sum(b["kind"] == "figure" for b in inner)
            col += width

    def table(self, e: ET.Element) -> list[dict]:
        """A table's block, then a figure for each picture in its cells; a table without a cell is none."""
        grid = child(e, "tblGrid")
        cols = min(sum(local(g.tag) == "gridCol" for g in grid), MAX_SPAN) if grid is not None else 0
        cells: list[dict] = []
        open_: dict[int, dict] = {}
        rows = figures = 0
        for tr in found(e, {"tr"}):
            own = list(self.row(tr))
            if not own and child(tr, "trPr", "del") is not None:
                continue
            for col, width, header, merge, text, pictures in own:
                figures += pictures
                cols = max(cols, col + width)
                if merge == "more" and col in open_:
                    held = open_[col]
                    held["row_span"], held["text"] = held["row_span"] + 1, "\n".join(x for x in (held["text"], text) if x)
                    continue
                cells.append({"row": rows, "col": col, "row_span": 1, "col_span": width, "header": header, "text": text})
                open_.pop(col, None)
                if merge == "new":
                    open_[col] = cells[-1]
            rows += 1
        self.cells += rows * cols
        if self.cells > MAX_CELLS:
            raise Corrupt("too many cells")
        lines: dict[int, list[str]] = {}
        for c in cells:
            lines.setdefault(c["row"], []).append(c["text"])
        block = {"kind": "table", "level": 0, "text": "\n".join(" | ".join(x) for x in lines.values()), "table": {"rows": rows, "cols": cols, "cells": cells}}
        return ([block] if cells else []) + [_figure() for _ in range(figures)]

    def blocks(self, e: ET.Element) -> list[dict]:
        """What stands below e: paragraphs and tables, wrappers read through."""
        self.nested += 1
        if self.nested > MAX_DEPTH:
            raise Corrupt("nested too deep")
        out = [b for c in found(e, {"p", "tbl"}, DROPPED | {"tcPr"}) for b in (self.paragraph(c) if local(c.tag) == "p" else self.table(c))]
        self.nested -= 1
        return out

    def read(self) -> list[dict]:
        body = child(self.package.xml(self.part), "body")
        out = self.blocks(body) if body is not None else []
        for kind in ("footnote", "endnote"):
            name = self.targets.get(kind + "s", "")
            if self.package.has(name):
                notes = {attribute(n, "id"): "\n".join(b["text"] for b in self.blocks(n) if b["text"]) for n in self.package.xml(name) if attribute(n, "type") in (None, "normal")}
                out += [{"kind": "footnote", "level": 0, "text": notes[i], "table": None} for k, i in list(self.cited) if k == kind and notes.get(i)]
        if len(out) > MAX_BLOCKS:
            raise Corrupt("too many blocks")
        return [{"page": 1, "ord": i + 1, **b} for i, b in enumerate(out)]


def _figure() -> dict:
    return {"kind": "figure", "level": 0, "text": "", "table": None}


#: How elements inside a paragraph are read: by the element, the run it stands in, and the text in the making.
HANDLERS = {
    "t": Document._text, "br": Document._break, "cr": lambda self, e, run, into: into.parts.append("\n"), "noBreakHyphen": lambda self, e, run, into: into.parts.append("-"),
    "tab": lambda self, e, run, into: into.parts.append("\t" if run is not None else ""), **dict.fromkeys(("footnoteReference", "endnoteReference"), Document._note), **dict.fromkeys(("drawing", "pict", "object"), Document._graphic),
}


# --- spreadsheets --------------------------------------------------------------------------------------------------


class Workbook:
    def __init__(self, package: Package):
        self.package = package
        self.part = package.main("xl/workbook.xml")
        self.parts = package.relations(self.part)
        targets = {kind: path for kind, path in self.parts.values()}
        strings = targets.get("sharedStrings", "")
        self.strings = [self.words(e) for e in package.xml(strings)] if package.has(strings) else []
        self.formats: list[frozenset[str]] = []
        if package.has(targets.get("styles", "")):
            styles = package.xml(targets["styles"])
            codes = {attribute(e, "numFmtId"): attribute(e, "formatCode") or "" for e in children(styles, "numFmts")}
            for xf in children(styles, "cellXfs"):
                number = attribute(xf, "numFmtId") or "0"
                self.formats.append(number_format(codes[number]) if number in codes else frozenset(filter(None, BUILTIN.get(int(number), "").split(","))))

    @staticmethod
    def words(e: ET.Element) -> str:
        """A string's runs, without phonetic ones."""
        return "".join((c.text or "") if local(c.tag) == "t" else Workbook.words(c) if local(c.tag) != "rPh" else "" for c in e)

    def value(self, c: ET.Element, date1904: bool) -> str:
        kind, v = c.get("t", "n"), child(c, "v")
        raw = (v.text or "") if v is not None else ""
        if kind == "inlineStr":
            inline = child(c, "is")
            return self.words(inline) if inline is not None else ""
        if kind == "s":
            return self.strings[int(raw)] if raw.isdigit() and int(raw) < len(self.strings) else ""
        if kind == "b":
            return {"1": "TRUE", "0": "FALSE"}.get(raw, raw)
        if kind != "n" or not raw:
            return raw
        style = int(c.get("s", "0"))
        return shown_number(raw, self.formats[style] if style < len(self.formats) else frozenset(), date1904)

    def sheet(self, name: str, date1904: bool) -> dict | None:
        """The rectangle around all cells with a value, as one table; merged cells are clipped to it."""
        root = self.package.xml(name)
        values: dict[tuple[int, int], str] = {}
        row = -1
        for r in children(root, "sheetData"):
            row = int(r.get("r", row + 2)) - 1
            col = -1
            for c in r:
                at = place(c.get("r", "")) if c.get("r") else (row, col + 1)
                if at is None:
                    raise Corrupt("a cell has no place")
                row, col = at
                text = self.value(c, date1904)
                if text:
                    values[at] = text
        if not values:
            return None
        r0, r1 = min(r for r, _ in values), max(r for r, _ in values)
        c0, c1 = min(c for _, c in values), max(c for _, c in values)
        if (r1 - r0 + 1) * (c1 - c0 + 1) > MAX_CELLS:
            raise Corrupt("too many cells")
        covered: dict[tuple[int, int], tuple[int, int]] = {}
        for m in children(root, "mergeCells"):
            a = area(m.get("ref", ""))
            if a is None:
                raise Corrupt("a merged range can't be read")
            clip = max(a[0], r0), max(a[1], c0), min(a[2], r1), min(a[3], c1)
            for r in range(clip[0], clip[2] + 1):
                for c in range(clip[1], clip[3] + 1):
                    if (r, c) in covered:
                        raise Corrupt("merged ranges overlap")
                    covered[r, c] = (clip[2] - clip[0] + 1, clip[3] - clip[1] + 1) if (r, c) == clip[:2] else (0, 0)
        cells = []
        for r in range(r0, r1 + 1):
            for c in range(c0, c1 + 1):
                down, across = covered.get((r, c), (1, 1))
                if down:
                    cells.append({"row": r - r0, "col": c - c0, "row_span": down, "col_span": across, "header": False, "text": values.get((r, c), "")})
        lines: dict[int, list[str]] = {}
        for c in cells:
            lines.setdefault(c["row"], []).append(c["text"])
        return {"kind": "table", "level": 0, "text": "\n".join(" | ".join(x) for x in lines.values()), "table": {"rows": r1 - r0 + 1, "cols": c1 - c0 + 1, "cells": cells}}

    def read(self) -> list[dict]:
        book = self.package.xml(self.part)
        setting = child(book, "workbookPr")
        date1904 = setting is not None and setting.get("date1904") in ("1", "true")
        out = []
        for page, s in enumerate(children(book, "sheets"), 1):
            kind, target = self.parts.get(attribute(s, "id") or "", ("", ""))
            if not target:
                raise Corrupt("a sheet names no part")
            own = [{"kind": "title", "level": 1, "text": s.get("name"), "table": None}] if s.get("name") else []
            table = self.sheet(target, date1904) if kind == "worksheet" else {"kind": "figure", "level": 0, "text": "", "table": None} if kind == "chartsheet" else None
            own += [table] if table else []
            out += [{"page": page, "ord": i + 1, **b} for i, b in enumerate(own)]
        return out


def read(data: bytes) -> tuple[list[dict], str | None]:
    """(blocks, code) of a Word or spreadsheet package; document_corrupt for what can't be read."""
    try:
        package = Package(data)
        if package.has(package.main("word/document.xml")) and not package.has("xl/workbook.xml"):
            return Document(package).read(), None
        return Workbook(package).read(), None
    except (Corrupt, KeyError, zipfile.BadZipFile, ValueError, RecursionError, NotImplementedError) as e:
        return [], f"document_corrupt: {e}"[:200]


def blocks(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """id, page, ord, kind, level, text, table of each package; and error, on a row of its own, for one that can't be read."""

    @F.pandas_udf(f"struct<blocks:array<{PAGE_BLOCK}>,error:string>")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(c) for c in contents], columns=["blocks", "error"])

    rows = files.select(id_col, run(content_col).alias("r"))
    return rows.select(id_col, "r.error", F.inline_outer("r.blocks"))


def sample_files(names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Small packages that hold each name: a Word file for even ids, a workbook for odd ones."""

    @F.pandas_udf("binary")
    def make(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([word_file(t) if i % 2 == 0 else workbook_file(t) for i, t in zip(ids, texts, strict=True)])

    return names.select(id_col, make(id_col, name_col).alias("content"))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def word_file(name: str) -> bytes:
    body = f'<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>{name}</w:t></w:r></w:p><w:p><w:r><w:t>About</w:t><w:tab/><w:t>{name}</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>'
    table = f"<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr><w:p><w:r><w:t>{name}</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return _zipped({"word/document.xml": f"<w:document {_W}><w:body>{body}{table}</w:body></w:document>"})


def workbook_file(name: str) -> bytes:
    cells = f'<row r="2"><c r="B2" t="inlineStr"><is><t>{name}</t></is></c><c r="C2" s="1"><v>46027</v></c></row><row r="3"><c r="B3" t="b"><v>1</v></c><c r="C3" s="2"><v>0.286</v></c></row>'
    return _zipped(
        {
            "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet {_S}><numFmts><numFmt numFmtId="164" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{cells}</sheetData></worksheet>",
        }
    )
