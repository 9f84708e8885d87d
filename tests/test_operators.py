"""Operators whose results are folds, formats or geometry, on small cases with known results."""

import io
import json
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docspark.functions import geometry as G
from docspark.functions import text as X
from docspark.operators import assemble as A
from docspark.operators import capacity as J
from docspark.operators import chunks as D
from docspark.operators import control as K
from docspark.operators import extract as E
from docspark.operators import fair as I
from docspark.operators import layout as LY
from docspark.operators import normalize as N
from docspark.operators import quality as Q
from docspark.operators import views as V
from docspark.sources import glyphs, office, ooxml, sinks, texts
from docspark.sources.html import read_table


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


# --- texts ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["3", "Page 3", "page 3 of 40", "3 / 40", "- 3 -", "[3]", "(3)", "p. 3", "Seite 3 von 40", "Página 3 de 40", "3."])
def test_page_numbers_are_known(spark, text):
    assert values(spark, [(text,)], "t string", X.is_page_number(F.col("t"))) == [(True,)]


@pytest.mark.parametrize("text", ["1,234.56", "12345", "Total 3", "3 apples", "Chapter 3"])
def test_other_numbers_are_not(spark, text):
    assert values(spark, [(text,)], "t string", X.is_page_number(F.col("t"))) == [(False,)]


def test_section_depths(spark):
    cases = {"1 Introduction": 1, "2.3 Method": 2, "3.2.1 Details": 3, "A.1 Proof": 2, "A. Appendix": 1, "IV. Results": 1, "A Study of": 0, "2024 Annual": 0, "3rd Quarter": 0, "1": 0, "IBM. Report": 0}
    got = values(spark, list(cases.items()), "t string, d int", "t", X.section_depth(F.col("t")), "d")
    assert [(t, d) for t, d, _ in got] == list(cases.items())


def test_labels(spark):
    cases = {"Section-header": "heading", "LAYOUT_FIGURE": "figure", "QR code": "barcode", "watermark": None, " Page Number ": "page_number", "narrative text": "text"}
    assert dict(values(spark, [(k,) for k in cases], "t string", "t", X.label_kind(F.col("t")))) == cases


def test_markdown():
    source = "# Title #\n\npara one\nstill one\n\n- a\n* b\n12. c\n## Head\n```py\nx = 1\n\n# no\n```\nlast\n```\nopen"
    assert list(texts.markdown_blocks(source)) == [
        ("title", 1, "Title"), ("text", 0, "para one\nstill one"), ("list_item", 0, "a"), ("list_item", 0, "b"), ("list_item", 0, "c"), ("heading", 2, "Head"), ("code", 0, "x = 1\n\n# no"), ("code", 0, "open"), ("text", 0, "last"),
    ][:7] + [("text", 0, "last"), ("code", 0, "open")]


def test_delimited_text_is_ragged():
    assert texts.records('a,"b ""q"", c"\n\nd\n"x\ny",z,,\n') == [["a", 'b "q", c'], ["d"], ["x\ny", "z", "", ""]]


def test_tables_from_markup():
    t = read_table("<table><tr><th rowspan=2>a<th colspan='x'>b &amp; c<tr><td>d<br>e<sup>2</sup></td></tr></table><script>x</script>")
    assert (t["rows"], t["cols"]) == (2, 2)
    assert [(c["row"], c["col"], c["row_span"], c["header"], c["text"]) for c in t["cells"]] == [(0, 0, 2, True, "a"), (0, 1, 1, True, "b & c"), (1, 1, 1, False, "d e^2")]
    wide = read_table("<td>a<td colspan=99999>b<tr><td>c<tr><td>d")
    assert (wide["rows"], wide["cols"]) == (3, 1001)
    assert read_table("<table><tr></tr></table>") is None and read_table(None) is None


# --- office formats --------------------------------------------------------------------------------------------------


def test_number_formats():
    cases = {"mm:ss": "clock seconds", "mmmm": "date", "[h]:mm:ss": "clock seconds elapsed", '"hours" 0': "", "yyyy-mm-dd hh:mm": "date clock", "0.0%": "percent", "h AM/PM": "clock", "0;[s]": "", "[mm]:ss": "clock seconds elapsed", "[Red]0": ""}
    assert {c: office.number_format(c) for c in cases} == {c: frozenset(f.split()) for c, f in cases.items()}


def test_numbers_and_serials():
    plain = {"2.2999999999999998": "2.3", "1E+3": "1000", "1.5E+300": "1.5e+300", "2.5E-9": "2.5e-09", "0": "0", "-12.50": "-12.5", "n/a": "n/a", "1e21": "1e+21"}
    assert {k: office.shown_number(k, frozenset()) for k in plain} == plain
    day, time = frozenset({"date"}), frozenset({"date", "clock"})
    assert office.shown_number("0.07", frozenset({"percent"})) == "7%"
    assert office.shown_number("46027", day) == "2026-01-05" and office.shown_number("46027.75", time) == "2026-01-05T18:00"
    assert office.shown_number("1.5", frozenset({"clock", "seconds", "elapsed"})) == "36:00:00"
    assert office.shown_number("46027.999999", time | {"seconds"}) == "2026-01-06T00:00:00"
    assert [office.shown_number(str(n), day) for n in (59, 60, 61)] == ["1900-02-28", "1900-02-29", "1900-03-01"]
    assert office.shown_number("44565", day, date1904=True) == "2026-01-05" and office.shown_number("2958466", day) == "2958466"


def test_serials_as_columns_are_the_same(spark):
    rows = [(v,) for v in (0.0, 1.5, 59.0, 60.25, 61.999999, 46027.75, 120.0416666)]
    got = values(spark, rows, "v double", "v", office.moment(F.col("v"), True, True, True), office.moment(F.col("v"), False, True, True, True))
    assert got == [(v, office.serial_text(v, frozenset({"date", "clock", "seconds"})), office.serial_text(v, frozenset({"clock", "seconds", "elapsed"}))) for (v,) in rows]


def test_references(spark):
    cases = {"B7": (6, 1), "$B$7": (6, 1), "XFD1048576": (1048575, 16383), "XFE1": None, "A0": None, "7": None, "A1048577": None}
    got = values(spark, [(k,) for k in cases], "r string", "r", office.cell_reference(F.col("r")))
    assert {r: tuple(v) if v else None for r, v in got} == cases == {r: office.place(r) for r in cases}
    assert office.area("C3:$A$1") == (0, 0, 2, 2) and office.area("A1:") == (0, 0, 0, 0) and office.area("x") is None


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_word_files():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def p(text, style=None, extra=""):
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r>{extra}</w:p>"

    merged = "<w:tbl>" + "".join(f"<w:tr><w:tc><w:tcPr><w:vMerge{v}/></w:tcPr>{p(t)}</w:tc><w:tc>{p('x')}</w:tc></w:tr>" for v, t in ((' w:val="restart"', "tall"), ("", ""))) + "</w:tbl>"
    data = package(
        {
            "word/document.xml": f'<w:document {w}><w:body>{p("T", "Title")}{p("One", "H")}{p("item", "L")}{p("see", None, "<w:r><w:footnoteReference w:id=\'2\'/></w:r>")}<w:p><w:r><w:drawing><w:blip/></w:drawing></w:r></w:p>{p("Cap", "Caption")}<w:del>{p("gone")}</w:del><w:ins>{p("new")}</w:ins>{merged}</w:body></w:document>',
            "word/_rels/document.xml.rels": f'<Relationships><Relationship Id="a" Type="{rel}/styles" Target="styles.xml"/><Relationship Id="b" Type="{rel}/footnotes" Target="footnotes.xml"/></Relationships>',
            "word/styles.xml": f'<w:styles {w}><w:style w:styleId="H"><w:name w:val="custom"/><w:basedOn w:val="H2"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="L"><w:name w:val="bullets"/><w:pPr><w:numPr><w:numId w:val="3"/></w:numPr></w:pPr></w:style></w:styles>',
            "word/footnotes.xml": f'<w:footnotes {w}><w:footnote w:id="1">{p("unused")}</w:footnote><w:footnote w:id="2">{p("a note")}</w:footnote></w:footnotes>',
        }
    )
    blocks, error = ooxml.read(data)
    assert error is None
    assert [(b["kind"], b["level"], b["text"]) for b in blocks] == [
        ("title", 1, "T"), ("heading", 2, "One"), ("list_item", 0, "item"), ("text", 0, "see"), ("figure", 0, ""), ("caption", 0, "Cap"), ("text", 0, "new"), ("table", 0, "tall | x\nx"), ("footnote", 0, "a note"),
    ]
    assert blocks[7]["table"]["cells"][0]["row_span"] == 2


W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def word_blocks(body, **more):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {"word/document.xml": f"<w:document {W_NS}><w:background><w:p><w:r><w:t>beside</w:t></w:r></w:p></w:background><w:body>{body}</w:body></w:document>"}
    parts |= {f"word/{k}.xml": f"<w:{k} {W_NS}>{v}</w:{k}>" for k, v in more.items()}
    parts["word/_rels/document.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="{k}" Type="{rel}/{k}" Target="{k}.xml"/>' for k in more) + "</Relationships>"
    return ooxml.read(package(parts))


def test_texts_of_word_paragraphs():
    r = lambda s, props="": f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{s}</w:t></w:r>'
    body = (
        f'<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:br w:type="page"/><w:t>-d</w:t><w:noBreakHyphen/><w:t>e</w:t></w:r></w:p>'
        f"<w:p>{r('The fee is ')}<w:del><w:r><w:delText>1</w:delText></w:r></w:del><w:ins>{r('2')}</w:ins><w:moveFrom>{r(' gone')}</w:moveFrom><w:smartTag>{r('.')}</w:smartTag></w:p>"
        f"<w:p><w:r><w:ruby><w:rt>{r('over')}</w:rt><w:rubyBase>{r('base')}</w:rubyBase></w:ruby></w:r></w:p><w:p><m:oMath><m:r><m:t>x+y</m:t></m:r></m:oMath></w:p>"
        f"<w:sdt><w:sdtPr><w:p>{r('no')}</w:p></w:sdtPr><w:sdtContent><w:p>{r('held')}</w:p></w:sdtContent></w:sdt><w:p>{r('1')}{r('st', '<w:vertAlign w:val=' + chr(34) + 'superscript' + chr(34) + '/>')}</w:p>"
    )
    blocks, error = word_blocks(body)
    assert error is None and [b["text"] for b in blocks] == ["a\tb\nc-d\u002de", "The fee is 2.", "base", "x+y", "held", "1st"]


def test_cells_of_word_tables():
    p = lambda s: f"<w:p><w:r><w:t>{s}</w:t></w:r></w:p>"
    tc = lambda content, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{content}</w:tc>"
    raised = '<w:p><w:r><w:t>km</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>2</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="subscript"/></w:rPr><w:t>i</w:t><w:t>j</w:t></w:r></w:p>'
    picture = "<w:p><w:r><w:drawing><a:blip/></w:drawing></w:r></w:p>"
    nested = f"<w:tbl><w:tr>{tc(p('in'))}{tc(p('side'))}</w:tr></w:tbl>"
    body = (
        "<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/><w:tblGridChange><w:tblGrid><w:gridCol/></w:tblGrid></w:tblGridChange></w:tblGrid>"
        f"<w:tr><w:trPr><w:tblHeader/></w:trPr>{tc(p('Region'), '<w:gridSpan w:val=%s2%s/>' % (chr(34), chr(34)))}{tc(p('Total'))}</w:tr>"
        f"<w:tr>{tc(p('North'), '<w:vMerge w:val=%srestart%s/>' % (chr(34), chr(34)))}{tc(raised)}{tc(p('9'))}</w:tr><w:tr>{tc(p('more'), '<w:vMerge/>')}{tc(picture + p('a'))}{tc(nested)}</w:tr>"
        f"<w:tr><w:trPr><w:del/></w:trPr>{tc(p('deleted'))}</w:tr><w:sdt><w:sdtContent><w:tr><w:trPr><w:gridBefore w:val='1'/><w:tblHeader w:val='0'/></w:trPr>{tc(p('alone'), '<w:vMerge/>')}{tc(p('kept'))}</w:tr></w:sdtContent></w:sdt></w:tbl><w:tbl/>"
    )
    blocks, error = word_blocks(body)
    assert error is None and [b["kind"] for b in blocks] == ["table", "figure"]
    t = blocks[0]["table"]
    assert (t["rows"], t["cols"]) == (4, 3) and [(c["row"], c["col"], c["row_span"], c["col_span"], c["header"], c["text"]) for c in t["cells"]] == [
        (0, 0, 1, 2, True, "Region"), (0, 2, 1, 1, True, "Total"), (1, 0, 2, 1, False, "North\nmore"), (1, 1, 1, 1, False, "km^2_ij"), (1, 2, 1, 1, False, "9"), (2, 1, 1, 1, False, "a"), (2, 2, 1, 1, False, "in | side"), (3, 1, 1, 1, False, "alone"), (3, 2, 1, 1, False, "kept"),
    ]
    wide = f"<w:tbl><w:tr>{tc(p('wide'), '<w:gridSpan w:val=%s2000000000%s/>' % (chr(34), chr(34)))}</w:tr></w:tbl>"
    assert word_blocks(wide)[0][0]["table"]["cols"] == 1000
    assert "nested too deep" in word_blocks("<w:sdt>" * 300 + "</w:sdt>" * 300)[1]


def test_figures_and_notes_of_word_files():
    p = lambda s: f"<w:p><w:r>{s}</w:r></w:p>"
    box = f"<w:drawing><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent><Fallback><a:blip/></Fallback></w:drawing>"
    cite = lambda k, i: f'<w:{k}Reference w:id="{i}"/>'
    note = lambda k, i, text, more="": f'<w:{k} w:id="{i}"{more}><w:p><w:r><w:t>{text}</w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p></w:{k}>'
    body = p("<w:pict><w:line/></w:pict>") + p(box) + p("<w:object><OLEObject/></w:object>") + p("<w:t>says</w:t>" + cite("footnote", 3) + cite("endnote", 1) + cite("footnote", 2) + cite("footnote", 3) + cite("footnote", 0) + cite("footnote", 9))
    blocks, error = word_blocks(body, footnotes=note("footnote", 2, "two") + note("footnote", 3, "three") + note("footnote", 0, "no", ' w:type="separator"'), endnotes=note("endnote", 1, "one"))
    assert error is None and [(b["kind"], b["text"]) for b in blocks] == [("text", "boxed"), ("figure", ""), ("text", "says"), ("footnote", "three\nend"), ("footnote", "two\nend"), ("footnote", "one\nend")]


def test_long_fields_of_delimited_text():
    assert texts.records("a," + "x" * 300_000 + "\nb") == [["a", "x" * 300_000], ["b"]]


def test_workbooks():
    blocks, error = ooxml.read(ooxml.workbook_file("Ledger"))
    assert error is None and [(b["page"], b["kind"], b["text"]) for b in blocks] == [(1, "title", "Ledger"), (1, "table", "Ledger | 2026-01-05\nTRUE | 28.6%")]
    assert ooxml.read(b"no zip")[1].startswith("document_corrupt") and ooxml.read(package({"a": "b"}))[1].startswith("document_corrupt")


def test_counts_of_pages():
    assert office.pdf_pages(b"%PDF-1.4 << /Type /Pages /Kids [] /Count 12 >> << /Type /Pages /Count 7 >>") == 12
    packed = b"<< /Type /ObjStm /Length 9 >>\nstream\n" + zlib.compress(b"<< /Type /Pages /Count 31 >>") + b"\nendstream"
    assert office.pdf_pages(b"%PDF-1.5 " + packed) == 31
    assert office.pdf_pages(b"<< /Type /Page >> << /Type/Page /X 1 >> /Type /PageLabel") == 2

    def tiff(*offsets, order="<"):
        out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, offsets[0] if offsets else 0))
        for i, at in enumerate(offsets):
            out[at:] = b"\0" * max(0, at - len(out)) + struct.pack(order + "H", 1) + b"\0" * 12 + struct.pack(order + "I", offsets[i + 1] if i + 1 < len(offsets) else 0)
        return bytes(out)

    assert office.tiff_frames(tiff(8, 40, 80)) == 3 and office.tiff_frames(tiff(8, order=">")) == 1
    assert office.tiff_frames(tiff()) == -1 and office.tiff_frames(b"II*\0" + struct.pack("<I", 900)) == -1
    assert office.tiff_frames(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 0) + struct.pack("<I", 8)) == -1


def test_signed_containers():
    def der(tag, body):
        return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + struct.pack(">H", len(body))) + body

    def signed(content):
        data = der(0x30, bytes.fromhex("06092A864886F70D010701") + der(0xA0, der(0x04, content)))
        return der(0x30, bytes.fromhex("06092A864886F70D010702") + der(0xA0, der(0x30, der(0x02, b"\x01") + der(0x31, b"") + data)))

    assert office.unwrapped(signed(b"hello")) == b"hello" and office.unwrapped(signed(signed(b"x" * 300))) == b"x" * 300
    assert office.unwrapped(b"plain") is None and office.unwrapped(signed(signed(signed(signed(b"y"))))) == signed(b"y")
    import base64

    assert office.unwrapped(b"-----BEGIN PKCS7-----\n" + base64.encodebytes(signed(b"pem")) + b"-----END PKCS7-----") == b"pem"


# --- assembly ------------------------------------------------------------------------------------------------------

BLOCKS = "parse_id long, page int, state string, source string, ord int, ref string, kind string, text string, level int, box struct<x0:double,y0:double,x1:double,y1:double>"


def pages_of(*pages, box=None):
    return [(1, n, "succeeded", "reader", i, f"{n}.{i}", kind, text, 0, box) for n, page in enumerate(pages, 1) for i, (kind, text) in enumerate(page, 1)]


def test_running_lines_need_half_the_pages(spark):
    rows = pages_of(*[[("text", head), ("text", f"body {i}"), ("text", f"Page {i}")] for i, head in enumerate(["Same  Line", "same line", "other", "SAME LINE", "x", "y"], 1)])
    out = {r.ref: (r.kind, r.repeated) for r in A.assembled(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert [out[f"{n}.1"] for n in (1, 2, 3, 4)] == [("page_header", False), ("page_header", True), ("text", False), ("page_header", True)]
    assert all(out[f"{n}.3"][0] == "page_number" and out[f"{n}.2"][0] == "text" for n in range(1, 7))
    fewer = pages_of(*[[("text", "h" if i < 2 else f"n{i}"), ("text", f"b{i}")] for i in range(6)])
    assert {r.kind for r in A.assembled(spark.createDataFrame(fewer, BLOCKS)).collect()} == {"text"}


def test_lines_away_from_the_edge_stay(spark):
    rows = pages_of(*[[("text", "same"), ("text", f"b{i}")] for i in range(4)], box=(0.1, 0.4, 0.9, 0.5))
    assert {r.kind for r in A.assembled(spark.createDataFrame(rows, BLOCKS)).collect()} == {"text"}


def table_rows(*pages):
    """pages: (state, [(kind, text, cols, header, x0)])."""
    out = []
    for n, (state, own) in enumerate(pages, 1):
        for i, (kind, text, cols, header, x0) in enumerate(own, 1):
            cell = {"row": 0, "col": 0, "row_span": 1, "col_span": 1, "header": True, "text": header}
            out.append((1, n, state, i, f"{n}.{i}", kind, text, {"rows": 5, "cols": cols, "cells": [cell]} if kind == "table" else None, (x0, 0.1, 0.9, 0.9) if x0 is not None else None))
    return out


SPAN_BLOCKS = f"parse_id long, page int, state string, ord int, ref string, kind string, text string, table struct<rows:int,cols:int,cells:{texts.CELLS}>, box struct<x0:double,y0:double,x1:double,y1:double>"


def found_spans(spark, *pages):
    return sorted((r.id, tuple(r.parts), r.rows) for r in A.spans(spark.createDataFrame(table_rows(*pages), SPAN_BLOCKS)).collect())


def test_spans(spark):
    t = lambda cols=3, header="Head", x0=None: ("table", "t", cols, header, x0)
    ok, text = "succeeded", ("text", "words", 0, "", None)
    more = ("caption", "Table 1 (continued)", 0, "", None)
    assert found_spans(spark, (ok, [t()]), (ok, [t()]), (ok, [t()])) == [("s1", ("1.1", "2.1", "3.1"), 15)]
    assert found_spans(spark, (ok, [t()]), (ok, [t(cols=4)])) == []
    assert found_spans(spark, (ok, [t()]), ("failed", [t()]), (ok, [t()])) == []
    assert found_spans(spark, (ok, [t(), text]), (ok, [t()])) == []
    assert found_spans(spark, (ok, [text, t()]), (ok, [more, t(), text]), (ok, [t()])) == [("s1", ("1.2", "2.2"), 10)]
    assert found_spans(spark, (ok, [t(header="a", x0=0.1)]), (ok, [t(header="b", x0=0.12)])) == [("s1", ("1.1", "2.1"), 10)]
    assert found_spans(spark, (ok, [t(header="a", x0=0.1)]), (ok, [t(header="b", x0=0.2)])) == []
    assert found_spans(spark, (ok, [t()]), (ok, [t(), text, t(header="New")]), (ok, [t(header="New")])) == [("s1", ("1.1", "2.1"), 10), ("s2", ("2.3", "3.1"), 10)]


def test_chunks_keep_headings_with_what_follows():
    block = lambda ref, kind, text, page=1, cells=None: {"page": page, "ref": ref, "kind": kind, "text": text, "cells": cells}
    doc = [block("1.1", "title", "A"), block("1.2", "heading", "B"), block("1.3", "text", "é" * 50), block("1.4", "page_footer", "f"), block("1.5", "heading", "C"), block("2.1", "text", "d" * 300, 2)]
    refs = lambda own, by, most: [c["refs"] for c in D.cut(own, by, most)]
    assert [(c["refs"], c["pages"]) for c in D.cut(doc, "section", 200)] == [(["1.1", "1.2", "1.3"], [1]), (["1.5", "2.1"], [1, 2])]
    assert refs(doc, "page", 1000) == [["1.1", "1.2", "1.3", "1.5"], ["2.1"]]
    heads = [block(f"1.{i}", "heading", "h" * 90) for i in range(6)]
    assert [len(own) for own in refs(heads, "section", 200)] == [3, 3]
    cells = [{"row": r, "col": c, "header": r == 0, "text": f"{r}{c}" * 10} for r in range(12) for c in range(2)]
    table = block("1.2", "table", "x" * 600, 1, cells)
    parts = D.cut([block("1.1", "heading", "H"), table, block("1.3", "text", "z")], "section", 200)
    assert parts[0]["refs"] == ["1.1", "1.2"] and all(c["refs"] == ["1.2"] for c in parts[1:-1]) and parts[-1]["refs"] == ["1.3"]
    head = "00" * 10 + " | " + "01" * 10
    assert all(head in "\n\n".join(c["texts"]) for c in parts[:-1])
    lines = [x for c in parts[:-1] for t in c["texts"] for x in t.split("\n") if x not in (head, "H")]
    assert lines == [f"{r}0" * 10 + " | " + f"{r}1" * 10 for r in range(1, 12)]


def test_windows_cut_sections_then_blocks_then_text():
    piece = lambda ref, text, section=False: {"ref": ref, "text": text, "section": section}
    own = [piece("1.1", "Head", True), piece("1.2", "a" * 20), piece("1.3", "Next", True), piece("1.4", "b" * 20)]
    assert D.pack(own, 0) == [("[1.1] Head\n[1.2] " + "a" * 20 + "\n[1.3] Next\n[1.4] " + "b" * 20, ["1.1", "1.2", "1.3", "1.4"])]
    assert [refs for _, refs in D.pack(own, 45)] == [["1.1", "1.2"], ["1.3", "1.4"]]
    long = D.pack([piece("2.1", "é" * 30)], 26)
    assert all(len(t.encode()) <= 26 for t, _ in long) and "".join(t.removeprefix("[2.1] ") for t, _ in long) == "é" * 30


PARSED = "parse_id long, page int, ord int, ref string, state string, kind string, text string"


def test_chunks_and_windows_of_odd_rows(spark):
    rows = [(1, 1, 1, "1.1", "succeeded", "text", None), (2, 1, 1, "1.1", "failed", "text", "a"), (3, 1, 1, "1.1", "succeeded", "page_header", "b"), (4, 1, 1, "1.1", "succeeded", "text", "c"), (4, 1, 1, "1.1", "succeeded", "text", "c"), (5, 1, 1, "1.1", "succeeded", "text", "日" * 70_000), (6, 1, 1, "1.1", "succeeded", None, "d")]
    blocks = spark.createDataFrame(rows, PARSED)
    for by in ("section", "page"):
        found = {r.parse_id: (r.id, r.text, r.pages, r.blocks) for r in D.chunks(blocks, by, 200).collect()}
        assert found == {4: ("c1", "c\n\nc", [1], ["1.1"]), 5: ("c1", "日" * 70_000, [1], ["1.1"]), 6: ("c1", "d", [1], ["1.1"])}
    own = {}
    for r in D.windows(blocks, 8000).collect():
        own.setdefault(r.parse_id, {})[r.window] = (r.text, r.refs, r.code)
    assert own[4] == {1: ("[1.1] c\n[1.1] c", ["1.1"], None)} and 1 not in own and len(own[5]) == 27
    assert "".join(own[5][i][0].removeprefix("[1.1] ") for i in range(1, 28)) == "日" * 70_000 and {r.code for r in D.windows(blocks, 4000).where("parse_id = 5").collect()} == {"too_many_pages"}
    assert D.chunks(blocks.where("false")).count() == 0 and D.windows(blocks.where("false"), 9).count() == 0


def test_table_renderings(spark):
    cells = [(0, 0, 1, 2, True, "A & B"), (1, 0, 1, 1, False, "x|y"), (1, 1, 1, 1, False, "z")]
    df = spark.createDataFrame([((2, 2, cells),)], f"table struct<rows:int,cols:int,cells:{texts.CELLS}>")
    row = df.select(V.table_html(F.col("table.cells")), V.table_text(F.col("table.cells")), V.table_markdown(F.col("table")), V.has_spans(F.col("table.cells"))).first()
    assert tuple(row) == ('<table><tr><th colspan="2">A &amp; B</th></tr><tr><td>x|y</td><td>z</td></tr></table>', "A & B\nx|y | z", "| A & B |  |\n| --- | --- |\n| x\\|y | z |", True)


# --- scores --------------------------------------------------------------------------------------------------------


def test_distances():
    cases = [("kitten", "sitting", 3), ("flaw", "lawn", 2), ("ab", "ba", 2), ("été", "ete", 2), ("", "abc", 3), ("same", "same", 0)]
    assert [Q.distance(a, b) for a, b, _ in cases] == [n for _, _, n in cases]


def test_matching_is_greedy_over_all_pairs():
    block = lambda kind, text, box=None: {"kind": kind, "text": text, "box": box}
    truth = [block("text", "alpha beta"), block("text", "alpha bet"), block("figure", "", {"x0": 0, "y0": 0, "x1": 1, "y1": 1}), block("text", "unseen words")]
    found = [block("text", "alpha bet"), block("figure", "", None), block("text", "alpha beta!"), block("figure", "", {"x0": 0, "y0": 0, "x1": 1, "y1": 0.9})]
    assert Q.matched(truth, found) == [2, 0, 3, -1]


def test_boxes(spark):
    rows = [((0.9, 0.2, 0.1, 0.4),), ((-1.0, -1.0, -0.5, -0.5),), ((0.0, 0.0, 1.0, 1.0),), (None,)]
    fixed = G.normalized(F.col("b"))
    got = values(spark, rows, "b struct<x0:double,y0:double,x1:double,y1:double>", fixed["box"], fixed["repaired"])
    assert [(tuple(b) if b else None, r) for b, r in got] == [((0.1, 0.2, 0.9, 0.4), True), (None, True), ((0.0, 0.0, 1.0, 1.0), False), (None, False)]


def test_miss_texts(spark):
    rows = [("cer", 0.0312, 0.02), ("kinds", 0.881, 0.9)]
    assert [r[0] for r in values(spark, rows, "m string, v double, b double", Q.miss_text(F.col("m"), F.col("v"), F.col("b")))] == ["cer 3.12% is over 2.00%", "kinds 88.1% is under 90.0%"]


# --- extractions ---------------------------------------------------------------------------------------------------


def test_merging_moves_citations():
    one = ({"a": 1, "l": [{"x": 1}], "n": None}, {"/a": ["1.1"], "/l/0/x": ["1.2"]})
    two = ({"a": 2, "l": [{"x": 2}, {"x": 1.0}], "n": "s"}, {"/a": ["2.1"], "/l/0": ["2.2"], "/l/1": ["2.3"], "/n": ["2.4"]})
    data, citations = E.merged([one, two, ({"a": 1}, {"/a": ["3.1", "1.1"]})])
    assert data == {"a": 1, "l": [{"x": 1}, {"x": 2}], "n": "s"}
    assert citations == {"/a": ["1.1", "3.1"], "/l/0/x": ["1.2"], "/l/1": ["2.2"], "/l/0": ["2.3"], "/n": ["2.4"]}
    assert E.cited({"a/b": [1]}, {"/a~1b/0": ["1.1", "9.9"], "/c": ["1.1"], "": ["1.1", "1.1"]}, ["1.1"]) == {"/a~1b/0": ["1.1"], "": ["1.1"]}


@pytest.mark.parametrize(
    ("schema", "value", "rules"),
    [
        ({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}, {"b": 1}, ["required", "additionalProperties"]),
        ({"type": "integer"}, 3.0, []), ({"type": "integer"}, True, ["type"]), ({"enum": [1, "x"]}, 1.0, []), ({"const": {"a": [1]}}, {"a": [2]}, ["const"]),
        ({"items": {"$ref": "#/$defs/s"}, "$defs": {"s": {"type": "string", "maxLength": 2}}}, ["ab", "abc", 1], ["maxLength", "type"]), ({"uniqueItems": True}, [{"a": 1, "b": 2}, {"b": 2.0, "a": 1}], ["uniqueItems"]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, 4, ["anyOf"]), ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 3, ["oneOf"]), ({"not": {"type": "null"}}, None, ["not"]), ({"if": {"minimum": 10}, "then": {"multipleOf": 5}}, 12, ["multipleOf"]),
        ({"contains": {"const": 1}, "minContains": 2}, [1, 2], ["contains"]), ({"pattern": "^a+$"}, "b", ["pattern"]), ({"dependentRequired": {"a": ["b"]}}, {"a": 1}, ["dependentRequired"]), ({"propertyNames": {"maxLength": 1}}, {"ab": 1}, ["maxLength"]),
    ],
)
def test_validation(schema, value, rules):
    # A schema's root is an object's, so the case is a member of one.
    root = {"type": "object", "properties": {"v": {k: x for k, x in schema.items() if k != "$defs"}}, "$defs": schema.get("$defs", {})}
    assert [f["rule"] for f in E.check(json.dumps({"v": value}), E.compile_schema(json.dumps(root)))] == rules


def test_parts_that_cannot_be_read_are_passed_over(spark):
    rows = [(1, 1, '{"a": 1', None), (1, 2, '{"a": 2, "t": "\\ud800"}', "no json"), (1, 3, None, None), (2, 1, "null", None), (3, 1, "[" * 200, '{"": 5}'), (4, 1, '{"b": null}', '{"/b": ["1.1", 3]}'), (4, 1, '{"b": null}', '{"/b": ["1.1", 3]}')]
    found = E.merge(spark.createDataFrame(rows, "id long, window int, data string, citations string"), ["id"])
    assert {r.id: (r.data, r.citations, r.unread) for r in found.collect()} == {1: ('{"a": 2, "t": "\ufffd"}', "{}", 2), 2: ("{}", "{}", 0), 3: ("{}", "{}", 1), 4: ('{"b": null}', '{"/b": ["1.1"]}', 0)}
    assert E.merge(spark.createDataFrame([], "id long, window int, data string, citations string"), ["id"]).count() == 0


def chained(n):
    links = {f"a{i}": {"allOf": [{"$ref": f"#/$defs/a{i + 1}"}] * 2} for i in range(n)}
    return {"type": "object", "$ref": "#/$defs/a0", "$defs": links | {f"a{n}": {"type": "object"}}}


@pytest.mark.parametrize(
    ("schema", "why"),
    [
        ({"type": "object", "$ref": "#"}, "without end"), ({"type": "object", "not": {"$ref": "#"}}, "without end"), ({"type": "object", "if": True, "then": {"$ref": "#"}}, "without end"), ({"type": "object", "dependentSchemas": {"a": {"$ref": "#"}}}, "without end"),
        ({"type": "object", "$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a"}}}, "without end"), (chained(40), "more than 256"), (chained(7), "more than 256"),
        ({"type": "object", "oneOf": [{"$ref": "#/$defs/a"}] * 128, "$defs": {"a": {"type": "object"}}}, "more than 256"), ({"type": "array"}, "root"), ({"items": {}}, "root"), ({"type": "object", "$schema": "http://json-schema.org/draft-07/schema#"}, "dialect"),
        ({"type": "object", "multipleOf": 0}, "multipleOf"), ({"type": "object", "properties": []}, "properties"), ({"type": "object", "required": "a"}, "required"), ({"type": "object", "pattern": "(?=a)"}, "pattern"), ({"type": "object", "pattern": "("}, "pattern"), ({"type": "object", "pattern": "(a{900}){900}"}, "steps"),
        ({"type": "object", "patternProperties": {f"{c}{{1000}}": {} for c in "abcdefghijklmnopq"}}, "steps"), ({"type": "object", "$id": "x"}, "$id"), ({"type": "object", "minLength": -1}, "minLength"), ({"type": "object", "type2": 1}, "type2"),
    ],
)
def test_schemas_that_cannot_be_held_are_refused(schema, why):
    with pytest.raises(E.Refused, match=why.replace("$", r"\$")):
        E.compile_schema(json.dumps(schema))


def test_schemas_that_end_are_taken():
    assert E.applied(dict(E.subschemas(chained(6))))[""] == 254 and E.compile_schema(json.dumps(chained(6)))
    tree = {"type": "object", "required": ["title"], "additionalProperties": False, "properties": {"title": {"type": "string"}, "first": {"$ref": "#"}, "sections": {"type": "array", "items": {"$ref": "#"}}}}
    own = E.compile_schema(json.dumps(tree))
    assert E.check('{"title":"1","first":{"title":"1.1"},"sections":[{"title":"1.1","sections":[{"title":"a"}]}]}', own) == []
    found = E.check('{"title":"1","sections":[{"title":"1.1","sections":[{"title":7},{"name":"x"}]}]}', own)
    assert {(f["pointer"], f["rule"]) for f in found} == {("/sections/0/sections/0/title", "type"), ("/sections/0/sections/1", "required"), ("/sections/0/sections/1/name", "additionalProperties")}


def test_patterns_take_linear_time():
    own = E.compile_schema(json.dumps({"type": "object", "properties": {"a": {"pattern": "^(a+)+$"}, "b": {"pattern": "^\\p{L}{2,}$"}}}))
    began = time.perf_counter()
    assert [f["pointer"] for f in E.check(json.dumps({"a": "a" * 5000 + "!", "b": "été"}), own)] == ["/a"]
    assert time.perf_counter() - began < 1


def test_findings_of_rows_that_are_no_json(spark):
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"$ref": "#/$defs/n"}}}, "$defs": {"n": {"type": "array", "items": {"$ref": "#/$defs/n"}}}}
    rows = [(1, None), (2, ""), (3, "{"), (4, '{"a": []}'), (5, '{"a": ' + "[" * 60 + "]" * 60 + "}"), (6, '{"a": ' + "[" * 900 + "]" * 900 + "}"), (7, '{"a": 3}')]
    found = spark.createDataFrame(rows, "id int, t string").select("id", E.findings(F.col("t"), schema)["rule"].alias("rules"))
    assert {r.id: r.rules for r in found.collect()} == {1: ["refused"], 2: ["refused"], 3: ["refused"], 4: [], 5: [], 6: ["refused"], 7: ["type"]}


def test_constrainable():
    closed = {"type": "object", "properties": {"a": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "l": {"items": {"$ref": "#/$defs/x"}}}, "additionalProperties": False, "$defs": {"x": {"enum": [1]}}}
    assert E.constrainable(closed) and E.constrainable({"type": "object", "default": {}, "examples": []})
    assert not any(map(E.constrainable, (True, closed | {"additionalProperties": True}, closed | {"minProperties": 1}, {"items": True}, {"anyOf": []}, {"$defs": {"x": {"minimum": 1}}})))


def test_parts_of_a_document_need_not_be_whole():
    schema = {"type": "object", "required": ["a"], "properties": {"l": {"minItems": 2}}}
    assert [f["rule"] for f in E.check('{"l": [1]}', schema)] == ["required", "minItems"] and E.check('{"l": [1]}', schema, part=True) == []


def test_schemas_are_refused():
    deep = {}
    for _ in range(40):
        deep = {"items": deep}
    for bad in ('{"foo": 1}', '{"$ref": "http://x"}', '{"$ref": "#/nowhere"}', "[]", json.dumps(deep), '{"pattern": "(a{1,1000}){1,1000}"}', '{"pattern": "("}', '{"description": "' + "x" * 70_000 + '"}'):
        with pytest.raises(E.Refused):
            E.compile_schema(bad)
    assert E.check("{", {})[0]["rule"] == "refused" and E.check("1e999", {})[0]["rule"] == "refused" and E.check("1e-999", {})[0]["rule"] == "refused" and E.check("[" * 100 + "]" * 100, {})[0]["rule"] == "refused"
    assert E.constrainable({"type": "object", "properties": {"a": {"type": "string"}}, "additionalProperties": False}) and not E.constrainable({"type": "string", "minLength": 2})
    closed = E.strict({"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "integer"}}, "required": ["a"]})
    assert closed["required"] == ["a", "b"] and closed["additionalProperties"] is False
    assert E.without_nulls({"a": "x", "b": None}, {"properties": {"a": {"type": "string"}, "b": {"type": "integer"}}}) == {"a": "x"}


def test_truncated_replies():
    assert N.completed_reply('{"blocks": [{"t": "a]"}, {"t": "b\\"}"}, {"t": "c') == '{"blocks": [{"t": "a]"}, {"t": "b\\"}"}]}'
    assert N.completed_reply("no list") is None and N.completed_reply('[{"t": "cut') is None and N.completed_reply("[[1]") == "[[1]]"


def test_words_in_cells_of_odd_pages(spark):
    """Repeated, wide, empty, endless and null cells; words on edges, outside, without a place or a page: as by looking at each pair."""
    import math
    import random

    rng = random.Random(3)
    inf = math.inf
    cells = [(p, n, x, x + rng.choice([0.5, 3.0, 40.0]), y, y + 5.0) for n in range(60) for p, x, y in [(rng.randint(0, 2), rng.uniform(-50, 50), rng.choice([0.0, 3.0]))]]
    cells += [(0, 100 + n, 0.0, 7.0, 0.0, 9.0) for n in range(1500)] + [(1, 90, 5.0, 5.0, 0.0, 9.0), (1, 91, 9.0, 5.0, 0.0, 9.0), (1, None, -9.0, 9.0, 0.0, 9.0), (2, 93, None, 9.0, 0.0, 9.0), (None, 94, 0.0, 9.0, 0.0, 9.0)]
    words = [(p, n, x, x + 1.0, y, y) for n in range(80) for p, x, y in [(rng.randint(0, 3), float(rng.randint(-60, 60)), rng.choice([0.0, 4.0, 20.0]))]]
    words += [(0, 80, -0.5, 0.5, 0.0, 0.0), (0, 81, 6.5, 7.5, 0.0, 0.0), (1, 82, None, 1.0, 0.0, 0.0), (None, 83, 0.0, 1.0, 0.0, 0.0), (0, 84, 0.0, 1.0, 1.0, 1.0), (0, 84, 0.0, 1.0, 1.0, 1.0), (1, 85, 1e300, 1e300, 0.0, 0.0)]
    for more in ([], [(0, 95, -inf, 3.0, 0.0, 9.0), (1, 96, 2.0, inf, -inf, inf)], None):
        own = [] if more is None else cells + more
        want = []
        for w in words:
            x, y = ((w[2] + w[3]) / 2, (w[4] + w[5]) / 2) if w[2] is not None else (None, None)
            held = [c for c in own if x is not None and None not in (w[0], c[2]) and w[0] == c[0] and c[2] <= x < c[3] and c[4] <= y < c[5]]
            want += [(*w, *c[1:], w[2] < c[2] - LY.SNAP or w[3] > c[3] + LY.SNAP) for c in held] or [(*w, *[None] * 6)]
        got = LY.words_in_cells(spark.createDataFrame(words, "page long, word_id int, x0 double, x1 double, y0 double, y1 double"), spark.createDataFrame(own, "page int, cell long, cx0 double, cx1 double, cy0 double, cy1 double"))
        assert got.columns == ["page", "word_id", "x0", "x1", "y0", "y1", "cell", "cx0", "cx1", "cy0", "cy1", "straddles"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_words_meet_only_cells_near_them(spark):
    """500,000 words and as many cells on one page, side by side: 250,000,000,000 pairs, 500,000 of them near."""
    n, began = F.col("id"), time.monotonic()
    side = [F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1")]
    words = spark.range(500_000).select(F.lit(1).alias("page"), n.alias("word_id"), (n + 0.25).cast("double").alias("x0"), (n + 0.75).cast("double").alias("x1"), *side)
    cells = spark.range(500_000).select(F.lit(1).alias("page"), n.alias("cell"), n.cast("double").alias("cx0"), (n + 1.0).alias("cx1"), F.lit(-1.0).alias("cy0"), F.lit(1.0).alias("cy1"))
    got = LY.words_in_cells(words, cells)
    assert got.agg(F.count("cell"), F.count_if(F.col("cell") == F.col("word_id"))).first() == (500_000, 500_000) and time.monotonic() - began < 40


def test_words_of_many_cells_take_little_room(spark, tmp_path):
    """500 words, each in 7,800 to 7,960 of 16,000 cells: 3,940,000 rows, written in less than 0.25 bytes each."""
    n = F.col("id")
    words = spark.range(500).select(F.lit(1).alias("page"), n.alias("word_id"), (20.0 + n % 5 / 10).alias("x0"), (20.0 + n % 5 / 10).alias("x1"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"))
    cells = spark.range(16_000).select(F.lit(1).alias("page"), (n * 7919 % 16_001).alias("cell"), (n % 400 / 10 + 0.55).alias("cx0"), (n % 400 / 10 + 20.55).alias("cx1"), F.lit(-1.0).alias("cy0"), F.lit(1.0).alias("cy1"))
    LY.words_in_cells(words, cells).select("word_id", "cell").write.parquet(str(tmp_path / "rows"))
    got = spark.read.parquet(str(tmp_path / "rows"))
    assert dict(got.distinct().groupBy("word_id").count().collect()) == {w: 7800 + w % 5 * 40 for w in range(500)} and got.count() == 3_940_000
    assert sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")) < 0.25 * 3_940_000


# --- scheduling ----------------------------------------------------------------------------------------------------


def test_windows_are_the_simulation(spark):
    import random

    rng = random.Random(9)
    jobs = [{"arrival": 0, "class": rng.randint(0, 1), "group_id": rng.randint(0, 2), "project_id": rng.randint(0, 1), "cost": rng.choice([1, 5]), "priority": 0} for _ in range(120)]
    for j in jobs:
        j |= {"class_weight": I.CLASS_WEIGHTS[j["class"]], "group_weight": 1 + j["group_id"], "project_weight": 1 + 2 * j["project_id"]}
    rows = spark.createDataFrame([{"task_key": i, **j} for i, j in enumerate(jobs)])
    got = [r.task_key for r in I.dispatch_order(rows, ["task_key"]).orderBy("seq").collect()]
    assert got == [d["job"] for d in I.simulate(jobs)]


def test_backlogged_groups_share_by_weight():
    jobs = [{"arrival": 0, "class": 0, "group_id": g, "project_id": 0, "cost": 1, "priority": 0, "class_weight": 4, "group_weight": w, "project_weight": 1} for g, w in enumerate((1, 2, 4)) for _ in range(500)]
    first = [jobs[d["job"]]["group_id"] for _, d in zip(range(700), I.simulate(jobs), strict=False)]
    assert all(abs(first.count(g) - n) <= 1 for g, n in ((0, 100), (1, 200), (2, 400)))


def test_a_full_group_is_passed_over():
    jobs = [{"arrival": 0, "class": 0, "group_id": g, "project_id": 0, "cost": 1, "priority": 0, "class_weight": 4, "group_weight": 1, "project_weight": 1} for g in (0, 0, 0, 1)]
    got = [(jobs[d["job"]]["group_id"], d["at"]) for d in I.simulate(jobs, slots=3, hold=2, max_running=1)]
    assert got == [(0, 0), (1, 0), (0, 2), (0, 4)]


def test_arrivals_by_sorts_are_the_simulation(spark):
    """Queues whose jobs come early, late, in between or all at once, in one slot or more: the whole fold's order and times."""
    import random

    rng = random.Random(4)
    queues = {}
    for q, spread in ((0, 0), (1, 9), (None, 60), (3, 400), (4, 3)):
        jobs = [{"arrival": rng.randint(-1, spread), "class": rng.randint(0, 1), "group_id": rng.randint(0, 3), "project_id": rng.randint(0, 2), "cost": rng.choice([0, 1, 1, 5]), "priority": rng.randint(1, 3)} for _ in range(3 if q == 4 else 150)]
        jobs.sort(key=lambda j: j["arrival"])
        for i, j in enumerate(jobs):
            j |= {"queue": q, "task_key": i, "class_weight": I.CLASS_WEIGHTS[j["class"]], "group_weight": 1 + j["group_id"], "project_weight": 1 + rng.randint(0, 2)}
        queues[q] = jobs
    rows = spark.createDataFrame([j for own in queues.values() for j in own])
    for slots, hold, full in ((1, 1, None), (3, 2, None), (4, 7, None), (2, 5, 1)):
        got = I.dispatch_arrivals(rows, ["queue"], slots, hold, full)
        assert got.columns == ["queue", "task_key", "seq", "at"]
        found = {}
        for r in got.orderBy("seq").collect():
            found.setdefault(r.queue, []).append((r.seq, r.task_key, r.at))
        assert found == {q: [(n, d["job"], d["at"]) for n, d in enumerate(I.simulate(jobs, slots, hold, full), 1)] for q, jobs in queues.items()}
    assert I.dispatch_arrivals(rows.where("false"), ["queue"]).count() == 0


def test_no_fold_holds_a_backlog(spark, monkeypatch):
    """30,000 jobs of two groups, the last of them come at 4: four have a turn until then, so few go through the fold."""
    held, turns = [], I._turns
    monkeypatch.setattr(I, "_turns", lambda rows, *a: held.append(rows.count()) or turns(rows, *a))
    n = F.col("id")
    same = [F.lit(1).alias(c) for c in ("queue", "class", "project_id", "priority", "cost", "class_weight", "group_weight", "project_weight")]
    got = I.dispatch_arrivals(spark.range(30_000).select(*same, (n % 2).alias("group_id"), (n % 5).alias("arrival"), n.alias("task_key")), ["queue"])
    assert got.agg(F.count_distinct("seq"), F.count_distinct("task_key"), F.max("seq"), F.max("at")).first() == (30_000, 30_000, 30_000, 29_999)
    assert held == [2 * 5 * 4]


def test_capacity(spark):
    events = spark.createDataFrame([("a", 10, 5, 3, 16), ("a", 11, 6, 9, 16), ("a", 30, 25, 1, 16)], "scope string, at long, leased_at long, wait long, most long")
    assert sorted(tuple(r) for r in J.limited(events).collect()) == [("a", 10, 8, 13), ("a", 11, 8, 20), ("a", 30, 4, 31)]
    health = spark.createDataFrame([(1, t, leased, h) for t, leased, h in ((1, 0, "failure"), (2, 0, "failure"), (3, 0, None), (4, 0, "failure"), (5, 3, "failure"), (6, 5, "failure"), (7, 6, "success"))], "reader_id long, at long, leased_at long, health string")
    assert [(r.failures, r.opened_at) for r in J.breaker(health).orderBy("at").collect()] == [(1, None), (2, None), (2, None), (3, 4), (4, 4), (5, 6), (0, None)]


def test_submissions(spark):
    rows = [(1, s, p, k, n, d) for s, (p, k, n, d) in enumerate([(10, True, 4, 1), (10, True, 4, 1), (11, False, 1, 1), (12, True, 9, 1), (13, True, 6, 1), (14, True, 1, 2), (15, True, 1, 2)])]
    df = spark.createDataFrame(rows, "group_id long, seq long, parse_id long, file_known boolean, pages long, day long")
    got = [(r.parse_id, r.outcome) for r in K.submitted(df, 3, 10).collect()]
    assert got == [(10, "created"), (10, "exists"), (11, "file_not_found"), (12, "budget_exhausted"), (13, "created"), (14, "created"), (15, "queue_full")]


def test_filters_meet():
    assert K.merged_filter(["a", "b"], ["b"], {"x": "1"}, {"y": "2"}) == (["b"], {"x": "1", "y": "2"})
    assert K.merged_filter(["a"], ["b"], {}, {}) is None and K.merged_filter(None, None, {"x": "1"}, {"x": "2"}) is None and K.merged_filter(None, ["a"], {}, {}) == (["a"], {})


# --- layout --------------------------------------------------------------------------------------------------------


def words_at(lines, size=10.0, bold=False):
    out = []
    for x, y, text in lines:
        for w in text.split():
            out.append(LY.Word(w, x, y - size, x + 5 * len(w), y, y, size, bold))
            x += 5 * len(w) + 5
    return out


def test_columns_are_read_left_to_right():
    body = "several words of plain prose here"
    left, right = [(50, 100 + 12 * i, f"left{i} {body}") for i in range(6)], [(300, 100 + 12 * i, f"right{i} {body}") for i in range(6)]
    text = " ".join(b.text for b in LY.read_page(words_at(left + right)))
    assert text.index("left5") < text.index("right0")
    single = LY.read_page(words_at([(50, 100, "Name"), (300, 100, "Value")]))
    assert [b.text for b in single] == ["Name", "Value"] or [b.text for b in single] == ["Name Value"]


def test_paragraphs_headings_and_lists():
    page = words_at([(50, 50, "A Large Title")], 20.0) + words_at([(50, 90, "1. first item of a"), (62, 102, "list that goes on"), (50, 114, "2. second item"), (50, 150, "A paragraph with hyphen-"), (50, 162, "ation and more words")])
    assert [(b.kind, b.text) for b in LY.read_page(page)] == [("title", "A Large Title"), ("list_item", "1. first item of a list that goes on"), ("list_item", "2. second item"), ("text", "A paragraph with hyphen-ation and more words")]
    assert LY.join_lines(["soft­", "ened", "-", "x"]) == "softened - x"


def test_side_by_side_text_that_is_no_prose_is_declined():
    rows = [(50, 100 + 12 * i, "label") for i in range(6)] + [(300, 100 + 12 * i, "9") for i in range(6)]
    with pytest.raises(LY.Declined, match="side by side"):
        LY.read_page(words_at(rows))
    body = "several words of plain prose here"
    columns = [(50, 100 + 12 * i, f"l{i} {body}") for i in range(6)] + [(300, 100 + 12 * i, f"r{i} {body}") for i in range(6)]
    # The line under the left column may belong to either column.
    with pytest.raises(LY.Declined, match="under them"):
        LY.read_page(words_at([*columns, (50, 230, f"stray {body}")]))
    assert LY.read_page(words_at([*columns, (50, 172, f"next {body}")]))[0].text.endswith(f"next {body}")
    heading = LY.read_page(words_at([(50, 60, "one long line above both of the columns that spans all of the page from left to right"), *columns, (50, 220, "and a line below them that spans all of the page, from its left edge to its right")]))
    assert [b.text.split()[0] for b in heading] == ["one", "l0", "r0", "and"]


def test_three_columns_are_read_in_turn():
    body = "some words of prose in it"
    rows = [(50 + 200 * c, 100 + 12 * i, f"c{c}l{i} {body}") for c in range(3) for i in range(5)]
    text = " ".join(b.text for b in LY.read_page(words_at(rows)))
    assert [text.index(f"c{c}l{i}") for c in range(3) for i in range(5)] == sorted(text.index(f"c{c}l{i}") for c in range(3) for i in range(5))


def test_tables_figures_and_bullets_stand_in_the_order():
    body = "a line of prose that fills the width of this page"
    words = words_at([(50, 100, body), (50, 112, body)]) + words_at([(60, 170, "Name"), (160, 170, "Age")], bold=True) + words_at([(60, 190, "Ann of the hill"), (160, 190, "7")]) + words_at([(50, 260, "first item"), (50, 272, "second item")])
    words += words_at([(320, 400, "axis")]) + words_at([(50, 600, "the end of it")])
    rules = [(50, y, 250, y + 1) for y in (155, 176, 196)] + [(x, 155, x + 1, 197) for x in (50, 150, 249)]
    drawings = [(40, 252, 44, 256), (40, 264, 44, 268), (300, 350, 400, 420), (410, 360, 430, 400), (0, 0, 600, 800)]
    page = LY.Page.of(words)
    found = [(b.kind, b.text, len(b.lines)) for b in LY.page_of(page, *LY.drawn(page, rules, drawings, 600.0, 800.0))]
    assert found == [("text", f"{body} {body}", 2), ("table", "Name | Age\nAnn of the hill | 7", 2), ("list_item", "first item", 1), ("list_item", "second item", 1), ("figure", "axis", 1), ("text", "the end of it", 1)]
    over = words_at([(120, 170, "over the line")])
    for own, more, why in (([*words, *over], drawings, "over the ruling"), (words, [(0, 300, 500, 790)], "mostly drawing"), (words, [(45, 180, 120, 230)], "over a table"), (words_at([(300, 400, "w" * 30)]), [(300, 389, 460, 405)], "more text")):
        page = LY.Page.of(own)
        with pytest.raises(LY.Declined, match=why):
            LY.drawn(page, rules, more, 600.0, 800.0)
    with pytest.raises(LY.Declined, match="close"):
        LY.drawn(LY.Page.of(words), rules[:-1] + [(249, 155, 250, 165)], [], 600.0, 800.0)
    # Underlines and separators are no table; a line that parts nothing is no row.
    assert LY.drawn(LY.Page.of(words), [(50, 114, 250, 115)], [], 600.0, 800.0)[0] == []
    assert LY.lattice([(0, y, 90, y + 1) for y in (0, 20, 40)] + [(x, 0, x + 1, 41) for x in (0, 90)] + [(45, 38, 46, 41)]) == [(0, 0, 1, 1), (1, 0, 1, 1)]


def test_pages_with_rules_and_drawings(spark):
    schema = "page long, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double, bold boolean"
    words = [(p, w.text, *map(float, (w.x0, w.y0, w.x1, w.y1, w.baseline, w.size)), w.bold) for p in (1, 2) for w in words_at([(60, 170, "Name"), (160, 170, "Age"), (60, 190, "Ann"), (160, 190, "7")])]
    rules = [(1, *map(float, r)) for r in [(50, y, 250, y + 1) for y in (155, 176, 196)] + [(x, 155, x + 1, 197) for x in (50, 150, 249)]] + [(1, None, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 9.0, 1.0)]
    boxes = spark.createDataFrame(rules, "page long, x0 double, y0 double, x1 double, y1 double")
    found = LY.page_blocks(spark.createDataFrame(words, schema), boxes, boxes.where("false"), (600.0, 800.0)).collect()
    assert [(r.kind, r.text) for r in found if r.page == 1] == [("table", "Name | Age\nAnn | 7")] and {r.page for r in found} == {1, 2}
    # Without its rules the same page is text side by side that is no prose.
    assert [(r.ord, "side by side" in r.declined) for r in found if r.page == 2] == [(0, True)]
    with pytest.raises(ValueError, match="size"):
        LY.page_blocks(spark.createDataFrame(words, schema), boxes)


def test_large_pages_take_little_time():
    prose = [LY.Word("words", 50 + 250 * c + 30 * k, 12.0 * i, 75 + 250 * c + 30 * k, 12.0 * i + 10, 12.0 * i + 10, 10.0) for i in range(800) for c in range(2) for k in range(5)]
    cells = [LY.Word("w", 50 + 60 * (i % 40), 12.0 * (i // 40), 60 + 60 * (i % 40), 12.0 * (i // 40) + 10, 12.0 * (i // 40) + 10, 10.0) for i in range(8000)]
    began = time.perf_counter()
    assert len(LY.read_page(prose)) == 2
    with pytest.raises(LY.Declined):
        LY.read_page(cells)
    assert time.perf_counter() - began < 2


def test_pages_of_odd_words(spark):
    schema = "page long, text string, x0 double, y0 double, x1 double, y1 double, baseline double, size double, bold boolean"
    rows = [(1, None, 0.0, 0.0, 5.0, 10.0, 10.0, 10.0, False), (2, "a", None, 0.0, 5.0, 10.0, 10.0, 10.0, False), (3, "a", 0.0, 0.0, 5.0, 10.0, 10.0, 10.0, None), (3, "a", 0.0, 0.0, 5.0, 10.0, 10.0, 10.0, None)]
    rows += [(4, w.text, *map(float, (w.x0, w.y0, w.x1, w.y1, w.baseline, w.size)), w.bold) for w in words_at([(50, 100 + 12 * i, "label") for i in range(6)] + [(300, 100 + 12 * i, "9") for i in range(6)])]
    found = {r.page: (r.ord, r.kind, r.text, r.lines, r.declined) for r in LY.page_blocks(spark.createDataFrame(rows, schema)).collect()}
    assert found[3] == (1, "text", "a a", 1, None) and found[4][:4] == (0, None, None, 0) and "side by side" in found[4][4] and set(found) == {3, 4}
    assert LY.page_blocks(spark.createDataFrame([], schema)).count() == 0


def test_text_gate(spark):
    word = "qwrtz"
    cases = {"usable": "plain words of a text", "not_letters": "a 1 --- === ...", "not_words": " ".join([word] * 20), "decoded_twice": "cafÃ© and thÃ© again", "unmapped": "a b\ufffdc"}
    df = spark.createDataFrame([*cases.items(), ("none", None), ("blank", " \n ")], "id string, text string")
    assert {r.id: r.answer for r in LY.usable_texts(df, "id", "text").collect()} == {k: k for k in cases}
    words = spark.createDataFrame([(k, w, False, k == "turned") for k, t in [*cases.items(), ("turned", "a")] for w in t.split()] + [("usable", "\ufffd", True, True), ("usable", None, False, False), ("usable", "\ue000", False, False)], "id string, text string, hidden boolean, turned boolean")
    assert {r.id: r.answer for r in LY.usable_gate(words, "id").collect()} == {k: k for k in (*cases, "turned")}
    one = LY.usable_texts(spark.createDataFrame([(1, "Don't (stop) XYZZ bcdfg it's a1 ab, \ue000x")], "id int, text string"), "id", "text").first()
    assert (one.words, one.chars, one.letters, one.plain, one.vowelless, one.answer) == (8, 31, 25, 2, 1, "unmapped")


def test_ruled_tables():
    across = [(0, y, 90, y + 1) for y in (0, 20, 40)]
    down = [(x, 0, x + 1, 41) for x in (0, 30, 60, 90)]
    assert LY.lattice(across + down) == [(r, c, 1, 1) for r in range(2) for c in range(3)]
    merged = across + [(x, 0, x + 1, 41) for x in (0, 90)] + [(30, 20, 31, 41), (60, 20, 61, 41)]
    assert LY.lattice(merged) == [(0, 0, 1, 3), (1, 0, 1, 1), (1, 1, 1, 1), (1, 2, 1, 1)]
    assert LY.lattice([(0, 0, 90, 1)]) is None
    assert sorted(map(sorted, LY.ruling_groups([(0, 0, 10, 1), (10, 0, 11, 10), (50, 50, 60, 51)]))) == [[0, 1], [2]]
    assert glyphs.rectangle([(0, 0), (5, 0), (5, 3), (0, 3)]) == (0, 0, 5, 3) and glyphs.rectangle([(0, 0), (5, 1), (5, 3), (0, 3)]) is None


def test_glyphs_become_words():
    row = lambda c, x, y=0.0: {"char": c, "x": x, "y": y, "width": 5.0, "size": 10.0}
    got = [w["text"] for w in glyphs.words([row("a", 0), row("b", 5), row(" ", 10), row("c", 15), row("d", 40), row("e", 45, 30.0)])]
    assert got == ["ab", "c", "d", "e"]


def test_sinks(spark, tmp_path):
    rows = spark.range(200).selectExpr("id % 20 as parse_id", "cast(id div 20 as int) as page", "1 as ord", "concat('t', id) as text")
    sinks.write_blocks(rows, f"{tmp_path}/b", buckets=8)
    assert sinks.read_blocks(spark, f"{tmp_path}/b").count() == 200
    one = sinks.read_blocks(spark, f"{tmp_path}/b", 7, buckets=8)
    assert one.count() == 10 and "bucket" in one._jdf.queryExecution().optimizedPlan().toString()
    sinks.write_ndjson(rows, f"{tmp_path}/n")
    assert len(spark.read.text(f"{tmp_path}/n").collect()) == 200
