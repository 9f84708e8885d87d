"""Queries over sources: detection, selections, text formats, office formats' values, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import views as V
from docspark.plans.entry import Entries
from docspark.session import prepare, table
from docspark.sources import detect as D
from docspark.sources import office as O
from docspark.sources import select as S
from docspark.sources import texts as T
from docspark.sources.html import table_from_html

ENTRIES = Entries()

_NAMES = "['a.pdf', 'b.TXT', 'c.md', 'd.html', 'e', 'f.csv', 'g.xls', 'h.docx', 'dir.x/i.jpeg', 'j.unknown']"
_MIMES = "['text/plain; charset=utf-8', 'application/xml', 'IMAGE/JPG', 'text/rtf', '', 'application/word', 'application/octet-stream']"


def _pick(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int") + 1)


NAMES = ("a.pdf", "b.TXT", "c.md", "d.html", "e", "f.csv", "g.xls", "h.docx", "dir.x/i.jpeg", "j.unknown")
MIMES = ("text/plain; charset=utf-8", "application/xml", "IMAGE/JPG", "text/rtf", "", "application/word", "application/octet-stream")


@ENTRIES.add(f"WITH m AS (SELECT event_id, {_MIMES}[event_id % 7 + 1] AS m FROM events), c AS (SELECT event_id, CASE lower(trim(split_part(m, ';', 1))) WHEN 'application/xml' THEN 'text/xml' WHEN 'image/jpg' THEN 'image/jpeg' WHEN 'text/rtf' THEN 'application/rtf' WHEN 'application/word' THEN 'application/msword' ELSE lower(trim(split_part(m, ';', 1))) END AS mime FROM m) SELECT event_id, mime, CASE mime WHEN 'text/plain' THEN 'native_text' WHEN 'image/jpeg' THEN 'reader' WHEN 'application/rtf' THEN 'convert_to_pdf' WHEN 'application/msword' THEN 'convert_doc_to_docx' END AS route FROM c")
def mime_route(spark, sf_dir):
    mime = _pick(MIMES, F.col("event_id"))
    return table(prepare(spark), sf_dir, "events").select("event_id", D.canonical(mime).alias("mime"), D.route(mime).alias("route"))


@ENTRIES.add(f"""WITH n AS (SELECT page_id, {_NAMES}[page_id % 10 + 1] AS name FROM pages) SELECT page_id, NULL AS mime, 'unsupported_media_type' AS code FROM n""".replace("NULL AS mime", "CAST(NULL AS VARCHAR) AS mime"))
def detect_html(spark, sf_dir):
    own = table(prepare(spark), sf_dir, "pages").select("page_id", F.substring(F.col("html").cast("binary"), 1, 8192).alias("head"), _pick(NAMES, F.col("page_id")).alias("name"))
    return own.select("page_id", D.detected(F.col("head"), F.col("name"), F.lit("")).alias("d")).select("page_id", "d.*")


@ENTRIES.add(f"""WITH n AS (SELECT doc_id, {_NAMES}[doc_id % 10 + 1] AS name, strlen(text) < 4 AS tiny FROM documents) SELECT doc_id, CASE WHEN name = 'b.TXT' THEN 'text/plain' WHEN name = 'c.md' THEN 'text/markdown' WHEN name = 'f.csv' THEN 'text/csv' WHEN name IN ('d.html') THEN NULL
    WHEN tiny THEN CASE name WHEN 'a.pdf' THEN 'application/pdf' WHEN 'h.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'dir.x/i.jpeg' THEN 'image/jpeg' END ELSE 'text/plain' END AS mime FROM n""")
def detect_text(spark, sf_dir):
    own = table(prepare(spark), sf_dir, "documents").select("doc_id", F.substring(F.col("text").cast("binary"), 1, 8192).alias("head"), _pick(NAMES, F.col("doc_id")).alias("name"))
    return own.select("doc_id", D.detected(F.col("head"), F.col("name"), F.lit("application/octet-stream"))["mime"].alias("mime"))


HEADS = {
    "255044462D312E37": D.PDF, "89504E470D0A1A0A00": D.PNG, "FFD8FFE000104A": D.JPEG, "49492A0008000000": D.TIFF, "4D4D002A00000008": D.TIFF, "7B5C727466312063": D.RTF,
    "504B030414" + b"word/document.xml".hex(): D.DOCX, "504B030414" + b"xl/workbook.xml xl/vbaProject.bin".hex(): D.XLSM, "504B030414" + b"xl/worksheets/a".hex(): D.XLSX, "504B030414" + b"ppt/slides/x".hex(): D.PPTX,
    "504B030414" + b"Index/Document.iwa".hex(): D.KEYNOTE, "504B030414" + f"mimetype{D.ODT}PK\x03\x04".encode().hex(): D.ODT, "504B030414" + f"mimetype{D.ODT}-templatePK\x03\x04".encode().hex(): D.OCTET,
    "30820102" + "06092A864886F70D010702A0": D.P7M, b"  <?xml version='1.0'?>".hex(): D.XML, b"\n<!DOCTYPE HTML>".hex(): D.HTML, b"just words".hex(): D.TXT, "0001020304": None, "FFD8": None,
}


@ENTRIES.add("SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if m is None else repr(m)})" for i, m in enumerate(HEADS.values())) + ") t(n, mime)")
def content_sniff(spark, sf_dir):
    rows = prepare(spark).createDataFrame([(i, bytearray.fromhex(h)) for i, h in enumerate(HEADS)], "n int, head binary")
    return rows.select("n", D.sniffed(F.col("head")).alias("mime"))


EXPRESSIONS = ("", "1-3,7", "3,1-2,2", " 2 , 4 - 5 ", "1-100", "2,99", "5-", "2,9-", "50-60", "5-1", "abc", "3-x", "-", "-3", "3--", "1,,3", "1,", "0", "0-3")
_SELECT = {"": "1..n", "1-3,7": "1,2,3,7", "3,1-2,2": "1,2,3", " 2 , 4 - 5 ": "2,4,5", "1-100": "1..n", "2,99": "2", "5-": "5..n", "2,9-": "2,9..n", "50-60": "50..60"}


def _wanted(expr: str, total: int) -> str | None:
    """What the cases say, for the SQL twin: a list of numbers and ranges cut at the total."""
    said = _SELECT.get(expr)
    if said is None or total <= 0:
        return None
    out = []
    for part in said.split(","):
        a, _, z = part.partition("..")
        out += range(int(a), (total if z in ("n", "") and z else int(z or a)) + 1)
    kept = [x for x in out if x <= total]
    return ",".join(map(str, kept)) or None


@ENTRIES.add("SELECT e.n AS n, t.range AS total, w.pages, CASE WHEN w.pages IS NULL THEN 'invalid_pages' END AS code FROM range(13) t, range(19) e(n) LEFT JOIN (VALUES " + ", ".join(f"({i}, {t}, '{w}')" for i, e in enumerate(EXPRESSIONS) for t in range(13) if (w := _wanted(e, t))) + ") w(n, total, pages) ON w.n = e.n AND w.total = t.range")
def page_select(spark, sf_dir):
    rows = prepare(spark).createDataFrame([(i, t, e) for i, e in enumerate(EXPRESSIONS) for t in range(13)], "n long, total long, expr string")
    chosen = S.selected(F.col("expr"), F.col("total"))
    return rows.select("n", "total", F.array_join(chosen["pages"].cast("array<string>"), ",").alias("pages"), chosen["code"].alias("code"))


@ENTRIES.add("SELECT n, e IN ('', '1-3,7', '3,1-2,2', ' 2 , 4 - 5 ', '1-100', '2,99', '5-', '2,9-', '50-60') AS ok FROM (VALUES " + ", ".join(f"({i}, '{e}')" for i, e in enumerate(EXPRESSIONS)) + ") t(n, e)")
def page_select_check(spark, sf_dir):
    rows = prepare(spark).createDataFrame(list(enumerate(EXPRESSIONS)), "n int, expr string")
    return rows.select("n", S.well_formed(F.col("expr")).alias("ok"))


@ENTRIES.add("SELECT o_orderkey AS file_id, CASE WHEN o_totalprice * 1000 > 268435456 THEN 'file_too_large' WHEN o_custkey * 3 > 3000 THEN 'too_many_pages' END AS code FROM orders")
def source_limits(spark, sf_dir):
    return table(prepare(spark), sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), S.limits(F.col("o_custkey") * 3, F.col("o_totalprice") * 1000).alias("code"))


@ENTRIES.add(r"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(regexp_replace(text, '\. ', '.' || chr(13) || chr(10) || chr(13) || chr(10), 'g'), chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda x: regexp_replace(x, '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS parts FROM documents) SELECT doc_id, CAST(generate_subscripts(parts, 1) AS INT) AS ord, 'text' AS kind, unnest(parts) AS text FROM p")
def paragraphs_plain(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\. ", ".\r\n\r\n").alias("text"))
    return T.plain(docs, "doc_id", "text")


@ENTRIES.add()
def markdown_blocks(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, F.concat(F.lit("# "), x)).when(i % 5 == 1, F.concat(F.lit("- "), x)).when(i % 5 == 2, F.concat(F.lit("```\n"), x, F.lit("\n```"))).when(i % 5 == 3, F.concat(F.lit("## "), x, F.lit(" ##"))).otherwise(F.concat(F.lit("\n"), x, F.lit("\n"))))
    return T.markdown(d.select("doc_id", F.array_join(lines, "\n").alias("md")), "doc_id", "md")


@ENTRIES.add("SELECT n_nationkey AS id, 0 AS row, 0 AS col, CAST(n_nationkey AS VARCHAR) AS text FROM nation UNION ALL SELECT n_nationkey, 0, 1, 'say \"' || n_name || '\", twice' FROM nation UNION ALL SELECT n_nationkey, 1, 0, '' FROM nation")
def delimited_cells(spark, sf_dir):
    n = table(prepare(spark), sf_dir, "nation")
    text = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"say ""'), F.col("n_name"), F.lit('"", twice"\r\n\r\n""\n'))
    return T.cells(T.delimited(n.select(F.col("n_nationkey").alias("id"), text.alias("csv")), "id", "csv"), "id").select("id", "row", "col", "text")


@ENTRIES.add("SELECT n_nationkey AS id, 4 AS rows, 3 AS cols, 'Head' || chr(10) || 'x^2 a b' || chr(10) || 'c | d' || chr(10) || n_name AS text FROM nation")
def html_tables(spark, sf_dir):
    n = table(prepare(spark), sf_dir, "nation")
    markup = F.concat(F.lit("<table><tr><th colspan=3>Head<tr><td rowspan=2>x<sup>2</sup> a<br>b</td></tr><tr><td>c<td>d</td></tr><tr><td>"), F.col("n_name"), F.lit("</td></tr></table>"))
    t = table_from_html(markup)
    return n.select(F.col("n_nationkey").alias("id"), t.alias("t")).select("id", "t.rows", "t.cols", V.table_text(F.col("t.cells")).alias("text"))


@ENTRIES.add("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS INT) AS size FROM documents")
def content_digest(spark, sf_dir):
    return T.files(table(prepare(spark), sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id")


@ENTRIES.add("SELECT source AS owner, sha256(text) AS sha256, min(doc_id) AS file_id, max(doc_id + 30) AS kept_until, count(*) AS uploads FROM documents GROUP BY 1, 2")
def content_dedup(spark, sf_dir):
    d = table(prepare(spark), sf_dir, "documents")
    files = d.select(F.col("source").alias("owner"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").alias("file_id"), F.col("doc_id").alias("created"), (F.col("doc_id") + 30).alias("kept_until"))
    return T.distinct_files(files)


# --- values of office formats ----------------------------------------------------------------------------------------


@ENTRIES.add("""WITH v AS (SELECT o_orderkey AS id, CAST(o_orderkey % 60000 AS BIGINT) AS days, o_custkey % 1440 AS minutes FROM orders), d AS (SELECT *, CASE WHEN days = 60 THEN '1900-02-29' WHEN days < 60 THEN strftime(DATE '1899-12-31' + CAST(days AS INT), '%Y-%m-%d') ELSE strftime(DATE '1899-12-30' + CAST(days AS INT), '%Y-%m-%d') END AS day FROM v)
  SELECT id, day || 'T' || lpad(CAST(minutes // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(minutes % 60 AS VARCHAR), 2, '0') AS moment FROM d""")
def serial_dates(spark, sf_dir):
    o = table(prepare(spark), sf_dir, "orders")
    value = (F.col("o_orderkey") % 60000) + (F.col("o_custkey") % 1440) / 1440.0
    return o.select(F.col("o_orderkey").alias("id"), O.moment(value, date=True, clock=True).alias("moment"))


CODES = {"mm:ss": "clock,seconds", "mmmm": "date", "[h]:mm:ss": "clock,seconds,elapsed", '"hours" 0': "", "0.0%": "percent", "yyyy\\-mm\\-dd hh:mm": "date,clock", "h AM/PM": "clock", "m/d/yy;@": "date", "0;[s]": "", "[Red]0": ""}


@ENTRIES.add("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(CODES.values())) + ") t(n, flags)")
def number_formats(spark, sf_dir):
    rows = prepare(spark).createDataFrame(list(enumerate(CODES)), "n int, code string")
    return rows.select("n", O.format_flags(F.col("code")).alias("flags"))


VALUES = {("2.2999999999999998", ""): "2.3", ("1E+3", ""): "1000", ("1.5E+300", ""): "1.5e+300", ("2.5E-9", ""): "2.5e-09", ("0.07", "percent"): "7%", ("abc", ""): "abc", ("1e21", ""): "1e+21", ("-0.5", ""): "-0.5", ("100000000000000000000", ""): "100000000000000000000"}


@ENTRIES.add("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(VALUES.values())) + ") t(n, shown)")
def shortest_numbers(spark, sf_dir):
    rows = prepare(spark).createDataFrame([(i, v, f) for i, (v, f) in enumerate(VALUES)], "n int, raw string, flags string")
    return rows.select("n", O.shown_numbers(F.col("raw"), F.col("flags")).alias("shown"))


@ENTRIES.add("""WITH k AS (SELECT p_partkey AS id, p_partkey % 16384 AS k, p_size FROM part) SELECT id, CASE WHEN k < 26 THEN chr(CAST(65 + k AS INT)) WHEN k < 702 THEN chr(CAST(64 + k // 26 AS INT)) || chr(CAST(65 + k % 26 AS INT))
    ELSE chr(CAST(64 + (k - 26) // 676 AS INT)) || chr(CAST(65 + (k - 26) // 26 % 26 AS INT)) || chr(CAST(65 + (k - 26) % 26 AS INT)) END AS name, CAST(k AS INT) AS col, CAST(p_size - 1 AS INT) AS row FROM k""")
def cell_references(spark, sf_dir):
    p = table(prepare(spark), sf_dir, "part")
    k = F.col("p_partkey") % 16384
    letter = lambda v: F.chr(F.lit(65) + v)
    name = F.when(k < 26, letter(k)).when(k < 702, F.concat(letter(F.floor(k / 26) - 1), letter(k % 26))).otherwise(F.concat(letter(F.floor((k - 26) / 676) - 1), letter(F.floor((k - 26) / 26) % 26), letter((k - 26) % 26)))
    at = O.cell_reference(F.concat(F.lit("$"), name, F.lit("$"), F.col("p_size").cast("string")))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), at["col"].alias("col"), at["row"].alias("row"))


@ENTRIES.add("WITH f AS (SELECT event_id, ['ABCDEF+Arial-BoldMT', 'Times-Italic', 'Helvetica', 'CMBX10', 'CMTI12', 'Foo-Heavy', 'Bar-Oblique'][event_id % 7 + 1] AS name FROM events) SELECT event_id, name IN ('ABCDEF+Arial-BoldMT', 'CMBX10', 'Foo-Heavy') AS bold, name IN ('Times-Italic', 'CMTI12', 'Bar-Oblique') AS italic FROM f")
def font_styles(spark, sf_dir):
    name = _pick(("ABCDEF+Arial-BoldMT", "Times-Italic", "Helvetica", "CMBX10", "CMTI12", "Foo-Heavy", "Bar-Oblique"), F.col("event_id"))
    s = O.font_style(name, F.lit(0))
    return table(prepare(spark), sf_dir, "events").select("event_id", s["bold"].alias("bold"), s["italic"].alias("italic"))


@ENTRIES.add()
def office_files(spark, sf_dir):
    """Word and spreadsheet files made of the nations' names, read back into blocks."""
    from docspark.sources import ooxml

    n = table(prepare(spark), sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("file_id"), "n_name")
    return ooxml.blocks(ooxml.sample_files(n, "file_id", "n_name"), "file_id", "content").select("file_id", "page", "ord", "kind", "text")
