"""Media types: from content first, then the name's extension, then the declared type. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types.
PDF, JPEG, PNG, TIFF = "application/pdf", "image/jpeg", "image/png", "image/tiff"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
DOC = "application/msword"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
XLS = "application/vnd.ms-excel"
XLSM = "application/vnd.ms-excel.sheet.macroenabled.12"
CSV, TXT, HTML, XML, MARKDOWN = "text/csv", "text/plain", "text/html", "text/xml", "text/markdown"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
PPT = "application/vnd.ms-powerpoint"
RTF, KEYNOTE = "application/rtf", "application/vnd.apple.keynote"
ODT, ODP = "application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.presentation"
P7M, P7M_X, P7S = "application/pkcs7-mime", "application/x-pkcs7-mime", "application/pkcs7-signature"
OCTET = "application/octet-stream"

#: The route of each type that is read.
ROUTES = {
    PDF: "reader", JPEG: "reader", PNG: "reader", TIFF: "reader",
    DOCX: "native_docx", DOC: "convert_doc_to_docx",
    XLSX: "native_spreadsheet", XLSM: "native_spreadsheet", CSV: "native_spreadsheet",
    TXT: "native_text", MARKDOWN: "native_text",
    PPTX: "convert_to_pdf", PPT: "convert_to_pdf", RTF: "convert_to_pdf", KEYNOTE: "convert_to_pdf", ODT: "convert_to_pdf", ODP: "convert_to_pdf",
    P7M: "unwrap_p7m", P7M_X: "unwrap_p7m", P7S: "unwrap_p7m",
}
#: Types that are known and not read.
REFUSED = (XLS, HTML, XML)
#: Extension -> type.
EXTENSIONS = {
    "pdf": PDF, "jpg": JPEG, "jpeg": JPEG, "png": PNG, "tif": TIFF, "tiff": TIFF, "docx": DOCX, "doc": DOC, "xlsx": XLSX, "xls": XLS, "xlsm": XLSM, "csv": CSV, "txt": TXT,
    "html": HTML, "htm": HTML, "xml": XML, "md": MARKDOWN, "pptx": PPTX, "ppt": PPT, "rtf": RTF, "key": KEYNOTE, "keynote": KEYNOTE, "odt": ODT, "odp": ODP, "p7m": P7M,
}
#: Other names of a type.
ALIASES = {
    "application/xml": XML, "text/rtf": RTF, "image/jpg": JPEG, "image/pjpeg": JPEG, "image/x-png": PNG, "image/tif": TIFF, "image/x-tiff": TIFF, "application/vnd.ms-word": DOC, "application/word": DOC,
}
#: What HTML begins with, after white space and before a blank or >.
HTML_TAGS = ("<!doctype html", "<html", "<head", "<script", "<iframe", "<h1", "<div", "<font", "<table", "<a", "<style", "<title", "<b", "<body", "<br", "<p", "<!--")
#: Fixed value: the object identifier of CMS SignedData.
SIGNED_DATA = "2A864886F70D010702"


def _map(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def canonical(mime: Column) -> Column:
    """Without parameters, in lower case, under the one name the tables use."""
    bare = F.lower(F.regexp_replace(F.split_part(F.coalesce(mime, F.lit("")), F.lit(";"), F.lit(1)), r"(?U)^\s+|\s+$", ""))
    return F.coalesce(_map(ALIASES, bare), bare)


def route(mime: Column) -> Column:
    """How a type is read; null for one that isn't."""
    return _map(ROUTES, canonical(mime))


def by_extension(name: Column) -> Column:
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/]*$", 0)
    return _map(EXTENSIONS, F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1)))


def _zip_kind(head: Column) -> Column:
    def has(s: str) -> Column:
        return F.contains(head, F.lit(s.encode()))

    return (
        F.when(has("word/document.xml"), DOCX)
        .when(has("ppt/presentation.xml") | has("ppt/slides/"), PPTX)
        .when(has("xl/workbook.xml") | has("xl/worksheets/"), F.when(has("xl/vbaProject.bin"), XLSM).otherwise(XLSX))
        .when(has(".apxl") | has("Index/Document.iwa"), KEYNOTE)
        .when(F.contains(head, F.lit(f"mimetype{ODT}PK\x03\x04".encode())), ODT)
        .when(F.contains(head, F.lit(f"mimetype{ODP}PK\x03\x04".encode())), ODP)
        .otherwise(OCTET)
    )


def sniffed(head: Column) -> Column:
    """The type that a file's first bytes (8 KiB are enough) tell; null if they tell none."""

    def begins(hexadecimal: str) -> Column:
        raw = bytes.fromhex(hexadecimal)
        return F.substring(head, 1, len(raw)) == F.lit(raw)

    first = F.hex(F.substring(head, 1, 512))
    # Text: no control character but \t \n \f \r and escape in the first 512 bytes.
    binary = first.rlike("^(?:..)*?(?:0[0-8BEF]|1[0-9ACDEF])")
    start = F.lower(F.regexp_replace(F.decode(F.substring(head, 1, 512), "ISO-8859-1"), r"^[\t\n\f\r ]+", ""))
    html = start.rlike("^(?:" + "|".join(t for t in HTML_TAGS if t != "<!--") + ")[ >]") | start.startswith("<!--")
    return (
        F.when(F.length(head) < 4, F.lit(None))
        .when(begins("255044462D"), PDF)
        .when(begins("89504E470D0A1A0A"), PNG)
        .when(begins("FFD8FF"), JPEG)
        .when(begins("49492A00") | begins("4D4D002A"), TIFF)
        .when(begins("7B5C727466"), RTF)
        .when(begins("504B0304"), _zip_kind(head))
        .when(begins("30") & F.substring(first, 1, 128).rlike("^(?:..)*?" + SIGNED_DATA), P7M)
        .when(F.substring(start, 1, 64).startswith("<?xml"), XML)
        .when(html, HTML)
        .when(~binary, TXT)
    )


def detected(head: Column, name: Column, mime: Column) -> Column:
    """struct(mime, code): what a file is read as, or why it is refused (unsupported_media_type)."""
    ext, declared = by_extension(name), canonical(mime)
    text_kind = ext.isin(CSV, TXT, HTML, XML, MARKDOWN)
    content = sniffed(head)
    content = F.when((content == TXT) & F.coalesce(text_kind, F.lit(False)), ext).otherwise(content)
    named = F.lit(None).cast("string")
    for c in (declared, ext, content):
        named = F.when(c.isin(*ROUTES, *REFUSED), c).otherwise(named)
    read = F.coalesce(named.isin(*ROUTES), F.lit(False))
    return F.struct(F.when(read, named).alias("mime"), F.when(~read, "unsupported_media_type").alias("code"))
