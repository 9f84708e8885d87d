"""Column functions over text. All are built-in expressions, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The closed set of kinds, in order.
KINDS = (
    "title", "heading", "text", "list_item", "table", "figure", "formula", "form", "key_value", "caption", "footnote",
    "page_header", "page_footer", "page_number", "signature", "barcode", "code",
)
#: Kinds whose text is words of the page.
TEXTUAL = (
    "title", "heading", "text", "list_item", "caption", "footnote", "page_header", "page_footer", "page_number",
)
FURNITURE = ("page_header", "page_footer", "page_number")

#: What engines call a region -> its kind.
LABELS = {
    "title": "title",
    "heading": "heading", "section_header": "heading", "sectionheader": "heading", "subtitle": "heading", "subheading": "heading",
    "text": "text", "paragraph": "text", "plain_text": "text", "body": "text", "narrative_text": "text", "narrativetext": "text",
    "uncategorized_text": "text", "uncategorizedtext": "text", "aside_text": "text", "references": "text", "comment": "text",
    "list_item": "list_item", "list": "list_item", "listitem": "list_item",
    "table": "table",
    "figure": "figure", "picture": "figure", "image": "figure", "chart": "figure", "diagram": "figure",
    "formula": "formula", "equation": "formula", "math": "formula",
    "form": "form",
    "key_value": "key_value", "key_value_region": "key_value", "key_value_pair": "key_value",
    "caption": "caption", "table_caption": "caption", "figure_caption": "caption", "figurecaption": "caption", "formula_caption": "caption",
    "footnote": "footnote",
    "page_header": "page_header", "header": "page_header", "running_header": "page_header",
    "page_footer": "page_footer", "footer": "page_footer", "running_footer": "page_footer",
    "page_number": "page_number", "pagenumber": "page_number",
    "signature": "signature",
    "barcode": "barcode", "qr_code": "barcode",
    "code": "code", "code_block": "code", "code_snippet": "code", "codesnippet": "code",
}

#: Patterns (Java dialect).
PAGE_NUMBER = r"(?iU)^[\s\-–—\[(]*(?:(?:page|seite|pagina|página|p\.?)\s*)?[0-9]{1,4}(?:\s*(?:/|of|von|de|di)\s*[0-9]{1,4})?[\s\-–—\])\.]*$"
SECTION_NUMBER = r"^(?:([0-9]{1,3}(?:\.[0-9]{1,3})*)\.?|([A-Z](?:\.[0-9]{1,3})+)\.?|(?:[A-Z]|[IVXLC]{1,7})\.)\s+\S"
LIST_MARKER = r"^(?:[-*+•·◦▪‣–]|\(?[0-9]{1,3}[.)])[ \t]+"

BLANKS = r"(?U)\s+"


def squeeze(c: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def stripped(c: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    return squeeze(F.lower(c))


def fold_digits(c: Column) -> Column:
    """Each run of decimal digits, of any script, becomes #."""
    return F.regexp_replace(c, r"\p{Nd}+", "#")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ref(page: Column, order: Column) -> Column:
    return F.concat_ws(".", page.cast("string"), order.cast("string"))


def ref_parts(c: Column) -> Column:
    """struct(page, ord) of a reference of two numbers from 1; null for anything else."""
    ok = c.rlike(r"^[1-9][0-9]{0,8}\.[1-9][0-9]{0,8}$")
    return F.when(ok, F.struct(F.split_part(c, F.lit("."), F.lit(1)).cast("int").alias("page"), F.split_part(c, F.lit("."), F.lit(2)).cast("int").alias("ord")))


def is_furniture(kind: Column) -> Column:
    return kind.isin(*FURNITURE)


def is_textual(kind: Column) -> Column:
    return kind.isin(*TEXTUAL)


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER)


def section_depth(c: Column) -> Column:
    """How deep the printed section number at the begin of a heading is; 0 for none."""
    digits = F.concat(F.regexp_extract(c, SECTION_NUMBER, 1), F.regexp_extract(c, SECTION_NUMBER, 2))
    return F.when(c.rlike(SECTION_NUMBER), F.length(digits) - F.length(F.replace(digits, F.lit("."), F.lit(""))) + 1).otherwise(0)


def heading_level(kind: Column, text: Column, level: Column) -> Column:
    """Before the document's scale: a title 1, a numbered heading its depth and one, others from 2 to 6."""
    depth = section_depth(text)
    return F.when(kind == "title", 1).when(depth > 0, F.least(depth + 1, F.lit(6))).otherwise(F.least(F.greatest(level, F.lit(2)), F.lit(6)))


def label_key(c: Column) -> Column:
    key = F.translate(F.lower(stripped(c)), "- ", "__")
    return F.regexp_replace(key, "^layout_", "")


def label_kind(c: Column) -> Column:
    """The kind an engine's label means; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.try_element_at(table, label_key(c))


def heading_marks(c: Column) -> Column:
    """struct(marks, rest): the number signs a heading begins with, 0 for none, and the text behind them."""
    marks = F.length(F.regexp_extract(c, "^(#{1,6}) ", 1))
    return F.struct(marks.alias("marks"), F.when(marks > 0, stripped(F.regexp_replace(c, "^#{1,6} ", ""))).otherwise(c).alias("rest"))


def list_body(c: Column) -> Column:
    """A list item without its marker; a marker alone stays."""
    rest = F.regexp_replace(c, LIST_MARKER, "")
    return F.when(F.length(rest) > 0, rest).otherwise(c)


def math_body(c: Column) -> Column:
    """A formula without the first pair of delimiters that fits."""
    out = F.when(F.lit(False), c)
    for a, z in (("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"), ("$", "$")):
        fits = (F.length(c) >= len(a) + len(z)) & c.startswith(a) & c.endswith(z)
        out = out.when(fits, stripped(F.substring(c, F.lit(len(a) + 1), F.length(c) - len(a) - len(z))))
    return out.otherwise(c)


def percent(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def sha256_of(*parts: Column) -> Column:
    """Hex digest of the parts with a NUL between them."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def defang(c: Column) -> Column:
    """Fence tags of a prompt in a text are made inert."""
    return F.regexp_replace(c, r"(?i)<(/?(?:document|schema))>", "&lt;$1>")
