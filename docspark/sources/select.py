"""Page selections such as "1-3,7,5-". Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most pages of a parse, and bytes of a file.
MAX_PAGES, MAX_BYTES = 3000, 256 << 20
_PART = r"\s*\+?[0-9]+\s*(?:-\s*(?:\+?[0-9]+)?\s*)?"


def _parts(expr: Column) -> Column:
    """array<struct<a, b>>; b is null for an open end, and a for a single page."""

    def ends(p: Column) -> Column:
        a = F.regexp_extract(p, r"^\s*\+?([0-9]+)", 1).cast("bigint")
        b = F.regexp_extract(p, r"-\s*\+?([0-9]+)\s*$", 1)
        return F.struct(a.alias("a"), F.when(b != "", b.cast("bigint")).when(~F.contains(p, F.lit("-")), a).alias("b"))

    return F.transform(F.split(expr, ","), ends)


def well_formed(expr: Column) -> Column:
    """Whether a selection can be read, whatever the number of pages; an empty one is all pages."""
    shape = expr.rlike(rf"^{_PART}(?:,{_PART})*$")
    fine = F.forall(_parts(expr), lambda p: (p["a"] >= 1) & (p["b"].isNull() | (p["b"] >= p["a"])))
    return (F.trim(expr) == "") | (shape & F.coalesce(fine, F.lit(False)))


def selected(expr: Column, total: Column) -> Column:
    """struct(pages, code): the pages chosen, in order, or invalid_pages."""

    def run(p: Column) -> Column:
        last = F.least(F.coalesce(p["b"], total), total)
        return F.when(p["a"] <= last, F.sequence(p["a"].cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    everything = F.sequence(F.lit(1), F.greatest(total, F.lit(1)).cast("int"))
    # An open end counts as the last page, so a begin past it is an end before the begin only where it was written.
    chosen = F.when(F.trim(expr) == "", everything).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(_parts(expr), run)))))
    fine = (total > 0) & well_formed(expr)
    pages = F.when(fine, chosen)
    return F.struct(F.when(F.size(pages) > 0, pages).alias("pages"), F.when(fine & (F.size(pages) > 0), F.lit(None)).otherwise("invalid_pages").alias("code"))


def limits(total: Column, size: Column, max_pages: int = MAX_PAGES, max_bytes: int = MAX_BYTES) -> Column:
    return F.when(size > max_bytes, "file_too_large").when(total > max_pages, "too_many_pages")
