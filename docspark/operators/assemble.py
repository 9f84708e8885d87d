"""Assembly: what makes pages a document. Blocks are re-labeled and marked, never deleted.

A block is a row: parse_id, page, ord (dense from 1), ref, state and source of its page, kind, text, level, box. All passes
are windows whose partitioning starts with parse_id, so one shuffle by parse serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import geometry as G
from docspark.functions import text as X

#: Fixed value: the longest text, in characters, that can be a running line.
RUNNING_CHARS = 200


def page_numbers(blocks: DataFrame) -> DataFrame:
    """First and last blocks at an edge, and headers and footers, whose whole text is a page number become one."""
    last = F.max("ord").over(Window.partitionBy("parse_id", "page"))
    first, final = F.col("ord") == 1, F.col("ord") == last
    body = F.col("kind").isin("text", "caption", "footnote") & (first | final) & G.at_edge(F.col("box"), first, final)
    marked = (F.col("state") == "succeeded") & (body | F.col("kind").isin("page_header", "page_footer")) & X.is_page_number(F.col("text"))
    return _relabeled(blocks, marked, F.lit("page_number"))


def _relabeled(blocks: DataFrame, marked: Column, kind: Column) -> DataFrame:
    out = blocks.withColumn("__m", F.coalesce(marked, F.lit(False)))
    return out.withColumn("kind", F.when(F.col("__m"), kind).otherwise(F.col("kind"))).withColumn("level", F.when(F.col("__m"), 0).otherwise(F.col("level"))).drop("__m")


def running_lines(blocks: DataFrame) -> DataFrame:
    """Lines that repeat at the same edge of half the pages, two at least, become headers or footers.

    The edges lie inside the page numbers. Texts are compared folded, digits as they are.
    """
    page = Window.partitionBy("parse_id", "page")
    content = F.when((F.col("kind") != "page_number") & (F.col("state") == "succeeded"), F.col("ord"))
    rows = blocks.withColumn("__first", F.min(content).over(page)).withColumn("__last", F.max(content).over(page))
    top = F.coalesce(F.col("ord") == F.col("__first"), F.lit(False))
    bottom = F.coalesce((F.col("ord") == F.col("__last")) & (F.col("__last") > F.col("__first")), F.lit(False))
    able = X.is_textual(F.col("kind")) & (F.col("text") != "") & (F.length("text") <= RUNNING_CHARS) & (X.is_furniture(F.col("kind")) | G.at_edge(F.col("box"), top, bottom))
    rows = rows.withColumn("__key", F.when((top | bottom) & F.coalesce(able, F.lit(False)), X.fold(F.col("text"))))
    rows = rows.withColumn("__top", top & F.col("__key").isNotNull()).withColumn("__bottom", bottom & F.col("__key").isNotNull())
    counted = F.sum(((F.col("ord") == 1) & (F.col("state") == "succeeded")).cast("int")).over(Window.partitionBy("parse_id"))
    same = Window.partitionBy("parse_id", "__key")
    rows = rows.withColumn("__pages", counted).withColumn("__tops", F.sum(F.col("__top").cast("int")).over(same)).withColumn("__bottoms", F.sum(F.col("__bottom").cast("int")).over(same))
    need = F.greatest(F.lit(2), F.floor((F.col("__pages") + 1) / 2))
    header, footer = F.col("__top") & (F.col("__tops") >= need), F.col("__bottom") & (F.col("__bottoms") >= need)
    out = _relabeled(rows, (header | footer) & ~X.is_furniture(F.col("kind")), F.when(header, "page_header").otherwise("page_footer"))
    return out.drop("__first", "__last", "__key", "__top", "__bottom", "__pages", "__tops", "__bottoms")


def repeated(blocks: DataFrame) -> DataFrame:
    """repeated: a header or footer, digits folded, that an earlier one of its kind has said."""
    running = F.col("kind").isin("page_header", "page_footer") & (F.col("state") == "succeeded")
    key = F.when(running, X.fold_digits(X.fold(F.col("text"))))
    rows = blocks.withColumn("__key", key)
    place = F.row_number().over(Window.partitionBy("parse_id", "kind", "__key").orderBy("page", "ord"))
    return rows.withColumn("repeated", F.col("__key").isNotNull() & (place > 1)).drop("__key")


def one_title(blocks: DataFrame) -> DataFrame:
    """The titles of the first read page that has one stay; later ones become headings. Native pages keep theirs."""
    title = (F.col("kind") == "title") & (F.col("source") != "native")
    first = F.min(F.when(title, F.col("page"))).over(Window.partitionBy("parse_id"))
    later = title & (F.col("page") > F.col("__first"))
    rows = blocks.withColumn("__first", first)
    return rows.withColumn("kind", F.when(later, "heading").otherwise(F.col("kind"))).drop("__first")


def outline(blocks: DataFrame) -> DataFrame:
    """parse_id, page, ord, ref, level, text of titles and headings; the levels that occur become 1, 2, 3 .."""
    heads = blocks.where(F.col("kind").isin("title", "heading"))
    level = X.heading_level(F.col("kind"), F.col("text"), F.col("level"))
    dense = F.dense_rank().over(Window.partitionBy("parse_id").orderBy("__level"))
    return heads.withColumn("__level", level).select("parse_id", "page", "ord", "ref", dense.alias("level"), "text")


def assembled(blocks: DataFrame) -> DataFrame:
    """All passes that re-label, in their order.

    Dealt by parse at once: the first pass's windows, by parse and page, would else be dealt by both and the rest anew.
    """
    return one_title(repeated(running_lines(page_numbers(blocks.repartition("parse_id")))))


def with_outline(blocks: DataFrame) -> DataFrame:
    """outline_level: the level that outline gives a title or heading, null for other blocks; no join, as it is a window."""
    head = F.col("kind").isin("title", "heading")
    rows = blocks.withColumn("__level", F.when(head, X.heading_level(F.col("kind"), F.col("text"), F.col("level"))))
    dense = F.dense_rank().over(Window.partitionBy("parse_id", F.col("__level").isNull()).orderBy("__level"))
    return rows.withColumn("outline_level", F.when(F.col("__level").isNotNull(), dense)).drop("__level")


def usage_sum(pages: DataFrame) -> DataFrame:
    """Pages and tokens of each parse; costs are decimal strings and are never summed."""
    return pages.groupBy("parse_id").agg(F.sum("pages").alias("pages"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def filled_pages(selected: DataFrame, read: DataFrame, state: str = "skipped") -> DataFrame:
    """Selected pages (parse_id, page) with the state they were read in; those never read get another."""
    return selected.join(read.select("parse_id", "page", "state"), ["parse_id", "page"], "left").withColumn("state", F.coalesce("state", F.lit(state)))


# --- tables that go on ---------------------------------------------------------------------------------------------


def first_row(cells: Column) -> Column:
    """A table's first row folded, for comparison: cells in the order of columns; empty if no cell has text."""
    own = F.array_sort(F.transform(F.filter(cells, lambda c: c["row"] == 0), lambda c: F.struct(c["col"].alias("col"), X.fold(c["text"]).alias("text"))))
    texts = F.transform(own, lambda c: c["text"])
    return F.when(F.exists(texts, lambda t: t != ""), F.array_join(texts, "\x1f")).otherwise("")


def is_continued(kind: Column, text: Column) -> Column:
    return (kind == "caption") & (F.contains(F.lower(text), F.lit("continued")) | F.contains(F.lower(text), F.lit("cont.")))


def table_edges(blocks: DataFrame) -> DataFrame:
    """One row per page with content: its first and last content blocks, as structs (ref, rows, cols, header, box).

    A caption that says a table goes on is passed over once at each end, if other content is left.
    """
    own = blocks.where((F.col("state") == "succeeded") & ~X.is_furniture(F.col("kind")))
    table = F.struct(F.col("table.rows").alias("rows"), F.col("table.cols").alias("cols"), first_row(F.col("table.cells")).alias("header"))
    entry = F.struct("ord", "ref", F.col("table").isNotNull().alias("is_table"), table.alias("t"), "box", is_continued(F.col("kind"), F.col("text")).alias("more"))
    pages = own.groupBy("parse_id", "page").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    lead = F.when((F.size("c") > 1) & F.element_at("c", 1)["more"], F.slice("c", F.lit(2), F.size("c") - 1)).otherwise(F.col("c"))
    pages = pages.withColumn("c", lead)
    tail = F.when((F.size("c") > 1) & F.element_at("c", -1)["more"], F.slice("c", F.lit(1), F.size("c") - 1)).otherwise(F.col("c"))
    return pages.withColumn("c", tail).select("parse_id", "page", F.element_at("c", 1).alias("first"), F.element_at("c", -1).alias("last"))


def spans(blocks: DataFrame) -> DataFrame:
    """parse_id, id (s1 ..), parts, rows, cols of tables that go on over pages.

    A fold over a parse's pages: the header compared is that of a span's first part, the sides are those of its latest.
    """
    edges = table_edges(blocks).groupBy("parse_id").agg(F.array_sort(F.collect_list(F.struct("page", "first", "last"))).alias("pages"))
    part = "struct<parts:array<string>,rows:bigint,cols:bigint,header:string,box:struct<x0:double,y0:double,x1:double,y1:double>>"
    start = F.expr(f"named_struct('page', cast(-1 as int), 'open', cast(null as {part}), 'done', cast(array() as array<{part}>))")

    def begun(e: Column) -> Column:
        table = F.struct(F.array(e["ref"]).alias("parts"), e["t"]["rows"].cast("bigint").alias("rows"), e["t"]["cols"].cast("bigint").alias("cols"), e["t"]["header"].alias("header"), e["box"].alias("box"))
        return F.when(e["is_table"] & (e["t"]["cols"] > 0), table).otherwise(F.lit(None).cast(part))

    def closed(done: Column, span: Column) -> Column:
        return F.when(F.coalesce(F.size(span["parts"]) > 1, F.lit(False)), F.concat(done, F.array(span))).otherwise(done)

    def step(held: Column, p: Column) -> Column:
        first, last, span = p["first"], p["last"], held["open"]
        header = F.coalesce((span["header"] != "") & (first["t"]["header"] == span["header"]), F.lit(False))
        joins = F.coalesce(span.isNotNull() & (held["page"] + 1 == p["page"]) & first["is_table"] & (first["t"]["cols"] == span["cols"]) & (header | G.same_sides(span["box"], first["box"])), F.lit(False))
        grown = F.struct(F.concat(span["parts"], F.array(first["ref"])).alias("parts"), (span["rows"] + first["t"]["rows"]).alias("rows"), span["cols"].alias("cols"), span["header"].alias("header"), first["box"].alias("box"))
        fills = last["ref"] == first["ref"]
        return F.struct(
            p["page"].cast("int").alias("page"),
            F.when(joins & fills, grown).otherwise(begun(last)).alias("open"),
            F.when(joins & fills, held["done"]).when(joins, closed(held["done"], grown)).otherwise(closed(held["done"], span)).alias("done"),
        )

    end = F.aggregate("pages", start, step, lambda held: closed(held["done"], held["open"]))
    rows = edges.select("parse_id", F.posexplode(end).alias("i", "s"))
    return rows.select("parse_id", F.concat(F.lit("s"), (F.col("i") + 1).cast("string")).alias("id"), "s.parts", "s.rows", "s.cols")
