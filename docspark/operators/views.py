"""Views of assembled documents: Markdown, text, pieces for extraction, lookups, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as X

#: Fixed value: the most figures of one run.
MAX_FIGURES = 1000


def shown(repeated: str = "once") -> Column:
    """Whether a block is printed: once hides repeats and page numbers, drop hides all furniture, keep hides nothing."""
    if repeated == "keep":
        return F.lit(True)
    if repeated == "drop":
        return ~X.is_furniture(F.col("kind"))
    return ~F.col("repeated") & (F.col("kind") != "page_number")


def viewed(blocks: DataFrame, repeated: str = "once", pages: list[int] | None = None) -> DataFrame:
    rows = blocks.where(F.col("state") == "succeeded").where(shown(repeated))
    return rows.where(F.col("page").isin(pages)) if pages is not None else rows


def table_text(cells: Column) -> Column:
    """Cells by row and column: blanks around | between cells, a line for each row."""
    return _rows(cells, lambda c: c["text"], " | ", "\n")


def _rows(cells: Column, show, between: str, after: str) -> Column:
    numbers = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c["row"])))

    def line(r: Column) -> Column:
        own = F.array_sort(F.filter(cells, lambda c: c["row"] == r), lambda a, b: F.when(a["col"] < b["col"], -1).when(a["col"] > b["col"], 1).otherwise(0))
        return F.array_join(F.transform(own, show), between)

    return F.array_join(F.transform(numbers, line), after)


def table_html(cells: Column) -> Column:
    """Markup written from the cells alone."""

    def cell(c: Column) -> Column:
        tag = F.when(c["header"], "th").otherwise("td")
        rows = F.when(c["row_span"] > 1, F.concat(F.lit(' rowspan="'), c["row_span"].cast("string"), F.lit('"'))).otherwise("")
        cols = F.when(c["col_span"] > 1, F.concat(F.lit(' colspan="'), c["col_span"].cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit("<"), tag, rows, cols, F.lit(">"), X.html_escape(c["text"]), F.lit("</"), tag, F.lit(">"))

    body = F.when(F.size(cells) > 0, F.concat(F.lit("<tr>"), _rows(cells, cell, "", "</tr><tr>"), F.lit("</tr>"))).otherwise("")
    return F.concat(F.lit("<table>"), body, F.lit("</table>"))


def table_markdown(table: Column) -> Column:
    """A grid of rows and columns with a rule under the first row; the last cell of a place wins."""
    cells = table["cells"]

    def place(r: Column, c: Column) -> Column:
        own = F.filter(cells, lambda x: (x["row"] == r) & (x["col"] == c))
        return F.when(F.size(own) > 0, F.replace(X.squeeze(F.element_at(own, -1)["text"]), F.lit("|"), F.lit("\\|"))).otherwise("")

    columns = F.sequence(F.lit(0), table["cols"] - 1)
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), table["cols"]))

    def line(r: Column) -> Column:
        text = F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda c: place(r, c)), " | "), F.lit(" |"))
        return F.when(r == 0, F.concat(text, rule)).otherwise(text)

    return F.array_join(F.transform(F.sequence(F.lit(0), table["rows"] - 1), line), "\n")


def has_spans(cells: Column) -> Column:
    return F.exists(cells, lambda c: (c["row_span"] > 1) | (c["col_span"] > 1))


def block_markdown(level: Column, table: Column | None = None, description: Column | None = None, tables: str = "auto") -> Column:
    """A block as Markdown; level is the outline's, null for a heading it doesn't hold."""
    kind, text = F.col("kind"), F.col("text")
    one = X.squeeze(text)
    depth = F.least(F.greatest(F.coalesce(level, X.heading_level(kind, text, F.col("level"))), F.lit(1)), F.lit(6)).cast("int")
    out = (
        F.when(kind.isin("title", "heading"), F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), one))
        .when(kind == "list_item", F.concat(F.lit("- "), one))
        .when(kind == "formula", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(kind == "caption", F.concat(F.lit("*"), one, F.lit("*")))
    )
    if table is not None:
        html = F.lit(tables == "html") | (F.lit(tables != "markdown") & has_spans(table["cells"]))
        whole = table.isNotNull() & (F.size(table["cells"]) > 0)
        out = out.when((kind == "table") & whole, F.when(html, table_html(table["cells"])).otherwise(table_markdown(table)))
    if description is not None:
        words = F.when(text != "", F.concat(F.lit("\n\n"), text)).otherwise("")
        out = out.when((kind == "figure") & (description != ""), F.concat(F.lit("*[Figure: "), X.squeeze(description), F.lit("]*"), words))
    return out.otherwise(text)


def block_text(description: Column | None = None) -> Column:
    if description is None:
        return F.col("text")
    words = F.when(F.col("text") != "", F.concat(F.lit("\n\n"), F.col("text"))).otherwise("")
    return F.when((F.col("kind") == "figure") & (description != ""), F.concat(F.lit("[Figure: "), X.squeeze(description), F.lit("]"), words)).otherwise(F.col("text"))


def rendered(rows: DataFrame, out: Column, page_breaks: bool = False) -> DataFrame:
    """parse_id, body: the printed blocks of each parse in their order, a blank line between them, a line feed at the end.

    With page_breaks a comment stands before each page's blocks; it counts as printed.
    """
    lines = rows.withColumn("__out", out).where(F.col("__out") != "")
    one = F.struct("page", "ord", F.col("__out").alias("s"))
    docs = lines.groupBy("parse_id").agg(F.array_sort(F.collect_list(one)).alias("b"))
    if not page_breaks:
        return docs.select("parse_id", F.concat(F.array_join(F.transform("b", lambda x: x["s"]), "\n\n"), F.lit("\n")).alias("body"))
    pages = F.array_distinct(F.transform("b", lambda x: x["page"]))

    def page(p: Column) -> Column:
        own = F.filter("b", lambda x: x["page"] == p)
        return F.concat(F.format_string("<!-- page %d -->\n", p), F.array_join(F.transform(own, lambda x: F.concat(F.lit("\n"), x["s"], F.lit("\n"))), ""))

    return docs.select("parse_id", F.array_join(F.transform(pages, page), "\n").alias("body"))


def markdown(blocks: DataFrame, outline: DataFrame | None = None, repeated: str = "once", pages: list[int] | None = None, page_breaks: bool = False) -> DataFrame:
    """Each parse as Markdown; heading levels are the outline's, or without one the column outline_level of the blocks."""
    rows = viewed(blocks, repeated, pages)
    if outline is not None:
        levels = outline.select("parse_id", "ref", F.col("level").alias("outline_level"))
        rows = rows.drop("outline_level").join(levels, ["parse_id", "ref"], "left")
    return rendered(rows, block_markdown(F.col("outline_level")), page_breaks)


def plain_text(blocks: DataFrame, repeated: str = "once", pages: list[int] | None = None) -> DataFrame:
    return rendered(viewed(blocks, repeated, pages), block_text())


def pieces(blocks: DataFrame) -> DataFrame:
    """What an extraction reads: content of succeeded pages, trimmed, with a prompt's fence tags made inert."""
    rows = blocks.where((F.col("state") == "succeeded") & ~X.is_furniture(F.col("kind")))
    return rows.withColumn("text", X.defang(X.stripped(F.col("text")))).where(F.col("text") != "").select("parse_id", "page", "ord", "ref", "kind", "text")


def lookup(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks by reference (parse_id, ref): found, not_ready for a page that hasn't succeeded, not_found."""
    own = blocks.select("parse_id", "ref", "state", "kind", "text")
    rows = wanted.join(own, ["parse_id", "ref"], "left")
    answer = F.when(F.col("state").isNull(), "not_found").when(F.col("state") != "succeeded", "not_ready").otherwise("found")
    return rows.select("parse_id", "ref", answer.alias("answer"), F.when(answer == "found", F.col("kind")).alias("kind"))


def read_key(content: Column, page: Column, languages: Column, versions: Column) -> Column:
    """What makes two reads of a page the same: the file's bytes, the page, the languages hinted, and every reader that may come
    to read it with its version (reader=version texts). Empty if the bytes or a version aren't known."""
    known = content.isNotNull() & (content != "") & F.forall(versions, lambda v: ~v.endswith("="))
    return F.when(known, X.sha256_of(content, page.cast("string"), languages, F.array_join(versions, "\0"))).otherwise("")


def figures(blocks: DataFrame, limit: int = MAX_FIGURES, redo: bool = True) -> DataFrame:
    """Figures with a place, and the caption beside each: the next block's, else the one before.

    Without redo those that have a description already (a column of blocks) are left out.
    """
    if not redo:
        described_ = F.coalesce(F.col("description") != "", F.lit(False))
        return figures(blocks.withColumn("kind", F.when((F.col("kind") == "figure") & described_, "described").otherwise(F.col("kind"))), limit)
    w = Window.partitionBy("parse_id", "page").orderBy("ord")
    rows = blocks.withColumn("__next", F.when(F.lead("kind").over(w) == "caption", F.lead("text").over(w))).withColumn("__prev", F.when(F.lag("kind").over(w) == "caption", F.lag("text").over(w)))
    own = rows.where((F.col("kind") == "figure") & F.col("box").isNotNull() & (F.col("state") == "succeeded"))
    place = F.row_number().over(Window.partitionBy("parse_id").orderBy("page", "ord"))
    return own.withColumn("__n", place).where(F.col("__n") <= limit).select("parse_id", "page", "ord", "ref", "box", F.coalesce("__next", "__prev", F.lit("")).alias("caption"))


def figure_key(content: Column, page: Column, box: Column, caption: Column, languages: Column, versions: Column) -> Column:
    """What makes two figures' descriptions the same; empty if a reader's version is unknown. versions: reader=version texts."""
    # Halves go to the even digit, as they do in C's and Go's printf; Java's would go up.
    place = F.format_string("%.5f,%.5f,%.5f,%.5f", *(F.bround(box[x], 5) for x in ("x0", "y0", "x1", "y1")))
    known = (F.size(versions) > 0) & F.forall(versions, lambda v: ~v.endswith("=")) & content.isNotNull()
    return F.when(known, X.sha256_of(content, page.cast("string"), place, caption, languages, F.array_join(versions, "\0"))).otherwise("")


def described(blocks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Descriptions (parse_id, ref, description, labels) on their blocks; labels are a figure's text only if it has none."""
    rows = blocks.join(descriptions, ["parse_id", "ref"], "left")
    return rows.withColumn("text", F.when((F.col("text") == "") & F.col("labels").isNotNull(), F.col("labels")).otherwise(F.col("text"))).drop("labels")


def as_ndjson(rows: DataFrame, key: str = "parse_id", order: tuple[str, ...] = ("page", "ord")) -> DataFrame:
    """One JSON object a line, in the order of pages and blocks inside each partition of a parse."""
    return rows.repartition(key).sortWithinPartitions(key, *order).select(F.to_json(F.struct(*rows.columns)).alias("value"))
