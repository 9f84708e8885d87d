"""Reader output made uniform, and the checks on it. Built-in expressions, but for tables read from markup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import geometry as G
from docspark.functions import text as X

#: A reply of so many lines is long; lines of fewer bytes don't count; the share one line may have.
LONG_REPLY, LINE_BYTES, SHARE = 20, 8, 0.5


def regions(rows: DataFrame, with_tables: bool = False) -> DataFrame:
    """Raw regions as blocks. rows: page, pos (place in the reply), label, text, raw_box, width, height, order, and with
    tables html. Returns page, ord, ref, kind, text, level, description, box, flags, and table.

    What has neither text nor table goes, but for figures, signatures and barcodes. Order is the engine's (the place in
    the reply where it gave none), ties by place, dense from 1.
    """
    known = X.label_kind(F.col("label"))
    kind = F.coalesce(known, F.lit("text"))
    text = X.stripped(F.col("text"))
    marks = X.heading_marks(text)
    named = F.least(F.greatest(F.coalesce(F.col("level") if "level" in rows.columns else F.lit(0), F.lit(0)), F.lit(0)), F.lit(6))
    head = kind.isin("title", "heading")
    body = F.when(head, marks["rest"]).when(kind == "formula", X.math_body(text)).when(kind == "list_item", X.list_body(text)).otherwise(text)
    level = F.when(head, F.when(named == 0, marks["marks"]).otherwise(named)).otherwise(0)
    fixed = G.normalized(G.scaled(F.col("raw_box"), F.col("width"), F.col("height")))
    repaired = (F.size("raw_box") == 4) & (fixed["box"].isNull() | fixed["repaired"])
    flags = F.array_compact(F.array(F.when(known.isNull(), "kind_coerced"), F.when(F.coalesce(repaired, F.lit(False)), "box_clamped")))
    described = F.when(kind == "figure", X.stripped(F.coalesce(F.col("description"), F.lit("")))).otherwise("") if "description" in rows.columns else F.lit("")
    order = F.when(F.coalesce(F.col("order"), F.lit(0)) > 0, F.col("order")).otherwise(F.col("pos") + 1)
    out = rows.select("page", "pos", order.alias("__order"), kind.alias("kind"), body.alias("text"), level.cast("int").alias("level"), described.alias("description"), fixed["box"].alias("box"), flags.alias("flags"), *(["html", F.col("text").alias("__raw")] if with_tables else []))
    whole = F.col("text") != ""
    if with_tables:
        from docspark.operators.views import table_text
        from docspark.sources.html import table_from_html

        markup = F.when(F.col("html") != "", F.col("html")).when(F.contains(F.lower("__raw"), F.lit("<table")), F.col("__raw"))
        out = out.withColumn("table", F.when(F.col("kind") == "table", table_from_html(F.when(F.col("kind") == "table", markup))))
        held = F.col("table.cells").isNotNull()
        out = out.withColumn("table", F.when(held, F.col("table"))).withColumn("text", F.when(held, table_text(F.col("table.cells"))).otherwise(F.col("text"))).drop("html", "__raw")
        whole = whole | F.col("table").isNotNull()
    out = out.where(whole | F.col("kind").isin("figure", "signature", "barcode"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("__order", "pos"))
    out = out.withColumn("ord", place).withColumn("ref", X.ref(F.col("page"), F.col("ord")))
    return out.drop("__order", "pos")


def reply_check(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Whether each reply (reply_id, truncated, blank) is usable: empty without a blank page, and a truncated one of which
    one line makes up over half, are invalid. blocks: reply_id, text."""
    lines = blocks.select("reply_id", F.explode(F.split("text", "\n")).alias("line")).select("reply_id", X.stripped(F.col("line")).alias("line")).where(F.octet_length("line") >= LINE_BYTES)
    counts = lines.groupBy("reply_id", "line").agg(F.count(F.lit(1)).alias("n")).groupBy("reply_id").agg(F.sum("n").alias("lines"), F.max("n").alias("top"))
    held = blocks.groupBy("reply_id").agg(F.count(F.lit(1)).alias("blocks"))
    rows = replies.join(held, "reply_id", "left").join(counts, "reply_id", "left")
    n, top = F.coalesce("lines", F.lit(0)), F.coalesce("top", F.lit(0))
    loops = F.col("truncated") & (n >= LONG_REPLY) & (top > SHARE * n)
    answer = F.when(F.col("blocks").isNull(), F.when(F.col("blank"), "fine").otherwise("invalid")).when(loops, "invalid").otherwise("fine")
    return rows.select("reply_id", n.alias("lines"), top.alias("top"), answer.alias("answer"))


def page_faults(blocks: DataFrame) -> DataFrame:
    """Blocks that break a rule of pages: the first rule each breaks."""
    w = Window.partitionBy("parse_id", "page").orderBy("ord")
    dense = F.row_number().over(w) == F.col("ord")
    b = F.col("box")
    inside = b.isNull() | ((b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] <= 1) & (b["y1"] <= 1) & (b["x0"] < b["x1"]) & (b["y0"] < b["y1"]))
    fault = (
        F.when(F.col("page") < 1, "number").when(F.col("state") != "succeeded", "blocks_without_success").when(~F.col("kind").isin(*X.KINDS), "kind").when(~dense, "order")
        .when(F.col("ref") != X.ref(F.col("page"), F.col("ord")), "ref").when(~inside, "box").when(~F.col("level").between(0, 6), "level")
    )
    return blocks.withColumn("fault", fault).where("fault is not null").select("parse_id", "page", "ord", "fault")


#: Commands whose first letter is a JSON escape too.
COMMANDS = (
    "bar begin beta big bigg bigcap bigcup binom bm boldsymbol bot boxed bullet frac forall flat nabla neq neg notin nu nmid nolimits nonumber newline nleq ngeq rho right rightarrow rangle rceil rfloor rvert rbrace rbrack "
    "tau text textbf textit textrm texttt theta tilde times to top triangle tfrac tanh therefore"
).split()


def latex_repaired(reply: Column) -> Column:
    """JSON whose strings hold LaTeX: backslashes that escape nothing, or begin a known command, are doubled."""
    begins = rf"(?:(?:{'|'.join(COMMANDS)})(?![A-Za-z])|u(?![0-9A-Fa-f]{{4}})|[^\\\\\"/bfnrtu])"
    return F.regexp_replace(reply, rf"(?<!\\)((?:\\\\)*)\\(?={begins})", r"$1\\\\")


def completed_reply(reply: str) -> str | None:
    """A truncated JSON list of blocks, cut behind its last whole element and closed; None if it holds none.

    A scan keeps the nesting and the strings; brackets inside strings count for nothing.
    """
    start = reply.find("[")
    if start < 0:
        return None
    opened: list[str] = []
    inside = escaped = False
    last = -1
    for i in range(start, len(reply)):
        c = reply[i]
        if inside:
            inside = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            opened.append("]" if c == "[" else "}")
        elif c in "]}":
            if not opened or opened.pop() != c:
                return None
            if not opened:
                return reply[: i + 1] + "}" * reply[:start].count("{")
            if len(opened) == 1:
                last = i
    return None if last < 0 else reply[: last + 1] + "]" + "}" * reply[:start].count("{")


def completed(reply: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(completed_reply)

    return run(reply)
