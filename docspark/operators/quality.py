"""Scores of found pages against a known truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import geometry as G
from docspark.functions import text as X

#: The least similarity of matched texts and overlap of right boxes; most notes; characters a note shows.
SIMILAR, OVERLAP, NOTES, CLIP = 0.5, 0.5, 40, 60
#: The bars of each class: cer at most; kinds, cells, order, boxes at least.
BARS = {
    "exact": {"cer": 0.0, "kinds": 1.0, "cells": 1.0, "order": 1.0, "boxes": 1.0},
    "typeset": {"cer": 0.02, "kinds": 0.90, "cells": 0.95, "order": 0.95, "boxes": 0.90},
    "scan": {"cer": 0.05, "kinds": 0.90, "cells": 0.95, "order": 0.95, "boxes": 0.85},
    "converted": {"cer": 0.02, "kinds": 0.90, "cells": 0.95, "order": 0.95, "boxes": 0.90},
}
UNTEXTED = ("figure", "formula")


def texted(kind: Column) -> Column:
    return ~kind.isin(*UNTEXTED)


def cell_text(cells: Column) -> Column:
    rows = F.array_sort(F.transform(cells, lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), c["text"].alias("text"))))
    return F.array_join(F.transform(rows, lambda c: c["text"]), " ")


def transcription(blocks: DataFrame, by: list[str]) -> DataFrame:
    """The words of each page: its blocks' squeezed texts but figures' and formulas', with a blank between.

    A table with cells (a column of that name, if any) counts by them, so the marks that its text puts between them don't.
    """
    text = F.col("text")
    if "cells" in blocks.columns:
        text = F.when((F.col("kind") == "table") & (F.size("cells") > 0), cell_text(F.col("cells"))).otherwise(text)
    one = F.struct("ord", X.squeeze(text).alias("s"))
    rows = blocks.where(texted(F.col("kind"))).groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("b"))
    return rows.select(*by, F.array_join(F.filter(F.transform("b", lambda x: x["s"]), lambda s: s != ""), " ").alias("words"))


def edits(truth: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Edit distance and truth characters of each page; a page on one side alone is all deletions or insertions."""
    t = transcription(truth, by).withColumnRenamed("words", "want")
    f = transcription(found, by).withColumnRenamed("words", "got")
    want, got = F.coalesce("want", F.lit("")), F.coalesce("got", F.lit(""))
    return t.join(f, by, "full").select(*by, F.length(want).cast("long").alias("characters"), F.levenshtein(want, got).cast("long").alias("edits"))


def cer(pages: DataFrame, by: list[str]) -> DataFrame:
    sums = pages.groupBy(*by).agg(F.sum("edits").alias("edits"), F.sum("characters").alias("characters"))
    return sums.withColumn("cer", F.col("edits") / F.greatest(F.col("characters"), F.lit(1)))


def share(right: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(right / total)


# --- matching ------------------------------------------------------------------------------------------------------


def distance(a: str, b: str) -> int:
    """Edit distance over code points, a row of the table at a time with numpy."""
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    short = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(short) + 1)
    row = steps.copy()
    for i, c in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32), 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (short != c))
        # Insertions run along the row: a running minimum of what is left once each step's cost is taken off.
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def _overlap(a: dict | None, b: dict | None) -> float:
    if a is None or b is None:
        return 0.0
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["y1"], b["y1"]) - max(a["y0"], b["y0"])
    if w <= 0 or h <= 0:
        return 0.0
    sizes = [(x["x1"] - x["x0"]) * (x["y1"] - x["y0"]) for x in (a, b)]
    return w * h / (sum(sizes) - w * h)


def matched(truth: list[dict], found: list[dict]) -> list[int]:
    """For each truth block (kind, text, box) the found one it is, -1 for none.

    Texts first: of all pairs similar enough the most similar, then the nearest in place, one to one. Figures and
    formulas then take the unmatched one of their kind that overlaps most.
    """
    candidates = []
    for i, t in enumerate(truth):
        for j, f in enumerate(found):
            if t["kind"] in UNTEXTED or f["kind"] in UNTEXTED:
                continue
            shorter, longer = sorted((len(t["text"]), len(f["text"])))
            if longer and shorter >= SIMILAR * longer:
                alike = 1 - distance(t["text"], f["text"]) / longer
                if alike >= SIMILAR:
                    candidates.append((-alike, abs(i - j), i, j))
    out = dict.fromkeys(range(len(truth)), -1)
    used: set[int] = set()
    for _, _, i, j in sorted(candidates):
        if out[i] < 0 and j not in used:
            out[i] = j
            used.add(j)
    for i, t in enumerate(truth):
        if t["kind"] in UNTEXTED:
            same = [(-_overlap(t["box"], f["box"]), j) for j, f in enumerate(found) if j not in used and f["kind"] == t["kind"]]
            if same:
                out[i] = min(same)[1]
                used.add(out[i])
    return [out[i] for i in range(len(truth))]


def matches(truth: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """by, ord (of the truth block), found_ord (null for none). A page is one group: its blocks are compared with its own.

    A null text counts as empty, and an empty text is like no other.
    """

    def run(key, t: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        t, f = t.sort_values("ord"), f.sort_values("ord")
        fits = matched(t.to_dict("records"), f.to_dict("records"))
        ords = f["ord"].tolist()
        rows = [(*key, o, ords[j] if j >= 0 else None) for o, j in zip(t["ord"].tolist(), fits, strict=True)]
        return pd.DataFrame(rows, columns=[*by, "ord", "found_ord"]).astype({"found_ord": "Int32"})

    def own(df: DataFrame) -> DataFrame:
        box = F.col("box") if "box" in df.columns else F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
        return df.select(*by, F.col("ord").cast("int").alias("ord"), "kind", F.coalesce(X.squeeze(F.col("text")), F.lit("")).alias("text"), box.alias("box"))

    t, f = own(truth), own(found)
    schema = t.select(*by, "ord").schema.add("found_ord", "integer")
    return t.groupBy(*by).cogroup(f.groupBy(*by)).applyInPandas(run, schema)


def kinds_share(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: by, kind, found_kind (null for none). The share of truth blocks found as their kind."""
    right = F.count_if(F.col("kind") == F.col("found_kind"))
    return pairs.groupBy(*by).agg(right.alias("kinds_right"), F.count(F.lit(1)).alias("blocks")).withColumn("kinds", share(F.col("kinds_right"), F.col("blocks")))


def order_share(pairs: DataFrame, page: list[str], by: list[str]) -> DataFrame:
    """Of neighbouring truth blocks both found, the share found in their order. pairs: page, ord, found_ord."""
    before = F.lag("found_ord").over(Window.partitionBy(*page).orderBy("ord"))
    rows = pairs.withColumn("__before", before)
    both = F.col("__before").isNotNull() & F.col("found_ord").isNotNull()
    sums = rows.groupBy(*by).agg(F.count_if(both & (F.col("__before") < F.col("found_ord"))).alias("order_right"), F.count_if(both).alias("order_pairs"))
    return sums.withColumn("order", share(F.col("order_right"), F.col("order_pairs")))


def boxes_share(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: by, box, found_box. The share of truth boxes that the found ones overlap enough; null without a box."""
    known = F.col("box").isNotNull()
    right = known & (G.overlap(F.col("box"), F.col("found_box")) >= OVERLAP)
    sums = pairs.groupBy(*by).agg(F.count_if(right).alias("boxes_right"), F.count_if(known).alias("boxes_total"))
    return sums.withColumn("boxes", F.when(F.col("boxes_total") > 0, F.col("boxes_right") / F.col("boxes_total")))


def cells_share(truth: DataFrame, found: DataFrame, table: list[str], by: list[str]) -> DataFrame:
    """Truth cells (table, row, col, row_span, col_span, text) that the found table holds alike; null without a cell."""
    f = found.select(*table, "row", "col", F.greatest("row_span", F.lit(1)).alias("__rs"), F.greatest("col_span", F.lit(1)).alias("__cs"), X.squeeze(F.col("text")).alias("__text"))
    rows = truth.join(f, [*table, "row", "col"], "left")
    same = (F.greatest("row_span", F.lit(1)) == F.col("__rs")) & (F.greatest("col_span", F.lit(1)) == F.col("__cs")) & (X.squeeze(F.col("text")) == F.col("__text"))
    sums = rows.groupBy(*by).agg(F.count_if(same).alias("cells_right"), F.count(F.lit(1)).alias("cells_total"))
    return sums.withColumn("cells", F.col("cells_right") / F.col("cells_total"))


def notes(pairs: DataFrame, by: list[str], limit: int = NOTES) -> DataFrame:
    """What is wrong, for the first blocks of each document: not found, or found as another kind."""
    clip = F.when(F.length("text") > CLIP, F.concat(F.substring("text", 1, CLIP), F.lit("..."))).otherwise(F.col("text"))
    said = F.when(F.col("found_kind").isNull(), F.format_string('%s %s is not found: "%s"', F.col("ref"), F.col("kind"), clip)).when(
        F.col("found_kind") != F.col("kind"), F.format_string('%s %s is found as %s: "%s"', F.col("ref"), F.col("kind"), F.col("found_kind"), clip)
    )
    rows = pairs.withColumn("note", said).where("note is not null")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("page", "ord"))).where(F.col("n") <= limit).select(*by, "n", "note")


def misses(scores: DataFrame, by: list[str]) -> DataFrame:
    """Measures that don't reach their class's bar. scores: by, class, cer, kinds, cells, order, boxes; a null never misses."""
    long = None
    for measure in ("cer", "kinds", "cells", "order", "boxes"):
        bar = F.try_element_at(F.create_map(*[x for c, b in BARS.items() for x in (F.lit(c), F.lit(b[measure]))]), F.col("class"))
        value = F.col(measure)
        missed = value > bar if measure == "cer" else value < bar
        part = scores.where(missed).select(*by, F.lit(measure).alias("measure"), value.alias("value"), bar.alias("bar"))
        long = part if long is None else long.unionByName(part)
    return long


def miss_text(measure: Column, value: Column, bar: Column) -> Column:
    return F.when(measure == "cer", F.concat(F.lit("cer "), X.percent(value, 2), F.lit(" is over "), X.percent(bar, 2))).otherwise(F.concat(measure, F.lit(" "), X.percent(value, 1), F.lit(" is under "), X.percent(bar, 1)))


def report(scores: DataFrame) -> DataFrame:
    """One Markdown row of a report for each file: file, class, pages, seconds, cer, kinds, cells, order, boxes."""
    per_page = F.col("seconds") / F.greatest(F.when(F.col("read_pages") > 0, F.col("read_pages")).otherwise(F.col("pages")), F.lit(1))
    shown = [F.coalesce(X.percent(F.col(x), d), F.lit("-")) for x, d in (("cer", 2), ("kinds", 1), ("cells", 1), ("order", 1), ("boxes", 1))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "file", "class", F.col("pages").cast("string"), F.format_string("%.2f", per_page), *shown), F.lit(" |"))
    return scores.select("file", per_page.alias("seconds_per_page"), line.alias("line"))


def truth_faults(blocks: DataFrame) -> DataFrame:
    """Truth blocks that break a rule: an unknown kind, cells and kind that disagree, a cell outside its table."""
    cells = F.col("cells")
    outside = F.exists(cells, lambda c: (c["row"] < 0) | (c["col"] < 0) | (c["row"] >= F.col("rows")) | (c["col"] >= F.col("cols")))
    fault = F.when(~F.col("kind").isin(*X.KINDS), "kind").when((F.col("kind") == "table") != (F.coalesce(F.size(cells), F.lit(0)) > 0), "table").when(F.coalesce(outside, F.lit(False)), "cell")
    return blocks.withColumn("fault", fault).where("fault is not null")


def selected_truth(blocks: DataFrame, pages: list[int]) -> DataFrame:
    """The blocks of chosen pages, pages numbered anew from 1 and heading levels dense again."""
    own = blocks.where(F.col("page").isin(pages))
    number = F.dense_rank().over(Window.partitionBy("parse_id").orderBy("page"))
    head = F.col("kind").isin("title", "heading")
    level = F.dense_rank().over(Window.partitionBy("parse_id", head).orderBy("level"))
    return own.withColumn("__page", number).withColumn("level", F.when(head, level).otherwise(F.col("level"))).withColumn("page", F.col("__page")).drop("__page").withColumn("ref", X.ref(F.col("page"), F.col("ord")))
