"""Words from a page's glyphs, and rectangles from its paths: the lowest layer of a text page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, in sizes of type: how far a glyph may stand off its word's line, and before or behind its reach.
ACROSS, BACK, AHEAD = 0.8, 0.2, 1.0
#: Points that may part the ends of a closed path, and how upright its sides must be.
CLOSE = 0.01


def words(glyphs: list[dict]) -> Iterator[dict]:
    """Words of glyphs (char, x, y, width, size) in the order they are drawn; a blank, or a glyph elsewhere, ends one."""
    now: dict | None = None
    for g in glyphs:
        if not g["char"].strip():
            if now:
                yield now
            now = None
            continue
        size = g["size"]
        if now and abs(g["y"] - now["baseline"]) <= ACROSS * size and -BACK * size <= g["x"] - now["x0"] and g["x"] <= now["x1"] + AHEAD * size:
            now["text"] += g["char"]
            now["x1"] = max(now["x1"], g["x"] + g["width"])
            now["size"] = max(now["size"], size)
        else:
            if now:
                yield now
            now = {"text": g["char"], "x0": g["x"], "x1": g["x"] + g["width"], "baseline": g["y"], "size": size}
    if now:
        yield now


def page_words(glyphs: DataFrame) -> DataFrame:
    """page, n, text, x0, x1, baseline, size. glyphs: page, n (drawing order), char, x, y, width, size; a page is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = list(words(pdf.sort_values("n", kind="stable").to_dict("records")))
        frame = pd.DataFrame(out, columns=["text", "x0", "x1", "baseline", "size"])
        frame.insert(0, "n", range(1, len(out) + 1))
        frame.insert(0, "page", pdf["page"].iloc[0])
        return frame

    return glyphs.groupBy("page").applyInPandas(run, "page long, n int, text string, x0 double, x1 double, baseline double, size double")


def rectangle(points: list[tuple[float, float]]) -> tuple[float, float, float, float] | None:
    """The box of a path of four upright lines back to its start; None for any other path."""
    if len(points) == 4:
        points = [*points, points[0]]
    if len(points) != 5 or max(abs(a - b) for a, b in zip(points[0], points[4], strict=True)) > CLOSE:
        return None
    level = [abs(a[1] - b[1]) <= CLOSE for a, b in zip(points, points[1:], strict=False)]
    upright = [abs(a[0] - b[0]) <= CLOSE for a, b in zip(points, points[1:], strict=False)]
    if not ((level[0] and upright[1] and level[2] and upright[3]) or (upright[0] and level[1] and upright[2] and level[3])):
        return None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def rectangles(paths: DataFrame) -> DataFrame:
    """paths (path_id, points: array of struct x, y) with the box of each, null unless it is a rectangle; the same test as
    rectangle, in built-in expressions. Null points make none."""
    p = F.when(F.size("points") == 4, F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    near = lambda a, b: F.abs(a - b) <= CLOSE
    rows = paths.withColumn("__p", p)
    at = lambda i: F.get("__p", F.lit(i))
    closed = (F.size("__p") == 5) & near(at(0)["x"], at(4)["x"]) & near(at(0)["y"], at(4)["y"])
    level, upright = ([near(at(i)[axis], at(i + 1)[axis]) for i in range(4)] for axis in ("y", "x"))
    fits = (level[0] & upright[1] & level[2] & upright[3]) | (upright[0] & level[1] & upright[2] & level[3])
    ends = [f(F.col("__p").getField(axis)) for f in (F.array_min, F.array_max) for axis in ("x", "y")]
    box = F.struct(*[e.alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1"), strict=True)])
    return rows.withColumn("box", F.when(closed & fits, box)).drop("__p")
