"""Boxes as struct<x0,y0,x1,y1:double> in fractions of a page; a null box is a place nobody knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The band at a page's edges, and how far two tables' sides may differ.
EDGE_BAND, EDGE_TOLERANCE = 0.12, 0.03


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def scaled(raw: Column, width: Column, height: Column) -> Column:
    """An engine's box, an array of four numbers on its grid, as fractions; null without four numbers and a grid."""
    ok = (F.size(raw) == 4) & (width > 0) & (height > 0)
    return F.when(ok, box(raw[0] / width, raw[1] / height, raw[2] / width, raw[3] / height))


def normalized(b: Column) -> Column:
    """struct(box, repaired): corners in order and inside the page; a null box if no area is left."""

    def inside(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    x0, x1 = inside(F.least(b["x0"], b["x1"])), inside(F.greatest(b["x0"], b["x1"]))
    y0, y1 = inside(F.least(b["y0"], b["y1"])), inside(F.greatest(b["y0"], b["y1"]))
    same = (x0 == b["x0"]) & (y0 == b["y0"]) & (x1 == b["x1"]) & (y1 == b["y1"])
    return F.struct(F.when((x0 < x1) & (y0 < y1), box(x0, y0, x1, y1)).alias("box"), (b.isNotNull() & ~same).alias("repaired"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for a null box or no overlap."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    both = w * h
    known = a.isNotNull() & b.isNotNull() & (w > 0) & (h > 0)
    return F.when(known, both / (area(a) + area(b) - both)).otherwise(0.0)


def at_edge(b: Column, top: Column, bottom: Column) -> Column:
    """Whether a block lies in the band at the top or the bottom; one without a box passes."""
    return b.isNull() | (top & (b["y1"] <= EDGE_BAND)) | (bottom & (b["y0"] >= 1 - EDGE_BAND))


def same_sides(a: Column, b: Column) -> Column:
    near = (F.abs(a["x0"] - b["x0"]) <= EDGE_TOLERANCE) & (F.abs(a["x1"] - b["x1"]) <= EDGE_TOLERANCE)
    return F.coalesce(near, F.lit(False))


def crop(b: Column, width: Column, height: Column) -> Column:
    """The pixels a box covers, rounded outward and kept inside the image: struct(left, top, right, bottom)."""
    return F.struct(
        F.greatest(F.floor(b["x0"] * width), F.lit(0)).cast("int").alias("left"),
        F.greatest(F.floor(b["y0"] * height), F.lit(0)).cast("int").alias("top"),
        F.least(F.ceil(b["x1"] * width), width).cast("int").alias("right"),
        F.least(F.ceil(b["y1"] * height), height).cast("int").alias("bottom"),
    )


def grown(b: Column, by: Column) -> Column:
    return box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by)


def around(a: Column, b: Column) -> Column:
    """The least box that holds both."""
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def meets(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def pixels(points: Column, dpi: int = 160) -> Column:
    """A page's side in pixels from points of a 72nd of an inch."""
    return F.ceil(points * dpi / 72).cast("int")


# --- intervals -----------------------------------------------------------------------------------------------------


def joined_intervals(rows: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", gap: float = 0) -> DataFrame:
    """Intervals of each group that overlap, or lie within a gap, as one: a running maximum finds where islands begin."""
    before = F.max(hi).over(Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.coalesce(F.col(lo) > before + gap, F.lit(True)).cast("int"))
    island = F.sum("__new").over(Window.partitionBy(*by).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__island", island).groupBy(*by, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__island")


def gaps(rows: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The open stretches between the joined intervals of each group."""
    after = F.lead(lo).over(Window.partitionBy(*by).orderBy(lo))
    out = joined_intervals(rows, by, lo, hi).withColumn("__next", after).where("__next is not null")
    return out.select(*by, F.col(hi).alias(lo), F.col("__next").alias(hi))


def covered(rows: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """How much of the line each group's intervals cover."""
    return joined_intervals(rows, by, lo, hi).groupBy(*by).agg(F.sum(F.col(hi) - F.col(lo)).alias("covered"))
