"""Folds whose next answer needs all earlier ones of a key: one linear pass over a key's rows, in their order.

fold is for keys with many rows each: a key is a task's group. fold_arrays is for many keys with few rows each, a day's or a
request's: a key's rows are one array, and arrays go through Python in Arrow batches, so neither a key nor what is held so
far costs more than its rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.session import written


def fold(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]], result: str) -> DataFrame:
    """by and what step returns for each row. step takes the state and the row (its columns in their order), and gives the
    new state and the row's result."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = start(), []
        clean = pdf.sort_values(order, kind="stable").astype(object).where(lambda x: x.notna(), None)
        for row in clean.itertuples(index=False):
            state, said = step(state, row)
            out.append(said)
        frame = pd.DataFrame(out, columns=names)
        for i, c in enumerate(by):
            frame.insert(i, c, pdf[c].iloc[0])
        return frame

    fields = T._parse_datatype_string(result).fields
    names = [f.name for f in fields]
    schema = T.StructType([*(rows.schema[c] for c in by), *fields])
    return rows.groupBy(*by).applyInPandas(run, schema)


def fold_arrays(rows: DataFrame, by: list[str], order: list[str], columns: list[str], answers: Callable[[list[tuple]], list[tuple]], result: str) -> DataFrame:
    """by, and for each row, in the order of its key, what answers gives: it takes a key's rows (columns) and answers each."""
    one = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *columns])])
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("__rows"))

    @F.pandas_udf(f"array<struct<{result}>>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, said, strict=True)) for said in answers([tuple(r[c] for c in columns) for r in own])] for own in lists])

    names = [f.name for f in T._parse_datatype_string(result.replace(":", " ")).fields]
    return held.select(*by, F.inline(run("__rows")))


def running(rows: DataFrame, scope: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with, by name, each sum over the rows before a row in its scope (none: the whole table); no task holds a scope.

    The rows are dealt out by ranges of their order and written, so a place is settled once; a row's sum is that of the rows
    before it in its range and those of the ranges before. order must tell any two rows of a scope apart. Columns of scope
    aren't null; a null value counts as 0.
    """
    values = rows.select("*", *[F.coalesce(v, F.lit(0)).cast("long").alias(f"__{n}") for n, v in sums.items()])
    held = written(values.orderBy(*scope, *order).withColumn("__range", F.spark_partition_id()), "ordered")
    ahead = Window.partitionBy("__range", *scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*scope).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range and scope.
    whole = held.groupBy("__range", *scope).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    base = whole.select("__range", *scope, *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums])
    inside = held.select("*", *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__inside_{n}") for n in sums])
    kept = [c for c in rows.columns if c not in sums]
    return inside.join(base, ["__range", *scope]).select(*kept, *[(F.col(f"__before_{n}") + F.col(f"__inside_{n}")).alias(n) for n in sums])
