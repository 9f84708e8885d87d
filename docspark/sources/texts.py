"""Blocks from plain text, Markdown and delimited text."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as X

CELLS = "array<struct<row:int,col:int,row_span:int,col_span:int,header:boolean,text:string>>"
BLOCK = f"struct<ord:int,kind:string,level:int,text:string,table:struct<rows:int,cols:int,cells:{CELLS}>>"


def plain(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Paragraphs between blank lines, trimmed; empty ones go. Rows: id, ord, kind, text. Built-in expressions only."""
    parts = F.split(F.regexp_replace(F.col(text_col), "\r\n", "\n"), "\n\n")
    kept = F.filter(F.transform(parts, X.stripped), lambda p: p != "")
    return df.select(id_col, F.posexplode(kept).alias("ord", "text")).select(id_col, (F.col("ord") + 1).alias("ord"), F.lit("text").alias("kind"), "text")


def _list_item(line: str) -> str:
    mark, _, rest = line.partition(" ")
    if mark in ("-", "*", "+"):
        return rest.strip()
    number, dot, rest = line.partition(". ")
    return rest.strip() if dot and re.fullmatch(r"[+-]?[0-9]+", number) else ""


def markdown_blocks(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, level, text): fenced code, headings, list items and paragraphs; a fence that never closes holds the rest."""
    paragraph: list[str] = []
    code: list[str] | None = None

    def ended() -> Iterator[tuple[str, int, str]]:
        joined = "\n".join(paragraph).strip()
        paragraph.clear()
        if joined:
            yield "text", 0, joined

    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for raw in lines:
        raw = raw.rstrip("\r")
        line = raw.strip()
        if line.startswith("```"):
            if code is None:
                yield from ended()
                code = []
            else:
                yield "code", 0, "\n".join(code)
                code = None
        elif code is not None:
            code.append(raw)
        elif heading := re.match(r"(#{1,6}) ", line):
            yield from ended()
            level = len(heading[1])
            yield ("title" if level == 1 else "heading"), level, line[level:].rstrip("#").strip()
        elif item := _list_item(line):
            yield from ended()
            yield "list_item", 0, item
        elif line:
            paragraph.append(line)
        else:
            yield from ended()
    if code is not None:
        yield "code", 0, "\n".join(code)
    yield from ended()


def records(text: str) -> list[list[str]]:
    """Rows of delimited text, ragged and with stray quotes as they are; empty lines are no rows. A field has any length."""
    csv.field_size_limit(1 << 31 - 1)
    return [r for r in csv.reader(io.StringIO(text, newline=""), strict=False) if r]


def table_block(rows: list[list[str]]) -> dict:
    cells = [{"row": r, "col": c, "row_span": 1, "col_span": 1, "header": False, "text": v} for r, own in enumerate(rows) for c, v in enumerate(own)]
    return {"ord": 1, "kind": "table", "level": 0, "text": "\n".join(" | ".join(own) for own in rows), "table": {"rows": len(rows), "cols": max(map(len, rows)), "cells": cells}}


def _parsed(kind: str, text: str | None) -> list[dict]:
    if not text:
        return []
    if kind == "markdown":
        return [{"ord": i + 1, "kind": k, "level": level, "text": t, "table": None} for i, (k, level, t) in enumerate(markdown_blocks(text))]
    rows = records(text)
    return [table_block(rows)] if rows else []


def _blocks(df: DataFrame, id_col: str, text_col: str, kind: str) -> DataFrame:
    # Batched through Arrow; a file is one value, so its blocks are one array.
    @F.pandas_udf(f"array<{BLOCK}>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _parsed(kind, t))

    return df.select(id_col, F.inline(parse(F.col(text_col))))


def markdown(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows: id, ord, kind, level, text of Markdown files."""
    return _blocks(df, id_col, text_col, "markdown").drop("table")


def delimited(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows: id, ord, kind, text, table: one table block for each file that has a row."""
    return _blocks(df, id_col, text_col, "delimited")


def cells(blocks: DataFrame, id_col: str) -> DataFrame:
    return blocks.where("table is not null").select(id_col, "ord", F.inline("table.cells"))


def files(df: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """Digest and size of each file's bytes."""
    return df.select(id_col, F.sha2(content_col, 256).alias("sha256"), F.octet_length(content_col).alias("size"))


def distinct_files(files: DataFrame, owner: str = "owner", digest: str = "sha256", order: str = "created") -> DataFrame:
    """One live file for each owner and digest: the first; its retention is the last asked for."""
    return files.groupBy(owner, digest).agg(F.min_by("file_id", F.struct(order, "file_id")).alias("file_id"), F.max("kept_until").alias("kept_until"), F.count(F.lit(1)).alias("uploads"))
