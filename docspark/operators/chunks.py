"""Chunks for retrieval and windows for extraction: breaks searched in running sums of sizes, one parse at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import text as X

#: Bounds and default of a chunk's characters, and the most windows of an extraction.
MIN_CHARS, MAX_CHARS, DEFAULT_CHARS, MAX_WINDOWS = 200, 100_000, 6000, 32
FURNITURE = frozenset(X.FURNITURE)
HEADINGS = ("title", "heading")


def sums(sizes: np.ndarray | list[int]) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])


def reach(total: np.ndarray, start: int, room: int) -> int:
    """The end of the longest stretch from start whose sizes sum to room at most (start itself if none does)."""
    return max(start, int(np.searchsorted(total, total[start] + room, "right")) - 1)


def table_parts(cells: list[dict], most: int) -> list[str]:
    """A long table cut between rows; each part starts with the header rows, the marked ones or else the first.

    A part takes at least one row, and more while they fit. A null text counts as empty. A table without cells has no part.
    """
    if not cells:
        return []
    row, col = (np.array([c[name] for c in cells]) for name in ("row", "col"))
    order = np.lexsort((col, row))
    new = np.flatnonzero(np.diff(row[order], prepend=row[order[0]] - 1))
    groups = np.split(order, new[1:])
    lines = np.array([" | ".join(cells[i]["text"] or "" for i in own) for own in groups], object)
    header = np.array([any(cells[i].get("header") for i in own) for own in groups])
    header[0] |= not header.any()
    head, body = "\n".join(lines[header]), lines[~header]
    if not len(body):
        return [head]
    total = sums([len(x) + 1 for x in body])
    out, at = [], 0
    while at < len(body):
        end = max(at + 1, reach(total, at, most - len(head)))
        out.append("\n".join([head, *body[at:end]]))
        at = end
    return out


def chunk_ends(length: np.ndarray, heading: np.ndarray, fresh: np.ndarray, joins: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Where chunks of items begin and end, of their lengths.

    A chunk ends before a fresh item, and before most would be passed, two characters parting its items. Headings alone
    are no chunk, unless they are past the bound themselves. An item that joins (the first part of a table) follows headings
    alone whatever their size, and stands alone otherwise.
    """
    n = len(length)
    total = sums(length + 2)
    edges = np.append(np.flatnonzero(fresh), n)
    bodies = np.append(np.flatnonzero(~heading), n)
    at = 0
    while at < n:
        edge = int(edges[np.searchsorted(edges, at, "right")])
        body = int(bodies[np.searchsorted(bodies, at)])
        over = reach(total, at, most + 2)
        end = over if body < over else over + 1
        if joins[edge - 1] and at < edge - 1 < n:
            # The stretch ends with a table's first part.
            end = min(end, edge - 1) if body < edge - 1 else end if end < edge - 1 else edge
        end = min(end, edge)
        yield at, end
        at = end


def cut(blocks: list[dict], by: str, most: int) -> list[dict]:
    """Chunks (texts, refs, pages) of one document's blocks (page, ref, kind, text, cells) in their order.

    By page a chunk is a page, by section it begins at a heading; both end before most characters would be passed. A table that
    is longer is cut between its rows. Furniture and blocks without a text are left out.
    """
    items: list[tuple[str, dict, int, bool]] = []
    for b in blocks:
        if b["kind"] in FURNITURE or not b["text"]:
            continue
        parts = table_parts(b["cells"], most) if b.get("cells") and len(b["text"]) > most else []
        if len(parts) > 1:
            items += [(part, b, i + 1, i + 1 == len(parts)) for i, part in enumerate(parts)]
        else:
            items.append((b["text"], b, 0, False))
    if not items:
        return []
    texts, own, part, last = zip(*items, strict=True)
    part = np.array(part)
    heading = np.array([b["kind"] in HEADINGS for b in own]) & (part == 0)
    fresh = (part > 1) | np.array([True, *last[:-1]])
    if by == "page":
        pages = np.array([b["page"] for b in own])
        fresh[1:] |= pages[1:] != pages[:-1]
    else:
        fresh[1:] |= heading[1:] & ~heading[:-1]
    ends = chunk_ends(np.array([len(t) for t in texts]), heading, fresh, part == 1, most)
    return [{"texts": list(texts[a:z]), "refs": list(dict.fromkeys(b["ref"] for b in own[a:z])), "pages": list(dict.fromkeys(b["page"] for b in own[a:z]))} for a, z in ends]


def chunks(blocks: DataFrame, by: str = "section", max_chars: int = DEFAULT_CHARS) -> DataFrame:
    """parse_id, id (c1 ..), text, pages, blocks. blocks: parse_id, page, ord, ref, state, kind, text, and cells if any.

    Blocks of pages that didn't succeed, furniture, and null or empty texts are left out; a parse with nothing else has no
    row, nor has an empty table. Repeated blocks are each given.
    """
    if by not in ("page", "section") or not MIN_CHARS <= max_chars <= MAX_CHARS:
        raise ValueError("by is page or section, max_chars 200 to 100,000")
    columns = ["parse_id", "page", "ord", "ref", "kind", "text", *(["cells"] if "cells" in blocks.columns else [])]
    own = blocks.where((F.col("state") == "succeeded") & (F.col("text") != "")).select(*columns)
    names = ["parse_id", "id", "text", "pages", "blocks"]

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("page", "ascending"), ("ord", "ascending")])
        found = cut(rows.to_pylist(), by, max_chars)
        arrays = [
            pa.repeat(rows.column("parse_id")[0], len(found)), pa.array([f"c{i + 1}" for i in range(len(found))], pa.string()), pa.array(["\n\n".join(c["texts"]) for c in found], pa.string()),
            pa.array([c["pages"] for c in found], pa.list_(rows.schema.field("page").type)), pa.array([c["refs"] for c in found], pa.list_(pa.string())),
        ]
        return pa.Table.from_arrays(arrays, names)

    fields = [T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("pages", T.ArrayType(own.schema["page"].dataType)), T.StructField("blocks", T.ArrayType(T.StringType()))]
    return own.groupBy("parse_id").applyInArrow(run, T.StructType([own.schema["parse_id"], *fields]))


def text_cuts(text: bytes, room: int) -> list[bytes]:
    """The text in pieces of room bytes (4 at least) or less, no character cut."""
    marks = np.append(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))
    at = [0]
    while at[-1] < len(text):
        at.append(int(marks[np.searchsorted(marks, at[-1] + max(room, 4), "right") - 1]))
    return [text[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]


def pack(pieces: list[dict], budget: int, cuts: bool = True) -> list[tuple[str, list[str]]]:
    """Windows of (ref, text, section) pieces within a budget of bytes: whole sections, then whole blocks, then cut blocks.

    Each piece is a line "[ref] text"; a cut one repeats the lead, and no character is cut. A budget of 0 is none. Without
    cuts a block over the budget stays whole, in a window of its own.
    """
    whole = budget + 1 if budget > 0 else 1 << 62
    leads = [f"[{p['ref']}] ".encode() for p in pieces]
    texts = [p["text"].encode(errors="replace") for p in pieces]
    # A line costs itself and the newline before it; room for one newline more stands for the one a window's first line lacks.
    total = sums([len(a) + len(t) + 1 for a, t in zip(leads, texts, strict=True)])
    heads = np.array([i for i, p in enumerate(pieces) if i == 0 or p["section"]] + [len(pieces)])
    out: list[list[tuple[int, bytes]]] = [[]]
    room = whole

    def shut() -> None:
        nonlocal room
        if out[-1]:
            out.append([])
        room = whole

    def take(start: int, end: int) -> None:
        nonlocal room
        out[-1].extend((i, leads[i] + texts[i]) for i in range(start, end))
        room -= int(total[end] - total[start])

    at, section = 0, 0
    while section < len(heads) - 1:
        # As many whole sections as fit; then, in a window of its own, what fits of one that is too long.
        to = reach(total[heads], section, room)
        if to > section:
            take(int(heads[section]), int(heads[to]))
            section = to
            continue
        if room < whole:
            shut()
            continue
        at, end = int(heads[section]), int(heads[section + 1])
        while at < end:
            to = min(reach(total, at, room), end)
            if to > at:
                take(at, to)
                at = to
            elif room < whole:
                shut()
            elif not cuts:
                take(at, at + 1)
                at += 1
            else:
                for part in text_cuts(texts[at], budget - len(leads[at])):
                    shut()
                    out[-1].append((at, leads[at] + part))
                    room -= len(leads[at]) + len(part) + 1
                at += 1
        section += 1
    refs = [p["ref"] for p in pieces]
    return [(b"\n".join(line for _, line in own).decode(), [refs[i] for k, (i, _) in enumerate(own) if not k or refs[i] != refs[own[k - 1][0]]]) for own in out if own]


def windows(pieces: DataFrame, budget: int, cuts: bool = True) -> DataFrame:
    """parse_id, window (from 1), text, refs, code. A parse that takes more than MAX_WINDOWS has one row, its code too_many_pages.

    Without cuts a block over the budget is one window, whole. Null texts are no pieces; a parse without a piece has no row, nor has an empty table. Repeated pieces are each given.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("page", "ascending"), ("ord", "ascending")])
        found = pack([{"ref": r["ref"], "text": r["text"], "section": r["kind"] in HEADINGS} for r in rows.select(["ref", "text", "kind"]).to_pylist()], budget, cuts)
        code = "too_many_pages" if len(found) > MAX_WINDOWS else None
        found = [("", [])] if code else found
        arrays = [
            pa.repeat(rows.column("parse_id")[0], len(found)), pa.array(range(1, len(found) + 1), pa.int64()), pa.array([t for t, _ in found], pa.string()),
            pa.array([r for _, r in found], pa.list_(pa.string())), pa.array([code] * len(found), pa.string()),
        ]
        return pa.Table.from_arrays(arrays, ["parse_id", "window", "text", "refs", "code"])

    own = pieces.where("text is not null").select("parse_id", "page", "ord", "ref", "kind", "text")
    fields = T._parse_datatype_string("window long, text string, refs array<string>, code string").fields
    return own.groupBy("parse_id").applyInArrow(run, T.StructType([own.schema["parse_id"], *fields]))
