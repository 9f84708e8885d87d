"""Best-fit-decreasing packing of token ids into rows of a matrix.

Documents longer than a row are split into full rows and a rest, without loss. Rests and short documents, longest
first, go to the row with the least room that still holds them; a segment tree over room sizes finds it in
logarithmic time. Packing runs over stretches of a partition's stream, so a task holds SEGMENT tokens.

Matrices are written as flat files: a task's ids and positions row after row, its cumulative segment lengths and where each
row's begin. A manifest tells the files, and from it rows are read back by their places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.flat_files import Files, id_type, reader
from docspark.llm.packing import WIDTH, documents_only, encoded_parts
from docspark.session import prepare

#: Tokens packed together, unless a single batch has more.
SEGMENT = 1 << 20
PAD = 0

SCHEMA = "sequence_id long, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<long>, ids binary, position_ids binary"


class Rooms:
    """Rows by the room left in them. tree[i] counts the rows below node i; the leaves are the room sizes."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.leaves
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of the row with the least room of size or more, taken out."""
        i = size + self.leaves
        tree = self.tree
        if not tree[i]:
            # Up until a right neighbour has rows, then down to its leftmost.
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        while i:
            tree[i] -= 1
            i >>= 1
        return room, row


def best_fit_decreasing(sizes: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """The row of each piece, none longer than width, and how many rows there are."""
    rooms, row_of, n = Rooms(width), np.empty(len(sizes), np.int64), 0
    listed = sizes.tolist()
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = listed[k]
        found = rooms.take(size)
        if found is None:
            room, row = width, n
            n += 1
        else:
            room, row = found
        row_of[k] = row
        if room > size:
            rooms.put(room - size, row)
    return row_of, n


def rows_of(doc_ids: np.ndarray, ids: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, starts, lengths, places in ids) of the pieces in each row, for documents at first in ids."""
    sizes = np.diff(first)
    pieces = np.maximum(1, -(-sizes // width))
    doc = np.repeat(np.arange(len(sizes)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * width
    length = np.minimum(width, sizes[doc] - start)
    row_of, n = best_fit_decreasing(length, width)
    order = np.lexsort((start, doc, row_of))
    bounds = np.searchsorted(row_of[order], np.arange(n + 1))
    for k in range(n):
        own = order[bounds[k] : bounds[k + 1]]
        yield doc_ids[doc[own]].tolist(), start[own], length[own], first[doc[own]] + start[own]


def _packed(parts: Iterable, width: int, segment: int) -> Iterator[tuple]:
    held: list = []
    size = 0
    for doc_ids, encoded in parts:
        held.append((doc_ids, encoded))
        size += len(encoded.ids)
        if size >= segment:
            yield from _rows(held, width)
            held, size = [], 0
    if held:
        yield from _rows(held, width)


def _rows(held: list, width: int) -> Iterator[tuple]:
    ids = np.concatenate([e.ids for _, e in held]).astype("<u4")
    base = np.cumsum([0] + [len(e.ids) for _, e in held])
    first = np.concatenate([[0], *(e.first[1:] + b for (_, e), b in zip(held, base, strict=False))])
    for names, starts, lengths, places in rows_of(np.concatenate([d for d, _ in held]), ids, first, width):
        yield names, starts, lengths, [ids[p : p + n] for p, n in zip(places.tolist(), lengths.tolist(), strict=True)]


def pack_matrix(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, pad: int = PAD, segment: int = SEGMENT) -> DataFrame:
    """All texts' ids, each closed by the end id, as rows of an id matrix of that width.

    Returns one row per sequence: sequence_id, n_tokens (the rest of the row is padding), doc_ids and starts (ids of
    its document before each segment), cu_seqlens (0, then each segment's end), ids (width little-endian unsigned
    32-bit ids) and position_ids (width positions: from 0 in each segment, 0 in the padding; of 16 bits, or of 32 where the
    width is over 65,536). A null or empty
    text is its end id alone; repeated rows are packed each on its own; a null id stays null; other columns are
    ignored; an empty table gives no rows.
    """
    if width < 1:
        raise ValueError("a row holds one id at least")
    prepare(df.sparkSession)

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        out: list[tuple] = []

        def batch():
            cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        many = pa.list_(pa.int64())
        types = [pa.int64(), pa.int64(), many, many, many, pa.binary(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for doc_ids, starts, lengths, segments in _packed(encoded_parts(batches, tokenizer), width, segment):
            ends = np.concatenate([[0], np.cumsum(lengths)])
            n = int(ends[-1])
            row = np.full(width, pad, "<u4")
            row[:n] = np.concatenate(segments)
            positions = np.zeros(width, id_type(width))
            positions[:n] = np.arange(n) - np.repeat(ends[:-1], lengths)
            out.append((at, n, doc_ids, starts, ends, row.tobytes(), positions.tobytes()))
            at += 1
            if len(out) >= 512:
                yield batch()
        if out:
            yield batch()

    return documents_only(df, id_col, text_col).mapInArrow(run, SCHEMA)


KINDS = ("ids", "positions", "lengths", "bounds", "docs", "starts")
_NO_ID = -(1 << 63)
MANIFEST = "part long, rows long, width int, id_bytes int, position_bytes int, first_sequence long, " + ", ".join(f"{k} string" for k in KINDS)


def write_matrices(packed: DataFrame, folder: str, width: int = WIDTH, vocabulary: int = 1 << 32) -> DataFrame:
    """pack_matrix's rows as files in the folder, and a manifest: one row per part with rows.

    ids and positions: rows * width numbers, of id_bytes (2 where all ids, fewer than vocabulary, fit) and of position_bytes. lengths: every row's cumulative segment
    lengths (from 0), end to end, as 64-bit numbers; bounds: where each row's begin in them, and the end. docs and starts: each
    segment's document (the least number for none) and its place there, signed 64-bit numbers. All are little-endian. Read the manifest from a written table: running its rows again writes other files. A part without
    rows has no files and no row.
    """
    kind, id_kind = id_type(width), id_type(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, rows, end, first = Files(folder, part), 0, 0, None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if len(r["ids"]) != 4 * width or len(r["position_ids"]) != np.dtype(kind).itemsize * width:
                        raise ValueError(f"a row isn't of width {width}")
                    first = r["sequence_id"] if first is None else first
                    ids = np.frombuffer(r["ids"], "<u4")
                    if ids.max() >= vocabulary:
                        raise ValueError(f"an id isn't below {vocabulary}")
                    files.append("ids", ids.astype(id_kind))
                    files.append("positions", np.frombuffer(r["position_ids"], kind))
                    files.append("lengths", np.array(r["cu_seqlens"], "<u8"))
                    files.append("bounds", np.array([end], "<u8"))
                    files.append("docs", np.array([_NO_ID if d is None else d for d in r["doc_ids"]], "<i8"))
                    files.append("starts", np.array(r["starts"], "<i8"))
                    rows, end = rows + 1, end + len(r["cu_seqlens"])
            if rows:
                files.append("bounds", np.array([end], "<u8"))
        finally:
            files.close()
        if rows:
            values = [part, rows, width, np.dtype(id_kind).itemsize, np.dtype(kind).itemsize, first, *map(files.path, KINDS)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.string()] * len(KINDS)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    return packed.select("sequence_id", "doc_ids", "starts", "cu_seqlens", "ids", "position_ids").mapInArrow(run, MANIFEST)


def read_matrices(manifest: DataFrame, rows: int = 256) -> DataFrame:
    """What pack_matrix gave, part and row for sequence_id, of every row in a manifest's files, read rows at a time."""
    stretches = manifest.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(rows).cast("long"))).alias("at"))
    schema = "part long, row long, " + SCHEMA.removeprefix("sequence_id long, ")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as stack:
            files = {k: stack.enter_context(reader()) for k in KINDS}
            for batch in batches:
                for m in batch.to_pylist():
                    at, n = m["at"], min(rows, m["rows"] - m["at"])
                    numbers = lambda k, a, z, kind="<i8", m=m: np.frombuffer(files[k].read(m[k], 8 * int(a), 8 * int(z - a)), kind).astype(np.int64)
                    wide = lambda k, size, m=m, at=at, n=n: _rows_of(files[k].read(m[k], size * at, size * n), size)
                    edges = numbers("bounds", at, at + n + 1, "<u8")
                    # A row has one segment less than it has bounds of segments.
                    own = edges - np.arange(at, at + n + 1)
                    lengths, docs, starts = numbers("lengths", edges[0], edges[-1], "<u8"), numbers("docs", own[0], own[-1]), numbers("starts", own[0], own[-1])
                    listed = lambda e, values: pa.ListArray.from_arrays(pa.array((e - e[0]).astype(np.int32)), values)
                    columns = [
                        pa.array([m["part"]] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(lengths[edges[1:] - edges[0] - 1]), listed(own, pa.array(docs, mask=docs == _NO_ID)), listed(own, pa.array(starts)), listed(edges, pa.array(lengths)),
                        pa.array([np.frombuffer(x, f"<u{m['id_bytes']}").astype("<u4").tobytes() for x in wide("ids", m["id_bytes"] * m["width"])], pa.binary()), pa.array(wide("positions", m["position_bytes"] * m["width"]), pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return stretches.mapInArrow(run, schema)


def _rows_of(raw: bytes, size: int) -> list[bytes]:
    return [raw[a : a + size] for a in range(0, len(raw), size)]


def digests(rows: DataFrame) -> DataFrame:
    """read_matrices' rows with checksums in place of the two matrices."""
    return rows.select("part", "row", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))
