"""Order-preserving packing: cuts of a token stream chosen by dynamic programming.

The documents of a partition form one stream of ids, each closed by an end id. Candidate cuts are the ends of
documents, the ends of sentences and lines, and, where neither is near, every FILL tokens. A window costs its padding
plus what its closing cut truncates; the cheapest chain of windows is found with a monotone queue in one pass, for the
best predecessor within a window's reach is a minimum over a sliding range. A window whose length is a power of two
needs no padding. What is left at a partition's end is cut into powers of two where that is cheaper than padding.

Only a bounded stretch of the stream is held: past SEGMENT tokens the cheapest chain of the stretch is settled, all its windows
but the last. So chains are the cheapest of their stretches, not of the whole stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.token_ids import END_OF_DOCUMENT, Encoded, encoder
from docspark.llm.words import not_null, steps
from docspark.session import prepare

WIDTH = 2048
#: What a cut costs in tokens of padding: at a document's end, a sentence's or line's end, elsewhere; and for an extra window.
AT_DOCUMENT, AT_SENTENCE, INSIDE, SHORT = 0, 1, 6, 4
#: Tokens between candidate cuts where no sentence ends.
FILL = 32
#: Tokens of a stream that are held at once, unless a single batch has more.
SEGMENT = 1 << 18
#: Bytes of text encoded in one step.
STEP = 1 << 20

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def candidates(n: int, document_ends: np.ndarray, breaks: np.ndarray, fill: int = FILL) -> tuple[np.ndarray, np.ndarray]:
    """Positions from 0 to n where a window may end, and what a cut there costs."""
    own = np.unique(np.concatenate([[0, n], document_ends, breaks]))
    gaps = np.diff(own)
    wide = np.flatnonzero(gaps > fill)
    if len(wide):
        more = (gaps[wide] - 1) // fill
        step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        own = np.unique(np.concatenate([own, np.repeat(own[wide], more) + fill * step]))
    cost = np.full(len(own), INSIDE)
    cost[np.isin(own, breaks, assume_unique=True)] = AT_SENTENCE
    cost[np.isin(own, document_ends, assume_unique=True)] = AT_DOCUMENT
    return own, cost


def exactly(at: np.ndarray, back: int) -> list[int]:
    """For each position the index of the one that lies back before it; -1 if none does."""
    found = np.searchsorted(at, at - back)
    found[(at < back) | (at[found] != at - back)] = -1
    return found.tolist()


def best_cuts(at: np.ndarray, cost: np.ndarray, width: int = WIDTH) -> list[int]:
    """The cheapest chain of windows from the first to the last position: the windows' ends.

    least[j] = cost[j] + min(least[i] + width - (at[j] - at[i]) over i with at[j] - at[i] <= width,
    least[i] + SHORT over i with at[j] - at[i] a lesser power of two).
    """
    positions, costs = at.tolist(), cost.tolist()
    shorter = [exactly(at, width >> k) for k in (1, 2, 3) if width >> k > 0]
    pairs = list(zip(*shorter, strict=True)) if shorter else [()] * len(positions)
    none = (-1,) * len(shorter)
    least, back, key = [0] * len(positions), [0] * len(positions), [0] * len(positions)
    queue: deque[int] = deque()
    for j in range(1, len(positions)):
        here = positions[j]
        k = key[j - 1]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j - 1)
        while positions[queue[0]] < here - width:
            queue.popleft()
        i = queue[0]
        value = key[i] + width - here
        if pairs[j] != none:
            for h in pairs[j]:
                if h >= 0 and least[h] + SHORT < value:
                    value, i = least[h] + SHORT, h
        value += costs[j]
        least[j], back[j], key[j] = value, i, value + here
    chain = []
    j = len(positions) - 1
    while j > 0:
        chain.append(positions[j])
        j = back[j]
    return chain[::-1]


def powers_of_two(start: int, length: int, width: int = WIDTH) -> list[int]:
    """Ends of the windows that hold length tokens from start: one padded, or powers of two if that costs less."""
    if length.bit_count() == 1 or (length.bit_count() - 1) * (INSIDE + SHORT) >= width - length:
        return [start + length]
    ends = []
    for bit in range(length.bit_length() - 1, -1, -1):
        if length >> bit & 1:
            start += 1 << bit
            ends.append(start)
    return ends


class Stream:
    """The stretch of a partition's stream whose windows aren't settled, as arrays; positions count from its begin."""

    def __init__(self, width: int = WIDTH, segment: int = SEGMENT):
        self.width, self.segment, self.sequences = width, segment, 0
        self.ids = np.empty(0, np.uint32)
        self.breaks = np.empty(0, np.int64)
        self.doc_ids = np.empty(0, object)
        self.doc_from = np.empty(0, np.int64)
        self.doc_upto = np.empty(0, np.int64)

    def add(self, doc_ids: np.ndarray, encoded: Encoded) -> None:
        n = len(self.ids)
        self.ids = np.concatenate([self.ids, encoded.ids])
        self.breaks = np.concatenate([self.breaks, encoded.breaks + n])
        self.doc_ids = np.concatenate([self.doc_ids, doc_ids])
        self.doc_from = np.concatenate([self.doc_from, encoded.first[:-1] + n])
        self.doc_upto = np.concatenate([self.doc_upto, encoded.first[1:] + n])

    def flush(self, last: bool) -> dict | None:
        """The pieces of all windows that are settled now, as columns."""
        n = len(self.ids)
        if not n:
            return None
        ends = best_cuts(*candidates(n, self.doc_upto, self.breaks), self.width)
        if last:
            begin = ends[-2] if len(ends) > 1 else 0
            ends[-1:] = powers_of_two(begin, n - begin, self.width)
        else:
            ends.pop()
            if not ends:
                return None
        ends = np.array(ends)
        done = int(ends[-1])
        cuts = np.unique(np.concatenate([ends, self.doc_upto[self.doc_upto < done]]))
        begins = np.concatenate([[0], cuts[:-1]])
        doc = np.searchsorted(self.doc_upto, begins, "right")
        sequence = np.searchsorted(ends, begins, "right")
        first = np.concatenate([[0], ends])[sequence]
        raw = self.ids.astype("<u4", copy=False)
        out = {
            "doc_id": self.doc_ids[doc],
            "start": begins - self.doc_from[doc],
            "length": cuts - begins,
            "doc_tokens": (self.doc_upto - self.doc_from)[doc],
            "sequence_id": sequence + self.sequences,
            "offset": begins - first,
            "ids": (raw[:done].tobytes(), cuts),
        }
        self.sequences += len(ends)
        keep = self.doc_upto > done
        self.ids = self.ids[done:]
        self.breaks = self.breaks[self.breaks > done] - done
        self.doc_ids = self.doc_ids[keep]
        self.doc_from, self.doc_upto = self.doc_from[keep] - done, self.doc_upto[keep] - done
        return out

    def take(self, parts: Iterable[tuple[np.ndarray, Encoded]]) -> Iterator[dict]:
        for doc_ids, encoded in parts:
            self.add(doc_ids, encoded)
            if len(self.ids) >= self.segment and (out := self.flush(False)):
                yield out
        if out := self.flush(True):
            yield out


def encoded_parts(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[tuple[np.ndarray, Encoded]]:
    """(ids of documents, their tokens) for batches of (id, text as bytes)."""
    own = encoder(path)
    for batch in batches:
        doc_ids = np.array(batch.column(0).to_pylist(), object)
        for a, b, data, bounds in steps(not_null(batch.column(1)), STEP):
            yield doc_ids[a:b], own.encode(data, bounds, END_OF_DOCUMENT)


def documents_only(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("binary").alias("text"))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Pack all texts' ids, in their order in each partition, into sequences of at most width tokens.

    Returns one row per piece: doc_id, start (ids of its document before it), length, doc_tokens (its document's ids,
    the end id included), sequence_id, offset (place in the sequence), ids (little-endian unsigned 32-bit).
    Each id of each document lies in one piece. A null or empty text is its end id alone. A null id stays null.
    Repeated rows are packed each on its own; other columns are ignored; an empty table gives no rows.
    """
    prepare(df.sparkSession)

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        for out in Stream(width).take(encoded_parts(batches, tokenizer)):
            raw, cuts = out.pop("ids")
            offsets = np.concatenate([[0], cuts]).astype(np.int32) * 4
            ids = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
            out["sequence_id"] = out["sequence_id"] + base
            arrays = [pa.array(v.tolist() if v.dtype == object else v, pa.int64()) for v in out.values()]
            yield pa.RecordBatch.from_arrays([*arrays, ids], [*out, "ids"])

    return documents_only(df, id_col, text_col).mapInArrow(run, SCHEMA)


def digests(packed: DataFrame) -> DataFrame:
    """pack's rows with a checksum in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
