"""Benchmark decontamination: Wu-Manber search for many test strings, with words as the symbols.

Test strings are runs of ten consecutive words of a benchmark item (all words of a shorter item). For each length m of
test strings there is a shift table over blocks of two words: a block that no test string holds lets the search jump
m - 1 words, a block inside one jumps to where that test string could end, and only a block that ends a test string
stops it; the bucket of that suffix block then names the test strings, which are compared word by word.

The search runs in lanes: a text is dealt into stretches of LANE words, and one numpy step moves every lane's cursor by
its shift. Items are held in the workers up to BOUND bytes of text; a larger benchmark is searched in so many passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.token_ids import HashTable
from docspark.llm.words import ALNUM_LOWER, mix, not_null, steps, words_of
from docspark.session import prepare, written

WINDOW = 10
BLOCK = 2
#: Words that one lane of the search covers.
LANE = 256
#: Bytes of item texts in one search.
BOUND = 8 << 20
STEP = 1 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


class Strings:
    """Test strings of one length, as rows of word hashes, with the tables that find them."""

    def __init__(self, rows: np.ndarray, items: list[list[int]]):
        self.rows, self.items = rows, items
        self.m = m = rows.shape[1]
        self.block = b = min(BLOCK, m)
        blocks = np.stack([blocks_of(rows[:, i : i + b].T) for i in range(m - b + 1)], 1)
        shift = np.broadcast_to(np.arange(m - b, -1, -1), blocks.shape)
        keys, where = np.unique(blocks.ravel(), return_inverse=True)
        self.shifts = np.full(len(keys) + 1, m - b + 1)
        np.minimum.at(self.shifts, where.ravel(), shift.ravel())
        self.table = HashTable(max(8, int(4 * len(keys)).bit_length()))
        self.table.add(keys)
        # The suffix buckets: test strings in the order of their last block's number.
        last = self.table.find(blocks[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange(len(keys) + 1))

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, number of the test string) of all occurrences inside one text each."""
        m, b = self.m, self.block
        counts = np.diff(first) - (m - 1)
        own = np.flatnonzero(counts > 0)
        # Lanes: ends of windows begin, begin + 1, .. upto - 1.
        lanes = -(-counts[own] // LANE)
        step = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(first[own] + m - 1, lanes) + step * LANE
        upto = np.minimum(begin + LANE, np.repeat(first[own + 1], lanes))
        at, stop = begin, upto
        found_at, found = [], []
        while len(at):
            block = blocks_of([hashes[at - b + 1 + i] for i in range(b)])
            number = self.table.find(block)
            shift = self.shifts[number]
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                which = number[hit]
                size = self.bucket[which + 1] - self.bucket[which]
                begin = np.repeat(at[hit] - m + 1, size)
                inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                string = self.order[np.repeat(self.bucket[which], size) + inner]
                for i in range(m):
                    same = hashes[begin + i] == self.rows[string, i]
                    begin, string = begin[same], string[same]
                found_at.append(begin)
                found.append(string)
                shift[hit] = 1
            at = at + shift
            more = at < stop
            at, stop = at[more], stop[more]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)


def blocks_of(parts) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        out = mix(out ^ x)
    return np.where(out == 0, np.uint64(1), out)


def test_strings(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[Strings]:
    """The distinct test strings of (id, text) items, by their length."""
    by_length: dict[int, dict[bytes, list[int]]] = {}
    for k, (_, text) in enumerate(items):
        data = np.frombuffer(text, np.uint8)
        if not len(data):
            continue
        hashes = words_of(data, np.array([0, len(data)]), ALNUM_LOWER).hashes
        m = min(window, len(hashes))
        for i in range(len(hashes) - m + 1) if m else ():
            held = by_length.setdefault(m, {}).setdefault(hashes[i : i + m].tobytes(), [])
            if not held or held[-1] != k:
                held.append(k)
    return [Strings(np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), m), list(rows.values())) for m, rows in sorted(by_length.items())]


def search(data: np.ndarray, bounds: np.ndarray, strings: list[Strings]) -> tuple[np.ndarray, list[set[int]], list[list[tuple[int, int]]]]:
    """For each text: its words, the numbers of the items that occur, the merged spans of words hit."""
    words = words_of(data, bounds, ALNUM_LOWER)
    n = len(bounds) - 1
    items: list[set[int]] = [set() for _ in range(n)]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    begins, ends = [], []
    for own in strings:
        at, string = own.find(words.hashes, words.first)
        if len(at):
            begins.append(at)
            ends.append(at + own.m)
            text = np.searchsorted(words.first, at, "right") - 1
            for t, s in np.unique(np.stack([text, string], 1), axis=0).tolist():
                items[t].update(own.items[s])
    if begins:
        cover = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(cover, np.concatenate(begins), 1)
        np.add.at(cover, np.concatenate(ends), -1)
        hit = np.cumsum(cover) > 0
        # A span ends with its text, even where the next text begins with a hit.
        edge = np.diff(hit, prepend=False)
        edge[words.first[:-1][words.first[:-1] < len(hit)]] |= hit[words.first[:-1][words.first[:-1] < len(hit)]]
        starts = np.flatnonzero(edge & hit)
        stops = np.minimum(np.searchsorted(np.flatnonzero(~hit), starts), (~hit).sum() - 1)
        stops = np.flatnonzero(~hit)[stops]
        text = np.searchsorted(words.first, starts, "right") - 1
        stops = np.minimum(stops, words.first[text + 1])
        for t, a, z in zip(text.tolist(), (starts - words.first[text]).tolist(), (stops - words.first[text]).tolist(), strict=True):
            spans[t].append((a, z))
    return np.diff(words.first), items, spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _pass(df: DataFrame, items: list[tuple[str | None, bytes]], window: int, text: str | None) -> DataFrame:
    """Search items; with a column of that name, results of earlier passes stand beside it and the text stays."""

    def run(batches):
        strings = test_strings(items, window)
        for batch in batches:
            for a, b, data, bounds in steps(not_null(batch.column("text")), STEP):
                counts, own, spans = search(data, bounds, strings)
                part = batch.slice(a, b - a)
                names = [sorted({items[k][0] for k in s if items[k][0] is not None}) for s in own]
                if text:
                    names = [sorted({*x, *y}) for x, y in zip(names, part.column("items").to_pylist(), strict=True)]
                    before = part.column("spans").to_pylist()
                    spans = [merged([*x, *((s["start"], s["end"]) for s in y)]) for x, y in zip(spans, before, strict=True)]
                out = {
                    "doc_id": part.column("doc_id"),
                    "n_words": pa.array(counts, pa.int64()),
                    "n_hit": pa.array([sum(z - a for a, z in s) for s in spans], pa.int64()),
                    "items": pa.array(names, pa.list_(pa.string())),
                    "spans": pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                }
                if text:
                    out["text"] = part.column("text")
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return df.mapInArrow(run, SCHEMA + (", text binary" if text else ""))


def _passes(benchmark: DataFrame, item_col: str, text_col: str, bound: int) -> tuple[int, Iterator[list[tuple[str | None, bytes]]]]:
    """How many searches the items need, and the items of each, about bound bytes of text at a time."""
    wanted = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("binary").alias("text")).where("text is not null")
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // bound))

    def parts() -> Iterator[list[tuple[str | None, bytes]]]:
        for k in range(passes):
            part = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
            yield [(r.item, bytes(r.text)) for r in part.collect()]

    return passes, parts()


def contamination(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, bound: int = BOUND
) -> DataFrame:
    """Words of each text that lie in an occurrence of a test string of the benchmark.

    Returns per row: doc_id, n_words, n_hit, items (ids of items with an occurrence, sorted as strings), spans (merged
    runs of hit words, from the text's first word). Words are runs of 0-9, a-z and non-ASCII characters, A-Z counting
    as a-z. A null or empty text has no words and no hits; a null or wordless item has no test string; items with equal
    texts each count; an item without an id is searched, and counts in n_hit and spans but not in items; repeated rows each
    give a row; an empty benchmark hits nothing; other columns are ignored.
    """
    prepare(df.sparkSession)
    passes, parts = _passes(benchmark, item_col, item_text_col, bound)
    own = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("binary").alias("text"))
    if passes == 1:
        return _pass(own, next(parts), window, None)
    own = own.selectExpr("doc_id", "0L as n_words", "0L as n_hit", "cast(array() as array<string>) as items", "cast(array() as array<struct<start:long,end:long>>) as spans", "text")
    for items in parts:
        own = written(_pass(own, items, window, "text"), "decontaminate")
    return own.drop("text")


def uncontaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, bound: int = BOUND) -> DataFrame:
    """The rows of df, all columns, in whose text no test string occurs. Nothing is shuffled.

    A null or empty text stays; repeated rows share their text's fate; an empty table stays empty, and an empty benchmark, or
    one of null and wordless texts, changes nothing.
    """
    prepare(df.sparkSession)
    schema = df.schema
    passes, parts = _passes(benchmark, item_col, item_text_col, bound)
    for items in parts:

        def run(batches, items=items):
            strings = test_strings(items, window)
            for batch in batches:
                for a, b, data, bounds in steps(not_null(batch.column(batch.num_columns - 1)), STEP):
                    _, found, _ = search(data, bounds, strings)
                    part = batch.slice(a, b - a).filter(pa.array([not x for x in found], pa.bool_()))
                    yield pa.RecordBatch.from_arrays(part.columns[:-1], names=schema.names)

        df = df.select("*", df[text_col].cast("binary").alias("__bytes")).mapInArrow(run, schema)
        df = written(df, "decontaminate") if passes > 1 else df
    return df


def digests(found: DataFrame) -> DataFrame:
    items = F.col("items")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
