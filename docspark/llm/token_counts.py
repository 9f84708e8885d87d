"""Token counts of documents in flat token files: a vectorised scan for end-of-document ids, joined by a prefix scan.

A flat token file is a bare run of ids; nothing tells where a document begins. It is read in blocks, by ranged reads, in any
order and on any executor: each block tells how many ids it has and where its separators are. What a block needs of the blocks
before it (ids, separators, the end of the last document) is an associative sum, so it comes from a prefix scan in two levels:
inside stretches of GROUP blocks, then over the stretches of a file. No task holds a file.

Files are told by rows: file_id, path, bytes, id_bytes (2 or 4, the width of an id) and separator, so neither is guessed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.flat_files import Files, id_type, reachable, reader
from docspark.llm.packing import STEP, documents_only
from docspark.llm.token_ids import encoder
from docspark.llm.words import not_null, steps
from docspark.session import prepare, written

#: The token that ends a document; special strings in texts are ordinary text, so no text holds its id.
END = "<|endoftext|>"
#: Ids in one block of a file, and blocks in one stretch of the prefix scan.
BLOCK_IDS, GROUP = 1 << 16, 1024
#: Document ids in one row of a manifest, and bytes of files that one task scans.
MANIFEST_ROWS, TASK_BYTES = 1 << 12, 8 << 20

_FILE = "file_id long, path string, bytes long, id_bytes int, separator long"


def write_files(df: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", separator: int | None = None) -> DataFrame:
    """Each partition's texts as one flat token file in the folder; the ids are of 16 bits where the vocabulary fits.

    Rows: the file (file_id, path, bytes, id_bytes, separator), and its manifest (file_id, first_index, doc_ids), which only
    names the documents in their order. Read them from a written table: running the rows again writes other files.
    separator: an id that no text holds, by default that of END. A null or empty text is its separator alone; a null id stays
    null; repeated rows are written each; other columns are ignored; an empty partition has no file.
    """
    prepare(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, True)
        kind = id_type(own.tokenizer.get_vocab_size())
        end = own.tokenizer.token_to_id(END) if separator is None else separator
        if end is None or not 0 <= end <= np.iinfo(kind).max:
            raise ValueError(f"{end} can't be the separator of ids of {kind}")
        file_id = TaskContext.get().partitionId()
        files = Files(folder, file_id)
        names: list[int | None] = []
        index = 0

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((file_id, *values), _TYPES, strict=True)], _NAMES)

        try:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for a, b, data, bounds in steps(not_null(batch.column(1)), STEP):
                    files.append("tokens", own.encode(data, bounds, end).ids.astype(kind))
                    names += doc_ids[a:b]
                    while len(names) >= MANIFEST_ROWS:
                        yield row(None, None, None, None, index, names[:MANIFEST_ROWS])
                        names, index = names[MANIFEST_ROWS:], index + MANIFEST_ROWS
        finally:
            files.close()
        if names:
            yield row(None, None, None, None, index, names)
        if files.sizes:
            yield row(files.path("tokens"), files.sizes["tokens"], np.dtype(kind).itemsize, end, None, None)

    return documents_only(df, id_col, text_col).mapInArrow(run, f"{_FILE}, first_index long, doc_ids array<long>")


_NAMES = ["file_id", "path", "bytes", "id_bytes", "separator", "first_index", "doc_ids"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def blocks_of(files: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The files' blocks as ranges, dealt out over tasks: file_id, block_no, path, offset, size, id_bytes, separator.

    An empty file has no block.
    """
    own = files.where("bytes > 0")
    total = own.agg(F.sum("bytes")).first()[0] or 0
    step = F.col("id_bytes") * block_ids
    ranges = own.select("file_id", F.explode(F.sequence(F.lit(0), F.ceil(F.col("bytes") / step) - 1)).alias("block_no"), "path", "bytes", "id_bytes", "separator")
    ranges = ranges.select("file_id", F.col("block_no").cast("long").alias("block_no"), "path", (F.col("block_no") * step).alias("offset"), F.least(step.cast("long"), F.col("bytes") - F.col("block_no") * step).alias("size"), "id_bytes", "separator")
    return ranges.repartition(max(1, -(-total // TASK_BYTES)), "file_id", F.floor(F.col("block_no") / 16))


def read_files(spark: SparkSession, path: str, separator: int, id_bytes: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Raw token files below path as blocks, file_id being a file's path.

    Blocks are ranges, read where they are scanned, and a file may be of any size. Where only Spark's readers reach the files,
    blocks hold their content (payload) and a file may have up to 2 GB.
    """
    files = prepare(spark).read.format("binaryFile").load(path)
    named = [F.lit(id_bytes).alias("id_bytes"), F.lit(separator).cast("long").alias("separator")]
    if reachable(path):
        return blocks_of(files.select(F.col("path").alias("file_id"), "path", F.col("length").alias("bytes"), *named), block_ids)
    step = id_bytes * block_ids
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.col("length") / step).cast("int") - 1), lambda i: F.substring("content", i * step + 1, F.lit(step)))
    return files.where("length > 0").select(F.col("path").alias("file_id"), F.posexplode(parts).alias("block_no", "payload"), *named)


def separators(blocks: DataFrame) -> DataFrame:
    """file_id, block_no, n (ids), ends (places in the block behind each separator).

    blocks: file_id, block_no, id_bytes, separator, and payload or else path, offset and size.
    """
    ranged = "payload" not in blocks.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with reader() as files:
            for batch in batches:
                counts, ends = [], []
                for r in batch.slice(0).to_pylist() if ranged else zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                    width, end, raw = (r["id_bytes"], r["separator"], files.read(r["path"], r["offset"], r["size"])) if ranged else (r[0], r[1], r[2].as_buffer() if r[2].is_valid else b"")
                    ids = np.frombuffer(raw, f"<u{width}", len(raw) // width if not isinstance(raw, pa.Buffer) else raw.size // width)
                    counts.append(len(ids))
                    ends.append(np.flatnonzero(ids == end) + 1)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ends])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ends) if ends else np.empty(0, np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), lists], ["file_id", "block_no", "n", "ends"])

    own = blocks.select("file_id", F.col("block_no").cast("long").alias("block_no"), "id_bytes", "separator", *(["path", "offset", "size"] if ranged else ["payload"]))
    return own.mapInArrow(run, T.StructType([own.schema["file_id"], own.schema["block_no"], T.StructField("n", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]))


def prefix_scan(found: DataFrame, group: int = GROUP) -> DataFrame:
    """separators' rows with what stands before each block in its file: ids, docs, and open (where the open document began).

    No two blocks of a file may share a block_no; numbers may be missing. An empty table gives no rows.
    """
    stretch = F.floor(F.col("block_no") / group)
    rows = found.withColumn("stretch", stretch)
    inner = Window.partitionBy("file_id", "stretch").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    rows = rows.withColumn("ids", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    rows = rows.withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(inner), F.lit(0))).withColumn("open", F.max(F.col("ids") + last).over(inner))
    sums = found.withColumn("stretch", stretch).groupBy("file_id", "stretch").agg(F.sum("n").alias("n"), F.sum(F.size("ends")).alias("d"))
    ends = rows.groupBy("file_id", "stretch").agg(F.max(F.col("ids") + last).alias("last"))
    outer = Window.partitionBy("file_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.join(ends, ["file_id", "stretch"])
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    sums = sums.select("file_id", "stretch", "base", F.coalesce(F.sum("d").over(outer), F.lit(0)).alias("base_docs"), F.coalesce(F.max(F.col("base") + F.col("last")).over(outer), F.lit(0)).alias("base_open"))
    return rows.join(sums, ["file_id", "stretch"]).select(
        "file_id", "block_no", "n", "ends", (F.col("base") + F.col("ids")).alias("ids"), (F.col("base_docs") + F.col("docs")).alias("docs"), F.coalesce(F.col("base") + F.col("open"), F.col("base_open")).alias("open")
    )


def count_tokens(blocks: DataFrame) -> DataFrame:
    """One row per document of each file: file_id, doc_index (from 0), start (ids before it), n_tokens, closed.

    n_tokens leaves out the separator. Ids behind a file's last separator are a document with closed = false. Empty
    documents (two separators in a row) count; a null or empty block adds nothing; an empty table gives no rows. Blocks
    of a file are told apart by block_no: no two may share it. The files are scanned once, the places written.
    """
    prepare(blocks.sparkSession)
    scanned = prefix_scan(written(separators(blocks), "separators"))
    ends = F.transform("ends", lambda e: e + F.col("ids"))
    starts = F.concat(F.array("open"), ends)
    closed = scanned.select("file_id", "docs", F.posexplode(F.arrays_zip(ends.alias("e"), F.slice(starts, F.lit(1), F.size("ends")).alias("s"))).alias("i", "d")).select(
        "file_id", (F.col("docs") + F.col("i")).alias("doc_index"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s") - 1).alias("n_tokens"), F.lit(True).alias("closed")
    )
    last = scanned.groupBy("file_id").agg(
        F.max(F.col("ids") + F.col("n")).alias("total"), F.max(F.col("docs") + F.size("ends")).alias("doc_index"), F.max(F.greatest("open", F.coalesce(F.element_at(F.concat(F.array(F.lit(0).cast("long")), ends), -1), F.lit(0)))).alias("start")
    )
    rest = last.where("total > start").select("file_id", "doc_index", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def manifest(files: DataFrame) -> DataFrame:
    """file_id, doc_index, doc_id of write_files' documents, in their order; a null id and repeated ids stay."""
    rows = files.where("doc_ids is not null").select("file_id", "first_index", F.posexplode("doc_ids").alias("i", "doc_id"))
    return rows.select("file_id", (F.col("first_index") + F.col("i")).alias("doc_index"), "doc_id")
