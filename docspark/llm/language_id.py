"""Language identification by compression: the dictionary that makes a text smallest names its language.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts. A text is
reduced to its letters in lower case and compressed in blocks, each on its own against every dictionary, so that late parts of a long text meet
the dictionary as its first part does; the language with the least sum wins. Where the margin to the second is narrow,
the text is rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.session import prepare

UNDETERMINED = "und"
#: The labelled sample by default: texts for each language (about), and characters taken from each.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 600
#: Bytes of a dictionary, bytes of a block.
DICTIONARY_BYTES, BLOCK_BYTES = 112 << 10, 4096
#: Matches of three bytes count: most of a short text's evidence is in them.
ZSTD = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 4, "min_match": 3, "target_length": 16}
#: A text whose margin is under MIN_MARGIN is rejected; the score reaches 1 at FULL_MARGIN.
MIN_MARGIN, FULL_MARGIN = 0.004, 0.1
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return _OTHER.sub(" ", text).lower()


def sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """About that many stretches of text for each language; the rows are chosen by a hash, alike in all partitions.

    labelled: key, text, lang. Two cheap passes: counts of each language, then the rows under its share. Every language is
    learned, so what comes to the driver is bounded by the languages: texts * chars characters for each.
    """
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    chance = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30))
    start = F.pmod(F.xxhash64("text", "key"), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    rows = (
        labelled.join(F.broadcast(counts), "lang")
        .where(chance < F.least(F.lit(1.0), 1.2 * texts / F.col("__n")) * (1 << 30))
        .select("lang", chance.alias("chance"), F.col("text").substr(start, F.lit(chars)).alias("part"))
        .distinct()
        .orderBy("lang", "chance", "part")
    )
    out: dict[str, list[str]] = {}
    for r in rows.toLocalIterator():
        own = out.setdefault(r.lang, [])
        if len(own) < texts:
            own.append(r.part)
    return out


@dataclass(frozen=True)
class Model:
    """dictionaries: raw content of each language."""

    dictionaries: dict[str, bytes]

    @classmethod
    def fit(cls, texts: dict[str, list[str]], size: int = DICTIONARY_BYTES) -> Model:
        return cls({lang: letters(" ".join(own)).encode("utf-8", "replace")[-size:] for lang, own in sorted(texts.items()) if own})


class Classifier:
    def __init__(self, model: Model):
        import zstandard as z

        bare = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        params = z.ZstdCompressionParameters(strategy=z.STRATEGY_GREEDY, **ZSTD, **bare)
        self.names = list(model.dictionaries)
        self.compressors = []
        for raw in model.dictionaries.values():
            own = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=params)
            self.compressors.append(z.ZstdCompressor(dict_data=own, compression_params=params).compress)

    def sizes(self, text: str) -> list[int]:
        raw = letters(text).encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(compress(b)) for b in blocks) for compress in self.compressors]

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)."""
        if text is None or not self.names or not _LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))
        best = order[0]
        margin = 1.0 if len(order) == 1 else (sizes[order[1]] - sizes[best]) / sizes[order[1]]
        return self.names[best], min(1.0, margin / FULL_MARGIN), margin, margin < MIN_MARGIN


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> Model:
    """Learn the dictionaries from labelled rows outside the held-out fold, at most SAMPLE_TEXTS for each language.

    A null id is in no fold; null and empty texts, and null languages, teach nothing. Copies count as often as they are
    chosen, equal stretches of one choice once. Every language is learned; a model takes DICTIONARY_BYTES for each.
    """
    prepare(df.sparkSession)
    labelled = df.select(df[id_col].alias("key"), df[text_col].alias("text"), df[lang_col].alias("lang")).where("lang is not null and text is not null and length(text) > 0")
    return Model.fit(sample(labelled.where(~in_fold(F.col("key"), folds, held_out))))


def classify(df: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of df, then lang_pred, score, margin and rejected of each whole text.

    A null text, or one without a letter, is und with score 0, and rejected; so is every text if nothing was learned.
    Ties go to the name that sorts first, with margin 0, and are rejected. Repeated rows are classified alike. Columns
    of df named as a result (prefix stands before the results' names) are left out; an empty table gives no rows.
    """
    prepare(df.sparkSession)
    results = [prefix + x for x in ("lang_pred", "score", "margin", "rejected")]
    kept = [c for c in df.columns if c not in results]
    own = df.select(*[df[c] for c in kept], df[text_col].cast("string").alias("__text"))
    types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())

    def run(batches):
        classifier = Classifier(model)
        for batch in batches:
            found = [classifier.classify(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            cols = [pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 4, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*kept, *results])

    schema = own.drop("__text").schema
    for name, kind in zip(results, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return own.mapInArrow(run, schema)
