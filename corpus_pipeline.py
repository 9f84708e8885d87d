"""From raw documents to packed sequences: five stages, each a pass over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontaminate, language_id, near_dedup, packing, toxicity
from docspark.llm.queries import tokenizer_path
from docspark.session import table, written


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear: those without a letter (null and empty texts among them) or with a narrow margin go.

    Where no document has a language to learn from, none can be told from another, and all stay. Repeated rows share their
    text's fate; an empty table stays empty. The columns are those of docs, which may have any names but __lang_pred,
    __score, __margin and __rejected.
    """
    model = language_id.fit(docs)
    if not model.dictionaries:
        return docs
    return language_id.classify(docs, model, prefix="__").where("not __rejected").select(docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic; all, where there are no labels of both kinds to learn from.

    Null and empty texts stay; repeated rows share their text's fate; an empty table stays empty. The columns are those of
    docs, which may have any names but __score and __predicted.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, prefix="__").where("__predicted = 0").select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates.

    Null and wordless texts are like nothing and stay; of repeated rows one stays; a document without an id stays unless its
    group has another; texts that share an id have their own fates. An empty table stays empty.
    """
    return near_dedup.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test string of the benchmark occurs; null and empty texts stay.

    Repeated rows share their text's fate; an empty table, or an empty benchmark, changes nothing.
    """
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, one row a piece, as op1's query gives them.

    A null or empty text is its end id alone; repeated rows are packed each on its own; other columns than doc_id and text are
    ignored; an empty table gives no rows.
    """
    return packing.digests(packing.pack(docs, tokenizer_path()))


STAGES = [
    ("language ID", keep_identified),
    ("toxicity", keep_civil),
    ("near duplicates", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("packing", pack_documents),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents, each on what the one before kept, written between them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
