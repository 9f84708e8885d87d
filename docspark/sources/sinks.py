"""Where results go: Parquet by parse, and one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.views import as_ndjson

#: Folders that parses are dealt to, so a table of many parses has neither a folder each nor one file for all.
BUCKETS = 256


def bucket(key: str = "parse_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_blocks(blocks: DataFrame, path: str, key: str = "parse_id", buckets: int = BUCKETS) -> None:
    """Blocks as Parquet in a folder for each bucket of parses, sorted by parse and place: a parse's read prunes to one."""
    rows = blocks.withColumn("bucket", bucket(key, buckets))
    rows.repartition("bucket").sortWithinPartitions(key, "page", "ord").write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str, parse_id: int | None = None, key: str = "parse_id", buckets: int = BUCKETS) -> DataFrame:
    rows = spark.read.parquet(path)
    if parse_id is None:
        return rows.drop("bucket")
    number = spark.range(1).select(F.pmod(F.xxhash64(F.lit(parse_id).cast("bigint")), F.lit(buckets)).cast("int").alias("b")).first().b
    return rows.where((F.col("bucket") == number) & (F.col(key) == parse_id)).drop("bucket")


def write_ndjson(rows: DataFrame, path: str, key: str = "parse_id", order: tuple[str, ...] = ("page", "ord")) -> None:
    as_ndjson(rows, key, order).write.text(path)


def result_key(parse_id, token, name: str):
    """parses/<id>/<token>/<name>: the lease's token keeps a late writer from another's object."""
    return F.concat_ws("/", F.lit("parses"), parse_id.cast("string"), token.cast("string"), F.lit(name))
