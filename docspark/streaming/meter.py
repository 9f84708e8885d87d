"""The usage meter over a stream of settled attempts, and the change feed of parses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators.control import SUMS
from docspark.session import new_path

#: The slots of an event id; the most pages one read of the feed returns.
PAGE, PROGRESS, STATE, FEED = 0, 1, 2, 500


def hourly(stream: DataFrame, late: str = "2 hours", at: str = "at") -> DataFrame:
    """Sums by tumbling hour, group, owner, kind and reader, of a stream or a table; at is a timestamp.

    The watermark bounds the state: an hour's sums are final once it has passed by so much.
    """
    rows = stream.withWatermark(at, late) if stream.isStreaming else stream
    sums = rows.groupBy(F.window(at, "1 hour"), "group_id", "owner", "kind", "reader").agg(*[F.sum(x).alias(x) for x in SUMS])
    return sums.select(F.col("window.start").alias("hour"), "group_id", "owner", "kind", "reader", *SUMS)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over all that is there, into Parquet in the shared folder, and read its rows."""
    spark = stream.sparkSession
    out, marks = new_path(spark, f"{name}-rows"), new_path(spark, f"{name}-marks")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def as_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A file stream over Parquet at path."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def change_counter(history: DataFrame, tracked: list[str], entity: str = "entity", order: str = "at") -> DataFrame:
    """change: how often an entity's tracked columns have changed up to each row; its first row is 0."""
    w = Window.partitionBy(entity).orderBy(order)
    now, before = F.struct(*tracked), F.lag(F.struct(*tracked)).over(w)
    changed = (F.row_number().over(w) > 1) & ~now.eqNullSafe(before)
    return history.withColumn("__c", changed.cast("long")).withColumn("change", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def event_id(change: Column, slot: Column) -> Column:
    return change * 3 + slot


def feed(live: DataFrame, archived: DataFrame, after: Column, limit: int = FEED) -> DataFrame:
    """Pages (parse_id, page, state, event) that settled behind a point, oldest first, at most limit of each parse."""
    rows = live.unionByName(archived).where(F.col("event") > after)
    place = F.row_number().over(Window.partitionBy("parse_id").orderBy("event", "page"))
    return rows.withColumn("__n", place).where(F.col("__n") <= limit).drop("__n")


def resumed(after: Column, last: Column) -> Column:
    """Where a stream goes on: behind the event it names; from the begin if that is past the end or none."""
    return F.when(after.isNull() | (after > last) | (after < 0), 0).otherwise(after)


def progress(history: DataFrame, entity: str = "entity", order: str = "at", state: str = "state") -> DataFrame:
    """Rows at which an entity's state is told: the first, and each that differs from the one before."""
    before = F.lag(state).over(Window.partitionBy(entity).orderBy(order))
    return history.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col(state))).drop("__b")
