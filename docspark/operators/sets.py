"""Sets: tables of extractions that share one request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(fields: DataFrame) -> DataFrame:
    s = F.col("state")
    return fields.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "pending").alias("pending"), F.count_if(s == "succeeded").alias("succeeded"), F.count_if(s == "failed").alias("failed")
    )


def listing(sets: DataFrame, limit: int, name: str | None = None, after: int | None = None, owners: list | None = None) -> DataFrame:
    """The newest sets below a cursor, and one more."""
    rows = sets
    if owners is not None:
        rows = rows.where(F.col("owner").isin(owners))
    if name is not None:
        rows = rows.where(F.col("name") == name)
    if after is not None:
        rows = rows.where(F.col("set_id") < after)
    return rows.orderBy(F.desc("set_id")).limit(limit + 1)


def as_table(fields: DataFrame, set_id: int, schema: str, limit: int) -> DataFrame:
    """A set's members, newest first, with the members of their JSON as columns."""
    rows = fields.where(F.col("set_id") == set_id).select("parse_id", "state", F.from_json("data", schema).alias("d"))
    return rows.select("parse_id", "state", "d.*").orderBy(F.desc("parse_id")).limit(limit)


def join_answer() -> Column:
    """Of set_found, parse_found, field_found, in_set, same_version, set_full, parse_full, field_pending, same_request and
    same_pin, the first that decides."""
    held, member = F.col("field_found"), F.col("field_found") & F.col("in_set")
    return (
        F.when(~F.col("set_found"), "no_set")
        .when(~F.col("parse_found"), "missing")
        .when(member & F.col("same_version"), "joined")
        .when(~member & F.col("set_full"), "full_set")
        .when(~held & F.col("parse_full"), "full")
        .when(~held, "asked")
        .when(F.col("field_pending"), "busy")
        .when(F.col("same_request") & F.col("same_pin"), "joined")
        .otherwise("asked")
    )


def ask_again_answer() -> Column:
    """Of parse_found, field_found, field_pending, in_set, same_request and same_pin."""
    differs = F.col("in_set") & ~(F.col("same_request") & F.col("same_pin"))
    return F.when(~F.col("parse_found"), "missing").when(~F.col("field_found"), "absent").when(F.col("field_pending"), "busy").when(differs, "set").otherwise("asked")


def leave_answer() -> Column:
    """Of set_found, parse_found, member and field_pending."""
    return F.when(~F.col("set_found"), "no_set").when(~F.col("parse_found"), "missing").when(~F.col("member"), "not_member").when(F.col("field_pending"), "busy").otherwise("left")


def update(sets: DataFrame, fields: DataFrame) -> DataFrame:
    """A new request for each set (request, new_request): busy while a member is pending, same for equal bytes, else the
    version rises and all members are asked again."""
    members = fields.groupBy("set_id").agg(F.bool_or("pending").alias("busy"), F.count(F.lit(1)).alias("n"))
    rows = sets.join(members, "set_id", "left")
    answer = F.when(F.coalesce("busy", F.lit(False)), "busy").when(F.col("request") == F.col("new_request"), "same").otherwise("updated")
    done = answer == "updated"
    return rows.select("set_id", answer.alias("answer"), (F.col("version") + done.cast("int")).alias("version"), F.when(done, F.coalesce("n", F.lit(0))).otherwise(0).alias("asked"))


def detached(fields: DataFrame, set_id: int) -> DataFrame:
    """All fields as they are once a set is deleted: its own stay, in no set."""
    return fields.withColumn("set_id", F.when(F.col("set_id") != set_id, F.col("set_id")))
