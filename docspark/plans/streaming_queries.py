"""Queries over streams: each runs over all rows that are there, so its result is a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.plans.bind import SQL_TASKS, tasks
from docspark.plans.control_queries import _HISTORY, history
from docspark.plans.entry import Entries
from docspark.session import prepare, table
from docspark.streaming import changes as C
from docspark.streaming import meter as M

ENTRIES = Entries()


def _attempts(e):
    return e.select(
        F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("g"), (F.col("user_id") % 10).cast("string")).alias("group_id"), F.col("user_id").cast("string").alias("owner"), F.lit("page").alias("kind"), F.col("event_type").alias("reader"),
        (F.col("event_type") != "error").cast("long").alias("pages"), F.lit(1).cast("long").alias("calls"), F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), F.floor("value").alias("output_tokens"),
    )


_METER = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00:00') AS hour, 'g' || (user_id % 10) AS group_id, CAST(user_id AS VARCHAR) AS owner, 'page' AS kind, event_type AS reader, CAST(sum((event_type <> 'error')::INT) AS BIGINT) AS pages, count(*) AS calls,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS output_tokens FROM events GROUP BY ALL"""


@ENTRIES.add(_METER)
def meter_hourly(spark, sf_dir):
    rows = M.hourly(_attempts(table(prepare(spark), sf_dir, "events")))
    return rows.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:00:00"))


@ENTRIES.add(_METER)
def meter_stream(spark, sf_dir):
    """The same sums from a stream: hours the watermark has passed come from it, those still open from the table."""
    like = table(prepare(spark), sf_dir, "events")
    # Append mode emits an hour once the watermark has passed it; the last hours are still in the state when input ends.
    stream = M.as_stream(spark, f"{sf_dir}/events.parquet*", like)
    done = M.run_available(M.hourly(_attempts(stream), "0 seconds"), "meter")
    whole = M.hourly(_attempts(like))
    left = whole.join(done, ["hour", "group_id", "owner", "kind", "reader"], "left_anti")
    return done.unionByName(left).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:00:00"))


@ENTRIES.add(f"""WITH {_HISTORY}, c AS (SELECT *, (lag(state) OVER w IS NOT NULL AND lag(state) OVER w <> state)::INT AS c FROM history WINDOW w AS (PARTITION BY entity ORDER BY "at")) SELECT entity, "at", state, CAST(sum(c) OVER (PARTITION BY entity ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS change FROM c""")
def change_counter(spark, sf_dir):
    return M.change_counter(history(spark, sf_dir), ["state"])


@ENTRIES.add(f"""WITH {_HISTORY}, c AS (SELECT *, (lag(state) OVER w IS NOT NULL AND lag(state) OVER w <> state)::INT AS c FROM history WINDOW w AS (PARTITION BY entity ORDER BY "at")) SELECT entity, "at", state, CAST(sum(c) OVER (PARTITION BY entity ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS change FROM c""")
def change_counter_stream(spark, sf_dir):
    like = table(prepare(spark), sf_dir, "events")
    t = F.col("event_type")
    state = F.when(t == "view", "queued").when(t == "click", "leased").when(t == "purchase", "succeeded").when(t == "error", "failed").otherwise("canceled")
    stream = M.as_stream(spark, f"{sf_dir}/events.parquet*", like).select(F.col("user_id").alias("entity"), F.col("event_id").alias("at"), state.alias("state"))
    return M.run_available(C.changes(stream, "entity", "at", "state"), "changes")


@ENTRIES.add(f"""WITH {SQL_TASKS}, s AS (SELECT parse_id, page, state, task_key + page AS event FROM tasks WHERE state IN ('succeeded', 'failed')), r AS (SELECT *, row_number() OVER (PARTITION BY parse_id ORDER BY event, page) AS n FROM s WHERE event > 50)
  SELECT parse_id, page, event, 3 * event AS event_id FROM r WHERE n <= 3""")
def events_feed(spark, sf_dir):
    settled = tasks(spark, sf_dir).where("state in ('succeeded', 'failed')").select("parse_id", "page", "state", (F.col("task_key") + F.col("page")).alias("event"))
    out = M.feed(settled.where("state = 'failed'"), settled.where("state = 'succeeded'"), F.lit(50), 3)
    return out.select("parse_id", "page", "event", M.event_id(F.col("event"), F.lit(M.PAGE)).alias("event_id"))


@ENTRIES.add("SELECT event_id, CASE WHEN event_id % 4 = 0 OR event_id % 7 * 10 > user_id THEN 0 ELSE event_id % 7 * 10 END AS after FROM events")
def feed_resume(spark, sf_dir):
    e = table(prepare(spark), sf_dir, "events")
    named = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 7 * 10)
    return e.select("event_id", M.resumed(named, F.col("user_id")).cast("long").alias("after"))


@ENTRIES.add(f"""WITH {_HISTORY}, b AS (SELECT *, lag(state) OVER (PARTITION BY entity ORDER BY "at") AS b FROM history) SELECT entity, "at", state FROM b WHERE b IS NULL OR b <> state""")
def progress_events(spark, sf_dir):
    return M.progress(history(spark, sf_dir))
