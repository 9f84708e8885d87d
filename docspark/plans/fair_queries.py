"""Queries over scheduling and capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import capacity as J
from docspark.operators import fair as I
from docspark.operators import lifecycle as K
from docspark.plans.bind import SQL_PARSES, SQL_TASKS, parses, tasks
from docspark.plans.entry import Entries
from docspark.session import prepare, table

ENTRIES = Entries()

_BACKLOG = f"""WITH {SQL_PARSES}, {SQL_TASKS}, b AS (SELECT class, group_id, project_id, priority, task_key, page, parse_id, day, t.input_tokens, cost,
    CASE class WHEN 0 THEN 4 ELSE 1 END AS class_weight, 1 + group_id % 7 AS group_weight, 1 + project_id % 3 AS project_weight,
    row_number() OVER (PARTITION BY parse_id ORDER BY page, task_key, day, t.input_tokens, cost) AS n
  FROM tasks t JOIN parses USING (parse_id) WHERE t.state = 'queued'),
  p1 AS (SELECT *, coalesce(sum(cost * 1000000 // project_weight) OVER (PARTITION BY class, group_id, project_id ORDER BY priority DESC, parse_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM b),
  p2 AS (SELECT *, row_number() OVER (PARTITION BY class, group_id ORDER BY t, project_id, priority DESC, parse_id, n) AS in_group FROM p1),
  p3 AS (SELECT *, coalesce(sum(cost * 1000000 // group_weight) OVER (PARTITION BY class, group_id ORDER BY in_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t2 FROM p2),
  p4 AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY t2, group_id, in_group) AS in_class FROM p3),
  p5 AS (SELECT *, coalesce(sum(cost * 1000000 // class_weight) OVER (PARTITION BY class ORDER BY in_class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t3 FROM p4),
  d AS (SELECT *, row_number() OVER (ORDER BY t3, class, in_class) AS seq FROM p5)"""


def backlog(spark, sf_dir):
    from pyspark.sql import Window

    t = tasks(spark, sf_dir).where("state = 'queued'").drop("state")
    p = parses(spark, sf_dir).select("parse_id", "class", "group_id", "project_id", "priority")
    n = F.row_number().over(Window.partitionBy("parse_id").orderBy("page", "task_key", "day", "input_tokens", "cost"))
    return t.join(p, "parse_id").select(
        "class", "group_id", "project_id", "priority", "parse_id", n.cast("long").alias("n"), "cost", F.when(F.col("class") == 0, 4).otherwise(1).alias("class_weight"),
        I.clamped_weight(1 + F.col("group_id") % 7).alias("group_weight"), I.clamped_weight(1 + F.col("project_id") % 3).alias("project_weight"), (-F.col("priority")).alias("urgency"),
    )


@ENTRIES.add(_BACKLOG + " SELECT class, group_id, project_id, parse_id, n, cost, in_class FROM d")
def fair_dispatch_group(spark, sf_dir):
    out = I.merged(backlog(spark, sf_dir), ["project_id"], ["urgency", "parse_id", "n"], "project_weight", "in_group", ["class", "group_id"])
    out = I.merged(out, ["group_id"], ["in_group"], "group_weight", "in_class", ["class"])
    return out.select("class", "group_id", "project_id", "parse_id", "n", "cost", "in_class")


@ENTRIES.add(_BACKLOG + " SELECT class, group_id, project_id, parse_id, n, cost, seq FROM d")
def fair_dispatch_hier(spark, sf_dir):
    return I.dispatch_order(backlog(spark, sf_dir), ["urgency", "parse_id", "n"]).select("class", "group_id", "project_id", "parse_id", "n", "cost", "seq")


@ENTRIES.add(
    _BACKLOG
    + """, m AS (SELECT class, cost, seq, row_number() OVER (PARTITION BY class ORDER BY seq) AS k FROM d), r AS (SELECT *, seq - k AS run, k - seq // 2 AS ahead FROM m),
  s AS (SELECT class, max(c) AS streak FROM (SELECT class, run, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1)
  SELECT class, count(*) AS served, CAST(sum(cost) AS BIGINT) AS units, CAST(greatest(max(ahead), 0) AS BIGINT) AS ahead, streak FROM r JOIN s USING (class) GROUP BY class, streak"""
)
def fair_share_metrics(spark, sf_dir):
    return I.share_metrics(I.dispatch_order(backlog(spark, sf_dir), ["urgency", "parse_id", "n"]), "class")


@ENTRIES.add()
def fair_dispatch_arrivals(spark, sf_dir):
    """The whole backlog is one queue: all groups compete on the same clocks."""
    rows = backlog(spark, sf_dir).select(
        F.lit(0).cast("long").alias("queue"), "class", "group_id", "project_id", "priority", "cost", "class_weight", "group_weight", "project_weight", (F.col("n") * 3).alias("arrival"), (F.col("parse_id") * 100 + F.col("n")).alias("task_key")
    )
    return I.dispatch_arrivals(rows, ["queue"])


_CORRECTION = "CASE WHEN used < charged THEN -((charged - used) * 1000000 // weight) ELSE (used - charged) * 1000000 // weight END"


@ENTRIES.add(f"SELECT event_id, CAST({_CORRECTION} AS BIGINT) AS moved FROM (SELECT event_id, user_id % 9 AS used, event_id % 9 AS charged, 1 + event_id % 7 AS weight FROM events)")
def charge_correction(spark, sf_dir):
    prepare(spark)
    e = table(spark, sf_dir, "events")
    return e.select("event_id", I.charge_correction(F.col("user_id") % 9, F.col("event_id") % 9, 1 + F.col("event_id") % 7).alias("moved"))


@ENTRIES.add("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN '' WHEN user_id % 3 = 0 THEN event_type || ':r' || user_id WHEN event_id % 4 = 0 THEN event_type ELSE event_type || '@' || (event_id % 4) END AS lane FROM events""")
def task_lane(spark, sf_dir):
    prepare(spark)
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "prepare").when(F.col("event_type") == "click", "assemble").otherwise(F.col("event_type"))
    pin = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("r"), F.col("user_id")))
    return e.select("event_id", I.lane(kind, pin, F.col("event_id") % 4).alias("lane"))


_CHAIN = "['a', 'b', 'c', 'd']"


@ENTRIES.add(f"SELECT event_id, list_filter(list_slice({_CHAIN}, event_id % 5 + 1, 4), lambda x: x NOT IN (['a', 'b', 'c', 'd'][user_id % 4 + 1], 'c'))[1] AS reader FROM events")
def chain_reader(spark, sf_dir):
    prepare(spark)
    chain = F.array(*[F.lit(x) for x in "abcd"])
    skip = F.array(F.element_at(chain, (F.col("user_id") % 4).cast("int") + 1), F.lit("c"))
    return table(spark, sf_dir, "events").select("event_id", I.reader_at(chain, (F.col("event_id") % 5).cast("int"), skip).alias("reader"))


@ENTRIES.add("""SELECT event_id, array_to_string(list_filter(['', 'page', 'page@1', 'field:r2', 'figure'], lambda x: x = '' OR (event_id % 2 = 0 AND (x = 'page' OR starts_with(x, 'page@') OR starts_with(x, 'page:')))
    OR (event_id % 3 = 0 AND (x = 'field' OR starts_with(x, 'field@') OR starts_with(x, 'field:')))), ',') AS lanes FROM events""")
def runnable_lanes(spark, sf_dir):
    prepare(spark)
    lanes = F.array(*[F.lit(x) for x in ("", "page", "page@1", "field:r2", "figure")])
    kinds = F.array_compact(F.array(F.when(F.col("event_id") % 2 == 0, "page"), F.when(F.col("event_id") % 3 == 0, "field")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(I.runnable_lanes(lanes, kinds), ",").alias("lanes"))


@ENTRIES.add(f"""WITH {SQL_PARSES}, j AS (SELECT class, owner, priority, parse_id FROM parses WHERE state = 'queued'),
  a AS (SELECT *, row_number() OVER (PARTITION BY class, owner ORDER BY priority, parse_id) AS turn, min(parse_id) OVER (PARTITION BY class, owner) AS first FROM j),
  n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY turn, first, owner) AS n, count(*) FILTER (class = 1) OVER () AS bs, count(*) FILTER (class = 0) OVER () AS ins FROM a)
  SELECT class, owner, parse_id, CAST(CASE WHEN class = 0 THEN n + least((n - 1) // 4, bs) ELSE n + least(n * 4, ins) END AS BIGINT) AS seq FROM n""")
def owner_turns(spark, sf_dir):
    p = parses(spark, sf_dir).where("state = 'queued'").select("class", "owner", "priority", "parse_id", F.col("parse_id").alias("arrival"))
    return I.turn_order(p, ["priority", "parse_id"]).select("class", "owner", "parse_id", "seq")


# --- capacity ----------------------------------------------------------------------------------------------------

_SCOPED = "s AS (SELECT event_id, 1 + user_id % 30 AS held, CASE WHEN event_id % 5 > 0 THEN event_id * 3 END AS since, 4 + event_id % 40 AS most, event_id * 3 + user_id * 2 AS now, CASE WHEN event_id % 3 = 0 THEN event_id * 3 + user_id END AS paused FROM events)"


def scoped(spark, sf_dir):
    prepare(spark)
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    return e.select(
        "event_id", (1 + u % 30).alias("held"), F.when(i % 5 > 0, i * 3).alias("since"), (4 + i % 40).alias("most"), (i * 3 + u * 2).alias("now"), F.when(i % 3 == 0, i * 3 + u).alias("paused")
    )


@ENTRIES.add(f"WITH {_SCOPED} SELECT event_id, CAST(least(most, held + greatest(0, (now - coalesce(since, now)) // 30) * greatest(1, most // 10)) AS BIGINT) AS ceiling FROM s")
def ceiling_recovery(spark, sf_dir):
    return scoped(spark, sf_dir).select("event_id", J.ceiling(F.col("held"), F.col("since"), F.col("most"), F.col("now")).alias("ceiling"))


@ENTRIES.add(f"WITH {_SCOPED} SELECT event_id, CAST(CASE WHEN paused IS NOT NULL AND now >= paused AND now < paused + 10 THEN greatest(1, held * (now - paused) // 10) ELSE held END AS BIGINT) AS admits FROM s")
def admit_ramp(spark, sf_dir):
    return scoped(spark, sf_dir).select("event_id", J.admits(F.col("held"), F.col("paused"), F.col("now")).alias("admits"))


@ENTRIES.add(f"""WITH {SQL_TASKS}, p AS (SELECT s_suppkey AS reader_id, 200 + s_suppkey % 16 AS most, CASE WHEN s_suppkey % 3 > 0 THEN 1 + s_suppkey % 9 * 20 END AS ceiling, s_suppkey AS raised, CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey * 2 END AS paused FROM supplier),
  f AS (SELECT reader_id, count(*) AS n FROM tasks WHERE state = 'leased' GROUP BY 1),
  c AS (SELECT *, least(most, ceiling + greatest(0, (100 - raised) // 30) * greatest(1, most // 10)) AS now_ceiling FROM p LEFT JOIN f USING (reader_id)),
  a AS (SELECT *, coalesce(paused > 100, false) AS is_paused, CASE WHEN paused IS NOT NULL AND 100 >= paused AND 100 < paused + 10 THEN greatest(1, now_ceiling * (100 - paused) // 10) ELSE now_ceiling END AS admits FROM c)
  SELECT coalesce(array_to_string(list_sort(list(reader_id) FILTER (ceiling IS NULL OR (NOT is_paused AND coalesce(n, 0) < admits))), ','), '') AS room, coalesce(array_to_string(list_sort(list(reader_id) FILTER (is_paused)), ','), '') AS paused, min(paused) FILTER (is_paused) AS wake FROM a""")
def reader_room(spark, sf_dir):
    prepare(spark)
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    pools = s.select(k.alias("reader_id"), (200 + k % 16).alias("max_in_flight"))
    scopes = s.where(k % 3 > 0).select(k.alias("reader_id"), F.lit("x").alias("scope"), (1 + k % 9 * 20).alias("ceiling"), k.alias("raised_at"), F.when(k % 4 == 1, k * 2).alias("paused_until"))
    # A pause of a scope that was never limited doesn't exist; the twin's rows with a pause and no ceiling are given one.
    scopes = scopes.unionByName(s.where((k % 3 == 0) & (k % 4 == 1)).select(k.alias("reader_id"), F.lit("x").alias("scope"), F.lit(None).cast("bigint").alias("ceiling"), k.alias("raised_at"), (k * 2).alias("paused_until")))
    flying = tasks(spark, sf_dir).where("state = 'leased'").select("reader_id", F.lit("x").alias("scope"))
    out = J.room(pools, scopes, flying, "x", 100)
    return out.select(F.array_join("room", ",").alias("room"), F.array_join("paused", ",").alias("paused"), "wake")


@ENTRIES.add("SELECT event_id, least(60.0::DOUBLE, 1 * pow(2.0::DOUBLE, least(event_id % 40, 30))) AS seconds FROM events")
def retry_backoff(spark, sf_dir):
    prepare(spark)
    return table(spark, sf_dir, "events").select("event_id", J.backoff(F.col("event_id") % 40 + 1).alias("seconds"))


@ENTRIES.add("""WITH c AS (SELECT event_id, ['rate_limited', 'budget', 'permanent', 'refused', 'misconfigured', 'invalid', 'retryable', 'other'][event_id % 8 + 1] AS k FROM events)
  SELECT event_id, CASE k WHEN 'rate_limited' THEN 'wait' WHEN 'budget' THEN 'permanent' WHEN 'permanent' THEN 'permanent' WHEN 'refused' THEN 'next' WHEN 'misconfigured' THEN 'next' ELSE 'retryable' END AS outcome,
    CASE WHEN k IN ('misconfigured', 'retryable', 'other') THEN 'failure' END AS health,
    CASE k WHEN 'rate_limited' THEN NULL WHEN 'budget' THEN 'budget_exhausted' WHEN 'permanent' THEN 'page_unreadable' WHEN 'refused' THEN 'page_unreadable' WHEN 'invalid' THEN 'page_unreadable' ELSE 'reader_unavailable' END AS code FROM c""")
def failure_outcome(spark, sf_dir):
    prepare(spark)
    names = F.array(*[F.lit(x) for x in (*J.OUTCOMES, "other")])
    e = table(spark, sf_dir, "events")
    return e.select("event_id", J.outcome_of(F.element_at(names, (F.col("event_id") % 8).cast("int") + 1)).alias("o")).select("event_id", "o.*")


_SETTLE = """s AS (SELECT event_id, ['succeeded', 'permanent', 'retryable', 'next', 'wait', 'continue', 'returned'][event_id % 7 + 1] AS outcome, user_id % 3 AS attempt, user_id % 2 AS invalid, event_id % 3 = 0 AS unusable,
    event_id % 11 = 0 AS escalated, event_id % 5 = 0 AS pinned, event_id % 10 = 0 AS stuck, user_id % 4 AS chain_at, CASE WHEN event_id % 6 > 0 THEN user_id % 4 + 1 END AS next_at, 4 AS chain_size FROM events),
  m AS (SELECT *, coalesce(next_at, chain_at + 1) AS following, (NOT pinned OR stuck) AND coalesce(next_at, chain_at + 1) < chain_size AS moves, invalid + unusable::INT AS bad FROM s),
  e AS (SELECT *, outcome = 'retryable' AND unusable AND bad >= 2 AND NOT escalated AND moves AS esc FROM m),
  f AS (SELECT *, outcome = 'permanent' OR (outcome = 'retryable' AND NOT esc AND attempt + 1 >= 3) OR (outcome = 'next' AND NOT moves) AS fails, esc OR (outcome = 'next' AND moves) AS jumps FROM e)"""


@ENTRIES.add(f"""WITH {_SETTLE} SELECT event_id, CASE WHEN outcome = 'succeeded' THEN 'succeeded' WHEN fails THEN 'failed' ELSE 'queued' END AS state,
    CASE WHEN jumps OR outcome = 'continue' THEN 0 WHEN outcome = 'retryable' THEN attempt + 1 ELSE attempt END AS new_attempt, CASE WHEN jumps OR outcome = 'continue' THEN 0 WHEN outcome = 'retryable' THEN bad ELSE invalid END AS new_invalid,
    CASE WHEN jumps THEN following ELSE chain_at END AS new_chain_at, escalated OR esc AS new_escalated, CASE WHEN jumps AND stuck THEN false WHEN outcome = 'continue' THEN true ELSE pinned END AS new_pinned,
    CASE WHEN outcome = 'retryable' AND NOT esc AND NOT fails THEN least(60.0::DOUBLE, pow(2.0::DOUBLE, attempt)) WHEN outcome = 'wait' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS delay FROM f""")
def settle_outcome(spark, sf_dir):
    prepare(spark)
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    names = F.array(*[F.lit(x) for x in ("succeeded", "permanent", "retryable", "next", "wait", "continue", "returned")])
    rows = e.select(
        "event_id", F.element_at(names, (i % 7).cast("int") + 1).alias("outcome"), (u % 3).alias("attempt"), (u % 2).alias("invalid"), (i % 3 == 0).alias("unusable"), (i % 11 == 0).alias("escalated"),
        (i % 5 == 0).alias("pinned"), (i % 10 == 0).alias("stuck"), (u % 4).alias("chain_at"), F.when(i % 6 > 0, u % 4 + 1).alias("next_at"), F.lit(4).alias("chain_size"),
    )
    return J.settled(rows).select("event_id", "state", "new_attempt", "new_invalid", "new_chain_at", "new_escalated", "new_pinned", "delay")


@ENTRIES.add()
def rate_limits(spark, sf_dir):
    prepare(spark)
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return J.limited(e.select((F.col("user_id") % 50).alias("scope"), F.col("event_id").alias("at"), (F.col("event_id") - F.col("user_id") % 7).alias("leased_at"), (1 + F.col("user_id") % 20).alias("wait"), F.lit(32).alias("most")))


@ENTRIES.add(f"""WITH RECURSIVE e AS (SELECT user_id % 60 AS reader_id, event_id AS "at", event_id - user_id % 5 AS leased_at, CASE event_type WHEN 'error' THEN 'failure' WHEN 'click' THEN 'failure' WHEN 'purchase' THEN 'success' END AS health,
    row_number() OVER (PARTITION BY user_id % 60 ORDER BY event_id) AS n FROM events),
  w AS (SELECT reader_id, n, "at", CAST(health IS NOT DISTINCT FROM 'failure' AS BIGINT) AS failures, CAST(NULL AS BIGINT) AS opened_at FROM e WHERE n = 1
    UNION ALL SELECT e.reader_id, e.n, e."at", CASE e.health WHEN 'failure' THEN w.failures + 1 WHEN 'success' THEN 0 ELSE w.failures END,
      CASE WHEN e.health = 'failure' AND ((w.opened_at IS NULL AND w.failures + 1 >= 3) OR (w.opened_at IS NOT NULL AND e.leased_at > w.opened_at)) THEN e."at" WHEN e.health = 'success' THEN NULL ELSE w.opened_at END
    FROM w JOIN e ON e.reader_id = w.reader_id AND e.n = w.n + 1)
  SELECT reader_id, "at", failures, opened_at FROM w""")
def reader_breaker(spark, sf_dir):
    prepare(spark)
    t = F.col("event_type")
    health = F.when(t.isin("error", "click"), "failure").when(t == "purchase", "success")
    e = table(spark, sf_dir, "events")
    return J.breaker(e.select((F.col("user_id") % 60).alias("reader_id"), F.col("event_id").alias("at"), (F.col("event_id") - F.col("user_id") % 5).alias("leased_at"), health.alias("health")))


@ENTRIES.add(f"""WITH {SQL_TASKS} SELECT parse_id, page, task_key, CASE WHEN input_tokens % 4 + 1 >= 3 THEN 'failed' ELSE 'queued' END AS new_state, input_tokens % 4 + 1 AS new_expiries,
    CASE WHEN input_tokens % 4 + 1 >= 3 THEN 'page_unreadable' END AS new_code FROM tasks WHERE state = 'leased' AND reader_id % 10 = 3""")
def reap_workers(spark, sf_dir):
    own = tasks(spark, sf_dir).select("parse_id", "page", "task_key", "state", F.lit("page").alias("kind"), (F.col("reader_id") % 10).alias("worker"), (F.col("input_tokens") % 4).alias("expiries"))
    return J.reaped(own, spark.range(3, 4).withColumnRenamed("id", "worker"))


@ENTRIES.add(f"""WITH {SQL_TASKS}, l AS (SELECT DISTINCT parse_id, page, task_key AS token FROM tasks WHERE state = 'leased' AND reader_id % 10 = 3), h AS (SELECT DISTINCT parse_id, page, task_key AS token FROM tasks WHERE state IN ('leased', 'failed') AND reader_id % 10 = 3 AND page % 3 <> 1),
    s AS (SELECT * FROM l WHERE page % 3 = 1 AND parse_id % 2 = 0)
  SELECT 'lost' AS answer, parse_id, page, token FROM h WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.parse_id = h.parse_id AND l.page = h.page AND l.token = h.token)
  UNION ALL SELECT 'requeued', parse_id, page, token FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE l.parse_id = h.parse_id AND l.page = h.page AND l.token = h.token) AND NOT EXISTS (SELECT 1 FROM s WHERE l.parse_id = s.parse_id AND l.page = s.page AND l.token = s.token)""")
def exchange_reconciliation(spark, sf_dir):
    own = tasks(spark, sf_dir).select("parse_id", "page", F.col("task_key").alias("token"), "state", (F.col("reader_id") % 10).alias("worker")).distinct()
    leased = own.where("state = 'leased'").drop("state")
    held = own.where("state in ('leased', 'failed') and worker = 3 and page % 3 <> 1").select("parse_id", "page", "token").distinct()
    settled = leased.where("worker = 3 and page % 3 = 1 and parse_id % 2 = 0").select("parse_id", "page", "token")
    lost, requeued = J.reconciled(held, leased, settled, 3)
    return lost.select(F.lit("lost").alias("answer"), "parse_id", "page", "token").union(requeued.select(F.lit("requeued"), "parse_id", "page", "token"))


@ENTRIES.add(f"WITH {SQL_PARSES} SELECT parse_id, 'failed' AS state, 'deadline_exceeded' AS code FROM parses WHERE state IN ('queued', 'running') AND created_day + 5 + owner % 20 <= 19000")
def deadline_sweep(spark, sf_dir):
    return K.overdue(parses(spark, sf_dir).withColumn("deadline", F.col("created_day") + 5 + F.col("owner") % 20), 19000).select("parse_id", "state", "code")
