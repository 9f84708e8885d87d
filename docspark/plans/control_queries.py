"""Queries over the control plane: usage, queues, listings, retention, admission, sets, lifecycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import control as C
from docspark.operators import lifecycle as K
from docspark.operators import sets as L
from docspark.plans.bind import SQL_ATTEMPTS, SQL_PARSES, SQL_TASKS, attempts, parses, tasks
from docspark.plans.entry import Entries
from docspark.session import prepare, table

ENTRIES = Entries()

_SUMS = "CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens"


def _usage(key: str, interval: str, where: str = "") -> str:
    return f"WITH {SQL_ATTEMPTS} SELECT {key} AS key, {interval} AS start, {_SUMS} FROM attempts {where} GROUP BY 1, 2"


@ENTRIES.add(_usage("group_id", "hour"))
def usage_by_group_hour(spark, sf_dir):
    return C.usage(attempts(spark, sf_dir), "group_id", "hour")


@ENTRIES.add(_usage("owner", "day"))
def usage_by_owner_day(spark, sf_dir):
    return C.usage(attempts(spark, sf_dir), "owner", "day")


@ENTRIES.add(_usage("reader", "hour", "WHERE owner IN ('1', '2', '3', '5', '8') AND group_id IN ('g1', 'g2', 'g5') AND hour >= '2024-01-01 00:00:00'"))
def usage_by_reader_hour_narrowed(spark, sf_dir):
    return C.usage(attempts(spark, sf_dir), "reader", "hour", since="2024-01-01 00:00:00", owners=["1", "2", "3", "5", "8"], groups=["g1", "g2", "g5"])


@ENTRIES.add(f"WITH {SQL_ATTEMPTS} SELECT hour, group_id, owner, kind, reader, {_SUMS} FROM attempts GROUP BY ALL")
def usage_meter(spark, sf_dir):
    return C.meter(attempts(spark, sf_dir))


@ENTRIES.add(
    "SELECT event_id, CAST(floor(a / 3600.0) * 3600 AS BIGINT) AS since, CAST(ceil(z / 3600.0) * 3600 AS BIGINT) AS until, "
    "CASE WHEN ceil(z / 3600.0) <= floor(a / 3600.0) THEN 'invalid_request' WHEN ceil(z / 3600.0) - floor(a / 3600.0) > 1000 THEN 'invalid_request' END AS code "
    "FROM (SELECT event_id, user_id * 1000 AS a, user_id * 1000 + event_id * 500 AS z FROM events)"
)
def usage_span(spark, sf_dir):
    prepare(spark)
    e = table(spark, sf_dir, "events")
    span = C.aligned_span(F.col("user_id") * 1000, F.col("user_id") * 1000 + F.col("event_id") * 500, 3600)
    return e.select("event_id", span.alias("s")).select("event_id", "s.since", "s.until", "s.code")


def _queue_sql(by: str) -> str:
    return f"""WITH {SQL_PARSES}, {SQL_TASKS}, open AS (SELECT * FROM parses WHERE state IN ('queued', 'running')),
  work AS (SELECT {by}, class, t.state AS ts FROM tasks t JOIN open USING (parse_id) WHERE t.state IN ('queued', 'leased')),
  heads AS (SELECT {by}, count(*) AS parses FROM open GROUP BY ALL),
  counts AS (SELECT {by}, count(*) FILTER (class = 0 AND ts = 'queued') AS iq, count(*) FILTER (class = 0 AND ts = 'leased') AS ir,
    count(*) FILTER (class = 1 AND ts = 'queued') AS bq, count(*) FILTER (class = 1 AND ts = 'leased') AS br FROM work GROUP BY {by})
  SELECT {by}, parses, coalesce(iq, 0) AS interactive_queued, coalesce(ir, 0) AS interactive_running, coalesce(bq, 0) AS batch_queued, coalesce(br, 0) AS batch_running
  FROM heads LEFT JOIN counts USING ({by})"""


@ENTRIES.add(_queue_sql("group_id"))
def queue_view_groups(spark, sf_dir):
    return C.queue_groups(parses(spark, sf_dir), tasks(spark, sf_dir), ["group_id"])


@ENTRIES.add(_queue_sql("group_id, project_id"))
def queue_view_projects(spark, sf_dir):
    return C.queue_groups(parses(spark, sf_dir), tasks(spark, sf_dir), ["group_id", "project_id"])


def pools(spark, sf_dir):
    prepare(spark)
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("reader_id"), (F.col("s_suppkey") % 16 + 1).alias("max_in_flight"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey")).alias("opened_at"), F.floor("s_acctbal").alias("balance")
    )


SQL_POOLS = "pools AS (SELECT s_suppkey AS reader_id, s_suppkey % 16 + 1 AS max_in_flight, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS opened_at, CAST(floor(s_acctbal) AS BIGINT) AS balance FROM supplier)"


@ENTRIES.add(f"""WITH {SQL_POOLS}, {SQL_TASKS}, f AS (SELECT reader_id, count(*) AS n FROM tasks WHERE state = 'leased' GROUP BY 1)
  SELECT reader_id, max_in_flight, coalesce(n, 0) AS in_flight, CASE WHEN opened_at IS NULL THEN 'closed' WHEN 60 < opened_at + 30 THEN 'open' ELSE 'trial' END AS breaker
  FROM pools LEFT JOIN f USING (reader_id)""")
def queue_view_pools(spark, sf_dir):
    return C.queue_pools(pools(spark, sf_dir), tasks(spark, sf_dir), now=60)


@ENTRIES.add(f"WITH {SQL_PARSES} SELECT * FROM parses WHERE state IN ('queued', 'running') AND owner BETWEEN 1 AND 400 AND parse_id < 9000 ORDER BY parse_id DESC LIMIT 51")
def parses_listing_topk(spark, sf_dir):
    return C.listing(parses(spark, sf_dir), 50, owners=list(range(1, 401)), states=["queued", "running"], after=9000)


@ENTRIES.add(f"WITH {SQL_PARSES} SELECT parse_id, owner, label FROM parses WHERE label = 'BUILDING' AND file_id = 7 ORDER BY parse_id DESC LIMIT 21")
def parses_listing_labels(spark, sf_dir):
    rows = parses(spark, sf_dir).withColumn("labels", F.create_map(F.lit("segment"), "label"))
    return C.listing(rows, 20, file_id=7, labels={"segment": "BUILDING"}).select("parse_id", "owner", "label")


@ENTRIES.add(f"WITH {SQL_TASKS} SELECT parse_id, page, task_key, state, code FROM tasks WHERE parse_id = 7")
def task_listing(spark, sf_dir):
    return tasks(spark, sf_dir).where("parse_id = 7").select("parse_id", "page", "task_key", "state", "code").orderBy("page", "task_key")


@ENTRIES.add(f"WITH {SQL_TASKS} SELECT parse_id, CASE WHEN count(DISTINCT code) = 1 THEN min(code) ELSE 'page_unreadable' END AS code FROM tasks WHERE state = 'failed' GROUP BY 1")
def failure_code(spark, sf_dir):
    return C.failure_codes(tasks(spark, sf_dir))


def files(spark, sf_dir):
    return spark.range(45).select(F.col("id").alias("file_id"), F.when(F.col("id") % 3 == 0, 9000 + F.col("id") * 10).alias("kept_until"))


SQL_FILES = "files AS (SELECT range AS file_id, CASE WHEN range % 3 = 0 THEN 9000 + range * 10 END AS kept_until FROM range(45))"
_RETAINED = "retained AS (SELECT *, 20 + owner % 10 AS retention FROM parses)"


def retained(spark, sf_dir):
    return parses(spark, sf_dir).withColumn("retention", 20 + F.col("owner") % 10)


@ENTRIES.add(f"WITH {SQL_PARSES}, {_RETAINED}, {SQL_FILES}, l AS (SELECT file_id, max(finished_day + retention) AS last FROM retained GROUP BY 1) SELECT file_id, greatest(kept_until, last) AS expires_day FROM files LEFT JOIN l USING (file_id)")
def file_expiry(spark, sf_dir):
    return C.file_expiry(files(spark, sf_dir), retained(spark, sf_dir))


@ENTRIES.add(f"WITH {SQL_PARSES}, {_RETAINED} SELECT parse_id, finished_day + retention AS expires_day FROM retained WHERE finished_day + retention <= 20000 ORDER BY 2, 1 LIMIT 200")
def expired_sweep(spark, sf_dir):
    return C.expired_parses(retained(spark, sf_dir), 20000)


@ENTRIES.add(f"WITH {SQL_PARSES}, {SQL_FILES} SELECT file_id, kept_until FROM files f WHERE NOT EXISTS (SELECT 1 FROM parses p WHERE p.file_id = f.file_id AND p.state IN ('queued', 'running'))")
def idle_files(spark, sf_dir):
    return C.idle_files(files(spark, sf_dir), parses(spark, sf_dir))


@ENTRIES.add(f"""WITH {SQL_PARSES} SELECT parse_id, group_id, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY created_day, parse_id) <= 100 THEN 'created' ELSE 'queue_full' END AS outcome FROM parses""")
def admission_arrivals(spark, sf_dir):
    return C.admitted(parses(spark, sf_dir), "group_id", ["created_day", "parse_id"], 100).select("parse_id", "group_id", "outcome")


@ENTRIES.add(f"""WITH RECURSIVE {SQL_PARSES}, req AS (SELECT group_id, created_day AS day, parse_id, 1 + tokens % 9 AS pages, row_number() OVER (PARTITION BY group_id, created_day ORDER BY parse_id) AS n FROM parses),
  walk AS (SELECT group_id, day, n, parse_id, pages, pages <= 10 AS granted, CASE WHEN pages <= 10 THEN pages ELSE 0 END AS total FROM req WHERE n = 1
    UNION ALL SELECT r.group_id, r.day, r.n, r.parse_id, r.pages, w.total + r.pages <= 10, w.total + CASE WHEN w.total + r.pages <= 10 THEN r.pages ELSE 0 END
    FROM walk w JOIN req r ON r.group_id = w.group_id AND r.day = w.day AND r.n = w.n + 1)
  SELECT group_id, day, parse_id, CAST(pages AS BIGINT) AS pages, granted FROM walk""")
def group_day_reservation(spark, sf_dir):
    p = parses(spark, sf_dir)
    return C.reserved(p.select("group_id", F.col("created_day").alias("day"), F.col("parse_id").alias("seq"), "parse_id", (1 + F.col("tokens") % 9).alias("pages")), 10)


@ENTRIES.add(f"""WITH {SQL_PARSES}, {SQL_TASKS}, r AS (SELECT parse_id, count(*) AS read FROM tasks WHERE state IN ('succeeded', 'failed') GROUP BY 1)
  SELECT group_id, CAST(sum(greatest(8 - coalesce(read, 0), 0)) AS BIGINT) AS refund FROM parses LEFT JOIN r USING (parse_id) WHERE state IN ('succeeded', 'failed') GROUP BY 1""")
def group_day_refund(spark, sf_dir):
    return C.refunds(parses(spark, sf_dir).withColumn("reserved", F.lit(8)), tasks(spark, sf_dir))


@ENTRIES.add(f"""WITH RECURSIVE {SQL_PARSES}, req AS (SELECT owner, file_id % 4 AS key, created_day * 24 // 30 AS hour, parse_id AS request_id, label AS body,
    row_number() OVER (PARTITION BY owner, file_id % 4 ORDER BY created_day * 24 // 30, parse_id) AS n FROM parses),
  walk AS (SELECT owner, key, n, request_id, hour AS since, body, 'created' AS outcome FROM req WHERE n = 1
    UNION ALL SELECT r.owner, r.key, r.n, r.request_id, CASE WHEN r.hour >= w.since + 24 THEN r.hour ELSE w.since END, CASE WHEN r.hour >= w.since + 24 THEN r.body ELSE w.body END,
      CASE WHEN r.hour >= w.since + 24 THEN 'created' WHEN r.body IS NOT DISTINCT FROM w.body THEN 'exists' ELSE 'conflict' END
    FROM walk w JOIN req r ON r.owner = w.owner AND r.key = w.key AND r.n = w.n + 1)
  SELECT owner, key, request_id, outcome FROM walk""")
def idempotency_keys(spark, sf_dir):
    p = parses(spark, sf_dir)
    hour = F.floor(F.col("created_day") * 24 / 30)
    return C.idempotency(p.select("owner", (F.col("file_id") % 4).alias("key"), hour.alias("hour"), F.col("parse_id").alias("request_id"), F.col("label").alias("body")))


@ENTRIES.add()
def submit_admission(spark, sf_dir):
    p = parses(spark, sf_dir)
    own = p.select(
        "group_id", F.col("created_day").alias("seq"), "parse_id", (F.col("file_id") % 9 != 0).alias("file_known"), (1 + F.col("tokens") % 9).alias("pages"), F.floor(F.col("created_day") / 30).alias("day"),
        F.col("finished_day").alias("ends"), "owner", (F.col("file_id") % 4).alias("key"), F.col("label").alias("body"),
    )
    # Thirty days of the table are one day here, and in idempotency_keys.
    return C.submitted(own, 500, 60, key_span=30)


_READS = "reads AS (SELECT event_id, user_id AS owner, CAST(floor(value) AS BIGINT) % 20 AS read_key, event_type = 'error' AS truncated, event_type = 'signup' AS reused FROM events)"


@ENTRIES.add(f"""WITH {_READS}, last AS (SELECT owner, read_key, max_by(event_id, event_id) AS output FROM reads WHERE NOT truncated AND NOT reused GROUP BY 1, 2)
  SELECT o_orderkey AS page_id, o_custkey % 150 AS owner, o_orderkey % 20 AS read_key, output FROM orders LEFT JOIN last ON owner = o_custkey % 150 AND read_key = o_orderkey % 20""")
def page_reuse(spark, sf_dir):
    prepare(spark)
    e = table(spark, sf_dir, "events")
    reads = e.select(
        F.col("user_id").alias("owner"), (F.floor("value") % 20).alias("read_key"), F.col("event_id").alias("output"), F.col("event_id").alias("written"), (F.col("event_type") == "error").alias("truncated"), (F.col("event_type") == "signup").alias("reused")
    )
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 150).alias("owner"), (F.col("o_orderkey") % 20).alias("read_key"))
    return C.reuse(pages, reads).select("page_id", "owner", "read_key", "output")


_COUNTERS = "counters AS (SELECT parse_id, count(*) FILTER (state IN ('queued', 'leased')) AS pages_open, count(*) FILTER (state = 'succeeded') AS pages_done, count(*) FILTER (state = 'failed') AS pages_failed, count(*) AS pages_total FROM tasks GROUP BY 1)"


@ENTRIES.add(f"WITH {SQL_TASKS}, {_COUNTERS} SELECT * FROM counters")
def settle_counters(spark, sf_dir):
    return C.settle_counters(tasks(spark, sf_dir))


@ENTRIES.add(f"""WITH {SQL_PARSES}, {_RETAINED}, {SQL_TASKS}, {_COUNTERS}, o AS (SELECT group_id, count(*) AS n FROM parses WHERE state IN ('queued', 'running') GROUP BY 1)
  SELECT parse_id, CASE WHEN state NOT IN ('succeeded', 'failed') THEN 'not_terminal' WHEN coalesce(pages_open, 0) > 0 THEN 'busy' WHEN finished_day + retention <= 19400 THEN 'expired'
    WHEN coalesce(pages_failed, 0) = 0 THEN 'nothing' WHEN coalesce(n, 0) >= 340 THEN 'queue_full' ELSE 'retried' END AS answer
  FROM retained LEFT JOIN counters USING (parse_id) LEFT JOIN o USING (group_id)""")
def retry_eligibility(spark, sf_dir):
    return C.retry_answer(retained(spark, sf_dir), C.settle_counters(tasks(spark, sf_dir)), 19400, 340)


@ENTRIES.add(f"""WITH {SQL_PARSES}, {SQL_TASKS} SELECT parse_id, page, task_key,
    '{{"parse_id":' || parse_id || ',"owner":' || owner || ',"group":' || group_id || ',"file_id":' || file_id || ',"page":' || page || '}}' AS context
  FROM tasks t JOIN parses p USING (parse_id) WHERE t.state = 'leased'""")
def claim_context(spark, sf_dir):
    return C.claim_context(tasks(spark, sf_dir), parses(spark, sf_dir))


@ENTRIES.add(f"WITH {SQL_TASKS}, {_COUNTERS} SELECT parse_id, pages_open + 1 AS held, pages_open AS counted FROM counters WHERE parse_id % 100 = 3")
def counters_recount(spark, sf_dir):
    own = tasks(spark, sf_dir)
    wrong = C.settle_counters(own).withColumn("pages_open", F.col("pages_open") + (F.col("parse_id") % 100 == 3).cast("long"))
    return C.recount(own, wrong, "pages_open", F.col("state").isin("queued", "leased"))


# --- lifecycles --------------------------------------------------------------------------------------------------

_HISTORY = """history AS (SELECT user_id AS entity, event_id AS "at", CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'leased' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'canceled' END AS state FROM events)"""


def history(spark, sf_dir):
    prepare(spark)
    t = F.col("event_type")
    state = F.when(t == "view", "queued").when(t == "click", "leased").when(t == "purchase", "succeeded").when(t == "error", "failed").otherwise("canceled")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("at"), state.alias("state"))


@ENTRIES.add(f"""WITH {_HISTORY}, steps AS (SELECT entity, "at", lag(state) OVER (PARTITION BY entity ORDER BY "at") AS before, state AS after FROM history)
  SELECT entity, "at", before, after FROM steps WHERE before IS NOT NULL AND before <> after
    AND (before, after) NOT IN (('queued', 'leased'), ('queued', 'canceled'), ('leased', 'queued'), ('leased', 'succeeded'), ('leased', 'failed'), ('leased', 'canceled'), ('succeeded', 'queued'), ('failed', 'queued'))""")
def illegal_transitions(spark, sf_dir):
    return K.illegal_transitions(history(spark, sf_dir), "task")


@ENTRIES.add(f"WITH {SQL_PARSES}, {SQL_TASKS} SELECT group_id, project_id, class, count(*) FILTER (t.state = 'queued') AS queued, count(*) FILTER (t.state = 'leased') AS running FROM tasks t JOIN parses USING (parse_id) GROUP BY ALL")
def service_counters(spark, sf_dir):
    return K.service_counters(tasks(spark, sf_dir), parses(spark, sf_dir), ["group_id", "project_id", "class"])


@ENTRIES.add(f"""WITH {SQL_PARSES}, {SQL_TASKS} SELECT p.parse_id, group_id, count(*) FILTER (t.state IN ('queued', 'leased')) AS canceled_tasks, CAST(greatest(9 - count(*) FILTER (t.state IN ('succeeded', 'failed')), 0) AS BIGINT) AS refund
  FROM parses p LEFT JOIN tasks t USING (parse_id) WHERE p.state IN ('queued', 'running') AND label = 'BUILDING' GROUP BY ALL""")
def cancel_cascade(spark, sf_dir):
    p = parses(spark, sf_dir).withColumn("reserved", F.lit(9))
    return K.cancel_cascade(p, tasks(spark, sf_dir), F.col("label") == "BUILDING")


@ENTRIES.add(f"WITH {SQL_PARSES} SELECT 'parses/' || event_id || '/result' AS object_key FROM events WHERE event_id NOT IN (SELECT parse_id FROM parses WHERE state <> 'failed')")
def orphan_objects(spark, sf_dir):
    prepare(spark)
    objects = table(spark, sf_dir, "events").select(F.concat(F.lit("parses/"), F.col("event_id"), F.lit("/result")).alias("object_key"))
    return K.orphans(objects, parses(spark, sf_dir).where("state <> 'failed'"))


# --- sets --------------------------------------------------------------------------------------------------------

_FIELDS = "fields AS (SELECT parse_id, file_id % 13 AS set_id, CASE state WHEN 'running' THEN 'pending' WHEN 'queued' THEN 'pending' ELSE state END AS state, tokens, priority, created_day, owner FROM parses)"


def fields(spark, sf_dir):
    p = parses(spark, sf_dir)
    state = F.when(F.col("state").isin("running", "queued"), "pending").otherwise(F.col("state"))
    return p.select("parse_id", (F.col("file_id") % 13).alias("set_id"), state.alias("state"), "tokens", "priority", "created_day", "owner")


@ENTRIES.add(f"WITH {SQL_PARSES}, {_FIELDS} SELECT set_id, count(*) AS total, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed FROM fields GROUP BY 1")
def set_counts(spark, sf_dir):
    return L.counts(fields(spark, sf_dir))


@ENTRIES.add("SELECT p_partkey AS set_id, p_brand AS name, p_size AS version FROM part WHERE p_brand = 'Brand#11' AND p_partkey < 1500 ORDER BY 1 DESC LIMIT 11")
def set_listing(spark, sf_dir):
    prepare(spark)
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("set_id"), F.col("p_brand").alias("name"), F.col("p_size").alias("version"))
    return L.listing(own, 10, name="Brand#11", after=1500)


@ENTRIES.add(f"WITH {SQL_PARSES}, {_FIELDS} SELECT parse_id, state, CASE WHEN state = 'succeeded' THEN tokens END AS total, CASE WHEN state = 'succeeded' THEN priority END AS urgency FROM fields WHERE set_id = 4 ORDER BY parse_id DESC LIMIT 100")
def set_table(spark, sf_dir):
    own = fields(spark, sf_dir)
    data = F.when(F.col("state") == "succeeded", F.to_json(F.struct(F.col("tokens").alias("total"), F.col("priority").alias("urgency"))))
    return L.as_table(own.withColumn("data", data), 4, "total long, urgency int", 100)


@ENTRIES.add(f"""WITH {SQL_PARSES}, facts AS (SELECT parse_id, state, tokens % 3 = 0 AS held, tokens % 3 = 0 AND file_id % 2 = 0 AS member, tokens, priority, owner FROM parses)
  SELECT parse_id, CASE WHEN parse_id % 17 = 0 THEN 'no_set' WHEN parse_id % 13 = 0 THEN 'missing' WHEN member AND tokens % 2 = 0 THEN 'joined' WHEN NOT member AND owner % 10 = 0 THEN 'full_set'
    WHEN NOT held AND priority = 5 THEN 'full' WHEN NOT held THEN 'asked' WHEN state IN ('queued', 'running') THEN 'busy' WHEN tokens % 5 < 3 AND priority < 4 THEN 'joined' ELSE 'asked' END AS answer FROM facts""")
def set_join_decision(spark, sf_dir):
    p, c = parses(spark, sf_dir), F.col
    facts = p.select(
        "parse_id", (c("parse_id") % 17 != 0).alias("set_found"), (c("parse_id") % 13 != 0).alias("parse_found"), (c("tokens") % 3 == 0).alias("field_found"), (c("file_id") % 2 == 0).alias("in_set"),
        (c("tokens") % 2 == 0).alias("same_version"), (c("owner") % 10 == 0).alias("set_full"), (c("priority") == 5).alias("parse_full"), c("state").isin("queued", "running").alias("field_pending"),
        (c("tokens") % 5 < 3).alias("same_request"), (c("priority") < 4).alias("same_pin"),
    )
    return facts.select("parse_id", L.join_answer().alias("answer"))


@ENTRIES.add(f"""WITH {SQL_PARSES} SELECT parse_id, CASE WHEN parse_id % 13 = 0 THEN 'missing' WHEN tokens % 3 <> 0 THEN 'absent' WHEN state IN ('queued', 'running') THEN 'busy' WHEN owner % 4 = 0 AND NOT (tokens % 2 = 0 AND priority < 4) THEN 'set' ELSE 'asked' END AS answer FROM parses""")
def field_ask_again(spark, sf_dir):
    p = parses(spark, sf_dir)
    facts = p.select(
        "parse_id", (F.col("parse_id") % 13 != 0).alias("parse_found"), (F.col("tokens") % 3 == 0).alias("field_found"), F.col("state").isin("queued", "running").alias("field_pending"), (F.col("owner") % 4 == 0).alias("in_set"),
        (F.col("tokens") % 2 == 0).alias("same_request"), (F.col("priority") < 4).alias("same_pin"),
    )
    return facts.select("parse_id", L.ask_again_answer().alias("answer"))


@ENTRIES.add(f"""WITH {SQL_PARSES} SELECT parse_id, CASE WHEN parse_id % 17 = 0 THEN 'no_set' WHEN parse_id % 13 = 0 THEN 'missing' WHEN tokens % 3 <> 0 THEN 'not_member' WHEN state IN ('queued', 'running') THEN 'busy' ELSE 'left' END AS answer FROM parses""")
def set_leave_decision(spark, sf_dir):
    p = parses(spark, sf_dir)
    facts = p.select("parse_id", (F.col("parse_id") % 17 != 0).alias("set_found"), (F.col("parse_id") % 13 != 0).alias("parse_found"), (F.col("tokens") % 3 == 0).alias("member"), F.col("state").isin("queued", "running").alias("field_pending"))
    return facts.select("parse_id", L.leave_answer().alias("answer"))


@ENTRIES.add(f"""WITH {SQL_PARSES}, {_FIELDS}, b AS (SELECT set_id, bool_or(state = 'pending' AND owner % 400 = 7) AS busy FROM fields GROUP BY 1)
  SELECT set_id, CASE WHEN busy THEN 'busy' WHEN set_id % 2 = 0 THEN 'same' ELSE 'updated' END AS answer, CASE WHEN NOT busy AND set_id % 2 = 1 THEN 4 ELSE 3 END AS version,
    CASE WHEN NOT busy AND set_id % 2 = 1 THEN n ELSE 0 END AS asked FROM b JOIN (SELECT set_id, count(*) AS n FROM fields GROUP BY 1) USING (set_id)""")
def set_update(spark, sf_dir):
    own = fields(spark, sf_dir)
    sets = own.select("set_id").distinct().select("set_id", F.lit(3).alias("version"), F.lit("a").alias("request"), F.when(F.col("set_id") % 2 == 0, "a").otherwise("b").alias("new_request"))
    return L.update(sets, own.withColumn("pending", (F.col("state") == "pending") & (F.col("owner") % 400 == 7)))


@ENTRIES.add(f"WITH {SQL_PARSES}, {_FIELDS} SELECT parse_id, CASE WHEN set_id <> 5 THEN set_id END AS set_id FROM fields")
def set_delete(spark, sf_dir):
    return L.detached(fields(spark, sf_dir), 5).select("parse_id", "set_id")
