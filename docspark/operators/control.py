"""Control-plane queries: usage, queues, listings, retention, admission."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators import capacity
from docspark.operators.folds import fold, fold_arrays

SUMS = ("pages", "calls", "input_tokens", "output_tokens")
#: Most intervals of one usage read, parses of one sweep, and hours an idempotency key is held.
MAX_INTERVALS, SWEEP, KEY_HOURS = 1000, 200, 24


def usage(attempts: DataFrame, key: str, interval: str, since: str | None = None, until: str | None = None, owners: list[str] | None = None, groups: list[str] | None = None) -> DataFrame:
    """Sums by one key (group_id, owner or reader) over hours or days that begin in [since, until)."""
    rows = attempts
    if since is not None:
        rows = rows.where(F.col("hour") >= since)
    if until is not None:
        rows = rows.where(F.col("hour") < until)
    if owners is not None:
        rows = rows.where(F.col("owner").isin(owners))
    if groups is not None:
        rows = rows.where(F.col("group_id").isin(groups))
    return rows.groupBy(F.col(key).alias("key"), F.col(interval).alias("start")).agg(*[F.sum(x).alias(x) for x in SUMS])


def meter(attempts: DataFrame) -> DataFrame:
    """The meter's rows: sums by hour, group, owner, kind and reader."""
    return attempts.groupBy("hour", "group_id", "owner", "kind", "reader").agg(*[F.sum(x).alias(x) for x in SUMS])


def aligned_span(since: Column, until: Column, seconds: int) -> Column:
    """struct(since, until, code) in epoch seconds: since down and until up to whole intervals; too many are refused."""
    a, z = F.floor(since / seconds) * seconds, F.ceil(until / seconds) * seconds
    return F.struct(a.alias("since"), z.alias("until"), F.when(z <= a, "invalid_request").when((z - a) / seconds > MAX_INTERVALS, "invalid_request").alias("code"))


def queue_groups(parses: DataFrame, tasks: DataFrame, by: list[str]) -> DataFrame:
    """Open parses, and queued and running tasks of each class, for each group (and project) that has an open parse."""
    open_parses = parses.where(F.col("state").isin("queued", "running"))
    heads = open_parses.groupBy(*by).agg(F.count(F.lit(1)).alias("parses"))
    work = tasks.where(F.col("state").isin("queued", "leased")).select("parse_id", F.col("state").alias("task_state")).join(open_parses.select("parse_id", "class", *by), "parse_id")
    counts = work.groupBy(*by).agg(*[F.count_if((F.col("class") == c) & (F.col("task_state") == s)).alias(f"{name}_{what}") for c, name in ((0, "interactive"), (1, "batch")) for s, what in (("queued", "queued"), ("leased", "running"))])
    names = [c for c in counts.columns if c not in by]
    return heads.join(counts, by, "left").select(*by, "parses", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def queue_pools(pools: DataFrame, tasks: DataFrame, now: int, open_seconds: int = 30) -> DataFrame:
    """Each pool with its calls in flight and its breaker: closed, open, or trial once open_seconds have passed."""
    flying = tasks.where("state = 'leased'").groupBy("reader_id").agg(F.count(F.lit(1)).alias("in_flight"))
    breaker = F.when(F.col("opened_at").isNull(), "closed").when(F.lit(now) < F.col("opened_at") + open_seconds, "open").otherwise("trial")
    return pools.join(flying, "reader_id", "left").select("reader_id", "max_in_flight", F.coalesce("in_flight", F.lit(0)).alias("in_flight"), breaker.alias("breaker"))


def listing(parses: DataFrame, limit: int, owners: list[int] | None = None, states: list[str] | None = None, after: int | None = None, file_id: int | None = None, labels: dict[str, str] | None = None, origin: dict[str, str] | None = None) -> DataFrame:
    """The newest parses below a cursor, one more than the limit so a caller sees whether there are more.

    origin: what members of the JSON in the column origin must be, by their paths ("source.name").
    """
    rows = parses
    for name, wanted in (("owner", owners), ("state", states)):
        if wanted is not None:
            rows = rows.where(F.col(name).isin(wanted))
    if after is not None:
        rows = rows.where(F.col("parse_id") < after)
    if file_id is not None:
        rows = rows.where(F.col("file_id") == file_id)
    for k, v in (labels or {}).items():
        rows = rows.where(F.col("labels")[k] == v)
    for path, v in (origin or {}).items():
        rows = rows.where(F.get_json_object("origin", "$." + path) == v)
    return rows.orderBy(F.desc("parse_id")).limit(limit + 1)


def merged_filter(owners: list | None, allowed: list | None, labels: dict, forced: dict) -> tuple[list | None, dict] | None:
    """A caller's filter within what it may see: owners meet, labels join; None where they contradict and nothing can match."""
    both = allowed if owners is None else owners if allowed is None else [x for x in owners if x in set(allowed)]
    if any(labels.get(k, v) != v for k, v in forced.items()) or both == []:
        return None
    return both, labels | forced


def filter_met(asked: Column, allowed: Column, wanted: Column, forced: Column) -> Column:
    """merged_filter of columns: struct(owners, labels), null where nothing can match. A null list of owners is everybody, a
    null map of labels is none. Built-in expressions only."""
    both = F.when(asked.isNull(), allowed).when(allowed.isNull(), asked).otherwise(F.filter(asked, lambda x: F.array_contains(allowed, x)))
    none = F.create_map().cast("map<string,string>")
    own, must = F.coalesce(wanted, none), F.coalesce(forced, none)
    against = F.exists(F.map_entries(must), lambda e: F.coalesce(own[e["key"]] != e["value"], F.lit(False)))
    labels = F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(must), k)), must)
    return F.when(~against & F.coalesce(F.size(both) > 0, F.lit(True)), F.struct(both.alias("owners"), labels.alias("labels")))


def failure_codes(tasks: DataFrame) -> DataFrame:
    """A parse's failure: the one code of its failed pages, or page_unreadable where they differ."""
    failed = tasks.where("state = 'failed'").groupBy("parse_id").agg(F.min("code").alias("lo"), F.max("code").alias("hi"))
    return failed.select("parse_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("page_unreadable").alias("code"))


def file_expiry(files: DataFrame, parses: DataFrame) -> DataFrame:
    """When a file may go: its own bound or its last parse's end and retention, whichever is later; nulls say nothing."""
    last = parses.groupBy("file_id").agg(F.max(F.col("finished_day") + F.col("retention")).alias("last"))
    return files.join(last, "file_id", "left").select("file_id", F.greatest("kept_until", "last").alias("expires_day"))


def expired_parses(parses: DataFrame, now: int, limit: int = SWEEP) -> DataFrame:
    """The parses whose retention ended, the longest past first."""
    ends = F.col("finished_day") + F.col("retention")
    return parses.where(ends <= now).select("parse_id", ends.alias("expires_day")).orderBy("expires_day", "parse_id").limit(limit)


def idle_files(files: DataFrame, parses: DataFrame) -> DataFrame:
    """Files that no open parse reads."""
    return files.join(parses.where(F.col("state").isin("queued", "running")), "file_id", "left_anti")


def admitted(arrivals: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """Arrivals at an empty queue, none of which ends: the first most of each group are created, the others refused."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return arrivals.withColumn("outcome", F.when(n <= most, "created").otherwise("queue_full"))


def reserved(requests: DataFrame, limit: int) -> DataFrame:
    """Day budgets: in the order of seq a request is granted if its group's day total stays within the limit; one that is
    refused takes nothing. A fold over each group's day, as a refusal leaves room for a smaller request behind it."""

    def answers(rows: list[tuple]) -> list[tuple]:
        out, total = [], 0
        for parse_id, pages in rows:
            fits = total + pages <= limit
            total += pages if fits else 0
            out.append((parse_id, pages, fits))
        return out

    own = requests.select("group_id", "day", *[F.col(c).cast("long").alias(c) for c in ("seq", "pages", "parse_id")])
    return fold_arrays(own, ["group_id", "day"], ["seq"], ["parse_id", "pages"], answers, "parse_id:bigint,pages:bigint,granted:boolean")


def refunds(parses: DataFrame, tasks: DataFrame) -> DataFrame:
    """Pages that an ended parse reserved and never read, by group."""
    read = tasks.where("state in ('succeeded', 'failed')").groupBy("parse_id").agg(F.count(F.lit(1)).alias("read"))
    ended = parses.where("state in ('succeeded', 'failed', 'canceled')").join(read, "parse_id", "left")
    return ended.groupBy("group_id").agg(F.sum(F.greatest(F.col("reserved") - F.coalesce("read", F.lit(0)), F.lit(0))).alias("refund"))


def idempotency(requests: DataFrame, hours: int = KEY_HOURS) -> DataFrame:
    """What a request under a key meets: created by the first, then by the first after each window ends; within it, exists
    for the same body and conflict for another. hour orders the requests; the window counts from the request that created."""

    def answers(rows: list[tuple]) -> list[tuple]:
        out, since, held = [], None, None
        for request_id, hour, body in rows:
            if since is None or hour >= since + hours:
                since, held, said = hour, body, "created"
            else:
                said = "exists" if body == held else "conflict"
            out.append((request_id, said))
        return out

    own = requests.select("owner", "key", F.col("hour").cast("long").alias("hour"), F.col("request_id").cast("long").alias("request_id"), "body")
    return fold_arrays(own, ["owner", "key"], ["hour", "request_id"], ["request_id", "hour", "body"], answers, "request_id:bigint,outcome:string")


def submitted(requests: DataFrame, max_queued: int, pages_per_day: int, key_span: int = KEY_HOURS) -> DataFrame:
    """The answers to submissions in their order, for each group: exists, conflict, file_not_found, queue_full,
    budget_exhausted or created. Rows: group_id, seq, parse_id, file_known, pages, day, and where known at, ends, owner, key
    and body. A fold: what is refused takes neither a place, nor pages, nor a key.

    A created parse holds its place until it ends: one that ended before a request's time leaves room for it. at is that time
    (seq where there is no such column), ends that of the parse's end, in the same unit; null: it doesn't end. A key of an
    owner is held for key_span from the request that created: exists for the same body, conflict for another. A parse id and
    an owner's keys are of one group.
    """

    def answer(state, r):
        seen, keys, ends, day, used = state
        used = used if day == r.day else 0
        while ends and ends[0] < r.at:
            heapq.heappop(ends)
        name = (r.owner, r.key)
        since, body = keys.get(name, (None, None))
        if r.parse_id in seen:
            outcome = "exists"
        elif since is not None and r.at - since < key_span:
            outcome = "exists" if r.body == body else "conflict"
        elif not r.file_known:
            outcome = "file_not_found"
        elif len(ends) >= max_queued:
            outcome = "queue_full"
        elif used + r.pages > pages_per_day:
            outcome = "budget_exhausted"
        else:
            outcome, used = "created", used + r.pages
            seen.add(r.parse_id)
            heapq.heappush(ends, math.inf if r.ends is None else r.ends)
            if r.key is not None:
                keys[name] = r.at, r.body
        return (seen, keys, ends, r.day, used), (r.parse_id, outcome)

    none = {"at": F.col("seq"), "ends": F.lit(None).cast("long"), **dict.fromkeys(("owner", "key", "body"), F.lit(None).cast("string"))}
    more = [F.col(c) if c in requests.columns else other.alias(c) for c, other in none.items()]
    own = requests.select("group_id", "seq", "parse_id", "file_known", "pages", "day", *more)
    return fold(own, ["group_id"], ["seq", "parse_id"], lambda: (set(), {}, [], None, 0), answer, "parse_id long, outcome string")


def reuse(pages: DataFrame, reads: DataFrame) -> DataFrame:
    """Each page with the last whole output written under its key; a truncated or reused output is none."""
    last = reads.where("not truncated and not reused").groupBy("owner", "read_key").agg(F.max_by("output", "written").alias("output"))
    return pages.join(last, ["owner", "read_key"], "left")


def settle_counters(tasks: DataFrame) -> DataFrame:
    """Pages open, done, failed and in all, of each parse; where tasks say which were reused, those too."""
    s = F.col("state")
    more = [F.count_if((s == "succeeded") & F.coalesce("reused", F.lit(False))).alias("pages_reused")] if "reused" in tasks.columns else []
    return tasks.groupBy("parse_id").agg(
        *more,
        F.count_if(s.isin("queued", "leased")).alias("pages_open"), F.count_if(s == "succeeded").alias("pages_done"), F.count_if(s == "failed").alias("pages_failed"), F.count(F.lit(1)).alias("pages_total")
    )


def retry_answer(parses: DataFrame, counters: DataFrame, now: int, max_queued: int) -> DataFrame:
    """Whether a parse may be retried: the first refusal that holds, else retried."""
    open_by_group = parses.where(F.col("state").isin("queued", "running")).groupBy("group_id").agg(F.count(F.lit(1)).alias("open_parses"))
    p = parses.join(counters, "parse_id", "left").join(open_by_group, "group_id", "left")
    answer = (
        F.when(~F.col("state").isin("succeeded", "failed"), "not_terminal")
        .when(F.coalesce("pages_open", F.lit(0)) > 0, "busy")
        .when(F.col("finished_day") + F.col("retention") <= now, "expired")
        .when(F.coalesce("pages_failed", F.lit(0)) == 0, "nothing")
        .when(F.coalesce("open_parses", F.lit(0)) >= max_queued, "queue_full")
        .otherwise("retried")
    )
    return p.select("parse_id", answer.alias("answer"))


def retry_answers(asked: DataFrame, parses: DataFrame, tasks: DataFrame, groups: DataFrame, used: DataFrame, now: int) -> DataFrame:
    """What asking for a retry meets: missing, not_terminal, busy, expired, unassembled, nothing, gone, queue_full,
    budget_exhausted or retried; the first that holds. Each is judged alone, as things stand.

    asked: owner, parse_id. parses: parse_id, owner, group_id, state, index_key, expires, pages_failed, pages_total. tasks: their
    pages' rows (parse_id, state). groups: group_id, max_queued, pages_per_day (null or 0: no bound). used: group_id and the
    pages its day has taken. A parse of another owner is missing; repeated asks are each answered; nulls in asked are missing.
    """
    s = F.col("state")
    rows = tasks.groupBy("parse_id").agg(F.count_if(s.isin("queued", "leased")).alias("open"), F.count_if(s == "failed").alias("failed"), F.count(F.lit(1)).alias("rows"))
    running = parses.where(s.isin("queued", "running")).groupBy("group_id").agg(F.count(F.lit(1)).alias("open_parses"))
    facts = parses.join(rows, "parse_id", "left").join(groups, "group_id", "left").join(running, "group_id", "left").join(used.select("group_id", F.col("pages").alias("taken")), "group_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    answer = (
        F.when(s.isNull(), "missing").when(s.isin("queued", "running"), "not_terminal").when(zero("open") > 0, "busy").when(F.col("expires") <= now, "expired").when(F.col("index_key").isNull(), "unassembled")
        .when(F.col("pages_failed") == 0, "nothing").when((zero("failed") != F.col("pages_failed")) | (zero("rows") != F.col("pages_total")), "gone")
        .when((zero("max_queued") > 0) & (zero("open_parses") >= F.col("max_queued")), "queue_full").when((zero("pages_per_day") > 0) & (zero("taken") + F.col("failed") > F.col("pages_per_day")), "budget_exhausted").otherwise("retried")
    )
    return asked.join(facts, ["owner", "parse_id"], "left").select("owner", "parse_id", answer.alias("answer"))


#: What a claim of each kind is told beside the owner.
TOLD = {"prepare": ("file", "pages"), "page": ("languages", "manifest", "reuse"), "assemble": ("manifest",), "extract": ("manifest", "index", "request", "progress"), "figure": ("languages", "figure")}


def claim_told(claims: DataFrame) -> DataFrame:
    """claims with context: what a worker is told, as JSON, by the claim's kind; what is null isn't told.

    claims: kind, owner, and of TOLD's columns those there are, each null where the parse has none. A page's manifest is its
    selection left out (manifest and selected are columns of their own), a figure's is {page, reuse}.
    """
    names = ["owner", *dict.fromkeys(n for own in TOLD.values() for n in own)]
    told = [F.col(n) if n == "owner" else F.when(F.col("kind").isin([k for k, own in TOLD.items() if n in own]), F.col(n)) for n in names if n in claims.columns]
    body = F.struct(*[c.alias(n) for c, n in zip(told, [n for n in names if n in claims.columns], strict=True)])
    return claims.withColumn("context", F.to_json(body))


def queue_bounds(view: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """queue_groups' rows with the weight, and where there are any the bounds, of their group or project; 1 without a weight."""
    more = [c for c in ("max_running", "max_queued") if c in bounds.columns]
    return view.join(bounds.select(*by, "weight", *more), by, "left").withColumn("weight", F.coalesce("weight", F.lit(1)))


def queue_scopes(pools: DataFrame, scopes: DataFrame, calls: DataFrame, now: int, groups: list[str] | None = None) -> DataFrame:
    """Each pool's scopes: the ceiling as it has recovered by now, the pause that is on, and calls in flight.

    Of some groups, only their scopes and the shared one (''), and their calls.
    """
    own, flying = scopes, calls
    if groups is not None:
        own, flying = own.where(F.col("scope").isin("", *groups)), flying.where(F.col("group_id").isin(groups))
    flying = flying.groupBy("reader_id", "scope").agg(F.count(F.lit(1)).alias("in_flight"))
    held = capacity.ceiling(F.col("ceiling"), F.col("raised_at"), F.col("max_in_flight"), F.lit(now))
    paused = F.when(F.col("paused_until") > now, F.col("paused_until"))
    rows = own.join(pools.select("reader_id", "max_in_flight"), "reader_id").join(flying, ["reader_id", "scope"], "left")
    return rows.select("reader_id", "scope", held.alias("ceiling"), paused.alias("paused_until"), F.coalesce("in_flight", F.lit(0)).alias("in_flight"))


def usage_window(since: Column, until: Column, now: Column, hourly: bool) -> Column:
    """aligned_span with what is left out filled in: until now, and since a day before it by the hour, 30 days by the day."""
    end = F.coalesce(until, now)
    return aligned_span(F.coalesce(since, end - (86_400 if hourly else 30 * 86_400)), end, 3600 if hourly else 86_400)


def claim_context(tasks: DataFrame, parses: DataFrame) -> DataFrame:
    """What a worker is told with a claimed task, as JSON by the task's kind."""
    joined = tasks.where("state = 'leased'").join(parses.select("parse_id", "owner", "group_id", "file_id"), "parse_id")
    body = F.struct("parse_id", "owner", F.col("group_id").alias("group"), "file_id", "page")
    return joined.select("parse_id", "page", "task_key", F.to_json(body).alias("context"))


def recount(tasks: DataFrame, counters: DataFrame, name: str, condition: Column) -> DataFrame:
    """Parses whose counter differs from a recount of its tasks; none, if the counters are right."""
    counted = tasks.groupBy("parse_id").agg(F.count_if(condition).alias("counted"))
    return counters.join(counted, "parse_id", "full").where(~F.col(name).eqNullSafe(F.col("counted"))).select("parse_id", F.col(name).alias("held"), "counted")
