"""Capacity of readers: ceilings that recover, ramps after a pause, breakers, backoff, and what an outcome does to a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.folds import fold

#: Fixed values, seconds: recovery, resume, pause, breaker's hold, and backoff's base and cap; failures that open a breaker; attempts and expiries of a task.
RECOVERY, RESUME, PAUSE, HOLD, BASE, CAP = 30, 10, 5, 30, 1, 60
FAILURES, ATTEMPTS, EXPIRIES = 3, 3, 3

#: The class of a failed call -> outcome, health, code.
OUTCOMES = {
    "rate_limited": ("wait", None, None),
    "budget": ("permanent", None, "budget_exhausted"),
    "permanent": ("permanent", None, "page_unreadable"),
    "refused": ("next", None, "page_unreadable"),
    "misconfigured": ("next", "failure", "reader_unavailable"),
    "invalid": ("retryable", None, "page_unreadable"),
    "retryable": ("retryable", "failure", "reader_unavailable"),
}


def ceiling(held: Column, since: Column, most: Column, now: Column, recovery: int = RECOVERY) -> Column:
    """A scope's ceiling now: a tenth of the pool, at least one, comes back for each whole recovery interval."""
    steps = F.greatest(F.floor((now - F.coalesce(since, now)) / recovery), F.lit(0))
    return F.least(most, held + steps * F.greatest(F.floor(most / 10), F.lit(1))).cast("long")


def admits(limit: Column, paused_until: Column, now: Column, resume: int = RESUME) -> Column:
    """Calls a scope may have in flight: after a pause a share of the ceiling that grows with the time since."""
    ramp = paused_until.isNotNull() & (now >= paused_until) & (now < paused_until + resume)
    return F.when(ramp, F.greatest(F.floor(limit * (now - paused_until) / resume), F.lit(1))).otherwise(limit).cast("long")


def room(pools: DataFrame, scopes: DataFrame, flying: DataFrame, scope: str, now: int) -> DataFrame:
    """One row: the readers with room for a scope, the paused ones, and when the first pause ends."""
    own = scopes.where(F.col("scope") == scope).select("reader_id", "ceiling", "raised_at", "paused_until")
    calls = flying.where(F.col("scope") == scope).groupBy("reader_id").agg(F.count(F.lit(1)).alias("in_flight"))
    rows = pools.join(own, "reader_id", "left").join(calls, "reader_id", "left")
    at = F.lit(now)
    limit = admits(ceiling(F.col("ceiling"), F.col("raised_at"), F.col("max_in_flight"), at), F.col("paused_until"), at)
    paused = F.coalesce(F.col("paused_until") > at, F.lit(False))
    has = F.col("ceiling").isNull() | (~paused & (F.coalesce("in_flight", F.lit(0)) < limit))
    return rows.agg(
        F.array_sort(F.collect_list(F.when(has, F.col("reader_id")))).alias("room"),
        F.array_sort(F.collect_list(F.when(paused, F.col("reader_id")))).alias("paused"),
        F.min(F.when(paused, F.col("paused_until"))).alias("wake"),
    )


def backoff(attempt: Column, base: int = BASE, cap: int = CAP) -> Column:
    """Seconds until an attempt may be made again, without the jitter of up to a half."""
    return F.least(F.lit(cap).cast("double"), base * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30))))


def outcome_of(error_class: Column) -> Column:
    """struct(outcome, health, code) of a failed call; an unknown class may pass."""
    out = F.lit(None)
    for name, (outcome, health, code) in reversed(OUTCOMES.items()):
        this = F.struct(F.lit(outcome).alias("outcome"), F.lit(health).cast("string").alias("health"), F.lit(code).cast("string").alias("code"))
        out = this if name == "retryable" else F.when(error_class == name, this).otherwise(out)
    return out


#: Words in a reply that tell of a spent budget, looked for in its first 4,096 bytes.
BUDGET_WORDS = ("budget_exhausted", "spend_exceeded", "insufficient_quota", "billing_hard_limit")


def error_class(status: Column, body: Column, retry_after: Column | None = None) -> Column:
    """The class of an HTTP reply that isn't a success; retry_after in seconds, null or 0 for none."""
    broke = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 4096)).rlike("|".join(BUDGET_WORDS))
    waits = F.coalesce(retry_after > 0, F.lit(False)) if retry_after is not None else F.lit(False)
    return (
        F.when((status == 402) | broke, "budget").when((status == 429) | ((status == 503) & waits), "rate_limited").when(status.isin(408, 409) | (status >= 500), "retryable").when(status.isin(413, 415), "permanent").otherwise("misconfigured")
    )


def settled(rows: DataFrame) -> DataFrame:
    """What one settle makes of a task. rows: outcome, attempt, invalid (replies so far), unusable (this reply), escalated,
    pinned, stuck, chain_at, next_at (the reader's place in the chain, null if it left), chain_size."""
    o, c = F.col("outcome"), F.col
    following = F.coalesce(c("next_at"), c("chain_at") + 1)
    moves = (~c("pinned") | c("stuck")) & (following < c("chain_size"))
    bad = c("invalid") + F.when(c("unusable"), 1).otherwise(0)
    escalates = (o == "retryable") & c("unusable") & (bad >= 2) & ~c("escalated") & moves
    fails = (o == "permanent") | ((o == "retryable") & ~escalates & (c("attempt") + 1 >= ATTEMPTS)) | ((o == "next") & ~moves)
    jumps = escalates | ((o == "next") & moves)
    fresh = jumps | (o == "continue")
    return rows.select(
        "*",
        F.when(o == "succeeded", "succeeded").when(fails, "failed").otherwise("queued").alias("state"),
        F.when(fresh, 0).when(o == "retryable", c("attempt") + 1).otherwise(c("attempt")).alias("new_attempt"),
        F.when(fresh, 0).when(o == "retryable", bad).otherwise(c("invalid")).alias("new_invalid"),
        F.when(jumps, following).otherwise(c("chain_at")).alias("new_chain_at"),
        (c("escalated") | escalates).alias("new_escalated"),
        F.when(jumps & c("stuck"), False).when(o == "continue", True).otherwise(c("pinned")).alias("new_pinned"),
        F.when((o == "retryable") & ~escalates & ~fails, backoff(c("attempt") + 1)).when(o == "wait", F.lit(float(PAUSE))).otherwise(F.lit(0.0)).alias("delay"),
    )


def limited(events: DataFrame) -> DataFrame:
    """Rate-limit replies of each scope in their order: the ceiling halves once per pause, pauses only grow.

    events: scope, at, leased_at, wait, most. Rows: scope, at, ceiling, paused_until behind each reply. A fold, as each
    reply is judged by when the last halving was.
    """

    def reply(state, r):
        held, halved, raised, until = state
        back = 0 if raised is None else max(0, (r.at - raised) // RECOVERY) * max(1, r.most // 10)
        now = min(r.most, (r.most if held is None else held) + back)
        if halved is None or r.leased_at > halved:
            now, halved = max(1, now // 2), r.at
        until = max(until or 0, r.at + r.wait)
        return (now, halved, r.at, until), (r.at, now, until)

    own = events.select("scope", "at", "leased_at", "wait", "most")
    return fold(own, ["scope"], ["at", "leased_at"], lambda: (None, None, None, None), reply, "at long, ceiling long, paused_until long")


def breaker(events: DataFrame) -> DataFrame:
    """A reader's breaker behind each settle: it opens at FAILURES in a row; a failure of a call leased since it opened opens
    it anew, a success closes it, other outcomes say nothing. events: reader_id, at, leased_at, health."""

    def settle(state, r):
        failures, opened = state
        if r.health == "success":
            failures, opened = 0, None
        elif r.health == "failure":
            failures += 1
            if (failures >= FAILURES) if opened is None else (r.leased_at > opened):
                opened = r.at
        return (failures, opened), (r.at, failures, opened)

    own = events.select("reader_id", "at", "leased_at", "health")
    return fold(own, ["reader_id"], ["at", "leased_at"], lambda: (0, None), settle, "at long, failures long, opened_at long")


def breaker_state(opened_at: Column, now: Column) -> Column:
    return F.when(opened_at.isNull(), "closed").when(now < opened_at + HOLD, "open").otherwise("trial")


def reaped(tasks: DataFrame, dead: DataFrame) -> DataFrame:
    """Leased tasks of workers that are gone: they go back, or fail at EXPIRIES with their kind's code."""
    own = tasks.where("state = 'leased'").join(dead, "worker", "left_semi")
    fails = F.col("expiries") + 1 >= EXPIRIES
    code = F.when(fails, F.when(F.col("kind") == "page", "page_unreadable").otherwise("internal"))
    return own.select("parse_id", "page", "task_key", F.when(fails, "failed").otherwise("queued").alias("new_state"), (F.col("expiries") + 1).alias("new_expiries"), code.alias("new_code"))


def reconciled(held: DataFrame, leased: DataFrame, settled_: DataFrame, worker: int) -> tuple[DataFrame, DataFrame]:
    """A worker's exchange: (lost: held by it but not leased to it under that token; requeued: leased to it, neither held nor settled)."""
    key = ["parse_id", "page", "token"]
    mine = leased.where(F.col("worker") == worker)
    return held.join(mine, key, "left_anti"), mine.join(held, key, "left_anti").join(settled_, key, "left_anti")
