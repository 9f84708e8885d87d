"""Lifecycles: the closed tables of allowed transitions, audits against them, counters and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From each state the states that may follow.
TRANSITIONS: dict[str, dict[str, tuple[str, ...]]] = {
    "parse": {
        "queued": ("running", "failed", "canceled"),
        "running": ("succeeded", "failed", "canceled"),
        "succeeded": ("running", "gone"),
        "failed": ("running", "gone"),
        "canceled": ("gone",),
        "gone": (),
    },
    "stage": {"queued": ("preparing",), "preparing": ("reading", "assembling"), "reading": ("assembling",), "assembling": ("done",), "done": ()},
    "task": {"queued": ("leased", "canceled"), "leased": ("queued", "succeeded", "failed", "canceled"), "succeeded": ("queued",), "failed": ("queued",), "canceled": ()},
    "field": {"pending": ("succeeded", "failed"), "succeeded": ("pending",), "failed": ("pending",)},
    "figure": {"pending": ("succeeded", "failed"), "succeeded": ("pending",), "failed": ("pending", "succeeded")},
    "run": {"running": ("succeeded", "failed"), "succeeded": ("running",), "failed": ("running", "succeeded")},
    "file": {"live": ("deleting",), "deleting": ("gone",), "gone": ()},
    "breaker": {"closed": ("open",), "open": ("closed",)},
}


def allowed(machine: str, before: Column, after: Column) -> Column:
    """Whether a machine may go from one state to the next; staying is no transition."""
    pairs = [f"{a}>{b}" for a, followers in TRANSITIONS[machine].items() for b in followers]
    return F.concat(before, F.lit(">"), after).isin(pairs)


def illegal_transitions(history: DataFrame, machine: str) -> DataFrame:
    """Steps of an entity's states (entity, at, state) that its machine doesn't allow."""
    before = F.lag("state").over(Window.partitionBy("entity").orderBy("at"))
    steps = history.select("entity", "at", before.alias("before"), F.col("state").alias("after"))
    return steps.where("before is not null and before <> after").where(~allowed(machine, F.col("before"), F.col("after")))


def unknown_states(history: DataFrame, machine: str) -> DataFrame:
    return history.where(~F.col("state").isin(list(TRANSITIONS[machine])))


def service_counters(tasks: DataFrame, parses: DataFrame, by: list[str]) -> DataFrame:
    """Queued and running tasks, counted from the tasks."""
    joined = tasks.select("parse_id", F.col("state").alias("task_state")).join(parses.select("parse_id", *by), "parse_id")
    return joined.groupBy(*by).agg(F.count_if(F.col("task_state") == "queued").alias("queued"), F.count_if(F.col("task_state") == "leased").alias("running"))


def cancel_cascade(parses: DataFrame, tasks: DataFrame, chosen: Column) -> DataFrame:
    """What canceling the chosen open parses does: their queued and leased tasks end, pages never read go back."""
    own = parses.where(F.col("state").isin("queued", "running") & chosen).select("parse_id", "group_id", "reserved")
    joined = own.join(tasks.select("parse_id", "state"), "parse_id", "left")
    read = F.count_if(F.col("state").isin("succeeded", "failed"))
    return joined.groupBy("parse_id", "group_id").agg(
        F.count_if(F.col("state").isin("queued", "leased")).alias("canceled_tasks"), F.greatest(F.max("reserved") - read, F.lit(0)).cast("long").alias("refund")
    )


def overdue(parses: DataFrame, now: int) -> DataFrame:
    """Open parses past their deadline, as they end."""
    late = parses.where(F.col("state").isin("queued", "running") & (F.col("deadline") <= now))
    return late.withColumn("state", F.lit("failed")).withColumn("code", F.lit("deadline_exceeded"))


def overdue_cascade(parses: DataFrame, tasks: DataFrame, now: int) -> DataFrame:
    """What ending overdue parses does to their tasks: those queued or leased are canceled. parse_id, task_key, before."""
    late = parses.where(F.col("state").isin("queued", "running") & (F.col("deadline") <= now)).select("parse_id")
    return tasks.where(F.col("state").isin("queued", "leased")).join(late, "parse_id", "left_semi").select("parse_id", "task_key", F.col("state").alias("before"))


def overdue_fields(fields: DataFrame, tasks: DataFrame, now: int) -> DataFrame:
    """Pending extractions past their deadline, as they end, with the calls and tokens that their tasks used until then."""
    late = fields.where((F.col("state") == "pending") & (F.col("deadline") <= now)).drop("calls", "input_tokens", "output_tokens")
    used = tasks.select("parse_id", "name", "calls", "input_tokens", "output_tokens")
    rows = late.join(used, ["parse_id", "name"], "left")
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "input_tokens", "output_tokens")]
    return rows.select("parse_id", "name", F.lit("failed").alias("state"), F.lit("deadline_exceeded").alias("code"), *sums)


def overdue_figures(runs: DataFrame, figures: DataFrame, now: int) -> DataFrame:
    """Running figure runs past their deadline: parse_id, how many pending figures are lost to them, failed then, and the run's end.

    runs: parse_id, state, deadline, failed, done. A run of which something was described succeeds; else it fails.
    """
    late = runs.where((F.col("state") == "running") & (F.col("deadline") <= now))
    lost = figures.where("state = 'pending'").groupBy("parse_id").agg(F.count(F.lit(1)).alias("lost"))
    rows = late.join(lost, "parse_id", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    return rows.select("parse_id", "lost", (F.col("failed") + F.col("lost")).alias("failed"), F.when(F.col("done") > 0, "succeeded").otherwise("failed").alias("state"))


def orphans(objects: DataFrame, parses: DataFrame) -> DataFrame:
    """Stored objects (object_key: parses/<id>/..) of parses that no row names."""
    keyed = objects.withColumn("parse_id", F.split_part("object_key", F.lit("/"), F.lit(2)).cast("long"))
    return keyed.join(parses.select("parse_id"), "parse_id", "left_anti").select("object_key")


def finish_state(error: Column, overdue_: Column, canceled: Column, failed: Column, allowed_failed: Column) -> Column:
    """How a parse ends."""
    return F.when(canceled, "canceled").when(overdue_, "failed").when(error.isNotNull(), "failed").when(failed > allowed_failed, "failed").otherwise("succeeded")
