"""Weighted start-time fair queuing over three levels: class, group, project.

For a backlog that is all there before the first dispatch, an entity's virtual time at each of its turns is the sum of
cost * 1000000 div weight over its turns before. So the order at each level is a sort by that sum, and the whole order is
three nested orders. dispatch_arrivals also holds for arrivals over time: a fold until the last one, then such sorts.
"""

from __future__ import annotations

import functools
import heapq
from collections import Counter, deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docspark.operators.folds import running
from docspark.session import written

#: Virtual time is in millionths; the classes' weights; the most a weight may be; interactive turns to a batch turn.
UNIT, CLASS_WEIGHTS, MAX_WEIGHT, INTERACTIVE_SHARE = 1_000_000, {0: 4, 1: 1}, 1000, 4


def clamped_weight(w: Column) -> Column:
    return F.least(F.greatest(F.coalesce(w, F.lit(1)), F.lit(1)), F.lit(MAX_WEIGHT))


def _tag(entity: list[str], order: list[str], weight: str) -> Column:
    """An entity's virtual time before each of its rows in order."""
    before = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.expr(f"cast(cost as bigint) * {UNIT} div {weight}")).over(before), F.lit(0))


def merged(rows: DataFrame, entity: list[str], order: list[str], weight: str, name: str, scope: list[str], spread: bool = False) -> DataFrame:
    """rows with name: the place of each in the order that serves the entities of a scope by their virtual times.

    A scope is one task's work, or with spread that of many: for scopes that grow with the backlog.
    """
    if not spread:
        tagged = rows.withColumn("__tag", _tag(scope + entity, order, weight))
        place = F.row_number().over(Window.partitionBy(*scope).orderBy("__tag", *entity, *order))
        return tagged.withColumn(name, place.cast("long")).drop("__tag")
    tagged = running(rows, scope + entity, order, {"__tag": F.expr(f"cast(cost as bigint) * {UNIT} div {weight}")})
    return running(tagged, scope, ["__tag", *entity, *order], {name: F.lit(1)}).withColumn(name, F.col(name) + 1).drop("__tag")


def dispatch_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """seq: the order of dispatch of a whole backlog. rows: class, group_id, project_id, cost, class_weight, group_weight,
    project_weight, and the columns that order tasks inside a project."""
    out = merged(rows, ["project_id"], order, "project_weight", "in_group", ["class", "group_id"])
    out = merged(out, ["group_id"], ["in_group"], "group_weight", "in_class", ["class"], spread=True)
    return merged(out, ["class"], ["in_class"], "class_weight", "seq", [], spread=True)


def charge_correction(used: Column, charged: Column, weight: Column) -> Column:
    """What an entity's virtual time moves by once a task's use is known; division goes toward zero."""
    delta = (used - charged).cast("bigint") * UNIT
    q = F.floor(F.abs(delta) / weight)
    return F.when(delta < 0, -q).otherwise(q).cast("bigint")


def lane(kind: Column, pin: Column, chain_at: Column) -> Column:
    """Tasks of one lane have room together or have none."""
    return (
        F.when(kind.isin("prepare", "assemble"), "").when(pin.isNotNull(), F.concat(kind, F.lit(":"), pin)).when(chain_at == 0, kind).otherwise(F.concat(kind, F.lit("@"), chain_at.cast("string")))
    )


def reader_at(chain: Column, chain_at: Column, skip: Column) -> Column:
    """The first reader behind a place of the chain that isn't skipped; null if there is none."""
    rest = F.slice(chain, chain_at + 1, F.greatest(F.size(chain) - chain_at, F.lit(0)))
    return F.try_element_at(F.filter(rest, lambda r: ~F.array_contains(skip, r)), F.lit(1))


def runnable_lanes(lanes: Column, kinds: Column) -> Column:
    """The lanes of the kinds a worker takes; the lane without a name is for all."""
    return F.filter(lanes, lambda x: (x == "") | F.exists(kinds, lambda k: (x == k) | x.startswith(F.concat(k, F.lit("@"))) | x.startswith(F.concat(k, F.lit(":")))))


def turn_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """seq of a whole backlog in the small queue: owners take turns in each class, in the order of their first job, and a
    batch job follows every INTERACTIVE_SHARE interactive ones. rows: class, owner, arrival and what orders an owner's jobs."""
    own = rows.withColumn("__turn", F.row_number().over(Window.partitionBy("class", "owner").orderBy(*order)))
    own = own.withColumn("__first", F.min("arrival").over(Window.partitionBy("class", "owner")))
    own = running(own, ["class"], ["__turn", "__first", "owner", *order], {"__n": F.lit(1)}).withColumn("__n", F.col("__n") + 1)
    batches, interactive = (rows.agg(F.count_if(F.col("class") == c)).scalar() for c in (1, 0))
    # The k-th batch job stands behind 4k interactive ones while there are any.
    place = F.when(F.col("class") == 0, F.col("__n") + F.least(F.floor((F.col("__n") - 1) / INTERACTIVE_SHARE), batches))
    return own.withColumn("seq", F.coalesce(place, F.col("__n") + F.least(F.col("__n") * INTERACTIVE_SHARE, interactive)).cast("long")).drop("__turn", "__first", "__n")


def share_metrics(dispatched: DataFrame, key: str) -> DataFrame:
    """Of dispatches in the order of seq: tasks served, units, the longest streak and how far ahead of an equal share."""
    own = Window.partitionBy(key).orderBy("seq")
    parts = dispatched.agg(F.count_distinct(F.col(key))).scalar()
    # seq counts the dispatches from 1, so no window over all of them is needed.
    rows = dispatched.withColumn("__k", F.row_number().over(own)).withColumn("__run", F.col("seq") - F.col("__k"))
    rows = rows.withColumn("__ahead", F.col("__k") - F.floor(F.col("seq") / parts))
    streaks = rows.groupBy(key, "__run").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max("n").alias("streak"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("served"), F.sum("cost").alias("units"), F.greatest(F.max("__ahead"), F.lit(0)).cast("long").alias("ahead")).join(streaks, key)


class Level:
    """Virtual times of the entities of one level below one parent."""

    def __init__(self):
        self.clock = 0
        self.at: dict = {}

    def start(self, entity) -> int:
        return max(self.at.get(entity, 0), self.clock)

    def charge(self, entity, cost: int, weight: int) -> None:
        self.clock = self.start(entity)
        self.at[entity] = self.clock + cost * UNIT // weight


class Clocks:
    """What decisions leave behind: the levels' virtual times, and the slots in use as (when it ends, group)."""

    def __init__(self):
        self.classes, self.groups, self.projects, self.busy = Level(), {}, {}, []

    def starts(self, c, g, p) -> tuple[int, int, int]:
        """The virtual times of a class, a group and a project at their next turn."""
        return self.classes.start(c), self.groups.get(c, Level()).start(g), self.projects.get((c, g), Level()).start(p)


class Jobs(Sequence):
    """A table's rows as dicts, each made when it is asked for: a queue's rows are held as arrays."""

    def __init__(self, table: pa.Table, names: list[str]):
        self.n, self.arrays = len(table), {c: table.column(c).to_numpy() for c in names}

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> dict:
        return {c: a.item(i) for c, a in self.arrays.items()}


def simulate(jobs: Sequence[dict], slots: int = 1, hold: int = 1, max_running: int | None = None, until: int | None = None, clocks: Clocks | None = None) -> Iterator[dict]:
    """Dispatches of jobs (arrival, class, group_id, project_id, cost, weights, priority) in time; each holds a slot so long.

    A group with max_running jobs in slots isn't considered. With until only those before that time; clocks is what they leave.
    """
    # class, group, project: a heap of the jobs that wait, the next one first; what has no job isn't held.
    waiting: dict = {}
    clocks = clocks or Clocks()
    classes, groups, projects = clocks.classes, clocks.groups, clocks.projects
    coming = deque(sorted(range(len(jobs)), key=lambda i: (jobs[i]["arrival"], i)))
    now, busy = 0, []
    while (coming or waiting) and (until is None or now < until):
        busy = clocks.busy = [x for x in busy if x[0] > now]
        while coming and jobs[coming[0]]["arrival"] <= now:
            i = coming.popleft()
            j = jobs[i]
            heap = waiting.setdefault(j["class"], {}).setdefault(j["group_id"], {}).setdefault(j["project_id"], [])
            heapq.heappush(heap, (-j["priority"], j["arrival"], i))
        while waiting and len(busy) < slots:
            full = {g for g, n in Counter(g for _, g in busy).items() if max_running is not None and n >= max_running}
            held = [c for c, own in waiting.items() if own.keys() - full]
            if not held:
                break
            c = min(held, key=lambda x: (classes.start(x), x))
            by_group = groups.setdefault(c, Level())
            g = min(waiting[c].keys() - full, key=lambda x: (by_group.start(x), x))
            by_project = projects.setdefault((c, g), Level())
            p = min(waiting[c][g], key=lambda x: (by_project.start(x), x))
            best = heapq.heappop(waiting[c][g][p])[-1]
            if not waiting[c][g][p]:
                del waiting[c][g][p]
                if not waiting[c][g]:
                    del waiting[c][g]
                    if not waiting[c]:
                        del waiting[c]
            job = jobs[best]
            by_project.charge(p, job["cost"], job["project_weight"])
            by_group.charge(g, job["cost"], job["group_weight"])
            classes.charge(c, job["cost"], job["class_weight"])
            busy.append((now + hold, g))
            yield {"job": best, "at": now}
        now += 1


#: What a decision reads of a job.
_JOB = ["arrival", "class", "group_id", "project_id", "priority", "cost", "class_weight", "group_weight", "project_weight"]
#: What is said of the jobs of a project that arrive at once: how many had a turn, the virtual times of its class, group and itself, slots in use.
_LEFT = "__taken long, __class_at long, __group_at long, __project_at long, __ends array<bigint>"


def _turns(rows: DataFrame, by: list[str], order: list[str], slots: int, hold: int, max_running: int | None) -> DataFrame:
    """The fold: by, task_key, seq, at of the dispatches of each queue, those before __last if rows have it; then also a row for
    each project and arrival with the columns of _LEFT, the number of dispatches as seq and __last as at."""
    stops = "__last" in rows.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        jobs, clocks = Jobs(table, _JOB), Clocks()
        last = table.column("__last")[0].as_py() if stops else None
        done = list(simulate(jobs, slots, hold, max_running, last, clocks))
        at = pa.array([d["job"] for d in done], pa.int64())
        turns = {c: table.column(c).take(at) for c in [*by, "task_key"]} | {"seq": pa.array(range(1, len(done) + 1), pa.int64()), "at": pa.array([d["at"] for d in done], pa.int64())}
        out = [pa.table([turns[f.name] if f.name in turns else pa.nulls(len(done), f.type) for f in shape], schema=shape)]
        if stops:
            key = ["class", "group_id", "project_id", "arrival"]
            place = lambda i: tuple(jobs[i][c] for c in key)
            taken = Counter(place(d["job"]) for d in done)
            first = {}
            for i in range(len(jobs)):
                first.setdefault(place(i), i)
            ends = sorted(x for x, _ in clocks.busy if x > last)
            rest = {c: table.column(c).take(pa.array(first.values(), pa.int64())) for c in [*by, *key]}
            said = [(len(done), last, taken[k], *clocks.starts(*k[:3]), ends) for k in first]
            rest |= {c: pa.array([x[n] for x in said], shape.field(c).type) for n, c in enumerate(["seq", "at", "__taken", "__class_at", "__group_at", "__project_at", "__ends"])}
            out.append(pa.table([rest[f.name] if f.name in rest else pa.nulls(len(said), f.type) for f in shape], schema=shape))
        return pa.concat_tables(out)

    own = rows.select(*dict.fromkeys([*by, "task_key", *_JOB, *order, *(["__last"] if stops else [])]))
    names = [*by, "task_key", *(["class", "group_id", "project_id", "arrival"] if stops else [])]
    fields = T._parse_datatype_string("seq long, at long" + (", " + _LEFT if stops else "")).fields
    schema = T.StructType([*(T.StructField(c, own.schema[c].dataType) for c in names), *fields])
    shape = to_arrow_schema(schema)
    return own.groupBy(*by).applyInArrow(run, schema)


def dispatch_arrivals(rows: DataFrame, by: list[str], slots: int = 1, hold: int = 1, max_running: int | None = None) -> DataFrame:
    """The order of dispatch with arrivals over time, for each independent queue (the columns by): by, task_key, seq, at.

    Until a queue's last arrival each decision needs all before it: a fold, one task a queue, of the jobs that can have a turn
    until then. Of a project's jobs that arrive at once those are the first ones, as many as there are turns. What is left is a
    backlog that is all there: its order is dispatch_order's, from the virtual times that the fold leaves, and no task holds it.
    With max_running the fold goes on to the end, and a queue is one task's work: a full group depends on all turns before.
    """
    if max_running is not None:
        return _turns(rows, by, ["arrival", "task_key"], slots, hold, max_running)
    key = ["__queue", "class", "group_id", "project_id", "arrival"]
    queue = F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by]).cast("array<string>")
    urgency = (-F.col("priority")).alias("__urgency")
    own = rows.select(*dict.fromkeys([*by, "task_key", *_JOB]), urgency, queue.alias("__queue"))
    # Jobs that tie in all of this are the same job to a decision.
    ties = ["task_key", "cost", "class_weight", "group_weight", "project_weight"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("__urgency", *ties))
    held = written(own.withColumn("__nth", nth.cast("long")), "arrivals")
    lasts = held.groupBy(F.col("__queue").alias("__of")).agg(F.greatest(F.ceil(F.max("arrival")).cast("long"), F.lit(0)).alias("__last"))
    turns = F.lit(slots) * F.ceil(F.col("__last") / max(hold, 1))
    early = held.join(lasts, F.col("__queue") == F.col("__of")).where(F.col("__nth") <= F.greatest(turns, F.lit(1)))
    folded = written(_turns(early, ["__queue", *by], ["arrival", "__nth"], slots, hold, None), "turns")

    left = folded.where("__taken is not null").select(*[F.col(c).alias(f"__of_{c}") for c in key], F.col("seq").alias("__done"), F.col("at").alias("__last"), "__taken", "__class_at", "__group_at", "__project_at", "__ends")
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in key])
    rest = held.join(left, same).where(F.col("__nth") > F.col("__taken")).drop("__taken", *[f"__of_{c}" for c in key])
    order = ["__urgency", "arrival", "__nth"]
    out = rest.withColumn("__tag", F.col("__project_at") + _tag(key[:4], order, "project_weight"))
    out = out.withColumn("__in_group", F.row_number().over(Window.partitionBy(*key[:3]).orderBy("__tag", "project_id", *order)))
    out = out.withColumn("__tag", F.col("__group_at") + _tag(key[:3], ["__in_group"], "group_weight"))
    out = out.drop("priority", *order, "project_id", "project_weight", "group_weight", "__project_at", "__group_at")
    # A class's virtual times run in the order inside it, so one pass gives both.
    served = F.expr(f"cast(cost as bigint) * {UNIT} div class_weight")
    out = running(out, key[:2], ["__tag", "group_id", "__in_group"], {"__in_class": F.lit(1), "__of_class": served})
    out = out.withColumn("__tag", F.col("__class_at") + F.col("__of_class")).drop("cost", "class_weight", "group_id", "__in_group", "__class_at", "__of_class")
    out = running(out, key[:1], ["__tag", "class", "__in_class"], {"__place": F.lit(1)})
    # Slots come free in the order of their ends, again and again.
    turn, free = F.col("__place") % slots, F.lit(slots) - F.size("__ends")
    start = F.when(turn < free, F.col("__last")).otherwise(F.get("__ends", (turn - free).cast("int")))
    at = start + F.expr(f"__place div {slots}") * max(hold, 1)
    tail = out.select(*by, "task_key", (F.col("__done") + F.col("__place") + 1).alias("seq"), at.cast("long").alias("at"))
    return folded.where("__taken is null").select(*by, "task_key", "seq", "at").unionByName(tail)
