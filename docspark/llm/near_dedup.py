"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingles gives two signature values, its least and its greatest, so BANDS * ROWS values cost half
as many hash evaluations. A band joins values of ROWS different permutations, so its values are independent even in
small sets; two documents of similarity s share one of the bands with probability 1 - (1 - s^ROWS)^BANDS, which is
1 - 6e-6 at 0.75.

Work goes by distinct shingle sets, so copies cost nothing after the first. In every bucket all sets are compared with
its most central one, the one that shares the most buckets' places: links that hold make components. A bucket whose sets
then lie in one component is done, however large. Where some bucket of three or more sets still has several components, its
sets go through an exact set join across components. A set that has too few shingles in sets of other components, by exact
counts, can't have a link there and is done too. The rest are joined by their first shingles, those that bring the fewest sets
of different components together, where what is left of both sets can still reach the similarity. No step makes all pairs
of a group inside a component, and every link that is used was counted on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.words import SPACED_LOWER, mix, not_null, steps, windows, words_of
from docspark.session import Scratch, prepare, written

SHINGLE = 5
#: Linked from 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
#: Ids sent to every executor at once (16 MB, as many as half of them with keys); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_RNG = np.random.Generator(np.random.PCG64(7))
_PERMUTATIONS = BANDS * ROWS // 2
_XOR = _RNG.integers(0, 1 << 63, _PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, _PERMUTATIONS, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, _PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted, end to end, and for each text the index of its first."""
    runs, first = windows(words_of(data, bounds, SPACED_LOWER), k)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        runs[a:z].sort()
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:] != runs[:-1]
    heads = first[:-1][first[:-1] < first[1:]]
    new[heads] = True
    kept = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return runs[new], kept[first]


def min_max_bands(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The band keys, (texts with a shingle, BANDS), in their order."""
    heads = first[:-1][first[:-1] < first[1:]]
    bands = np.zeros((len(heads), BANDS), np.uint64)
    if not len(heads):
        return bands
    bands += np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    work = np.empty_like(shingles)
    for p in range(_PERMUTATIONS):
        np.bitwise_xor(shingles, _XOR[p], out=work)
        np.multiply(work, _ODD[p], out=work)
        # Of each ROWS permutations two bands are made: one takes least, greatest, least, .. and one the other half.
        one = 2 * (p // ROWS) + p % 2
        bands[:, one] = mix(bands[:, one] ^ np.minimum.reduceat(work, heads))
        other = 2 * (p // ROWS) + 1 - p % 2
        bands[:, other] = mix(bands[:, other] ^ np.maximum.reduceat(work, heads))
    return bands


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])


def set_keys(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers a set, the same for equal sets."""
    return _sums(mix(shingles), first).view(np.int64), _sums(mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)), first).view(np.int64)


def signatures(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (the set as 128 bits; null if empty), bands, of (doc_id, text as bytes)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for a, b, data, bounds in steps(not_null(batch.column(1))):
                shingles, first = shingle_sets(data, bounds)
                empty = pa.array(first[:-1] == first[1:])
                n = np.diff(first)
                k1, k2 = set_keys(shingles, first)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(min_max_bands(shingles, first).view(np.int64).ravel()))
                nulls = np.asarray(empty)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(k1, mask=nulls), pa.array(k2, mask=nulls), bands], ["doc_id", "n_shingles", "k1", "k2", "bands"]
                )

    return df.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def sets_of(df: DataFrame, classes: DataFrame) -> DataFrame:
    """id and shingles (sorted), one row for each of classes (id, k1, k2, least), of df (doc_id, text as bytes).

    A class is read from a row with its least id, or from a row without an id where none of its rows has one. Rows that
    share an id but not a text are told apart by their sets. Null and wordless texts have no class.
    """
    ids = classes.where("least is not null").select("least").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = df.join(ids, df["doc_id"] == ids["least"], "left_semi")
    if not classes.where("least is null").isEmpty():
        chosen = chosen.union(df.where("doc_id is null"))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for _, _, data, bounds in steps(not_null(batch.column(1))):
                shingles, first = shingle_sets(data, bounds)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in set_keys(shingles, first)), lists], ["k1", "k2", "shingles"])

    keys = classes.select("id", "k1", "k2")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS // 2 else keys
    return chosen.mapInArrow(run, "k1 long, k2 long, shingles array<long>").join(keys, ["k1", "k2"]).select("id", "shingles").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets (id, shingles; one row an id) are similar enough.

    A pair of which either has no set, or a null id, isn't; repeated pairs are each given; empty tables give no rows.
    """
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    n, m, both = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(one, "a").join(two, "b").where(100 * F.least(n, m) >= percent * F.greatest(n, m))
    return joined.where(100 * both >= percent * (n + m - both)).select("a", "b")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (the least id reachable) of every id in links (a, b): least neighbours, then labels of labels.

    Repeated links, and links both ways, count once; ids aren't null; an empty table gives no rows.
    """
    both = scratch.written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = scratch.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        of = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        new = scratch.written(step.join(of, "next").select("id", "old", F.least("next", "beyond").alias("component")), "labels")
        moved = new.where("component <> old").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            return labels


def _reachable(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of sets (id, c, shingles) those with so many shingles in sets of other components that a link is possible."""
    rows = scratch.written(sets.select("id", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "shingles")
    across = scratch.written(rows.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("s"), "across")
    reach = rows.join(across, "s", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n"))
    return sets.join(scratch.written(reach.where(100 * F.col("met") >= percent * F.col("n")).select("id"), "reachable"), "id", "left_semi")


def _prefix_pairs(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets (id, c, shingles) of different components that could be similar enough.

    Shingles are ordered by the pairs of sets they would bring together, counted exactly: first those inside one component,
    which bring none. Two similar sets share one of the first n - ceil(percent * n / 100) + 1 shingles of each, and what
    they share is at most the shingles from their first common one on, so places far from the front start no link.
    """
    rows = sets.select("id", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rows = scratch.written(rows, "shingles")
    held = rows.groupBy("s", "c").agg(F.count(F.lit(1)).alias("k"))
    cost = held.groupBy("s").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same")).select("s", (F.col("k") * F.col("k") - F.col("same")).alias("cost"))
    cost = scratch.written(cost.where("cost > 0"), "across")
    found = rows.join(cost, "s").groupBy("id").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("cost", "s"))).alias("met"))
    # Of n shingles size(met) are in other components too; the rest come before them in the order.
    shared = F.ceil(percent * F.col("n") / 100)
    found = found.where(F.size("met") >= shared).select("id", "c", "n", F.size("met").alias("left"), F.slice("met", F.lit(1), (F.size("met") - shared + 1).cast("int")).alias("met"))
    fronts = found.select("id", "c", "n", "left", F.posexplode("met").alias("at", "met")).select("id", "c", "n", (F.col("left") - F.col("at")).alias("left"), F.col("met.s").alias("s"))
    fronts = scratch.written(fronts, "prefixes")
    x, y = fronts.alias("x"), fronts.alias("y")
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    # shared >= percent * union / 100 is (100 + percent) * shared >= percent * (n + m).
    reach = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.c") < F.col("y.c")) & sizes & reach)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _central_pairs(banded: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): every set with the most central set of each bucket that it shares with others."""
    # Written first, as the tables below are: then a crowded bucket's rows meet it in a join that can split them.
    crowded = scratch.written(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowded")
    shared = scratch.written(banded.join(crowded, "band"), "shared")
    central = shared.groupBy("id").agg(F.sum("n").alias("score"))
    heads = shared.join(central, "id").groupBy("band").agg(F.max(F.struct("score", "id")).alias("head")).select("band", F.col("head.id").alias("a"))
    pairs = shared.join(scratch.written(heads, "heads"), "band").where("a <> id")
    return scratch.written(pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), "pairs")


def _labels(own: DataFrame, named: DataFrame, banded: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """id and component of the sets that have a link: pairs is what the buckets bring together."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = scratch.written(sets_of(own, scratch.written(named.join(ids, "id", "left_semi"), "met")), "sets")
    links = scratch.written(confirmed(pairs, sets, percent), "confirmed")
    labels = components(links, scratch)

    # Buckets that still span components.
    places = banded.join(sets.select("id"), "id", "left_semi").join(labels, "id", "left").select("id", "band", F.coalesce("component", "id").alias("c"))
    mixed = places.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi and n > 2").select("band")
    mixed = scratch.written(mixed, "mixed")
    if mixed.isEmpty():
        return labels
    unsure = places.join(mixed, "band", "left_semi").groupBy("id").agg(F.first("c").alias("c"))
    rest = scratch.written(sets.join(scratch.written(unsure, "unsure"), "id"), "rest")
    rest = scratch.written(_reachable(rest, percent, scratch), "rest")
    found = scratch.written(_prefix_pairs(rest, percent, scratch), "pairs")
    if found.isEmpty():
        return labels
    more = scratch.written(confirmed(found, rest, percent), "confirmed")
    return labels if more.isEmpty() else components(links.union(more), scratch)


def _classes(own: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The signatures (doc_id, n_shingles, k1, k2) of own (doc_id, text as bytes), and its distinct sets.

    Sets are k1, k2, least (the least id of a row with this set, null if none has one) and component (a number).
    """
    spark = own.sparkSession
    signed = written(signatures(own), "signatures")
    classes = signed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    # Numbers are fixed once the table is written.
    classes = scratch.written(classes.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "least", "bands"), "classes")
    banded = scratch.written(classes.select("id", F.explode(F.array_distinct("bands")).alias("band")), "bands")
    pairs = _central_pairs(banded, scratch)
    named = classes.select("id", "k1", "k2", "least")
    labels = spark.createDataFrame([], "id long, component long") if pairs.isEmpty() else _labels(own, named, banded, pairs, percent, scratch)
    found = named.join(labels, "id", "left").select("k1", "k2", "least", F.coalesce("component", "id").alias("component"))
    return signed.select("doc_id", "n_shingles", "k1", "k2"), scratch.written(found, "found")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (the least id reachable by links, its own included), kept.

    Words are runs of anything but blanks, A-Z counting as a-z; a text's set holds its distinct five-word shingles, or
    with fewer words the whole sequence as one. A null or wordless text has an empty set and is linked with nothing.
    Equal sets are always linked. Rows that share an id are rows of their own, each with its text's links; repeated rows
    are each given; other columns are ignored; an empty table gives no rows. A row without an id links like any other, but
    its component's id is that of the others, null if none has one, and its kept is false.
    """
    own = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("binary").alias("text"))
    with Scratch(prepare(df.sparkSession)) as scratch:
        signed, found = _classes(own, percent, scratch)
        least = found.groupBy("component").agg(F.min("least").alias("component_id"))
        found = written(found.join(least, "component").select("k1", "k2", "component_id"), "found")
    # Wordless rows have no key to join by.
    named = signed.where("k1 is not null").join(found, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    out = named.union(signed.where("k1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _with_keys(df: DataFrame, text_col: str) -> DataFrame:
    """df's rows and columns, and __k1 and __k2, the set's keys (0 and 0 without words)."""
    texts = df.withColumn("__text", df[text_col].cast("binary"))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for a, b, data, bounds in steps(not_null(batch.column(batch.num_columns - 1))):
                keys = [pa.array(k) for k in set_keys(*shingle_sets(data, bounds))]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *keys], [*batch.schema.names[:-1], "__k1", "__k2"])

    return texts.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__k1", T.LongType()), T.StructField("__k2", T.LongType())]))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row, all columns, of each group of near duplicates of df: that of the least id.

    Null and wordless texts stay, each row of them. Of rows that share an id and a set one stays; a row without an id
    stays where none of its group has one, one row of the group. An empty table stays empty. The ids that go are sent to all
    executors up to BROADCAST_IDS, and joined by a shuffle beyond. df may not have columns __k1, __k2 or __gone.
    """
    own = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("binary").alias("text"))
    with Scratch(prepare(df.sparkSession)) as scratch:
        signed, found = _classes(own, percent, scratch)
        least = found.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "k1", "k2")).alias("least"))
        least = scratch.written(least.select("component", "least.least", "least.k1", "least.k2"), "least")
        stays = least.select("k1", "k2", F.lit(True).alias("stays"))
        sets = scratch.written(found.select("k1", "k2", "least").join(stays, ["k1", "k2"], "left"), "stays")
        rows = signed.where("k1 is not null").join(sets, ["k1", "k2"]).select("doc_id", (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("least"))).alias("stay"))
        fate = rows.union(signed.where("k1 is null").select("doc_id", F.lit(True))).groupBy("doc_id")
        fate = written(fate.agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("stay", F.lit(False))).alias("stay")).where("n > 1 or doc_id is null or not stay"), "fates")
        sets = written(least.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("least").alias("__least")), "least")
    gone = fate.where("doc_id is not null").select(F.col("doc_id").alias("__gone"), "n")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    key = df[id_col].cast("long")
    sure = df.where(key.isNotNull()).join(gone, key == F.col("__gone"), "left_anti")
    doubtful = fate.where("n > 1 or doc_id is null")
    if doubtful.isEmpty():
        return sure.union(df.where(key.isNull())).select(*df.columns)
    # Rows without an id, or with one that others have too, are told apart by their sets.
    repeated = doubtful.where("n > 1").select(F.col("doc_id").alias("__gone"))
    odd = _with_keys(df.join(repeated, key == F.col("__gone"), "left_semi").union(df.where(key.isNull())), text_col)
    alone = odd.where("__k1 = 0 and __k2 = 0")
    one = odd.where("not (__k1 = 0 and __k2 = 0)").join(sets, ["__k1", "__k2"]).where(F.col(id_col).cast("long").eqNullSafe(F.col("__least"))).dropDuplicates(["__k1", "__k2"])
    return sure.select(*df.columns).union(one.select(*df.columns)).union(alone.select(*df.columns))
