import random
from collections import defaultdict

import numpy as np
import pytest

from docspark.llm import near_dedup as N
from docspark.session import table


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for own in holders.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                shared[a, b] += 1
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    groups = defaultdict(list)
    for i in sets:
        groups[root(i)].append(i)
    return {i: (len(sets[i]), min(g), i == min(g)) for g in groups.values() for i in g}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}


def families(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(50):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 8, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(((len(rows) * 7919) % 100003, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_families(spark, seed):
    rows = families(seed)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_components_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_long_chain(spark):
    words = [f"c{i}" for i in range(400)]
    rows = [(1000 - k, " ".join(words[3 * k : 3 * k + 40])) for k in range(100)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_texts(odd_docs, odd_texts):
    assert got(odd_docs) == brute(dict(odd_texts).items())
    kept = N.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(i for i, (_, _, k) in brute(dict(odd_texts).items()).items() if k)


def test_null_and_shared_ids(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (None, "other"), (None, "other"), (7, "a text of its own"), (7, "another text with that id"), (7, "a text of its own"), (8, "another text with that id"), (9, ""), (9, ""), (9, "word"), (None, None), (4, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_duplicates(df).collect()), key=str)
    want = [(None, 5, False), (5, 5, True), (None, None, False), (None, None, False), (7, 7, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True), (9, 9, True), (9, 4, False), (None, None, False), (4, 4, True)]
    assert found == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in N.one_of_each(df).collect()), key=str)
    assert kept == sorted([(5, "a b c d e f"), (None, "other"), (7, "a text of its own"), (7, "another text with that id"), (9, ""), (9, ""), (None, None), (4, "word")], key=str)


def test_far_families_under_the_threshold(spark):
    """Members of one family share most shingles with others, but few of them enough with any one."""
    rng = random.Random(11)
    rows = []
    for _ in range(6):
        base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(40):
            own = list(base)
            for i in rng.sample(range(120), rng.choice([2, 4, 5, 6, 7])):
                own[i] = f"e{rng.randrange(30)}"
            rows.append((len(rows), " ".join(own)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_set_join_finds_every_link_across_components(spark):
    rng = random.Random(12)
    sets = {i: sorted(rng.sample(range(60), rng.choice([8, 12, 16, 30, 40]))) for i in range(400)}
    for i in range(400, 500):
        own = set(sets[rng.randrange(400)])
        sets[i] = sorted(own ^ set(rng.sample(range(60), rng.choice([1, 2, 3]))))
    rows = [(i, i % 7, s) for i, s in sets.items()]
    df = spark.createDataFrame(rows, "id long, c long, shingles array<long>")
    want = {(a, b) for a in sets for b in sets if a % 7 < b % 7 and 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))}
    assert len(want) > 50
    with N.Scratch(spark) as scratch:
        found = {(r.a, r.b) for r in N._prefix_pairs(N._reachable(df, 75, scratch), 75, scratch).collect()}
        checked = {(r.a, r.b) for r in N.confirmed(spark.createDataFrame(list(found), "a long, b long"), df).collect()}
    assert checked == want


def test_empty_table(no_docs):
    assert N.near_duplicates(no_docs).count() == 0
    assert N.one_of_each(no_docs).count() == 0


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(300):
        both, a, b = rng.integers(1, 1 << 62, 60, dtype=np.uint64), rng.integers(1, 1 << 62, 10, dtype=np.uint64), rng.integers(1, 1 << 62, 10, dtype=np.uint64)
        sets = [np.sort(np.concatenate([both, x])) for x in (a, b)]
        bands = N.min_max_bands(np.concatenate(sets), np.array([0, 70, 140]))
        met += bool((bands[0] == bands[1]).any())
    assert met == 300


def test_signature_values_match_as_often_as_the_sets():
    rng = np.random.default_rng(6)
    both, a, b = rng.integers(1, 1 << 62, 300, dtype=np.uint64), rng.integers(1, 1 << 62, 100, dtype=np.uint64), rng.integers(1, 1 << 62, 100, dtype=np.uint64)
    x, y = np.concatenate([both, a]), np.concatenate([both, b])
    same = [f((x ^ r) * m) == f((y ^ r) * m) for r, m in zip(N._XOR, N._ODD, strict=True) for f in (np.min, np.max)]
    assert abs(np.mean(same) - 0.6) < 0.15
