"""Queries that answer for the whole table, on small tables in which a cut would show."""

from pyspark.sql import functions as F

from docspark.operators import control as K
from docspark.plans.bind import parses
from docspark.plans.fair_queries import backlog
from docspark.plans.registry import ORACLES, QUERIES
from tests.oracle import connect, difference


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


PASSAGES = [(0, "Été à la plage. Straße nach Köln"), (1, "Привет мир. Ещё одна строка"), (2, "你好世界。再见"), (3, "日本"), (4, "plain words. and more"), (15, "naïve café"), (16, "😀 smile. ё")]


def benchmark(spark, path):
    spark.createDataFrame(PASSAGES, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def sides():
    """The truth and the reading of each page by the rules of truth_and_found, in plain Python."""
    truth, found = {}, {}
    for item, text in PASSAGES:
        at = item // 10, item % 10 + 1
        for o, t in enumerate(text.split("."), 1):
            if t:
                truth.setdefault(at, []).append((o, " ".join(t.split())))
                read = {0: t.replace("e", ""), 1: t + " x", 2: t}[o % 3]
                if at[1] != 4:
                    found.setdefault(at, []).append((o, " ".join(read.split())))
    return truth, found


def test_scores_are_of_whole_texts(spark, tmp_path):
    sf = benchmark(spark, tmp_path)
    truth, found = sides()
    words = {at: (" ".join(t for _, t in b), " ".join(t for _, t in found.get(at, []))) for at, b in truth.items()}
    want = {at: (len(t), levenshtein(t, f)) for at, (t, f) in words.items()}
    got = QUERIES["cer_by_page_whole"](spark, sf).collect()
    assert {(r.doc, r.page): (r.characters, r.edits) for r in got} == want
    by_doc = {d: [sum(v[i] for at, v in want.items() if at[0] == d) for i in (0, 1)] for d in (0, 1)}
    assert {r.doc: (r.characters, r.edits, r.cer) for r in QUERIES["cer_by_document_whole"](spark, sf).collect()} == {d: (c, e, e / c) for d, (c, e) in by_doc.items()}
    con = connect(sf)
    for name in ("transcriptions_whole", "kinds_share_whole", "order_share_whole", "score_notes_whole"):
        assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) == ""
    assert {(r.doc, r.page): r.words for r in QUERIES["transcriptions_whole"](spark, sf).collect()} == {at: t for at, (t, _) in words.items()}


def test_blocks_are_matched_by_whole_texts(spark, tmp_path):
    got = {(r.doc, r.page, r.ord): r.found_ord for r in QUERIES["greedy_match"](spark, benchmark(spark, tmp_path)).collect()}
    truth, found = sides()
    assert sorted(got) == sorted((*at, o) for at, b in truth.items() for o, _ in b)
    # Every reading is like its own block only, but for page 4, which isn't read.
    for at, b in truth.items():
        for o, t in b:
            alike = [(1 - levenshtein(t, f) / max(len(t), len(f)), p) for p, f in found.get(at, [])]
            best = max(alike, default=(0, None))
            assert got[(*at, o)] == (best[1] if best[0] >= 0.5 else None)


def test_every_parse_is_filled_and_looked_up(spark, tmp_path):
    """Parses 2, 25 and 700, of which 700 has no block at all."""
    docs = [(20, "one\ntwo\nthree"), (251, "first\nsecond"), (7003, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    got = {(r.parse_id, r.page): r.state for r in QUERIES["skipped_pages_whole"](spark, sf).collect()}
    read = {(2, 1): "failed", (25, 2): "succeeded"}
    assert got == {(p, g): read.get((p, g), "skipped") for p in (2, 25, 700) for g in range(1, 15)}
    rows = [(r.parse_id, r.ref, r.answer) for r in QUERIES["block_lookup_whole"](spark, sf).collect()]
    # 20 is page 1 of parse 2, whose lines are behind a head; nothing has a block 26 or 21.
    found = {(2, "1.3"): "not_ready"}
    assert sorted(rows) == sorted((p, f"{g}.{1 + p % 40}", found.get((p, f"{g}.{1 + p % 40}"), "not_found")) for p in (2, 25, 700) for g in range(1, 13))


ROWS = "group_id long, seq long, parse_id long, file_known boolean, pages long, day long, ends long, owner string, key string, body string"


def test_ended_parses_free_their_places(spark):
    own = [(10, 1, 3), (11, 1, None), (12, 2, 9), (13, 3, 9), (14, 4, 4), (15, 5, None), (16, 6, None)]
    df = spark.createDataFrame([(1, at, p, True, 1, 0, ends, "o", None, None) for p, at, ends in own], ROWS)
    got = {r.parse_id: r.outcome for r in K.submitted(df, 2, 99).collect()}
    # 10 ends at 3, which frees a place after 3; 14 ends at 4.
    assert got == {10: "created", 11: "created", 12: "queue_full", 13: "queue_full", 14: "created", 15: "created", 16: "queue_full"}


def test_keys_are_seen_before_files_and_places(spark):
    rows = [
        (1, 0, 1, True, 1, 0, None, "o", "k", "b"), (1, 5, 2, False, 1, 0, None, "o", "k", "b"), (1, 6, 3, False, 1, 0, None, "o", "k", "c"), (1, 7, 4, False, 1, 0, None, "o", "j", "b"),
        (1, 8, 5, True, 1, 0, None, "o", "j", "c"), (1, 9, 6, True, 1, 0, None, "p", "k", "b"), (1, 23, 7, True, 1, 0, None, "o", "k", None), (1, 24, 8, True, 1, 0, None, "o", "k", "c"),
    ]
    got = [r.outcome for r in K.submitted(spark.createDataFrame(rows, ROWS), 3, 99).orderBy("parse_id").collect()]
    assert got == ["created", "exists", "conflict", "file_not_found", "created", "created", "conflict", "queue_full"]


def test_admission_of_the_table_is_the_replay(spark, sf_dir):
    """The queue counted anew at each request, with few places so that the smallest table fills them."""
    p = parses(spark, sf_dir)
    df = p.select("group_id", F.col("created_day").alias("seq"), "parse_id", (F.col("file_id") % 9 != 0).alias("file_known"), F.lit(1).alias("pages"), F.floor(F.col("created_day") / 30).alias("day"), F.col("finished_day").alias("ends"), "owner", (F.col("file_id") % 4).alias("key"), F.col("label").alias("body"))
    want, held, keys = {}, {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.group_id, r.seq, r.parse_id)):
        created = held.setdefault(r.group_id, [])
        since, body = keys.get((r.owner, r.key), (None, None))
        if since is not None and r.seq < since + 30:
            want[r.parse_id] = "exists" if body == r.body else "conflict"
        elif not r.file_known:
            want[r.parse_id] = "file_not_found"
        elif sum(e is None or e >= r.seq for e, _ in created) >= 20:
            want[r.parse_id] = "queue_full"
        elif sum(d == r.day for _, d in created) >= 5:
            want[r.parse_id] = "budget_exhausted"
        else:
            want[r.parse_id] = "created"
            created.append((r.ends, r.day))
            keys[r.owner, r.key] = r.seq, r.body
    assert {"created", "queue_full", "file_not_found"} <= set(want.values())
    assert {r.parse_id: r.outcome for r in K.submitted(df, 20, 5, key_span=30).collect()} == want


def test_the_backlog_is_one_queue(spark, sf_dir):
    """All tasks on one set of clocks, each time the class, group and project furthest behind."""
    tasks = backlog(spark, sf_dir).collect()
    jobs = sorted(tasks, key=lambda r: (r.n * 3, r.parse_id * 100 + r.n))
    waiting, clock, at, want = [], {}, {}, []
    start = lambda level, x: max(at.get((level, x), 0), clock.get(level, 0))
    for now in range(150):
        while jobs and jobs[0].n * 3 <= now:
            waiting.append(jobs.pop(0))
        if waiting:
            best = min(waiting, key=lambda r: (start((), r["class"]), r["class"], start(r["class"], r.group_id), r.group_id, start((r["class"], r.group_id), r.project_id), r.project_id, -r.priority, r.n * 3, r.parse_id * 100 + r.n))
            waiting.remove(best)
            for level, x, weight in (((), best["class"], best.class_weight), (best["class"], best.group_id, best.group_weight), ((best["class"], best.group_id), best.project_id, best.project_weight)):
                clock[level] = start(level, x)
                at[level, x] = clock[level] + best.cost * 1_000_000 // weight
            want.append((best.parse_id * 100 + best.n, now))
    got = QUERIES["fair_dispatch_arrivals"](spark, sf_dir).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, len(tasks) + 1)) and [(r.task_key, r.at) for r in got[: len(want)]] == want


def test_a_line_wider_than_a_window_stays_whole(spark, tmp_path):
    """windows_pack_wide over lines longer than its windows, first, last and between short ones and headings."""
    line = lambda c, n: " ".join([c * 49] * (n // 50))
    texts = [line("a", 90_000), f"Head\n{line('b', 200)}\n{line('c', 50_000)}\n{line('d', 300)}\nNext\n{line('e', 100)}", f"{line('f', 39_000)}\n{line('g', 2_000)}\n{line('日', 30_000)}", line("h", 41_000)]
    spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["windows_pack_wide"](spark, str(tmp_path))
    assert difference(got, connect(str(tmp_path)), ORACLES["windows_pack_wide"]) == ""
    assert max(len(r.text) for r in got.collect()) > 89_000


def test_bullets_meet_words_without_a_broadcast(spark, sf_dir):
    """20 words are exploded from each customer: the table's small files say nothing about what a broadcast would take."""
    got = QUERIES["bullet_words"](spark, sf_dir)
    assert got.count() > 0 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
