"""Token counts, URL filters, chat formatting, the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import chat_template as C
from docspark.llm import queries
from docspark.llm import token_counts as T
from docspark.llm import url_filter as U
from docspark.session import table, written
from tests.oracle import connect, difference


def test_token_counts(spark, odd_docs, odd_texts, no_docs, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    own.encode_special_tokens = True
    want = sorted(((i or 0, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in [*odd_texts, (None, "no id"), (None, "no id")]))
    docs = odd_docs.unionByName(spark.createDataFrame([(None, "no id")] * 2, "doc_id long, text string"), allowMissingColumns=True).withColumn("path", F.lit("p")).withColumn("file_id", F.lit("f"))
    files = written(T.write_files(docs.repartition(3), tokenizer, f"file://{tmp_path}/t"), "t")
    for size in (97, T.BLOCK_IDS):
        found = T.manifest(files).join(T.count_tokens(T.blocks_of(files.where("path is not null"), size)), ["file_id", "doc_index"])
        assert sorted((r.doc_id or 0, r.n_tokens) for r in found.collect()) == want
    row = files.where("path is not null").first()
    assert row.id_bytes == 2 and row.separator == own.token_to_id(T.END)
    # The files are plain: ids and separators alone.
    assert sum(int((np.fromfile(r.path.removeprefix("file://"), "<u2") == row.separator).sum()) for r in files.where("path is not null").collect()) == len(want)
    assert T.write_files(no_docs, tokenizer, f"file://{tmp_path}/n").count() == 0


def test_wide_ids_and_other_separators(spark, odd_docs, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    files = written(T.write_files(odd_docs.coalesce(1), path, f"file://{tmp_path}/t"), "t")
    row = files.where("path is not null").first()
    assert row.separator == Tokenizer.from_file(path).token_to_id(T.END) == 50256
    raw = np.fromfile(row.path.removeprefix("file://"), "<u2")
    (tmp_path / "wide.bin").write_bytes(raw.astype("<u4").tobytes())
    counts = lambda blocks: sorted((r.doc_index, r.start, r.n_tokens) for r in T.count_tokens(blocks).collect())
    narrow = counts(T.blocks_of(files.where("path is not null"), 100))
    assert counts(T.read_files(spark, f"file://{tmp_path}/wide.bin", row.separator, 4, 100)) == narrow and len(narrow) == odd_docs.count()
    with pytest.raises(Exception, match="can't be the separator"):
        T.write_files(odd_docs, path, f"file://{tmp_path}/u", separator=1 << 16).count()


def test_scan_of_flat_files(spark, tmp_path):
    rng = random.Random(1)
    end = 49407
    rows, want = [], []
    for f in range(5):
        ids = [rng.choice([7, 7, 8, end]) for _ in range(rng.choice([0, 1, 50, 4000]))]
        begin = k = 0
        for i, x in enumerate(ids):
            if x == end:
                want.append((f, k, begin, i - begin, True))
                begin, k = i + 1, k + 1
        if begin < len(ids):
            want.append((f, k, begin, len(ids) - begin, False))
        raw = np.array(ids, "<u2")
        (tmp_path / f"{f}.bin").write_bytes(raw.tobytes())
        rows += [(f, b // 3, raw[b : b + 3].tobytes(), 2, end) for b in range(0, len(raw), 3)] + [(f, 10**6, None, 2, end)]
    blocks = spark.createDataFrame(rows, "file_id long, block_no long, payload binary, id_bytes int, separator long")
    got = T.count_tokens(blocks).select("file_id", "doc_index", "start", "n_tokens", "closed")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    for size in (32, 1 << 16):
        files = T.count_tokens(T.read_files(spark, f"file://{tmp_path}", end, block_ids=size)).select(F.regexp_extract("file_id", r"(\d+)\.bin$", 1).cast("long"), "doc_index", "start", "n_tokens", "closed")
        assert sorted(map(tuple, files.collect())) == sorted(want)
    assert T.count_tokens(blocks.where("false")).count() == 0
    assert T.count_tokens(T.read_files(spark, f"file://{tmp_path}/4.bin", end).where("false")).count() == 0


def test_files_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    raw = np.array([5, 9, 9, 5, 5, 9, 4], "<u2")
    (tmp_path / "a.bin").write_bytes(raw.tobytes())
    monkeypatch.setattr(T, "reachable", lambda path: False)
    found = T.count_tokens(T.read_files(spark, f"file://{tmp_path}", 9, block_ids=3))
    assert sorted((r.doc_index, r.start, r.n_tokens, r.closed) for r in found.collect()) == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 2, True), (3, 6, 1, False)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) == ""


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://a.net/", "a.net", "/", "net/", "block"), ("http://A.NET", "a.net", "", None, "allow"), ("x://example.net/en/1?q", "example.net", "/en/1", "example.net/en/", "allow"),
        ("x://m.example.net/en", "m.example.net", "/en", "net/", "block"), ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("x://example.com/de/a#b", "example.com", "/de/a", "example.com/de/", "block"),
        ("x://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"), ("x://borg/fr/", "borg", "/fr/", None, "allow"), ("x://casino-win.example.com/", "casino-win.example.com", "/", None, "block"),
        ("x://a.com/CASINO/1", "a.com", "/CASINO/1", None, "block"), ("x://a.com/casinos", "a.com", "/casinos", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a.net/", "", "", None, "allow"), ("x://a b.net/c\nd", "a b.net", "/c\nd", "net/", "block"), ("x://", "", "", None, "allow"),
    ],
)
def test_url_cases(url, host, path, rule, verdict):
    assert U.Index(U.RULES).judge(url) == (host, path, rule, verdict)


def test_only_candidates_run():
    ran = []

    class Counting(U.Rule):
        def compiled(self):
            fits = super().compiled()
            return lambda h, p: ran.append(self.anywhere) or fits(h, p)

    rules = [Counting(None, "block", 0, anywhere=rf"\bwww\.w{i}\b") for i in range(100)]
    assert U.Index(rules).judge("http://www.w7.com/")[3] == "block" and ran == [r"\bwww\.w7\b"]


@pytest.mark.parametrize(
    ("pattern", "tokens"),
    [
        (r"\bcasino\b", [{"casino"}]), (r"casino", [set()]), (r"-(?:bets|pills?)\.", [{"bets"}, {"pill"}, {"pills"}]), (r"(?<![0-9a-z])[ck]asino(?![0-9a-z])", [{"casino"}, {"kasino"}]), (r"/ad[0-9]+/", [set()]), (r"/ads/+track/", [{"ads", "track"}]),
        (r"^www\.x$", [{"www", "x"}]), (r"\.(?i:Poker)\.", [set()]), (r"\.(?ai:Poker)\.", [{"poker"}]), (r"\.(?i:Bet)\.", [{"bet"}]), (r"\b(?:a|b|c){2}\b", [{x + y} for x in "abc" for y in "abc"]), (r"\bab*\b", [set()]), (r"_ad_", [{"ad"}]), (r"\bad\B", [set()]), (r"\w+\.ru$", [{"ru"}]), (r"[^a-z]ad[^a-z]", [set()]),
        (r"\.(x-)?yy\.", [{"yy"}, {"x", "yy"}]), (r"\b[a-h][a-h]x\b", [set()]), (r"\b(?:[abcd][abcd][abcd][abcd])\b", [set()] * 64), (r"\b(?=casino)c", [set()]), (r"(?:-spam)+-", [set()]), (r"-(?:spam-)+", [{"spam"}]),
    ],
)
def test_tokens_that_a_match_must_hold(pattern, tokens):
    assert sorted(map(sorted, U.needed(pattern, U.GAP, U.GAP))) == sorted(map(sorted, tokens))


def test_the_index_finds_what_all_rules_find(spark, sf_dir):
    rng = random.Random(9)
    pieces = ["casino", "ads", "www", "x1", "bet", "s", "-", ".", "/", "_", "Ads", "é", "ru", "ſ", "\n", "7"]
    shapes = [r"\b{0}\b", r"{0}", r"[-./]{0}s?[-./]", r"(?:{0}|{1})\.{2}", r"^{0}", r"{0}$", r"(?<![0-9a-z]){0}[-_]{1}(?![0-9a-z])", r"(?i:{0})-{1}", r"{0}+{1}", r"(?:{0}-)*{1}\b", r"[{0}]{1}\.", r"\b{0}(?={1})", r"(?:{0}){{2}}", r"\W{0}\W", r"{0}.*{1}"]
    rules = []
    for i in range(400):
        own = [re.escape(rng.choice(pieces)) for _ in range(3)]
        host, path, anywhere = (rng.choice(shapes).format(*own) for _ in range(3))
        rules.append(U.Rule(f"r{i}", rng.choice(["allow", "block"]), rng.randrange(5), host=f"(?:.*){host}(?:.*)", path=path) if rng.random() < 0.5 else U.Rule(f"r{i}", rng.choice(["allow", "block"]), rng.randrange(5), anywhere=anywhere))
    urls = ["x://" + "".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(600)] + [r.url for r in table(spark, sf_dir, "pages").collect()]
    for own in (rules, U.RULES):
        index = U.Index(own)
        compiled = [(r, r.compiled()) for r in own]
        for url in urls:
            host, path = U.parts(url)
            fits = [r for r, fit in compiled if fit(host, path)]
            best = max(fits, key=lambda r: (r.weight, r.verdict, r.name or ""), default=None)
            assert index.judge(url) == (host, path, best.name if best else None, best.verdict if best else "allow"), url
    own = U.Index(U.RULES)
    assert len(U.RULES) > 150 and len(own.always) == 1


def test_rules_of_a_table(spark):
    schema = "name string, verdict string, weight int, host string, path string, anywhere string"
    rows = [("a", "block", 2, None, None, r"\bspam\b"), ("b", "allow", 2, ".*", "/spam/", None), (None, "block", None, None, None, r"\bspam\b"), ("b", "allow", 2, ".*", "/spam/", None)]
    rules = U.rules_of(spark.createDataFrame(rows, schema))
    assert len(rules) == 4 and U.Index(rules).judge("x://h/spam/")[2:] == ("a", "block") and U.Index(rules).judge("x://h/eggs/")[2:] == (None, "allow")
    for bad in [("a", "block", 1, None, None, "("), ("a", "deny", 1, None, None, "x"), ("a", "block", 1, None, None, None)]:
        with pytest.raises(ValueError, match="rule"):
            U.rules_of(spark.createDataFrame([bad], schema))


def test_url_operator_on_odd_tables(spark):
    long = "http://a.com/" + "x-casinos." * 200_000
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "http://a.net/", "y"), (2, long, "z"), (3, long + "/casino", "z")], "page_id long, url string, host string")
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in U.judge(df).collect()) == [(0, "a.net", "block"), (1, "", "allow"), (1, "", "allow"), (2, "a.com", "allow"), (3, "a.com", "block")]
    assert U.judge(df.where("false")).count() == 0


def expected_chats(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chats_are_read_back(spark, sf_dir):
    odd = [
        (-1, 0, "user", queries.PLANTED), (-1, 1, "assistant", queries.PLANTED), (7, 2, "assistant", None), (7, 0, "system", ""), (7, 1, "user\nname", "\\ <\\| \\\n<|im_end|>\n<|im_start|>"), (7, 1, "assistant", "tie"), (7, 1, "assistant", "tie"),
        (None, 0, "user", "no id"), (8, None, None, "no turn"), (9, 0, "assistant", "<"), (9, 1, "assistant", "|im_end|>\n" * 20000),
    ]
    extra = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra).withColumn("formatted", F.lit("x"))
    formatted = C.format_chats(rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(formatted).collect()}
    assert got == expected_chats([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])
    assert C.digests(C.format_chats(rows.where("false"))).count() == 0
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    assert texts[-1].count("<|im_start|>") == texts[-1].count("<|im_end|>") == 2


def test_rows_without_an_id_are_conversations_of_their_own(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (1, 0, "user", "c"), (1, 1, "assistant", "d")]
    found = C.digests(C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in found) == [(0, 1, 0), (0, 1, 1), (0, 1, 1), (1, 2, 1)]


def test_template_language():
    t = C.Template("{% set x = 'a' + 'b' %}{%- if 1 == 2 %}no{% elif true or y %}yes {{ x | upper }}{% endif -%}  {{ 'k' + 'l' }}!{# note #}{% for i in l %}{{ loop.index0 }}{{ i['n'] }}{% if not loop.last %},{% endif %}{% endfor %}")
    assert t.render(l=[{"n": 5}, {}]).text == "yes ABkl!05,1"
    assert C.Template("{% if 'a' == 'b' %}x{% endif %}{{ 'y' }}z").tree == (C.Text("yz"),)
    r = C.Template("a{% generation %}b{{ x }}{% endgeneration %}c").render(x="é")
    assert (r.text, r.spans) == ("abéc", [(1, 3)])


@pytest.mark.parametrize("source", ["{{ ''.__class__ }}", "{{ f() }}", "{% import os %}", "{% for x in y %}", "{{ a b }}", "{% endif %}", "{{ x | exec }}", "{{ _x }}", "{{ 1 + 'a' }}", "{% generation %}"])
def test_template_sandbox(source):
    with pytest.raises(C.TemplateError):
        C.Template(source)


def test_escapes_are_undone():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choices("<|\\>a\n", k=rng.randint(0, 12)))
        assert C.unescape(C.escape(text)) == C.unescape(C.escape_line(text)) == text
        assert "<|" not in C.escape(text) and not re.search(r"(?<!\\)(?:\\\\)*\n", C.escape_line(text))


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language ID", "toxicity", "near duplicates", "benchmark decontamination", "packing"]
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == table(spark, sf_dir, "documents").columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert 0.5 * before.count() < docs.count() <= before.count(), name
            assert docs.join(before, docs.columns, "left_anti").count() == 0, name
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert P.run(spark, sf_dir).agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]


def test_pipeline_stages_on_odd_tables(spark, sf_dir, odd_docs, no_docs):
    import corpus_pipeline as P

    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    whole = table(spark, sf_dir, "documents").where("doc_id >= 50")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, no_docs, sf_dir).columns == no_docs.columns and stage(spark, no_docs, sf_dir).count() == 0, name
    # A table with the columns that operators name their own, null and repeated rows, very long texts.
    docs = whole.select("doc_id", "text", "lang", "source", F.lit(-1).cast("long").alias("n_words"), F.lit(0.5).alias("score"), F.lit(True).alias("kept"), F.lit("k").alias("k1")).unionByName(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    kept = {name: stage(spark, docs, sf_dir) for name, stage in P.STAGES[:-1]}
    assert all(df.columns == docs.columns for df in kept.values())
    assert not {1, 2, 3, 13} & set(ids(kept["language ID"])) and {6, 7, 9} <= set(ids(kept["language ID"]))
    assert {1, 2, 3, 6, 7} <= set(ids(kept["toxicity"])) and {1, 2, 3, 7} <= set(ids(kept["benchmark decontamination"]))
    one = [i for i in ids(kept["near duplicates"]) if i < 50]
    assert one == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14]
    assert set(ids(P.STAGES[-1][1](spark, odd_docs, sf_dir))) == {i for i in range(1, 15)}
    # Without a language to learn from nothing is thrown away for its language.
    assert ids(P.keep_identified(spark, odd_docs.withColumn("lang", F.lit(None).cast("string")), sf_dir)) == ids(odd_docs)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
