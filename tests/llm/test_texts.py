"""Quality rules, decontamination, language ID, toxicity."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import decontaminate as D
from docspark.llm import language_id as L
from docspark.llm import quality_rules as Q
from docspark.llm import toxicity as X
from docspark.session import table

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def judged(df):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in Q.judge(df).collect())


def expected(rows):
    out = Counter()
    for i, t in rows:
        b = base(t)
        out[(i, *b, not b[-1] and Q.passes(Q.RULES, (t or "").encode()))] += 1
    return out


def test_quality_counts_and_verdicts(spark, sf_dir, odd_docs, odd_texts, no_docs):
    assert judged(odd_docs) == expected(odd_texts)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    assert judged(docs) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert judged(no_docs) == Counter()


def test_rules_are_ordered_by_rejections_per_cost():
    rules = (Q.Rule("dear", lambda t: True), Q.Rule("cheap", lambda t: False), Q.Rule("good", lambda t: True))
    order = Q.ordered(rules, [Q.Estimate("dear", 9.0, 0.5), Q.Estimate("cheap", 0.1, 0.0), Q.Estimate("good", 1.0, 0.4)])
    assert [r.name for r in order] == ["good", "dear", "cheap"]
    calls = []
    cascade = (Q.Rule("a", lambda t: calls.append("a") or True), Q.Rule("b", lambda t: calls.append("b") or True))
    assert not Q.passes(cascade, b"x") and calls == ["a"]


def test_quality_keeps_clean_documents(spark, sf_dir):
    kept = Q.judge(table(spark, sf_dir, "documents")).where("not base_failed").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = kept.groupBy("quality", "kept").count().collect()
    by = {(r.quality, r.kept): r["count"] for r in rows}
    assert by[1, True] > 0.97 * (by[1, True] + by.get((1, False), 0))


def contaminated(text, items):
    words = ALNUM.findall((text or "").encode().lower())
    hit, found = set(), set()
    for item, own in items:
        w = ALNUM.findall((own or "").encode().lower())
        m = min(10, len(w))
        strings = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1) if m else ():
            if tuple(words[i : i + m]) in strings:
                hit |= set(range(i, i + m))
                found.add(str(item))
    return len(words), len(hit), tuple(sorted(found))


def check_contamination(docs, items, rows, **bounds):
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in D.contamination(docs, items, **bounds).collect())
    pairs = [(r.item_id, r.text) for r in items.collect()]
    assert got == Counter((i, *contaminated(t, pairs)) for i, t in rows)


@pytest.mark.parametrize("bound", [D.BOUND, 2000])
def test_contamination(spark, sf_dir, bound):
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    check_contamination(docs, items, [(r.doc_id, r.text) for r in docs.collect()], bound=bound)


def test_contamination_of_odd_texts(spark, odd_docs, odd_texts, no_docs):
    long = odd_texts[6][1].split()
    items = spark.createDataFrame([(1, None), (2, ""), (3, "One"), (4, "text, here!"), (5, " ".join(long[100:125])), (6, " ".join(long[500:511]).upper()), (7, "日本語"), (8, "x" * 60_000), (9, "one")], "item_id long, text string")
    check_contamination(odd_docs, items, odd_texts)
    check_contamination(odd_docs, items.where("false"), odd_texts)
    assert D.contamination(no_docs, items).count() == 0
    clean = D.uncontaminated(odd_docs, items)
    pairs = [(r.item_id, r.text) for r in items.collect()]
    assert clean.columns == odd_docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, t in odd_texts if not contaminated(t, pairs)[1])


def test_items_without_an_id_are_searched(spark):
    passage, other = "one two three four five six seven eight nine ten eleven", "ta tb tc td te tf tg th ti tj"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, "clean words"), (3, f"{other} and {passage}")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (7, other)], "item_id long, text string")
    for bound in (1 << 20, 8):
        got = {r.doc_id: (r.n_hit, list(r["items"])) for r in D.contamination(docs, items, bound=bound).collect()}
        assert got == {1: (11, []), 2: (0, []), 3: (21, ["7"])}
        assert [r.doc_id for r in D.uncontaminated(docs, items, bound=bound).collect()] == [2]
    assert {r.doc_id: r.contaminated for r in D.digests(D.contamination(docs, items)).collect()} == {1: True, 2: False, 3: True}


def test_search_skips_and_finds():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdef" for b in "xyz"]
    for _ in range(40):
        items = [(str(k), " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 9, 10, 11, 30]))).encode()) for k in range(6)]
        texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 700]))) for _ in range(4)]
        texts.append(texts[-1] + " " + items[2][1].decode())
        raw = [t.encode() for t in texts]
        counts, found, spans = D.search(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), D.test_strings(items))
        for t, n, f, s in zip(texts, counts, found, spans, strict=True):
            assert (n, sum(z - a for a, z in s), tuple(sorted(str(k) for k in f))) == contaminated(t, [(i, x.decode()) for i, x in items])


def test_language_on_held_out_rows(spark, sf_dir, odd_docs, no_docs):
    docs = table(spark, sf_dir, "documents")
    model = L.fit(docs)
    found = L.classify(docs.select("doc_id", "text", "lang"), model).where(L.in_fold(F.col("doc_id"), 4, 2))
    right, n, low, high = found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    assert right > 0.9 and n > 20 and 0 <= low <= high <= 1
    odd = {r.doc_id: r for r in L.classify(odd_docs, model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].rejected and odd[i].score == 0 for i in (1, 2, 3, 13))
    assert all(odd[i].lang_pred in model.dictionaries for i in (4, 5, 6, 7, 8, 12, 14))
    assert L.classify(no_docs, model).count() == 0


def test_language_is_the_smallest_by_brute_force(spark, sf_dir):
    import zstandard as z

    docs = table(spark, sf_dir, "documents")
    model = L.fit(docs)
    # Each block and dictionary anew, every byte counted, nothing kept from one text to the next.
    params = z.ZstdCompressionParameters(strategy=z.STRATEGY_GREEDY, window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=3, target_length=16, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(raw, lang):
        dictionary = z.ZstdCompressionDict(model.dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
        return sum(len(z.ZstdCompressor(dict_data=dictionary, compression_params=params).compress(raw[i : i + L.BLOCK_BYTES])) for i in range(0, len(raw), L.BLOCK_BYTES))

    for r in L.classify(docs.select("doc_id", "text"), model).collect()[:80]:
        if not any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == "und"
            continue
        raw = re.sub(r"[\W\d_]+", " ", r.text).lower().encode()
        sizes = sorted((size(raw, lang), lang) for lang in model.dictionaries)
        assert r.lang_pred == sizes[0][1] and r.margin == (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert r.score == min(1.0, r.margin / L.FULL_MARGIN) and r.rejected == (r.margin < L.MIN_MARGIN)


def test_language_ties_and_clashing_columns(spark):
    model = L.Model.fit({"b": ["same words here"], "a": ["same words here"]})
    df = spark.createDataFrame([(1, "same words", "x", 0.5, "y"), (1, "same words", "x", 0.5, "y")], "doc_id long, text string, lang_pred string, margin double, score string")
    found = L.classify(df, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "margin", "rejected"]
    assert [tuple(r) for r in found.collect()] == [(1, "same words", "a", 0.0, 0.0, True)] * 2
    one = L.classify(df, L.Model.fit({"a": ["other"]})).first()
    assert (one.lang_pred, one.score, one.rejected) == ("a", 1.0, False)


def test_every_language_is_learned(spark):
    rows = [(i * 10 + k, f"word{i} other{i} text{i}", f"l{i:03}") for i in range(300) for k in range(3)]
    assert len(L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).dictionaries) == 300


def test_language_learns_nothing_from_nothing(odd_docs, no_docs):
    model = L.fit(no_docs)
    assert model.dictionaries == {}
    assert {r.lang_pred for r in L.classify(odd_docs, model).collect()} == {"und"}


def test_language_never_reads_held_out_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wrong = docs.withColumn("lang", F.when(L.in_fold(F.col("doc_id"), 4, 2), "xx").otherwise(F.col("lang")))
    assert L.fit(wrong) == L.fit(docs)


def toxic_rows(seed=1, n=600):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ba", "ce", "di", "fo") for b in ("ra", "se", "tu") for c in ("", "n", "st")]
    bad = ["grumbler", "snorked", "vilepoint", "quxify", "quxifam", "quxiro"]
    rows = []
    for i in range(n):
        toxic = i % 6 == 0
        words = rng.choices(plain, k=rng.randint(10, 80))
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(10**6, 1), (3, None)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    found = {r.doc_id: r for r in X.score(docs, model).where(L.in_fold(F.col("doc_id"), 3, 1)).collect()}
    truth = {i: y for i, _, y in rows}
    assert len(found) > 150 and np.mean([r.predicted == truth[i] for i, r in found.items()]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    odd = {r.doc_id: r for r in X.score(odd_docs, model, prefix="tox_").collect()}
    assert odd[1].tox_score == odd[2].tox_score and odd[1].tox_predicted == 0 and odd[6].score == 0.5
    assert X.score(no_docs, model).count() == 0
    flipped = labels.withColumn("toxic", F.when(L.in_fold(F.col("doc_id"), 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = X.fit(docs, flipped)
    assert again.terms.tolist() == model.terms.tolist() and np.allclose(again.weights, model.weights)


def test_toxicity_scores_by_brute_force(spark):
    rows = toxic_rows(2, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = X.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))

    def term(word, kind):
        raw = np.frombuffer(word.encode(), np.uint8)
        return next(t for t in X.terms_of(raw, np.array([0, len(raw)]))[1].tolist() if t & 7 == kind + 1)

    column, n = {t: i for i, t in enumerate(model.terms.tolist())}, len(model.sure)
    for r in X.score(docs, model).collect()[:60]:
        words = ALNUM.findall(r.text.encode().lower())
        counts = np.zeros(len(column))
        for w in words:
            for kind, k in enumerate((0, *X.PREFIXES)):
                if len(w) >= k and (at := column.get(term(w.decode()[:k] if k else w.decode(), kind))) is not None:
                    counts[at] += 1
        hits, own = counts[:n].sum(), counts[:n] > 0
        more = [np.log1p(hits), np.log1p(own.sum()), (own * model.sure).max(), np.sqrt((own * model.sure).sum()), np.sqrt(hits / (len(words) + 20)), 1 / np.sqrt(len(words) + 1)]
        odds = np.concatenate([counts / (counts + 1), more, [1]]) @ model.weights
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(odds, -30, 30)))) < 1e-4


def test_toxicity_learns_from_long_texts_and_the_worst_label(spark):
    rows = toxic_rows(3, 400)
    long = [(i, (t + " ") * 30 if y else t, y) for i, t, y in rows]
    docs = spark.createDataFrame([(i, t, 0.1, "x") for i, t, _ in long], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in long] + [(i, 0) for i, _, _ in long], "doc_id long, toxic int")
    model = X.fit(docs, labels, sample_bytes=900)
    found = X.score(docs, model)
    truth = {i: y for i, _, y in long}
    assert found.columns == ["doc_id", "text", "label", "score", "predicted"] and np.mean([r.predicted == truth[r.doc_id] for r in found.collect()]) > 0.95


def test_toxicity_without_labels(spark, odd_docs):
    assert X.fit(odd_docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r.score for r in X.score(odd_docs.drop("score"), None).collect()} == {0.0}


def test_label_model_weighs_correlated_voters_less():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.85, np.where(y, 1, 2), np.where(y, 2, 1)) for _ in range(3)]
    noisy = np.where(rng.random(4000) < 0.6, np.where(y, 1, 2), np.where(y, 2, 1))
    votes = np.stack([*good, *[noisy] * 8], 1)
    label = np.where(np.arange(4000) < 400, y.astype(int), -1)
    q = X.label_model(votes, label)[400:]
    alone = (np.stack(good, 1) == 1).sum(1)[400:] >= 2
    assert ((q > 0.5) == y[400:]).mean() >= (alone == y[400:]).mean() - 0.01
