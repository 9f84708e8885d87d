"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Terms are whole words and word beginnings of 4 to 6 bytes, as hashes. From a bounded sample of labelled rows the terms
that mark either class are chosen. Lexicon voters each hold a share of the toxic terms of one kind and vote toxic from so
many hits; pattern voters look at density, variety and absence. The label model estimates by expectation maximisation
how each voter votes in each class, and how the voters correlate inside the classes; correlated voters share their weight.
Labelled rows have their label as one more, more reliable voter. Its posteriors over labelled and unlabelled sample rows
train a logistic regression over the terms; scores of rows that were left out of a fit say how sure a score makes, and
set its scale. It then scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.language_id import in_fold
from docspark.llm.token_ids import HashTable
from docspark.llm.words import ALNUM_LOWER, _Powers, mix, not_null, steps, words_of
from docspark.session import prepare

#: The sample that fit learns from by default, about: labelled rows, unlabelled rows, and the bytes of a row's text at most.
LABELLED_ROWS, UNLABELLED_ROWS, SAMPLE_BYTES = 4000, 1000, 1 << 16
#: Bytes of the word beginnings that count as terms.
PREFIXES = (4, 5, 6)
#: Terms of the classifier: marking toxic and clean rows.
TOXIC_TERMS, CLEAN_TERMS = 150, 50
#: Toxic terms that are looked at one by one.
CANDIDATES = 6000
#: A term's bound as a share of the greatest that chance would make of so many terms.
CHANCE = 0.8
#: Lexicons of each kind of term, and terms in each.
LEXICONS, LEXICON_TERMS = 4, 12
#: How often a given label is taken to be right when the label model begins, and the parts that scores are calibrated over.
LABEL_ACCURACY, PARTS = 0.98, 4
#: A row is toxic from this score.
THRESHOLD = 0.7
ROUNDS, STEPS, RATE, DECAY = 12, 400, 0.05, 1e-4

KINDS = 1 + len(PREFIXES)


def terms_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term) of every word and word beginning, and the words of each text. The low three bits tell the kind."""
    words = words_of(data, bounds, ALNUM_LOWER)
    n = np.diff(words.first)
    text = np.repeat(np.arange(len(n)), n)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(ALNUM_LOWER.values[data] * _Powers.up[: len(data)], out=total[1:])
    texts, terms = [text], [_marked(words.hashes, 0)]
    length = words.ends - words.starts
    for kind, k in enumerate(PREFIXES, 1):
        own = length >= k
        start = words.starts[own]
        texts.append(text[own])
        terms.append(_marked(mix((total[start + k] - total[start]) * _Powers.down[start]), kind))
    return np.concatenate(texts), np.concatenate(terms), n


def _marked(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (hashes & ~np.uint64(7)) | np.uint64(kind + 1)


@dataclass
class Sample:
    """Counts of terms in texts, as (text, place of the term in names) pairs; label is 1, 0, -1 for none, or -2 for left out."""

    names: np.ndarray
    text: np.ndarray
    term: np.ndarray
    count: np.ndarray
    words: np.ndarray
    label: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], label: np.ndarray) -> Sample:
        rows, terms, counts, words, done = [], [], [], [], 0
        for a, b, data, bounds in steps(pa.array(texts, pa.binary())):
            text, term, n = terms_of(data, bounds)
            key = np.empty(len(text), np.dtype([("x", np.int64), ("t", np.uint64)]))
            key["x"], key["t"] = text, term
            order = np.lexsort((term, text))
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(new)
            rows.append((key["x"][at] + done).astype(np.int32))
            terms.append(key["t"][at])
            counts.append(np.diff(np.append(at, len(key))).astype(np.int32))
            words.append(n)
            done += b - a
        names, place = np.unique(np.concatenate(terms), return_inverse=True)
        return cls(names, np.concatenate(rows), place.astype(np.int32), np.concatenate(counts), np.concatenate(words), label)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def choose_terms(sample: Sample) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms that mark toxic and clean rows best, by log-odds, and how sure each toxic one is.

    Toxic terms are picked one after the other, each for the toxic rows that hold it; a row counts half as much with
    every term picked from it, so many copies of one text can't fill the list.
    """
    terms, label = sample.names, sample.label[sample.text]
    toxic_rows, clean_rows = int((sample.label == 1).sum()), int((sample.label == 0).sum())
    a, b = (np.bincount(sample.term[label == y], minlength=len(terms)).astype(float) for y in (1, 0))
    odds = np.log((a + 0.5) / (toxic_rows + 1)) - np.log((b + 0.5) / (clean_rows + 1))
    # The root of the likelihood ratio: how far a term's rows are from falling on the classes by chance. Among many terms
    # some are far from it by chance as well, so the bound grows with how many there are.
    expected = np.maximum((a + b) * toxic_rows / (toxic_rows + clean_rows), 1e-300)
    ratio = _xlogx(a) + _xlogx(b) - a * np.log(expected) - b * np.log(np.maximum(a + b - expected, 1e-300))
    sure = np.sign(odds) * np.sqrt(2 * np.maximum(ratio, 0))
    seen = int((a + b > 0).sum())
    fit = np.flatnonzero((a >= 2) & (sure > CHANCE * np.sqrt(2 * np.log(seen + 1))))
    fit = fit[np.lexsort((terms[fit], -sure[fit]))][:CANDIDATES]
    row_of = np.cumsum(sample.label == 1) - 1
    place = np.full(len(terms), -1)
    place[fit] = np.arange(len(fit))
    held = np.flatnonzero(label == 1)
    held = held[place[sample.term[held]] >= 0]
    holds = np.zeros((toxic_rows, len(fit)), np.float32)
    holds[row_of[sample.text[held]], place[sample.term[held]]] = 1
    weight, left = np.ones(toxic_rows, np.float32), odds[fit].astype(np.float32)
    picked = []
    for _ in range(min(TOXIC_TERMS, len(fit))):
        best = int(np.argmax((weight @ holds) * left))
        picked.append(best)
        left[best] = 0
        weight = weight * np.where(holds[:, best] > 0, 0.5, 1).astype(np.float32)
    clean = np.flatnonzero((b >= 3) & (sure < -CHANCE * np.sqrt(2 * np.log(seen + 1))))
    clean = clean[np.lexsort((terms[clean], sure[clean]))][:CLEAN_TERMS]
    return terms[fit[picked]], terms[clean], sure[fit[picked]]


def votes_of(counts: np.ndarray, terms: np.ndarray, n_toxic: int, words: np.ndarray) -> np.ndarray:
    """(texts, voters): 1 toxic, 2 clean, 0 neither. counts: (texts, terms), the toxic terms first."""
    toxic = counts[:, :n_toxic]
    kind = (terms[:n_toxic] & np.uint64(7)).astype(int) - 1
    out = []
    leading = np.zeros(n_toxic, bool)
    for k in range(KINDS):
        ranked = np.flatnonzero(kind == k)[: LEXICONS * LEXICON_TERMS]
        leading[ranked] = True
        for i in range(LEXICONS):
            hits = toxic[:, ranked[i::LEXICONS]].sum(1)
            out += [np.where(hits >= least, 1, 0) for least in (1, 2, 4)]
    hits, kinds = toxic[:, leading].sum(1), (toxic[:, leading] > 0).sum(1)
    density = hits / (words + 20)
    out += [np.where(hits == 0, 2, 0), np.where(kinds <= 2, 2, 0), np.where(kinds >= 6, 1, 0), np.where(density > 0.04, 1, 0), np.where(density < 0.005, 2, 0)]
    return np.stack(out, 1)


def label_model(votes: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The posterior of toxic for each row, from votes and what labels there are."""
    n, m = votes.shape
    onehot = np.stack([votes == v for v in range(3)], 2).astype(float)
    sign = np.array([0.0, 1.0, -1.0])[votes]
    known = label >= 0
    prior = float(np.clip((label[known] == 1).mean(), 0.01, 0.99))
    gold = np.where(known, np.where(label == 1, 1, -1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)), 0.0)
    q = np.where(known, np.where(label == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY), prior)
    trust = known.astype(float)
    for _ in range(ROUNDS):
        like, residual = [], np.zeros((m, m))
        for y in (1, 0):
            w = (q if y else 1 - q) * np.where(trust > 0, 1.0, 0.0)
            theta = (np.tensordot(w, onehot, 1) + 1.0) / (w.sum() + 3.0)
            like.append(np.log(theta))
            centred = (sign - (w @ sign) / max(w.sum(), 1e-9)) * np.sqrt(w)[:, None]
            residual += centred.T @ centred
        scale = np.sqrt(np.maximum(np.diag(residual), 1e-9))
        correlation = residual / scale[:, None] / scale
        np.fill_diagonal(correlation, 0.0)
        weight = 1 / (1 + np.maximum(correlation, 0).sum(1))
        odds = np.tensordot(onehot, (like[0] - like[1]) * weight[:, None], ([1, 2], [0, 1])) + np.log(prior / (1 - prior)) + gold
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        trust = np.ones(n)
    return q


def features(counts: np.ndarray, words: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Terms, damped; then hits and different hits of toxic terms, how sure they are, and their density."""
    toxic = counts[:, : len(sure)]
    hits, kinds = toxic.sum(1), (toxic > 0).sum(1)
    surest = ((toxic > 0) * sure).max(1)
    more = np.stack([np.log1p(hits), np.log1p(kinds), surest, np.sqrt((toxic > 0) @ sure), np.sqrt(hits / (words + 20.0)), 1 / np.sqrt(words + 1.0)], 1)
    return np.concatenate([counts / (counts + 1.0), more], 1).astype(np.float32)


def fit_linear(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels: weights, the intercept last. Adam over the whole matrix, so it is repeatable."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w = np.zeros(x.shape[1], np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - q).astype(np.float32) / len(x) + DECAY * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def calibrated(z: np.ndarray, q: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores of rows a model wasn't fitted on into the posteriors' odds."""
    up, down = q.sum(), (1 - q).sum()
    target = q * (up + 1) / (up + 2) + (1 - q) / (down + 2)
    x, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
    return (float(w[0]), float(w[1])) if w[0] > 0 and np.isfinite(w).all() else (1.0, 0.0)


@dataclass(frozen=True)
class Model:
    """terms: toxic ones first, sure says how much each tells. weights: one per feature, then the intercept."""

    terms: np.ndarray
    sure: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, texts: list[bytes], label: np.ndarray) -> Model | None:
        if not (label == 1).any() or not (label == 0).any():
            return None
        # Copies would count as evidence that there isn't.
        first = sorted({t: i for i, t in reversed(list(enumerate(texts)))}.values())
        texts, label = [texts[i] for i in first], label[first]
        if not (label == 1).any() or not (label == 0).any():
            return None
        sample = Sample.of(texts, label)
        whole = cls.learned(sample)
        if whole is None:
            return None
        own, q = whole
        # Scores of rows that were left out tell how sure a score makes.
        part, z = np.argsort(np.argsort(label, kind="stable"), kind="stable") % PARTS, np.full(len(texts), np.nan)
        for k in range(PARTS):
            rest = cls.learned(replace(sample, label=np.where(part == k, -2, label)))
            if rest is not None:
                z[part == k] = rest[0].odds(*rest[0].counts(sample))[part == k]
        known = (label >= 0) & ~np.isnan(z)
        slope, intercept = calibrated(z[known], q[known]) if known.any() else (1.0, 0.0)
        weights = own.weights * np.float32(slope)
        weights[-1] += np.float32(intercept)
        return cls(own.terms, own.sure, weights)

    @classmethod
    def learned(cls, sample: Sample) -> tuple[Model, np.ndarray] | None:
        """A model and the posteriors it was fitted on, from rows whose label isn't -2."""
        toxic, clean, sure = choose_terms(sample)
        if not len(toxic):
            return None
        own = cls(np.concatenate([toxic, clean]), sure.astype(np.float32), np.empty(0, np.float32))
        counts, words = own.counts(sample)
        there = sample.label > -2
        q = np.zeros(len(words))
        q[there] = label_model(votes_of(counts[there], own.terms, len(sure), words[there]), sample.label[there])
        return cls(own.terms, own.sure, fit_linear(features(counts[there], words[there], own.sure), q[there])), q

    def counts(self, sample: Sample) -> tuple[np.ndarray, np.ndarray]:
        column = self.table().find(sample.names)[sample.term]
        own = column >= 0
        counts = np.zeros((len(sample.words), len(self.terms)), np.float32)
        counts[sample.text[own], column[own]] = sample.count[own]
        return counts, sample.words

    def odds(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        return features(counts, words, self.sure) @ self.weights[:-1] + self.weights[-1]

    def table(self) -> HashTable:
        out = HashTable(14)
        out.add(self.terms)
        return out

    def scores(self, table: HashTable, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        text, term, words = terms_of(data, bounds)
        column = table.find(term)
        own = column >= 0
        n, m = len(words), len(self.terms)
        out = np.empty(n)
        # A stretch of texts at a time bounds the count matrix.
        text, column = text[own], column[own].astype(np.int64)
        order = np.argsort(text, kind="stable")
        text, column = text[order], column[order]
        for a in range(0, n, 256):
            z = min(n, a + 256)
            lo, hi = np.searchsorted(text, (a, z))
            counts = np.bincount((text[lo:hi] - a) * m + column[lo:hi], minlength=(z - a) * m).reshape(z - a, m)
            out[a:z] = 1 / (1 + np.exp(-np.clip(self.odds(counts, words[a:z]), -30, 30)))
        return out


def _chosen(key: Column, total: int, rows: int) -> Column:
    return F.pmod(key, F.lit(1 << 30)) < int(min(1.0, rows / max(1, total)) * (1 << 30)) + 1


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
    folds: int = 3,
    held_out: int = 1,
    labelled_rows: int = LABELLED_ROWS,
    unlabelled_rows: int = UNLABELLED_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model | None:
    """Learn from a bounded sample of labels outside the held-out fold, and of all rows.

    labelled_rows and unlabelled_rows are about how many rows the sample has; hashes choose them, alike however the table is
    dealt out. A row whose text is longer than sample_bytes teaches by one stretch of that length, which a hash places.
    A null label, id or empty text teaches nothing; an id with several labels is toxic if one of them is, and of several
    texts of one id one teaches. Equal texts count once. None if either class has no row.
    """
    prepare(df.sparkSession)
    own = df.select(df[id_col].alias("id"), df[text_col].cast("binary").alias("text")).where(F.octet_length("text") > 0)
    given = labels.select(labels[label_id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("label is not null and id is not null")
    given = given.where(~in_fold(F.col("id"), folds, held_out)).groupBy("id").agg(F.max("label").alias("label"))
    given = given.where(_chosen(F.xxhash64("id"), given.count(), labelled_rows))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.octet_length("text") - sample_bytes, F.lit(0)) + 1).cast("int") + 1
    part = F.substring("text", start, F.lit(sample_bytes)).alias("text")
    labelled = own.join(F.broadcast(given), "id").select("id", part, "label").dropDuplicates(["id"])
    # Copies of a text are chosen together and count once.
    unlabelled = own.where(_chosen(F.xxhash64("text"), df.count(), unlabelled_rows)).select(part).distinct().select(F.lit(None).cast(own.schema["id"].dataType).alias("id"), "text", F.lit(-1).alias("label"))
    # Labelled rows first: the unlabelled sample may hold them too, and the first of equal texts stays.
    rows = sorted((-r.label, bytes(r.text)) for r in labelled.select("id", "text", "label").union(unlabelled).toLocalIterator())
    if not rows:
        return None
    return Model.fit([r[1] for r in rows], np.clip(np.array([-r[0] for r in rows]), -1, 1))


def score(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """All columns of df, then score (0 to 1) and predicted (1 from threshold) of each whole text.

    A null or empty text has the score of a text without terms; without a model every score is 0. Repeated rows score
    alike. Columns of df named as a result (prefix stands before the results' names) are left out; an empty table gives
    no rows.
    """
    prepare(df.sparkSession)
    results = [prefix + "score", prefix + "predicted"]
    kept = [c for c in df.columns if c not in results]
    own = df.select(*[df[c] for c in kept], df[text_col].cast("binary").alias("__bytes"))

    def run(batches: Iterable[pa.RecordBatch]):
        table = model.table() if model else None
        for batch in batches:
            for a, b, data, bounds in steps(not_null(batch.column(batch.num_columns - 1))):
                found = model.scores(table, data, bounds) if model else np.zeros(b - a)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.float64()), pa.array(found >= threshold, pa.bool_()).cast(pa.int32())], [*kept, *results])

    return own.mapInArrow(run, own.drop("__bytes").schema.add(results[0], "double").add(results[1], "integer"))
