"""Quality rules as a short-circuit cascade, ordered by what each rule rejects for its cost.

Every rule looks at one whole text and says whether it must go. On a bounded sample each rule is timed and its
rejections are counted; for independent rules the cheapest order is by rejections per second, so that is the order in
which every text meets them, and the first rejection ends its run. The order never changes a verdict, only its cost.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.words import SPACED, Alphabet, mix, not_null, steps, windows, words_of
from docspark.session import prepare

#: Rows on which costs and rejections are estimated; rows are chosen by a hash of their text's length and id.
SAMPLE_ROWS = 1000
#: Longer texts aren't in the sample; they are judged like all others.
SAMPLE_BYTES = 1 << 16
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
LINES = Alphabet(b"\n", lower=False)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_CODE_POINT = np.ones(256, np.int64)
_CODE_POINT[0x80:0xC0] = 0
_CODE_POINT[list(b" \t\n\x0b\x0c\r")] = 0

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class Rule:
    """rejects: the text's bytes -> whether it must go."""

    name: str
    rejects: Callable[[bytes], bool]


def _without(text: bytes, gone: bytes) -> int:
    return len(text) - len(text.translate(None, gone))


def many_symbols(text: bytes) -> bool:
    """A symbol for every four words or more: tables, markup, noise."""
    return 4 * _without(text, SYMBOLS) > len(text.split())


def shouting(text: bytes) -> bool:
    """More than half of the ASCII letters are capitals."""
    upper = _without(text, UPPER)
    return upper >= 20 and 2 * upper > _without(text, LETTERS)


def exclaiming(text: bytes) -> bool:
    """An exclamation mark for every four words or more."""
    return 4 * text.count(b"!") > len(text.split()) + 8


def same_lines(text: bytes) -> bool:
    """More than three in ten lines with a word repeat an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) > 3 and 10 * (len(lines) - len(set(lines))) > 3 * len(lines)


def stuttering(text: bytes) -> bool:
    """More than one word in four equals the word before it."""
    words = text.split()
    return len(words) >= 10 and 4 * sum(map(bytes.__eq__, words[1:], words)) > len(words)


def few_words(text: bytes) -> bool:
    """Less than half of the words hold a letter; a byte from 0x80 counts as one."""
    words = text.translate(_LETTER_MAP).split()
    return 2 * sum(b"a" in w for w in words) < len(words)


def narrow_vocabulary(text: bytes) -> bool:
    """Over 50 words, less than one in six of them distinct; texts of thousands of words repeat more, so the square root bounds it."""
    words = text.split()
    return len(words) > 50 and len(set(words)) < min(len(words) / 6, 4 * len(words) ** 0.5)


_LETTER_MAP = bytearray(range(256))
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalpha():
        _LETTER_MAP[_b] = 97
_LETTER_MAP = bytes(_LETTER_MAP)

RULES = tuple(Rule(f.__name__, f) for f in (many_symbols, shouting, exclaiming, same_lines, stuttering, few_words, narrow_vocabulary))


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float


def estimate(rules: tuple[Rule, ...], texts: list[bytes]) -> list[Estimate]:
    """Seconds per text and the share rejected, for each rule alone."""
    out = []
    for rule in rules:
        began = time.perf_counter()
        gone = sum(map(rule.rejects, texts))
        out.append(Estimate(rule.name, (time.perf_counter() - began) / max(1, len(texts)), gone / max(1, len(texts))))
    return out


def ordered(rules: tuple[Rule, ...], estimates: list[Estimate]) -> tuple[Rule, ...]:
    """By rejections per cost, the most first; rules that rejected nothing stand last, cheap before dear."""
    by = {e.name: e for e in estimates}
    return tuple(sorted(rules, key=lambda r: (-by[r.name].rejected / max(by[r.name].seconds, 1e-9), by[r.name].seconds, r.name)))


def passes(rules: tuple[Rule, ...], text: bytes) -> bool:
    return not any(rule.rejects(text) for rule in rules)


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = words_of(data, bounds, SPACED)
    lines = words_of(data, bounds, LINES)

    def summed(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(values[data], out=total[1:])
        return np.diff(total[bounds])

    def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[first])

    n = len(bounds) - 1
    text_of_line = np.repeat(np.arange(n), np.diff(lines.first))
    filled = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    keys = mix(lines.hashes + text_of_line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[filled]
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    dup = np.bincount(text_of_line[filled][again], minlength=n)

    runs, first = windows(words, 5)
    text_of_run = np.repeat(np.arange(n), np.diff(first))
    keys = mix(runs + text_of_run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = (np.arange(len(keys)) + (words.first[:-1] - first[:-1])[text_of_run])[twice]
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 5, -1)
    repeat = per_text(np.cumsum(cover)[:-1] > 0, words.first)
    return {
        "n_words": np.diff(words.first),
        "word_chars": summed(_CODE_POINT),
        "n_symbols": summed(_SYMBOL),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
    }


def sample_texts(df: DataFrame, rows: int = SAMPLE_ROWS) -> list[bytes]:
    """About rows whole texts, of all rows alike."""
    total = df.count()
    if not total:
        return []
    share = min(1.0, rows / total)
    chosen = df.where(F.octet_length("text") <= SAMPLE_BYTES).where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return [bytes(r.text or b"") for r in chosen.select("text").limit(2 * rows).collect()]


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts of each whole text, and whether it stays.

    Returns per row: doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that
    equal an earlier line), n_repeat_words (words in five-word windows found twice or more), base_failed (under ten
    words, or over a fifth of the words repeat), kept (not base_failed, and no rule rejects it). A null or empty text
    counts nothing and fails; repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    prepare(df.sparkSession)
    own = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("binary").alias("text"))
    cascade = ordered(rules, estimate(rules, sample_texts(own, sample_rows)))

    def run(batches):
        for batch in batches:
            for a, b, data, bounds in steps(not_null(batch.column(1))):
                out = base_counts(data, bounds)
                failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
                raw = data.tobytes()
                kept = ~failed
                for i in np.flatnonzero(kept):
                    kept[i] = passes(cascade, raw[bounds[i] : bounds[i + 1]])
                arrays = [batch.column(0).slice(a, b - a), *(pa.array(x, pa.int64()) for x in out.values()), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *out, "base_failed", "kept"])

    return own.mapInArrow(run, SCHEMA)
