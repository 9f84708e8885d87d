"""From a page's words with places to its blocks: the text gate, lines, columns, paragraphs, labels, ruled tables.

The gate and the joining of words with ruled cells are built-in expressions. The rest is geometry that looks at a whole page
at once; a page is one small group, so it runs as a function of the page's words.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The gate's bounds.
MIN_LETTERS, MOJIBAKE_PAIRS, MAX_VOWELLESS, VOWEL_SAMPLE = 0.5, 2, 0.15, 20
#: Fixed values, in sizes of type: how far a baseline may drift in a line, type that is small beside a line's, the gaps that part pieces.
LINE_DRIFT, SMALL_TYPE, COLUMN_GAP, BULLET_REACH = 0.25, 0.85, 2.0, 3.0
#: The least gutter in points; what makes a column prose.
MIN_GUTTER, COLUMN_LINES, FULL_LINES, FULL_LINE, COLUMN_WORDS = 6.0, 4, 0.5, 0.85, 3.0
#: Leading, slack of a pitch, sameness of sizes, indent; scales of headings and titles; reach of a caption.
MAX_LEADING, PITCH_SLACK, SAME, INDENT, HEADING, HEADING_LINES, TITLE, CAPTION = 1.9, 1.25, 0.02, 1.0, 1.15, 3, 1.6, 2.0
#: Fixed value: how far apart ruling lines may be and still touch, in points.
SNAP = 1.5
#: The most cells of one box that are held as one row; cells of a tile and of a task, about.
BOXED, TILE, TASK_CELLS = 1000, 256, 3000
MARKER = re.compile(r"^(?:[-*+•·◦▪‣–]|\(?[0-9]{1,3}[.)])$")
CAPTIONED = re.compile(r"^[^\W\d_]{2,}\.?\s?[0-9]+")
NOTED = re.compile(r"^(?:[0-9¹²³⁰-⁹]{1,3}|[*†‡§])\s?\S")


def _said(sums: DataFrame) -> DataFrame:
    answer = (
        F.when(F.col("turned"), "turned").when(F.col("unmapped"), "unmapped").when(F.col("pairs") >= MOJIBAKE_PAIRS, "decoded_twice").when(F.col("letters") < MIN_LETTERS * F.col("chars"), "not_letters")
        .when((F.col("plain") >= VOWEL_SAMPLE) & (F.col("vowelless") > MAX_VOWELLESS * F.col("plain")), "not_words").otherwise("usable")
    )
    return sums.withColumn("answer", answer)


#: Letters decoded twice: a lead byte's character and what a byte after it becomes.
_TWICE = "[\\x{C2}-\\x{F4}][\\x{80}-\\x{BF}€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸŽ]"


def usable_gate(words: DataFrame, key: str) -> DataFrame:
    """Whether each page's words (key, text, and hidden and turned if any) read as text: key, counts, and why they are declined.

    A page's shown words become one text for the gate. Null and empty words count as none; a page without others has no row.
    """
    shown = words.where(~F.col("hidden")) if "hidden" in words.columns else words
    turned = F.bool_or("turned") if "turned" in words.columns else F.lit(False)
    pages = shown.where("text <> ''").groupBy(key).agg(F.array_join(F.collect_list("text"), "\n").alias("__text"), turned.alias("turned"))
    return usable_texts(pages, key, "__text", (r"\n", r"[^\n]"), "turned")


def usable_texts(texts: DataFrame, key: str, text_col: str, blank: tuple[str, str] = (r"\s", r"\S"), turned: str | None = None) -> DataFrame:
    """key, counts and answer of whole texts, their words parted by blank (patterns of a blank and of anything else).

    Counts are taken in whole texts: no word is a row, and nothing is exchanged. A null text, or one without a word, has no
    row; repeated rows are each given.
    """
    t, (empty, solid) = F.col(text_col), blank
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    # Plain words are ASCII letters, four at least and a small one among them, once what isn't a letter is off their ends.
    edge = rf"(?:(?!\p{{L}}){solid})*+"
    plain = lambda letters: count(rf"(?<!{solid}){edge}(?=[A-Z]*[a-z]){letters}{{4,}}+{edge}(?!{solid})")
    unmapped = rf"(?!{empty})[\x{{FFFD}}\p{{Cc}}\x{{FDD0}}-\x{{FDEF}}]|(?<={solid})\p{{Co}}|\p{{Co}}(?={solid})"
    sums = texts.select(
        key, count(rf"{solid}++").alias("words"), left(empty).alias("chars"), left(r"[^\p{L}\p{N}]+").alias("letters"), plain("[A-Za-z]").alias("plain"), plain("[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]").alias("vowelless"),
        (F.col(turned) if turned else F.lit(False)).alias("turned"), t.rlike(unmapped).alias("unmapped"), count(_TWICE).alias("pairs"),
    )
    return _said(sums.where("words > 0"))


# --- one page ------------------------------------------------------------------------------------------------------


@dataclass(slots=True)
class Word:
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    baseline: float
    size: float
    bold: bool = False


class Page:
    """A page's words as arrays, one field each."""

    def __init__(self, text: list[str], fields: np.ndarray, bold: np.ndarray):
        self.text = text
        self.x0, self.y0, self.x1, self.y1, self.baseline, self.size = fields
        self.bold = bold
        self.chars = np.array([len(t) for t in text], np.int64)

    @classmethod
    def of(cls, words: list[Word]) -> Page:
        fields = np.array([(w.x0, w.y0, w.x1, w.y1, w.baseline, w.size) for w in words], float).reshape(-1, 6).T
        return cls([w.text for w in words], fields, np.array([w.bold for w in words], bool))


def modal(values: np.ndarray, weights: np.ndarray) -> float:
    """The value of the greatest weight, the greater of equals."""
    if not len(values):
        return 0.0
    own, which = np.unique(values, return_inverse=True)
    total = np.bincount(which, weights)
    return float(own[np.flatnonzero(total == total.max())[-1]])


class Lines:
    """Lines, each a run of words from left to right, as arrays of what is measured on them."""

    def __init__(self, page: Page, words: list[np.ndarray], baseline: Iterable[float]):
        self.page, self.words, self.baseline = page, words, np.array(list(baseline), float)
        n = np.array([len(w) for w in words], np.int64)
        at = np.concatenate(words) if words else np.empty(0, np.int64)
        heads = np.cumsum(n) - n
        over = lambda f, x: f.reduceat(x[at], heads) if len(at) else np.empty(0)
        self.x0, self.y0, self.x1, self.y1 = over(np.minimum, page.x0), over(np.minimum, page.y0), over(np.maximum, page.x1), over(np.maximum, page.y1)
        self.bold = over(np.logical_and, page.bold).astype(bool)
        self.n, self.chars = n, over(np.add, page.chars) + np.maximum(n - 1, 0)
        self.size = over(np.maximum, page.size)
        for i in np.flatnonzero(over(np.minimum, page.size) != self.size):
            self.size[i] = modal(page.size[words[i]], page.chars[words[i]])
        self.marked = np.array([len(w) > 1 and MARKER.match(page.text[w[0]]) is not None for w in words], bool)

    def __len__(self) -> int:
        return len(self.words)

    def text(self, i: int) -> str:
        return " ".join([self.page.text[w] for w in self.words[i]])

    def picked(self, order: Sequence[int]) -> Lines:
        return Lines(self.page, [self.words[i] for i in order], self.baseline[np.asarray(order, np.int64)])


def lines_of(page: Page, free: np.ndarray | None = None) -> Lines:
    """Words (those that are free, if told) on one baseline; marks in small type beside a line are part of it."""
    own = np.arange(len(page.text)) if free is None else np.flatnonzero(free)
    if not len(own):
        return Lines(page, [], [])
    order = own[np.lexsort((page.x0[own], page.baseline[own]))]
    base, size = page.baseline[order], page.size[order]
    # Runs of one baseline and size are on one line; only their first words are compared with lines.
    runs = np.flatnonzero(np.concatenate([[True], (np.diff(base) != 0) | (np.diff(size) != 0)]))
    heads = [0]
    for i in runs[1:].tolist():
        if base[i] - base[heads[-1]] > LINE_DRIFT * min(size[i], size[heads[-1]]):
            heads.append(i)
    by_x = lambda own: own[np.argsort(page.x0[own], kind="stable")]
    lines = Lines(page, [by_x(own) for own in np.split(order, heads[1:])], base[heads])
    hosts = SMALL_TYPE * lines.size.max()
    gone, here = np.zeros(len(lines), bool), np.arange(len(lines))
    for i in range(len(lines)):
        if lines.size[i] > hosts:
            continue
        over = ~gone & (here != i) & (lines.size[i] <= SMALL_TYPE * lines.size) & (lines.y0 <= lines.baseline[i]) & (lines.baseline[i] <= lines.y1 + LINE_DRIFT * lines.size)
        for j in np.flatnonzero(over).tolist():
            own, slack = lines.words[j], lines.size[j] / 2
            if ((lines.x0[i] <= page.x1[own] + slack) & (lines.x1[i] >= page.x0[own] - slack)).any():
                one = Lines(page, [by_x(np.concatenate([own, lines.words[i]]))], [lines.baseline[j]])
                lines.words[j], gone[i] = one.words[0], True
                for name in ("x0", "y0", "x1", "y1", "size", "bold", "n", "chars", "marked"):
                    getattr(lines, name)[j] = getattr(one, name)[0]
                break
    return lines.picked(here[~gone].tolist())


def pieces_of(lines: Lines) -> tuple[Lines, np.ndarray]:
    """The lines' parts that stand apart, and the line of each; more room is left behind a list marker."""
    page, parts, line = lines.page, [], []
    for i, own in enumerate(lines.words):
        gap = page.x0[own[1:]] - page.x1[own[:-1]]
        type_size = np.maximum(page.size[own[1:]], page.size[own[:-1]])
        cuts = [0]
        for k in (np.flatnonzero(gap > COLUMN_GAP * type_size) + 1).tolist():
            if k - cuts[-1] > 1 or gap[k - 1] > BULLET_REACH * type_size[k - 1] or not MARKER.match(page.text[own[k - 1]]):
                cuts.append(k)
        parts += np.split(own, cuts[1:]) if len(cuts) > 1 else [own]
        line += [i] * len(cuts)
    line = np.array(line, np.int64)
    return Lines(page, parts, lines.baseline[line]), line


class Pieces:
    """What stands on a page, lines and regions (tables and figures) alike: places, and words (none in a region)."""

    def __init__(self, lines: Lines, boxes: list[tuple[float, float, float, float]]):
        more = np.array(boxes, float).reshape(-1, 4).T
        self.x0, self.y0, self.x1, self.y1 = (np.concatenate([a, b]) for a, b in zip((lines.x0, lines.y0, lines.x1, lines.y1), more, strict=True))
        self.n = np.concatenate([lines.n, np.zeros(len(boxes), np.int64)])


class Strips:
    """The strips between pieces side by side, and the paper that no piece enters, of a run of rows.

    A strip that holds another is clear where that one is, so only the inmost ones are looked at, by their left ends.
    """

    def __init__(self):
        self.clear: list[tuple[float, float]] = [(-math.inf, math.inf)]
        self.all: list[tuple[float, float]] = []
        self.inmost: list[tuple[float, float]] = []

    def after(self, spans: list[tuple[float, float]], more: list[tuple[float, float]]) -> Strips:
        new = Strips()
        new.clear = list(self.clear)
        for lo, hi in spans:
            i = max(0, bisect.bisect_right(new.clear, (lo, math.inf)) - 1)
            j = i
            while j < len(new.clear) and new.clear[j][0] < hi:
                j += 1
            new.clear[i:j] = [(a, z) for own in new.clear[i:j] for a, z in ((own[0], min(own[1], lo)), (max(own[0], hi), own[1])) if a < z]
        new.all, new.inmost = self.all + more if more else self.all, list(self.inmost)
        for lo, hi in more:
            i = bisect.bisect_left(new.inmost, (lo, -math.inf))
            if i < len(new.inmost) and new.inmost[i][1] <= hi:
                continue
            j = i
            while j and new.inmost[j - 1][1] >= hi:
                j -= 1
            new.inmost[j:i] = [(lo, hi)]
        return new

    def parted(self) -> bool:
        """Whether every strip still holds a stretch of clear paper as wide as a gutter."""
        at = 0
        for lo, hi in self.inmost:
            while at < len(self.clear) and self.clear[at][1] < lo + MIN_GUTTER:
                at += 1
            k = at
            while k < len(self.clear) and min(hi, self.clear[k][1]) - max(lo, self.clear[k][0]) < MIN_GUTTER and self.clear[k][0] < hi:
                k += 1
            if k == len(self.clear) or min(hi, self.clear[k][1]) - max(lo, self.clear[k][0]) < MIN_GUTTER:
                return False
        return True

    def widest(self) -> tuple[float, float] | None:
        if not self.all:
            return None
        s, c = np.array(self.all), np.array(self.clear)
        lo, hi = np.maximum(s[:, :1], c[None, :, 0]), np.minimum(s[:, 1:], c[None, :, 1])
        best = int(np.argmax(hi - lo))
        lo, hi = float(lo.flat[best]), float(hi.flat[best])
        return (lo, hi) if hi - lo >= MIN_GUTTER else None


#: The share of the lower of two pieces that lies beside the other, and how far a stray line stands off, in pitches.
SIDE_BY_SIDE, MAX_STRAY = 0.3, 1.5


def band(pieces: Pieces, rows: list[list[int]]) -> tuple[int, tuple[float, float] | None]:
    """How many of the rows (pieces, downward) share their gutters, and the widest one."""
    held = Strips()
    # Pieces above that reach down to the row at hand; rows come by their tops, so the others never meet another row.
    beside: list[int] = []
    for n, row in enumerate(rows):
        top = min(pieces.y0[i] for i in row)
        beside = [i for i in beside if pieces.y1[i] > top]
        more = [(pieces.x1[a], pieces.x0[b]) for a, b in zip(row, row[1:], strict=False)]
        for i in beside:
            for j in row:
                lap = min(pieces.y1[i], pieces.y1[j]) - max(pieces.y0[i], pieces.y0[j])
                if lap <= SIDE_BY_SIDE * min(pieces.y1[i] - pieces.y0[i], pieces.y1[j] - pieces.y0[j]):
                    continue
                a, b = (i, j) if pieces.x1[i] <= pieces.x0[j] else (j, i)
                if pieces.x1[a] > pieces.x0[b]:
                    return n, held.widest()
                more.append((pieces.x1[a], pieces.x0[b]))
        new = held.after([(pieces.x0[i], pieces.x1[i]) for i in row], more)
        if n and not new.parted():
            return n, held.widest()
        held = new
        beside += row
    return len(rows), held.widest()


def is_prose(pieces: Pieces, side: list[list[int]]) -> bool:
    """Whether one side of a gutter is a column of prose: lines enough, most as wide as the column, words enough.

    A side without a line, only regions, stands beside prose and passes.
    """
    own = np.concatenate(side)
    own = own[pieces.n[own] > 0]
    if not len(own):
        return True
    wide = pieces.x1[own] - pieces.x0[own]
    return len(own) >= COLUMN_LINES and np.mean(wide >= FULL_LINE * wide.max()) >= FULL_LINES and pieces.n[own].mean() >= COLUMN_WORDS


def is_stray(pieces: Pieces, left: list[list[int]], right: list[list[int]]) -> bool:
    """Whether the order of columns may misplace a line: one on the left that begins below the right side's end, or one on the
    right that ends above the left side's start, and that stands off its column by more than MAX_STRAY pitches."""
    tops = [np.array([pieces.y0[row].min() for row in side]) for side in (left, right)]
    steps = [np.diff(t) for t in tops]
    pitch = [np.sort(s)[len(s) // 2] if len(s) else 0.0 for s in steps]
    below = np.flatnonzero(tops[0][1:] >= pieces.y1[np.concatenate(right)].max())
    ends = np.array([pieces.y1[row].max() for row in right])
    above = np.flatnonzero(ends[:-1] <= pieces.y0[np.concatenate(left)].min())
    return bool(len(below) and steps[0][below[0]] > MAX_STRAY * pitch[0]) or bool(len(above) and steps[1][above[-1]] > MAX_STRAY * pitch[1])


class Declined(ValueError):
    """A page whose order can't be told."""


def reading_order(pieces: Pieces, row_of: np.ndarray) -> list[int]:
    """The pieces' order: rows downward, and where a run of rows leaves a gutter between columns of prose, left before right."""
    top = np.full(int(row_of.max(initial=-1)) + 1, math.inf)
    np.minimum.at(top, row_of, pieces.y0)
    rows: list[list[int]] = [[] for _ in top]
    for i, r in enumerate(row_of.tolist()):
        rows[r].append(i)
    todo = [[rows[r] for r in np.argsort(top, kind="stable").tolist()]]
    out: list[int] = []
    while todo:
        rows = todo.pop()
        n, gutter = band(pieces, rows)
        head, rest = rows[:n], rows[n:]
        if rest:
            todo.append(rest)
        if gutter is None or n == 1:
            out += [i for row in head for i in row]
            continue
        left, right = ([own for row in head if (own := [i for i in row if (pieces.x0[i] >= gutter[1]) == after])] for after in (False, True))
        if not (is_prose(pieces, left) and is_prose(pieces, right)):
            raise Declined("text stands side by side and is neither columns of prose nor a ruled table")
        if is_stray(pieces, left, right):
            raise Declined("a line beside the columns may belong under them")
        todo += [right, left]
    return out


@dataclass
class Block:
    lines: list[str]
    size: float
    bold: bool
    marked: bool
    kind: str = "text"
    level: int = 0

    @property
    def text(self) -> str:
        return self.lines[0] if self.kind in ("table", "figure") else join_lines(self.lines)


def join_lines(lines: list[str]) -> str:
    """Lines of a paragraph as one: a soft hyphen goes, a hyphen inside a word stays without a blank."""
    out = lines[:1]
    for text in lines[1:]:
        last = out[-1]
        if last.endswith("\u00ad"):
            out[-1] = last[:-1]
        elif not (last.endswith("-") and last[-2:-1].isalpha() and text[:1].islower()):
            out.append(" ")
        out.append(text)
    return "".join(out)


def paragraph_ends(lines: Lines) -> Iterator[tuple[int, int]]:
    """Where paragraphs begin and end, of lines in the order they are read in.

    What two neighbours must have in common is tested for all lines at once; what a line must have in common with the
    first two of its paragraph, for stretches that double until one ends it.
    """
    n = len(lines)
    pitch = np.diff(lines.baseline, prepend=lines.baseline[:1])
    alike = np.abs(np.diff(lines.size, prepend=lines.size[:1])) <= SAME * lines.size
    above = np.where((pitch > 0) & alike, pitch, 0.0)
    joins = (pitch > 0) & ~lines.marked
    at = 0
    while at < n:
        size, first = lines.size[at], lines.x0[at]
        low, high = (-INDENT, BULLET_REACH) if lines.marked[at] else (-math.inf, INDENT)
        end = at + 1
        leading = min(MAX_LEADING * size, (1 + SAME) * above[at] if above[at] > 0 else math.inf)
        if end < n and joins[end] and abs(lines.size[end] - size) <= SAME * size and lines.bold[end] == lines.bold[at] and pitch[end] <= leading and low * size <= lines.x0[end] - first <= high * size:
            # Where the lines begin is told by the second one, or by a list marker.
            left, low = (first, low) if lines.marked[at] else (lines.x0[end], -INDENT)
            slack, step = PITCH_SLACK * pitch[end], 16
            end += 1
            while end < n:
                own = slice(end, min(n, end + step))
                off = lines.x0[own] - left
                fits = joins[own] & (np.abs(lines.size[own] - size) <= SAME * size) & (lines.bold[own] == lines.bold[at]) & (pitch[own] <= slack) & (off >= low * size) & (off <= high * size)
                if not fits.all():
                    end += int(np.argmin(fits))
                    break
                end, step = own.stop, 2 * step
        yield at, end
        at = end


def label(blocks: list[Block], body: float, bold_body: bool) -> None:
    """Kinds by type: larger or bold is a heading, the largest alone a title."""
    for b in blocks:
        short = len(b.lines) <= HEADING_LINES
        if b.size >= HEADING * body or (b.bold and not bold_body and b.size >= body and short):
            b.kind = "heading"
        elif b.marked:
            b.kind = "list_item"
        elif b.size < body and NOTED.match(b.text):
            b.kind = "footnote"
        elif b.size < body and short and CAPTIONED.match(b.text):
            b.kind = "caption"
    heads = [b for b in blocks if b.kind == "heading"]
    rank = {size: i + 1 for i, size in enumerate(sorted({b.size for b in heads}, reverse=True))}
    for b in heads:
        b.level = min(rank[b.size], 6)
    largest = [b for b in heads if b.level == 1]
    if len(largest) == 1 and largest[0].size >= TITLE * body:
        largest[0].kind = "title"


@dataclass
class Region:
    """A table or a figure: its box, its text, and the rows of a table."""

    kind: str
    box: tuple[float, float, float, float]
    text: str
    rows: int = 0


def page_of(page: Page, regions: Sequence[Region] = (), free: np.ndarray | None = None, bulleted: frozenset[int] | set[int] = frozenset()) -> list[Block]:
    """A page's blocks in the order they are read in; Declined if that can't be told.

    regions stand among the lines; only the words that are free (all by default) make lines, and a line that begins with a
    bulleted word is a list's item.
    """
    whole = lines_of(page, free)
    pieces, row_of = pieces_of(whole)
    rows = np.concatenate([row_of, len(whole) + np.arange(len(regions))]).astype(np.int64)
    order = reading_order(Pieces(pieces, [r.box for r in regions]), rows)
    out: list[Block] = []
    texts: list[Block] = []
    run: list[int] = []

    def ended() -> None:
        lines = pieces.picked(run)
        lines.marked |= np.array([bool(bulleted) and int(w[0]) in bulleted for w in lines.words], bool)
        for a, z in paragraph_ends(lines):
            texts.append(Block([lines.text(i) for i in range(a, z)], float(lines.size[a]), bool(lines.bold[a]), bool(lines.marked[a])))
            out.append(texts[-1])
        run.clear()

    for i in order:
        if i < len(pieces):
            run.append(i)
            continue
        ended()
        r = regions[i - len(pieces)]
        out.append(Block([r.text] + [""] * (r.rows - 1), 0.0, False, False, r.kind))
    ended()
    label(texts, modal(pieces.size, pieces.chars), 2 * int(pieces.chars[pieces.bold].sum()) > int(pieces.chars.sum()))
    return out


def read_page(words: list[Word]) -> list[Block]:
    return page_of(Page.of(words))


def page_blocks(words: DataFrame, rules: DataFrame | None = None, drawings: DataFrame | None = None, size: tuple[float, float] | None = None) -> DataFrame:
    """page, ord, kind, level, text, lines, declined of each page. words: page, text, x0, y0, x1, y1, baseline, size, bold.

    rules and drawings (page, x0, y0, x1, y1; with a page's size, width and height) add tables, their text a line a row, figures,
    with the words inside them, and items of lists marked by drawn bullets. A page whose order can't be told has one row:
    ord 0, and the reason in declined. Words with a null text, place or size are left out (a null bold is false), as are rules
    and drawings with a null place; a page without words has no row, nor has an empty table. Repeated words are each read.
    """
    if (rules is not None or drawings is not None) and size is None:
        raise ValueError("rules and drawings need the pages' size")
    numbers, sides = ["x0", "y0", "x1", "y1", "baseline", "size"], ["x0", "y0", "x1", "y1"]
    known = lambda names: functools.reduce(lambda a, b: a & b, [F.col(n).isNotNull() & ~F.isnan(n) for n in names])
    own = words.where(known(numbers) & F.col("text").isNotNull()).select("page", "text", *[F.col(n).cast("double") for n in numbers], F.coalesce("bold", F.lit(False)).alias("bold"))
    # One row a page: its words as arrays, each in the same order.
    pages = own.groupBy("page").agg(F.collect_list(F.struct("text", *numbers, "bold")).alias("words"))
    for name, boxes in (("rules", rules), ("drawings", drawings)):
        if boxes is None:
            pages = pages.withColumn(name, F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
        else:
            box = F.struct(*[F.col(s).cast("double").alias(s) for s in sides])
            pages = pages.join(boxes.where(known(sides)).groupBy("page").agg(F.array_sort(F.collect_set(box)).alias(name)), "page", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            boxes = [[[tuple(b[s] for s in sides) for b in own or []] for own in batch.column(c).to_pylist()] for c in (2, 3)]
            for number, at in zip(batch.column(0).to_pylist(), range(batch.num_rows), strict=True):
                w = batch.column(1)[at].values
                page = Page(w.field("text").to_pylist(), np.array([w.field(n).to_numpy(zero_copy_only=False) for n in numbers]), w.field("bold").to_numpy(zero_copy_only=False))
                try:
                    found = page_of(page, *drawn(page, boxes[0][at], boxes[1][at], *size)) if size else page_of(page)
                    out += [(number, i + 1, b.kind, b.level, b.text, len(b.lines), None) for i, b in enumerate(found)]
                except Declined as why:
                    out.append((number, 0, None, 0, None, 0, str(why)))
            types = [batch.column(0).type, pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            columns = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page", "ord", "kind", "level", "text", "lines", "declined"])

    fields = T._parse_datatype_string("ord int, kind string, level int, text string, lines int, declined string").fields
    return pages.select("page", "words", "rules", "drawings").mapInArrow(run, T.StructType([own.schema["page"], *fields]))


def words_of_documents(docs: DataFrame, size: float = 10.0) -> DataFrame:
    """Documents set in type: each line one text line at 12 points' pitch, its first line larger, words side by side."""
    lines = docs.select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    # Where each word begins: one running sum a line.
    starts = F.aggregate(words, F.array(F.lit(0)), lambda held, w: F.array_append(held, F.element_at(held, -1) + F.length(w) + 1))
    rows = lines.select("page", "n", F.explode(F.arrays_zip(words.alias("text"), F.slice(starts, F.lit(1), F.size(words)).alias("before"))).alias("w")).select("page", "n", "w.text", "w.before")
    before = F.col("before")
    type_size = F.when(F.col("n") == 0, F.lit(1.7 * size)).otherwise(F.lit(size))
    base = 100 + F.col("n") * 12.0
    x = before * size * 0.5
    return rows.select("page", "text", x.alias("x0"), (base - type_size).alias("y0"), (x + F.length("text") * size * 0.5).alias("x1"), base.alias("y1"), base.alias("baseline"), type_size.alias("size"), F.lit(False).alias("bold"))


# --- ruled tables --------------------------------------------------------------------------------------------------


def ruling_groups(rects: list[tuple[float, float, float, float]], reach: float = SNAP) -> list[list[int]]:
    """Rectangles that are within reach of each other, directly or through others. A sweep from left to right."""
    parent = list(range(len(rects)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted(range(len(rects)), key=lambda i: rects[i][0])
    near: list[int] = []
    for i in order:
        a = rects[i]
        near = [j for j in near if rects[j][2] + reach >= a[0]]
        for j in near:
            if a[1] <= rects[j][3] + reach and rects[j][1] <= a[3] + reach:
                parent[root(i)] = root(j)
        near.append(i)
    groups: dict[int, list[int]] = {}
    for i in range(len(rects)):
        groups.setdefault(root(i), []).append(i)
    return list(groups.values())


def axes(values: Iterable[float]) -> list[float]:
    """Places of lines, those within SNAP of each other as one."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and v - out[-1][-1] <= SNAP:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(g) / len(g) for g in out]


#: Fixed value: the share of a cell's edge that must be ruled.
EDGE = 0.9


@dataclass
class Grid:
    """The lines of a ruled table, and for each square of theirs the cell it is part of (row, col, rows, cols)."""

    xs: list[float]
    ys: list[float]
    cells: list[tuple[int, int, int, int]]

    @property
    def shape(self) -> list[tuple[int, int, int, int]]:
        """The cells in the rows and columns that some cell begins in: lines that part nothing don't count."""
        starts = [sorted({c[k] for c in self.cells}) for k in (0, 1)]
        place = [{v: i for i, v in enumerate(own)} for own in starts]
        inside = lambda own, a, n: bisect.bisect_left(own, a + n) - bisect.bisect_left(own, a)
        return sorted((place[0][r], place[1][c], inside(starts[0], r, h), inside(starts[1], c, w)) for r, c, h, w in self.cells)


def closed_grid(rects: list[tuple[float, float, float, float]]) -> Grid | None:
    """The table that ruling lines make; None for fewer than two lines across or down. Declined if they don't close: an
    edge of the frame isn't ruled, or some region that lines part isn't a rectangle. Squares that no line parts are one cell."""
    across = [r for r in rects if r[2] - r[0] >= r[3] - r[1]]
    down = [r for r in rects if r[2] - r[0] < r[3] - r[1]]
    xs, ys = axes((r[0] + r[2]) / 2 for r in down), axes((r[1] + r[3]) / 2 for r in across)
    rows, cols = len(ys) - 1, len(xs) - 1
    if rows < 1 or cols < 1:
        return None

    def ruled(lines, at, lo, hi, flat: bool) -> bool:
        part = sorted((r[0], r[2]) if flat else (r[1], r[3]) for r in lines if abs(((r[1] + r[3]) if flat else (r[0] + r[2])) / 2 - at) <= SNAP)
        held, upto = 0.0, lo
        for a, z in part:
            held += max(0.0, min(z, hi) - max(a, upto))
            upto = max(upto, min(z, hi))
        return held >= EDGE * (hi - lo)

    wall = np.array([[ruled(down, x, ys[r], ys[r + 1], False) for x in xs] for r in range(rows)])
    floor = np.array([[ruled(across, y, xs[c], xs[c + 1], True) for c in range(cols)] for y in ys])
    if not (wall[:, [0, -1]].all() and floor[[0, -1]].all()):
        raise Declined("ruling on the page doesn't close into a table")
    group = np.arange(rows * cols).reshape(rows, cols)
    joins = [((r, c), (r, c + 1)) for r in range(rows) for c in range(cols - 1) if not wall[r, c + 1]] + [((r, c), (r + 1, c)) for r in range(rows - 1) for c in range(cols) if not floor[r + 1, c]]
    for a, b in joins:
        group[group == group[b]] = group[a]
    cells = []
    for k in np.unique(group):
        at = np.argwhere(group == k)
        (r0, c0), (r1, c1) = at.min(0).tolist(), at.max(0).tolist()
        if (r1 - r0 + 1) * (c1 - c0 + 1) != len(at):
            raise Declined("a region that ruling parts isn't a rectangle")
        cells.append((r0, c0, r1 - r0 + 1, c1 - c0 + 1))
    return Grid(xs, ys, cells)


def lattice(rects: list[tuple[float, float, float, float]]) -> list[tuple[int, int, int, int]] | None:
    """(row, col, row_span, col_span) of the cells that ruling lines close; None if they make no grid, or don't close it."""
    try:
        grid = closed_grid(rects)
    except Declined:
        return None
    return grid.shape if grid else None


#: Fixed values, in shares: a bullet of its word's size; figures and frames of the page, figures in all, and words of a figure.
BULLET, FIGURE, FRAME, FIGURES, LETTERED = 0.8, 0.002, 0.95, 0.4, 0.3


def ruled_table(page: Page, grid: Grid, taken: np.ndarray) -> Region | None:
    """A grid's table with the page's words in it, which are taken; None for a grid without a word (a frame)."""
    x, y = (page.x0 + page.x1) / 2, (page.y0 + page.y1) / 2
    own = np.flatnonzero(~taken & (x >= grid.xs[0]) & (x < grid.xs[-1]) & (y >= grid.ys[0]) & (y < grid.ys[-1]))
    if not len(own):
        return None
    r, c = np.searchsorted(grid.ys, y[own], "right") - 1, np.searchsorted(grid.xs, x[own], "right") - 1
    rows: dict[int, list[str]] = {}
    for top, left, height, width in sorted(grid.cells):
        held = own[(r >= top) & (r < top + height) & (c >= left) & (c < left + width)]
        if len(held) and (page.x0[held].min() < grid.xs[left] - SNAP or page.x1[held].max() > grid.xs[left + width] + SNAP):
            raise Declined("a word lies over the ruling of a table")
        free = np.zeros(len(page.text), bool)
        free[held] = True
        lines = lines_of(page, free)
        rows.setdefault(top, []).append(join_lines([lines.text(i) for i in range(len(lines))]) if len(held) else "")
    taken[own] = True
    return Region("table", (grid.xs[0], grid.ys[0], grid.xs[-1], grid.ys[-1]), "\n".join(" | ".join(rows[k]) for k in sorted(rows)), len(rows))


def drawn(page: Page, rules: list, drawings: list, width: float, height: float) -> tuple[list[Region], np.ndarray, set[int]]:
    """(regions, free words, bulleted words) of what is ruled and drawn on a page of that size. Declined if that can't be told."""
    taken, regions = np.zeros(len(page.text), bool), []
    for group in ruling_groups(rules):
        grid = closed_grid([rules[i] for i in group])
        table = ruled_table(page, grid, taken) if grid else None
        regions += [table] if table else []
    parts, bulleted = [], set()
    for d in drawings:
        # A small mark before a word on its line is a list's bullet.
        gap, middle = page.x0 - d[2], (d[1] + d[3]) / 2
        near = np.flatnonzero(~taken & (gap >= 0) & (gap <= BULLET_REACH * page.size) & (page.y0 <= middle) & (middle <= page.y1) & (max(d[2] - d[0], d[3] - d[1]) <= BULLET * page.size))
        if len(near):
            bulleted.add(int(near[np.argmin(gap[near])]))
        else:
            parts.append(d)
    boxes = figures(parts, width, height)
    if sum((b[2] - b[0]) * (b[3] - b[1]) for b in boxes) > FIGURES * width * height:
        raise Declined("the page is mostly drawing")
    x, y = (page.x0 + page.x1) / 2, (page.y0 + page.y1) / 2
    for b in boxes:
        if any(b[0] <= r.box[2] and r.box[0] <= b[2] and b[1] <= r.box[3] and r.box[1] <= b[3] for r in regions if r.kind == "table"):
            raise Declined("a drawing lies over a table")
        inside = ~taken & (x >= b[0]) & (x < b[2]) & (y >= b[1]) & (y < b[3])
        if ((page.x1 - page.x0) * (page.y1 - page.y0))[inside].sum() > LETTERED * (b[2] - b[0]) * (b[3] - b[1]):
            raise Declined("a drawing holds more text than a figure does")
        lines = lines_of(page, inside)
        taken |= inside
        regions.append(Region("figure", b, join_lines([lines.text(i) for i in range(len(lines))]) if len(lines) else ""))
    return regions, ~taken, bulleted


def words_in_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """Each word with the cell of its page that holds its middle, and whether it stands out of it (straddles).

    A middle that several words have, and a box that several cells have, are compared once; they meet in strips of the page as
    wide as boxes are on average, so a middle is compared with the boxes near it and not with all of its page. Boxes lie in at
    most three strips each, on average. A word has a row for each cell that holds it, or one without a cell.

    Rows can be many times the input, so they come in an order that takes little room where they are written: all words of a
    middle go through a tile of cells before the next tile, and a task has few middles. Columns are then short patterns that
    repeat, of few different ids. The words of a middle are held in memory while its tiles pass.
    """
    sides = ["cx0", "cx1", "cy0", "cy1"]
    others = [c for c in cells.columns if c not in ("page", *sides)]
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    # Cells of one box are one row, or several of BOXED cells.
    nth = F.row_number().over(Window.partitionBy("page", *sides).orderBy("cx0"))
    own = cells.where("cx0 < cx1 and cy0 < cy1").withColumn("__part", F.floor((nth - 1) / BOXED))
    boxes = own.groupBy(F.col("page").alias("__of"), *sides, "__part").agg(F.collect_list(F.struct(*others)).alias("__cells")).drop("__part")
    # One column, a null too, unfolds faster without a struct around it.
    boxes = boxes.withColumn("__cells", F.transform("__cells", lambda c: c[others[0]])) if len(others) == 1 else boxes
    wide, held = boxes.agg(F.avg(F.col("cx1").cast("double") - F.col("cx0").cast("double")), F.sum(F.size("__cells"))).first()
    # Tasks aren't put together by the size of what they read, which says nothing about their rows.
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((held or 0) / TASK_CELLS))
    strip = lambda v: F.floor(v.cast("double") / F.lit(wide).cast("double"))
    placed = boxes.withColumn("__strip", F.explode(F.sequence(strip(F.col("cx0")), strip(F.col("cx1")))))
    before = Window.partitionBy("__of", "__strip").orderBy(*sides).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__tile", F.floor(F.coalesce(F.sum(F.size("__cells")).over(before), F.lit(0)) / TILE))
    tiles = placed.groupBy("__of", "__strip", "__tile").agg(F.collect_list(F.struct(*sides, "__cells")).alias("__boxes"))
    spots = words.select(F.col("page").alias("__page"), x.alias("__x"), y.alias("__y")).distinct().withColumn("__at", strip(F.col("__x")))
    inside = lambda b: (F.col("__x") >= b["cx0"]) & (F.col("__x") < b["cx1"]) & (F.col("__y") >= b["cy0"]) & (F.col("__y") < b["cy1"])
    near = (F.col("__page") == F.col("__of")) & (F.col("__at") == F.col("__strip"))
    # Rows of arrays in several strips are larger than their tables' files say: they aren't broadcast.
    found = spots.join(tiles.hint("merge"), near).select("__page", "__x", "__y", F.filter("__boxes", inside).alias("__boxes")).where(F.size("__boxes") > 0)
    # Middles meet by a hash, so both sides are dealt out as told; then they are compared. 0.0 + makes one zero of two.
    spot = lambda *of: F.xxhash64(of[0], *[F.lit(0.0) + v for v in of[1:]])
    same = lambda a, b: (F.col(a) >= F.col(b)) & (F.col(a) <= F.col(b))
    left = found.withColumn("__spot", spot(F.col("__page"), F.col("__x"), F.col("__y"))).repartition(tasks, "__spot")
    right = words.select("*", F.col("page").alias("__p"), x.alias("__mx"), y.alias("__my"), spot(F.col("page"), x, y).alias("__own")).repartition(tasks, "__own")
    meet = (F.col("__spot") == F.col("__own")) & same("__p", "__page") & same("__mx", "__x") & same("__my", "__y")
    # The tiles come first: a merge goes through the right side's rows for each row of the left.
    out = left.hint("merge").join(right, meet).select(*words.columns, F.explode("__boxes").alias("__box"))
    each = F.explode("__box.__cells").alias(others[0]) if len(others) == 1 else F.inline("__box.__cells")
    out = out.select(*words.columns, *[F.col(f"__box.{c}").alias(c) for c in sides], each)
    none = words.join(found.select("__page", "__x", "__y"), (words["page"] == F.col("__page")) & (x == F.col("__x")) & (y == F.col("__y")), "left_anti")
    out = out.unionByName(none, allowMissingColumns=True)
    out = out.select(*words.columns, *[c for c in cells.columns if c != "page"])
    return out.withColumn("straddles", (F.col("x0") < F.col("cx0") - SNAP) | (F.col("x1") > F.col("cx1") + SNAP))


def nearest_words(marks: DataFrame, words: DataFrame) -> DataFrame:
    """For each small mark the nearest word to its right on its line, within BULLET_REACH sizes: page, mark_id, word_id.

    Marks and words meet by a shuffle: words may be exploded from small rows, whose size says nothing about theirs, so a
    broadcast could take far more of the driver than was foreseen.
    """
    m = marks.select("page", "mark_id", F.col("x1").alias("mx"), F.col("baseline").alias("mb"))
    gap = F.col("x0") - F.col("mx")
    near = words.hint("merge").join(m, "page").where((gap >= 0) & (gap <= BULLET_REACH * F.col("size")) & (F.abs(F.col("baseline") - F.col("mb")) <= F.col("size")))
    return near.groupBy("page", "mark_id").agg(F.min_by("word_id", F.struct(gap, F.col("word_id"))).alias("word_id"))


def figures(parts: list[tuple[float, float, float, float]], width: float, height: float) -> list[tuple[float, float, float, float]]:
    """Drawings within a tenth of the page's width of each other, as one box each; specks and page frames are none."""
    boxes = [p for p in parts if not (p[2] - p[0] >= FRAME * width and p[3] - p[1] >= FRAME * height)]
    while True:
        # Boxes that were joined may reach others, so they are looked at again until none does.
        groups = ruling_groups(boxes, 0.1 * width)
        joined = [tuple(f(boxes[i][k] for i in g) for k, f in enumerate((min, min, max, max))) for g in groups]
        if len(joined) == len(boxes):
            return [b for b in sorted(joined, key=lambda b: (b[1], b[0])) if (b[2] - b[0]) * (b[3] - b[1]) >= FIGURE * width * height]
        boxes = joined


def ruled_cells(rects: DataFrame) -> DataFrame:
    """page, tab, row, col, row_span, col_span of the tables that ruling lines (page, x0, y0, x1, y1) close.

    Lines that touch are one table's; tables count from 1 by their uppermost and leftmost line. Lines that close no table, or
    one whose cells aren't all rectangles, give no rows. Lines with a null place are left out; repeated lines count once; an
    empty table gives no rows.
    """
    sides = ["x0", "y0", "x1", "y1"]
    known = functools.reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in sides])
    own = rects.where(known).select("page", F.struct(*[F.col(s).cast("double").alias(s) for s in sides]).alias("r"))
    pages = own.groupBy("page").agg(F.array_sort(F.collect_set("r")).alias("rects"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, boxes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                boxes = [tuple(b[s] for s in sides) for b in boxes]
                groups = [[boxes[i] for i in g] for g in ruling_groups(boxes)]
                groups.sort(key=lambda g: (min(b[1] for b in g), min(b[0] for b in g)))
                tables = [cells for g in groups if (cells := lattice(g))]
                out += [(page, n, *cell) for n, cells in enumerate(tables, 1) for cell in cells]
            columns = zip(*out, strict=True) if out else [()] * 6
            types = [batch.column(0).type, *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page", "tab", "row", "col", "row_span", "col_span"])

    fields = T._parse_datatype_string("tab int, row int, col int, row_span int, col_span int").fields
    return pages.mapInArrow(run, T.StructType([own.schema["page"], *fields]))


def header_rows(cells: DataFrame) -> DataFrame:
    """cells (page, tab, row, bold, backed) with header: in the rows from the top that are all bold, or backed by a fill for nine
    tenths, unless that is the whole table. Null marks are false. Built-in expressions only."""
    rows = cells.groupBy("page", "tab", "row").agg(
        F.bool_and(F.coalesce("bold", F.lit(False))).alias("bold"), F.avg(F.coalesce("backed", F.lit(False)).cast("double")).alias("share")
    )
    table = Window.partitionBy("page", "tab")
    plain = ~(F.col("bold") | (F.col("share") >= 0.9))
    first = F.min(F.when(plain, F.col("row"))).over(table)
    heads = rows.withColumn("header", F.coalesce(F.col("row") < first, F.lit(False))).select("page", "tab", "row", "header")
    return cells.join(heads, ["page", "tab", "row"])


def page_figures(parts: DataFrame, width: float, height: float) -> DataFrame:
    """page, n, x0, y0, x1, y1 of the figures that drawings (page, x0, y0, x1, y1) make on pages of that size, from the top."""
    sides = ["x0", "y0", "x1", "y1"]
    own = parts.select("page", F.struct(*[F.col(s).cast("double").alias(s) for s in sides]).alias("r"))
    pages = own.groupBy("page").agg(F.array_sort(F.collect_set("r")).alias("parts"))

    @F.udf("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    def boxes(rows):
        return sorted(figures([tuple(r) for r in rows], width, height), key=lambda b: (b[1], b[0]))

    return pages.select("page", F.posexplode(boxes("parts")).alias("n", "b")).select("page", (F.col("n") + 1).alias("n"), "b.*")
