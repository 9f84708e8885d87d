"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host and path, with a weight and a verdict. From the parsed expression it is worked out
which tokens (runs of letters and digits, whole) a URL must hold for the rule to fit: of each way in which the expression can
match, one token, the one that the fewest rules share. The rule is filed under those. A URL's own tokens fetch the rules
filed under them, and only these, and the few rules that need no token, run. The fitting rule of the greatest weight decides;
where none fits, the default verdict does.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from docspark.session import prepare

TOKEN = re.compile(r"[0-9a-z]+")
#: Rules that one task may hold, and ways to match that are looked at in one expression before the rest count as anything.
MAX_RULES, MAX_WAYS = 1_000_000, 64

SCHEMA = "host string, path string, rule string, verdict string"
_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

# --- tokens that a match must hold -----------------------------------------------------------------------------------

#: In a way to match, beside characters of tokens: a place that surely parts tokens, and one that may hold anything.
BREAK, GAP = "|", "*"
_ALNUM = frozenset(string.digits + string.ascii_lowercase)
_UNIT, _ANY = [()], [(GAP,)]


def _member(items: list, c: str) -> bool | None:
    """Whether a parsed character class holds c; None if it can't be told."""
    found, negated = False, False
    for op, arg in items:
        name = str(op)
        if name == "NEGATE":
            negated = True
        elif name == "LITERAL":
            found |= ord(c) == arg
        elif name == "RANGE":
            found |= arg[0] <= ord(c) <= arg[1]
        elif name == "CATEGORY":
            kind = str(arg).removeprefix("CATEGORY_")
            own = {"DIGIT": c.isdigit(), "WORD": True, "SPACE": False}.get(kind.removeprefix("NOT_"))
            if own is None:
                return None
            found |= own != kind.startswith("NOT_")
        else:
            return None
    return found != negated


def _class_ways(items: list, folded: bool) -> list[tuple[str, ...]]:
    held = {c for c in string.digits + string.ascii_letters if _member(items, c) is not False}
    plain = all(str(op) == "LITERAL" for op, _ in items)
    if folded and not (plain and all(arg < 128 for _, arg in items)):
        return _ANY
    if not held:
        return [(BREAK,)]
    if plain and len(items) <= 8 and not folded:
        return [(_char(chr(arg)),) for _, arg in items]
    return _ANY


def _char(c: str) -> str:
    c = c.translate(_LOWER)
    return c if c in _ALNUM else BREAK


def _crossed(parts: Iterable[list[tuple[str, ...]]]) -> list[tuple[str, ...]]:
    out = _UNIT
    for own in parts:
        out = [a + b for a in out for b in own] if len(out) * len(own) <= MAX_WAYS else [a + (GAP,) for a in out]
    return out


def _no_token_beside(items: list) -> bool:
    """Whether a look-around forbids every character of a token."""
    own = items[0][1] if len(items) == 1 and str(items[0][0]) == "IN" else None
    return own is not None and all(_member(own, c) for c in _ALNUM)


def ways(items: Iterable, flags: int = 0) -> list[tuple[str, ...]]:
    """Every way in which a parsed expression can match, as token characters, BREAK and GAP; at most MAX_WAYS.

    Only certain things are said: where more can stand than is listed, there is a GAP, and a token is whole between two
    BREAKs alone.
    """
    parts = []
    for op, arg in items:
        name = str(op)
        # Case folding lets a few characters outside ASCII stand for i, k and s.
        folded = bool(flags & re.IGNORECASE and not flags & re.ASCII)
        if name == "LITERAL":
            parts.append(_ANY if folded and chr(arg) in "iIkKsS\u0130\u0131\u017f\u212a" else [(_char(chr(arg)),)])
        elif name == "IN":
            parts.append(_class_ways(arg, bool(flags & re.IGNORECASE)))
        elif name == "AT":
            parts.append(_ANY if "NON_BOUNDARY" in str(arg) else [(BREAK,)])
        elif name == "SUBPATTERN":
            _, add, gone, own = arg
            parts.append(ways(own, (flags | add) & ~gone))
        elif name == "ATOMIC_GROUP":
            parts.append(ways(arg, flags))
        elif name == "BRANCH":
            own = [w for branch in arg[1] for w in ways(branch, flags)]
            parts.append(own if len(own) <= MAX_WAYS else _ANY)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, own = arg
            once = ways(own, flags)
            if once == [(BREAK,)]:
                parts.append(once if low else [(), (BREAK,)])
            elif high == 1:
                parts.append(once if low else [(), *once])
            elif low == high <= 3:
                parts += [once] * low
            else:
                parts += [once, _ANY] if low else [_ANY]
        elif name in ("ASSERT", "ASSERT_NOT"):
            parts.append([(BREAK,)] if name == "ASSERT_NOT" and _no_token_beside(arg[1]) else _UNIT)
        else:
            parts.append(_ANY)
    return _crossed(parts)


def tokens_of(way: tuple[str, ...]) -> frozenset[str]:
    """The whole tokens in a way to match."""
    return frozenset(re.findall(r"(?<=\|)[0-9a-z]+(?=\|)", "".join(way)))


def needed(pattern: str, before: str, after: str) -> list[frozenset[str]]:
    """For each way in which a pattern can match, the tokens that it holds. before and after: what stands beside a match."""
    tree = re._parser.parse(pattern)
    return [tokens_of((before, *way, after)) for way in ways(tree, tree.state.flags)]


# --- rules -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """name: as reported, None for a rule that only sets the verdict.

    host and path are regular expressions that must match all of the host and the begin of the path; a rule without
    them has anywhere, which is searched for in the host and in the lower-cased path. Expressions are taken as they are, so
    they should be of a trusted list: none may need time that grows fast with a URL's length.
    """

    name: str | None
    verdict: str
    weight: int
    host: str = ""
    path: str = ""
    anywhere: str = ""

    def compiled(self) -> Callable[[str, str], bool]:
        if self.anywhere:
            found = re.compile(self.anywhere).search
            return lambda host, path: bool(found(host) or found(path.translate(_LOWER)))
        on_host, on_path = re.compile(self.host, re.DOTALL).fullmatch, re.compile(self.path, re.DOTALL).match
        return lambda host, path: bool(on_path(path) and on_host(host))

    @cached_property
    def choices(self) -> list[list[frozenset[str]]]:
        """Ways to match, of the whole rule or of either half; a URL that fits holds the tokens of one way of each."""
        if self.anywhere:
            return [needed(self.anywhere, GAP, GAP)]
        return [needed(self.host, BREAK, BREAK), needed(self.path, BREAK, GAP)]


def site_rule(name: str, verdict: str) -> Rule:
    """host/path: fits the host, all its subdomains, and paths that start with the rule's; the longest wins."""
    host, slash, path = name.partition("/")
    return Rule(name, verdict, 1_000_000 + len(name), rf"(?:.*\.)?{re.escape(host)}", re.escape(slash + path))


def word_rule(words: str, verdict: str, weight: int = 0) -> Rule:
    """Words with hyphens between them, standing whole anywhere in the host or the path."""
    return Rule(None, verdict, weight, anywhere=rf"(?<![0-9a-z]){re.escape(words)}(?![0-9a-z])")


def pitch_rule(pitch: str, goods: str) -> Rule:
    """Two words beside each other in either order, parted by one mark."""
    return Rule(None, "block", 0, anywhere=rf"(?<![0-9a-z])(?:{pitch}[-_.+]{goods}|{goods}[-_.+]{pitch})(?![0-9a-z])")


def server_rule(word: str) -> Rule:
    """A host below a label of that word, which may have a number."""
    return Rule(None, "block", 0, host=rf"(?:.*\.)?{word}s?(?:-[0-9]+)?\.[^.]+\..*")


def folder_rule(word: str) -> Rule:
    """A folder of that name in the path."""
    return Rule(None, "block", 0, host=r".*", path=rf".*/{word}s?(?:/|\Z)")


def rules_of(df: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table: name, verdict, weight, host, path, anywhere. At most MAX_RULES; null expressions are none.

    A rule without any expression, a verdict but allow or block, or an expression that can't be read is refused.
    """
    rows = df.select("name", "verdict", "weight", "host", "path", "anywhere").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = tuple(Rule(r.name, r.verdict, r.weight or 0, r.host or "", r.path or "", r.anywhere or "") for r in sorted(rows, key=str))
    for r in out:
        try:
            r.compiled(), r.choices  # noqa: B018
        except re.error as e:
            raise ValueError(f"the rule {r} can't be read: {e}") from e
        if r.verdict not in ("allow", "block") or not (r.host or r.path or r.anywhere):
            raise ValueError(f"the rule {r} has no verdict or no expression")
    return out


#: The rules of the query by name, and words that mark spam, gambling and advertising.
SITE_RULES = (site_rule("net/", "block"), site_rule("example.net/en/", "allow"), site_rule("example.com/de/", "block"), site_rule("org/fr/", "allow"))
WORDS = ("casino-win", "free-bets", "cheap-pills", "ads-track", "casino", "bets", "pills", "ads", "adserver", "viagra", "xxx", "porn", "torrent")
PITCHES = ("cheap", "free", "buy", "win", "best", "online", "bonus", "fast", "instant", "discount", "deal", "hot")
GOODS = ("pill", "poker", "slots", "roulette", "lottery", "loans", "payday", "cialis", "replica", "escort", "crypto", "betting")
SERVERS = ("adclick", "banner", "tracker", "popunder", "clickserver", "adimage", "affiliate", "doubleclick")
FOLDERS = ("adframe", "sponsored", "popup", "banner", "clicktrack", "outbound-ad", "casino_game", "adult")
FILES = ("exe", "scr", "msi", "apk", "bat", "dmg")
RULES = (
    *SITE_RULES, *(word_rule(w, "block") for w in WORDS), *(pitch_rule(p, g) for p in PITCHES for g in GOODS), *(server_rule(w) for w in SERVERS), *(folder_rule(w) for w in FOLDERS),
    Rule(None, "block", 0, anywhere=rf"\.(?:{'|'.join(FILES)})\Z"), Rule(None, "block", 0, host=r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?"),
)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path): the host with A-Z in lower case; both empty for a null or a URL without ://."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = re.search(r"[?#]", rest)
    rest = rest[: end.start()] if end else rest
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class Index:
    def __init__(self, rules: Iterable[Rule], default: str = "allow"):
        rules = tuple(rules)
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; {MAX_RULES} are the bound")
        self.default = default
        shared = Counter(t for r in rules for t in {t for half in r.choices for way in half for t in way})
        self.by_token: dict[str, list[tuple[Rule, Callable[[str, str], bool]]]] = {}
        self.always: list[tuple[Rule, Callable[[str, str], bool]]] = []
        for r in rules:
            own = (r, r.compiled())
            halves = [{min(way, key=lambda t: (shared[t], -len(t), t)) for way in half} for half in r.choices if all(half)]
            for t in min(halves, key=lambda h: (sum(shared[t] for t in h), sorted(h)), default=()):
                self.by_token.setdefault(t, []).append(own)
            if not halves:
                self.always.append(own)

    def candidates(self, host: str, path: str) -> list[tuple[Rule, Callable[[str, str], bool]]]:
        """Each rule that may fit; one that is filed under several of the URL's tokens may come as often."""
        tokens = set(TOKEN.findall(f"{host} {path.translate(_LOWER)}"))
        return [c for t in tokens for c in self.by_token.get(t, ())] + self.always

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """(host, path, the deciding rule's name, verdict)."""
        host, path = parts(url)
        fits = [r for r, fit in self.candidates(host, path) if fit(host, path)]
        if not fits:
            return host, path, None, self.default
        best = max(fits, key=lambda r: (r.weight, r.verdict, r.name or ""))
        return host, path, best.name, best.verdict


def judge(df: DataFrame, rules: Iterable[Rule] = RULES, url_col: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per row: page_id, host, path, rule (the deciding site rule, else null), verdict (allow or block).

    A null URL or one without :// has an empty host and path, no rule, and the default verdict. Of rules of the same weight
    one that blocks decides, then the name that sorts last. Repeated rows are judged alike; a null id stays null; other
    columns are ignored; an empty table gives no rows.
    """
    prepare(df.sparkSession)
    rules = tuple(rules)
    own = df.select(df[id_col].alias("page_id"), df[url_col].cast("string").alias("__url"))

    def run(batches):
        index = Index(rules, default)
        for batch in batches:
            found = [index.judge(u.as_py()) for u in batch.column(1)]
            cols = [pa.array(x, pa.string()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["page_id", "host", "path", "rule", "verdict"])

    schema = own.select("page_id").schema
    for name in ("host", "path", "rule", "verdict"):
        schema = schema.add(name, "string")
    return own.mapInArrow(run, schema)


_MARK, _OTHER = "[-_.+]", "[^0-9a-z]"
_ANYWHERE = [
    rf"(^|{_OTHER})({'|'.join(WORDS)})({_OTHER}|$)", rf"(^|{_OTHER})(({'|'.join(PITCHES)}){_MARK}({'|'.join(GOODS)})|({'|'.join(GOODS)}){_MARK}({'|'.join(PITCHES)}))({_OTHER}|$)", rf"\.({'|'.join(FILES)})$",
]
_HOSTS = [rf"(.*\.)?({'|'.join(SERVERS)})s?(-[0-9]+)?\.[^.]+\..*", r"[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?"]

#: The same rows in DuckDB.
SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0
    THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path
  FROM u
), r AS (
  SELECT page_id, host, path, translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN {" OR ".join(f"regexp_matches({own}, '{x}')" for x in _ANYWHERE for own in ("host", "low"))} OR {" OR ".join(f"regexp_full_match(host, '{x}', 's')" for x in _HOSTS)}
    OR regexp_matches(path, '^.*/({"|".join(FOLDERS)})s?(/|$)', 's') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""
