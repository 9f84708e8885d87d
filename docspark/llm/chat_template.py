"""Chat formatting: a compiler from a small, sandboxed template language to Python closures.

The language has literals, {{ expressions }}, {% for x in list %}, {% if %}/{% elif %}/{% else %}, {% set x = .. %} and
{% generation %} .. {% endgeneration %}, whose output is under the loss mask. Expressions know strings, numbers, true,
false, none, names, member access by .name or ['name'], ==, !=, in, not, and, or, +, a list of filters after |, and
loop.first, loop.last and loop.index0. There are no calls, no attributes of Python objects and no way to import.

compile() parses a template into a syntax tree, folds constant expressions, joins neighbouring literals, drops
branches that can't be reached, and turns each node into a closure. Texts pass through the filter esc, which makes
control strings in them inert and can be undone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.session import prepare

CHATML = (
    "{% for m in messages %}<|im_start|>{{ m.role | line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | esc }}{% endgeneration %}{% else %}{{ m.text | esc }}{% endif %}<|im_end|>\n{% endfor %}"
)


class TemplateError(ValueError):
    """A template that the language doesn't allow."""


# --- control strings ---------------------------------------------------------------------------------------------


def escape(text: str) -> str:
    r"""No control string is left: \ becomes \\ and <| becomes <\|."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_line(text: str) -> str:
    """As escape, and each line feed stands behind a backslash, so the first bare one ends the line."""
    return escape(text).replace("\n", "\\\n")


FILTERS: dict[str, Callable] = {"esc": escape, "line": escape_line, "trim": lambda x: x.strip(), "upper": lambda x: x.upper(), "lower": lambda x: x.lower(), "length": len}

# --- syntax tree -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class Set:
    name: str
    of: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing -----------------------------------------------------------------------------------------------------

_PARTS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.DOTALL)
_LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.|+\[\]()]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise TemplateError(f"expected {value or 'more'}, found {token[1] or 'the end'}")
        self.at += 1
        return token

    def whole(self):
        out = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def _chain(self, words: tuple[str, ...], below):
        out = below()
        while self.peek()[1] in words and self.peek()[0] in ("name", "op"):
            out = Op(self.take()[1], (out, below()))
        return out

    def either(self):
        return self._chain(("or",), self.both)

    def both(self):
        return self._chain(("and",), self.negated)

    def negated(self):
        if self.peek() == ("name", "not"):
            self.take()
            return Op("not", (self.negated(),))
        return self._chain(("==", "!=", "in"), self.total)

    def total(self):
        return self._chain(("+",), self.filtered)

    def filtered(self):
        out = self.member()
        while self.peek() == ("op", "|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Filter(name, out)
        return out

    def member(self):
        out = self.atom()
        while self.peek() in (("op", "."), ("op", "[")):
            if self.take()[1] == ".":
                kind, name = self.take()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no member {name!r}")
                out = Member(out, Const(name))
            else:
                out = Member(out, self.either())
                self.take("]")
        return out

    def atom(self):
        kind, value = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "num":
            return Const(int(value))
        if kind == "name":
            if value.startswith("_"):
                raise TemplateError(f"no name {value!r}")
            constants = {"true": True, "false": False, "none": None}
            return Const(constants[value]) if value in constants else Name(value)
        if value == "(":
            out = self.either()
            self.take(")")
            return out
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """A template's syntax tree."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _PARTS.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        if "-" in (m[1], m[4]):
            text = text.rstrip()
        parts.append(("text", text))
        if m[2] is not None:
            parts.append(("out", m[2]))
        elif m[5] is not None:
            parts.append(("tag", m[5].strip()))
        strip = "-" in (m[3], m[6])
        at = m.end()
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    body, rest, stop = _body(parts, 0, ())
    if rest != len(parts):
        raise TemplateError(f"unexpected {{% {stop} %}}")
    return body


def _body(parts: list, at: int, ends: tuple[str, ...]) -> tuple[tuple, int, str]:
    """Nodes up to a tag in ends: (nodes, index behind that tag, the tag)."""
    out = []
    while at < len(parts):
        kind, text = parts[at]
        at += 1
        if kind == "text":
            if text:
                out.append(Text(text))
            continue
        if kind == "out":
            out.append(Output(Expression(text).whole()))
            continue
        word, _, rest = text.partition(" ")
        if word in ends:
            return tuple(out), at, text
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
            if not m:
                raise TemplateError(f"cannot read {{% {text} %}}")
            body, at, _ = _body(parts, at, ("endfor",))
            out.append(For(m[1], Expression(m[2]).whole(), body))
        elif word == "if":
            branches, condition = [], Expression(rest).whole()
            while True:
                body, at, end = _body(parts, at, ("elif", "else", "endif"))
                branches.append((condition, body))
                word, _, rest = end.partition(" ")
                if word == "endif":
                    break
                condition = Const(True) if word == "else" else Expression(rest).whole()
            out.append(If(tuple(branches)))
        elif word == "set":
            m = re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)\s*(.+)", rest.strip(), re.DOTALL)
            if not m:
                raise TemplateError(f"cannot read {{% {text} %}}")
            out.append(Set(m[1], Expression(m[2]).whole()))
        elif word == "generation":
            body, at, _ = _body(parts, at, ("endgeneration",))
            out.append(Generation(body))
        else:
            raise TemplateError(f"no tag {word!r} here")
    if ends:
        raise TemplateError(f"missing {{% {ends[-1]} %}}")
    return tuple(out), at, ""


# --- constant folding --------------------------------------------------------------------------------------------

_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
}


def fold(node):
    """An expression with its constant parts computed."""
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(_OPS[node.op](*(a.value for a in args)))
            except TypeError as e:
                raise TemplateError(str(e)) from e
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Op(node.op, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Member):
        return Member(fold(node.of), fold(node.key))
    return node


def fold_body(body: tuple) -> tuple:
    out: list = []
    for node in body:
        if isinstance(node, Output):
            of = fold(node.of)
            new = [Text(shown(of.value))] if isinstance(of, Const) else [Output(of)]
        elif isinstance(node, Set):
            new = [Set(node.name, fold(node.of))]
        elif isinstance(node, For):
            new = [For(node.name, fold(node.over), fold_body(node.body))]
        elif isinstance(node, Generation):
            new = [Generation(fold_body(node.body))]
        elif isinstance(node, If):
            branches = []
            for condition, own in node.branches:
                condition = fold(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                branches.append((condition, fold_body(own)))
                if isinstance(condition, Const):
                    break
            new = list(branches[0][1]) if branches and isinstance(branches[0][0], Const) else [If(tuple(branches))] if branches else []
        else:
            new = [node]
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + x.value)
            elif not isinstance(x, Text) or x.value:
                out.append(x)
    return tuple(out)


# --- closures ----------------------------------------------------------------------------------------------------


def shown(value: object) -> str:
    return "" if value is None else str(value)


@dataclass
class Rendering:
    """parts: the output so far; spans: code points under the loss mask, from..upto."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n)
    if isinstance(node, Member):
        of, key = _value(node.of), _value(node.key)

        def member(scope):
            held, k = of(scope), key(scope)
            if isinstance(held, dict):
                return held.get(k)
            return held[k] if isinstance(held, list) and isinstance(k, int) and -len(held) <= k < len(held) else None

        return member
    if isinstance(node, Filter):
        of, f = _value(node.of), FILTERS[node.name]

        def filtered(scope):
            held = of(scope)
            return f("" if held is None else held)

        return filtered
    if node.op == "and":
        a, b = map(_value, node.args)
        return lambda scope: a(scope) and b(scope)
    if node.op == "or":
        a, b = map(_value, node.args)
        return lambda scope: a(scope) or b(scope)
    args, op = tuple(map(_value, node.args)), _OPS[node.op]
    return lambda scope: op(*(x(scope) for x in args))


def _run(body: tuple) -> Callable[[dict, Rendering], None]:
    steps = tuple(_step(node) for node in body)

    def run(scope, out):
        for step in steps:
            step(scope, out)

    return run


def _step(node) -> Callable[[dict, Rendering], None]:
    if isinstance(node, Text):
        return lambda scope, out, t=node.value: out.write(t)
    if isinstance(node, Output):
        of = _value(node.of)
        return lambda scope, out: out.write(shown(of(scope)))
    if isinstance(node, Set):
        of = _value(node.of)
        return lambda scope, out, n=node.name: scope.__setitem__(n, of(scope))
    if isinstance(node, Generation):
        body = _run(node.body)

        def generation(scope, out):
            begin = out.size
            body(scope, out)
            out.spans.append((begin, out.size))

        return generation
    if isinstance(node, If):
        branches = tuple((_value(c), _run(b)) for c, b in node.branches)

        def choose(scope, out):
            for condition, body in branches:
                if condition(scope):
                    return body(scope, out)

        return choose
    over, body = _value(node.over), _run(node.body)

    def loop(scope, out, n=node.name):
        items = list(over(scope) or ())
        inner = dict(scope)
        for i, item in enumerate(items):
            inner[n] = item
            inner["loop"] = {"index0": i, "first": i == 0, "last": i == len(items) - 1}
            body(inner, out)

    return loop


class Template:
    """A compiled template; render(messages=[..]) gives the text and the spans under the loss mask."""

    def __init__(self, source: str):
        self.tree = fold_body(parse(source))
        self._run = _run(self.tree)

    def render(self, **scope) -> Rendering:
        out = Rendering()
        self._run(dict(scope), out)
        return out


# --- reading back ------------------------------------------------------------------------------------------------

_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def read_back(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of CHATML's output; escaped texts hold no control string, so the marks are the turns'."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


# --- the operator ------------------------------------------------------------------------------------------------

FORMATTED = "array<struct<start:long,end:long>>"


def format_chats(df: DataFrame, template: str = CHATML, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code points of formatted under the loss mask).

    Turns stand in the order of turn, then role, then text, so ties and repeated rows have one result. A null text or
    role is empty; a row with a null id is a conversation of its own, as nothing tells with which others it belongs; other
    columns are ignored; an empty table gives no rows. A conversation is one task's work, as its text is one value; rows
    stream through sorted, so a task never holds more than one conversation.
    """
    prepare(df.sparkSession)
    Template(template)
    own = df.select(
        df[id_col].alias("conv_id"), df[turn_col].alias("__turn"), F.coalesce(df[role_col], F.lit("")).alias("__role"), F.coalesce(df[text_col], F.lit("")).alias("__text")
    )
    # Rows without an id are dealt out by what they hold.
    own = own.repartition(F.coalesce(F.when(F.col("conv_id").isNotNull(), F.xxhash64("conv_id")), F.xxhash64("__turn", "__role", "__text"))).sortWithinPartitions("conv_id", "__turn", "__role", "__text")

    def run(batches):
        compiled = Template(template)
        done: list[tuple] = []
        messages: list[dict] = []
        current = None
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def close():
            r = compiled.render(messages=messages)
            done.append((current, r.text, [{"start": a, "end": z} for a, z in r.spans]))

        def rows(kind):
            ids, texts, spans = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string()), pa.array(spans, span)], ["conv_id", "formatted", "loss_spans"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if messages and (conv != current or conv is None):
                    close()
                    messages = []
                    if len(done) >= 500:
                        yield rows(kind)
                current = conv
                messages.append({"role": role, "text": text})
        if messages:
            close()
            yield rows(kind)

    schema = T.StructType([own.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T._parse_datatype_string(FORMATTED))])
    return own.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from format_chats' rows: turns, and the texts under the loss mask."""
    import hashlib

    def run(batches):
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = list(read_back(text))
                turn_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                for role, said in turns:
                    turn_hash.update(f"{role}\n{said}\n".encode())
                loss = [unescape(text[s["start"] : s["end"]]) for s in spans]
                for part in loss:
                    loss_hash.update(part.encode())
                out.append((conv, len(turns), turn_hash.hexdigest(), sum(map(len, loss)), loss_hash.hexdigest(), len(text)))
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = formatted.select("conv_id").schema
    for name, kind in (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")):
        schema = schema.add(name, kind)
    return formatted.mapInArrow(run, schema)
