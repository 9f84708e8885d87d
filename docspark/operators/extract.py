"""Extractions: JSON shaped by a schema, merged over windows, with citations, and checked within a cost."""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of schemas and values.
SCHEMA_BYTES, SCHEMA_DEPTH, VALUE_DEPTH, NUMBER_CHARS, MAX_FINDINGS, MESSAGE_BYTES, MAX_COST, MAX_APPLIED, PATTERN_STEPS = 64 << 10, 16, 64, 32, 64, 300, 1 << 20, 256, 16_384
#: Keywords of a schema that are understood.
KEYWORDS = frozenset(
    "$schema $ref $defs $comment title description default examples deprecated readOnly writeOnly type enum const properties required additionalProperties patternProperties propertyNames minProperties maxProperties "
    "dependentRequired dependentSchemas items prefixItems contains minContains maxContains minItems maxItems uniqueItems minLength maxLength pattern format minimum maximum exclusiveMinimum exclusiveMaximum multipleOf allOf anyOf oneOf not if then else".split()
)
#: Keywords that only shape a value, so a model's decoder can be held to them.
SHAPING = frozenset("$schema $ref $defs $comment type properties required items enum const anyOf additionalProperties title description default examples".split())
#: The dialect of schemas, and the names of types.
DIALECT = "https://json-schema.org/draft/2020-12/schema"
TYPES = ("object", "array", "string", "boolean", "null", "number", "integer")
#: Rules that part of a document needn't keep.
WHOLE_ONLY = frozenset("required minItems minProperties minContains contains dependentRequired".split())


class Refused(ValueError):
    """A schema or a value that isn't taken."""


# --- JSON ----------------------------------------------------------------------------------------------------------


def decode(text: str) -> object:
    """JSON with bounds: numbers of at most NUMBER_CHARS, finite and not lost to zero; values nested at most VALUE_DEPTH."""

    def number(s: str) -> float | int:
        if len(s) > NUMBER_CHARS:
            raise Refused("a number is too long")
        v = float(s)
        if math.isinf(v) or (v == 0 and re.search(r"[1-9]", re.split("[eE]", s)[0])):
            raise Refused("a number is out of range")
        return int(s) if re.fullmatch(r"-?\d+", s) else v

    try:
        out = json.loads(text, parse_float=number, parse_int=number, parse_constant=lambda c: number("1e999"))
    except (json.JSONDecodeError, RecursionError) as e:
        raise Refused(str(e)) from e
    if nesting(out) > VALUE_DEPTH:
        raise Refused("the value is nested too deep")
    return out


def canonical(v: object) -> str:
    """The same text for equal values: members sorted, numbers as doubles."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else json.dumps(v)


def same(a: object, b: object) -> bool:
    return canonical(a) == canonical(b)


def token(name: str) -> str:
    """A member's name in a JSON pointer."""
    return name.replace("~", "~0").replace("/", "~1")


_MISSING = object()


def resolve(v: object, pointer: str) -> object:
    """The value a JSON pointer names, or _MISSING."""
    if pointer and not pointer.startswith("/"):
        return _MISSING
    for part in pointer.split("/")[1:]:
        name = part.replace("~1", "/").replace("~0", "~")
        if isinstance(v, dict):
            v = v.get(name, _MISSING)
        elif isinstance(v, list):
            v = v[int(name)] if re.fullmatch(r"\+?\d+", name) and int(name) < len(v) else _MISSING
        else:
            return _MISSING
        if v is _MISSING:
            return v
    return v


# --- schemas -------------------------------------------------------------------------------------------------------

_LISTS, _MAPS = ("allOf", "anyOf", "oneOf", "prefixItems"), ("properties", "patternProperties", "$defs", "dependentSchemas")
_ONES = ("items", "additionalProperties", "propertyNames", "contains", "not", "if", "then", "else")


_COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minContains", "maxContains", "minProperties", "maxProperties")
_BOUNDS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")


def _of(own: dict, keyword: str, kind: type, at: str):
    value = own.get(keyword, kind())
    if not isinstance(value, kind):
        raise Refused(f"{at}: {keyword} isn't of the right shape")
    return value


def subschemas(schema: object) -> Iterator[tuple[str, object]]:
    """(pointer, schema) of a schema and all below it."""
    todo = [("", schema)]
    while todo:
        at, own = todo.pop()
        yield at, own
        if isinstance(own, dict):
            todo += [(f"{at}/{k}", own[k]) for k in _ONES if k in own]
            todo += [(f"{at}/{k}/{i}", x) for k in _LISTS for i, x in enumerate(_of(own, k, list, at))]
            todo += [(f"{at}/{k}/{token(n)}", x) for k in _MAPS for n, x in _of(own, k, dict, at).items()]


def _values_checked(own: dict, at: str) -> None:
    """Refuses keywords whose values a check couldn't use."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    names = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    kinds = own.get("type", [])
    tests = [
        ("type", all(x in TYPES for x in ([kinds] if isinstance(kinds, str) else kinds if isinstance(kinds, list) else [None]))), ("enum", isinstance(own.get("enum", []), list)), ("required", names(own.get("required", []))),
        ("dependentRequired", all(names(x) for x in _of(own, "dependentRequired", dict, at).values())), ("uniqueItems", isinstance(own.get("uniqueItems", False), bool)), ("multipleOf", "multipleOf" not in own or number(own["multipleOf"]) and own["multipleOf"] > 0),
        ("pattern", isinstance(own.get("pattern", ""), str)), *((k, number(own.get(k, 0))) for k in _BOUNDS), *((k, number(own.get(k, 0)) and own.get(k, 0) >= 0 and float(own.get(k, 0)).is_integer()) for k in _COUNTS),
    ]
    wrong = next((k for k, fine in tests if not fine), None)
    if wrong:
        raise Refused(f"{at}: {wrong} isn't of the right shape")


def nesting(v: object) -> int:
    """How deep objects and lists stand in each other; 0 for a scalar."""
    level, own = 0, [v]
    while own := [x for x in own if isinstance(x, (dict, list))]:
        level += 1
        own = [y for x in own for y in (x.values() if isinstance(x, dict) else x)]
    return level


def applied(places: dict[str, object]) -> dict[str, int]:
    """How many schemas each place's schema applies to one value, its own among them, counted to MAX_APPLIED + 1.

    Refuses a schema that comes back to itself with no member and no item in between. A walk without recursion: a place is
    counted once all those that it applies are.
    """
    held: dict[str, list[str]] = {}
    for at, own in places.items():
        if isinstance(own, dict):
            ref = [own["$ref"][1:]] if "$ref" in own else []
            held[at] = ref + [f"{at}/{k}" for k in ("not", "if", "then", "else") if k in own and (k == "not" or "if" in own)]
            held[at] += [f"{at}/{k}/{i}" for k in ("allOf", "anyOf", "oneOf") for i in range(len(own.get(k, [])))] + [f"{at}/dependentSchemas/{token(n)}" for n in own.get("dependentSchemas", {})]
    waits = {at: len(held.get(at, [])) for at in places}
    users: dict[str, list[str]] = {}
    for at, own in held.items():
        for x in own:
            users.setdefault(x, []).append(at)
    counts, ready = dict.fromkeys(places, 1), [at for at, n in waits.items() if not n]
    while ready:
        done = ready.pop()
        waits.pop(done)
        for at in users.get(done, []):
            counts[at] = min(counts[at] + counts[done], MAX_APPLIED + 1)
            waits[at] -= 1
            if not waits[at]:
                ready.append(at)
    if waits:
        raise Refused(f"{min(waits)}: the schema applies itself to one value without end")
    return counts


def compile_schema(source: str) -> dict:
    """A schema that may be used, or Refused: an object's, small, of one dialect and known keywords, no deeper than SCHEMA_DEPTH,
    references inside itself, at most MAX_APPLIED schemas on one value, patterns of PATTERN_STEPS at most together."""
    if len(source.encode(errors="replace")) > SCHEMA_BYTES:
        raise Refused("the schema is too large")
    schema = decode(source)
    if not isinstance(schema, dict):
        raise Refused("a schema is an object")
    if nesting(schema) > SCHEMA_DEPTH:
        raise Refused("the schema is nested too deep")
    places = dict(subschemas(schema))
    patterns: dict[str, int] = {}
    for at, own in places.items():
        if isinstance(own, bool):
            continue
        if not isinstance(own, dict):
            raise Refused(f"{at}: a schema is an object or a boolean")
        unknown = sorted(own.keys() - KEYWORDS) or ["$schema"] * (at != "" and "$schema" in own)
        if unknown:
            raise Refused(f"{at}: {unknown[0]} isn't known")
        if own.get("$schema", DIALECT) != DIALECT:
            raise Refused("the schema is of another dialect")
        _values_checked(own, at)
        ref = own.get("$ref", "#")
        if not isinstance(ref, str) or not ref.startswith("#") or ref[1:] not in places:
            raise Refused(f"{at}: $ref names no schema of this one")
        for pattern in [*([own["pattern"]] if "pattern" in own else []), *own.get("patternProperties", {})]:
            patterns[pattern] = pattern_steps(pattern)
            if sum(patterns.values()) > PATTERN_STEPS:
                raise Refused(f"{at}: the patterns take too many steps")
    if schema.get("type") != "object":
        raise Refused("the schema's root isn't of the type object")
    wide = [at for at, n in applied(places).items() if n > MAX_APPLIED]
    if wide:
        raise Refused(f"{min(wide)}: the schema applies more than {MAX_APPLIED} schemas to one value")
    return schema


@functools.lru_cache(4096)
def pattern_steps(pattern: str) -> int:
    """About how many states a pattern unrolls to: bounded repeats multiply what they hold."""
    try:
        # Character classes by property are one state; this parser doesn't know them.
        tree = re._parser.parse(re.sub(r"\\[pP](\{\^?\w+\}|\w)", "a", pattern))
    except (re.error, OverflowError, RecursionError) as e:
        raise Refused(f"the pattern can't be read: {e}") from e

    def size(items) -> int:
        n = 0
        for op, arg in items:
            name = str(op)
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, own = arg
                n += max(1, low if high == re._constants.MAXREPEAT else high) * size(own) + 1
            elif name == "SUBPATTERN":
                n += size(arg[-1])
            elif name == "BRANCH":
                n += sum(map(size, arg[1])) + 1
            else:
                n += 1
        return n

    steps = size(tree)
    if steps <= PATTERN_STEPS:
        matches(pattern, "")
    return steps


def matches(pattern: str, text: str) -> bool:
    """Whether a text holds a match, in time that is the text's length times the pattern's steps: the engine never backtracks."""
    try:
        return pc.match_substring_regex(pa.scalar(text), pattern).as_py()
    except (pa.ArrowInvalid, UnicodeEncodeError) as e:
        raise Refused(f"the pattern can't be read: {e}") from e


def constrainable(schema: object) -> bool:
    """Whether a decoder can be held to the whole schema: shaping keywords alone, and objects closed where they say."""
    todo = [schema]
    while todo:
        own = todo.pop()
        if not isinstance(own, dict) or own.keys() - SHAPING or own.get("additionalProperties", False) is not False or own.get("anyOf", [{}]) == []:
            return False
        todo += [*own.get("properties", {}).values(), *own.get("$defs", {}).values(), *own.get("anyOf", []), *([own["items"]] if "items" in own else [])]
    return True


def strict(schema: object) -> object:
    """The schema with objects closed and every property required and nullable, as strict decoders ask for."""
    if isinstance(schema, list):
        return [strict(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: ({n: strict(x) for n, x in v.items()} if k in _MAPS else strict(v) if k in (*_ONES, *_LISTS) else v) for k, v in schema.items()}
    if "properties" in out:
        needed = set(out.get("required", []))
        out["properties"] = {n: x if n in needed else {"anyOf": [x, {"type": "null"}]} for n, x in out["properties"].items()}
        out |= {"required": list(out["properties"]), "additionalProperties": False}
    return out


def without_nulls(v: object, schema: object) -> object:
    """A strict decoder's nulls taken out again where the schema doesn't allow them."""
    if isinstance(v, dict) and isinstance(schema, dict):
        own = schema.get("properties", {})
        return {n: without_nulls(x, own.get(n, {})) for n, x in v.items() if not (x is None and n in own and next(validate(None, own[n]), None))}
    if isinstance(v, list) and isinstance(schema, dict):
        return [without_nulls(x, schema.get("items", {})) for x in v]
    return v


# --- checks --------------------------------------------------------------------------------------------------------

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def has_type(v: object, name: str) -> bool:
    if name in ("number", "integer"):
        return isinstance(v, (int, float)) and not isinstance(v, bool) and (name == "number" or float(v).is_integer())
    return isinstance(v, _TYPES.get(name, ()))


class _Meter:
    def __init__(self):
        self.spent = 0

    def pay(self, n: int) -> None:
        self.spent += n
        if self.spent > MAX_COST:
            raise Refused("the check takes too much work")


def validate(v: object, schema: object, at: str = "", root: object = None, part: bool = False, meter: _Meter | None = None) -> Iterator[tuple[str, str, str]]:
    """(pointer, rule, message) of what a value breaks; part leaves out the rules only a whole document must keep."""
    meter = meter or _Meter()
    root = schema if root is None else root
    meter.pay(1)
    if schema is False:
        yield at, "false", "no value is allowed here"
    if not isinstance(schema, dict):
        return

    def below(x, own, where):
        return validate(x, own, where, root, part, meter)

    def fits(x, own) -> bool:
        return next(below(x, own, at), None) is None

    def rule(name: str) -> bool:
        return name in schema and not (part and name in WHOLE_ONLY)

    if "$ref" in schema:
        yield from below(v, resolve(root, schema["$ref"][1:]), at)
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(has_type(v, n) for n in names):
            yield at, "type", f"expected {' or '.join(names)}"
    if "enum" in schema and not any(same(v, x) for x in schema["enum"]):
        yield at, "enum", "the value is none of those allowed"
    if "const" in schema and not same(v, schema["const"]):
        yield at, "const", "the value isn't the one allowed"
    if isinstance(v, str):
        meter.pay(len(v) // 64)
        if "minLength" in schema and len(v) < schema["minLength"]:
            yield at, "minLength", f"shorter than {schema['minLength']}"
        if "maxLength" in schema and len(v) > schema["maxLength"]:
            yield at, "maxLength", f"longer than {schema['maxLength']}"
        if "pattern" in schema:
            meter.pay(len(v) * pattern_steps(schema["pattern"]) // 64)
            if not matches(schema["pattern"], v):
                yield at, "pattern", "the text doesn't match"
    if has_type(v, "number"):
        for name, broken, words in (("minimum", lambda b: v < b, "less than"), ("maximum", lambda b: v > b, "more than"), ("exclusiveMinimum", lambda b: v <= b, "not more than"), ("exclusiveMaximum", lambda b: v >= b, "not less than")):
            if name in schema and broken(schema[name]):
                yield at, name, f"{words} {schema[name]}"
        if "multipleOf" in schema and Fraction(v) % Fraction(schema["multipleOf"]) and not float(v / schema["multipleOf"]).is_integer():
            yield at, "multipleOf", f"no multiple of {schema['multipleOf']}"
    if isinstance(v, list):
        if rule("minItems") and len(v) < schema["minItems"]:
            yield at, "minItems", f"fewer than {schema['minItems']} items"
        if "maxItems" in schema and len(v) > schema["maxItems"]:
            yield at, "maxItems", f"more than {schema['maxItems']} items"
        if schema.get("uniqueItems"):
            keys = [canonical(x) for x in v]
            meter.pay(sum(map(len, keys)) // 16)
            if len(set(keys)) < len(keys):
                yield at, "uniqueItems", "an item stands twice"
        first = schema.get("prefixItems", [])
        for i, x in enumerate(v):
            own = first[i] if i < len(first) else schema.get("items")
            if own is not None:
                yield from below(x, own, f"{at}/{i}")
        if rule("contains"):
            n = sum(fits(x, schema["contains"]) for x in v)
            if not schema.get("minContains", 1) <= n <= schema.get("maxContains", n):
                yield at, "contains", "too few or too many items of the kind asked for"
    if isinstance(v, dict):
        if rule("required"):
            for n in schema["required"]:
                if n not in v:
                    yield at, "required", f"{n} is missing"
        if rule("minProperties") and len(v) < schema["minProperties"]:
            yield at, "minProperties", f"fewer than {schema['minProperties']} members"
        if "maxProperties" in schema and len(v) > schema["maxProperties"]:
            yield at, "maxProperties", f"more than {schema['maxProperties']} members"
        if rule("dependentRequired"):
            for n, others in schema["dependentRequired"].items():
                for o in others if n in v else ():
                    if o not in v:
                        yield at, "dependentRequired", f"{o} is missing"
        for n, own in schema.get("dependentSchemas", {}).items():
            if n in v:
                yield from below(v, own, at)
        for n, x in v.items():
            where = f"{at}/{token(n)}"
            known = n in schema.get("properties", {})
            if known:
                yield from below(x, schema["properties"][n], where)
            for pattern, own in schema.get("patternProperties", {}).items():
                meter.pay(len(n) * pattern_steps(pattern) // 64)
                if matches(pattern, n):
                    known = True
                    yield from below(x, own, where)
            if not known and "additionalProperties" in schema:
                if schema["additionalProperties"] is False:
                    yield where, "additionalProperties", "no such member is allowed"
                else:
                    yield from below(x, schema["additionalProperties"], where)
            if "propertyNames" in schema:
                yield from below(n, schema["propertyNames"], where)
    for own in schema.get("allOf", []):
        yield from below(v, own, at)
    if "anyOf" in schema and not any(fits(v, own) for own in schema["anyOf"]):
        yield at, "anyOf", "the value fits none of the schemas"
    if "oneOf" in schema and sum(fits(v, own) for own in schema["oneOf"]) != 1:
        yield at, "oneOf", "the value doesn't fit exactly one of the schemas"
    if "not" in schema and fits(v, schema["not"]):
        yield at, "not", "the value fits a schema it mustn't"
    if "if" in schema:
        branch = schema.get("then" if fits(v, schema["if"]) else "else")
        if branch is not None:
            yield from below(v, branch, at)


def check(data: str | None, schema: dict, part: bool = False) -> list[dict]:
    """At most MAX_FINDINGS of what JSON text breaks; text that isn't JSON, or takes too much work, is one finding."""
    try:
        found = []
        for pointer, rule, message in validate(decode(data or ""), schema, part=part):
            found.append({"pointer": pointer, "rule": rule, "message": message.encode()[:MESSAGE_BYTES].decode(errors="ignore")})
            if len(found) == MAX_FINDINGS:
                break
        return found
    except (Refused, RecursionError) as e:
        return [{"pointer": "", "rule": "refused", "message": (str(e) if isinstance(e, Refused) else "the check takes too much work").encode(errors="replace")[:MESSAGE_BYTES].decode(errors="ignore")}]


def findings(data: Column, schema: dict, part: bool = False) -> Column:
    """array<struct<pointer, rule, message>>; the schema is compiled once, on the driver.

    A null, text that isn't JSON, and a value that would take too much work have one finding each, its rule refused.
    """
    own = compile_schema(json.dumps(schema))

    @F.pandas_udf("array<struct<pointer:string,rule:string,message:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: check(t, own, part))

    return run(data)


# --- merging -------------------------------------------------------------------------------------------------------


class _Settled:
    """The value that stands for several parts' values of one place, and where each part's citations go.

    moves has, for each part, the places whose citations go elsewhere: alone, or with all that is below.
    """

    def __init__(self, values: list[object]):
        self.moves: list[dict[str, tuple[int, str, bool]]] = [{} for _ in values]
        self.value = self.settle([(i, "", v) for i, v in enumerate(values)], "")

    def move(self, part: int, origin: str, to: str, deep: bool) -> None:
        self.moves[part][origin] = (len(self.moves[part]), to, deep)

    def settle(self, own: list[tuple[int, str, object]], to: str) -> object:
        own = [x for x in own if x[2] is not None]
        if not own:
            return None
        part, origin, first = own[0]
        self.move(part, origin, to, True)
        alike = [x for x in own[1:] if isinstance(x[2], type(first))] if isinstance(first, (dict, list)) else [x for x in own[1:] if same(x[2], first)]
        for part, at, _ in alike:
            self.move(part, at, to, False)
        if isinstance(first, dict):
            return self.members([own[0], *alike], to)
        return self.items(first, alike, to) if isinstance(first, list) else first

    def members(self, own: list[tuple[int, str, dict]], to: str) -> dict:
        out = {}
        for name in sorted({n for _, _, v in own for n in v}):
            step = "/" + token(name)
            out[name] = self.settle([(part, at + step, v[name]) for part, at, v in own if name in v], to + step)
        return out

    def items(self, first: list, others: list[tuple[int, str, list]], to: str) -> list:
        out, places = list(first), {}
        for i, x in enumerate(first):
            places.setdefault(canonical(x), i)
        for part, at, more in others:
            for i, x in enumerate(more):
                place = places.setdefault(canonical(x), len(out))
                out += [x] * (place == len(out))
                self.move(part, f"{at}/{i}", f"{to}/{place}", True)
        return out

    def moved(self, part: int, pointer: str) -> tuple[int, str] | None:
        """Where a part's citations of a place go, and which of its moves that is: the last that is above the place."""
        at, found = pointer, None
        while found is None:
            n, to, deep = self.moves[part].get(at, (0, "", False))
            if at in self.moves[part] and (deep or at == pointer):
                found = (n, to + pointer[len(at) :])
            elif not at:
                return None
            at = at.rpartition("/")[0]
        return found


def merged(parts: list[tuple[object, dict[str, list[str]]]]) -> tuple[object, dict[str, list[str]]]:
    """The parts (value, citations) of one document as one, in their order, and its citations.

    Objects are joined by member, lists as sets, and of other values the first that isn't null stands. A citation goes with
    its value; that of a value that doesn't stand is dropped. Nothing at all is an empty object.
    """
    own = _Settled([v for v, _ in parts])
    out: dict[str, list[str]] = {}
    for i, (_, citations) in enumerate(parts):
        found = [(*own.moved(i, p), refs) for p, refs in citations.items() if own.moved(i, p) is not None]
        for _, to, refs in sorted(found, key=lambda x: x[:2]):
            out[to] = list(dict.fromkeys([*out.get(to, []), *refs]))
    return {} if own.value is None else own.value, {to: refs for to, refs in out.items() if refs}


def read_part(data: str | None, citations: str | None) -> tuple[object, dict[str, list[str]]] | None:
    """A part's value and citations; None if its value can't be read. Citations that can't be are none."""
    try:
        value = decode(data or "")
    except Refused:
        return None
    try:
        given = json.loads(citations or "{}")
    except (ValueError, RecursionError):
        given = {}
    given = given if isinstance(given, dict) else {}
    return value, {p: [r for r in refs if isinstance(r, str)] for p, refs in given.items() if isinstance(refs, list)}


def as_json(v: object) -> str:
    """Halves of characters, which no text may hold, become U+FFFD."""
    return _HALF.sub("\ufffd", json.dumps(v, ensure_ascii=False, sort_keys=True))


_HALF = re.compile("[\ud800-\udfff]")


def cited(value: object, citations: dict[str, list[str]], refs: list[str]) -> dict[str, list[str]]:
    """Citations whose place is in the value and whose references are in the window."""
    known = set(refs)
    out = {p: [r for r in dict.fromkeys(own) if r in known] for p, own in citations.items() if resolve(value, p) is not _MISSING}
    return {p: own for p, own in out.items() if own}


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, data, citations (JSON, members sorted) and unread of the parts of each extraction (window, data, citations), in the
    order of windows.

    A part that is null or can't be read is passed over and counted in unread; with no other part data is {}. Repeated parts
    change nothing but unread. An extraction has at most 32 windows, so its parts are one small array; arrays go to Python in
    Arrow batches, which costs far less than a group at a time.
    """

    @F.pandas_udf("struct<data:string,citations:string,unread:int>")
    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for own in rows:
            read = [read_part(r["data"], r["citations"]) for r in own]
            value, citations = merged([x for x in read if x is not None])
            out.append((as_json(value), as_json(citations), read.count(None)))
        return pd.DataFrame(out, columns=["data", "citations", "unread"])

    grouped = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("window", "data", "citations"))).alias("__rows"))
    return grouped.select(*by, run("__rows").alias("m")).select(*by, "m.data", "m.citations", "m.unread")


def merge_flat(parts: DataFrame, by: list[str], members: dict[str, str]) -> DataFrame:
    """Scalar members alone: the first that isn't null, by window. Built-in expressions only."""
    schema = ", ".join(f"{n} {t}" for n, t in members.items())
    rows = parts.withColumn("__d", F.from_json("data", schema))
    return rows.groupBy(*by).agg(*[F.min_by(F.col(f"__d.{n}"), F.when(F.col(f"__d.{n}").isNotNull(), F.col("window"))).alias(n) for n in members])


def cited_refs(refs: Column, window: Column) -> Column:
    """References that a window holds, each once. Built-in expressions only."""
    return F.array_intersect(refs, window)


def next_step(max_repairs: int = 2) -> Column:
    """What follows a reply, of findings, repairs so far, window and windows; a document without a window is filled at once."""
    broken = F.col("findings") > 0
    return F.when(F.col("windows") == 0, "filled").when(broken & (F.col("repairs") >= max_repairs), "unsatisfied").when(broken, "repair").when(F.col("window") < F.col("windows"), "next").otherwise("filled")


def latest(fields: DataFrame, by: list[str]) -> DataFrame:
    """The newest answer of each field."""
    w = Window.partitionBy(*by).orderBy(F.desc("asks"), F.desc("finished"))
    return fields.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
