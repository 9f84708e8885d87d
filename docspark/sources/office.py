"""Values of office formats: cell references, number formats, serial dates, shortest numbers, fonts; and counts of pages."""

from __future__ import annotations

import re
import struct
import zlib
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The size of a sheet; the last day a serial number names; formats by their built-in number.
SHEET_COLUMNS, SHEET_ROWS, LAST_DAY = 16_384, 1_048_576, 2_958_465
BUILTIN = {
    9: "percent", 10: "percent",
    14: "date", 15: "date", 16: "date", 17: "date",
    18: "clock", 19: "clock,seconds", 20: "clock", 21: "clock,seconds", 22: "date,clock",
    27: "date", 28: "date", 29: "date", 30: "date", 31: "date",
    32: "clock", 33: "clock,seconds", 34: "clock", 35: "clock,seconds", 36: "date",
    45: "clock,seconds", 46: "clock,seconds,elapsed", 47: "clock,seconds",
    50: "date", 51: "date", 52: "date", 53: "date", 54: "date", 55: "date", 56: "date", 57: "date", 58: "date",
}
FLAGS = ("date", "clock", "seconds", "elapsed", "percent")


def cell_reference(ref: Column) -> Column:
    """struct(row, col) from 0 of B7 or $B$7; null for anything else or a place off the sheet. Built-in expressions."""
    bare = F.upper(F.replace(ref, F.lit("$"), F.lit("")))
    letters = F.split(F.regexp_extract(bare, "^([A-Z]{1,3})[0-9]{1,7}$", 1), "")
    col = F.aggregate(letters, F.lit(0), lambda held, c: held * 26 + F.when(c == "", 0).otherwise(F.ascii(c) - 64))
    row = F.regexp_extract(bare, "^[A-Z]{1,3}([0-9]{1,7})$", 1)
    number = F.when(row != "", row.cast("int"))
    ok = bare.rlike("^[A-Z]{1,3}[0-9]{1,7}$") & number.between(1, SHEET_ROWS) & col.between(1, SHEET_COLUMNS)
    return F.when(ok, F.struct((number - 1).alias("row"), (col - 1).alias("col")))


def place(ref: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})", ref)
    if not m:
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    row = int(m[2])
    return (row - 1, col - 1) if 1 <= row <= SHEET_ROWS and col <= SHEET_COLUMNS else None


def area(ref: str) -> tuple[int, int, int, int] | None:
    """(row, col, last row, last col) of A1 or A1:B2, corners in either order."""
    a, _, z = ref.partition(":")
    first, last = place(a), place(z or a)
    if first is None or last is None:
        return None
    return min(first[0], last[0]), min(first[1], last[1]), max(first[0], last[0]), max(first[1], last[1])


_CODE = re.compile(r'"[^"]*(?:"|$)|[\\_*].?|\[(?P<box>[^\]]*)(?:\]|$)|(?P<half>[aA][mM]/[pP][mM]|[aA]/[pP])|(?P<end>;)|(?P<percent>%)|(?P<letter>[yYdDhHsSmM])|.', re.DOTALL)


def number_format(code: str) -> frozenset[str]:
    """What a format code's first section shows: date, clock, seconds, elapsed, percent.

    Quoted and escaped text and colours show nothing. An m is minutes behind hours or before seconds, else months.
    """
    out: set[str] = set()
    letters: list[str] = []
    for m in _CODE.finditer(code):
        if m["end"]:
            break
        if m["percent"]:
            out.add("percent")
        elif m["half"]:
            out.add("clock")
        elif m["box"] is not None and m["box"].lower() in ("h", "hh", "m", "mm", "s", "ss"):
            out.add("elapsed")
            letters.append({"h": "h", "m": "minutes", "s": "s"}[m["box"][0].lower()])
        elif m["letter"]:
            letters.append(m["letter"].lower())
    runs = [c for i, c in enumerate(letters) if not i or letters[i - 1] != c]
    for i, c in enumerate(runs):
        if c in "yd":
            out.add("date")
        elif c == "m" and "h" not in runs[i - 1 : i] and "s" not in runs[i + 1 : i + 2]:
            out.add("date")
        else:
            out.add("clock")
            if c == "s":
                out.add("seconds")
    return frozenset(out)


def format_flags(code: Column) -> Column:
    @F.pandas_udf("string")
    def run(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: ",".join(f for f in FLAGS if f in number_format(c or "")))

    return run(code)


def moment(value: Column, date: bool, clock: bool, seconds: bool = False, elapsed: bool = False, date1904: bool = False) -> Column:
    """A serial number as ISO text, to the second; 1900 has its phantom 29th of February. Built-in expressions."""
    whole, part = F.floor(value), F.round((value - F.floor(value)) * 86400).cast("long")
    days = (whole + F.when(part >= 86400, 1).otherwise(0)).cast("int")
    secs = F.when(part >= 86400, 0).otherwise(part)
    hours = F.floor(secs / 3600) + (days * 24 if elapsed else F.lit(0))

    def two(c: Column) -> Column:
        # lpad would cut hours of three digits.
        return F.when(c < 10, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))

    time = F.concat(two(hours), F.lit(":"), two(F.floor(secs / 60) % 60), *([F.lit(":"), two(secs % 60)] if seconds else []))
    if not date or elapsed:
        return time if clock else F.lit("")

    def on(base: str) -> Column:
        return F.date_format(F.date_add(F.lit(base).cast("date"), days), "yyyy-MM-dd")

    day = on("1904-01-01") if date1904 else F.when(days == 60, "1900-02-29").when(days < 60, on("1899-12-31")).otherwise(on("1899-12-30"))
    return F.concat(day, F.lit("T"), time) if clock else day


def plain_number(v: float) -> str:
    """The shortest digits that mean v, without an exponent from 1e-7 up to 1e21."""
    if v == 0 or 1e-7 <= abs(v) < 1e21:
        text = format(Decimal(repr(v)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    digits, _, exponent = format(Decimal(repr(v)), "e").partition("e")
    digits = digits.rstrip("0").rstrip(".") if "." in digits else digits
    return f"{digits}e{exponent[0]}{int(exponent[1:]):02d}"


def shown_number(raw: str, flags: frozenset[str], date1904: bool = False) -> str:
    """A cell's value as its format shows it; text that is no number stays."""
    try:
        v = float(raw.strip())
    except ValueError:
        return raw
    if v != v or v in (float("inf"), float("-inf")):
        return raw
    if flags & {"date", "clock"} and 0 <= v < LAST_DAY + 1:
        return serial_text(v, flags, date1904)
    if "percent" in flags:
        return plain_number(float(f"{v * 100:.15g}")) + "%"
    return plain_number(v)


def serial_text(v: float, flags: frozenset[str], date1904: bool = False) -> str:
    from datetime import date, timedelta

    seconds = int((v % 1) * 86400 + 0.5)
    days = int(v // 1) + seconds // 86400
    seconds %= 86400
    hours = seconds // 3600 + (days * 24 if "elapsed" in flags else 0)
    time = f"{hours:02d}:{seconds // 60 % 60:02d}" + (f":{seconds % 60:02d}" if "seconds" in flags else "")
    if "date" not in flags or "elapsed" in flags:
        return time if "clock" in flags else ""
    if date1904:
        day = str(date(1904, 1, 1) + timedelta(days))
    else:
        day = "1900-02-29" if days == 60 else str(date(1899, 12, 31 if days < 60 else 30) + timedelta(days))
    return f"{day}T{time}" if "clock" in flags else day


def shown_numbers(raw: Column, flags: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([shown_number(v, frozenset(filter(None, k.split(",")))) for v, k in zip(values, kinds, strict=True)])

    return run(raw, flags)


def font_style(name: Column, flags: Column) -> Column:
    """struct(bold, italic) of a font by its name and its descriptor's flags. Built-in expressions."""
    own = F.lower(F.regexp_replace(name, r"^[^+]*\+", ""))
    face = F.when(own.startswith("cm"), F.substring(own, 3, 1000)).otherwise("")
    slant = F.regexp_replace(face, "^bx", "")
    bold = own.rlike("bold|black|heavy") | face.startswith("b") | (flags.bitwiseAND(1 << 18) != 0)
    italic = own.rlike("italic|oblique") | slant.startswith("ti") | slant.startswith("sl") | (flags.bitwiseAND(1 << 6) != 0)
    return F.struct(bold.alias("bold"), italic.alias("italic"))


# --- counts of pages, and signed containers --------------------------------------------------------------------------

#: Object streams looked into, bytes they may inflate to, bytes around a node that are looked at, frames, nested containers.
MAX_STREAMS, MAX_INFLATED, AROUND, MAX_FRAMES, MAX_NESTED = 4096, 64 << 20, 512, 100_000, 3
_TREE, _LEAF, _COUNT = re.compile(rb"/Type\s*/Pages\b"), re.compile(rb"/Type\s*/Page(?![A-Za-z])"), re.compile(rb"/Count\s+(\d+)")
SIGNED_DATA = bytes.fromhex("2A864886F70D010702")


def pdf_pages(data: bytes) -> int:
    """The greatest count a page tree's node states, in the file or its compressed objects; else the pages counted; 0 for none."""
    parts, left = [data], MAX_INFLATED
    for n, m in enumerate(re.finditer(rb"/Type\s*/ObjStm\b", data)):
        begin = data.find(b"stream", m.end())
        if n >= MAX_STREAMS or begin < 0 or left <= 0:
            break
        begin += 6 + (2 if data[begin + 6 : begin + 8] == b"\r\n" else 1)
        try:
            parts.append(zlib.decompressobj().decompress(data[begin:], left))
            left -= len(parts[-1])
        except zlib.error:
            continue
    most = 0
    for part in parts:
        for m in _TREE.finditer(part):
            lo, hi = part.rfind(b"<<", max(0, m.start() - AROUND), m.start()), part.find(b">>", m.end(), m.end() + AROUND)
            node = part[max(lo, 0, m.start() - AROUND) : hi if hi >= 0 else m.end() + AROUND]
            most = max([most, *(int(c[1]) for c in _COUNT.finditer(node))])
    return most or sum(len(_LEAF.findall(p)) for p in parts)


def tiff_frames(data: bytes) -> int:
    """Frames of a TIFF: the directories in its chain. -1 for a chain that is broken or goes round, -2 for too many."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        return -1
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            return -1
        seen.add(at)
        if len(seen) > MAX_FRAMES:
            return -2
        end = at + 2 + 12 * struct.unpack(order + "H", data[at : at + 2])[0]
        if end + 4 > len(data):
            return -1
        at = struct.unpack(order + "I", data[end : end + 4])[0]
    return len(seen) or -1


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, body) of a run of DER elements; None if it isn't one."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 0 < n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n])
            at += n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def _payload(der: bytes) -> bytes | None:
    """The content of one SignedData: ContentInfo > [0] > SignedData > encapContentInfo > [0] > octets."""
    info = _elements(der)
    if not info or info[0][0] != 0x30:
        return None
    info = _elements(info[0][1]) or []
    if len(info) < 2 or info[0] != (0x06, SIGNED_DATA):
        return None
    signed = _elements(info[1][1]) or []
    inner = next((_elements(body) or [] for tag, body in (_elements(signed[0][1]) or [] if signed else []) if tag == 0x30), [])
    content = _elements(inner[1][1]) or [] if len(inner) > 1 else []
    if not content:
        return None
    tag, body = content[0]
    if tag & 0x20:
        return b"".join(b for _, b in _elements(body) or [])
    return body if tag == 0x04 else None


def unwrapped(data: bytes) -> bytes | None:
    """What signed containers hold, up to MAX_NESTED deep, DER or PEM; None if the outermost is none."""
    import base64

    out = None
    for _ in range(MAX_NESTED):
        armor = re.search(rb"-----BEGIN (?:PKCS7|CMS)-----(.*?)-----END", data, re.DOTALL)
        inner = _payload(base64.b64decode(armor[1]) if armor else data)
        if inner is None:
            break
        out = data = inner
    return out


def page_counts(content: Column, mime: Column) -> Column:
    """Pages of PDF and TIFF files (-1 corrupt, -2 too many); null for other types. content is binary, from binaryFile."""

    @F.pandas_udf("int")
    def run(files: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([pdf_pages(f) if k == "application/pdf" else tiff_frames(f) if k == "image/tiff" else None for f, k in zip(files, kinds, strict=True)], dtype="Int32")

    return run(content, mime)


def payloads(content: Column) -> Column:
    @F.pandas_udf("binary")
    def run(files: pd.Series) -> pd.Series:
        return files.map(unwrapped)

    return run(content)
