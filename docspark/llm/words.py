"""Words of whole Arrow batches as 64-bit hashes, found with numpy over the batch's byte buffer.

A polynomial over random byte values, taken as differences of one running sum, gives each word's hash; no Python
object is made per word. Texts come as binary columns, so nothing is decoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of text that one step works on, unless a single text is longer.
STEP_BYTES = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(int(base), done, 1 << 64))
        done += more
    return out


class _Powers:
    up = _powers(_BASE, 1 << 16)
    down = _powers(_INVERSE, 1 << 16)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Alphabet:
    """Which bytes part words, and whether A-Z count as a-z."""

    def __init__(self, separators: bytes, lower: bool):
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        folded = np.arange(256)
        if lower:
            folded[65:91] += 32
        self.values = _VALUES[folded]


#: Words are runs of anything but a blank and \t \n \v \f \r.
SPACED = Alphabet(b" \t\n\x0b\x0c\r", lower=False)
SPACED_LOWER = Alphabet(b" \t\n\x0b\x0c\r", lower=True)
#: Words are runs of 0-9, a-z and bytes from 0x80, after A-Z became a-z.
ALNUM_LOWER = Alphabet(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)), lower=True)


@dataclass
class Words:
    """hashes: one per word. first: for each text the index of its first word, and the end of the last."""

    hashes: np.ndarray
    first: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words_of(data: np.ndarray, bounds: np.ndarray, alphabet: Alphabet, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Words:
    """data: the texts' bytes, end to end. bounds: n + 1 offsets into it.

    part(data, starts, ends) may name places inside words where they are cut in two.
    """
    n = len(data)
    inside = ~alphabet.separator[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if part is not None:
        cuts = part(data, starts, ends)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    _Powers.need(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(alphabet.values[data] * _Powers.up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _Powers.down[starts])
    return Words(hashes, np.searchsorted(starts, bounds), data, starts, ends, bounds)


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a binary column without nulls into (from row, to row, bytes, bounds) of about limit bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    if not wide and not pa.types.is_binary(column.type):
        raise TypeError(f"a binary column is needed, not {column.type}")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def not_null(column: pa.Array) -> pa.Array:
    """Nulls become empty."""
    import pyarrow.compute as pc

    return pc.fill_null(column, b"") if column.null_count else column


def windows(words: Words, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and for each text the index of its first run.

    A text with fewer words, but not none, has one run: all its words.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    factors = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    counts = np.diff(words.first)
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(runs, out=first[1:])
    n = len(words.hashes)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        if n > j:
            out[: n - j] += words.hashes[j:] * factors[j]
    out = mix(out)
    # The runs that begin at a text's words first .. first + runs.
    at = np.repeat(words.first[:-1] - first[:-1], runs) + np.arange(first[-1])
    out = out[at]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words.hashes[words.first[i] : words.first[i + 1]]
        out[first[i]] = mix(np.array([(own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]
    return out, first
