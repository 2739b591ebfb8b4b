"""Words of many texts at once, as byte positions and 64-bit hashes.

Both word rules in use break at ASCII bytes only, so UTF-8 bytes can be split without decoding. A word's hash
is a polynomial over its bytes modulo 2^64, a window's hash one over its words' hashes; both come from prefix
sums, so a window of any length costs the same. Equal content gives equal hashes in every task and run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = (1 << 64) - 1
_M, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_MI, _QI = pow(_M, -1, 1 << 64), pow(_Q, -1, 1 << 64)
_CHUNK = 1 << 16  # bytes; each worker process keeps two tables of that many powers
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES_LOWER = _BYTES[_LOWER]

#: True at bytes that no word holds.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
PUNCTUATION = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
PUNCTUATION[:128] = True
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    PUNCTUATION[_low:_high] = False

_tables: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo 2^64 (a view of a table that grows)."""
    table = _tables.get(base)
    if table is None or len(table) < count:
        size = max(1024, 1 << (count - 1).bit_length())
        table = np.ones(size, U)
        done = 1
        while done < size:
            table[done:2 * done] = table[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        _tables[base] = table
    return table[:count]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@dataclass
class Words:
    """Words of a run of texts: byte ranges in `data`, hashes, and `first[i]` .. `first[i+1]` as the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def text(self, word: int, lower: bool = False) -> bytes:
        found = self.data[self.starts[word]:self.ends[word]]
        return (_LOWER[found] if lower else found).tobytes()

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of `length` consecutive words of one text."""
        count = len(self.hashes)
        if count < length:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.arange(count - length + 1)
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = at[at + length <= last[:len(at)]]
        return at, self.ranges(at, at + length)

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the word ranges a .. b-1; the length takes part."""
        if not hasattr(self, "_sums"):
            self._sums = np.zeros(len(self.hashes) + 1, U)
            np.cumsum(self.hashes * powers(_Q, len(self.hashes)), out=self._sums[1:])
        total = (self._sums[b] - self._sums[a]) * powers(_QI, len(self.hashes) + 1)[a]
        return mix(total + (b - a).astype(U) * U(0x8CB92BA72F3D8DD7))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def hash_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of disjoint, ascending byte ranges, a bounded stretch of bytes at a time."""
    table = _BYTES_LOWER if lower else _BYTES
    out = np.empty(len(starts), U)
    done = 0
    while done < len(starts):
        origin = starts[done]
        stop = int(np.searchsorted(ends, origin + _CHUNK, "right"))
        if stop <= done:  # one range longer than a stretch
            total = 0
            for off in range(0, int(ends[done] - origin), _CHUNK):
                part = table[data[origin + off:min(origin + off + _CHUNK, ends[done])]]
                total += int((part * powers(_M, len(part))).sum(dtype=U)) * pow(_M, off, 1 << 64)
            out[done] = total & _MASK
            done += 1
            continue
        width = int(ends[stop - 1] - origin)
        sums = np.zeros(width + 1, U)
        np.cumsum(table[data[origin:origin + width]] * powers(_M, width), out=sums[1:])
        a, b = starts[done:stop] - origin, ends[done:stop] - origin
        out[done:stop] = (sums[b] - sums[a]) * powers(_MI, width + 1)[a]
        done = stop
    return mix(out + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def split(texts: pa.Array, breaks: np.ndarray, lower: bool = False) -> Words:
    """All words of `texts`: maximal runs of bytes outside `breaks`, never across two texts."""
    data, offsets = buffers(texts)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~breaks[data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    opens[edge] = inside[1:-1][edge]
    closes[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, starts, ends, hash_bytes(data, starts, ends, lower), np.searchsorted(starts, offsets), offsets)
