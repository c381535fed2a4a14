"""Hashes of words, word windows and byte windows of many texts at once, in numpy.

A string's hash is a polynomial over the 64-bit integers; prefix sums and the base's
inverse powers give every window's hash in a few passes. Bytes and words enter as random
64-bit numbers and results are mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from chartloom.llm.common import HELD

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text whose words are hashed at once.
CHUNK = 1_000_000


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit numbers over all 64 bits (a bijection)."""
    x = x + U((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % (1 << 64))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        x = np.full(n, U(base))
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


HELD["powers"] = _powers.cache_clear


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    size = 1 << max(12, (n - 1).bit_length())
    a, b = _powers(size)
    return a[:n], b[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``between`` takes the hash of any stretch of ``values``."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of the stretches [start, end)."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start], salt)


@lru_cache(maxsize=8)
def byte_numbers(salt: int, lower: bool) -> np.ndarray:
    """A random number for each byte; with ``lower`` A-Z have those of a-z."""
    table = mix(np.arange(256, dtype=U), salt)
    if lower:
        table[65:91] = table[97:123]
    return table


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 9, 10, 11, 12, 13]] = True
    return table


class Texts:
    """Some texts laid end to end: ``raw`` bytes, ``ends`` of texts in them."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) if texts else np.zeros(0, np.int64)

    def words(self, salt: int = 1, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of words before the end of each text), as words part texts.

        Some texts at a time, so that the byte-wide arrays stay small.
        """
        hashes, counts = [np.zeros(0, U)], []
        at, begin = 0, 0
        while at < len(self.ends):
            to = max(at + 1, int(np.searchsorted(self.ends, begin + CHUNK, side="right")))
            part, ends = self.raw[begin : self.ends[to - 1]], self.ends[at:to] - begin
            some, before = _words(part, ends, salt, lower)
            counts.append(np.diff(before, prepend=0))
            hashes.append(some)
            at, begin = to, int(self.ends[to - 1])
        return np.concatenate(hashes), np.cumsum(np.concatenate(counts)) if counts else np.zeros(0, np.int64)


def _words(raw: np.ndarray, ends: np.ndarray, salt: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(len(ends), np.int64)
    said = ~_space()[raw]
    first = np.zeros(n + 1, bool)  # where a text starts
    first[0] = True
    first[ends] = True
    starts = said.copy()
    starts[1:] &= ~said[:-1] | first[1:n]
    last = said.copy()
    last[:-1] &= ~said[1:] | first[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(last) + 1
    sums = prefix(byte_numbers(salt, lower)[raw])
    hashes = between(sums, start, end, salt) + mix((end - start).astype(U), salt)
    return mix(hashes, salt), np.searchsorted(start, ends)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least one (the first of equals)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    at, size = np.arange(len(values), dtype=np.int32), 1
    while size * 2 <= width:
        a, b = at[:-size], at[size:]
        at = np.where(values[b] < values[a], b, a)
        size *= 2
    if size < width:
        a, b = at[:n], at[width - size : width - size + n]
        at = np.where(values[b] < values[a], b, a)
    return at[:n]


def inside(n_before: np.ndarray, total: int, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` items that lie in one text each."""
    if total < width:
        return np.zeros(0, np.int64)
    ok = np.ones(total - width + 1, bool)
    for end in np.unique(n_before[:-1]).tolist():
        ok[max(0, end - width + 1) : end] = False
    return np.flatnonzero(ok)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows (values of the first column..., the last one as bytes) until a block holds ``size`` bytes of text.

    The last column is the text; null counts as empty.
    """
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        keys = [c.to_pylist() for c in batch.columns[:-1]]
        text = batch.columns[-1].cast(pa.large_binary())
        for i in range(batch.num_rows):
            raw = text[i].as_py() or b""
            rows.append((*[k[i] for k in keys], raw))
            held += len(raw)
            if held >= size:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def sorted_rows(rows: list[tuple]) -> tuple[np.ndarray, list[bytes]]:
    """(ids, texts) of a block in the order of ids; rows equal in both count once."""
    distinct = sorted({(i, raw) for i, raw in rows}) if len({r[0] for r in rows}) < len(rows) else sorted(rows)
    return np.array([r[0] for r in distinct], np.int64), [r[1] for r in distinct]


def pack(parts: list[tuple[str, np.ndarray]]) -> bytes:
    """Arrays one after the other, each after its size in bytes and its type."""
    out = []
    for kind, a in parts:
        raw = a.astype(kind).tobytes()
        out += [len(raw).to_bytes(8, "little"), kind.encode().ljust(4), raw]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        n, kind = int.from_bytes(blob[at : at + 8], "little"), np.dtype(blob[at + 8 : at + 12].decode().strip())
        out.append(np.frombuffer(blob, kind, n // kind.itemsize, at + 12))
        at += 12 + n
    return out


def split48(x: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """48 bits of numbers as two arrays to ``pack``."""
    return [("<u4", x & U(0xFFFFFFFF)), ("<u2", (x >> U(32)) & U(0xFFFF))]


def join48(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U) | high.astype(U) << U(32)


def fitting(x: np.ndarray) -> str:
    """The smaller type that holds all of ``x``."""
    return "<u2" if not len(x) or int(x.max()) < 1 << 16 else "<u4"
