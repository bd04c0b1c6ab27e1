"""Numpy kernels over Arrow string batches: code points, casefolding, words, rolling hashes.

Everything here is a pure function of its arguments and runs inside Arrow-batched Python workers. Whole texts are
processed; batches are cut into slabs by size only to bound memory, never to drop or shorten a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Code points per slab; one longer text forms a slab of its own.
SLAB = 2_000_000
_U = np.uint64


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """1 where a code point is a Unicode letter or digit."""
    table = np.zeros(0x110000, dtype=bool)
    table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalnum()]] = True
    return table


@lru_cache(maxsize=1)
def japanese_table() -> np.ndarray:
    """1 for kana and Han."""
    table = np.zeros(0x110000, dtype=bool)
    for first, last in ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D)):
        table[first : last + 1] = True
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread integers over 64 bits (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = x.astype(_U) + _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


@lru_cache(maxsize=1)
def mixed_table() -> np.ndarray:
    """:func:`mix64` of every code point."""
    return mix64(np.arange(0x110000, dtype=_U))


def slabs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Index ranges of at most SLAB code points each (single texts may exceed it)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLAB:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def to_codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the offsets of each text (len + 1)."""
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=offsets[1:])
    return cps, offsets


_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    size = 1 << max(10, int(n).bit_length())
    return _powers(size, base)[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for every span, by prefix sums: equal spans give equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, dtype=_U)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, dtype=_U)
        np.cumsum(values * powers(len(values)), out=prefix[1:])
        inverse = pow(_BASE, -1, 1 << 64)
        raw = (prefix[ends] - prefix[starts]) * powers(len(values) + 1, inverse)[starts]
        return mix64(raw ^ (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_spans(cps: np.ndarray, offsets: np.ndarray, ok: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the longest runs of letters and digits, none crossing a text's border."""
    if ok is None:
        ok = alnum_table()[cps]
    begin = ok.copy()
    begin[1:] &= ~ok[:-1]
    borders = offsets[1:-1]
    borders = borders[borders < len(cps)]
    begin[borders] = ok[borders]
    finish = ok.copy()
    finish[:-1] &= ~ok[1:]
    last = borders[borders > 0] - 1
    finish[last] = ok[last]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


@dataclass(frozen=True)
class Cut:
    """Casefolded texts cut into comparison units: words, or single letters and digits in Japanese texts.

    A text counts as Japanese if half of its letters and digits are kana or Han. ``values`` holds the units of all texts in
    order as 64-bit hashes, ``offsets`` where each text's begin (len + 1); ``letters`` and ``letter_offsets`` likewise the
    code points of all letters and digits.
    """

    values: np.ndarray
    offsets: np.ndarray
    japanese: np.ndarray
    letters: np.ndarray
    letter_offsets: np.ndarray


def cut(texts: list[str]) -> Cut:
    cps, at = to_codepoints([t.casefold() for t in texts])
    n = len(texts)
    if not len(cps):
        none = np.zeros(n + 1, dtype=np.int64)
        return Cut(np.zeros(0, dtype=_U), none, np.zeros(n, dtype=bool), np.zeros(0, dtype=np.uint32), none)
    ok = alnum_table()[cps]
    where = np.flatnonzero(ok)
    letters, letter_at = cps[where], np.searchsorted(where, at)
    kana = np.concatenate(([0], np.cumsum(japanese_table()[letters])))
    count = np.diff(letter_at)
    japanese = (count > 0) & (np.diff(kana[letter_at]) * 2 >= count)
    mixed = mixed_table()[cps]
    starts, ends, owner = word_spans(cps, at, ok)
    by_word = ~japanese[owner]
    single = np.repeat(japanese, count)
    words = span_hashes(mixed, starts[by_word], ends[by_word])
    many = np.where(japanese, count, np.bincount(owner, minlength=n))
    offsets = np.concatenate(([0], np.cumsum(many)))
    of_letters = np.repeat(japanese, many)
    values = np.empty(offsets[-1], dtype=_U)
    values[~of_letters] = words
    values[of_letters] = mixed_table()[letters[single]]
    return Cut(values, offsets, japanese, letters, letter_at)


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of the texts, their offsets, and which texts are Japanese: see :class:`Cut`."""
    c = cut(texts)
    return c.values, c.offsets, c.japanese


def grouped_order(owner: np.ndarray, first: np.ndarray, then: np.ndarray, bits: int) -> np.ndarray:
    """Order by owner (ascending already), ``first`` (below 2**bits) and ``then`` (64 bits).

    All three are packed into one key as far as they go; the few equal keys whose rest could tell them apart are sorted out.
    """
    if not len(owner):
        return np.zeros(0, dtype=np.int64)
    spare = 64 - bits - int(owner[-1]).bit_length()
    if spare < 24:
        return np.lexsort((then, first, owner))
    key = (owner.astype(_U) << _U(64 - int(owner[-1]).bit_length()) if owner[-1] else np.zeros(len(owner), dtype=_U)) | (first.astype(_U) << _U(spare)) | (then >> _U(64 - spare))
    order = np.argsort(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if len(same) and (then[order[same]] != then[order[same + 1]]).any():
        return np.lexsort((then, first, owner))
    return order


def windows(values: np.ndarray, offsets: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` units inside each text: hashes, owner, start unit. ``size`` may differ by text."""
    n = np.diff(offsets)
    size = np.broadcast_to(np.asarray(size, dtype=np.int64), n.shape)
    many = np.where(n > 0, np.maximum(0, n - size + 1), 0)
    owner = np.repeat(np.arange(len(n)), many)
    if not len(owner):
        return np.zeros(0, dtype=_U), owner, owner
    first = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + offsets[:-1][owner]
    return span_hashes(mix64(values), first, first + size[owner]), owner, first


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over Python integers."""
    low = 0
    limit = min(len(a), len(b))
    while low < limit and a[low] == b[low]:
        low += 1
    high = 0
    while high < limit - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not len(a) or not len(b):
        return low + high
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for x in b.tolist():
        hit = free & at.get(x, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & full
    return low + high + len(a) - free.bit_count()


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]
