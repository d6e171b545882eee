"""Vectorised scans over Arrow string arrays: words, word hashes, shingle sets.

Everything works on the UTF-8 bytes of an Arrow buffer, so no Python string is
built for a document.  Texts are taken in runs of about ``RUN_BYTES`` so that
the working arrays stay small whatever the size of an Arrow batch is; one text
longer than that makes a run of its own, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        size = max(n, RUN_BYTES + 1)
        for name, base in (("p", _P), ("q", _P_INV)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            out[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(out)
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string array; a null text has no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    n = len(arr)
    null = np.zeros(n, bool) if arr.null_count == 0 else np.asarray(arr.is_null())
    _, off, data = arr.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), null
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if null.any():  # nulls may span bytes in a foreign buffer
        length = np.where(null, 0, np.diff(offsets))
        if not np.array_equal(length, np.diff(offsets)):
            return buffers(arr.fill_null(""))[:2] + (null,)
    return raw, offsets, null


def runs(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` bytes each."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of maximal runs of non-space bytes; words
    first[i]:first[i+1] belong to text i.  ``raw`` starts at offsets[0]."""
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    off = offsets - offsets[0]
    cut[off] = True
    solid = ~IS_SPACE[raw]
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, equal for equal bytes wherever they stand."""
    n = len(raw)
    p, q = _power(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))


def shingle_sets(arr: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text, in order: the sorted distinct 64-bit hashes of its shingles of
    ``width`` words (A-Z lower-cased).  Fewer words make one shingle of them all;
    a null text or one without words gives an empty set."""
    raw, offsets, _ = buffers(arr)
    c = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    for lo, hi in runs(offsets):
        part = LOWER[raw[offsets[lo] : offsets[hi]]]
        start, end, first = words(part, offsets[lo : hi + 1])
        h = word_hashes(part, start, end)
        m = len(h)
        full = h[: max(0, m - width + 1)].copy()
        for k in range(1, width):
            full *= c[0]
            full += h[k : k + len(full)]
        full = mix(full + c[1])
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                s = np.sort(full[a : b - width + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                one = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        one = one * c[1] + x
                yield mix(np.array([one], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
