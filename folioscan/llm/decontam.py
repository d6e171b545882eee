"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm import textscan
from folioscan.llm.common import broadcast_if_small, written
from folioscan.session import ship

#: Errors allowed for a byte of an item; test items are matched in blocks of BLOCK_BYTES.
ERROR_RATE, BLOCK_BYTES, BROADCAST_ROWS = 0.06, 16 << 20, 1_000_000
_PLAIN = np.full(256, 0x20, np.uint8)
for _r in ((48, 58), (97, 123), (128, 256)):
    _PLAIN[_r[0] : _r[1]] = np.arange(*_r)
_PLAIN[65:91] = np.arange(97, 123)


def normalised(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): lower-cased texts in which every run of ASCII other than
    letters and digits, of Latin-1 signs and of general punctuation is one space;
    each text begins and ends with a space.  A null text is an empty one."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.utf8_lower(arr.cast(pa.large_string()).fill_null(""))
    none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    framed = pc.binary_join_element_wise(none, arr, none, space)
    raw, offsets, _ = textscan.buffers(framed)
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    b = _PLAIN[raw]
    if len(b) > 2:
        two = np.flatnonzero((raw[:-1] == 0xC2) & (raw[1:] >= 0xA0))
        three = np.flatnonzero((raw[:-2] == 0xE2) & ((raw[1:-1] == 0x80) | (raw[1:-1] == 0x81)))
        for at, width in ((two, 2), (three, 3)):
            for j in range(width):
                b[at + j] = 0x20
    space = b == 0x20
    keep = np.ones(len(b), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(b)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return b[keep], total[offsets]


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the whole pattern to any substring of text, and the
    end of the first such substring, by Myers' bit-parallel columns."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Pieces:
    """Pieces of test items (key, normalised text, errors allowed) by the hash of their first bytes."""

    def __init__(self, items: list[tuple[int, bytes, int]]):
        self.items = items
        pieces = []
        for i, (_, text, k) in enumerate(self.items):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            pieces += [(i, a, z - a) for a, z in zip(cuts[:-1], cuts[1:])]
        self.q = min([p[2] for p in pieces], default=1)
        heads = pa.array([self.items[i][1][a : a + self.q] for i, a, _ in pieces], pa.binary())
        h = self._grams(np.frombuffer(b"".join(heads.to_pylist()), np.uint8))[:: self.q] if pieces else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.piece = h[order], np.array(pieces, np.int64).reshape(-1, 3)[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def _grams(self, raw: np.ndarray) -> np.ndarray:
        """Hash of each run of q bytes."""
        n = len(raw) - self.q + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, x = np.zeros(n, np.uint64), raw.astype(np.uint64)
        for j in range(self.q):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += x[j : j + n]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9)

    def matches(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, errors allowed) of every pair within the budget, for
        normalised texts raw[off[i]:off[i + 1]]."""
        if not self.items:
            return
        h = self._grams(raw)
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        first, last = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        found: dict[tuple[int, int], list[int]] = {}
        hit = np.flatnonzero(last > first)
        doc = np.searchsorted(off, at[hit], "right") - 1
        for d, p, a, z in zip(doc.tolist(), at[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
            for i, shift, size in self.piece[a:z].tolist():
                text = self.items[i][1]
                if p + size <= off[d + 1] and raw[p : p + size].tobytes() == text[shift : shift + size]:
                    found.setdefault((d, i), []).append(p - shift)
        for (d, i), starts in sorted(found.items()):
            if (best := self._verify(raw, int(off[d]), int(off[d + 1]), i, starts)) is not None:
                yield d, self.items[i][0], best, self.items[i][2]

    def _verify(self, raw: np.ndarray, lo: int, hi: int, i: int, starts: list[int]) -> int | None:
        _, text, k = self.items[i]
        m = len(text)
        for s in sorted(set(starts)):
            if s >= lo and raw[s : s + m].tobytes() == text:
                return 0
        if not k:
            return None
        spans: list[list[int]] = []  # windows that overlap are read once
        for s in sorted(set(starts)):
            a, z = max(lo, s - k), min(hi, s + m + k)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], z)
            else:
                spans.append([a, z])
        best = min(myers(text, raw[a:z].tobytes())[0] for a, z in spans)
        return best if best <= k else None


class Matcher:
    """Test items within floor(rate * bytes) edits of their normalised bytes; those so short that this
    is none, exactly and between word borders."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        b, off = normalised(pa.array([t for _, t in items], pa.large_string()))
        texts = [(key, b[s:e].tobytes().strip()) for (key, _), s, e in zip(items, off[:-1], off[1:])]
        budget = lambda t: int(rate * len(t))
        self.parts = []
        for lo, hi in ((1, 5), (5, 24), (24, 1 << 62)):  # the shortest piece sets how many bytes are hashed
            some = [(k, t) for k, t in texts if lo <= len(t) < hi]
            self.parts.append(Pieces([(k, b" " + t + b" ", 0) for k, t in some if not budget(t)]))
            self.parts.append(Pieces([(k, t, budget(t)) for k, t in some if budget(t)]))

    def matches(self, arr: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, errors allowed) of every pair within the budget."""
        if not len(arr):
            return
        _, offsets, _ = textscan.buffers(arr)
        for lo, hi in textscan.runs(offsets):
            raw, off = normalised(arr.slice(lo, hi - lo))
            for part in self.parts:
                for d, *rest in part.matches(raw, off):
                    yield lo + d, *rest


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of about block_bytes, one at a time in the driver."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        yield sorted((r.i, r.t) for r in (rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows).distinct().collect())


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, max_errors) of every document that holds a test
    item within floor(rate * bytes) edits of its normalised text.

    Such a passage keeps one of budget + 1 pieces of the item whole, so exact hits
    of pieces find all of them, and Myers' distance around the hits decides.  Whole
    texts are scanned where they are read; no row is shuffled.  Test items beyond
    BLOCK_BYTES go in blocks, each with a scan of its own.

    Items of so few normalised bytes that the budget is none (under 17) are found exactly, between word
    borders; null texts and items, and items without a letter or digit, match nothing; a repeated document has its rows each time; an
    item_id with several texts may give several rows; very long texts are scanned whole; other columns are
    ignored; an empty table of either gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema, out = "doc_id long, item_id long, distance int, max_errors int", None
    blocks = item_blocks(benchmark)
    block = next(blocks, [])
    while True:
        after = next(blocks, None)
        matcher = Matcher(block, rate)

        def run(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(zip(*matcher.matches(b.column(1)))) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(got[0], pa.int64())), pa.array(got[1], pa.int64()), pa.array(got[2], pa.int32()), pa.array(got[3], pa.int32())], ["doc_id", "item_id", "distance", "max_errors"])

        part = written(rows.mapInArrow(run, schema), "leaks")
        out = part if out is None else out.union(part)
        if after is None:
            return out
        block = after


def detector(items: list[tuple[int, str]], rate: float = ERROR_RATE) -> Callable[[Column], Column]:
    """A column function text -> whether the text holds one of the items."""
    matcher = Matcher(items, rate)

    @F.arrow_udf("boolean")
    def holds(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        out[[m[0] for m in matcher.matches(text)]] = True
        return pa.array(out)

    return holds


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, whose text holds no test item.

    One block of test items filters in place.  With more, each block writes the two
    hashes of the texts it finds, one block in memory at a time, and rows with these
    hashes go at the end.  Null and empty texts stay; repeated rows stay or go together;
    with no items, or an empty table, docs comes back as it is; other columns, of
    whatever name, are not looked at."""
    ship(docs.sparkSession)
    text = docs[text_col]
    hashes = [F.xxhash64(text).alias("__a"), F.xxhash64(text, F.lit(1)).alias("__b")]
    blocks, found = item_blocks(benchmark), None
    block = next(blocks, [])
    while (after := next(blocks, None)) is not None or found is not None:
        part = written(docs.where(detector(block, rate)(text)).select(*hashes).distinct(), "leaks")
        found = part if found is None else found.union(part)
        if after is None:
            found = found.distinct()
            return docs.join(broadcast_if_small(found, found.count(), BROADCAST_ROWS), (hashes[0] == F.col("__a")) & (hashes[1] == F.col("__b")), "left_anti")
        block = after
    return docs.where(~detector(block, rate)(text)) if block else docs
