"""N-gram Jaccard self-join over parity sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm import textscan
from folioscan.llm.common import Scratch, broadcast_if_small, written
from folioscan.llm.components import connected_components

WIDTH, PERCENT = 5, 80
BAND, SUBS, SPARE = 1.25, 4, 35
#: A key of more than COLD classes can be dropped; what is left of one is compared pair by pair up to WARM classes.
COLD, WARM, BROADCAST_ROWS = 12, 32, 1_000_000
STREAM_SHINGLES, STREAMS_A_TASK, SEND_KEYS, MERGE_ROWS = 2_000_000, 64, 250_000, 250_000
BLOCK_BYTES, PRUNINGS, GROUP_BITS, KEY_BYTES, TAG_BYTES = 8 << 20, 2, 10, 5, 6
SHARED = np.int64(-1 << 63)
_M, _GROUP, _ODD = (1 << 64) - 1, np.uint64((1 << GROUP_BITS) - 1), np.uint64(1 << GROUP_BITS)


@lru_cache(1 << 12)
def band_bounds(percent: int, upto: int) -> list[int]:
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return [*out, max(out[-1] + 1, int(out[-1] * BAND))]


def max_difference(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


@lru_cache(1 << 12)
def scheme(low: int, high: int, percent: int) -> tuple[int, int]:
    """(groups, spare) for sets of low to high shingles: D differing bits spoil at
    most D // 2 groups twice, so groups - D // 2 = spare + 1 groups of any linked
    pair differ in one bit or none.  spare makes up for groups with next to nothing."""
    d = max_difference(high, high, percent)
    if not d:
        return 0, 0
    spare, most = 0, max(1, SPARE * (d // 2 + 1) // 100)
    while spare < most:
        groups = d // 2 + 1 + spare
        dull = SUBS * math.exp(-low / groups * (SUBS - 1) / SUBS) * groups
        if spare >= dull + math.sqrt(dull):
            break
        spare += 1
    return d // 2 + 1 + spare, spare


def bands_of(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, smallest, largest size in it): band k joins sets whose larger size
    is in [L_k, L_k+1); smaller sets come in where they can still be linked."""
    bounds = band_bounds(percent, 1 << max(6, (2 * n).bit_length()))
    k = int(np.searchsorted(bounds, n, "right")) - 1
    out = []
    for j in (k, k + 1):
        low = -(-percent * bounds[j] // 100)
        if n >= low:
            out.append((j, low, bounds[j + 1] - 1))
    return out


def class_of(s: np.ndarray) -> int:
    """Hash of a set; equal sets are one class."""
    with np.errstate(over="ignore"):
        return int(textscan.mix(np.array([s.sum() + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)], np.uint64))[0].astype(np.int64))


def keys_of(s: np.ndarray, percent: int, odd: int | None = None) -> tuple[np.ndarray, int]:
    """Keys (``odd``: of odd bands, 1, or of even ones, 0, alone) of which any set linked to s (but not equal) has some too, and a tag: the
    set's size, and in how many groups of an even and of an odd band a linked set
    meets it at least, in 16 bits each.

    A shingle hash sets one bit of a parity sketch: 64 bits for each of SUBS parts
    of each group.  Bits that differ between two sketches are no more than the
    symmetric difference.  In a group that differs in one bit or none, all parts
    but one are equal: each way to leave one part out makes a key.  Ways that
    leave no odd bit are skipped, unless a set has more groups with such ways than
    spare ones: then it gives all keys, so two such sets still meet.  The lowest
    GROUP_BITS of a key number its group (modulo), the next one says whether its band is odd."""
    out, tag = [], len(s) << 32
    for band, low, high in bands_of(len(s), percent):
        groups, spare = scheme(low, high, percent)
        if not groups or odd not in (None, band & 1):
            continue
        parts = groups * SUBS
        at = ((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        bits = np.bincount(at * 64 + (s & np.uint64(63)).astype(np.int64), minlength=parts * 64) & 1
        sketch = np.packbits(bits.astype(np.uint8)).view(np.uint64)
        seed = np.uint64((band << 44) & _M) + np.arange(parts, dtype=np.uint64)
        h = textscan.mix(textscan.mix(seed) + sketch).reshape(groups, SUBS)
        key = textscan.mix(h.sum(1, keepdims=True) - h + np.arange(SUBS, dtype=np.uint64))
        key = key & ~(_GROUP | _ODD) | (np.arange(groups, dtype=np.uint64) & _GROUP)[:, None] | np.uint64((band & 1) << GROUP_BITS)
        some = (sketch != 0).reshape(groups, SUBS)
        left = some.sum(1, keepdims=True) - some > 0
        dull = int((~left.all(1)).sum())
        if dull > spare:
            left[:] = True
        out.append(key[left])
        tag |= max(1, min(spare + 1 - dull, 0xFFFF)) << (0 if band & 1 else 16)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), tag


def fold_bits(n: int) -> int:
    return 1 << max(6, (n - 1).bit_length())


def folded(s: np.ndarray) -> np.ndarray:
    """Parity sketch of the whole set, with a power of two of bits, as words."""
    f = fold_bits(len(s))
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & (f - 1), minlength=f) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def refold(words: np.ndarray, size: int) -> np.ndarray:
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(b: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    return textscan.shingle_sets(b.column(1), width)


def _joined(key: np.ndarray, cls: np.ndarray, tag: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows (key, cls, tag) as one leading row for each key, the first, whose tag is
    marked SHARED if the key has another class, and the rows of those other classes."""
    order = np.argsort(key, kind="stable")
    k, c, t = key[order], cls[order], tag[order]
    first = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=first[1:])
    at = np.flatnonzero(first)
    other = c != c[at][np.cumsum(first) - 1] if len(k) else first
    shared = np.logical_or.reduceat(other | (t < 0), at) if len(k) else first
    return [k[at], c[at], np.where(shared, t[at] | SHARED, t[at] & ~SHARED)], [k[other], c[other], t[other] & ~SHARED]


def _absorbed(lead: list[np.ndarray], rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Leading rows (one for each key, ascending) with rows (key, cls, tag) joined to them, and rows of
    other classes.  Only the new rows are sorted, known keys are marked in place and the columns
    grow one by one, so beside the leading rows stand one more column and what the new rows take."""
    (k, c, t), other = _joined(*rows)
    at = np.searchsorted(lead[0], k)
    known = np.flatnonzero(at < len(lead[0]))
    known = known[lead[0][at[known]] == k[known]]
    differs = lead[1][at[known]] != c[known]
    lead[2][at[known][differs | (t[known] < 0)]] |= SHARED
    also = known[differs]
    other = [np.concatenate(x) for x in zip(other, (k[also], c[also], t[also] & ~SHARED))]
    new = np.ones(len(k), bool)
    new[known] = False
    for i, x in enumerate((k, c, t)):
        lead[i] = np.insert(lead[i], at[new], x[new])
    return lead, other


def _wire(x: np.ndarray, size: int) -> bytes:
    """The lowest ``size`` bytes of each number."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unwired(x: bytes, size: int) -> np.ndarray:
    eight = np.zeros((len(x) // size, 8), np.uint8)
    eight[:, :size] = np.frombuffer(x, np.uint8).reshape(-1, size)
    return eight.view(np.uint64).ravel()


def _shared_keys(rows: DataFrame, width: int, percent: int, odd: int, streams: int, partitions: int) -> DataFrame:
    """(key, cls, tag) of all classes that have a key of an odd (1) or even (0) band in
    common with another one; rows may be repeated.

    Equal keys that meet in one batch are joined there and go on as one row. Rows
    go to ``streams`` by key, packed (KEY_BYTES of the key, class and TAG_BYTES of the
    tag, which has one half in use, once for their keys); a task takes its streams one after the other, sorted by Spark, and
    keeps one class per key of the stream at hand, so its memory follows the number
    of distinct keys in a stream and neither the input nor a key's documents."""
    names, ends = ["part", "keys", "cls", "tags", "counts"], ["key", "cls", "tag"]
    low, at = np.uint64((1 << 8 * KEY_BYTES) - 1), np.uint64(0 if odd else 16)
    size, half = np.uint64(32), np.uint64(16)

    def named(key: np.ndarray, stream: np.ndarray | int) -> np.ndarray:
        return (key & low | np.asarray(stream).astype(np.uint64) << np.uint64(8 * KEY_BYTES)).view(np.int64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys: list[np.ndarray], cls: list[np.ndarray], tags: list[np.ndarray]) -> pa.RecordBatch:
            lead, other = _joined(*(np.concatenate(x) for x in (keys, cls, tags)))
            part, out = [], [[], [], [], []]
            for (key, c, t), done in ((lead, 0), (other, 1)):
                to = ((key >> np.uint64(32)) * np.uint64(streams) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((t, c, to))
                key, c, t, to = key[order], c[order], t[order], to[order]
                cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, np.int64)
                for x, y in zip(cut[:-1], cut[1:]):
                    run = np.flatnonzero(np.concatenate([[True], (c[x + 1 : y] != c[x : y - 1]) | (t[x + 1 : y] != t[x : y - 1]), [True]]))
                    part.append(int(to[x]) << 1 | done)
                    out[0].append(_wire(key[x:y], KEY_BYTES))
                    out[1].append(c[x:y][run[:-1]].tobytes())
                    few = t[x:y][run[:-1]].view(np.uint64)
                    out[2].append(_wire(few >> size << half | few >> at & np.uint64(0xFFFF), TAG_BYTES))
                    times = np.diff(run)
                    out[3].append(times.astype(np.min_scalar_type(int(times.max()))).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(x, pa.binary()) for x in out)], names)

        held: list[list[np.ndarray]] = [[], [], []]
        for b in batches:
            for s in _sets(b, width):
                if len(s):
                    k, t = keys_of(s, percent, odd)
                    for x, y in zip(held, (k, np.full(len(k), class_of(s), np.int64), np.full(len(k), t, np.int64))):
                        x.append(y)
            if sum(map(len, held[0])) >= SEND_KEYS:
                yield emit(*held)
                held = [[], [], []]
        if held[0]:
            yield emit(*held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead, held, waiting = -1, [], [], 0

        def table(e: list[np.ndarray], stream: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (named(e[0], stream), *e[1:])], ends)

        def merge() -> list[np.ndarray]:
            nonlocal lead, held, waiting
            rows = [np.concatenate(x) for x in zip(*held)]
            held, waiting = [], 0
            lead, other = _absorbed(lead, rows) if lead else _joined(*rows)
            return other

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal lead
            if held:
                yield table(merge(), now)
            shared = np.flatnonzero(lead[2] < 0) if lead else []
            for x in range(0, len(shared), MERGE_ROWS):
                at = shared[x : x + MERGE_ROWS]
                yield table([lead[0][at], lead[1][at], lead[2][at] & ~SHARED], now)
            lead = []

        for b in batches:
            for part, k, c, t, n in zip(*(x.to_pylist() for x in b.columns)):
                few = _unwired(t, TAG_BYTES)
                tags = (few >> half << size | (few & np.uint64(0xFFFF)) << at).view(np.int64)
                times = np.frombuffer(n, f"u{len(n) // len(tags)}")
                rows = [_unwired(k, KEY_BYTES), np.repeat(np.frombuffer(c, np.int64), times), np.repeat(tags, times)]
                if part & 1:
                    yield table(rows, part >> 1)
                    continue
                if part >> 1 != now:
                    yield from close()
                    now = part >> 1
                held.append(rows)
                waiting += len(rows[0])
                if waiting >= MERGE_ROWS:
                    yield table(merge(), now)
        yield from close()

    sent = rows.mapInArrow(packed, "part long, keys binary, cls binary, tags binary, counts binary")
    return sent.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(merged, "key long, cls long, tag long")


def _with_sets(rows: DataFrame, width: int, whole: bool, of_class: bool = False) -> DataFrame:
    """rows: rep, text -> rep and its set: the hashes (``whole``) or the folded sketch.
    ``of_class``: only of texts whose class is rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(rep, (s if whole else folded(s)).tobytes()) for rep, s in zip(b.column(0).to_pylist(), _sets(b, width)) if not of_class or class_of(s) == rep]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.binary())], ["rep", "words"])

    return rows.select("rep", "text").mapInArrow(run, "rep long, words binary")


def _folded(held: DataFrame) -> DataFrame:
    """held (rep, words, n) with the folded sketch of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = [folded(np.frombuffer(x.as_py(), np.uint64)).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fold, pa.binary())], ["rep", "n", "words", "fold"])

    return held.select("rep", "n", "words").mapInArrow(run, "rep long, n long, words binary, fold binary")


def _near(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose folded sketches do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for i, (na, nb, fa, fb) in enumerate(zip(t.column(2).to_pylist(), t.column(3).to_pylist(), t.column(4), t.column(5))):
                x, y = np.frombuffer(fa.as_py(), np.uint64), np.frombuffer(fb.as_py(), np.uint64)
                size = min(len(x), len(y))
                if int(np.bitwise_count(refold(x, size) ^ refold(y, size)).sum()) <= max_difference(na, nb, percent):
                    keep.append(i)
            yield t.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = [i for i, (x, y) in enumerate(zip(t.column(2), t.column(3))) if linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)]
            yield t.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def near_rows(size: np.ndarray, by: list[np.ndarray], side: np.ndarray, label: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of side 0 with the rows of side 1 of another label that sizes and
    sketches do not rule out, nearest first."""
    length = np.array([len(f) for f in by])
    rights = {int(n): np.flatnonzero((side == 1) & (length == n)) for n in np.unique(length[side == 1])}
    folds: dict[tuple[int, int], np.ndarray] = {}
    for i in np.flatnonzero(side == 0).tolist():
        found, gaps = [], []
        for n in (int(length[i]) // 2, int(length[i]), 2 * int(length[i])):
            if n not in rights:
                continue
            js, w = rights[n], min(n, int(length[i]))
            if (n, w) not in folds:
                folds[n, w] = np.stack([refold(by[j], w) for j in js])
            gap = np.bitwise_count(folds[n, w] ^ refold(by[i], w)).sum(1, dtype=np.int64)
            fit = (label[js] != label[i]) & (100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i]))
            fit &= gap <= (100 - percent) * (size[js] + size[i]) // (100 + percent)
            found.append(js[fit])
            gaps.append(gap[fit])
        if found:
            yield i, np.concatenate(found)[np.argsort(np.concatenate(gaps), kind="stable")]


def forest(reps: list[int], sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Verified links between the two sides that connect the same labels as all
    links between them do; pairs that are connected already are not looked at."""
    root = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, js in near_rows(np.array([len(s) for s in sets]), [folded(s) for s in sets], side, label, percent):
        for j in js.tolist():
            if (a := find(int(label[i]))) != (b := find(int(label[j]))) and linked(sets[i], sets[j], percent):
                root[b] = a
                out.append((reps[i], reps[j]))
    return out


def _dealt(members: DataFrame, size: Column) -> DataFrame:
    """members (cluster, rep, label, ...): those outside the largest label of their
    cluster (side 0) meet all of it (side 1) in groups (cluster, lo, hi) of a block
    of each, both of about BLOCK_BYTES, so no task holds more however large a
    cluster is.  A cluster of one label gives nothing."""
    top = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    m = members.join(top, "cluster").withColumn("outside", F.col("label") != F.col("top")).drop("top")
    blocks = lambda x: F.ceil(F.sum(x) / BLOCK_BYTES).cast("int")
    count = m.groupBy("cluster").agg(blocks(size).alias("all"), blocks(F.when(F.col("outside"), size)).alias("out")).where("out is not null")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = m.join(count, "cluster")
    left = m.where("outside").select("*", F.lit(0).alias("side"), own("out").alias("lo"), every("all").alias("hi"))
    return left.union(m.select("*", F.lit(1).alias("side"), every("out").alias("lo"), own("all").alias("hi"))).drop("all", "out", "outside")


def _compared(members: DataFrame, size: Column, percent: int, whole: bool) -> DataFrame:
    """(a, b) of members (cluster, rep, label, n, words): links that connect the
    labels of each cluster (``whole``: words are sets), or for each member that may
    have one (words are sketches) a row with itself and its cluster."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        reps, words = t.column("rep").to_pylist(), [np.frombuffer(x.as_py(), np.uint64) for x in t.column("words")]
        side, label = np.asarray(t.column("side")), np.asarray(t.column("label"))
        if whole:
            out = forest(reps, words, side, label, percent)
        else:
            hit: set[int] = set()
            for i, js in near_rows(np.asarray(t.column("n")), words, side, label, percent):
                hit.update([i, *js.tolist()] if len(js) else [])
            cluster = t.column("cluster")[0].as_py() if len(t) else 0
            out = [(r, cluster) for r in sorted({reps[h] for h in hit})]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return _dealt(members, size).groupBy("cluster", "lo", "hi").applyInArrow(run, "a long, b long")


def _linkable(held: DataFrame, percent: int) -> DataFrame:
    """held (rep, n, words) without the sets that share too few of their shingles with
    any other of held to have a link there.

    Shingles go to streams packed, each stream keeps one number per shingle (its set, or
    that there are several), and says how many each set has to itself."""
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = -(1 << 63)

    def once(s: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(s, kind="stable")
        s, rep = s[order], rep[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        many = np.diff(np.append(at, len(s))) > 1
        return s[at], np.where(many, several, rep[at])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(1)]
            if not sets:
                continue
            s, rep = once(np.concatenate(sets), np.repeat(np.asarray(b.column(0)), [len(x) for x in sets]))
            to = ((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # ascending, as s is
            cut = np.searchsorted(to, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cut)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array([x[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary()) for x in (s, rep))], ["part", "s", "rep"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, rep, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for b in batches:
            waiting += [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64)) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            if sum(len(x) for x, _ in waiting) >= MERGE_ROWS:
                s, rep = once(*(np.concatenate(x) for x in zip((s, rep), *waiting)))
                waiting = []
        s, rep = once(*(np.concatenate(x) for x in zip((s, rep), *waiting)))
        own, n = np.unique(rep[rep != several], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["rep", "own"])

    own = held.select("rep", "words").mapInArrow(packed, "part long, s binary, rep binary").repartition(parts, "part").mapInArrow(counted, "rep long, own long")
    own = own.groupBy("rep").agg(F.sum("own").alias("own"))
    return held.join(own, "rep", "left").where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n")).drop("own")


def _stars(hot: DataFrame) -> DataFrame:
    """(a, b): of each key of hot (key, cls, w) the class with the most company leads (a)
    the others (b); w is the number of the key's classes."""
    company = F.sum("w").over(Window.partitionBy("cls"))
    lead = F.max(F.struct("company", "cls")).over(Window.partitionBy("key"))
    return hot.withColumn("company", company).select(lead.cls.alias("a"), F.col("cls").alias("b")).where("a <> b").distinct()


def _hot_links(stars: DataFrame, held: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """Links that connect the sets held (rep, n, words, fold), which meet in keys that many
    have: stars (a, b) join a key's leading set to each other set of it.

    Sets without enough shingles in common with all others are left out.  The links of the
    leading sets contract the keys' members; then only those outside the largest part of a
    cluster (of keys that have members in common) are compared with the cluster, by sketches first."""
    for _ in range(PRUNINGS):
        held = tables.written(_linkable(held, percent), "linkable", (512, "2m"))
    side = lambda c: held.select(F.col("rep").alias(c), F.col("n").alias("n" + c), F.col("words").alias("h" + c))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    links = tables.written(_verified(stars.join(side("a"), "a").join(side("b"), "b").where(fits), percent), "links", (256, "4m"))
    label = connected_components(links, "a", "b", tables).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    cluster = connected_components(stars, "a", "b", tables).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    m = held.join(cluster, "rep").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    m = tables.written(m, "members")
    hopeful = _compared(m.select("cluster", "rep", "label", "n", F.col("fold").alias("words")), F.octet_length("words") + 64, percent, whole=False)
    hopeful = tables.written(hopeful.distinct().select(F.col("a").alias("rep"), F.col("b").alias("cluster")), "hopeful", (512, "2m"))
    return links.union(_compared(m.join(hopeful, ["rep", "cluster"], "left_semi").select("cluster", "rep", "label", "n", "words"), F.octet_length("words") + 64, percent, whole=True))


def _bucketed(tokens: DataFrame, limit: int) -> DataFrame:
    """(key, w, members) of tokens (key, cls, tag) that are dealt by key already: the w
    classes of a key as one array, or a row each where they are more than limit."""
    counted = tokens.withColumn("w", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("w > 1")
    return counted.groupBy("key", F.when(F.col("w") > limit, F.col("cls")).alias("own")).agg(F.max("w").cast("int").alias("w"), F.collect_list(F.struct("cls", "tag")).alias("members")).drop("own")


def _tag(tag: str, key: str = "key") -> tuple[Column, Column, Column]:
    """(size, whether the key's band is odd, groups required in that band)."""
    odd = F.shiftright(key, GROUP_BITS).bitwiseAND(1)
    return F.shiftright(tag, 32), odd, F.when(odd == 1, F.col(tag)).otherwise(F.shiftright(tag, 16)).bitwiseAND(0xFFFF)


def droppable(required: Column) -> Column:
    """How many groups a set may lose of those in which any linked set meets it."""
    return F.floor((required - 1) * 2 / 3)


def _without_hottest(hot: DataFrame, percent: int) -> DataFrame:
    """hot (key, w, members) without the hottest keys of each set.

    All sets rank keys alike, by (w, key), and drop their highest ones as long as these
    are in no more than droppable groups.  Of two linked sets, the one that drops from
    a lower rank on drops all that the other drops of their common keys, so as many
    groups as are required less those droppable still meet."""
    bounds = band_bounds(percent, 1 << 40)
    lows = [-(-percent * x // 100) for x in bounds]
    wide = next((low for low, high in zip(lows, bounds[1:]) if scheme(low, high - 1, percent)[0] > 1 << GROUP_BITS), 1 << 62)
    t = hot.select("key", "w", F.col("members")[0].cls.alias("cls"), F.col("members")[0].tag.alias("tag")).repartition("cls")
    size, odd, required = _tag("tag")
    group = F.when(size < wide, F.col("key").bitwiseAND(int(_GROUP))).otherwise(F.col("key"))  # in the latter each key counts as a group
    t = t.withColumns({"odd": odd, "group": group}).withColumn("top", F.max(F.struct("w", "key")).over(Window.partitionBy("cls", "odd", "group")))
    t = t.withColumn("nth", F.dense_rank().over(Window.partitionBy("cls", "odd").orderBy(F.desc("top"))))
    return t.where(F.col("nth") > droppable(required)).select("key", "cls", "tag")


def _pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes with enough keys in common, of keys with few classes."""
    t = buckets.select("key", "members", F.explode("members").alias("p")).select("key", "p", F.explode("members").alias("q")).where("p.cls < q.cls")
    t = t.select("key", F.col("p.cls").alias("a"), F.col("q.cls").alias("b"), F.col("p.tag").alias("ta"), F.col("q.tag").alias("tb"))
    (na, odd, ra), (nb, _, rb) = _tag("ta"), _tag("tb")
    required = F.greatest(ra, rb)
    need = F.shiftleft(required - droppable(required), 1).bitwiseOR(odd).cast("int").alias("need")
    t = t.where(100 * F.least(na, nb) >= percent * F.greatest(na, nb)).select("a", "b", need)
    return t.groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= F.shiftright("need", 1)).select("a", "b").distinct()


def _classified(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """((doc_id, text_hash, n, part, component_id) of every row, written; whether ids are unique).  part tells
    components apart: null without words, else the smallest node, which is a class's smallest id, or its hash
    where ids repeat (then one id may stand for several classes)."""
    spark, batch = docs.sparkSession, (512, "2m")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls = [], []
            for s in _sets(b, width):
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64())], ["doc_id", "text_hash", "n", "cls"])

    with Scratch(spark) as tables:
        sets = tables.written(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(measure, "doc_id long, text_hash long, n long, cls long"), "sets", batch)
        ids = sets.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
        unique = ids.n == ids.d
        classes = sets.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"))
        classes = tables.written(classes.withColumn("rep", F.col("least" if unique else "cls")), "classes")
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        streams = max(least, -(-(classes.agg(F.sum("n")).first()[0] or 0) // STREAM_SHINGLES))
        partitions, candidates, hot = max(least, -(-streams // STREAMS_A_TASK)), [], []
        for odd in (0, 1):  # a linked pair has enough keys in common in one of the two, so each goes by itself and holds half of the disk
            shared = tables.written(_shared_keys(rows, width, percent, odd, streams, partitions), "keys", batch)
            once = shared.repartition("key").groupBy("key", "cls").agg(F.first("tag").alias("tag"))
            buckets = tables.written(_bucketed(once, COLD), "buckets")
            tables.drop(shared)
            warm = tables.written(_bucketed(_without_hottest(buckets.where(F.col("w") > COLD), percent).repartition("key"), WARM), "warm")
            candidates.append(tables.written(_pairs(buckets.where(F.col("w") <= COLD).union(warm.where(F.col("w") <= WARM)), percent), "candidates"))
            tables.drop(buckets)
            hot.append(tables.written(warm.where(F.col("w") > WARM).select("key", "w", F.col("members")[0].cls.alias("cls")), "hot"))
            tables.drop(warm)

        def fetched(reps: DataFrame, whole: bool) -> DataFrame:
            reps = tables.written(reps.distinct() if unique else reps.distinct().join(classes, "rep").select("rep", "least"), "reps")
            reps = broadcast_if_small(reps, reps.count(), BROADCAST_ROWS)
            if unique:
                return tables.written(_with_sets(rows.withColumnRenamed("doc_id", "rep").join(reps, "rep"), width, whole), "words", batch)
            texts = rows.join(reps, F.col("doc_id") == F.col("least"))
            return tables.written(_with_sets(texts, width, whole, of_class=True).dropDuplicates(["rep"]), "words", batch)  # rows of a class have the same set

        side = lambda t, c, name: t.select(F.col("rep").alias(c), F.col("words").alias(f"{name}{c}"))
        ends = lambda t: t.select(F.col("a").alias("rep")).union(t.select("b"))
        of = lambda c: classes.select(F.col("cls").alias(c), F.col("rep").alias("r" + c), F.col("n").alias("n" + c))
        pairs = candidates[0].union(candidates[1]).distinct()
        pairs = pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "na", "nb")
        pairs = tables.written(pairs, "pairs")
        tables.drop(*candidates)
        folds = fetched(ends(pairs), whole=False)
        near = tables.written(_near(pairs.join(side(folds, "a", "f"), "a").join(side(folds, "b", "f"), "b"), percent), "near", batch)
        tables.drop(folds)
        held = fetched(ends(near), whole=True)
        links = tables.written(_verified(near.join(side(held, "a", "h"), "a").join(side(held, "b", "h"), "b"), percent), "links", (256, "4m"))
        tables.drop(held)

        stars = tables.written(_stars(hot[0].union(hot[1])), "stars")
        tables.drop(*hot)
        stars = tables.written(stars.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")), "stars")
        if not stars.isEmpty():
            held = fetched(ends(stars), whole=True)
            held = tables.written(_folded(held.withColumn("n", (F.octet_length("words") / 8).cast("long"))), "held", batch)
            links = links.union(_hot_links(stars, held, percent, tables))
        found = connected_components(links, "a", "b", tables).select(F.col("node").alias("rep"), "component")
        parts = classes.join(found, "rep", "left").select("cls", "least", F.coalesce("component", "rep").alias("part"))
        if unique:
            parts = parts.select("cls", "part", F.col("part").alias("component_id"))
        else:
            parts = parts.join(parts.groupBy("part").agg(F.min("least").alias("component_id")), "part").drop("least")
        out = sets.join(parts, "cls", "left").select("doc_id", "text_hash", "n", "part", F.coalesce("component_id", "doc_id").alias("component_id"))
        return written(out, "components"), unique


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row, written: documents whose sets of
    ``width``-word shingles have 100 * common >= percent * union are linked.

    Equal sets are one class, found by hash.  Keys of parity sketches (keys_of)
    are joined within a batch before they are shuffled, those of even bands first and
    those of odd ones after them, and leave only classes that share one (_shared_keys).  Each set drops some of the keys that most
    classes share (_without_hottest).  Keys of few classes then give the pairs that
    have as many in common as linked sets must, and larger ones, which are left where
    many sets are much alike, are contracted around leading sets before anything is
    compared within them (_hot_links).  Every candidate is decided on the whole
    sets, so no link is lost and none is made up (64-bit hashes stand for shingles
    and for sets).

    Null, empty and wordless texts have no shingles and their own id as component;
    a text of fewer words than ``width`` has one shingle.  Links are between texts: of rows that
    repeat an id with other texts, each is in the component of its own text, named by the smallest id of
    any of its rows.  Rows of a null id link nothing and take the component of their text, if others have
    it.  Other columns are ignored; an empty table gives an empty result.
    """
    return _classified(docs, width, percent, id_col, text_col)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns kept: that of the smallest id, and of that id's
    texts in the component that of the smallest hash.  Texts without words all stay, and so do rows of
    a null id.  Of rows that repeat both id and text, one stays (the smallest hash of all columns)."""
    found, unique = _classified(docs, width, percent, id_col, text_col)
    if unique:
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
        return docs.join(broadcast_if_small(gone, found.count(), BROADCAST_ROWS), docs[id_col] == F.col("__gone"), "left_anti")
    known = found.where("doc_id is not null")
    first = known.where("part is not null").groupBy("part").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash")).union(known.where("part is null").select("doc_id", "text_hash").distinct())
    mine = docs.where(F.col(id_col).isNotNull()).withColumn("__text", F.xxhash64(text_col))
    mine = mine.join(kept, (F.col(id_col) == F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    one = mine.groupBy(id_col, "__text").agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.xxhash64(*docs.columns)).alias("__row"))
    return one.select("__row.*").unionByName(docs.where(F.col(id_col).isNull()))
