"""Hard negatives of anchors by exact inner products over rotated vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import Scratch, written

#: Rows and anchors of a block, anchors compared at a time, blocks of which one gives the first floors.
ROWS, ANCHORS, CHUNK, SAMPLE = 2048, 1024, 256, 16
#: Up to this many bytes of anchor blocks are broadcast; more are dealt out with the blocks of rows.
BROADCAST = 32 << 20
#: Shares of the energy that is left where a partial product is looked at; of pairs, below which they are taken one by one.
LEFT, FEW = (0.5, 0.25, 0.125, 0.06, 0.03, 0.0), 0.04
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v as integers floor(256 * x), with
    the label of every seventh id moved on by one."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows; shorter ones end in zeros."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = lists.flatten().to_numpy()
    return out


@dataclass
class Rotation:
    """Principal axes of all rows, and the numbers of leading axes at which products are looked at."""

    axes: np.ndarray
    cuts: list[int]

    @property
    def width(self) -> int:
        return len(self.axes)


def rotation(rows: DataFrame) -> Rotation:
    """Axes from the sum over all rows of v v', added up by partition; one number for
    each pair of components reaches the driver."""
    most, largest = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()
    if (largest or 0) >= 2.0**56:
        raise ValueError("vectors are too long: inner products could exceed a long")
    width = max(1, most or 0)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = _matrix(b.column(0), width).astype(np.float64)
            total += m.T @ m
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    gram = np.zeros((width, width))
    for r in rows.select("v").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        gram[r.i, r.j] = gram[r.j, r.i] = r.s
    energy, axes = np.linalg.eigh(gram)
    energy, axes = np.maximum(energy[::-1], 0), axes[:, ::-1]
    left = 1 - np.cumsum(energy) / max(energy.sum(), 1e-300)
    return Rotation(np.ascontiguousarray(axes), sorted({min(width, int(np.argmax(left <= x + 1e-12)) + 1) if x else width for x in LEFT}))


BLOCKS = "block int, part int, n int, ids binary, labels binary, copies binary, v binary, y binary"


def packed(rows: DataFrame, turned: Rotation, size: int, count: int) -> DataFrame:
    """Blocks of at most ``size`` rows: ids, labels, numbers of copies, integers, and
    rotated vectors in single precision, each as the bytes of one array."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kth, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            v = np.vstack([h[3] for h in held])
            y = (v.astype(np.float64) @ turned.axes).astype(np.float32)
            cols = [np.concatenate([h[k] for h in held]).astype(np.int64) for k in range(3)]
            values = [[part + (kth << 16)], [part], [len(v)], *[[x.tobytes()] for x in (*cols, v, y)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, [pa.int32()] * 3 + [pa.binary()] * 5)], [f.split()[0] for f in BLOCKS.split(", ")])

        for b in batches:
            for lo in range(0, b.num_rows, size):
                s = b.slice(lo, size)
                if held and sum(len(h[0]) for h in held) + s.num_rows > size:
                    yield block()
                    kth, held = kth + 1, []
                held.append([*(s.column(k).to_numpy(zero_copy_only=False) for k in range(3)), _matrix(s.column(3), turned.width)])
        if held:
            yield block()

    return rows.select("vec_id", "label", "copies", "v").repartition(max(1, -(-count // size))).mapInArrow(pack, BLOCKS)


def _unpacked(b: pa.RecordBatch, i: int, side: str, width: int) -> list[np.ndarray]:
    get = lambda name, kind: np.frombuffer(b.column(f"{side}{name}")[i].as_buffer(), kind)
    return [get("ids", np.int64), get("labels", np.int64), get("copies", np.int64), get("v", np.int64).reshape(-1, width), get("y", np.float32).reshape(-1, width)]


def _first(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first of each i, by score from above, then by id."""
    at = np.lexsort((ids, -score, i))
    begin = np.flatnonzero(np.diff(i[at], prepend=-1))
    nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    return at[nth < k]


def compared(rows: list[np.ndarray], anchors: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, k: int, same: bool, cuts: list[int]) -> tuple[list[tuple], np.ndarray]:
    """([(anchor, window, row, score)], pairs left after each look): for each anchor and window [lo, hi] the k
    first of its label (``same``) or of other labels.

    Products of leading axes are summed in single precision.  What the other axes can add is at most
    the product of the two remainders' norms, what rounding can, ``slack``.  A pair goes when no
    window of its anchor can hold it; when few are left, or at the last axis, those that by the same slack
    can still be among the k first of a window are scored in integers.
    """
    ids, labels, _, v, y = rows
    _, own, _, va, ya = anchors
    width, out, left = y.shape[1], [], np.zeros(len(cuts) + 2, np.int64)
    rest = lambda m: np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1])
    tail_b = np.hstack([rest(y), np.zeros((len(y), 1))]).astype(np.float32)
    tail_a = np.hstack([rest(ya), np.zeros((len(ya), 1))]).astype(np.float32)
    unit = np.float32((width + 16) * 2.0**-22)
    for c in range(0, len(ya), CHUNK):
        a, ta, low, high = ya[c : c + CHUNK], tail_a[c : c + CHUNK], lo[c : c + CHUNK], hi[c : c + CHUNK]
        alive = (own[c : c + CHUNK, None] == labels[None, :]) == same
        left[0] += alive.size
        slack = unit * ta[:, :1] * tail_b[None, :, 0]
        total, done = np.zeros(alive.shape, np.float32), 0
        for nth, m in enumerate(cuts):
            total += a[:, done:m] @ y[:, done:m].T
            done = m
            room = ta[:, m, None] * tail_b[None, :, m] + slack
            fits = np.zeros_like(alive)
            for w in range(lo.shape[1]):
                fits |= (total + room >= low[:, w, None]) & (total - room <= high[:, w, None])
            alive &= fits
            left[nth + 1] += alive.sum()
            if alive.sum() <= FEW * alive.size:
                break
        i, j = np.nonzero(alive)
        part = total[i, j].astype(np.float64)
        for s in range(0, len(i), 1 << 16):
            p = slice(s, s + (1 << 16))
            part[p] += np.einsum("ij,ij->i", a[i[p], done:].astype(np.float64), y[j[p], done:])
        room = slack[i, j].astype(np.float64)
        for w in range(lo.shape[1]):
            at = np.flatnonzero((part + room >= low[i, w]) & (part - room <= high[i, w]))
            sure = at[(part[at] - room[at] >= low[i[at], w]) & (part[at] + room[at] <= high[i[at], w])]
            top = _first(i[sure], part[sure] - room[sure], sure, k)
            floor = np.full(len(a), -np.inf)
            if len(top):
                enough = np.bincount(i[sure[top]], minlength=len(a)) >= k
                np.minimum.at(worst := np.full(len(a), np.inf), i[sure[top]], part[sure[top]] - room[sure[top]])
                floor = np.where(enough, worst, -np.inf)
            at = at[part[at] + room[at] >= floor[i[at]]]
            exact = np.empty(len(at), np.int64)
            for s in range(0, len(at), 1 << 16):
                p = at[s : s + (1 << 16)]
                exact[s : s + len(p)] = np.einsum("ij,ij->i", va[c + i[p]], v[j[p]])
            left[-1] += len(at)
            keep = (exact >= low[i[at], w]) & (exact <= high[i[at], w])
            at, exact = at[keep], exact[keep]
            for q in _first(i[at], exact, ids[j[at]], k):
                out.append((c + int(i[at[q]]), w, int(j[at[q]]), int(exact[q])))
    return out, left


FOUND = "anchor_block int, nth int, anchor_id long, copies long, w int, score long, vec_id long, itself boolean"


def scan(rows: DataFrame, anchors: DataFrame, windows: DataFrame | None, k: int, same: bool, turned: Rotation, small: bool, n_blocks: int) -> DataFrame:
    """The k first rows of each anchor's windows in every block of rows, as FOUND.  Rows of nth -1
    count pairs: all, those left after each look (w), those scored in integers.

    windows: (anchor_block, nth, w, lo, hi); an anchor without any is not asked, unless
    windows is None: then one without bounds.  Blocks meet blocks: anchors are broadcast if ``small``, else a
    copy of their blocks goes with each group of about eight blocks of rows, so that no task gets all of either.
    """
    width, cuts, n_windows, unbounded = turned.width, turned.cuts, 1 if same else 5, windows is None
    left = anchors.select(F.col("block").alias("anchor_block"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "copies", "v", "y")])
    if windows is not None:
        of = windows.groupBy("anchor_block").agg(F.collect_list(F.struct("nth", "w", "lo", "hi")).alias("x"))
        left = left.join(of.select("anchor_block", *[F.col(f"x.{c}").alias(c) for c in ("nth", "w", "lo", "hi")]), "anchor_block", "left")
    else:
        left = left.selectExpr("*", "cast(null as array<int>) as nth", "cast(null as array<int>) as w", "cast(null as array<long>) as lo", "cast(null as array<long>) as hi")
    right = rows.select("block", *[F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "copies", "v", "y")])
    groups = max(min(n_blocks, 64), n_blocks // 8)
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    both = right.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).join(anchors.select(F.col("block").alias("anchor_block"), each), "g")
    both = both.join(F.broadcast(left), "anchor_block") if small else both.join(left.select("*", each), ["anchor_block", "g"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                mine, theirs = _unpacked(b, r, "b_", width), _unpacked(b, r, "a_", width)
                n, block = len(theirs[0]), b.column("anchor_block")[r].as_py()
                nth, w, low, high = (b.column(c)[r].values for c in ("nth", "w", "lo", "hi"))
                lo, hi = np.full((n, n_windows), HIGHEST), np.full((n, n_windows), LOWEST)
                if unbounded:
                    lo, hi = hi, lo
                elif nth is not None:
                    lo[nth.to_numpy(), w.to_numpy()], hi[nth.to_numpy(), w.to_numpy()] = low.to_numpy(), high.to_numpy()
                found, counts = compared(mine, theirs, lo, hi, k, same, cuts)
                a, w, j, s = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
                itself = (mine[0][j] == theirs[0][a]) & (mine[1][j] == theirs[1][a]) & (mine[3][j] == theirs[3][a]).all(axis=1)
                m = len(counts)
                cols = [np.full(len(a) + m, block), np.append(a, [-1] * m), np.append(theirs[0][a], [0] * m), np.append(theirs[2][a], [0] * m), np.append(w, range(m)), np.append(s, counts), np.append(mine[0][j], [0] * m), np.append(itself, [False] * m)]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], [f.split()[0] for f in FOUND.split(", ")])

    return both.mapInArrow(search, FOUND)


def _floors(found: DataFrame, k: int) -> DataFrame:
    """The k-th best score of every window that has so many."""
    ranked = found.where("nth >= 0").selectExpr("anchor_block", "nth", "w", "score", "row_number() over (partition by anchor_block, nth, w order by score desc, vec_id) as r")
    return ranked.where(f"r = {k}").select("anchor_block", "nth", "w", F.col("score").alias("floor"))


def mine(vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, counts: bool = False) -> DataFrame:
    """Hard negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``every`` divides.  Scores are integer inner products; an anchor's positives are its
    first ``n_positives`` other rows of the same label, by score from above, then by id; for each of them the first
    ``n_negatives`` rows of other labels with 50 * positive <= 100 * negative <= 95 * positive.

    Vectors are turned to their principal axes; see ``compared`` for how pairs are left out without loss.  Rows and anchors are
    packed into blocks, and blocks meet blocks.  One block of rows in SAMPLE is searched first: the k-th best
    score there is a floor for the search of all.  So each search gives few rows per anchor.

    Rows without id, label or vector, or with a component that is null or not finite, take no part; shorter vectors count as
    ended by zeros, empty ones score 0.  Each repeated row is a row, an anchor, a positive or a negative of its own; an anchor
    isn't its own positive, but its copies are.  Where rows or labels are lacking, there are fewer rows; an empty table gives
    none.  Vectors whose products could exceed a long raise.  Other columns take no part.
    ``counts`` gives instead, per search and look, how many pairs were left (search, look, pairs).
    """
    spark = vectors.sparkSession
    if n_positives != 5:
        raise ValueError("five windows an anchor")
    with Scratch(spark) as tables:
        rows = tables.written(usable(vectors), "usable")
        turned, n = rotation(rows), rows.count()
        asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("copies"))
        asked = tables.written(asked, "asked")
        batch = (512, "4m")
        blocks = tables.written(packed(rows.withColumn("copies", F.lit(1).cast("long")), turned, ROWS, n), "rows", batch)
        n_asked = asked.count()
        anchors = tables.written(packed(asked, turned, ANCHORS, n_asked), "anchors", batch)
        small, n_blocks = n_asked * turned.width * 12 <= BROADCAST, blocks.count()
        some = blocks.where(F.col("part") % SAMPLE == 0)
        search = lambda of, windows, k, same, name: tables.written(scan(of, anchors, windows, k, same, turned, small, n_blocks), name, batch)

        k = n_positives + 1  # the anchor itself may be among them
        probe = search(some, None, k, True, "probe")
        open_ = anchors.select(F.col("block").alias("anchor_block"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"), F.lit(0).alias("w"))
        bounded = open_.join(_floors(probe, k), ["anchor_block", "nth", "w"], "left").select("anchor_block", "nth", "w", F.coalesce("floor", F.lit(LOWEST)).alias("lo"), F.lit(HIGHEST).alias("hi"))
        near = search(blocks, bounded, k, True, "near")
        place = "partition by anchor_block, nth"
        positives = (
            near.where("nth >= 0").selectExpr("*", f"row_number() over ({place} order by score desc, vec_id, itself desc) as r")
            .selectExpr("*", f"coalesce(min(case when itself then r end) over ({place}), 1000) as me").where("r <> me")
            .selectExpr("anchor_block", "nth", "anchor_id", "copies", "vec_id as positive_id", "score as positive_score", "cast(r - if(r > me, 1, 0) - 1 as int) as w").where(f"w < {n_positives}")
        )
        positives = tables.written(positives, "positives")
        s = "positive_score"
        windows = positives.selectExpr("anchor_block", "nth", "w", f"({s} + pmod({s}, 2)) div 2 as lo", f"(95 * {s} - pmod(95 * {s}, 100)) div 100 as hi").where("lo <= hi")
        probe2 = search(some, windows, n_negatives, False, "probe")
        raised = windows.join(_floors(probe2, n_negatives), ["anchor_block", "nth", "w"], "left").withColumn("lo", F.greatest("lo", F.coalesce("floor", "lo"))).drop("floor")
        far = search(blocks, raised, n_negatives, False, "far")
        if counts:
            out = [t.where("nth = -1").groupBy(F.col("w").alias("look")).agg(F.sum("score").alias("pairs")).withColumn("search", F.lit(x)) for x, t in (("positives", near), ("negatives", far))]
            return written(out[0].unionByName(out[1]), "counts")
        best = far.where("nth >= 0").selectExpr("anchor_block", "nth", "w", "vec_id as negative_id", "score as negative_score", "cast(row_number() over (partition by anchor_block, nth, w order by score desc, vec_id) as int) as rank")
        out = best.where(f"rank <= {n_negatives}").join(positives, ["anchor_block", "nth", "w"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        return written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
