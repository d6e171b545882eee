"""Packing token streams into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import written

CAPACITY, END_ID, BLOCK = 2048, 1, 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Sequences of rests that met no full block in their partition are numbered from here.
LATE = 1 << 60

#: Texts of these characters alone are split alike by both libraries; others take the slower one.
_PLAIN = re.compile("[\x00-ɏ‐-‧€]*\\Z")


class Encoder:
    """Ids as ``tokenizers`` gives them for a vocabulary file, special strings of
    the file included.  With the same vocabulary as ranks, texts of plain
    characters are encoded several times faster to the same ids."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and _PLAIN.match(text) and not (self.special and self.special.search(text)):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(2)
def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One for each vocabulary in a worker process, whatever the number of its tasks."""
    return Encoder(path, ranks, pattern)


def differencing(sizes: list[int], k: int) -> tuple[list[list[int]], int]:
    """Items dealt to k windows, and the largest sum.  Partial partitions with the
    widest spread are merged first, the largest sums of the one upon the smallest
    of the other.  Sums that are still zero are not stored."""
    n = len(sizes)
    left, right = np.full(16 * n + 8, -1, np.int64), np.full(16 * n + 8, -1, np.int64)
    nodes = n
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:
            if nodes + over > len(left):
                left, right = (np.concatenate([z, np.full(max(len(z), over), -1, np.int64)]) for z in (left, right))
            made = np.arange(nodes, nodes + over)
            left[made], right[made] = x[len(x) - over :], y[len(y) - over :][::-1]
            nodes += over
            s = np.concatenate([a[: len(a) - over], b[: len(b) - over], a[len(a) - over :] + b[len(b) - over :][::-1]])
            z = np.concatenate([x[: len(x) - over], y[: len(y) - over], made])
        else:
            s, z = np.concatenate([a, b]), np.concatenate([x, y])
        order = np.argsort(-s, kind="stable")
        s, z = s[order], z[order]
        tie += 1
        heapq.heappush(heap, (-int(s[0] - (s[-1] if len(s) == k else 0)), tie, s, z))
    if not heap:
        return [], 0
    _, _, s, z = heap[0]
    out = []
    for root in z.tolist():
        stack, items = [root], []
        while stack:
            v = stack.pop()
            if v < n:
                items.append(v)
            else:
                stack += [int(right[v]), int(left[v])]
        out.append(items)
    return out, int(s[0])


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their count starts at the least
    possible and rises whenever the largest sum exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while sizes:
        out, most = differencing(sizes, k)
        if most <= capacity:
            return out
        k += 1 + k // 200
    return []


def placed(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(item, window, offset) of each item."""
    out = []
    for k, group in enumerate(windows(sizes, capacity)):
        at = 0
        for i in group:
            out.append((i, k, at))
            at += sizes[i]
    return out


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document's ids (its end id included).

    Each document fills whole windows with full pieces; the rest, shorter than a
    window, is cut into equal pieces of at most a quarter of a window, which go to
    windows shared with other rests of their block of ``block`` rests.  Blocks are filled
    in each partition; the rests left over there are numbered through all partitions and make
    blocks of their own, so that one block in all is not full, however the input is partitioned.
    Texts are read once and never shuffled; of the rests left over, less than a block a
    partition, sizes and checksums are.  Memory is bounded by a block; a task that
    runs again gives the same rows.  Sequence ids of the first kind hold the partition in their upper bits.

    A null text is an empty one and yields its end id; repeated documents are
    packed each time; very long texts are encoded whole; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer, ranks, pattern), TaskContext.get().partitionId()
        sequence = part << 36
        full: list[tuple] = []
        rests: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*full)) if full else [()] * 9
            full.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [*NAMES, "part", "nth"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                cuts = list(range(0, n, capacity))
                if (rest := n - cuts[-1]) < capacity:
                    parts, at = -(-4 * rest // capacity), cuts[-1]
                    cuts += [at + rest * j // parts for j in range(1, parts)]
                for s, e in zip(cuts, [*cuts[1:], n]):
                    row = (doc, s, e - s, zlib.crc32(ids[s:e].tobytes()), n)
                    if e - s == capacity:
                        full.append((*row, sequence, 0, None, None))
                        sequence += 1
                        continue
                    rests.append(row)
                    if len(rests) == block:
                        for i, k, at in placed([r[2] for r in rests], capacity):
                            full.append((*rests[i], sequence + k, at, None, None))
                        sequence, rests = sequence + block, []
            if len(full) >= 4096:
                yield batch()
        full += [(*r, None, None, part, k) for k, r in enumerate(rests)]
        yield batch()

    def deal(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("nth", "ascending")])
        at = placed(t["length"].to_pylist(), capacity)
        t = t.take(pa.array([i for i, *_ in at], pa.int64()))
        first = LATE + t["block"][0].as_py() * block
        cols = {"sequence_id": pa.array([first + k for _, k, _ in at], pa.int64()), "offset": pa.array([o for *_, o in at], pa.int64())}
        return pa.table([cols[c] if c in cols else t[c] for c in NAMES], NAMES)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(texts.mapInArrow(run, f"{SCHEMA}, part long, nth long"), "pieces")
    left = pieces.where("part is not null")
    first, blocks = 0, []
    for r in left.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        blocks.append((r.part, first))
        first += r.n
    firsts = spark.createDataFrame(blocks, "part long, first long")
    late = left.join(F.broadcast(firsts), "part").withColumn("block", F.expr(f"(first + nth) div {block}"))
    return pieces.where("part is null").select(*NAMES).union(late.groupBy("block").applyInArrow(deal, SCHEMA))
