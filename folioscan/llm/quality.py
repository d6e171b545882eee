"""Quality scores: random Fourier features of document statistics, ridge, isotonic."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm import textscan
from folioscan.llm.common import written
from folioscan.llm.langid import remainder

N_FOURIER, FOLDS, BINS, PARTIALS, SEED = 256, 3, 2048, 16, 7
RIDGE = [1e-5, 1e-4, 1e-3, 1e-2, 1e-1]

_CLASS = np.zeros((256, 11), np.float64)
for _i, _chars in enumerate([
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n",
    ".,;:?'\"-()", "!", "#$%&*", "|<>=_~^@{}[]\\/+`",
]):
    _CLASS[[ord(c) for c in _chars], _i] = 1
_CLASS[128:, 9] = 1
_CLASS[:32, 10] = 1
N_STATS = 11 + 14


def statistics(arr: pa.Array) -> np.ndarray:
    """(texts, N_STATS): shares of byte classes, entropy, and measures of words
    and lines, of each whole text; a null or empty text gives zeros."""
    raw, offsets, _ = textscan.buffers(arr)
    out = np.zeros((len(offsets) - 1, N_STATS))
    for lo, hi in textscan.runs(offsets, 1 << 19):
        part = raw[offsets[lo] : offsets[hi]]
        off = offsets[lo : hi + 1] - offsets[lo]
        start, end, first = textscan.words(part, offsets[lo : hi + 1])
        h = textscan.word_hashes(part, start, end)
        size = (end - start).astype(np.float64)
        lead = part[start] if len(start) else part[:0]
        tail = part[end - 1] if len(end) else part[:0]
        capital = (lead >= 65) & (lead <= 90)
        odd_tail = ~(((tail | 32) >= 97) & ((tail | 32) <= 122) | (tail >= 128))
        line = np.flatnonzero(part == 10)
        for i in range(hi - lo):
            s, e = off[i], off[i + 1]
            if e == s:
                continue
            hist = np.bincount(part[s:e], minlength=256).astype(np.float64)
            n, row = float(e - s), out[lo + i]
            row[:11] = hist @ _CLASS / n
            p = hist[hist > 0] / n
            row[11] = -(p * np.log(p)).sum() / 5
            row[12] = np.log1p(n) / 10
            a, b = first[i], first[i + 1]
            if b > a:
                m, w, hw = float(b - a), size[a:b], h[a:b]
                row[13] = np.log1p(m) / 8
                row[14] = min(w.mean() / 10, 5)
                row[15] = min(w.std() / 10, 5)
                _, times = np.unique(hw, return_counts=True)
                row[16] = len(times) / m
                row[17] = times.max() / m
                row[18] = capital[a:b].mean()
                row[19] = odd_tail[a:b].mean()
                row[20] = (w <= 2).mean()
                row[21] = (w >= 12).mean()
                if b - a > 1:
                    row[22] = len(np.unique(hw[1:] * np.uint64(3) + hw[:-1])) / (m - 1)
            cuts = line[np.searchsorted(line, s) : np.searchsorted(line, e)]
            lines = np.concatenate([[s], cuts + 1, [e + 1]])
            lines = [part[x : y - 1].tobytes() for x, y in zip(lines[:-1], lines[1:]) if y - 1 > x]
            row[23] = len(set(lines)) / max(1, len(lines))
            row[24] = np.log1p(n / max(1, len(lines))) / 8
    return out


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def measured(text: pa.Array) -> pa.Array:
        s = statistics(text).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * N_STATS, pa.int32()), pa.array(s.ravel()))

    return measured(text)


def _matrix(arr: pa.Array) -> np.ndarray:
    return np.asarray(arr.flatten(), np.float64).reshape(-1, N_STATS)


@dataclass
class Fourier:
    """cos(x W + b) of standardised statistics, with a constant."""

    mean: np.ndarray
    scale: np.ndarray

    def __post_init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.w = rng.normal(size=(N_STATS, N_FOURIER)) / (0.8 * N_STATS**0.5)
        self.b = rng.uniform(0, 2 * np.pi, N_FOURIER)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * (2 / N_FOURIER) ** 0.5, np.ones((len(z), 1))])


@dataclass
class Model:
    fourier: Fourier
    weights: np.ndarray
    xs: np.ndarray
    ys: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.fourier(stats) @ self.weights, self.xs, self.ys), 0.0, 1.0)


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means of y (weights n) over ascending x, as points to interpolate:
    the mean x and the mean y of each pooled block."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    m = np.array(blocks)
    return m[:, 0] / m[:, 2], m[:, 1] / m[:, 2]


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """stats: doc_id and stats of every document.  All labelled rows whose
    crc32(doc_id) mod 4 is not 2 count (repeated labels by their mean).

    Each partition sums the normal equations of its rows by fold; the sums meet
    in PARTIALS streams and so at most PARTIALS * FOLDS matrices reach the driver
    at any size of input.  The ridge is chosen by the error on the fold left out,
    which the sums give without another pass; scores of left-out rows, counted in
    BINS bins, are pooled for the isotonic map.  Without labels, or with one
    value alone, the score is a constant."""
    y = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(FOLDS)).cast("int")
    rows = written(stats.where(remainder() != 2).join(y, "doc_id").select("stats", "y", fold.alias("fold")), "labelled")
    s = lambda i: F.col("stats")[i].cast("double")
    got = rows.agg(F.count(F.lit(1)), F.avg("y"), *[F.avg(s(i)) for i in range(N_STATS)], *[F.stddev_pop(s(i)) for i in range(N_STATS)]).first()
    if not got[0]:
        return Model(Fourier(np.zeros(N_STATS), np.ones(N_STATS)), np.zeros(N_FOURIER + 1), np.array([0.0]), np.array([0.5]))
    fourier = Fourier(np.array(got[2 : 2 + N_STATS]), np.maximum(np.array(got[2 + N_STATS :]), 1e-3))
    d = N_FOURIER + 2  # features, constant, label

    def pack(sums: np.ndarray) -> pa.RecordBatch:
        keep = [f for f in range(FOLDS) if sums[f].any()]
        return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([sums[f].tobytes() for f in keep], pa.binary())], ["fold", "m"])

    def partition_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, d, d))
        for b in batches:
            x = np.hstack([fourier(_matrix(b.column(0))), np.asarray(b.column(1))[:, None]])
            f = np.asarray(b.column(2))
            for k in range(FOLDS):
                sums[k] += x[f == k].T @ x[f == k]
        yield pack(sums)

    def stream_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, d, d))
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1)):
                sums[k] += np.frombuffer(m.as_py()).reshape(d, d)
        yield pack(sums)

    total = np.zeros((FOLDS, d, d))
    for r in rows.mapInArrow(partition_sums, "fold int, m binary").repartition(PARTIALS).mapInArrow(stream_sums, "fold int, m binary").collect():
        total[r.fold] += np.frombuffer(bytes(r.m)).reshape(d, d)

    def solve(t: np.ndarray, ridge: float) -> np.ndarray:
        a = t[:-1, :-1] + ridge * t[-2, -2] * np.diag([*[1.0] * (d - 2), 1e-9])
        return np.linalg.lstsq(a, t[:-1, -1], rcond=None)[0]

    everything = total.sum(0)
    loss = []
    for ridge in RIDGE:
        loss.append(0.0)
        for k in range(FOLDS):
            w = np.append(solve(everything - total[k], ridge) if (everything - total[k])[-2, -2] > 0 else np.zeros(d - 1), -1.0)
            loss[-1] += float(w @ total[k] @ w)
    ridge = RIDGE[int(np.argmin(loss))]
    apart = np.stack([solve(everything - total[k], ridge) if (everything - total[k])[-2, -2] > 0 else np.zeros(d - 1) for k in range(FOLDS)], 1)

    @F.arrow_udf("int")
    def bin_of(x: pa.Array, f: pa.Array) -> pa.Array:
        f = np.asarray(f)
        raw = (fourier(_matrix(x)) @ apart)[np.arange(len(f)), f]
        return pa.array(np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int32))

    bins = rows.select(bin_of("stats", "fold").alias("bin"), "y").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    xs, ys = pool_adjacent(*(np.array(c, float) for c in zip(*[((r.bin + 0.5) * 2 / BINS - 0.5, r.y, r.n) for r in bins])))
    return Model(fourier, solve(everything, ridge), xs, ys)


def scorer(model: Model) -> Callable[[Column], Column]:
    """A column function statistics -> score in 0 to 1."""

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(x)) if len(x) else [], pa.float64())

    return score


def stats_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row, written: one pass over the texts."""
    return written(docs.select(F.col(id_col).alias("doc_id"), statistics_column(F.col(text_col)).alias("stats")), "stats", (1024, "4m"))


def score_all(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.  Texts are read once, for
    their statistics; null and empty texts have those of an empty text; a null id
    is not held out; repeated rows and clashing other columns do not matter."""
    stats = stats_of(docs, id_col, text_col)
    score = scorer(fit(stats, labels))
    out = stats.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), score(F.col("stats")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, min_score: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, that score at least ``min_score`` by a model
    fitted on the labels of these rows.  Texts are measured for the fit and once more where
    rows are kept, which costs less than a copy of all texts beside their statistics.
    Null and empty texts score as an empty text; repeated rows go or stay together;
    without labels every score is 0.5; an empty table stays empty."""
    model = fit(stats_of(docs, id_col, text_col), labels)
    return docs.where(scorer(model)(statistics_column(docs[text_col])) >= min_score)
