"""Document fingerprints by consistent weighted sampling of their words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm import textscan
from folioscan.llm.common import written

#: Samples of a fingerprint; words of more bytes than LONG count as their windows of WINDOW bytes,
#: so that texts without spaces have many terms too; terms sampled at a time.
SAMPLES, LONG, WINDOW, PIECE = 128, 40, 12, 1 << 19
_U64 = np.uint64


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the lowest 23 bits."""
    return ((bits & _U64(0x7FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)


def terms(arr: pa.Array, lo: int, hi: int, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every term of texts lo to hi, A-Z lower-cased, in order of texts."""
    part = textscan.LOWER[raw[offsets[lo] : offsets[hi]]]
    start, end, first = textscan.words(part, offsets[lo : hi + 1])
    text = np.repeat(np.arange(hi - lo), np.diff(first))
    size = end - start
    long = size > LONG
    if long.any():
        n = size[long] - WINDOW + 1
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(start[long], n) + inside
        start, end = np.concatenate([start[~long], at]), np.concatenate([end[~long], at + WINDOW])
        text = np.concatenate([text[~long], np.repeat(text[long], n)])
    return text, textscan.word_hashes(part, start, end)


def draws(term: np.ndarray, log_weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(log a, t) of the k-th sample for terms with the logarithms of their weights: r and c are gamma
    variables of shape two, b is uniform, all three given by the term and k alone;
    t = floor(log_weight / r + b), and log a = log c - r * (t - b + 1).  The term with the least a,
    with its t, is the sample."""
    h = textscan.mix(term + _U64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
    g = textscan.mix(h + _U64(0xA0761D6478BD642F))
    b = ((h >> _U64(46)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-18)
    r = -np.log(_uniform(h) * _uniform(h >> _U64(23)))
    c = -np.log(_uniform(g) * _uniform(g >> _U64(23)))
    t = np.floor(log_weight / r + b)
    return np.log(c) - r * (t - b + np.float32(1)), t


def signatures(arr: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) of 16 bits: two texts agree in a sample with the probability of their
    generalised Jaccard similarity (the sum over terms of the smaller count by the sum of
    the greater one), but for one chance in 65,536.  Texts without terms have only zeros.

    The weight of a term is how often it occurs.  Equal (term, count) pairs of a run of texts
    are drawn once; ties go to the smaller hash, so a text's samples don't depend on its neighbours.
    """
    raw, offsets, _ = textscan.buffers(arr)
    out = np.zeros((len(offsets) - 1, samples), np.uint16)
    for lo, hi in textscan.runs(offsets, 4 * textscan.RUN_BYTES):
        text, h = terms(arr, lo, hi, raw, offsets)
        if not len(h):
            continue
        name, which = np.unique(h, return_inverse=True)
        pair, count = np.unique(text * len(name) + which, return_counts=True)
        text, which = pair // len(name), pair % len(name)
        least = np.full((hi - lo, samples), np.uint32(0xFFFFFFFF))
        for a in range(0, len(pair), PIECE):
            t_, w_, c_ = text[a : a + PIECE], which[a : a + PIECE], count[a : a + PIECE]
            most = int(c_.max()) + 1
            drawn, back = np.unique(w_ * most + c_, return_inverse=True)
            term, log_weight = name[drawn // most], np.log((drawn % most).astype(np.float32))
            begin = np.flatnonzero(np.diff(t_, prepend=-1))
            here, nth = t_[begin], np.arange(len(drawn), dtype=np.uint64)
            for k in range(samples):
                log_a, t = draws(term, log_weight, k)
                bits = log_a.view(np.uint32)
                bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
                best = np.minimum.reduceat((bits.astype(np.uint64) << _U64(32) | nth)[back], begin)
                value, at = (best >> _U64(32)).astype(np.uint32), (best & _U64(0xFFFFFFFF)).astype(np.int64)
                sample = textscan.mix(term[at] + textscan.mix(t[at].astype(np.uint64) + _U64(k)))
                better = value < least[here, k]
                least[here[better], k] = value[better]
                out[lo + here[better], k] = np.maximum(sample[better] >> _U64(48), _U64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of samples in which rows agree; texts without terms are like one another and nothing else."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many of what follows it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
DONE = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: Rows of a partition: finished ones; its first (``edge`` 1) and its last one (2), whose text goes along.
ROWS = pa.schema([*DONE, ("edge", pa.int32()), ("part", pa.int32()), ("text", pa.string())])


def _finished(ids: list, texts: list[str], own: np.ndarray, new: list[str], sig: np.ndarray, after: np.ndarray) -> dict:
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
        "fingerprint": [x.tobytes() for x in own], "edited_fingerprint": [x.tobytes() for x in sig], "near_edited": likeness(own, sig), "near_next": likeness(own, after),
    }


def _table(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = len(cols["doc_id"])
    return pa.RecordBatch.from_arrays([pa.array(cols.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each waits for the one that follows it.  Texts are sampled beside their edited
    forms, which have nearly the same terms, so that those are drawn once."""
    part, held = TaskContext.get().partitionId(), None
    for b in batches:
        if not b.num_rows:
            continue
        ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
        waiting = [*held[1:2], *texts] if held else texts
        new = [edited(t, u) for t, u in zip(waiting, waiting[1:])]
        both = signatures(pa.array([x for pair in zip(texts, [*new, ""][: len(texts)]) for x in pair], pa.large_string()))
        own, sig = both[::2], both[1::2][: len(new)]
        if held:
            ids, own = [held[0], *ids], np.vstack([held[2], own])
        else:
            yield _table({"doc_id": ids[:1], "edge": [1], "part": [part], "text": texts[:1], "fingerprint": [own[0].tobytes()]}, ROWS)
        if new:
            yield _table(_finished(ids[:-1], waiting[:-1], own[:-1], new, sig, own[1:]), ROWS)
        held = ids[-1], texts[-1], own[-1:]
    if held:
        yield _table({"doc_id": [held[0]], "edge": [2], "part": [part], "text": [held[1]], "fingerprint": [held[2].tobytes()]}, ROWS)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of partitions with the first ones of the next."""
    for b in batches:
        ids, texts, own, following, after = (b.column(i).to_pylist() for i in range(5))
        own, after = (np.frombuffer(b"".join(x), np.uint16).reshape(len(ids), -1) for x in (own, after))
        if ids:
            new = [edited(t, u) for t, u in zip(texts, following)]
            yield _table(_finished(ids, texts, own, new, signatures(pa.array(new, pa.large_string())), after), DONE)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (see ``edited``), and how like the edited
    text and the next document are: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).

    The next document is that of the next id (null first; of equal ids, in the order of a
    hash of the text); after the last comes the first, so a single document follows itself.  Texts are
    dealt by ranges of ids once; each task goes through its range in order, and the
    partitions' last rows meet the next ones' first.  Words are separated by ASCII white space.
    A null text is an empty one; texts without words have a fingerprint of zeros, like each
    other (1) and unlike all else (0).  Repeated rows are rows of their own; very long texts are sampled
    whole, PIECE terms at a time; an empty table gives no rows; other columns take no part.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    out = written(rows.mapInArrow(_neighbours, f"{FIELDS}, edge int, part int, text string"), "fingerprints", (1024, "4m"))
    parts = sorted(r.part for r in out.where("edge = 1").select("part").collect())
    after = spark.createDataFrame([(p, q) for p, q in zip(parts, [*parts[1:], *parts[:1]])], "part int, following int")
    first = out.where("edge = 1").select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = out.where("edge = 2").join(after, "part").join(first, "following").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    whole = out.where("edge is null").select(*DONE.names).unionByName(last.mapInArrow(_met, FIELDS))
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
