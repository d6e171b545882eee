"""Language identification: the family first, then pairwise linear SVMs within it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm import textscan
from folioscan.session import ship

#: Families of ISO 639-1 codes (fixed values); any other code is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}
UNKNOWN = "und"
BIGRAM_BITS, TRIGRAM_BITS = 10, 11
DIMS = (1 << BIGRAM_BITS) + (1 << TRIGRAM_BITS)
#: Rows fitted on: PER_LANGUAGE of a language, SAMPLE in all; more languages than MAX_LANGUAGES are an error.
PER_LANGUAGE, SAMPLE, MAX_LANGUAGES = 400, 4000, 200
#: Scores below this are no evidence of a language: two decisions near chance give 0.25, and
#: the lowest of 1000 labelled documents at sf0.01, one word long, scores 0.41.
MIN_SCORE = 0.35
_LETTERISH = np.full(256, 0x20, np.uint8)
_LETTERISH[97:123] = np.arange(97, 123)
_LETTERISH[128:] = np.arange(128, 256)
_LETTERISH[65:91] = np.arange(97, 123)


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), lang)


def features(arr: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows, in order: square roots of the shares of hashed byte bigrams
    and trigrams of each whole text, A-Z lower-cased, other ASCII as spaces."""
    raw, offsets, _ = textscan.buffers(arr)
    for lo, hi in textscan.runs(offsets, 1 << 18):
        b = _LETTERISH[raw[offsets[lo] : offsets[hi]]].astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0xC2B2AE3D)
        two = two * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BIGRAM_BITS)
        three = three * np.uint32(0x297A2D39) >> np.uint32(32 - TRIGRAM_BITS)
        off = offsets[lo : hi + 1] - offsets[lo]
        out = np.zeros((hi - lo, DIMS), np.float32)
        for i, (s, e) in enumerate(zip(off[:-1], off[1:])):
            if e - s >= 2:
                out[i, : 1 << BIGRAM_BITS] = np.bincount(two[s : e - 1], minlength=1 << BIGRAM_BITS)
            if e - s >= 3:
                out[i, 1 << BIGRAM_BITS :] = np.bincount(three[s : e - 2], minlength=1 << TRIGRAM_BITS)
            out[i] /= max(1, 2 * (e - s))
        yield np.sqrt(out, out=out)


def svm(x: np.ndarray, y: np.ndarray, c: float = 30.0, rounds: int = 200) -> np.ndarray:
    """Weights and bias of the L2-regularised squared-hinge linear SVM (y is +-1),
    classes weighted equally, by accelerated full gradients."""
    n = len(y)
    weight = np.where(y > 0, n / 2 / max(1, (y > 0).sum()), n / 2 / max(1, (y < 0).sum())) * c / n
    x1 = np.hstack([x, np.ones((n, 1), x.dtype)])
    scale = np.einsum("ij,ij->i", x1, x1)
    step = 1.0 / (1.0 + 2.0 * float((weight * scale).sum()))
    w = np.zeros(x1.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v.astype(x1.dtype)))
        grad = v - 2 * (x1.T @ (weight * slack * y).astype(x1.dtype))
        grad[-1] -= v[-1]
        new = v - step * grad
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w.astype(np.float32)


@dataclass
class Model:
    """families: languages of each; weights: one column per binary machine."""

    families: dict[str, list[str]] = field(default_factory=dict)
    root: list[tuple[str, str]] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def predict(self, arr: pa.Array, lettered: np.ndarray) -> tuple[list[str], np.ndarray]:
        langs, scores = [], []
        for x in features(arr):
            got = self._block(x)
            langs += got[0]
            scores.append(got[1])
        score = np.concatenate(scores) if scores else np.zeros(0)
        return [a if ok else UNKNOWN for a, ok in zip(langs, lettered)], np.where(lettered, score, 0.0)

    def _block(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        margin = x @ self.weights[:-1] + self.weights[-1]
        sure = 1 / (1 + np.exp(-4.0 * margin.astype(np.float64)))
        fam, p_fam = _vote(list(self.families), self.root, sure[:, : len(self.root)])
        langs, score = np.empty(n, object), np.zeros(n)
        at = len(self.root)
        for f, members in self.families.items():
            own = [p for p in self.pairs if p[0] in members]
            rows = np.flatnonzero(fam == f)
            who, p = _vote(members, own, sure[rows, at : at + len(own)])
            langs[rows], score[rows] = who, p * p_fam[rows]
            at += len(own)
        return langs.tolist(), score


def _vote(names: list[str], pairs: list[tuple[str, str]], sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-one: most pairwise wins, then the largest summed certainty, then
    the first name; and the mean certainty of the winner's pairs."""
    n, k = len(sure), len(names)
    if k == 1:
        return np.full(n, names[0], object), np.ones(n)
    wins, total = np.zeros((n, k)), np.zeros((n, k))
    for j, (a, b) in enumerate(pairs):
        ia, ib = names.index(a), names.index(b)
        wins[:, ia] += sure[:, j] >= 0.5
        wins[:, ib] += sure[:, j] < 0.5
        total[:, ia] += sure[:, j]
        total[:, ib] += 1 - sure[:, j]
    best = np.argmax(wins + total / (k + 1), axis=1)
    return np.array(names, object)[best], total[np.arange(n), best] / (k - 1)


def train(x: np.ndarray, langs: list[str]) -> Model:
    names = sorted(set(langs))
    families: dict[str, list[str]] = {}
    for name in names:
        families.setdefault(family_of(name), []).append(name)
    families = dict(sorted(families.items()))
    lang, fam = np.array(langs, object), np.array([family_of(a) for a in langs], object)
    root = list(combinations(families, 2))
    pairs = [p for members in families.values() for p in combinations(members, 2)]
    columns = []
    for of, couples in ((fam, root), (lang, pairs)):
        for a, b in couples:
            rows = np.flatnonzero((of == a) | (of == b))
            columns.append(svm(x[rows], np.where(of[rows] == a, 1.0, -1.0)))
    weights = np.stack(columns, 1) if columns else np.zeros((DIMS + 1, 0), np.float32)
    return Model(families, root, pairs, weights)


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Fits on labelled rows whose crc32(id) mod 4 is not 2: for each language, of its
    distinct texts min(per_language, sample // languages) drawn by a hash of id and
    text, so at most ``sample`` rows reach the driver, as features.  Rows with null
    language, id or text do not count; repeated rows count once; without any, all
    texts are ``und``.  Every language is drawn from; more than MAX_LANGUAGES of them
    raise ValueError, since each pair within a family is a machine of its own."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null").where(remainder("k") != 2)
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(count) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_col}")
    if not count:
        return Model()
    each = max(1, min(per_language, sample // len(count)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [v.tobytes() for block in features(b.column(1)) for v in block.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.binary())], ["lang", "x"])

    def drawn(part: dict[str, float]) -> list[tuple[str, bytes]]:
        """Features of the texts of these languages with the least hashes, out of about these shares."""
        share = F.lit(0)
        for lang, p in part.items():
            share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, p) * (1 << 31)))).otherwise(share)
        t = rows.withColumn("h", F.pmod(F.xxhash64("k", "text"), F.lit(1 << 31))).where(F.col("h") < share)
        t = t.groupBy("lang", F.xxhash64("text").alias("same")).agg(F.min_by("text", "h").alias("text"), F.min("h").alias("h"))
        t = t.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "same"))).where(F.col("nth") <= each)
        return [(r.lang, bytes(r.x)) for r in t.select("lang", "text").mapInArrow(run, "lang string, x binary").collect()]

    got = drawn({lang: 2 * each / n for lang, n in count.items()})
    if few := {lang: 1.0 for lang in count if lang not in {a for a, _ in got}}:  # many rows, but few that differ
        got += drawn(few)
    got.sort()
    x = np.stack([np.frombuffer(v, np.float16) for _, v in got]).astype(np.float32)
    return train(x, [a for a, _ in got])


def predictor(model: Model) -> Callable[[Column], Column]:
    """A column function text -> struct(lang_pred, score); the text is all it sees."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(text: pa.Array, lettered: pa.Array) -> pa.Array:
        lang, score = model.predict(text, np.asarray(lettered, bool))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return lambda text: predict(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, in one pass without a
    shuffle.  A null text or one without a letter is ``und`` with score 0; a null
    id is not held out; repeated rows and clashing other columns do not matter."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    said = rows.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), predictor(model)(F.col("text")).alias("p"))
    return said.select("doc_id", "held_out", "p.lang_pred", "p.score")


def spoken(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, all columns kept, whose text is in a language: it has a letter and
    its predicted language scores at least ``min_score``.  Null, empty and letterless texts
    go.  A model of no language rejects only those.  Repeated rows go or stay together;
    very long texts count whole; an empty table stays empty; other columns are not looked at."""
    ship(docs.sparkSession)
    text = docs[text_col]
    if not model.families:
        return docs.where(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    said = predictor(model)(text)
    return docs.where((said.lang_pred != UNKNOWN) & (said.score >= min_score))
