"""Sequence ratios: the one measure that built-in functions lack, in pandas batches."""

from __future__ import annotations

import functools
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP, _SPACES = re.compile(r"[^A-Z0-9.\s]"), re.compile(r"\s+")
TITLE_LINES, TITLE_CHARS = 12, 400


@functools.lru_cache(maxsize=1 << 14)
def _name(text: str) -> str:
    return normalised(text)


def normalised(text: str) -> str:
    return _SPACES.sub(" ", _KEEP.sub(" ", text.upper())).strip()


def ratio(a: str | None, b: str | None) -> float:
    """Similarity of two texts after normalisation; none if either is empty."""
    return SequenceMatcher(None, normalised(a), normalised(b)).ratio() if a and b else 0.0


class Opener:
    """A page's first lines and first characters, normalised once for all names they are compared with."""

    def __init__(self, opener: list[str] | None):
        lines = list(opener) if opener is not None else []
        shown = [x for x in [*lines[:TITLE_LINES], " ".join(lines)[:TITLE_CHARS]] if x]
        self.texts = sorted({normalised(x) for x in shown}, key=len)
        self.matchers: dict[str, SequenceMatcher] = {}

    def match(self, name: str | None) -> float:
        """Best ratio of a chapter name to one of them.  Two lengths bound a ratio, so texts that cannot be better are not compared."""
        best, a = 0.0, _name(name or "")
        if not name:
            return best
        for b in sorted(self.texts, key=lambda b: abs(len(a) - len(b))):
            if not a and not b:
                return 1.0
            if 2 * min(len(a), len(b)) > best * (len(a) + len(b)):
                if b not in self.matchers:
                    self.matchers[b] = SequenceMatcher(None, "", b)
                m = self.matchers[b]
                m.set_seq1(a)
                if m.quick_ratio() > best:
                    best = max(best, m.ratio())
        return best


def title_match(name: str | None, opener: list[str] | None) -> float:
    """Best ratio of a chapter name to the first lines or the first characters of a page's opener."""
    return Opener(opener).match(name)


def ratio_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype=float)

    return f(a, b)


def ratios_column(texts: Column, name: Column) -> Column:
    """Ratio of each of an array of texts to a name, as they stand."""

    @F.pandas_udf("array<double>")
    def f(texts: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([[SequenceMatcher(None, x, n).ratio() for x in t] for t, n in zip(texts, name)], dtype=object)

    return f(texts, name)


def title_match_column(name: Column, opener: Column) -> Column:
    """title_match of each row; rows of one page that follow one another share its opener."""

    @F.pandas_udf("double")
    def f(name: pd.Series, opener: pd.Series) -> pd.Series:
        out, last, page = [], None, Opener(None)
        for n, o in zip(name, opener):
            lines = [] if o is None else list(o)
            if lines != last:
                last, page = lines, Opener(lines)
            out.append(page.match(n))
        return pd.Series(out, dtype=float)

    return f(name, opener)
