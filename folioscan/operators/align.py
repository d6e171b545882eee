"""Aligning chapters of a table of contents to pages."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import fuzzy
from folioscan.functions import text as T

log = logging.getLogger(__name__)

TOP_K, WINDOW, MARGIN, W_STRUCTURE, MAX_SHOWN = 15, 30, 0.18, 0.85, 8
#: Names of front matter that are not aligned (fixed values).
FRONT_MATTER = [
    "foreword", "preface", "acknowledgement", "acknowledgements", "a note for the teacher", "note for the teacher", "rationalisation",
    "rationalisation of content", "textbook development committee", "the constitution of india",
]
#: Beginnings of first lines that speak against a chapter start (fixed values).
NEGATIVE = ["EXERCISE", "MISCELLANEOUS EXERCISE", "SUMMARY", "CONTENTS", "FOREWORD", "PREFACE", "ACKNOWLEDGEMENT", "ACKNOWLEDGEMENTS", "RATIONALISATION", "APPENDIX", "ANSWERS"]
#: Dashes before the name under a quotation, in the encoding in which they are met (fixed values).
QUOTE_DASHES = [" - ", " â€” ", " â€“ "]
WEIGHTS = {
    "title_match": 0.30, "chapter_number": 0.20, "section_start": 0.16, "introduction": 0.10, "objectives_marker": 0.20,
    "quote_marker": 0.08, "uppercase_heading": 0.08, "negative_marker": -0.55, "exercise_marker": -0.45,
}


def alignable(name: Column) -> Column:
    return (T.strip(F.coalesce(name, F.lit(""))) != "") & ~F.lower(T.strip(name)).isin(FRONT_MATTER)


def query_text(number: Column, name: Column) -> Column:
    n = T.strip(F.coalesce(number, F.lit("?")))
    return F.concat(F.when(n.rlike(r"(?U)^\d+$"), "Chapter ").otherwise("CHAPTER "), n, F.lit(" "), name)


def anchor_window(previous: Column, toc: Column, total: Column) -> tuple[Column, Column]:
    """First and last page of the window that is always considered."""
    near_toc = (toc > 0) & (toc <= total) & (toc <= 0.8 * total)
    low = F.when(previous > 0, previous + 1).when(near_toc, F.greatest(F.lit(1), toc - 5)).otherwise(1)
    high = F.when(previous > 0, F.least(total, previous + WINDOW)).when(near_toc, F.least(total, toc + WINDOW)).otherwise(F.least(total, F.lit(WINDOW)))
    return low, high


def page_features(pages: DataFrame, keep: list[str]) -> DataFrame:
    """What a page's text says by itself, once a page: ``keep`` and lines (the first 20),
    opener, tokens and sections (numbers like 2.1) of the opener, and the six signals that need no chapter."""
    up = F.col("first_up")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    starts = lambda words: F.lit(False) if not words else up.startswith(words[0]) | starts(words[1:])
    letters, upper = (F.length(F.regexp_replace("first", rx, "")) for rx in (r"\P{L}", r"\P{Lu}"))
    quoted = F.exists(F.slice("lines", 2, 3), lambda x: x.startswith("v ") | x.startswith("V ") | x.contains(QUOTE_DASHES[0]) | x.contains(QUOTE_DASHES[1]) | x.contains(QUOTE_DASHES[2]))
    p = pages.select(*keep, F.slice(T.solid_lines(F.coalesce("text", F.lit(""))), 1, 20).alias("lines"))
    p = p.withColumns({"first": F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")), "opener": T.normalise(F.array_join("lines", " "))})
    p = p.withColumn("first_up", T.normalise(F.col("first")))
    return p.select(
        *keep, "lines", "opener", F.split("opener", "[. ]+").alias("tokens"), F.regexp_extract_all("opener", F.lit(r"(?U)(?=\b(\d+\.\d+)\b)"), F.lit(1)).alias("sections"),
        one(F.contains("opener", F.lit("INTRODUCTION"))).alias("introduction"), one(F.contains("opener", F.lit("OBJECTIVES")) | F.contains("opener", F.lit("AFTER STUDYING THIS UNIT"))).alias("objectives_marker"),
        one(quoted).alias("quote_marker"), F.when(letters > 0, upper / letters).otherwise(0.0).alias("uppercase_heading"), one(starts(NEGATIVE)).alias("negative_marker"),
        one(F.contains("opener", F.lit("EXERCISES")) | starts(["EXERCISE", "MISCELLANEOUS EXERCISE"])).alias("exercise_marker"),
    )


def number_signals(number: Column, page: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """The two signals of a chapter's number on a page with page_features (``page`` gives
    its columns by name): membership, for numbers of letters and digits; other numbers
    are searched as they are."""
    n = T.strip(number.cast("string"))
    quoted = F.concat(F.lit("\\Q"), n, F.lit("\\E"))
    plain = F.arrays_overlap(page("tokens"), F.array(n, F.concat(n, F.lit("UNIT")), F.concat(F.lit("UNIT"), n)))
    said = F.when(n.rlike("^[A-Za-z0-9]+$"), plain).otherwise(F.regexp_like(page("opener"), F.concat(F.lit("(?U)\\b"), quoted, F.lit("\\b|\\b"), quoted, F.lit("\\s*UNIT\\b|\\bUNIT\\s*"), quoted, F.lit("\\b"))))
    section = F.when(F.array_contains(page("sections"), F.concat(n, F.lit(".1"))), 1.0).when(F.exists(page("sections"), lambda x: x.startswith(F.concat(n, F.lit(".")))), 0.5).otherwise(0.0)
    return {"chapter_number": F.when(said, 1.0).otherwise(0.0), "section_start": F.when(n.rlike(r"(?U)^\d+$"), section).otherwise(0.0)}


def weighed(signals: dict[str, Column]) -> Column:
    return sum((c * WEIGHTS[k] for k, c in signals.items()), F.lit(0.0))


def structural(pairs: DataFrame, pages: DataFrame, on: list[str], number: str = "chapter_number", name: str = "chapter_name") -> DataFrame:
    """Adds ``structural`` and ``signals`` (a map, structural_score with them) to (chapter, page)
    rows; a page that is missing or has no text scores 0 and has no signals.  pages: ``on``, text."""
    f = page_features(pages.where("text is not null"), on)
    f = f.select(*on, F.struct(*[c for c in f.columns if c not in on]).alias("__page"))
    joined = pairs.join(f, on, "left")
    page = lambda c: joined["__page"][c]
    signals = {k: page(k) for k in WEIGHTS if k not in ("title_match", "chapter_number", "section_start")} | number_signals(F.col(number), page)
    signals = {"title_match": fuzzy.title_match_column(F.col(name), page("lines"))} | signals
    named = joined.select(*pairs.columns, page("opener").isNotNull().alias("__there"), F.struct(*[c.alias(k) for k, c in signals.items()]).alias("__s"))
    score = F.when(F.col("__there"), weighed({k: F.col("__s")[k] for k in signals})).otherwise(0.0)
    named = named.withColumn("structural", score)
    packed = F.create_map(*[x for k in signals for x in (F.lit(k), F.round(F.col("__s")[k], 4))], F.lit("structural_score"), F.round("structural", 4))
    return named.select(*pairs.columns, "structural", F.when(F.col("__there"), packed).otherwise(F.create_map().cast("map<string,double>")).alias("signals"))


def rerank(scored: DataFrame) -> DataFrame:
    """Adds ``total`` to rows with score (hybrid), structural and signals, and both totals to the signals."""
    total = scored.withColumn("total", F.col("score") + W_STRUCTURE * F.col("structural"))
    more = F.create_map(F.lit("hybrid_score"), F.round("score", 4), F.lit("total_score"), F.round("total", 4))
    return total.withColumn("signals", F.map_concat("signals", more))


def decision(gap: Column, negative: Column) -> Column:
    """``best`` where the best page leads clearly and has no negative marker."""
    return F.when((gap >= MARGIN) & (negative == 0), "best").otherwise("resolver")


def repair_companion(chapters: DataFrame) -> DataFrame:
    """Start pages of books whose table of contents goes on into a second volume.

    chapters: book, pos, start_page (string), total_pages.  Only where some numeric
    starts lie within the book and some beyond: the latter move back to follow from
    1; the former go if the smallest of them is in the first quarter; chapters
    without a numeric start go as well.  Others stay as they are."""
    n = T.safe_int(F.col("start_page"))
    c = chapters.withColumn("n", n).withColumn("beyond", F.col("n") > F.col("total_pages"))
    w = "over (partition by book)"
    c = c.selectExpr("*", f"count_if(beyond) {w} as n_beyond", f"count_if(not beyond) {w} as n_within", f"min(case when beyond then n end) {w} as low_beyond", f"min(case when not beyond then n end) {w} as low_within")
    mixed = (F.col("n_beyond") > 0) & (F.col("n_within") > 0)
    companion = F.col("low_within") <= F.floor(F.col("total_pages") / 4)
    keep = ~mixed | (F.col("beyond") | (F.col("n").isNotNull() & ~companion))
    start = F.when(mixed & F.col("beyond"), F.col("n") - F.col("low_beyond") + 1).otherwise(F.col("n"))
    return c.where(keep).select("book", "pos", "total_pages", start.cast("int").alias("start_page"), (mixed & F.col("beyond")).alias("shifted"))


def chapter_ends(starts: DataFrame) -> DataFrame:
    """end_page: the page before the next start, the last page of the book at the end.
    starts: book, pos, start_page, total_pages."""
    return starts.selectExpr("*", "coalesce(lead(start_page) over (partition by book order by pos) - 1, total_pages) as end_page")


#: Characters of a page that a resolver is shown.
SNIPPET = 300


@dataclass
class Question:
    """What a resolver is asked: the page on which a chapter starts, of the best pages after ``after`` (0: of any).
    shown: (page, beginning of its text) of at most MAX_SHOWN pages, in the order of pages."""

    number: str | None
    name: str | None
    after: int
    shown: list[tuple[int, str]]

    def prompt(self) -> str:
        """The question for a chat model, which answers with a page number."""
        chapter = f'chapter {self.number}: "{self.name}"'
        parts = [f"On which of the pages below does {chapter} of a textbook start?", "A chapter starts on the page that shows its title or number as a heading, a motto with an introduction, or its objectives."]
        parts.append("Exercises, examples, solutions, summaries, contents and front matter start no chapter.")
        if self.after > 0:
            parts.append(f"The chapter before it starts on page {self.after}, so the number must be greater than {self.after}.")
        parts += [f"PAGE {page}:\n{text}" for page, text in self.shown]
        return "\n\n".join([*parts, f"Answer with the page number of the start of {chapter} and nothing else."])


def _choose(c: pd.DataFrame, after: int, resolver: Callable[[Question], int | str | None] | None, snippets: dict[int, str]) -> int:
    """A page of the candidates c (best first) after ``after``: the number that the resolver says
    first, if it is one of them, else the best of them; the best of all where none is after."""
    valid = c[c.page > after] if after > 0 else c
    if valid.empty:
        return int(c.page.iloc[0])
    if resolver:
        shown = [(p, snippets.get(p) or "(no text)") for p in sorted({int(p) for p in valid.page.iloc[:MAX_SHOWN]})]
        told = {k: c[k].iloc[0] if k in c else None for k in ("number", "name")}
        try:
            said = re.search(r"\d+", str(resolver(Question(told["number"], told["name"], after, shown))))
            if said and int(said[0]) in set(valid.page):
                return int(said[0])
        except Exception as e:  # whatever a model's client raises: the best page stands in
            log.warning("resolver failed: %s", e)
    return int(valid.page.iloc[0])


def snippet(text: str) -> Column:
    """The beginning of a page's text that a resolver is shown."""
    return F.substring(T.strip(F.col(text)), 1, SNIPPET)


def fold(candidates: DataFrame, openers: DataFrame | None = None, resolver: Callable[[Question], int | str | None] | None = None) -> DataFrame:
    """Picks a page for each chapter, in order.

    candidates: book, pos, page, hybrid, total, negative, toc_page, total_pages: the
    scores of all pages, which do not depend on one another.  Only membership does:
    a page takes part if it is among the TOP_K by hybrid or in the window after the
    last pick.  A clear lead decides, else the resolver, which is shown the best MAX_SHOWN pages (see ``Question``);
    starts that do not rise are then picked again from the pages after the one before.
    A chapter without candidates is left out.

    With ``openers`` (book, page, lines, and for a resolver snippet: see ``snippet``) candidates also have a
    name, and ``total`` lacks the share of title_match, which is compared only where a page takes part;
    ``number``, if candidates have it, is told to the resolver.  A null toc_page is an unknown one (0).
    A book's chapters meet in one group, of its candidate pages.
    """

    def picks(book: pd.DataFrame, lines: dict[int, list[str]] | None, snippets: dict[int, str]) -> pd.DataFrame:
        out, previous, shown = [], 0, {}

        def title(name: str | None, page: int) -> float:
            if page not in shown:
                shown[page] = fuzzy.Opener(lines.get(page))
            return shown[page].match(name)

        for pos, c in book.groupby("pos", sort=True):
            total, toc = int(c.total_pages.iloc[0]), int(c.toc_page.iloc[0])
            if previous > 0:
                low, high = previous + 1, min(total, previous + WINDOW)
            elif 0 < toc <= total and toc <= 0.8 * total:
                low, high = max(1, toc - 5), min(total, toc + WINDOW)
            else:
                low, high = 1, min(total, WINDOW)
            rank = c.sort_values(["hybrid", "page"], ascending=[False, True]).head(TOP_K).page
            c = c[c.page.isin(rank) | c.page.between(low, high)]
            if lines is not None:
                match = [title(n, p) for n, p in zip(c.name, c.page)]
                c = c.assign(total=c.total + W_STRUCTURE * WEIGHTS["title_match"] * pd.Series(match, c.index))
            c = c.sort_values(["total", "page"], ascending=[False, True])
            best = c.iloc[0]
            lead = best.total - (c.total.iloc[1] if len(c) > 1 else -999.0)
            clear = lead >= MARGIN and best.negative == 0
            previous = int(best.page) if clear else _choose(c, 0, resolver, snippets)
            out.append([best.book, int(pos), previous, float(lead), "best" if clear else "resolver", c])
        for a, b in zip(out, out[1:]):
            if b[2] <= a[2]:
                b[2], b[4] = _choose(b[5], a[2], resolver, snippets), "repaired"
        return pd.DataFrame([r[:5] for r in out], columns=["book", "pos", "start_page", "lead", "decided_by"])

    schema = "book string, pos int, start_page int, lead double, decided_by string"
    candidates = candidates.withColumn("toc_page", F.coalesce("toc_page", F.lit(0)))
    if openers is None:
        return candidates.groupBy("book").applyInPandas(lambda c: picks(c, None, {}), schema)
    return candidates.groupBy("book").cogroup(openers.groupBy("book")).applyInPandas(lambda c, o: picks(c, dict(zip(o.page, o.lines)), dict(zip(o.page, o.snippet)) if "snippet" in o else {}), schema)
