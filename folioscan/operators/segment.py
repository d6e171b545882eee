"""Segmenting a book's blocks or lines by chapter, topic, example and exercise.

What a block is (answer key, exercise heading, chapter number, topic number) is
decided by built-in expressions for all rows at once; only the order-dependent
part, which segment a block belongs to, is a fold over one book's rows.  No text goes through it:
it sees what blocks are, and says of which blocks a segment consists; their texts are joined to that.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import headings, scan
from folioscan.shared import broadcast_if_small, written

_OUT = "book string, seg int, chapter string, topic string, topic_name string, kind string, page_start int, page_end int, pages array<int>, parts array<long>"
#: Segments whose numbers of chunks are sent to all tasks at most.
SMALL = 500_000
# Kinds of layout blocks.
NOISE = ["header", "footer", "page_number", "page_footnote"]
FIGURES = ["image", "chart", "table"]
#: Headings of level 1 and 2 that may begin a chapter: length at most, ratio at least.
LONGEST, LEAST = {1: 100, 2: 60}, {1: 0.62, 2: 0.72}


@dataclass
class Segment:
    chapter: str
    topic: str
    name: str
    kind: str
    pages: dict[int, None] = field(default_factory=dict)
    parts: list[int] = field(default_factory=list)

    def add(self, page: int, *parts: int) -> None:
        self.pages[page] = None
        self.parts += parts


def _table(book: str, segments: list[Segment]) -> pd.DataFrame:
    kept = [s for s in segments if s.parts]
    rows = [(book, i, s.chapter, s.topic, s.name, s.kind, pages[0], pages[-1], pages, s.parts) for i, s in enumerate(kept, 1) if (pages := list(s.pages))]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])


def _told(segments: DataFrame, placed: DataFrame) -> DataFrame:
    """Segments with their content: the texts (book, seg, nth, text) of their parts, in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n")
    return segments.drop("parts").join(placed.groupBy("book", "seg").agg(T.strip(text).alias("content")), ["book", "seg"])


def classify(blocks: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Adds what each block is: role, chapter number said, topic number said."""
    b = blocks.join(skip, ["book", "page"], "left_anti") if skip is not None else blocks
    text = T.strip(F.coalesce("text", F.lit("")))
    code = F.col("code_body") if "code_body" in b.columns else F.lit(None).cast("string")
    inline = F.coalesce(T.falsy(F.col("text")), code, F.lit(""))  # formulas and code stay as they are
    topic = F.regexp_extract(text, r"^(\d+)\s*\.\s*(\d+)", 0)
    role = (
        F.when(F.col("type").isin(NOISE), "noise").when(F.col("type").isin(FIGURES), "figure").when(F.col("type").isin("equation", "code"), "inline")
        .when(text == "", "noise").when(text.rlike(T.ANSWERS_HEADING), "answers").when(text.rlike(T.EXERCISE_HEADING) | text.rlike(T.INTEXT_HEADING), "exercise")
        .when(text.rlike(r"(?i)^Example\s+(\d+)[.\s]"), "example").otherwise("body")
    )
    return b.select(
        "book", F.col("pos").cast("long").alias("pos"), "page", F.coalesce("level", F.lit(0)).alias("level"), role.alias("role"), F.when(role == "inline", inline).otherwise(text).alias("text"),
        F.regexp_extract(text, T.CHAPTER_NUMBER, 1).alias("said_chapter"), T.strip(F.regexp_replace(text, T.CHAPTER_NUMBER, "")).alias("rest"),
        F.regexp_replace(topic, r"\s", "").alias("said_topic"), text.rlike(T.UNIT_HEADER).alias("unit"),
    )


class BlockFold:
    """One book's blocks in order; chapters and topics: number to name."""

    def __init__(self, chapters: dict[str, str], topics: dict[str, tuple[str, str]]):
        self.chapters, self.topics = chapters, topics
        self.done: list[Segment] = []
        self.now: Segment | None = None
        self.seen: set[str] = set()
        self.chapter: str | None = None
        self.waiting: str | None = None
        self.exercises = self.answers = False
        self.hit_page, self.spoilt = -1, set()

    def open(self, chapter: str, topic: str, name: str, kind: str, page: int, *parts: int) -> None:
        self.close()
        self.now = Segment(chapter, topic, name, kind)
        self.now.add(page, *parts)

    def close(self) -> None:
        if self.now:
            self.done.append(self.now)
        self.now = None

    def starts(self, b) -> str | None:
        """The chapter whose beginning this block is."""
        fresh = lambda c: c and c not in self.seen and c != self.chapter
        if b.flat and b.said_chapter and b.said_chapter in self.chapters and fresh(b.said_chapter):
            return b.said_chapter if b.rest else None
        if b.near_chapter:
            return b.near_chapter if fresh(b.near_chapter) else None
        return None

    def enter(self, chapter: str, page: int) -> None:
        self.close()
        self.seen.add(chapter)
        self.chapter, self.waiting, self.hit_page = chapter, None, page
        self.exercises = self.answers = False

    def block(self, b) -> None:
        if b.role in ("noise", "figure", "inline"):
            if self.now and b.role != "noise" and (b.role == "figure" or b.given):
                self.now.add(b.page, *([b.pos] if b.role == "inline" and b.solid else []))
            return
        if b.role == "answers":
            self.close()
            self.answers, self.exercises, self.waiting = True, False, None
            return
        start = None if (b.said_topic or b.unit) and not self.answers else self.starts(b)
        if self.answers:
            if not start:
                return
            self.answers = False
        if b.role == "exercise" and self.chapter:
            was = self.now
            self.exercises, self.waiting = True, None
            if was:
                self.open(was.chapter, f"ex_{was.chapter}", b.title, "exercise", b.page)
            return
        if start and not (b.said_topic or b.unit):
            if b.page == self.hit_page:  # an index of several chapters: none of them begins here
                self.spoilt.add(b.page)
                self.seen -= {self.chapter, start}
                self.chapter = self.waiting = None
            else:
                self.enter(start, b.page)
            return
        if self.waiting and self.waiting not in self.seen:
            if b.page not in self.spoilt and b.page != self.hit_page:
                self.enter(self.waiting, b.page)
                return
            self.waiting = None
        if b.flat and b.said_chapter in self.chapters and not b.rest and b.said_chapter not in self.seen:
            self.waiting = b.said_chapter
            return
        self.waiting = None
        self.body(b)

    def body(self, b) -> None:
        if b.level == 2:
            t = b.near_topic
            if t not in self.topics:
                if self.now:
                    self.now.add(b.page, b.pos)
                return
            chapter, name = self.topics[t]
            if chapter != self.chapter:
                self.seen.add(chapter)
                self.chapter, self.exercises = chapter, False
            self.open(chapter, t, f"Exercise {t}" if self.exercises else name, "exercise" if self.exercises else "content", b.page, b.pos)
            return
        if b.role == "example" and not self.exercises:
            number = b.second or "0"
            if self.now:
                self.open(self.now.chapter, "ex_" + re.sub(r"[^0-9.]", "", number), f"Example {number}", "example", b.page, b.pos)
        elif self.exercises and self.now and b.said_topic:
            self.open(self.chapter or self.now.chapter, b.said_topic, f"Exercise {b.said_topic}", "exercise", b.page, b.pos)
        elif self.now:
            self.now.add(b.page, b.pos)
        elif self.chapter in self.chapters:
            self.open(self.chapter, f"{self.chapter}.0", "Introduction", "content", b.page, b.pos)


def _contents(toc: pd.DataFrame) -> tuple[dict[str, str], dict[str, tuple[str, str]]]:
    """Names by number, of rows that ``_numbers`` gave."""
    toc = toc.fillna("")
    return {r.chapter: r.name for r in toc.itertuples() if not r.topic}, {r.topic: (r.chapter, r.name) for r in toc.itertuples() if r.topic}


def _numbers(toc: DataFrame) -> DataFrame:
    """book, chapter, topic, name: a row for each chapter (topic '') and topic of the contents."""
    chapters, topics = headings.numbered(toc)
    return chapters.select("book", "chapter", F.lit("").alias("topic"), F.col("chapter_name").alias("name")).unionByName(topics.select("book", "chapter", "topic", F.col("topic_name").alias("name")))


def block_segments(blocks: DataFrame, toc: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """blocks: book, pos, page, type, level, text; toc: book, chapter, chapter_name,
    topic, topic_name.  Which chapter or topic a heading names is decided for all
    headings by joins; one book's rows then meet in one group."""
    c = written(classify(blocks, skip), "blocks").withColumn("id", F.struct("book", "pos"))  # read for headings, for what blocks are and for texts
    flat = ~F.contains("text", F.lit("\n")) & (F.col("text") != "")
    near = c.where(flat & ((F.col("level") == 1) & (F.length("text") <= LONGEST[1]) | (F.col("level") == 2) & (F.length("text") <= LONGEST[2])))
    near = near.select("id", "book", "text", F.when(F.col("level") == 1, LEAST[1]).otherwise(LEAST[2]).alias("least"))
    chapters = headings.chapter_matches(near, toc).withColumnRenamed("chapter", "near_chapter")
    topics = headings.topic_matches(c.where("level = 2 and text <> ''").select("id", "book", "text"), toc).withColumnRenamed("topic", "near_topic")
    c = c.join(chapters, "id", "left").join(topics, "id", "left").drop("id")
    for name in ("near_chapter", "near_topic"):
        c = c.withColumn(name, F.coalesce(name, F.lit("")))

    def run(key: tuple, rows: pd.DataFrame, toc: pd.DataFrame) -> pd.DataFrame:
        f = BlockFold(*_contents(toc))
        for b in rows.sort_values("pos").itertuples():
            f.block(b)
        f.close()
        return _table(key[0], f.done)

    facts = {
        "flat": ~F.contains("text", F.lit("\n")), "rest": F.col("rest") != "", "given": F.col("text") != "", "solid": T.strip("text") != "",
        "title": F.when(F.col("role") == "exercise", F.col("text")).otherwise(""), "second": F.coalesce(F.try_element_at(T.words(F.col("text")), F.lit(2)), F.lit("")),
    }
    narrow = c.select("book", "pos", "page", "level", "role", "said_chapter", "said_topic", "unit", "near_chapter", "near_topic", *[v.alias(k) for k, v in facts.items()])
    found = written(narrow.groupBy("book").cogroup(_numbers(toc).groupBy("book")).applyInPandas(run, _OUT), "segments")
    return _told(found, found.select("book", "seg", F.posexplode("parts").alias("nth", "at")).join(c.select("book", F.col("pos").alias("at"), "text"), ["book", "at"]))


#: What a line is, by the codes that the fold gets.
BODY, ANSWERS, EXERCISE, EXAMPLE = range(4)


def _marks(pages: DataFrame) -> DataFrame:
    """(book, page, i, role, example, topic, solid, rest, rest_solid): the lines (i from 0) that may change the segment, and
    before them one of i = -1 for each page, each with how many other lines follow it and whether those say anything."""

    def marked(x: F.Column, i: F.Column) -> F.Column:
        role = F.when(x.rlike(T.ANSWERS_HEADING), ANSWERS).when(x.rlike(T.EXERCISE_HEADING) | x.rlike(T.INTEXT_HEADING), EXERCISE).when(x.rlike(T.EXAMPLE_HEADING), EXAMPLE).otherwise(BODY)
        number = lambda rx: F.when(x.rlike(rx), F.concat_ws(".", F.regexp_extract(x, rx, 1), F.regexp_extract(x, rx, 2)))
        return F.struct(i.alias("i"), role.alias("role"), number(T.EXAMPLE_HEADING).alias("example"), number(T.TOPIC_HEADING).alias("topic"), _says(x).alias("solid"))

    before = F.struct(F.lit(-1).alias("i"), F.lit(BODY).alias("role"), F.lit(None).cast("string").alias("example"), F.lit(None).cast("string").alias("topic"), F.lit(False).alias("solid"))
    every = F.concat(F.array(before), F.filter(F.transform("lines", marked), lambda m: (m["role"] != BODY) | m["topic"].isNotNull()))
    end = lambda ms, j: F.coalesce(F.get(ms, j + 1)["i"], F.size("lines"))
    row = lambda m, n: F.struct(m["i"].alias("i"), m["role"].alias("role"), m["example"].alias("example"), m["topic"].alias("topic"), m["solid"].alias("solid"), n.alias("rest"), F.exists(F.slice("lines", m["i"] + 2, n), _says).alias("rest_solid"))
    rows = T.once(every, lambda ms: F.transform(ms, lambda m, j: row(m, end(ms, j) - m["i"] - 1)))
    return pages.select("book", "page", F.explode(rows).alias("m")).select("book", "page", "m.*").where("i >= 0 or rest > 0")


def _says(line: F.Column) -> F.Column:
    return line.rlike(r"(?U)[^\s\x1c-\x1f]")


def line_segments(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Segments from plain page text by the headings on its lines.  pages: book, page, text.
    The fold sees lines that may be headings, and of those between them how many they are."""
    pages = written(pages.where("page is not null").select("book", "page", T.lines(F.coalesce("text", F.lit(""))).alias("lines")), "lines")

    def run(key: tuple, rows: pd.DataFrame, toc: pd.DataFrame) -> pd.DataFrame:
        chapters, topics = _contents(toc)
        done: list[Segment] = []
        carried: Segment | None = None
        chapter, mode = None, "content"

        def put(s: Segment | None, page: int, lines: list[tuple[int, int, bool]]) -> None:
            """lines: first and last of lines that follow one another, and whether they say anything."""
            if s is None or not lines:
                return
            if not done or done[-1].topic != s.topic:
                done.append(Segment(s.chapter, s.topic, s.name, s.kind))
            at = page << 32
            done[-1].add(page, *([at + i for a, b, _ in lines for i in (a, b)] if any(solid for _, _, solid in lines) else []))

        for page, group in itertools.groupby(rows.sort_values(["page", "i"]).itertuples(index=False), lambda r: r.page):
            now, text, skipping = None, [], False
            for r in group:
                fresh = None
                if r.i < 0:
                    pass
                elif r.role == ANSWERS:
                    put(now, page, text)
                    now, text, skipping = None, [] if now else text, True
                elif r.role == EXERCISE:
                    put(now, page, text)
                    text = [] if now else text
                    mode, now = "exercise", carried and Segment(carried.chapter, carried.topic, carried.name, "exercise")
                else:
                    if r.role == EXAMPLE and mode != "exercise":
                        c = carried.chapter if carried else r.example.split(".")[0]
                        mode, fresh = "example", Segment(c, f"ex{r.example}", f"Example {r.example}", "example")
                    elif r.topic in topics:
                        c, name = topics[r.topic]
                        if c != chapter:
                            chapter, mode = c, "content"
                        if mode == "exercise":
                            fresh = Segment(carried.chapter if carried else c, r.topic, f"Exercise {r.topic}", "exercise")
                        else:
                            mode, fresh = "content", Segment(c, r.topic, name, "content")
                            carried = fresh
                    if fresh:
                        put(now, page, text)
                        now, text = fresh, []
                    text.append((r.i, r.i, r.solid))
                if skipping:
                    break
                if r.rest:
                    text.append((r.i + 1, r.i + r.rest, r.rest_solid))
            put(now or (carried and Segment(carried.chapter, carried.topic, carried.name, mode)), page, text)
        return _table(key[0], done)

    found = written(_marks(pages).groupBy("book").cogroup(_numbers(toc).groupBy("book")).applyInPandas(run, _OUT), "segments")
    part = F.transform(F.sequence(F.lit(0), F.size("parts") - 2, F.lit(2)), lambda i: F.struct(F.get("parts", i).alias("first"), F.get("parts", i + 1).alias("last")))
    placed = found.select("book", "seg", F.posexplode(part).alias("nth", "part")).select("book", "seg", "nth", F.shiftright("part.first", 32).cast("int").alias("page"), (F.col("part.first").bitwiseAND(0xFFFFFFFF) + 1).cast("int").alias("first"), (F.col("part.last") - F.col("part.first") + 1).cast("int").alias("n"))
    return _told(found, placed.join(pages, ["book", "page"]).select("book", "seg", "nth", F.array_join(F.slice("lines", F.col("first"), F.col("n")), "\n").alias("text")))


def windows(segments: DataFrame, target: int = 400, least: int = 80, overlap: float = 0.15, images: DataFrame | None = None, chapters: DataFrame | None = None, mode: str = "mineru") -> DataFrame:
    """Chunks of segments with ids numbered through the book.

    With ``images`` (book, page, image_id) a chunk has image_refs, the images on the pages of
    its segment, page by page, and has_images; with ``chapters`` (book, chapter, chapter_name)
    the name of its chapter."""
    refs = F.array().cast("array<string>")
    s = segments
    if images is not None:
        on = segments.select("book", "seg", F.posexplode("pages").alias("nth", "page")).join(images.select("book", "page", F.col("image_id").cast("string").alias("image_id")), ["book", "page"])
        got = on.groupBy("book", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "image_id"))), lambda x: x["image_id"]).alias("image_refs"))
        s, refs = s.join(got, ["book", "seg"], "left"), F.coalesce("image_refs", refs)
    name = F.lit(None).cast("string")
    if chapters is not None:
        names = chapters.groupBy("book", "chapter").agg(F.max("chapter_name").alias("chapter_name"))
        s, name = s.join(names, ["book", "chapter"], "left"), F.col("chapter_name")
    s = written(s.drop("pages").withColumn("pieces", T.word_windows(F.col("content"), target, least, overlap)).drop("content"), "pieces")
    before = written(scan.summed(s.select("book", "seg", F.size("pieces").cast("long").alias("m")), "book", ["seg"], "m", "before").drop("m"), "before")
    w = s.join(broadcast_if_small(before, before.count(), SMALL), ["book", "seg"]).select("*", F.posexplode("pieces").alias("part", "piece"))
    n = w.withColumn("n", (F.col("before") + F.col("part") + 1).cast("int"))
    cid = F.concat("book", F.lit("_ch"), "chapter", F.lit("_t"), "topic", F.lit("_"), F.lpad(F.col("n").cast("string"), 4, "0"))
    return n.select(
        "book", cid.alias("chunk_id"), "chapter", name.alias("chapter_name"), "topic", "topic_name", "kind", "page_start", "page_end", F.col("piece").alias("content"), F.size(T.words(F.col("piece"))).alias("word_count"),
        refs.alias("image_refs"), (F.size(refs) > 0).alias("has_images"), F.lit(mode).alias("mode"), F.col("n").alias("seq"),
    )
