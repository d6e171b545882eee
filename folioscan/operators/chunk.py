"""Topic ranges, chunks, word windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import scan
from folioscan.shared import written


def topic_ranges(chapters: DataFrame, topics: DataFrame) -> DataFrame:
    """Page ranges of topics, each up to the start of the next, that page included.

    chapters: book, chapter, start_page, end_page, toc_start; topics: book, chapter,
    pos, topic, topic_page (string).  Printed pages are moved by the chapter's offset
    and kept within the chapter; topics without a whole number are dropped.
    """
    t = topics.withColumn("n", T.safe_int(F.col("topic_page"))).where("n is not null").join(chapters, ["book", "chapter"])
    offset = F.when(F.col("toc_start") > 0, F.col("start_page") - F.col("toc_start")).otherwise(0)
    t = t.withColumn("first_page", F.greatest("start_page", F.least(F.col("n") + offset, F.col("end_page"))))
    return t.selectExpr("book", "chapter", "pos", "topic", "first_page", "coalesce(lead(first_page) over (partition by book, chapter order by first_page, pos), end_page) as last_page")


def topic_page_chunks(chapters: DataFrame, ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """A row per topic and page (shared pages once for each), pages no topic covers
    with the chapter's first topic, chapters without topics with none.

    The interval join is an explode of both sides and an equi-join.  pages: book, page, text.
    """
    span = lambda a, b: F.explode(F.when(F.col(a) <= F.col(b), F.sequence(a, b)).otherwise(F.array().cast("array<int>")))
    every = chapters.select("book", "chapter", span("start_page", "end_page").alias("page"))
    covered = ranges.select("book", "chapter", "pos", "topic", F.col("first_page").alias("at"), span("first_page", "last_page").alias("page"))
    first = ranges.groupBy("book", "chapter").agg(F.min_by("topic", F.struct("first_page", "pos")).alias("first_topic"))
    rows = every.join(covered, ["book", "chapter", "page"], "left").join(first, ["book", "chapter"], "left").join(pages.select("book", "page", "text"), ["book", "page"], "left")
    return rows.select("book", "chapter", "page", F.coalesce("topic", "first_topic").alias("topic"), F.col("topic").isNotNull().alias("covered"), T.strip(F.coalesce("text", F.lit(""))).alias("text"))


def boundary_pages(chunks: DataFrame) -> DataFrame:
    """Pages of a chapter that more than one topic covers."""
    return chunks.where("covered").groupBy("book", "chapter", "page").agg(F.count(F.lit(1)).alias("topics")).where("topics > 1")


def topics_by_name(chapters: DataFrame, toc: DataFrame) -> DataFrame:
    """chapters (book, chapter_name) with the topics of the contents' chapter of that name, both trimmed; of
    repeated names the last counts, a name that the contents lack has no topics.  toc: book, chapter_name, pos, topics."""
    last = toc.groupBy("book", T.strip(F.coalesce("chapter_name", F.lit(""))).alias("__name")).agg(F.max_by("topics", "pos").alias("topics"))
    return chapters.withColumn("__name", T.strip(F.coalesce("chapter_name", F.lit("")))).join(last, ["book", "__name"], "left").drop("__name")


def flat_chunks(pages: DataFrame, target: int = 400, least: int = 80, overlap: float = 0.15) -> DataFrame:
    """Word windows page by page: book, page, seq (from 1), content, word_count."""
    w = pages.select("book", "page", F.posexplode(T.word_windows(F.coalesce("text", F.lit("")), target, least, overlap)).alias("i", "content"))
    return w.select("book", "page", (F.col("i") + 1).alias("seq"), "content", F.size(T.words(F.col("content"))).alias("word_count"))


# Fixed value: a line that gives a chapter's number and title.
CHAPTER_TITLE = r"(?idU)^chapter\s+\d+\s+(.+)"


def chapter_chunks(pages: DataFrame, chapters: DataFrame, target: int = 400, least: int = 80, overlap: float = 0.15, skipped: DataFrame | None = None) -> DataFrame:
    """Windows over whole chapters: a chapter starts at the first page with its name on a line of its own,
    alone or after the word chapter and a number (pages naming several chapters count only where no other
    does) and ends before the next; the last runs to the end.  Pages up to the last of ``skipped``
    (book, page), those of the contents, start none.  chapters: book, chapter, name."""
    pages = written(pages.select("book", "page", "text"), "pages")  # read for names, for lengths and for windows
    text = F.transform(T.solid_lines(F.coalesce("text", F.lit(""))), lambda x: F.array(x, T.strip(F.regexp_extract(x, CHAPTER_TITLE, 1))))
    line = F.explode(F.array_distinct(F.transform(F.flatten(text), F.upper))).alias("line")
    said = pages
    if skipped is not None:
        said = pages.join(skipped.groupBy("book").agg(F.max("page").alias("contents_end")), "book", "left").where("contents_end is null or page > contents_end")
    named = said.select("book", "page", line).where("line <> ''").join(chapters.select("book", "chapter", F.upper(F.coalesce("name", F.lit(""))).alias("line")), ["book", "line"])
    named = named.select("book", "page", "chapter").distinct().selectExpr("*", "count(*) over (partition by book, page) > 1 as many")
    starts = named.selectExpr("*", "row_number() over (partition by book, chapter order by many, page) as rn").where("rn = 1")
    last = pages.groupBy("book").agg(F.max("page").alias("last"))
    ranges = starts.join(last, "book").selectExpr("book", "chapter", "page as first_page", "coalesce(lead(page) over (partition by book order by page, chapter), last + 1) as next_page")
    placed = ranges.where("next_page > first_page").select("book", "chapter", "first_page", F.explode(F.expr("sequence(first_page, next_page - 1)")).alias("page"))
    return _windows_across(placed, pages, target, least, overlap)


def _windows_across(placed: DataFrame, pages: DataFrame, target: int, least: int, overlap: float) -> DataFrame:
    """The word windows (``text.word_windows``) of each chapter's pages in order, without a row or a task that
    holds a chapter: each page gives its share of the windows it has words of.  placed: book, chapter, first_page, page."""
    step = T.window_step(target, overlap)
    said = pages.select("book", "page", T.words(F.coalesce("text", F.lit(""))).alias("w")).withColumn("n", F.size("w").cast("long"))
    sizes = placed.select(F.struct("book", "chapter", "first_page").alias("key"), "book", "page").join(said.groupBy("book", "page").agg(F.sum("n").alias("n")), ["book", "page"])
    at = scan.summed(sizes, "key", ["page"], "n", "at")
    whole = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max("page").alias("last_page"))
    at = at.drop("n").join(whole.withColumn("k", F.floor((F.col("all") - 1) / step).cast("long") + 1), "key")
    # Rows of one page, should there be several, follow one another in the order of their words.
    one = said.selectExpr("*", "coalesce(sum(n) over (partition by book, page order by w rows between unbounded preceding and 1 preceding), 0) as off").where("n > 0")
    p = one.join(at, ["book", "page"]).withColumn("at", F.col("at") + F.col("off"))
    of = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("at") - target) / step).cast("long") + 1), F.floor((F.col("at") + F.col("n") - 1) / step).cast("long"))
    p = p.withColumn("i", F.explode(of))
    start = F.greatest(F.col("i") * step - F.col("at"), F.lit(0).cast("long"))
    size = F.least(F.col("i") * step + target - F.col("at"), F.col("n")) - start
    short = (F.col("k") > 1) & (F.col("all") - (F.col("k") - 1) * step < least)
    into = F.when(short & (F.col("i") == F.col("k") - 1), F.col("i") - 1).otherwise(F.col("i"))
    piece = F.struct("i", (F.col("at") + start).alias("at"), F.array_join(F.slice("w", (start + 1).cast("int"), size.cast("int")), " ").alias("said"))
    p = p.select("key", "last_page", (into + 1).cast("int").alias("seq"), piece.alias("piece"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["said"]), " ")
    return p.groupBy("key", "last_page", "seq").agg(content.alias("content")).select("key.*", "last_page", "seq", "content")


def mode(blocks: F.Column, topics: F.Column, heading_hits: F.Column, chapters: F.Column) -> F.Column:
    """Which chunker a book takes, from counts."""
    return F.when(blocks > 0, "mineru").when(topics > 0, F.when(heading_hits >= 2, "structured").otherwise("chapter")).when(chapters > 0, "chapter").otherwise("flat")


def link_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """chunk_id, image_refs: images on a chunk's pages, once each, by id.
    chunks: book, chunk_id, page_start, page_end; images: book, image_id, page."""
    c = chunks.select("book", "chunk_id", F.explode(F.when(F.col("page_start") <= F.col("page_end"), F.sequence("page_start", "page_end"))).alias("page"))
    hit = c.join(images, ["book", "page"]).groupBy("book", "chunk_id").agg(F.array_sort(F.collect_set("image_id")).alias("image_refs"))
    return chunks.select("book", "chunk_id").join(hit, ["book", "chunk_id"], "left").withColumn("image_refs", F.coalesce("image_refs", F.array().cast("array<string>")))


def back_links(linked: DataFrame) -> DataFrame:
    """image_id, chunk_ids: the chunks that refer to each image."""
    return linked.select("book", "chunk_id", F.explode("image_refs").alias("image_id")).groupBy("book", "image_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def carry_forward(rows: DataFrame, by: str, order: str, col: str, out: str) -> DataFrame:
    """The last value seen up to each row, whatever share of the rows its key has (see ``scan.carried``)."""
    return scan.carried(rows, by, [c.strip() for c in order.split(",")], col, out)
