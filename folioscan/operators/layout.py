"""Topics of pages, figure regions and their topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import headings
from folioscan.operators.chunk import carry_forward

# Patterns of captions and headings, and distances in points.
#: A figure's number anywhere in a caption.
CAPTION = r"(?iU)\b(?:FIGURE|Figure|Fig\.?)\s+(\d+)\.(\d+)"
#: A topic's heading at the start of a line; of its own block, on a page with positions.
TOPIC_LINE = r"(?mdU)^(\d+\.\d+)\s+\S.*"
TOPIC_BLOCK = r"(?U)^(\d+)\.(\d+)\s{2,}\S"
CHAPTER_LINE = r"(?idU)Chapter\s+(\w+)\s+(.+)"
HEADER_MARGIN, H_PADDING, MIN_HEIGHT, MAX_UP, MIN_PIXELS, DPI = 40.0, 20.0, 80.0, 500.0, 5000, 150


def page_topics(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """book, page, topic, chapter: of a page's topic headings the first one that the contents
    have; without any, the chapter (a topic of none) of the page's first chapter heading, in
    digits or a word, if the contents have it; else what came before.  toc: see ``headings.numbered``."""
    chapters, topics = headings.numbered(toc)
    text = F.coalesce("text", F.lit(""))
    said = pages.select("book", "page", F.posexplode(F.regexp_extract_all(text, F.lit(TOPIC_LINE), F.lit(1))).alias("at", "topic")).join(topics.select("book", "topic", "chapter"), ["book", "topic"])
    said = said.groupBy("book", "page").agg(F.min_by(F.struct("topic", "chapter"), "at").alias("t"))
    rows = pages.select("book", "page", T.word_to_digit(F.lower(F.regexp_extract(text, CHAPTER_LINE, 1))).alias("chapter"))
    rows = rows.join(chapters.select("book", "chapter", F.lit(True).alias("known")), ["book", "chapter"], "left").join(said, ["book", "page"], "left")
    own = F.coalesce("t", F.when(F.col("known"), F.struct(F.lit(None).cast("string").alias("topic"), "chapter")))
    out = carry_forward(rows.select("book", "page", own.alias("own")), "book", "page", "own", "got")
    return out.select("book", "page", "got.topic", "got.chapter")


def caption_of(block: str = "") -> F.Column:
    """A layout block's captions and footnotes that are not blank, joined."""
    at = lambda c: F.coalesce(F.col(f"{block}{c}"), F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(at("image_caption"), at("image_footnote")), lambda x: T.strip(x) != ""), " ")


def image_index(images: DataFrame, topics: DataFrame, toc: DataFrame) -> DataFrame:
    """Topic of each image: the topic of its page, or that of its caption's number
    where the table of contents has it under the number's chapter.
    images: book, page, image_seq, caption (with footnotes, see ``caption_of``)."""
    chapter, nth = (F.regexp_extract("caption", CAPTION, k) for k in (1, 2))
    i = images.withColumn("fig", F.when(chapter != "", F.concat(chapter, F.lit("."), nth))).join(topics, ["book", "page"], "left")
    exact = toc.where(F.substring_index("topic", ".", 1) == F.col("chapter")).select("book", F.col("topic").alias("fig"), F.col("chapter").alias("fig_chapter")).distinct()
    i = i.join(exact, ["book", "fig"], "left")
    return i.select(
        "book", "page", "image_seq", "caption", "fig", F.format_string("page_%04d_img_%03d", "page", "image_seq").alias("image_id"),
        F.when(F.col("fig_chapter").isNotNull(), F.col("fig")).otherwise(F.col("topic")).alias("topic"), F.coalesce("fig_chapter", "chapter").alias("chapter"),
    )


def figure_regions(blocks: DataFrame, pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Crop boxes of captioned figures and the topic each belongs to.

    blocks: book, page, pos, y0, y1, text; pages: book, page, width, height.  A page's blocks are
    one row, in order of their top edges, so a caption finds what is above it without a join.  The top
    of a region is the bottom of the first block upwards whose text is another, unless that is more than
    MAX_UP points away, else the header margin; at least MIN_HEIGHT high; regions under MIN_PIXELS are
    dropped.  A figure's topic: that of its own number; else the last heading above it, of a topic or only of a
    chapter that the contents have; else its number's chapter; else nothing, which takes
    the last topic of a figure in page order.
    """
    chapters, topics = headings.numbered(toc)
    known = chapters.select("book", F.col("chapter").alias("c"), F.lit(True).alias("in_toc"))
    text = T.strip(F.coalesce("text", F.lit("")))
    b = blocks.select("book", "page", "pos", "y0", "y1", text.alias("text"), F.regexp_extract(text, TOPIC_BLOCK, 1).alias("c"), F.regexp_extract(text, TOPIC_BLOCK, 2).alias("t"))
    b = b.withColumn("topic", F.concat("c", F.lit("."), "t")).join(topics.select("book", "topic", F.col("chapter").alias("of")), ["book", "topic"], "left").join(known, ["book", "c"], "left")
    none = F.lit(None).cast("string")
    head = F.when(F.col("of").isNotNull(), F.struct(F.col("topic").alias("topic"), F.col("of").alias("chapter"))).when(F.col("in_toc"), F.struct(none.alias("topic"), F.col("c").alias("chapter")))
    page = b.groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "pos", "y1", "text", head.alias("head")))).alias("b"))
    cap = page.select("book", "page", "b", F.explode(F.filter("b", lambda x: x["text"].rlike(CAPTION))).alias("f")).withColumns({"c": F.regexp_extract("f.text", CAPTION, 1), "t": F.regexp_extract("f.text", CAPTION, 2)})
    above = F.filter("b", lambda x: (x["y1"] < F.col("f.y0")) & ((F.col("f.y0") - x["y1"] > MAX_UP) | (x["text"] != F.col("f.text"))))
    headed = F.filter("b", lambda x: (x["y0"] < F.col("f.y0")) & x["head"].isNotNull())
    cap = cap.select("book", "page", "f.pos", "f.y0", "f.y1", "f.text", "c", F.concat("c", F.lit("."), "t").alias("fig"), F.array_max(above)["y1"].alias("up"), F.try_element_at(headed, F.lit(-1))["head"].alias("above"))
    one = cap.selectExpr("*", "row_number() over (partition by book, page, fig order by y0, pos) as nth").where("nth = 1")
    own = topics.select("book", F.col("topic").alias("fig"), F.col("chapter").alias("own_chapter"))
    r = one.join(own, ["book", "fig"], "left").join(known, ["book", "c"], "left").join(pages, ["book", "page"])
    bottom = F.least(F.col("height"), F.col("y1") + 5)
    top = F.when(F.col("y0") - F.col("up") <= MAX_UP, F.greatest(F.lit(HEADER_MARGIN), F.col("up") + 2)).otherwise(HEADER_MARGIN)
    top = F.when(bottom - top < MIN_HEIGHT, F.greatest(F.lit(HEADER_MARGIN), bottom - MIN_HEIGHT)).otherwise(top)
    r = r.withColumns({"crop_top": top, "crop_bottom": bottom})
    pixels = (F.col("width") - 2 * H_PADDING) * (F.col("crop_bottom") - F.col("crop_top")) * (DPI / 72.0) ** 2
    method = (
        F.when(F.col("own_chapter").isNotNull(), "caption").when(F.col("in_toc") & F.col("above").isNotNull(), "caption_chapter+y_position")
        .when(F.col("in_toc"), "caption_chapter_only").when(F.col("above.topic").isNotNull(), "y_position").when(F.col("above").isNotNull(), "y_position_chapter_only").otherwise("page_only")
    )
    topic = F.when(F.col("own_chapter").isNotNull(), F.col("fig")).otherwise(F.col("above.topic"))
    chapter = F.coalesce("own_chapter", "above.chapter", F.when(F.col("in_toc"), F.col("c")))
    r = r.where(pixels >= MIN_PIXELS).select("book", "page", "pos", "fig", F.substring("text", 1, 120).alias("caption"), F.round("crop_top", 1).alias("y0"), F.round("crop_bottom", 1).alias("y1"), method.alias("method"), topic.alias("topic"), chapter.alias("chapter"), F.col("y0").alias("at"))
    r = r.withColumn("own", F.when(F.col("topic").isNotNull(), F.struct("topic", "chapter")))
    r = carry_forward(r, "book", "page, at, pos", "own", "last")
    lost = (F.col("method") == "page_only") & F.col("last").isNotNull()
    return r.select("book", "page", "fig", "caption", "y0", "y1", F.when(lost, "carry_forward").otherwise(F.col("method")).alias("mapping_method"), F.when(lost, F.col("last.topic")).otherwise(F.col("topic")).alias("topic"), F.when(lost, F.col("last.chapter")).otherwise(F.col("chapter")).alias("chapter"))


def heading_hit(text: F.Column, keywords: list[str]) -> F.Column:
    """A line that is a keyword, or one of at most 40 characters that begins with one and a space."""
    rx = "|".join("\\Q" + k + "\\E" for k in sorted(keywords, key=len, reverse=True))
    return F.exists(T.lines(F.coalesce(text, F.lit(""))), lambda x: F.upper(T.strip(x)).rlike(f"^(?:{rx})$") | ((F.length(T.strip(x)) <= 40) & F.upper(T.strip(x)).rlike(f"^(?:{rx})[ \\t]")))


def toc_slice(pages: DataFrame, keywords: list[str], search: int = 30, after: int = 5) -> DataFrame:
    """The first page of a book's first pages with a contents heading, and the next ones."""
    first = pages.where(F.col("page") <= search).where(heading_hit(F.col("text"), keywords)).groupBy("book").agg(F.min("page").alias("toc_page"))
    return pages.join(first, "book").where(f"page between toc_page and toc_page + {after}").select("book", "page", "toc_page")
