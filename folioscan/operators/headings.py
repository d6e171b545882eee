"""Which chapter or topic a heading names: joins of headings and names, ratios per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import fuzzy
from folioscan.functions import text as T

TOPIC_LEAST, WINDOW_LEAST = 0.75, 0.82
LONG_NAME, SHORT_NAME = 12, 5


def numbered(toc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book, chapter, chapter_name, nth) and (book, topic, chapter, topic_name, nth): the chapters and
    topics of contents (book, chapter and, where there are any, chapter_name, topic, topic_name, pos).

    Of a repeated number the last entry counts, at the place (nth) of the first.  The order is that of
    ``pos``, where the contents have it; else by number, part by part, then by name."""
    name = lambda c: (F.col(c) if c in toc.columns else F.lit(None)).cast("string").alias(c)
    parts = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\."), lambda x: x.try_cast("int"))
    t = toc.select("book", name("chapter"), name("chapter_name"), name("topic"), name("topic_name"), *(["pos"] if "pos" in toc.columns else []))
    order = F.struct(*([F.col("pos")] if "pos" in toc.columns else []), parts("chapter"), "chapter", parts("topic"), "topic", "chapter_name", "topic_name")
    t = t.withColumn("nth", order)
    last = lambda by, *of: t.where(f"{by} is not null and {by} <> ''").groupBy("book", by).agg(F.max_by(F.struct(*of), "nth").alias("x"), F.min("nth").alias("nth")).select("book", by, "x.*", "nth")
    return last("chapter", "chapter_name"), last("topic", "chapter", "topic_name")


def undoubled(c: Column) -> Column:
    """A heading that recognition printed twice, once: the longest beginning of at most
    half the text that is followed by itself alone, or by four characters it begins with."""
    t = T.strip(c)
    half = F.floor(F.length(t) / 2).cast("int")
    rest = lambda k: F.substring(t, k + 1, F.length(t))
    head = lambda k: F.substring(t, F.lit(1), k)
    twice = lambda k: (rest(k) == head(k)) | F.upper(head(k)).startswith(F.substring(F.upper(rest(k)), 1, 4))
    cuts = F.when(half >= 4, F.sequence(half, F.lit(4), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    at = F.try_element_at(F.filter(cuts, twice), F.lit(1))
    return F.coalesce(head(at), t)


def bag(c: Column) -> Column:
    """A text's characters, each with its number among its like, so that the common part of two
    bags is as large as the sum of the smaller counts."""
    chars = F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.transform(chars, lambda x, i: F.concat(x, (i - F.array_position(chars, x)).cast("string")))


def most(a: str, b: str) -> Column:
    """The most that the ratio of two texts can be, from their bags alone."""
    return 2 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))


def topic_pairs(rows: DataFrame, topics: DataFrame, least: float = TOPIC_LEAST) -> tuple[DataFrame, DataFrame]:
    """((id, topic) of texts that begin with a topic's number, (id, said, topic, name, nth, bound) of the pairs
    whose ratio may be ``least`` or more) for rows (id, book, text)."""
    text = T.strip("text")
    said = F.concat_ws(".", F.regexp_extract(text, T.NUMBERED, 1), F.regexp_extract(text, T.NUMBERED, 2))
    r = rows.where("text is not null").select("id", "book", said.alias("topic"), F.lower(F.regexp_replace(text, r"^\d+\.\d+\s*", "")).alias("said"))
    t = numbered(topics)[1].select("book", "topic", F.lower(F.coalesce("topic_name", F.lit(""))).alias("name"), "nth")
    exact = r.join(t.select("book", "topic"), ["book", "topic"]).select("id", "topic")
    names = t.where("name <> ''").withColumn("name_bag", bag(F.col("name")))
    pairs = r.drop("topic").join(exact, "id", "left_anti").withColumn("said_bag", bag(F.col("said"))).join(names, "book")
    return exact, pairs.withColumn("bound", most("said_bag", "name_bag")).where(F.col("bound") >= least).drop("said_bag", "name_bag", "book")


def topic_matches(rows: DataFrame, topics: DataFrame, least: float = TOPIC_LEAST) -> DataFrame:
    """(id, topic) of rows (id, book, text): the topic of the book whose number the text
    begins with, else the one whose name is closest, if close enough; of equals the first of the
    contents.  topics: see ``numbered``.  Rows that name nothing are left out.

    Ratios are bounded from the texts' characters first (``most``); the pair of the highest bound is
    compared, and then only those whose bound is no less than its ratio."""
    exact, pairs = topic_pairs(rows, topics, least)
    ratio = lambda t: t.withColumn("score", fuzzy.ratios_column(F.array("said"), F.col("name"))[0])
    first = pairs.selectExpr("*", "row_number() over (partition by id order by bound desc, nth) as r")
    lead = ratio(first.where("r = 1"))
    rest = first.where("r > 1").join(lead.select("id", F.col("score").alias("best")), "id").where(F.col("bound") >= F.greatest("best", F.lit(least)))
    scored = lead.select("id", "topic", "score", "nth").unionByName(ratio(rest).select("id", "topic", "score", "nth")).where(F.col("score") >= least)
    return exact.unionByName(scored.groupBy("id").agg(F.min_by("topic", F.struct(-F.col("score"), "nth")).alias("topic")))


def kind(c: Column) -> Column:
    """A text's characters in order, all digits as one: what two texts of these kinds have in common is at most what the kinds have."""
    return F.array_join(F.array_sort(F.filter(F.split(F.translate(c, "123456789", "0" * 9), ""), lambda x: x != "")), "")


def chapter_pairs(rows: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, chapter) of texts that hold a long name, pairs of the others that may be alike: id, least, form, said, chapter, name, nth).

    Kinds of texts meet kinds of names first, so that headings and chapters that differ in their numbers
    alone are not compared one by one where none can be alike; a text that holds a name has all of its characters."""
    raw = F.regexp_replace(T.strip("text"), r"(?iU)^chapter\s+\w+\s*", "")
    forms = F.array_sort(F.array_distinct(F.array(F.upper(raw), F.upper(undoubled(raw)))))
    r = rows.where("text is not null").select("id", "book", "least", F.posexplode(forms).alias("form", "said")).withColumn("said_kind", kind(F.col("said")))
    c = numbered(chapters)[0].select("book", "chapter", F.upper(F.coalesce("chapter_name", F.lit(""))).alias("name"), "nth").where("name <> ''").withColumn("name_kind", kind(F.col("name")))
    size = F.size("name_bag")
    may = (most("said_bag", "name_bag") >= F.col("least")) | (size >= SHORT_NAME) & (F.size(F.array_intersect("said_bag", "name_bag")) >= WINDOW_LEAST * size)
    said, named = r.select("book", "least", "said_kind").distinct(), c.select("book", "name_kind").distinct()
    kinds = said.withColumn("said_bag", bag(F.col("said_kind"))).join(named.withColumn("name_bag", bag(F.col("name_kind"))), "book").where(may).drop("said_bag", "name_bag")
    p = r.join(kinds, ["book", "least", "said_kind"]).join(c, ["book", "name_kind"]).drop("said_kind", "name_kind").withColumns({"said_bag": bag(F.col("said")), "name_bag": bag(F.col("name"))})
    held = p.where((F.length("name") >= LONG_NAME) & F.contains("said", F.col("name"))).groupBy("id").agg(F.min_by("chapter", F.struct("form", "nth")).alias("chapter"))
    return held, p.where(may).join(held.select("id"), "id", "left_anti").drop("book", "said_bag", "name_bag")


def chapter_matches(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """(id, chapter) of rows (id, book, text, least), without the word chapter and what
    follows it, as they stand and undoubled: a chapter whose long name is in it; else the one
    whose name is closest, at ``least`` or more; else one whose name is close to a stretch
    of the same length.  Of equals the first chapter of the contents counts.  chapters: see ``numbered``.
    Rows that name nothing are left out.  Only pairs whose characters allow for one of these are compared."""
    held, p = chapter_pairs(rows, chapters)
    size = F.length("name")
    starts = F.sequence(F.lit(0), F.greatest(F.length("said") - size, F.lit(0)), F.greatest(F.floor(size / 3).cast("int"), F.lit(1)))
    stretches = F.when(size >= SHORT_NAME, F.transform(starts, lambda i: F.substring("said", i + 1, size))).otherwise(F.array().cast("array<string>"))
    p = p.withColumn("ratios", fuzzy.ratios_column(F.concat(F.array("said"), stretches), F.col("name")))
    near = F.exists(F.slice("ratios", 2, F.size("ratios")), lambda x: x >= WINDOW_LEAST)
    one = p.groupBy("id").agg(
        F.max(F.col("ratios")[0]).alias("best"), F.first("least").alias("least"),
        F.min_by("chapter", F.struct(-F.col("ratios")[0], "form", "nth")).alias("closest"),
        F.min_by(F.when(near, F.col("chapter")), F.when(near, F.struct("nth", "form"))).alias("stretch"),
    )
    return held.unionByName(one.select("id", F.coalesce(F.when(F.col("best") >= F.col("least"), F.col("closest")), "stretch").alias("chapter")).where("chapter is not null"))
