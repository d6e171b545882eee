"""Validation of manifests, alignments and chunks; text search with confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T


def bad_value(c: Column) -> Column:
    return c.isNull() | F.upper(T.strip(c)).isin("UNKNOWN", "NONE", "NULL", "")


def is_roman(c: Column) -> Column:
    return F.coalesce(F.upper(T.strip(c)).isin(T.ROMAN), F.lit(False))


def needs_fix(subject: Column, class_number: Column, part: Column) -> Column:
    return bad_value(subject) | bad_value(class_number) | is_roman(class_number) | is_roman(part)


def manifest_status(manifests: DataFrame) -> DataFrame:
    """status: ok, or else no_pdfs or patched, with Roman numbers as digits."""
    fix = needs_fix(F.col("subject"), F.col("class_number"), F.col("part"))
    return manifests.withColumns({"status": F.when(~fix, "ok").when(F.col("n_pages") == 0, "no_pdfs").otherwise("patched"), "class_fixed": T.roman_to_arabic(F.col("class_number")), "part_fixed": T.roman_to_arabic(F.col("part"))})


def alignment_issues(map_: DataFrame) -> DataFrame:
    """book, pos, start_page, end_page, total_pages -> previous_end, gap, issues."""
    m = map_.selectExpr("*", "lag(end_page) over (partition by book order by pos) as previous_end")
    flag = lambda c, name: F.when(c, name)
    issues = F.array(
        flag(F.col("previous_end").isNotNull() & (F.col("start_page") <= F.col("previous_end")), "OVERLAP"),
        flag(F.col("end_page") < F.col("start_page"), "BAD_END"),
        flag((F.col("start_page") < 1) | (F.col("start_page") > F.col("total_pages")), "OUT_OF_RANGE"),
        flag(F.col("end_page") > F.col("total_pages"), "END_EXCEEDS"),
    )
    return m.withColumns({"gap": F.col("start_page") - F.col("previous_end") - 1, "issues": F.filter(issues, lambda x: x.isNotNull())})


def coverage(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per book: chunks, pages, empty texts, with and without topic, boundary pages,
    pages of chapters without a chunk and chunk pages outside any chapter."""
    span = F.explode(F.when(F.col("start_page") <= F.col("end_page"), F.sequence("start_page", "end_page")))
    want = chapters.select("book", span.alias("page")).distinct().withColumn("wanted", F.lit(1))
    have = chunks.groupBy("book", "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "").alias("empty"), F.count("topic").alias("topics"), F.lit(1).alias("had"))
    both = want.join(have, ["book", "page"], "full")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.groupBy("book").agg(
        zero("n").alias("chunks"), F.count("had").alias("pages"), zero("empty").alias("empty"), zero("topics").alias("with_topic"), (zero("n") - zero("topics")).alias("without_topic"),
        F.count_if(F.col("n") > 1).alias("boundary"), F.count_if(F.col("had").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("extra"),
    )


def confidence(score: Column) -> Column:
    return F.when(score >= 0.70, "HIGH").when(score >= 0.55, "MEDIUM").otherwise("LOW")


def text_search(pages: DataFrame, query: str) -> DataFrame:
    """First line of each page that holds the query, whatever its case."""
    hit = F.filter(T.lines(F.coalesce("text", F.lit(""))), lambda x: F.contains(F.lower(x), F.lit(query.lower())))
    return pages.withColumn("line", T.strip(F.try_element_at(hit, F.lit(1)))).where("line is not null")


def rollup(status: DataFrame, by: list[str]) -> DataFrame:
    return status.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "skipped", "error")])
