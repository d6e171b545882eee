"""What a book leaves behind: manifests, alignment maps, chapter files, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T


def sanitised(name: Column) -> Column:
    """A name without the characters that file names may not hold; Unknown if nothing is left."""
    return F.coalesce(T.falsy(T.strip(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\\/:*?"<>|]', "_"))), F.lit("Unknown"))


def subject_folder(subject: Column, class_number: Column) -> Column:
    return F.concat(sanitised(subject), F.lit("_Class"), sanitised(class_number))


def manifests(pages: DataFrame, books: DataFrame) -> DataFrame:
    """One manifest per book, of its pages in order, identity still open.
    pages: book_stem, page, pdf, txt; books: book_stem, source_pdf, extractor."""
    p = pages.groupBy("book_stem").agg(F.array_sort(F.collect_list(F.struct("page", "pdf", "txt"))).alias("pages"))
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<page:int,pdf:string,txt:string>>")
    m = books.join(p, "book_stem", "left")
    return m.select("book_stem", "source_pdf", none.alias("subject"), none.alias("part"), none.alias("class_number"), "extractor", F.coalesce("pages", empty).alias("pages"))


def with_identity(manifests: DataFrame, identity: DataFrame) -> DataFrame:
    """manifests with subject, part and class_number of identity (book_stem, ...); books that
    identity does not name stay as they are."""
    new = identity.groupBy("book_stem").agg(F.max(F.struct("subject", "part", "class_number")).alias("__i"))
    m = manifests.join(new, "book_stem", "left")
    put = {c: F.when(F.col("__i").isNull(), F.col(c)).otherwise(F.col(f"__i.{c}")) for c in ("subject", "part", "class_number")}
    return m.withColumns(put).drop("__i")


def alignment_maps(chapters: DataFrame, manifests: DataFrame) -> DataFrame:
    """One map per book of its chapters in order.  chapters: book_stem, pos, chapter_number,
    chapter_name, toc_start_page, confirmed_start_page, end_page, confidence, signals."""
    fields = ["chapter_number", "chapter_name", "toc_start_page", "confirmed_start_page", "end_page", "confidence", "signals"]
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.to_json(F.struct(*fields)).alias("c"))), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    c = chapters.groupBy("book_stem").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["c"]), ","), F.lit("]")).alias("chapters"))
    return c.join(manifests.select("book_stem", "subject", "class_number", "part"), "book_stem", "left").select("book_stem", "subject", "class_number", "part", "chapters")


def chapter_documents(chunks: DataFrame) -> DataFrame:
    """(book, chapter_file, chapter_number, chapter_name, total_chunks) and the chunks they are
    of stay apart: files are written from chunks by ``chapter_chunks``.  chunks: book, seq,
    chapter_number, chapter_name.

    A missing chapter counts as 00; chapters whose number is no number share one file, in
    which the one that comes last replaces the others."""
    c = chunks.withColumn("chapter_number", F.coalesce(T.falsy(F.col("chapter_number")), F.lit("00")))
    g = c.groupBy("book", "chapter_number").agg(F.min("seq").alias("first"), F.min_by("chapter_name", "seq").alias("chapter_name"), F.count(F.lit(1)).alias("total_chunks"))
    g = g.withColumn("chapter_name", F.coalesce(T.falsy(F.col("chapter_name")), F.lit("Unknown"))).withColumn("chapter_file", T.chapter_file(F.col("chapter_number"), F.col("chapter_name")))
    last = F.struct(F.when(F.col("chapter_number").rlike(r"(?U)^\d+$"), F.col("chapter_number").try_cast("int")).otherwise(0), "first")
    w = g.groupBy("book", "chapter_file").agg(F.max_by(F.struct("chapter_number", "chapter_name", "total_chunks"), last).alias("d"))
    return w.select("book", "chapter_file", "d.*")


def chapter_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with the chapter_file each goes to; those of replaced chapters are left out."""
    c = chunks.withColumn("chapter_number", F.coalesce(T.falsy(F.col("chapter_number")), F.lit("00")))
    return c.join(chapter_documents(chunks).select("book", "chapter_number", "chapter_file"), ["book", "chapter_number"])


def write_json(rows: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines in a folder for each value of ``by``; only folders that rows touches are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy(*by).json(path)


def columns_of(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str, bool]]:
    """(table, position, column, type, nullable) of each column, as an information schema has them."""
    return [(name, i, f.name, f.dataType.simpleString(), f.nullable) for name, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]


def sample_row(df: DataFrame) -> DataFrame:
    return df.limit(1)
