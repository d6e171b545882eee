"""Merging chunks, equations and images into one document per book; images as served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators import store

from folioscan.functions import text as T
from folioscan.operators.chunk import back_links, link_images


def with_equations(chunks: DataFrame, content: str = "content") -> DataFrame:
    e = T.equations(F.col(content))
    return chunks.withColumn("__e", e).withColumns({"equations": F.col("__e.equations"), content: F.col("__e.text"), "has_equations": F.size("__e.equations") > 0}).drop("__e")


def knowledge_base(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """book, total_chunks, total_images, total_equations, chunks, images.  A book's
    document is one row by its nature; ``linked`` tables are the scalable form.
    chunks: book, chunk_id, page_start, page_end, content; images: book, image_id, page."""
    linked = link_images(chunks, images)
    c = with_equations(chunks).join(linked, ["book", "chunk_id"])
    i = images.join(back_links(linked), ["book", "image_id"], "left")
    cs = c.groupBy("book").agg(F.count(F.lit(1)).alias("total_chunks"), F.sum(F.size("equations")).alias("total_equations"), F.array_sort(F.collect_list(F.struct("chunk_id", "page_start", "page_end", "content", "equations", "image_refs"))).alias("chunks"))
    im = i.groupBy("book").agg(F.count(F.lit(1)).alias("total_images"), F.array_sort(F.collect_list(F.struct("image_id", "page", "chunk_ids"))).alias("images"))
    return cs.join(im, "book", "left").withColumn("total_images", F.coalesce("total_images", F.lit(0)))


def media_type(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".png"), "image/png").otherwise("image/jpeg")


def image_response(images: DataFrame, asked: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """image_id, status, media_type, image_data of each asked id: the stored bytes, else those of the image's file
    below its book's folder (files: book_stem, path, content, see ``store.below_book``), else 404.  Stored
    bytes are PNG by their extension or else JPEG, files what their extension says."""
    i = asked.select("image_id").distinct().join(images, "image_id", "left").withColumn("stored", F.when(F.octet_length("image_data") > 0, F.col("image_data")))
    if files is not None:
        f = files.select("book_stem", store.below_book(F.col("path"), F.col("book_stem")).alias("image_path"), F.col("path").alias("at"), "content").groupBy("book_stem", "image_path").agg(F.min_by("content", "at").alias("file"))
        i = i.join(f, ["book_stem", "image_path"], "left")
    else:
        i = i.withColumn("file", F.lit(None).cast("binary"))
    data = F.coalesce("stored", "file")
    return i.select("image_id", F.when(data.isNotNull(), 200).otherwise(404).alias("status"), F.when(data.isNotNull(), media_type(F.coalesce("image_path", F.lit("")))).alias("media_type"), data.alias("image_data"))


def merge_scores(text_hits: DataFrame, vector_scores: DataFrame, extra: int = 5) -> DataFrame:
    """Text matches with their vector scores, and the best ``extra`` pages of each
    book that only the vectors found.  Both: book, page; vector_scores: score."""
    both = text_hits.join(vector_scores, ["book", "page"], "left").withColumn("found_by", F.lit("text"))
    rest = vector_scores.join(text_hits, ["book", "page"], "left_anti")
    rest = rest.selectExpr("*", "row_number() over (partition by book order by score desc, page) as rn").where(F.col("rn") <= extra).drop("rn").withColumn("found_by", F.lit("vector"))
    return both.unionByName(rest, allowMissingColumns=True)
