"""Keyed merges and replacement of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import schemas


def ensure_tables(spark: SparkSession, prefix: str = "") -> None:
    for name, ddl in schemas.TABLES.items():
        spark.sql(f"create table if not exists {prefix}{name} ({ddl}) using parquet")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None, order: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; ``keep`` columns stay as they were.  Of new rows
    with the same key the last by ``order`` counts, or else the greatest."""
    rest = [c for c in new.columns if c not in keys]
    if rest:
        first = [F.col(order).alias("__o")] if order else []
        one = new.groupBy(*keys).agg(F.max(F.struct(*first, *rest)).alias("__r"))
        new = one.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in new.columns])
    else:
        new = new.distinct()
    rest = old.join(new.select(*keys), keys, "left_anti")
    if keep:
        was = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(was, keys, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return rest.unionByName(new)


def replace_partitions(new: DataFrame, path: str, by: str = "book_stem") -> None:
    """Overwrites the partitions that ``new`` has rows of, and no others."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replaced(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """The table after its groups that ``new`` has were deleted and inserted anew."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def write_back(table: DataFrame, values: DataFrame, keys: list[str], col: str) -> DataFrame:
    """UPDATE ... FROM: values fill ``col`` where they have the row's key; of several the greatest."""
    v = values.groupBy(*keys).agg(F.max(col).alias("__v"))
    return table.join(v, keys, "left").withColumn(col, F.coalesce("__v", col)).drop("__v")


def cascade(children: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(deleted.select(*keys), keys, "left_anti")


def pending(table: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not processed yet."""
    return table.join(done.select(*keys), keys, "left_anti")


def fresh_cache(cache: DataFrame, now: F.Column, days: int = 7) -> DataFrame:
    return cache.where(F.col("cached_at") > now - F.expr(f"interval {days} days"))


def check_dimension(vectors: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """Rows of another dimension, of which a sound collection has none."""
    return vectors.where(F.size(col) != dim)


def below_book(path: F.Column, stem: F.Column) -> F.Column:
    """A file's path below the folder of its book; as it is, if the folder isn't in it."""
    whole, folder = F.concat(F.lit("/"), path), F.concat(F.lit("/"), stem, F.lit("/"))
    at = F.instr(whole, folder)
    return F.when(at > 0, F.substring(whole, at + F.length(folder), F.length(whole))).otherwise(path)


def archive(books: DataFrame, files: DataFrame, images: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(books with pdf_data, images with bytes and figure number, JSON documents).

    files: book_stem, path, content.  An image's file is the one of its path below the book's
    folder, so images keep one row each whatever ``files`` repeats; an image whose file is missing stays
    as it was.  A book's PDF is one at the root of its folder that isn't a page.  Documents that
    aren't JSON are left out.  Sources are not deleted."""
    from folioscan.functions.text import figure_number

    placed = files.withColumn("file", below_book(F.col("path"), F.col("book_stem")))
    pdf = placed.where(F.col("file").endswith(".pdf") & ~F.contains("file", F.lit("/")) & ~F.col("file").startswith("page_"))
    pdf = pdf.groupBy("book_stem").agg(F.min_by("content", "path").alias("pdf_data"))
    found = placed.groupBy("book_stem", F.col("file").alias("image_path")).agg(F.min_by("content", "path").alias("content"))
    there = F.col("content").isNotNull()
    filled = images.join(found, ["book_stem", "image_path"], "left").withColumns({
        "image_data": F.coalesce("content", "image_data"), "has_data": there | F.col("has_data"),
        "fig_number": F.when(there, figure_number(F.col("caption"))).otherwise(F.col("fig_number")),
    }).select(*images.columns)
    kept = documents.where(F.col("file_name").isin("manifest.json", "toc.json", "chapter_page_map.json", "chunks.json")).where(F.expr("try_parse_json(content) is not null"))
    return write_back(books, pdf, ["book_stem"], "pdf_data"), filled, kept.groupBy("book_id", "book_stem", "file_name").agg(F.max("content").alias("content"))
