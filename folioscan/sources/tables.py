"""Reading page files, blocks, JSON documents and keyword lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import schemas
from folioscan.functions import text as T

#: Headings of a table of contents (fixed values).
TOC_KEYWORDS = ["CONTENTS", "CONTENT", "TABLE OF CONTENTS", "INDEX", "CHAPTER INDEX", "CONTENTS PART I", "CONTENTS PART II", "CONTENTS OF"]
#: What counts without a file of them (fixed values).
TOC_BUILT_IN = ["CONTENTS", "CONTENT", "TABLE OF CONTENTS"]
#: Subjects whose pages are read as plain text (fixed values).
TEXT_SUBJECTS = ["english", "hindi", "sanskrit", "history", "geography", "political science", "sociology"]


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the PDF files of a folder itself; content is read only where selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder)


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """book_stem, page_number, text of ``root/<book>/txts/page_NNNN.txt``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "page_*.txt").load(f"{root}/*/txts")
    name = F.col("path")
    return raw.select(F.regexp_extract(name, r"/([^/]+)/txts/[^/]+$", 1).alias("book_stem"), T.page_of_name(name).alias("page_number"), F.decode("content", "UTF-8").alias("text"))


def json_documents(spark: SparkSession, paths: str | list[str], schema) -> DataFrame:
    """One row per document, with the path it came from."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(paths).withColumn("path", F.input_file_name())


def keywords(spark: SparkSession, path: str | None = None, most: int = 100_000) -> list[str]:
    """Upper-cased lines that are neither blank nor comments; a short built-in list where
    there is no file.  They become one literal, so more than ``most`` raise ValueError."""
    if path is None:
        return list(TOC_BUILT_IN)
    try:
        rows = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return list(TOC_BUILT_IN)
    found = rows.select(F.upper(T.strip("value")).alias("k")).where("k <> '' and k not like '#%'").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} keywords in {path}")
    return [r.k for r in found]


def text_or_ocr(native: Column, ocr: Column, failure: Column | None = None) -> Column:
    """Recognised text only where a page has no text of its own; where recognition failed, a
    text that says so, so that no page is empty for that reason."""
    said = F.concat(F.lit("[OCR failed: "), failure, F.lit("]")) if failure is not None else F.lit(None).cast("string")
    return F.coalesce(T.falsy(T.strip(native)), said, ocr)


def page_of_layout(blocks: DataFrame) -> DataFrame:
    """Page text from positioned blocks (book_stem, page_number, pos, y0, text):
    stripped, empties dropped, from top to bottom."""
    kept = blocks.withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("y0", "pos", "text")))
    return kept.groupBy("book_stem", "page_number").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))


def blocks_of_json(docs: DataFrame, json_col: str = "content") -> DataFrame:
    """One row per block: book_stem, pos, page_number (1-based) and the block's fields."""
    b = docs.select("book_stem", F.posexplode(F.from_json(json_col, schemas.BLOCKS)).alias("pos", "b"))
    return b.select("book_stem", "pos", (F.coalesce("b.page_idx", F.lit(0)) + 1).alias("page_number"), "b.*")


def blocks_to_pages(blocks: DataFrame) -> DataFrame:
    """Text of each page that has a block: titles, texts and equations in $$, in
    block order with blank lines between; other blocks add nothing."""
    body = T.strip(F.coalesce("text", F.lit("")))
    math = F.when(body.startswith("$$") | (body == ""), body).otherwise(F.concat(F.lit("$$"), body, F.lit("$$")))
    piece = F.when(F.col("type").isin("text", "title"), body).when(F.col("type") == "equation", math).otherwise("")
    grouped = blocks.select("book_stem", "page_number", "pos", piece.alias("piece")).groupBy("book_stem", "page_number")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return grouped.agg(F.array_join(F.filter(F.transform(ordered, lambda x: x["piece"]), lambda x: x != ""), "\n\n").alias("text"))


def images_of_blocks(blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """book_stem, page_number, image_path, caption (the first or null), number on its page.  With ``files`` (book_stem,
    path below the book's folder) a path is that of the layout output, below the book's folder, if that file is there; else as told."""
    caption = F.try_element_at("image_caption", F.lit(1))
    rows = blocks.where("type = 'image'").select("book_stem", "page_number", "pos", F.col("img_path").alias("image_path"), caption.alias("caption"))
    if files is not None:
        there = files.select("book_stem", F.col("path").alias("__full")).distinct()
        rows = rows.withColumn("__full", F.concat(F.lit("mineru_output/"), "book_stem", F.lit("/txt/"), "image_path"))
        rows = rows.join(there.withColumn("__there", F.lit(True)), ["book_stem", "__full"], "left").withColumn("image_path", F.when(F.col("__there"), F.col("__full")).otherwise(F.col("image_path"))).drop("__full", "__there")
    return rows.selectExpr("*", "row_number() over (partition by book_stem, page_number order by pos) as image_seq")


def extractor(subject: Column) -> Column:
    return F.when(F.lower(T.strip(subject)).isin(TEXT_SUBJECTS), "text").otherwise("layout")


def first_output(manifests: DataFrame) -> DataFrame:
    """book_stem, folder: the first folder whose manifest names a source with that
    stem.  manifests: folder, source_pdf; unreadable manifests have a null source."""
    stem = F.regexp_replace(F.regexp_extract("source_pdf", r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    return manifests.where("source_pdf is not null").select(stem.alias("book_stem"), "folder").groupBy("book_stem").agg(F.min("folder").alias("folder"))


def resume_state(books: DataFrame, folders: DataFrame, blocks: DataFrame) -> DataFrame:
    """book_stem, state: ``new`` without an output folder, ``partial`` without
    extracted blocks, else ``done``: the only books to process again are not done."""
    f = folders.select("book_stem", F.lit(True).alias("has_folder")).distinct()
    b = blocks.select("book_stem", F.lit(True).alias("has_blocks")).distinct()
    state = F.when(F.col("has_folder").isNull(), "new").when(F.col("has_blocks").isNull(), "partial").otherwise("done")
    return books.select("book_stem").distinct().join(f, "book_stem", "left").join(b, "book_stem", "left").select("book_stem", state.alias("state"))


def preview(pages: DataFrame, n: int = 5, chars: int = 200) -> DataFrame:
    """The first pages of each book, with the beginning of their text."""
    return pages.where(F.col("page") <= n).select("book", "page", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text_preview"))


def page_images(files: DataFrame) -> DataFrame:
    """Page images as base64 text, on one line."""
    return files.select("path", F.translate(F.base64("content"), "\r\n", "").alias("image_b64"))


def split_pages(files: DataFrame, make=None) -> DataFrame:
    """(path, page, content) of each page of each PDF; ``make`` builds the splitter
    (bytes -> list of bytes) once per worker.  None ships with this package."""
    from folioscan.operators.adapters import NoModel

    if make is None:
        raise NoModel("no PDF library: pass a factory of a splitter")

    def run(frames):
        import pandas as pd

        split = make()
        for f in frames:
            rows = [(p, i, page) for p, c in zip(f.path, f.content) for i, page in enumerate(split(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, content binary")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an external database; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def completed(texts: DataFrame, pages: DataFrame, extract: Column) -> DataFrame:
    """book_stem, page_number, text, extracted: the texts that a book has, and those of its other pages, which
    alone are extracted (``extract``, of columns of pages).  texts: book_stem, page_number, text; pages: book_stem, page_number and
    what extract reads."""
    key = ["book_stem", "page_number"]
    new = pages.join(texts.select(*key), key, "left_anti").select(*key, extract.alias("text"), F.lit(True).alias("extracted"))
    return texts.select(*key, "text", F.lit(False).alias("extracted")).unionByName(new)
