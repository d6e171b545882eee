"""Work book by book that may fail for some: repairing manifests, status rows, clean-up."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import adapters, checks, documents
from folioscan.session import ship
from folioscan.shared import file_system


def validated(manifests: DataFrame, images: DataFrame, make: Callable[[], adapters.Chat] | None, question: str) -> DataFrame:
    """manifests (book_stem, content: JSON) with what was found and done: content (patched where the model was asked
    and answered), status, patched, subject, part, class_number, pages, error.

    A sound manifest is ``ok``, whether or not it has pages.  Of one whose identity is missing, unknown or in Roman
    numbers, the first pages' images (book, page, image_b64) are shown to the model: ``patched`` with
    its answer, other keys of the manifest untouched; ``no_pdfs`` without images; ``error`` where the call fails, the answer
    holds no JSON or the manifest isn't JSON.  One book's failure is its own."""
    v = manifests.withColumn("doc", documents.parsed(F.col("content")))
    v = v.select("book_stem", "content", F.col("doc").isNotNull().alias("sound"), *[documents.field(F.col("doc"), f"$.{c}").alias(c) for c in documents.IDENTITY], F.coalesce(F.size(documents.pages(F.col("doc"))), F.lit(0)).alias("pages"))
    fix = v.where(F.col("sound") & checks.needs_fix(F.col("subject"), F.col("class_number"), F.col("part")))
    shown = adapters.shown(images.join(fix.select(F.col("book_stem").alias("book")), "book", "left_semi"), 5)
    asked = adapters.ask(shown.select("book", F.to_json(F.struct("images", F.lit(question).alias("question"))).alias("prompt")), make)
    text = T.strip_fences(F.col("reply"))
    answered = T.valid_json(text) | text.rlike(r"\{[^{}]+\}")
    error = F.coalesce("error", F.when(~F.coalesce(answered, F.lit(False)), F.concat(F.lit("No JSON found in response: "), F.substring(F.coalesce(text, F.lit("")), 1, 200))))
    said = asked.select(F.col("book").alias("book_stem"), T.identity(F.col("reply")).alias("i"), error.alias("error"), F.lit(True).alias("asked"))
    r = v.join(fix.select("book_stem", F.lit(True).alias("bad")), "book_stem", "left").join(said, "book_stem", "left")
    status = (
        F.when(~F.col("sound"), "error").when(F.col("bad").isNull(), "ok").when(F.col("asked").isNull(), "no_pdfs").when(F.col("error").isNotNull(), "error").otherwise("patched")
    )
    r = r.withColumn("status", status)
    done = F.col("status") == "patched"
    new = documents.patched(documents.parsed(F.col("content")), {c: F.col(f"i.{c}") for c in documents.IDENTITY})
    put = {c: F.when(done, F.col(f"i.{c}")).otherwise(F.col(c)) for c in documents.IDENTITY}
    return r.select("book_stem", F.when(done, new).otherwise(F.col("content")).alias("content"), "status", done.alias("patched"), *[c.alias(k) for k, c in put.items()], "pages", F.coalesce("error", F.when(~F.col("sound"), "manifest is not JSON")).alias("error"))


def reports(found: DataFrame) -> DataFrame:
    """book_stem and one JSON report each, from what ``validated`` gave."""
    return found.select("book_stem", F.to_json(F.struct(F.col("book_stem").alias("book"), "status", "patched", *documents.IDENTITY, "pages", "error"), {"ignoreNullFields": "false"}).alias("report"))


def isolated(rows: DataFrame, by: str, work: Callable[[pd.DataFrame], dict | None]) -> DataFrame:
    """(by, status, result, error): ``work`` on each book's rows, for steps that must see a book whole.  What it
    returns is the book's result, as JSON (``success``); None is ``skipped``; what it raises is that book's ``error`` and
    nobody else's.  Give narrow rows.  Totals: ``checks.rollup``."""
    ship(rows.sparkSession)

    def run(key: tuple, book: pd.DataFrame) -> pd.DataFrame:
        try:
            out = work(book)
            row = (key[0], "skipped" if out is None else "success", None if out is None else json.dumps(out), None)
        except Exception as e:  # whatever a step raises
            row = (key[0], "error", None, f"{type(e).__name__}: {e}")
        return pd.DataFrame([row], columns=[by, "status", "result", "error"])

    kind = dict(rows.dtypes)[by]
    return rows.groupBy(by).applyInPandas(run, f"{by} {kind}, status string, result string, error string")


def cleared(spark: SparkSession, root: str, books: list[str], by: str = "book_stem") -> list[str]:
    """Removes these books' partitions of the tables in ``root`` before they are made anew; what was removed.
    Other books, and tables that aren't partitioned by book, stay."""
    fs, where = file_system(spark, root)
    gone = []
    for table in fs.listStatus(where) if fs.exists(where) else []:
        for part in fs.listStatus(table.getPath()) if table.isDirectory() else []:
            name = part.getPath().getName()
            escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
            if name in {f"{by}={escape(b)}" for b in books}:
                fs.delete(part.getPath(), True)
                gone.append(f"{table.getPath().getName()}/{name}")
    return sorted(gone)
