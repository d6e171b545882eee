"""Places where external models and services plug in.  Nothing is made up here:
without a model a call says so."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan import schemas
from folioscan.functions import text as T
from folioscan.operators import layout

Embed = Callable[[list[str]], list[list[float]]]
Chat = Callable[[str], str]


class NoModel(RuntimeError):
    pass


def embed(rows: DataFrame, make: Callable[[], Embed] | None, text: str = "text", batch: int = 32) -> DataFrame:
    """Adds ``embedding`` (normalised); ``make`` builds the model once per worker."""
    if make is None:
        raise NoModel("no embedding model: pass a factory, or join vectors that exist already")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            out = []
            for i in range(0, len(f), batch):
                for v in model(f[text].iloc[i : i + batch].tolist()):
                    size = sum(x * x for x in v) ** 0.5 or 1.0
                    out.append([float(x / size) for x in v])
            yield f.assign(embedding=out)

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, embedding array<float>")


def ask(rows: DataFrame, make: Callable[[], Chat] | None, prompt: str = "prompt", tries: int = 3, fallback: Callable[[], Chat] | None = None) -> DataFrame:
    """Adds ``reply`` and ``error``: after ``tries`` failures, or one that names a
    limit (429, 413), the fallback model is asked; a row that fails has its error."""
    if make is None:
        raise NoModel("no chat model: pass a factory")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = make(), fallback() if fallback else None

        def one(p: str) -> tuple[str | None, str | None]:
            said = "no attempt"
            for _ in range(tries):
                try:
                    return first(p), None
                except Exception as e:  # noqa: BLE001
                    said = str(e)
                    if "429" in said or "413" in said:
                        break
            if second:
                try:
                    return second(p), None
                except Exception as e:  # noqa: BLE001
                    said = str(e)
            return None, said

        for f in frames:
            got = [one(p) for p in f[prompt]]
            yield f.assign(reply=[g[0] for g in got], error=[g[1] for g in got])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, reply string, error string")


def ask_json(rows: DataFrame, make: Callable[[], Chat] | None, schema: str, prompt: str = "prompt", tries: int = 3, fallback: Callable[[], Chat] | None = None) -> DataFrame:
    """Adds ``answer`` (by ``schema``, DDL), ``salvaged`` (chapters of a cut reply) and ``error``:
    a reply that is neither JSON nor can be salvaged is an error with its beginning."""
    a = ask(rows, make, prompt, tries, fallback).withColumn("__j", T.json_reply(F.col("reply"), schema))
    bad = F.concat(F.lit("Response not valid JSON:\n"), F.substring(T.strip_fences(F.col("reply")), 1, 500))
    nothing = F.col("reply").isNotNull() & F.col("__j.whole").isNull() & F.col("__j.salvaged").isNull()
    return a.select(*rows.columns, F.col("__j.whole").alias("answer"), F.col("__j.salvaged").alias("salvaged"), F.coalesce("error", F.when(nothing, bad)).alias("error"))


def shown(images: DataFrame, most: int) -> DataFrame:
    """book, images: the first page images of each book in order.  images: book, page, image_b64."""
    first = images.selectExpr("*", "row_number() over (partition by book order by page) as nth").where(F.col("nth") <= most)
    return first.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "image_b64"))), lambda x: x["image_b64"]).alias("images"))


def identify_subjects(images: DataFrame, books: DataFrame, make: Callable[[], Chat] | None, question: str, most: int = 5) -> DataFrame:
    """book, subject, part, class_number: what a model says of the first pages' images.  The
    prompt is JSON of ``images`` and ``question``.  A book without images, or whose call
    fails, is Unknown."""
    p = shown(images, most).withColumn("prompt", F.to_json(F.struct("images", F.lit(question).alias("question"))))
    said = ask(p.select("book", "prompt"), make).withColumn("i", T.identity(F.col("reply")))
    unknown = F.struct(F.lit("Unknown").alias("subject"), F.lit(None).cast("string").alias("part"), F.lit("Unknown").alias("class_number"))
    known = said.select("book", F.when(F.col("error").isNull(), F.col("i")).alias("i"))
    return books.select("book").distinct().join(known, "book", "left").select("book", F.coalesce("i", unknown).alias("i")).select("book", "i.*")


def extract_contents(pages: DataFrame, images: DataFrame, make: Callable[[], Chat] | None, question: str, most: int = 5, chars: int = 6000) -> DataFrame:
    """book, chapters, truncated, error: the table of contents a model reads from the contents
    pages (book, page, text) and their first images.  Texts are joined in order and cut to
    ``chars``.  A cut reply gives its complete chapters; a failed call gives none and its error."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n\n")
    t = pages.groupBy("book").agg(F.substring(T.strip(text), 1, chars).alias("toc_text")).join(shown(images, most), "book", "left")
    p = t.select("book", F.to_json(F.struct("images", F.concat(F.lit(question), "toc_text").alias("question"))).alias("prompt"))
    chapter = schemas.CHAPTER.simpleString()
    a = ask_json(p, make, f"chapters array<{chapter}>")
    chapters = F.coalesce("answer.chapters", "salvaged.chapters", F.array().cast(f"array<{chapter}>"))
    return a.select("book", chapters.alias("chapters"), F.coalesce("salvaged._truncated", F.lit(False)).alias("truncated"), "error")


def reread_contents(book: str, stored: DataFrame, pages: DataFrame, images: DataFrame, make: Callable[[], Chat] | None, question: str, keywords: list[str]) -> DataFrame:
    """stored (what extract_contents gave) with the contents of one book found and read again;
    if no contents page is found, or the call fails, what was stored stays."""
    one = layout.toc_slice(pages.where(F.col("book") == book), keywords).select("book", "page").join(pages, ["book", "page"])
    new = extract_contents(one, images.join(one.select("book", "page"), ["book", "page"], "left_semi"), make, question).where("error is null")
    new = new.select(*[F.col(c).alias(c) for c in stored.columns])
    return stored.join(new.select(F.col("book").alias("__b")), stored["book"] == F.col("__b"), "left_anti").unionByName(new)


def missing_vectors(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows whose vector the cache does not hold: the only ones to embed."""
    return rows.join(cache.select(key), key, "left_anti")


def cached_vectors(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return rows.join(cache.select(key, F.col("embedding")), key)
