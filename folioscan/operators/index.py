"""Vector indexes of pages and chunks: filter, cache, model, collection.

A collection has a dimension and points (id, vector, payload), which are published book by
book.  Vectors of texts are kept in a cache for some days, by a key of model and text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import adapters, publish
from folioscan.shared import file_system, written, written_text

PAGE_LEAST, CHUNK_LEAST, PREVIEW, CACHE_DAYS = 50, 20, 200, 7
CACHE = "cache_key string, embedding array<float>, cached_at timestamp"
PAGE_PAYLOAD = ["book_stem", "subject", "class_number", "part", "page_number", "txt_file"]
CHUNK_PAYLOAD = ["chunk_id", "book_id", "book_stem", "class_number", "subject", "part", "chapter_number", "chapter_name", "topic_number", "topic_name", "page_number"]


@dataclass
class Model:
    """``make`` builds the embedding function once per worker."""

    name: str
    dimension: int
    make: Callable[[], adapters.Embed]


@dataclass
class Report:
    """What a build did: the collection was created, kept or recreated; rows with a point, rows too short or
    without text, texts that the model was asked for."""

    collection: str
    embedded: int
    skipped: int
    computed: int


def open_collection(spark: SparkSession, root: str, dimension: int) -> str:
    """``created``, ``kept``, or ``recreated`` where the stored dimension is another: then all points go."""
    fs, where = file_system(spark, f"{root}/collection.json")
    before = json.loads(spark.read.text(f"{root}/collection.json", wholetext=True).first()[0])["dimension"] if fs.exists(where) else None
    if before == dimension:
        return "kept"
    if before is not None:
        for part in ("books", "data"):
            fs.delete(file_system(spark, f"{root}/{part}")[1], True)
    written_text(spark, f"{root}/collection.json", json.dumps({"dimension": dimension}))
    return "created" if before is None else "recreated"


def cached(spark: SparkSession, path: str, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """The newest vector of each key that is not too old; none if there is no cache yet."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return spark.createDataFrame([], CACHE).select("cache_key", "embedding")
    fresh = spark.read.schema(CACHE).option("recursiveFileLookup", True).parquet(path).where(F.col("cached_at") > now - F.expr(f"interval {days} days"))
    return fresh.groupBy("cache_key").agg(F.max_by("embedding", "cached_at").alias("embedding"))


def fill_cache(rows: DataFrame, path: str, model: Model, now: Column, days: int = CACHE_DAYS) -> int:
    """Asks the model for each text (cache_key, text) that the cache lacks, once; how many these were.
    A cached vector of another dimension counts as lacking."""
    spark = rows.sparkSession
    known = cached(spark, path, now, days).where(F.size("embedding") == model.dimension)
    new = adapters.missing_vectors(rows.select("cache_key", "text").dropDuplicates(["cache_key"]), known)
    at = f"{path}/{uuid.uuid4().hex}"
    adapters.embed(new, model.make).select("cache_key", "embedding", now.cast("timestamp").alias("cached_at")).write.parquet(at)
    return spark.read.schema(CACHE).parquet(at).count()


def build(rows: DataFrame, root: str, cache: str, model: Model, payload: list[str], least: int, now: Column | None = None) -> Report:
    """Points of rows (point_id, text and the payload, with book_stem) in the collection at ``root``.

    Rows whose stripped text has fewer than ``least`` characters, or that have none, are skipped.  Only texts
    that the cache lacks reach the model; a second run asks for none.  Points of ids that the collection has are
    replaced, others of the same books stay, and a book's points are published together.  Rows are written once,
    the skipped ones without text and vector, so that counts are read from that table.  A null book_stem has no
    place in a collection: such rows are skipped.
    """
    spark, now = rows.sparkSession, now if now is not None else F.current_timestamp()
    action = open_collection(spark, root, model.dimension)
    text = T.strip("text")
    fit = F.coalesce((F.length(text) >= least) & F.col("book_stem").isNotNull(), F.lit(False))
    r = rows.select("point_id", *payload, text.alias("text"), fit.alias("fit"), T.cache_key(model.name, text).alias("cache_key"))
    computed = fill_cache(r.where("fit"), cache, model, now)
    vectors = cached(spark, cache, now).where(F.size("embedding") == model.dimension)
    preview = F.when(F.col("fit"), F.substring("text", 1, PREVIEW)).alias("text_preview")
    staged = written(r.join(vectors, "cache_key", "left").select("point_id", F.when(F.col("fit"), F.col("embedding")).alias("embedding"), preview, *payload, "fit"), "points")
    count = {x.fit: x.n for x in staged.groupBy("fit").agg(F.count(F.lit(1)).alias("n")).collect()}
    new = staged.where("fit").drop("fit")
    new = new.groupBy("point_id").agg(F.max(F.struct(*new.columns)).alias("p")).select("p.*")  # a page given twice is one point
    books = [x.book_stem for x in staged.where("fit").select("book_stem").distinct().collect()]
    old = publish.read(spark, root, "points", new.schema, books)
    publish.publish(spark, root, {"points": old.join(new.select("point_id"), "point_id", "left_anti").select(*new.columns).unionByName(new)})
    publish.swept(spark, root)
    return Report(action, count.get(True, 0), count.get(False, 0), computed)


def pages(rows: DataFrame, books: DataFrame, root: str, cache: str, model: Model, now: Column | None = None) -> Report:
    """rows: book_stem, page_number, txt_file, text (null: its file is missing); books: book_stem, subject, class_number, part."""
    unknown = lambda c: F.coalesce(T.falsy(F.col(c)), F.lit("Unknown")).alias(c)
    one = books.groupBy("book_stem").agg(F.max(F.struct("subject", "class_number", "part")).alias("b")).select("book_stem", "b.*")
    r = rows.join(one, "book_stem", "left").select("book_stem", unknown("subject"), unknown("class_number"), "part", "page_number", "txt_file", "text", T.point_id(F.col("book_stem"), F.col("page_number")).alias("point_id"))
    return build(r, root, cache, model, PAGE_PAYLOAD, PAGE_LEAST, now)


def points(spark: SparkSession, root: str, schema: str, books: list[str] | None = None) -> DataFrame:
    return publish.read(spark, root, "points", schema, books)


def chunks(rows: DataFrame, root: str, cache: str, model: Model, now: Column | None = None) -> tuple[Report, DataFrame]:
    """(report, rows with point_id filled in): chunks without a point id are embedded, the others left as they
    are.  rows: id, point_id, content and the payload.  A point's id is derived from the chunk's."""
    key = F.sha2(F.concat(F.lit("chunk:"), F.col("id").cast("string")), 256)
    uid = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    open_ = F.col("point_id").isNull()
    pending = rows.where(open_).select(uid.alias("point_id"), F.col("id").cast("string").alias("chunk_id"), *CHUNK_PAYLOAD[1:], F.col("content").alias("text"))
    report = build(pending, root, cache, model, CHUNK_PAYLOAD, CHUNK_LEAST, now)
    fit = F.coalesce((F.length(T.strip("content")) >= CHUNK_LEAST) & F.col("book_stem").isNotNull(), F.lit(False))
    return report, rows.withColumn("point_id", F.when(open_ & fit, uid).otherwise(F.col("point_id")))
