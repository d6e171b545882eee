"""JSON documents of open schema: what is known is read and patched, all else stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T

IDENTITY = ["subject", "part", "class_number"]


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content, doc of JSON files; doc (VARIANT) is null where the content isn't one JSON value."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.decode("content", "UTF-8").alias("content"))
    return files.withColumn("doc", parsed(F.col("content")))


def parsed(content: Column) -> Column:
    return F.when(T.valid_json(content), F.try_parse_json(content))


def field(doc: Column, path: str, kind: str = "string") -> Column:
    """A value by its path, whatever kind it came as; null where there is none or it doesn't convert."""
    return F.try_variant_get(doc, path, kind)


def pages(doc: Column) -> Column:
    """The page entries of a manifest: page, pdf, txt."""
    each = F.try_variant_get(doc, "$.pages", "array<variant>")
    return F.transform(each, lambda x: F.struct(field(x, "$.page", "int").alias("page"), field(x, "$.pdf").alias("pdf"), field(x, "$.txt").alias("txt")))


def patched(doc: Column, values: dict[str, Column]) -> Column:
    """The document as JSON with these keys set (to JSON null where the value is null); every other key, nested or
    not, keeps its value and kind.  Null for what is no object."""
    whole = F.try_variant_get(doc, "$", "map<string, variant>")
    rest = F.map_filter(whole, lambda k, _: ~k.isin(*values))
    put = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(F.to_variant_object(F.struct(v.alias("x"))), F.parse_json(F.lit('{"x": null}'))))])
    put = F.transform_values(put, lambda _, v: F.coalesce(F.try_variant_get(v, "$.x", "variant"), F.parse_json(F.lit("null"))))
    return F.to_json(F.map_concat(rest, put))


def with_identity(documents: DataFrame, identity: DataFrame, key: str = "book_stem") -> DataFrame:
    """documents (key, content) with subject, part and class_number of identity (key, ...) set; those that
    identity does not name, and those that are no JSON object, stay as they are."""
    new = identity.groupBy(key).agg(F.max(F.struct(*IDENTITY)).alias("__i"))
    d = documents.join(new, key, "left")
    put = patched(parsed(F.col("content")), {c: F.col(f"__i.{c}") for c in IDENTITY})
    return d.withColumn("content", F.when(F.col("__i").isNull(), F.col("content")).otherwise(F.coalesce(put, "content"))).drop("__i")
