"""A book's rows of several tables, published together.

The rows of a publish are written first, in a folder of their own.  A book then becomes
visible by one small file that names that folder, put in the place of the one before by a
rename.  Readers follow these files, so a book's chunks, images and documents are of one
publish, whatever fails between two writes.  Nothing else is kept: no log, no statistics.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscan.shared import file_system, written_text

BY = "book_stem"


def _folder(book: str) -> str:
    return hashlib.sha256(book.encode()).hexdigest()[:20]


def stage(root: str, tables: dict[str, DataFrame]) -> tuple[str, dict[str, set[str]]]:
    """(version, the tables that each book has rows in): all rows written, nothing visible yet."""
    version, has = uuid.uuid4().hex, {}
    for name, df in tables.items():
        at, spark = f"{root}/data/{version}/{name}", df.sparkSession
        df.withColumn("__book", F.substring(F.sha2(F.col(BY), 256), 1, 20)).write.partitionBy("__book").parquet(at)
        for r in spark.read.parquet(at).select(BY).distinct().collect() if _exists(spark, at) else []:
            has.setdefault(r[0], set()).add(name)
    return version, has


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where) and any("__book=" in f.getPath().getName() for f in fs.listStatus(where))


def point(spark: SparkSession, root: str, version: str, books: dict[str, set[str]]) -> None:
    """Makes the version visible, book by book."""
    for book, tables in sorted(books.items()):
        written_text(spark, f"{root}/books/{_folder(book)}.json", json.dumps({"book": book, "version": version, "tables": sorted(tables)}))


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], books: list[str] | None = None) -> str:
    """Replaces the rows of these books in all tables, each book at once.  ``books``: those to replace,
    so that one without rows becomes empty; by default those that have rows.  tables: each with
    book_stem.  The driver sees a name per book."""
    version, has = stage(root, tables)
    point(spark, root, version, {b: has.get(b, set()) for b in books} if books is not None else has)
    return version


def pointers(spark: SparkSession, root: str) -> list[dict]:
    """Book, version and tables of every book, as they are now."""
    fs, where = file_system(spark, f"{root}/books")
    if not fs.exists(where):
        return []
    files = [f.getPath().toString() for f in fs.listStatus(where) if f.getPath().getName().endswith(".json")]
    return [json.loads(r.value) for r in spark.read.text(files, wholetext=True).collect()] if files else []


def read(spark: SparkSession, root: str, table: str, schema: StructType | str, books: list[str] | None = None) -> DataFrame:
    """A table's visible rows; of ``books`` only, whose folders alone are read."""
    at = [p for p in pointers(spark, root) if table in p["tables"] and (books is None or p["book"] in books)]
    paths = [f"{root}/data/{p['version']}/{table}/__book={_folder(p['book'])}" for p in at]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def swept(spark: SparkSession, root: str) -> list[str]:
    """Removes the folders of versions that no book points to; to be run when no publish is under way."""
    used, gone = {p["version"] for p in pointers(spark, root)}, []
    fs, where = file_system(spark, f"{root}/data")
    for f in fs.listStatus(where) if fs.exists(where) else []:
        if f.getPath().getName() not in used:
            fs.delete(f.getPath(), True)
            gone.append(f.getPath().getName())
    return gone
