"""Pages as a data source: ``spark.read.format("folio_pages").load(root)``.

A book is a folder ``root/<book>`` with page texts in ``txts/page_NNNN.txt`` or, where a
splitter is named, PDF files whose bytes it turns into page texts.  A book is one partition; filters on book
and page are applied before a file is opened.  As a stream, books that appear are read once.

Load anew for each query (``load``): Spark 4.1 keeps the filters that it passed to a Python source with the
loaded frame, so that another query on the same frame would find them still applied.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

NAME = "folio_pages"
SCHEMA = "book_stem string, page_number int, text string"
_PAGE = re.compile(r"page_(\d+)\.txt$")


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters passed to it."""
    from folioscan.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)


def load(spark: SparkSession, root: str, splitter: str | None = None) -> DataFrame:
    """The pages below root, for one query."""
    register(spark)
    reader = spark.read.format(NAME)
    return (reader.option("splitter", splitter) if splitter else reader).load(root)


class Book(InputPartition):
    def __init__(self, name: str, low: int, high: int):
        self.name, self.low, self.high = name, low, high


def _store(root: str) -> tuple:
    """(pyarrow's file system of a path, the path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _listed(root: str, kind: str) -> list[str]:
    from pyarrow import fs

    store, at = _store(root)
    wanted = fs.FileType.Directory if kind == "folders" else fs.FileType.File
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == wanted)


def _bytes(path: str) -> bytes:
    store, at = _store(path)
    with store.open_input_stream(at) as f:
        return f.read()


def splitter_of(name: str | None) -> Callable[[bytes], list[str | None]] | None:
    """``module:function``: what turns the bytes of a PDF into its pages' texts."""
    if not name:
        return None
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def _pages(root: str, book: Book, splitter: str | None) -> Iterator[tuple]:
    split = splitter_of(splitter)
    if split:
        page = 0
        for name in (n for n in _listed(f"{root}/{book.name}", "files") if n.lower().endswith(".pdf")):
            for text in split(_bytes(f"{root}/{book.name}/{name}")):
                page += 1
                if book.low <= page <= book.high:
                    yield book.name, page, text
        return
    for name in _listed(f"{root}/{book.name}/txts", "files"):
        m = _PAGE.match(name)
        if m and book.low <= int(m[1]) <= book.high:
            yield book.name, int(m[1]), _bytes(f"{root}/{book.name}/txts/{name}").decode("utf-8", "ignore")


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.splitter = options["path"].rstrip("/"), options.get("splitter")
        self.books: set[str] | None = None
        self.low, self.high = -(1 << 31), 1 << 31

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on book and page; those that it doesn't take are Spark's."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("book_stem",) and isinstance(f, (EqualTo, In)):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.books = named if self.books is None else self.books & named
            elif column == ("page_number",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan)
                most = f.value - isinstance(f, LessThan)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, least)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, most)
            else:
                yield f

    def partitions(self) -> list[Book]:
        return [Book(b, self.low, self.high) for b in _listed(self.root, "folders") if self.books is None or b in self.books]

    def read(self, partition: Book | None) -> Iterator[tuple]:
        return iter(()) if partition is None else _pages(self.root, partition, self.splitter)


class PageStreamReader(DataSourceStreamReader):
    """The offset is the books that were there: a name for each."""

    def __init__(self, options: dict):
        self.root, self.splitter = options["path"].rstrip("/"), options.get("splitter")

    def initialOffset(self) -> dict:
        return {"books": []}

    def latestOffset(self) -> dict:
        return {"books": _listed(self.root, "folders")}

    def partitions(self, start: dict, end: dict) -> list[Book]:
        before = set(start["books"])
        return [Book(b, -(1 << 31), 1 << 31) for b in end["books"] if b not in before]

    def read(self, partition: Book) -> Iterator[tuple]:
        return _pages(self.root, partition, self.splitter)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema: StructType) -> PageStreamReader:
        return PageStreamReader(self.options)
