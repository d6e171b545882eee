"""Inputs derived from the driver's tables, in SQL that Spark and DuckDB both run.

No textbooks ship with the data: a source of documents stands for a book, a
document for a page, every ten pages for a chapter, parts for figures.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import scan
from folioscan.shared import broadcast_if_small, written

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SQL = {
    "pg": "select source as book, cast(row_number() over (partition by source order by doc_id) as int) as page, doc_id, lang, text from documents",
    "ch": """select book, cast(floor((page - 1) / 10.0) as int) + 1 as chapter, min(page) as start_page, max(page) as end_page, min(page) + 3 as toc_start,
             max(concat('part ', cast(floor((page - 1) / 10.0) as int) + 1)) as name from pg group by book, cast(floor((page - 1) / 10.0) as int)""",
    "pv": """select concat(book, '/', cast(floor((page - 1) / 200.0) as int)) as book, cast((page - 1) % 200 + 1 as int) as page, doc_id, text from pg""",
    "cv": """select book, cast(floor((page - 1) / 10.0) as int) + 1 as chapter, min(page) + 3 as toc_start,
             max(concat('part ', cast(floor((page - 1) / 10.0) as int) + 1)) as name from pv group by book, cast(floor((page - 1) / 10.0) as int)""",
    "tp": """select book, cast(floor((page - 1) / 10.0) as int) + 1 as chapter, cast((page - 1) % 10 as int) as pos,
             concat(cast(floor((page - 1) / 10.0) as int) + 1, '.', (page - 1) % 10) as topic,
             case when doc_id % 17 = 0 then 'xii' when doc_id % 13 = 0 then null when doc_id % 11 = 0 then ' 400 ' else cast(page + 3 as string) end as topic_page
             from pg where (page - 1) % 10 in (1, 4, 7) and page % 40 < 30""",
    "im": """select cast(p_partkey as string) as image_id, concat('src', p_partkey % 20) as book, cast(p_partkey % 37 + 1 as int) as page,
             case when p_partkey % 7 = 0 then null when p_partkey % 5 = 0 then case p_partkey % 3 when 0 then '(ii)' when 1 then '(a)' else ' (a)' end when p_partkey % 3 = 0 then p_name
             else concat('Figure ', p_size, '.', p_partkey % 9, case when p_partkey % 4 = 0 then '(a)' else '' end, ' ', p_name) end as caption from part""",
    "ht": """select cast(floor(p_partkey / 6.0) as int) as q, concat('src', p_partkey % 20) as book, cast(p_partkey % 37 + 1 as int) as page,
             cast(row_number() over (partition by floor(p_partkey / 6.0) order by p_retailprice, p_partkey) as int) as rank,
             case when p_partkey % 60 < 6 then 'no pictures' else concat('See Fig. ', p_size, '.', p_partkey % 9, '. Also figure ', p_partkey % 5 + 1, '.', p_partkey % 8, '(b), not figures 5, Figure. 3 or Config 4.1') end as text from part""",
    "qs": "select item_id as q_id, concat('src', item_id % 20) as book, text as q_text from benchmark",
    "mf": """select concat('book', p_partkey) as book, case p_partkey % 5 when 0 then 'unknown' when 1 then null else p_name end as subject,
             case p_partkey % 6 when 0 then 'XII' when 1 then ' vii ' when 2 then '12' when 3 then '' else 'Class X' end as class_number,
             case p_partkey % 4 when 0 then 'II' when 1 then null else '1' end as part, cast(p_partkey % 3 as int) as n_pages from part""",
    "bt": """select cast(floor(o_orderkey / 64.0) as int) as book, cast(row_number() over (partition by floor(o_orderkey / 64.0) order by o_orderkey) as int) as pos,
             case when o_orderkey % 19 = 0 then 'iv' else cast(o_orderkey % 230 + 1 as string) end as start_page, 200 as total_pages from orders""",
    "al": """select cast(floor(o_orderkey / 128.0) as int) as book, cast(row_number() over (partition by floor(o_orderkey / 128.0) order by o_orderkey) as int) as pos,
             cast(o_orderkey % 230 as int) as start_page, 200 as total_pages from orders""",
    "bl": """select conv_id as book, cast(turn as int) as pos, cast(floor(turn / 3.0) as int) + 1 as page,
             case when turn % 5 = 3 then 'equation' when role = 'system' then 'title' when turn % 7 = 6 then 'header' else 'text' end as type, text from conversations""",
    "js": """select event_id, case event_id % 4 when 0 then concat('```json\n', props, '\n```') when 1 then props else concat('  ', props, '  ') end as reply,
             concat('{"chapters": [{"chapter_number": "', event_id % 9, '", "chapter_name": "', event_type, '", "start_page": "', user_id, '"',
             case event_id % 3 when 0 then '}' when 1 then ', "topics": [{"topic_number": "1.1", "topic_name": "a [b]"}, {"topic_number": "1.2", "topic_name": "c"}] }' else ', "topics": [] }, { "chapter_number" : "x", oops "topics": []}' end,
             ', {"chapter_number": "', event_id % 7, '", "chapter_name": "cut', case when event_id % 4 = 0 then '", "topics": [{"topic_number": "2.1"' else '' end) as cut,
             case event_id % 5 when 0 then concat('{"subject": "', event_type, '", "part": "null", "class_number": "XII"}') when 1 then concat('Sure: {"subject": "', event_type, '", "part": "2", "class_number": "9"} ok') else 'no answer' end as who from events""",
}
#: What each stand-in is made of, in order.
NEEDS = {"ch": ["pg"], "tp": ["pg"], "pv": ["pg"], "cv": ["pv"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Inputs:
    """Stand-ins as DataFrames: ``Inputs(spark, sf_dir)("pg")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.dir, name)
        if name == "pg":
            return self._pages()
        return self.sql(SQL[name])

    @functools.cached_property
    def _numbers(self) -> str:
        """Where the page numbers of SQL["pg"] are, made range by range: a source may have a third of all documents."""
        d = self("documents").select("source", "doc_id")
        return written(scan.ranked(d, "source", ["doc_id"], "page").select("source", "doc_id", F.col("page").cast("int").alias("page")), "pages").written_to

    def _pages(self) -> DataFrame:
        d, n = self("documents"), self.spark.read.parquet(self._numbers).withColumnRenamed("doc_id", "of").withColumnRenamed("source", "book")
        return d.join(n, (F.col("doc_id") == F.col("of")) & F.col("source").eqNullSafe(F.col("book"))).select("book", "page", "doc_id", "lang", "text")

    def documents(self) -> DataFrame:
        """The pages of "pg" with the numbers of their documents in the place of their own (book, page, text): no text
        is moved for that.  What is made of them gets its page numbers by ``numbered``."""
        return self("documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text").where("page is not null")

    def numbered(self, rows: DataFrame) -> DataFrame:
        """rows (book, page and others) with the page numbers of the documents that ``page`` has the numbers of."""
        n = self.spark.read.parquet(self._numbers).select(F.col("source").alias("in_book"), "doc_id", F.col("page").alias("nr"))
        return rows.join(n, (F.col("page") == F.col("doc_id")) & F.col("book").eqNullSafe(F.col("in_book"))).withColumn("page", F.col("nr")).drop("in_book", "doc_id", "nr")

    def pages_of(self, wanted: DataFrame) -> DataFrame:
        """Those pages of "pg" that ``wanted``, a written table, has (book, page): few enough, no text is moved for them."""
        n = self.spark.read.parquet(self._numbers).withColumnRenamed("source", "book").join(wanted.select("book", "page").distinct(), ["book", "page"], "left_semi")
        n = n.select(F.col("doc_id").alias("of"), "book", "page")
        d = self("documents").select("source", "doc_id", "text")
        return d.join(broadcast_if_small(n, wanted.count(), 500_000), (F.col("doc_id") == F.col("of")) & (F.col("source") == F.col("book"))).select("book", "page", "doc_id", "text")

    def sql(self, text: str) -> DataFrame:
        import re

        names = [n for n in [*TABLES, *SQL] if re.search(rf"\b(?:from|join)\s+{n}\b", text)]
        text = text.replace("{", "{{").replace("}", "}}")
        for n in names:
            text = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: self(n) for n in names})


def oracle(text: str) -> str:
    """A query for DuckDB with the stand-ins it names as common tables."""
    import re

    need: list[str] = []

    def add(body: str) -> None:
        for n in SQL:
            if re.search(rf"\b(?:from|join)\s+{n}\b", body) and n not in need:
                add(SQL[n])
                need.append(n)

    add(text)
    head = ", ".join(f"{n} as ({SQL[n]})" for n in need)
    if not head:
        return text
    return f"with {head}{', ' + text.lstrip()[5:] if text.lstrip().lower().startswith('with ') else ' ' + text}"
