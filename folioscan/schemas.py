"""Explicit schemas of everything that is read from JSON, and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Numbers in a table of contents may be digits, words or Roman, so every leaf is a string.
TOC = _struct(chapters=T.ArrayType(_struct(chapter_number=_S, chapter_name=_S, start_page=_S, topics=T.ArrayType(_struct(topic_number=_S, topic_name=_S, start_page=_S)))), error=_S)
MANIFEST = _struct(source_pdf=_S, subject=_S, part=_S, class_number=_S, extractor=_S, pages=T.ArrayType(_struct(page=T.IntegerType(), pdf=_S, txt=_S)))
BLOCK = _struct(type=_S, text=_S, text_level=T.IntegerType(), page_idx=T.IntegerType(), img_path=_S, image_caption=T.ArrayType(_S), image_footnote=T.ArrayType(_S), bbox=T.ArrayType(T.DoubleType()), code_body=_S)
BLOCKS = T.ArrayType(BLOCK)
IDENTITY = _struct(subject=_S, part=_S, class_number=_S)
CHAPTER = _struct(chapter_number=_S, chapter_name=_S, start_page=_S, topics=T.ArrayType(_struct(topic_number=_S, topic_name=_S, start_page=_S)))
CHAPTER_CHECKED = T.StructType([*CHAPTER.fields, T.StructField("corrupt", _S)])

#: DDL of the stored tables, the union of what every phase writes.
TABLES = {
    "books": "id string, book_stem string, subject string, part string, class_number string, total_pages int, created_at timestamp, updated_at timestamp, pdf_data binary",
    "chunks": "id string, book_id string, book_stem string, class_number string, subject string, part string, chapter_number string, chapter_name string, topic_number string, topic_name string, page_number int, content string, point_id string",
    "images": "id string, book_id string, book_stem string, page_number int, image_path string, caption string, description string, bbox array<double>, image_data binary, fig_number string, has_data boolean",
    "json_files": "book_id string, book_stem string, file_name string, content string",
}
