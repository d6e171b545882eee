"""A book from its layout blocks to chapter files, in two phases, for all books at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators import knowledge, layout, outputs, segment
from folioscan.sources import tables


def extracted(blocks: DataFrame, keywords: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, contents pages, images) of blocks (book_stem, pos, page_number, type, text, ...)."""
    pages = tables.blocks_to_pages(blocks).select(F.col("book_stem").alias("book"), F.col("page_number").alias("page"), "text")
    images = tables.images_of_blocks(blocks).select(F.col("book_stem").alias("book"), F.col("page_number").alias("page"), F.concat_ws("_", "book_stem", "page_number", "image_seq").alias("image_id"), "image_path", "caption")
    return pages, layout.toc_slice(pages, keywords), images


def chunked(blocks: DataFrame, toc: DataFrame, contents: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, knowledge bases, chapter files): contents pages are left out of the chunks.
    toc: book, chapter, chapter_name, topic, topic_name."""
    b = blocks.select(F.col("book_stem").alias("book"), "pos", F.col("page_number").alias("page"), "type", F.col("text_level").alias("level"), "text", "code_body")
    segments = segment.block_segments(b, toc, skip=contents.select("book", "page"))
    chunks = segment.windows(segments, images=images, chapters=toc)
    base = knowledge.knowledge_base(chunks.select("book", "chunk_id", "page_start", "page_end", "content"), images.select("book", "image_id", "page"))
    files = outputs.chapter_documents(chunks.select("book", "seq", F.col("chapter").alias("chapter_number"), "chapter_name"))
    return chunks, base, files
