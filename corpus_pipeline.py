"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import decontam, jaccard, langid, packing, quality
from folioscan.llm.common import written

#: A document goes if its quality score is below this.
MIN_QUALITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language by a model fitted on those that say theirs: others score below
    ``langid.MIN_SCORE`` or have no letter, and go, null and empty texts among them."""
    return langid.spoken(docs, langid.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels of these documents, scores at least
    MIN_QUALITY.  Null and empty texts score as an empty text."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIN_QUALITY)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near duplicates (five words, 0.8).
    Texts without words are near to nothing; of repeated ids one row stays, null ids all stay."""
    return jaccard.one_of_each(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Null and empty texts stay."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows; a null or empty text has its end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", language), ("quality classifier", good), ("n-gram Jaccard join", distinct), ("benchmark decontamination", unleaked), ("packing", packed)]

#: Learned models and edit matching are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return written(STAGES[-1][1](spark, docs, sf_dir), "stage")
