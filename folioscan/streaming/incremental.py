"""Incremental processing with Structured Streaming."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def run_available(spark: SparkSession, source: str, schema: StructType, sink: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet", per_batch: int = 1000) -> StreamingQuery:
    """Processes the files that are new since the checkpoint, and ends."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_batch).load(source)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> tuple[dict[int, list[tuple[int, str]]], int, set[str]]:
    """(for each bucket its (version, folder), newest first, of versions that are complete; the
    greatest number that a version has; the tags of the complete ones)."""
    fs, root = _files(spark, path)
    out: dict[int, list[tuple[int, str]]] = {}
    last, tags = -1, set()
    for v in fs.listStatus(root) if fs.exists(root) else []:
        name = v.getPath().getName()
        if not (m := re.fullmatch(r"v(\d+)(?:-(\w+))?", name)):
            continue
        last = max(last, int(m[1]))
        if not fs.exists(_files(spark, f"{path}/{name}/_SUCCESS")[1]):
            continue
        tags.add(m[2])
        for f in fs.listStatus(v.getPath()):
            if f.getPath().getName().startswith("bucket="):
                out.setdefault(int(f.getPath().getName()[7:]), []).append((int(m[1]), f.getPath().toString()))
    return {b: sorted(found, reverse=True) for b, found in out.items()}, last, tags


def latest_merge(path: str, keys: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each key.

    Keys are dealt to ``buckets``.  A micro-batch rewrites only the buckets that its rows
    fall in, as the next version of the table, made from what is there.  A version is tagged with the stream and the
    number of the batch, so one that runs again after it was written changes nothing, and a stream with
    a new checkpoint, which counts from 0 again, goes on from the table.  Of a bucket the version before
    the newest is kept for readers that began with it; older ones are removed."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        tag = hashlib.sha256(f"{stream}:{epoch}".encode()).hexdigest()[:16]
        old, last, tags = _versions(spark, path)
        if stream and tag in tags:
            return
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]
        if not touched:
            return
        paths = [old[b][0][1] for b in touched if b in old]
        rows = dealt
        if paths:
            before = spark.read.schema(batch.schema).parquet(*paths)
            rows = before.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).unionByName(dealt)
        rest = [c for c in batch.columns if c not in keys]
        newest = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r"))
        newest.select("bucket", *keys, "r.*").write.partitionBy("bucket").parquet(f"{path}/v{last + 1}-{tag}")
        for b in touched:
            for _, folder in old.get(b, [])[1:]:
                fs, where = _files(spark, folder)
                fs.delete(where, True)

    return sink


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of each bucket; FileNotFoundError if nothing was written."""
    paths = [found[0][1] for found in _versions(spark, path)[0].values()]
    if not paths:
        raise FileNotFoundError(path)
    return spark.read.parquet(*paths)


def event_time(events: DataFrame, col: str = "ts", late: str = "1 day") -> DataFrame:
    """Timestamps without zone cannot carry a watermark; they are taken as the session's."""
    return events.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, late)


def frames(buffer: F.Column) -> F.Column:
    """Events of a server-sent stream: the JSON after ``data:`` of each frame."""
    parts = F.filter(F.split(buffer, "\n\n"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, r"^data:\s*", ""))
