"""Shared folder, tables cut from their lineage, settings that hold for one write."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.session import ship

#: Shuffle files of a finished write are deleted at once: written tables are read instead.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.  Where
    none is named, a temporary folder is set if the master is local; a cluster must name one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioscan-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop's file system of a path, the path): any store that Spark reads."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    return path


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block and are put back after it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows and bytes of an Arrow batch, which bound what a Python worker holds at once.
BATCH = (1024, "4m")


def written(df: DataFrame, name: str = "table", batch: tuple[int, str] = BATCH) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, whatever is
    lost later, with column pruning for each reader.  ``batch`` holds during this write alone."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    ship(spark)
    conf = {CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch[0]), "spark.sql.execution.arrow.maxBytesPerBatch": batch[1]}
    with settings(spark, conf):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def written_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the place of the one before, by a rename: readers see the one or the other."""
    jvm = spark.sparkContext._jvm
    fs, where = file_system(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(text.encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, where, options)


class Scratch:
    """Written tables that go when the block ends, or before by ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame, name: str = "table", batch: tuple[int, str] = BATCH) -> DataFrame:
        out = written(df, name, batch)
        self.tables[out.written_to] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            fs, where = file_system(self.spark, t.written_to)
            fs.delete(where, True)
            self.tables.pop(t.written_to, None)

    def __exit__(self, *_: object) -> None:
        self.drop(*self.tables.values())


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint only where the counted rows keep within limit."""
    return F.broadcast(df) if rows <= limit else df
