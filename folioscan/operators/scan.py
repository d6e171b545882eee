"""Ordered passes over a key's rows that do not put a key in one task.

Rows are dealt by ranges of (key, order), so a key with most of the rows fills as many ranges as it
needs.  Each range is gone through by itself; what it hands on is one row for each key in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.shared import written


def _dealt(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    return written(rows.repartitionByRange(by, *order).withColumn("__dealt", F.spark_partition_id()), "dealt")


def ranked(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows with ``name``, their number from 1 in ``order`` among the rows of their key.  Give narrow rows: they are written once."""
    dealt = _dealt(rows, by, order)
    count = dealt.groupBy("__dealt", by).agg(F.count(F.lit(1)).alias("m"))
    first = count.selectExpr("__dealt", f"{by} as __by", f"sum(m) over (partition by {by} order by __dealt) - m as first")
    nth = dealt.selectExpr("*", f"row_number() over (partition by __dealt, {by} order by {', '.join(order)}) as __nth")
    met = nth.alias("r").join(first.alias("f"), (F.col("r.__dealt") == F.col("f.__dealt")) & F.col(by).eqNullSafe(F.col("__by")))
    return met.select("r.*", (F.col("first") + F.col("__nth")).alias(name)).drop("__dealt", "__nth")


def carried(rows: DataFrame, by: str, order: list[str], col: str, out: str) -> DataFrame:
    """rows with ``out``, the last value of ``col`` that is not null up to each row of its key.  Give narrow rows: they are written once."""
    dealt, said = _dealt(rows, by, order), F.col(col).isNotNull()
    own = dealt.selectExpr("*", f"last({col}, true) over (partition by __dealt, {by} order by {', '.join(order)} rows between unbounded preceding and current row) as __own")
    ends = dealt.groupBy("__dealt", by).agg(F.max_by(F.when(said, F.col(col)), F.when(said, F.struct(*order))).alias("end"))
    before = ends.selectExpr("__dealt", f"{by} as __by", f"last(end, true) over (partition by {by} order by __dealt rows between unbounded preceding and 1 preceding) as __before")
    met = own.alias("r").join(before.alias("f"), (F.col("r.__dealt") == F.col("f.__dealt")) & F.col(by).eqNullSafe(F.col("__by")))
    return met.select("r.*", F.coalesce("__own", "__before").alias(out)).drop("__dealt", "__own")


def summed(rows: DataFrame, by: str, order: list[str], col: str, out: str) -> DataFrame:
    """rows with ``out``, the sum of ``col`` over the rows of their key before them.  Give narrow rows: they are written once."""
    dealt = _dealt(rows, by, order)
    before = dealt.groupBy("__dealt", by).agg(F.sum(col).alias("m")).selectExpr("__dealt", f"{by} as __by", f"sum(m) over (partition by {by} order by __dealt) - m as __before")
    own = dealt.selectExpr("*", f"sum({col}) over (partition by __dealt, {by} order by {', '.join(order)} rows between unbounded preceding and current row) - {col} as __own")
    met = own.alias("r").join(before.alias("f"), (F.col("r.__dealt") == F.col("f.__dealt")) & F.col(by).eqNullSafe(F.col("__by")))
    return met.select("r.*", (F.col("__before") + F.col("__own")).alias(out)).drop("__dealt", "__own")
