"""Dense similarity and top-k under filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order, inside the JVM."""
    d = lambda x: x.cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, v: s + v)


def scores(queries: DataFrame, vectors: DataFrame, on: list[str]) -> DataFrame:
    """Every query against the vectors that agree with it on ``on``: an equi-join, so
    the filter is applied before any product.  queries: q_id, q_vec and ``on``."""
    return vectors.join(queries, on).withColumn("score", dot(F.col("embedding"), F.col("q_vec")))


def top_k(scored: DataFrame, k: int, by: list[str], tie: str) -> DataFrame:
    """The k best rows per key, limited per task before the shuffle."""
    keys = ", ".join(by)
    ranked = scored.selectExpr("*", f"cast(row_number() over (partition by {keys} order by score desc, {tie}) as int) as rank")
    return ranked.where(F.col("rank") <= k)


def by_max(scored: DataFrame, by: list[str], guarded: bool = False) -> DataFrame:
    """Scores over the largest of their key; a non-positive one divides as it is
    unless guarded, and a zero gives null."""
    top = F.expr(f"max(score) over (partition by {', '.join(by)})")
    return scored.withColumn("score", F.try_divide("score", F.when(top > 0, top).otherwise(1.0) if guarded else top))


def gap(scored: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Best row of each key with its lead over the second (over -999 if alone)."""
    keys = ", ".join(by)
    w = f"(partition by {keys} order by score desc, {tie})"
    r = scored.selectExpr("*", f"row_number() over {w} as rn", f"lead(score) over {w} as second")
    return r.where("rn = 1").withColumn("gap", F.col("score") - F.coalesce("second", F.lit(-999.0))).drop("rn", "second")
