"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import Scratch, written


def _print(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)), F.sum(F.xxhash64("v", "u") % F.lit(1 << 31))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str, into: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component), written (``into``: by that scope): the smallest id reachable from each node of an edge.

    Only (node, node) pairs are shuffled; the minimum of a node's neighbours is
    aggregated before the shuffle, and the join back to its edges is one that
    adaptive execution can split.  Each round is written to the shared folder; the
    one before it goes.  Null ends and loops are ignored.  An empty table gives an
    empty result.
    """
    with Scratch(edges.sparkSession) as tables:
        e = (
            edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
            .where("x is not null and y is not null and x <> y")
            .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
            .distinct()
        )
        e = tables.written(e, "edges")
        last = _print(e)
        for _ in range(max_rounds if last[0] else 0):
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m"))
            big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
            low = big.groupBy("u").agg(F.min("v").alias("m"))
            star = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            before, e = e, tables.written(star.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
            tables.drop(before)
            now = _print(e)
            if now == last:
                break
            last = now
        else:
            if last[0]:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return (into.written if into else written)(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
