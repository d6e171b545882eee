"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import new_path, text_of, written

N_SLOTS = 8192


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot): the slot depends on the id alone."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_slots)).cast("int").alias("vslot"),
    )


def slot_stats(slotted: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; at most n_slots rows reach the driver."""
    size, rows = [0] * n_slots, [0] * n_slots
    for r in slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r.vslot], rows[r.vslot] = r.b, r.n
    return size, rows


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [s % n_shards for s in range(n_slots)]


def rebalanced(shard_of: list[int], size: list[int], n_shards: int, tolerance: float = 0.0005) -> list[int]:
    """The next version of a map: as few slots as needed change their shard until
    the largest and smallest shard differ by at most ``tolerance`` of the mean or
    no single move brings them nearer.  Shards beyond those of the old map start empty."""
    out, load, own = list(shard_of), [0] * n_shards, [set() for _ in range(n_shards)]
    for slot, shard in enumerate(out):
        load[shard] += size[slot]
        if size[slot]:
            own[shard].add(slot)
    aim = tolerance * sum(load) / n_shards
    for _ in range(4 * len(out)):
        moved = False
        low = min(range(n_shards), key=lambda s: (load[s], s))
        for high in sorted(range(n_shards), key=lambda s: (-load[s], s)):
            gap = load[high] - load[low]
            if gap <= aim:
                break
            fit = [s for s in own[high] if 0 < size[s] < gap]
            if fit:
                slot = min(fit, key=lambda s: (abs(2 * size[s] - gap), s))
                own[high].remove(slot)
                own[low].add(slot)
                load[high] -= size[slot]
                load[low] += size[slot]
                out[slot], moved = low, True
                break
        if not moved:
            break
    return out


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int], size: list[int]) -> None:
    """Adds one version to the stored map; earlier versions stay readable."""
    rows = [(version, s, shard_of[s], size[s]) for s in range(len(shard_of))]
    spark.createDataFrame(rows, "version int, vslot int, shard int, bytes long").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """(version, shard of each slot); the newest version by default."""
    t = spark.read.parquet(path)
    version = t.agg(F.max("version")).first()[0] if version is None else version
    return version, [r.shard for r in t.where(F.col("version") == version).orderBy("vslot").collect()]


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Deals all rows to shards whose byte sizes are near equal (law ``bytes``).

    Records are hashed by id into ``n_slots`` fixed virtual slots; bytes are
    summed by slot; the map in ``map_path`` (version 0 is written where there is
    none) is edited into a next version for these sums.  ``slot`` is the row's
    place in its shard, gapless from 0: an offset per virtual slot (at most
    n_slots numbers, broadcast) plus the rank within the virtual slot, so no task
    sorts a whole shard.  The text is read once and never shuffled.

    A null text counts no bytes (size 8, checksum 0); null ids share one slot;
    repeated rows are kept and take places of their own; an empty table gives an
    empty result; other columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    slotted = written(with_slots(docs, id_col, text_col, n_slots), "slots")
    size, rows = slot_stats(slotted, n_slots)
    if map_path is None:
        map_path = new_path(spark, "slot-map")
        save_map(spark, map_path, 0, first_map(n_shards, n_slots), [0] * n_slots)
    version, old = load_map(spark, map_path)
    new = rebalanced(old, size, n_shards)
    save_map(spark, map_path, version + 1, new, size)
    nxt, first = [0] * n_shards, []
    for s in range(n_slots):
        first.append(nxt[new[s]])
        nxt[new[s]] += rows[s]
    places = spark.createDataFrame([(s, new[s], first[s]) for s in range(n_slots)], "vslot int, shard int, first long")
    ranked = slotted.selectExpr("*", "row_number() over (partition by vslot order by doc_id, text_crc32, size) - 1 as nth")
    return ranked.join(F.broadcast(places), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"), F.lit(version + 1).alias("map_version"),
    )
