"""A Merkle manifest of a data set: one tree per source, one tree over their roots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import written

#: Nodes of a run, which one digest replaces; levels that one block of FAN ** HEIGHT nodes collapses.
FAN, HEIGHT = 16, 2
BLOCK = FAN**HEIGHT


def encoded(col: str | Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    s = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(s), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def folder(source: Column) -> Column:
    """A source as a key that is never null; byte order, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def lowered(docs: DataFrame) -> tuple[Column, Column]:
    """(which rows are tampered with: 5 divides the checksum of the decimal doc_id; their text with A-Z lower-cased)."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, leaf, altered) of each row: ``altered`` is the leaf of the
    tampered text where the row is one of those that are tampered with, else null."""
    head = [encoded("doc_id"), encoded("source"), encoded("lang"), encoded("n_chars")]
    hit, text = lowered(docs)
    return docs.select("doc_id", "source", folder(F.col("source")).alias("key"), digest(*head, encoded("text")).alias("leaf"), F.when(hit, digest(*head, encoded(text))).alias("altered"))


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with ``pos``, their place from 0 in ``order`` among the rows of their key, and ``n``,
    the key's rows.  Rows are dealt by ranges of (key, order), counted by range and key, and
    ranked in their range: a key with most of the rows is spread over as many ranges as it fills."""
    dealt = written(rows.repartitionByRange(key, *order).withColumn("dealt", F.spark_partition_id()), "dealt")
    count = dealt.groupBy("dealt", key).agg(F.count(F.lit(1)).alias("m"))
    first = count.selectExpr("dealt", key, f"sum(m) over (partition by {key} order by dealt) - m as first", f"sum(m) over (partition by {key}) as n")
    ranked = dealt.selectExpr("*", f"row_number() over (partition by dealt, {key} order by {', '.join(order)}) - 1 as nth")
    return ranked.join(first, ["dealt", key]).withColumn("pos", F.col("first") + F.col("nth")).drop("dealt", "first", "nth")


def levels(n: str) -> str:
    """How many levels of digests lie over n nodes, as SQL."""
    return f"size(filter(array({', '.join(f'{FAN**k}L' for k in range(16))}), x -> x < {n}))"


def blocks(nodes: DataFrame, payload: str = "cast(null as string)") -> DataFrame:
    """(key, block, n, up, items, tree): the nodes of a block as one ordered array and,
    level by level, what it collapses to; ``up`` levels of at most HEIGHT.

    nodes: key, pos, n, hash.  ``payload`` is carried with each node in ``items``.
    """
    item = nodes.select("key", "n", F.expr(f"pos div {BLOCK}").alias("block"), F.struct("pos", "hash", F.expr(payload).alias("payload")).alias("item"))
    grouped = item.groupBy("key", "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("item")).alias("items"))
    grouped = grouped.withColumn("up", F.expr(f"least({HEIGHT}, {levels('n')})"))
    below, run = "element_at(acc, -1)", f"slice(element_at(acc, -1), i * {FAN} + 1, {FAN})"
    collapse = f"concat(acc, array(transform(sequence(0, (size({below}) - 1) div {FAN}), i -> sha2(array_join({run}, ''), 256))))"
    return grouped.withColumn("tree", F.expr(f"aggregate(slice(sequence(1, {HEIGHT}), 1, up), array(transform(items, x -> x.hash)), (acc, k) -> {collapse})"))


def roots_of(built: DataFrame) -> DataFrame:
    """The one digest that each block came to, as a node of the next round."""
    return built.selectExpr("key", "block as pos", f"(n + {BLOCK - 1}) div {BLOCK} as n", "element_at(tree, -1)[0] as hash")


@dataclass
class Tree:
    """rounds: written block tables, leaves first; roots: (key, pos, n, hash), one row per key."""

    rounds: list[DataFrame]
    roots: DataFrame


def grow(nodes: DataFrame, most: int, payload: str = "cast(null as string)") -> Tree:
    """Trees over the nodes of each key; ``most`` is the largest key's number of nodes.
    A round collapses HEIGHT levels, so rounds grow with the logarithm of the input."""
    rounds = [written(blocks(nodes, payload), "merkle")]
    while most > BLOCK:
        most = -(-most // BLOCK)
        rounds.append(written(blocks(roots_of(rounds[-1])), "merkle"))
    return Tree(rounds, roots_of(rounds[-1]))


def paths(built: DataFrame, above: DataFrame) -> DataFrame:
    """(key, top, pos, hash, payload, path) of every node of the blocks: the sibling digests to the left
    and right of its way, level by level, in the block and then as ``above`` (key, pos, path, top)
    has it for the block's root; ``top`` is carried along."""
    at, run = f"(i div cast(power({FAN}, k) as int))", f"(i div cast(power({FAN}, k + 1) as int)) * {FAN}"
    step = f"struct(array_join(slice(tree[k], {run} + 1, {at} % {FAN}), '') as left, array_join(slice(tree[k], {at} + 2, {FAN - 1} - {at} % {FAN}), '') as right)"
    own = f"transform(slice(sequence(0, {HEIGHT - 1}), 1, up), k -> {step})"
    met = built.join(above.select("key", F.col("pos").alias("block"), "path", "top"), ["key", "block"])
    return met.select("key", "top", F.expr(f"inline(transform(items, (x, i) -> struct(x.pos as pos, x.hash as hash, x.payload as payload, concat({own}, path) as path)))"))


def descend(tree: Tree, above: DataFrame) -> DataFrame:
    for built in reversed(tree.rounds):
        above = paths(built, above)
    return above


@dataclass
class Manifest:
    """A tree for each source over its rows, and one over the sources' digests."""

    inner: Tree
    outer: Tree


def manifest(docs: DataFrame) -> Manifest:
    """Leaves of each source in the order of doc_id (null first, then of the leaf's own digest),
    runs of FAN collapsed until one is left; the sources' digests, null first, likewise."""
    nodes = written(placed(leaves(docs), "key", ["doc_id", "leaf"]).withColumnRenamed("leaf", "hash"), "leaves")
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    inner = grow(nodes, most, "struct(doc_id, source, altered)")
    subroots = inner.roots.select(F.lit("").alias("all"), F.col("key").alias("name"), "hash")
    sources = written(placed(subroots, "all", ["name"]).withColumnRenamed("all", "key"), "sources")
    return Manifest(inner, grow(sources, sources.count(), "name"))


def proofs(m: Manifest) -> DataFrame:
    """(doc_id, source, leaf, altered, subroot, root, path) of every row; path runs from the leaf to the root."""
    top = m.outer.roots.select("key", "pos", F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"), F.col("hash").alias("top"))
    tops = descend(m.outer, top).select(F.col("payload").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top"))
    return descend(m.inner, written(tops, "tops")).select("payload.doc_id", "payload.source", F.col("hash").alias("leaf"), "payload.altered", "top.subroot", "top.root", "path")


def verified(proved: DataFrame) -> DataFrame:
    """Proofs reduced to their digest, and the root that the tampered leaf (else the leaf) folds to."""
    told = "aggregate(path, '', (s, x) -> concat(s, x.left, x.right))"
    fold = "aggregate(path, coalesce(altered, leaf), (h, x) -> sha2(concat(x.left, h, x.right), 256))"
    out = proved.select("doc_id", "leaf", "subroot", "root", F.expr(f"sha2({told}, 256)").alias("proof_sha256"), F.expr(fold).alias("folded_root"), "source")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def audit(docs: DataFrame) -> DataFrame:
    """Every row's place in the manifest, and whether what is found there now (the tampered row) still
    folds to the manifest's root.

    Null columns are told from empty ones in a leaf; null sources are a source of their own and
    come first; null and repeated ids are leaves of their own, ordered by digest after the id; an
    empty table gives no rows; other columns take no part.  A leaf is made in one pass over the
    text; only digests are shuffled.  A source is cut into blocks of BLOCK leaves, however many it has.
    """
    return verified(proofs(manifest(docs)))


def oracle(depth: int = 6) -> str:
    """DuckDB SQL of ``audit`` for sources of at most FAN ** depth rows: a level is a grouping of
    places, a proof is read off the runs, one level after the other."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    chars = "list_transform(range(1, length(t) + 1), lambda i: ascii(substring(t, i, 1))::bigint)"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], {chars}), lambda c, b: {bits}), 4294967295)"
    enc = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    head = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"summed as (select *, {crc} as crc from (select *, doc_id::varchar as t from documents))",
        f"leafs as (select doc_id, coalesce('1' || source, '0') as key, sha256({head} || {enc('text')}) as leaf, case when crc % 5 = 0 then sha256({head} || {enc(low)}) end as altered from summed)",
        "a0 as (select *, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as pos from leafs)",
        "l0 as (select key, pos, leaf as hash from a0)",
    ]

    def climb(name: str, d: int) -> list[str]:
        out = []
        for k in range(d):
            out.append(f"{name}c{k} as (select *, count(*) over (partition by key) as n from {name}{k})")
            out.append(f"{name}{k + 1} as (select key, case when n = 1 then pos else pos // {FAN} end as pos, case when max(n) = 1 then max(hash) else sha256(string_agg(hash, '' order by pos)) end as hash from {name}c{k} group by key, case when n = 1 then pos else pos // {FAN} end, n)")
            side = lambda op: f"coalesce((select string_agg(s.hash, '' order by s.pos) from {name}c{k} s where s.n > 1 and s.key = x.key and s.pos // {FAN} = x.pos // {FAN} and s.pos {op} x.pos), '')"  # noqa: B023, E731
            out.append(f"{name}s{k} as (select key, pos, n, {side('<')} as l, {side('>')} as r from {name}c{k} x)")
        return out

    ctes += climb("l", depth)
    ctes += [f"subs as (select key as name, hash as subroot, row_number() over (order by key) - 1 as pos from l{depth})", "o0 as (select '' as key, pos, subroot as hash from subs)"]
    ctes += climb("o", 2)
    ctes.append(f"w0 as (select a0.*, subroot, subs.pos as opos, (select hash from o2) as root, coalesce(altered, leaf) as fold, '' as proof from a0 join subs on name = key)")
    at = "w0"
    for name, d, pos, key in (("l", depth, "pos", "w.key"), ("o", 2, "opos", "''")):
        for k in range(d):
            nxt = f"w{name}{k}"
            ctes.append(f"{nxt} as (select w.* replace (case when s.n = 1 then w.{pos} else w.{pos} // {FAN} end as {pos}, case when s.n = 1 then fold else sha256(l || fold || r) end as fold, proof || l || r as proof) from {at} w join {name}s{k} s on s.key = {key} and s.pos = w.{pos})")
            at = nxt
    return f"with {', '.join(ctes)} select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, fold as folded_root, case when key = '0' then null else substring(key, 2) end as source, fold = root as verified from {at}"
