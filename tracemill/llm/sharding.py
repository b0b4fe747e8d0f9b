"""Sharding by a hierarchical weighted hash tree: weighted hash draws choose a region, a rack in it, a shard in that.

At each level a node with weight w draws -ln(u) / w, u from a hash of the key and the node's name; the smallest draw
wins, which gives each node its share of the keys. A changed weight moves keys only into or out of that node: all
other draws stay. So rows move only within the subtrees whose weights change. A shard that opens a region of its own
(as the 41st of the standard tree does) takes rows only into itself.

Law `key`: doc_id and the tree decide, nothing else.

Defined cases: a null doc_id is a key of its own; a null text has no bytes and crc32 0; rows that repeat go to one
shard and to slots of their own; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_start, stage_table, text_or_empty

SHARDS = 40
BUCKET_ROWS = 20_000


def standard_tree(n_shards: int, racks: int = 2, per_rack: int = 4) -> dict[int, tuple[int, int, float]]:
    """shard -> (region, rack, weight): racks of `per_rack` shards, regions of `racks` racks, filled in order, all weights 1."""
    return {s: (s // (racks * per_rack), s // per_rack % racks, 1.0) for s in range(n_shards)}


def _draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of md5(key/node)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, F.lit(node)).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(weight)


def _winner(key: Column, nodes: dict[int, float], prefix: str) -> Column:
    """The index of the node with the smallest draw; ties go to the lower index."""
    if len(nodes) == 1:
        return F.lit(next(iter(nodes)))
    return F.array_min(F.array(*[F.struct(_draw(key, f"{prefix}{i}", w).alias("d"), F.lit(i).alias("i")) for i, w in sorted(nodes.items())]))["i"]


def shard_of(df: DataFrame, key: Column, tree: dict[int, tuple[int, int, float]], out: str) -> DataFrame:
    """Add `out`: the shard of each key; two working columns are dropped again."""
    regions: dict[int, float] = defaultdict(float)
    racks: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    leaves: dict[tuple[int, int], dict[int, float]] = defaultdict(dict)
    for s, (region, rack, w) in tree.items():
        regions[region] += w
        racks[region][rack] += w
        leaves[region, rack][s] = w

    def choose(on: Column, cases: dict) -> Column:
        expr = None
        for k, c in cases.items():
            expr = F.when(on == F.lit(k), c) if expr is None else expr.when(on == F.lit(k), c)
        return expr

    df = df.withColumn("__tm_region", _winner(key, regions, "r"))
    df = df.withColumn("__tm_rack", choose(F.col("__tm_region"), {r: _winner(key, n, f"r{r}/k") for r, n in racks.items()}))
    leaf = F.concat_ws("/", F.col("__tm_region"), F.col("__tm_rack"))
    return df.withColumn(out, choose(leaf, {f"{r}/{k}": _winner(key, n, f"r{r}/k{k}/s") for (r, k), n in leaves.items()}).cast("int")).drop("__tm_region", "__tm_rack")


def shard(docs: DataFrame, tree: dict[int, tuple[int, int, float]], grown: dict[int, tuple[int, int, float]]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; slots count a shard's rows in hashed order, without a task per shard."""
    t = text_or_empty(F.col("text"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    df = docs.select("doc_id", (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).cast("long").alias("text_crc32"), F.lit("key").alias("law"), key.alias("__key"))
    df = shard_of(shard_of(df, F.col("__key"), tree, "shard"), F.col("__key"), grown, "grown_shard")
    df = stage_table(df.withColumns({"__h": F.xxhash64("__key"), "__one": F.lit(1).cast("long")}).drop("__key"), "shard-rows")
    buckets = 1 << max(0, (df.count() // BUCKET_ROWS).bit_length())
    df = running_start(df, ["shard"], [F.col("__h"), F.col("doc_id"), F.col("size"), F.col("text_crc32")], "__one", "slot", F.floor((F.col("__h") / F.lit(float(2**64)) + F.lit(0.5)) * buckets))
    return df.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_sharding(docs: DataFrame) -> DataFrame:
    return shard(docs.select("doc_id", "text"), standard_tree(SHARDS), standard_tree(SHARDS + 1))
