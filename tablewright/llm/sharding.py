"""Shards by a hierarchical weighted hash tree: region, rack and shard are drawn one after the other.

At each level every child draws -ln(u) / weight with a u hashed from the row's key and the child's name; the least
draw wins, so a child gets rows in proportion to its weight, and a changed weight only moves rows into or out of
the subtree that has it. A shard is added as a region of its own (`grown`): no other weight changes, so rows move
into the new shard only. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import block_offsets, documents, id_block

#: regions, racks in them, and (shard, weight) in those
Tree = list[list[list[tuple[int, float]]]]


def tree_of(shape: Sequence[int] = (2, 2, 2), weights: Sequence[float] | None = None) -> Tree:
    """A tree of so many regions, racks a region and shards a rack; weights by shard, 1 each unless given."""
    regions, racks, shards = shape
    weights = list(weights or [1.0] * (regions * racks * shards))
    if len(weights) != regions * racks * shards or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("a weight of 0 or more for each shard, and one above 0")
    number = iter(range(len(weights)))
    return [[[(s := next(number), float(weights[s])) for _ in range(shards)] for _ in range(racks)] for _ in range(regions)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return [*tree, [[(1 + max(s for region in tree for rack in region for s, _ in rack), float(weight))]]]


def _drawn(key: Column, children: list[tuple[str, int, float]]) -> Column:
    """Position of the child with the least weighted draw; children: name, position, weight. Those of weight 0 draw nothing."""
    live = [x for x in children if x[2] > 0]
    if len(live) == 1:
        return F.lit(live[0][1])
    draws = []
    for name, at, weight in live:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(at).alias("at")))
    return F.least(*draws)["at"]


def assign(df: DataFrame, key: Column, tree: Tree, out: str) -> DataFrame:
    """df with the int column `out`: the shard of the key. Equal keys share a shard; a null key counts as an empty one."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    total = lambda part: sum(w for _, w in part) if part and isinstance(part[0], tuple) else sum(map(total, part))
    region = f"{out}_region_"
    rack = f"{out}_rack_"
    df = df.withColumn(region, _drawn(key, [(f"region {r}", r, total(x)) for r, x in enumerate(tree)]))
    choice = F.lit(None).cast("int")
    for r, racks in enumerate(tree):
        if total(racks) > 0:
            choice = F.when(F.col(region) == r, _drawn(key, [(f"rack {r}.{k}", 1000 * r + k, total(x)) for k, x in enumerate(racks)])).otherwise(choice)
    df = df.withColumn(rack, choice)
    choice = F.lit(None).cast("int")
    for r, racks in enumerate(tree):
        for k, shards in enumerate(racks):
            if total(shards) > 0:
                choice = F.when(F.col(rack) == 1000 * r + k, _drawn(key, [(f"shard {s}", s, w) for s, w in shards])).otherwise(choice)
    return df.withColumn(out, choice.cast("int")).drop(region, rack)


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None, width: int = 1024) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of df.

    A null text has size 1 and the crc32 of no bytes; a null id is a key of its own. Slots number a shard's rows from 0
    in order of id (null first, ties by size and crc32) without gaps. Numbers are dealt by blocks of `width` ids: a
    first pass counts a shard's rows by block from the ids alone, so no task orders a whole shard. Other columns of
    df are not read. An empty table gives an empty result.
    """
    tree = tree or tree_of()
    ids = assign(df.select(F.col(id_col).alias("doc_id")), F.col("doc_id"), tree, "shard").withColumn("block_", id_block(F.col("doc_id"), width))
    starts = block_offsets(ids.groupBy("shard", "block_").agg(F.count("*").alias("n_")), ["shard"], "block_", "n_", "start_")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = assign(assign(rows, F.col("doc_id"), tree, "shard"), F.col("doc_id"), grown(tree), "grown_shard").withColumn("block_", id_block(F.col("doc_id"), width))
    inner = Window.partitionBy("shard", "block_").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    rows = rows.join(starts.select("shard", "block_", "start_"), ["shard", "block_"])
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start_") + F.row_number().over(inner) - 1).cast("long").alias("slot"), "grown_shard",
    )


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir))
