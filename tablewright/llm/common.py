"""Helpers that the text operators share: written tables, batches, distributed numbering, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that Python code works on at once.
SLICE_BYTES = 4 << 20
#: Word characters: all but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def vocabulary(name: str) -> str:
    """Where a file of the installed public vocabularies is: the default of parameters that name one."""
    return public_tokenizers.path(name)


_own_folder: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share; a new local one only where that is unset (local mode)."""
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return _own_folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name for a folder in the shared one, to be removed when the driver ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage and survives lost executors. Removed when the driver ends."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: its folder belongs to the cluster
            return


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let_go() -> None:
    """Give memory that earlier work in this process has freed back to the machine: workers serve task after task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have at most `most` bytes (one row at least)."""
    let_go()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def fmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def id_block(column: Column, width: int) -> Column:
    """Number of the block of `width` consecutive ids that an id is in; a block of its own for null."""
    return F.coalesce(F.floor(column / F.lit(width)).cast("long"), F.lit(-(1 << 60)))


def block_offsets(sums: DataFrame, group: list[str], block: str, value: str, out: str, fan: int = 1024) -> DataFrame:
    """For rows of unique (group, block): `out` is the sum of `value` over the group's earlier blocks.

    Two levels, so that no task orders more than `fan` blocks of a group, or a group's blocks divided by `fan`.
    """
    upper = sums.withColumn("upper_", F.floor(F.col(block) / F.lit(fan)))
    tops = upper.groupBy(*group, "upper_").agg(F.sum(value).alias("top_"))
    before = Window.partitionBy(*group).orderBy("upper_").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("base_", F.coalesce(F.sum("top_").over(before), F.lit(0))).drop("top_")
    on = F.lit(True)
    for name in (*group, "upper_"):
        on = on & F.col(f"l_.{name}").eqNullSafe(F.col(f"r_.{name}"))
    inner = Window.partitionBy(*group, "upper_").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    both = upper.alias("l_").join(tops.alias("r_"), on).select("l_.*", "r_.base_")
    return both.withColumn(out, F.col("base_") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("upper_", "base_")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root one node of each component, for all nodes on edges between different ends.

    Each round every node moves to its least neighbour (least by a mix of the round, so that long paths halve),
    and equal moved edges merge. Tables are written between rounds; sums and minima are taken before any shuffle,
    so a node with many neighbours loads no task. Each round at least a part of the nodes goes, so that `rounds` are beyond what any
    graph takes; an error if they are used up.
    """
    spark = edges.sparkSession
    live = written(edges.select("a", "b").filter("a <> b").distinct())
    roots = None
    for k in range(rounds):
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mix = lambda c, k=k: F.xxhash64(c, F.lit(k))
        least = both.groupBy("a").agg(F.min(F.struct(mix(F.col("b")).alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(mix(F.col("a")).alias("h"), F.col("a").alias("to"))
        step = written(least.select(F.col("a").alias("node"), F.least(own, F.col("m"))["to"].alias("to")))
        # two steps at once: a node whose target itself moves goes on with it
        move = written(step.join(step.select(F.col("node").alias("to"), F.col("to").alias("on")), "to").select("node", F.col("on").alias("to")))
        if roots is None:
            roots = move.select("node", F.col("to").alias("root"))
        else:
            later = move.select(F.col("node").alias("root"), F.col("to").alias("next_"))
            roots = written(roots.join(later, "root", "left").select("node", F.coalesce("next_", "root").alias("root")))
        to_a = move.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        to_b = move.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        live = written(live.join(to_a, "a").join(to_b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if roots is None:
        return spark.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("a").alias("root")).schema)
    return roots
