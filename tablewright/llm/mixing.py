"""Mixing sources to target weights.

The words of a source, in order of document, are packed into blocks of fixed length. A mix is a sequence of slots that hold
one block each, cut into output shards. The sources' counts of a shard are a multinomial draw held to the exact totals of
the whole mix: the totals are halved again and again (a multivariate hypergeometric draw at each halving, seeded by the
range), so that any shard finds its counts, and how many slots of a source come before it, in log(shards) steps on its own.
The k-th slot of a source takes block p(k mod blocks) with p a keyed pseudorandom permutation of the round k div blocks.
Slots and documents are joined by source and block number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import WORD, block_offsets, documents, fmix, id_block, partitions, written


@dataclass(frozen=True)
class Plan:
    """One source: its number, name, words, target in words, blocks, and slots in the mix."""

    number: int
    source: str | None
    size: int
    target: float
    blocks: int
    slots: int


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Shares of `share` times all words by weight; a source stops at `cap` times its words, and the rest is shared anew."""
    total = share * sum(sizes)
    out = [0.0] * len(sizes)
    live = [k for k, s in enumerate(sizes) if s > 0 and weights[k] > 0]
    while live:
        by = sum(weights[k] for k in live)
        full = [k for k in live if total * weights[k] / by > cap * sizes[k]]
        if not full:
            for k in live:
                out[k] = total * weights[k] / by
            break
        for k in full:
            out[k] = cap * sizes[k]
        total -= sum(out[k] for k in full)
        live = [k for k in live if k not in set(full)]
    return out


def split_counts(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `take` slots fall to each source: a multivariate hypergeometric draw from counts."""
    out = np.zeros_like(counts)
    left = int(counts.sum())
    for k, c in enumerate(counts.tolist()):
        left -= c
        if take == 0:
            break
        if left + c >= 10**9:  # beyond numpy's range: the normal limit, held to what is possible
            n = left + c
            mean, var = take * c / n, take * (c / n) * (left / n) * ((n - take) / max(1, n - 1))
            x = int(min(max(round(rng.normal(mean, var**0.5)), take - left, 0), take, c))
        else:
            x = int(rng.hypergeometric(c, left, take)) if left else take
        out[k] = x
        take -= x
    return out


def shard_counts(slots: np.ndarray, shard: int, shards: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source before a shard, and in it. Shards have `width` slots, the last the rest."""
    before, counts, low, high = np.zeros_like(slots), slots.copy(), 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        left = split_counts(counts, (mid - low) * width, np.random.default_rng([seed, low, high]))
        if shard < mid:
            counts, high = left, mid
        else:
            before, counts, low = before + left, counts - left, mid
    return before, counts


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 at some indexes: four Feistel rounds, walked until they fall below size."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> shift, x & mask
        for r in range(4):
            mixed = fmix(b + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            a, b = b, a ^ (mixed >> np.uint64(20) & mask)
        out[todo] = (a << shift) | b
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def plan_of(totals: DataFrame, block_words: int, weights: Sequence[float], share: float, cap: float, max_sources: int) -> list[Plan]:
    """totals: rows (source, words). Sources in order of code points, null last, take the weights in turn."""
    rows = totals.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in rows]
    wanted = targets(sizes, [weights[k % len(weights)] for k in range(len(rows))], share, cap)
    out = []
    for k, (row, size, target) in enumerate(zip(rows, sizes, wanted, strict=True)):
        blocks = -(-size // block_words)
        out.append(Plan(k, row[0], size, target, blocks, min(int(cap * blocks), round(target / size * blocks)) if size else 0))
    return out


def slots_of(spark: SparkSession, plan: list[Plan], shard_slots: int, seed: int) -> DataFrame:
    """Rows (shard, slot, number, block): the mix in full, drawn shard by shard on the executors."""
    counts = np.array([p.slots for p in plan], np.int64)
    blocks = [p.blocks for p in plan]
    total = int(counts.sum())
    shards = max(1, -(-total // shard_slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                before, here = shard_counts(counts, shard, shards, shard_slots, seed)
                number, block = [], []
                for k in np.flatnonzero(here).tolist():
                    index = np.arange(before[k], before[k] + here[k])
                    taken = np.empty_like(index)
                    for turn in np.unique(index // blocks[k]).tolist():
                        some = index // blocks[k] == turn
                        taken[some] = permuted(index[some] % blocks[k], blocks[k], (seed * 1_000_003 + k) * 64 + turn)
                    number.append(np.full(len(index), k, np.int32))
                    block.append(taken)
                if number:
                    n = int(here.sum())
                    order = np.random.default_rng([seed, shard, 1]).permutation(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, shard, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.concatenate(number)[order]), pa.array(np.concatenate(block)[order])],
                        ["shard", "slot", "number", "block"],
                    )

    n = min(shards, 4 * partitions(spark))
    return spark.range(0, shards, 1, n).mapInArrow(run, "shard long, slot int, number int, block long")


@dataclass(frozen=True)
class Mix:
    """plan; rows: the input's rows with number, size and start (of its words in its source); slots."""

    plan: list[Plan]
    rows: DataFrame
    slots: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """Rows (number, start, block, first, words): the words of a document, from its first-th, that lie in a block."""
        b, end = F.lit(self.block_words), F.col("start") + F.col("size")
        cut = self.rows.filter("size > 0").select("number", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))).alias("block"))
        low, high = F.greatest(F.col("start"), F.col("block") * b), F.least(end, (F.col("block") + 1) * b)
        return cut.select("number", "start", "block", (low - F.col("start")).alias("first"), (high - low).alias("words"))

    def taken(self) -> DataFrame:
        """The pieces, and how many slots of the mix hold their block (`times`; only those that one holds)."""
        # the slots' size isn't known when the plan is made: never let it be taken for a small table
        return self.pieces().hint("merge").join(self.slots.groupBy("number", "block").agg(F.count("*").alias("times")), ["number", "block"])


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
    cap: float = 2.0, block_words: int = 128, shard_slots: int = 4096, seed: int = 17, max_sources: int = 100_000, width: int = 1024, keep_text: bool = False, carry: Sequence[str] = (),
) -> Mix:
    """Draw a mix of all rows of df. A null text has no words; null is a source of its own, the last; rows with a null or
    repeated id are rows like others (in one source they follow each other by id, size and hash of the text). Only sources
    (max_sources at most, an error beyond) come to the driver."""
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    base = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("tie_"),
        id_block(F.col(id_col).cast("long"), width).alias("block_"), *([text.alias("text")] if keep_text else []), *[F.col(c).alias(f"with_{c}") for c in carry],
    )
    base = written(base)
    plan = plan_of(base.groupBy("source").agg(F.sum("size")), block_words, weights, share, cap, max_sources)
    names = base.sparkSession.createDataFrame([(p.number, p.source, p.size, p.target) for p in plan], "number int, name_ string, source_size long, target double")
    numbered = base.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name_"))).drop("name_")
    starts = block_offsets(numbered.groupBy("number", "block_").agg(F.sum("size").alias("n_")), ["number"], "block_", "n_", "base_start_")
    inner = Window.partitionBy("number", "block_").orderBy("doc_id", "size", "tie_").rowsBetween(Window.unboundedPreceding, -1)
    rows = numbered.join(starts.select("number", "block_", "base_start_"), ["number", "block_"])
    rows = rows.withColumn("start", F.col("base_start_") + F.coalesce(F.sum("size").over(inner), F.lit(0))).drop("block_", "tie_", "base_start_")
    return Mix(plan, rows, slots_of(df.sparkSession, plan, shard_slots, seed), block_words)


def taken_words(df: DataFrame, **options: object) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of df; see mix(). A document without words takes none;
    no document takes more than cap times its words. The same input gives the same result."""
    m = mix(df, **options)  # type: ignore[arg-type]
    sums = m.taken().groupBy("number", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken_"))
    columns = ["doc_id", "size", "source_size", "target"]
    some = m.rows.filter("size > 0").join(sums.hint("merge"), ["number", "start"], "left").select(*columns, F.coalesce("taken_", F.lit(0)).cast("long").alias("taken"))
    return some.union(m.rows.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def word_ranges(text: Column, ranges: Column) -> Column:
    """The words of text in each range (first, words) of an array, joined by a space."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    return F.concat_ws(" ", F.flatten(F.transform(ranges, lambda r: F.slice(words, r["first"].cast("int") + 1, r["words"].cast("int")))))


def mixed_documents(df: DataFrame, **options: object) -> DataFrame:
    """The mix as documents: rows (doc_id, source, text, turn) and the columns to `carry`. Turn t of a document has its words in blocks that the mix
    takes t times or more, so a document that is taken whole stays as it is, and one taken twice comes twice."""
    m = mix(df, keep_text=True, **options)  # type: ignore[arg-type]
    turns = m.taken().select("number", "start", "first", "words", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn"))
    parts = turns.groupBy("number", "start", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"), F.sum("words").alias("n_"))
    out = m.rows.filter("size > 0").join(parts.hint("merge"), ["number", "start"])
    return out.select("doc_id", "source", F.when(F.col("n_") == F.col("size"), F.col("text")).otherwise(word_ranges(F.col("text"), F.col("parts"))).alias("text"), "turn", *[F.col(f"with_{c}").alias(c) for c in options.get("carry", ())])  # type: ignore[attr-defined]


def op3_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(documents(spark, sf_dir, "doc_id", "text", "source"))
