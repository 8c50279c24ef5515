"""Token counts from an exact histogram of document lengths.

Documents are grouped by encoded length; sums over the lengths from either end then answer, for every context limit, how many
documents and tokens are above it and how many tokens are left when documents are cut at it.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import block_offsets, documents, id_block, slices, vocabulary, written

RANK_FILE = vocabulary("byte_bpe_50k.tiktoken")
#: The split pattern that the vocabulary file belongs to (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def length_histogram(df: DataFrame, text_col: str = "text", path: str = RANK_FILE) -> DataFrame:
    """Rows (n_tokens, n_docs): how many whole texts have so many ids. A null text counts as an empty one, with none.
    Each task adds up its own documents before the shuffle. An empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        found: Counter[int] = Counter()
        for batch in slices(batches, 0):
            found.update(len(encode(x)) if x else 0 for x in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "n_docs"])

    counts = df.select(F.col(text_col).cast("string")).mapInArrow(run, "n_tokens long, n_docs long")
    return counts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame, width: int = 1024) -> DataFrame:
    """For each length that occurs, taken as a context limit: n_docs and tokens of that length; docs_at_most and tokens_at_most;
    docs_above and tokens_above; truncated_total, the tokens left if documents are cut at the limit; quantile, the share of
    documents within it. Between two lengths the truncated total grows by docs_above of the lower one for each token."""
    rows = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    rows = written(rows.withColumn("up_", id_block(F.col("n_tokens"), width)).withColumn("down_", id_block(-F.col("n_tokens"), width)))
    for block, sign, ends in (("up_", 1, ("docs_at_most", "tokens_at_most")), ("down_", -1, ("docs_above", "tokens_above"))):
        sums = rows.groupBy(block).agg(F.sum("n_docs").alias("d_"), F.sum("tokens").alias("t_"))
        sums = block_offsets(block_offsets(sums, [], block, "d_", "do_"), [], block, "t_", "to_").select(block, "do_", "to_")
        inner = Window.partitionBy(block).orderBy(F.col("n_tokens") * sign).rowsBetween(Window.unboundedPreceding, 0 if sign > 0 else -1)
        rows = rows.join(sums, block)
        for name, value, base in ((ends[0], "n_docs", "do_"), (ends[1], "tokens", "to_")):
            rows = rows.withColumn(name, (F.col(base) + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long"))
        rows = rows.drop("do_", "to_")
    left = F.col("tokens_at_most") + F.col("n_tokens") * F.col("docs_above")
    share = F.col("docs_at_most") / (F.col("docs_at_most") + F.col("docs_above"))
    return rows.drop("up_", "down_").withColumns({"truncated_total": left.cast("long"), "quantile": share})


def truncated_total(limits: DataFrame, limit: int) -> int:
    """Tokens left if all documents are cut at any limit."""
    row = limits.filter(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).limit(1).collect()
    if row:
        return row[0]["truncated_total"] + (limit - row[0]["n_tokens"]) * row[0]["docs_above"]
    first = limits.orderBy("n_tokens").limit(1).collect()
    return limit * (first[0]["n_docs"] + first[0]["docs_above"]) if first else 0


def quantile(limits: DataFrame, q: float) -> int | None:
    """The least length that a share q of all documents does not exceed."""
    row = limits.filter(F.col("quantile") >= q).orderBy("n_tokens").limit(1).collect()
    return row[0]["n_tokens"] if row else None


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_limits(length_histogram(documents(spark, sf_dir, "text")))
