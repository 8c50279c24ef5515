"""The queries of this package by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.counts import op5_length_histogram
from tablewright.llm.dedup import op1_suffix_dedup
from tablewright.llm.imatch import op9_imatch
from tablewright.llm.mixing import op3_multinomial_mix
from tablewright.llm.pieces import op8_shared_prefix_pieces
from tablewright.llm.quality import op10_compression_bands
from tablewright.llm.sharding import op6_hash_tree_shards
from tablewright.llm.simhash import op7_simhash_pigeonring
from tablewright.llm.tokens import op2_range_coded_tokens
from tablewright.llm.toxicity import op4_subword_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_range_coded_tokens,
        op3_multinomial_mix,
        op4_subword_toxicity,
        op5_length_histogram,
        op6_hash_tree_shards,
        op7_simhash_pigeonring,
        op8_shared_prefix_pieces,
        op9_imatch,
        op10_compression_bands,
    )
}

ORACLES: dict[str, str] = {}
