"""Quality rules: word, line and repetition counts, and compression bands.

Zstandard ratios (compressed bytes by bytes) of the whole text and of fixed chunks are held against limits that
depend on the length: repetitive text falls below its band, random or encoded text rises above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import documents, raw_texts, slices

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
_NOT_COUNTED = SPACES + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a code point


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length in bytes: (from this length, least, most), of whole texts and of chunks. A text of `chunk_bytes` or
    more is also cut into chunks of so many bytes, the last one being what is left, and fails if more than `chunk_share` of
    them leave the limits for their length."""

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0), (128, 0.35, 1.05), (256, 0.50, 0.88), (512, 0.50, 0.82), (768, 0.48, 0.80), (1024, 0.465, 0.74), (1536, 0.45, 0.72), (2048, 0.44, 0.70), (3072, 0.435, 0.68),
        (4096, 0.42, 0.66), (6144, 0.412, 0.66), (8192, 0.403, 0.64), (12288, 0.398, 0.64), (16384, 0.385, 0.62), (32768, 0.37, 0.62), (65536, 0.33, 0.60), (262144, 0.28, 0.60),
    )
    chunk: tuple[tuple[int, float, float], ...] = ((0, 0.0, 9.0), (128, 0.25, 1.10), (512, 0.36, 0.90), (1024, 0.36, 0.84), (2048, 0.36, 0.78), (4096, 0.36, 0.74))
    chunk_bytes: int = 4096
    chunk_share: float = 0.1
    min_words: int = 50
    max_repeat_percent: int = 50


def counts_of(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(raw.translate(None, _NOT_COUNTED)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = dict.fromkeys(words)
    v = len(number)
    for k, w in enumerate(number):
        number[w] = k
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _within(raw: bytes, limits: tuple[tuple[int, float, float], ...], zstd: zstandard.ZstdCompressor) -> bool:
    n = len(raw)
    least, most = next((low, high) for start, low, high in reversed(limits) if n >= start)
    return least <= len(zstd.compress(raw)) / n <= most


def in_bands(raw: bytes, bands: Bands, zstd: zstandard.ZstdCompressor) -> bool:
    """Whether the ratios of the text and of its chunks stay within the limits for their lengths; an empty text's do."""
    if raw and not _within(raw, bands.whole, zstd):
        return False
    if len(raw) < bands.chunk_bytes:
        return True
    chunks = [raw[k : k + bands.chunk_bytes] for k in range(0, len(raw), bands.chunk_bytes)]
    return sum(not _within(x, bands.chunk, zstd) for x in chunks) <= bands.chunk_share * len(chunks)


def measures(raws: list[bytes], bands: Bands) -> list[tuple]:
    zstd = zstandard.ZstdCompressor(level=bands.level)
    out = []
    for raw in raws:
        c = counts_of(raw)
        failed = c[0] < bands.min_words or 100 * c[4] > bands.max_repeat_percent * c[0]
        out.append((*c, failed, not failed and in_bands(raw, bands, zstd)))
    return out


_COLUMNS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one for each row of df.

    A null text counts as an empty one and fails (too few words). Each row is judged alone: a null or repeated id is
    kept as it is, other columns are not read, an empty table gives an empty result. Text is worked on whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            columns = list(zip(*measures(raw_texts(batch.column(1)), bands), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True))], ["doc_id", *(n for n, _ in _COLUMNS)])

    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(df: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of df, all columns, whose text passes the base rules and the bands. A null text doesn't."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array([x[-1] for x in measures(raw_texts(batch.column(at)), bands)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
