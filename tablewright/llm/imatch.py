"""Document fingerprints by I-Match.

A first pass counts, over all documents, how many have each term; terms whose inverse document frequency lies in a band
form the lexicon. The lexicon is dealt at random into 2, 4, 8, ... thinned lexicons, a level for each number; the first
`lexicons` of a level are used. A text takes the level at which a thinned lexicon holds half to one of its terms on average, and
the next two, so that texts of up to four times as many terms have a level in common. For each thinned lexicon the text's distinct terms that it holds are sorted and hashed; these hashes
are the fingerprint. A hash then rests on very few terms, so that an edit leaves the others as they are. The share of hashes
that two fingerprints have in common, of those at the same level for which either has a term, is their likeness.

The lexicon's size has a bound that doesn't grow with the number of documents: a term in it is in at least a share
`least` of them, so there are at most (mean distinct terms of a document) / least. It is checked before it is sent out: where
there are more than `most_terms`, those in the fewest documents are left out, by raising the least number of documents.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import documents, fmix, partitions, raw_texts, slices, written

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_EMPTY = b"\0\0\0\0"


@dataclass(frozen=True)
class Band:
    """idf: least and most of ln(documents / documents with the term). lexicons: thinned ones of a level that are used; levels: that a text
    takes. A text with fewer than least_terms terms of the lexicon is fingerprinted by all its terms. most_terms: bound of the
    lexicon that is sent to the executors."""

    idf: tuple[float, float] = (2.5, 8.0)
    lexicons: int = 32
    levels: int = 3
    least_terms: int = 8
    seed: int = 7
    most_terms: int = 8_000_000

    def frequencies(self, n: int) -> tuple[int, int]:
        """Least and most number of documents with a term of the lexicon."""
        return math.ceil(n * math.exp(-self.idf[1])), max(1, math.floor(n * math.exp(-self.idf[0])))


def distinct_terms(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of some texts; for each text, where its terms begin in the third array, of positions of hashes."""
    number: dict[bytes, int] = {}
    flat: list[int] = []
    starts = [0]
    for raw in raws:
        flat += [number.setdefault(w, len(number)) for w in set(raw.translate(_LOWER).split())]
        starts.append(len(flat))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, number), np.uint64, len(number)), np.array(starts), np.array(flat, np.int64)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """Rows (hash long, df long) of all terms; texts: one column. Counts are added up in each task, then by hash, in blocks of many terms."""
    n = 4 * partitions(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, c = added(held)
            held.clear()
            block = (h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
            cuts = np.searchsorted(block, np.arange(n + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([h[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()), pa.array([c[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())],
                ["block", "hashes", "counts"],
            )

        for batch in slices(batches, 0):
            h, _, flat = distinct_terms(raw_texts(batch.column(0)))
            if len(h):
                held.append((h, np.bincount(flat, minlength=len(h)).astype(np.uint32)))
            if sum(len(x) for x, _ in held) > 2_000_000:
                held[:] = [added(held)]
                if len(held[0][0]) > 1_000_000:
                    yield from out()
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for h, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append((np.frombuffer(h, np.uint64), np.frombuffer(c, np.uint32)))
            if sum(len(x) for x, _ in held) > 4_000_000:
                held[:] = [added(held)]
        if held:
            h, c = added(held)
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000].view(np.int64)), pa.array(c[at : at + 100_000].astype(np.int64))], ["hash", "df"])

    return texts.mapInArrow(count, "block int, hashes binary, counts binary").repartition(n, "block").mapInArrow(merge, "hash long, df long")


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all parts, and their counts added up."""
    h = np.concatenate([x for x, _ in parts])
    c = np.concatenate([x for _, x in parts])
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(c.astype(np.int64), first).astype(np.uint32)


def lexicon_of(texts: DataFrame, n: int, band: Band) -> np.ndarray:
    """Sorted hashes of the terms in the band; of more than most_terms, those in the most documents, none of equals being left."""
    least, most = band.frequencies(n)
    some = written(document_frequencies(texts).filter(F.col("df").between(least, most)))
    if some.count() > band.most_terms:
        by_df = some.groupBy("df").count().orderBy(F.desc("df"))  # a row for each number of documents
        held = by_df.withColumn("terms", F.sum("count").over(Window.orderBy(F.desc("df")))).filter(F.col("terms") <= band.most_terms)
        some = some.join(F.broadcast(held.agg(F.min("df").alias("from_"))), F.col("df") >= F.col("from_")).select("hash", "df")
    return np.sort(some.select("hash").toArrow().column(0).to_numpy().view(np.uint64))


_HEAD = struct.Struct("<BB")  # level, and 1 if the terms are all those of the text
_WORDLESS = xxhash.xxh32_digest(b"", 1)


def level_of(terms: int) -> int:
    """The least level with a thinned lexicon or more for each term."""
    return (terms - 1).bit_length() if terms else 0


def prints(raws: list[bytes], lexicon: np.ndarray, band: Band) -> list[bytes]:
    """The fingerprint of each text: its least level, then four bytes for each thinned lexicon of this level and of the next ones, zero
    if the text has none of its terms. None is all zeros."""
    hashes, starts, flat = distinct_terms(raws)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        known = lexicon[at] == hashes
    else:
        known = np.zeros(len(hashes), bool)
    mixed = fmix(hashes ^ np.uint64(band.seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    digest, k = xxhash.xxh32_digest, band.lexicons
    out = []
    for a, b in itertools.pairwise(starts.tolist()):
        mine = flat[a:b]
        some = mine[known[mine]]
        every = len(some) < band.least_terms
        terms = np.sort(mixed[mine if every else some])
        if not len(terms):
            out.append(_HEAD.pack(0, 1) + _WORDLESS + bytes(4 * (band.levels * k - 1)))
            continue
        raw, level = terms.tobytes(), level_of(len(terms))
        while True:
            rows = []
            for x in range(level, level + band.levels):
                of = (terms >> np.uint64(64 - x)).astype(np.int64) if x else np.zeros(len(terms), np.int64)
                n = int(np.searchsorted(of, k))  # terms of the first k lexicons
                row = [_EMPTY] * k
                cuts = np.flatnonzero(np.diff(of[:n], prepend=-1)).tolist()
                for c, d in itertools.pairwise([*cuts, n]):
                    row[of[c]] = digest(raw[8 * c : 8 * d], 0)
                rows += row
            if level == 0 or any(x != _EMPTY for x in rows):
                break
            level -= 1
        out.append(_HEAD.pack(level, every) + b"".join(rows))
    return out


def likeness(a: bytes, b: bytes, levels: int = 3) -> float:
    """Equal hashes as a share of those that either has, at the levels that both have; 0 if there is none."""
    (x, every), (y, other) = _HEAD.unpack_from(a), _HEAD.unpack_from(b)
    p, q = (np.frombuffer(raw, np.uint32, offset=_HEAD.size).reshape(levels, -1) for raw in (a, b))
    p, q = p[max(0, y - x) : max(0, levels + y - x)], q[max(0, x - y) : max(0, levels + x - y)]
    if every != other or not len(p):
        return 0.0
    either = (p != 0) | (q != 0)
    return float(((p == q) & either).sum() / max(1, either.sum()))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def imatch(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: Band = Band()) -> DataFrame:
    """Rows (doc_id, fingerprint): one for each row of df. A null text counts as an empty one; nulls in the id and repeated rows
    stay; equal texts have equal fingerprints; other columns are not read. An empty table gives an empty result."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lexicon = lexicon_of(source.select("text"), source.count(), band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.hex() for x in prints(raw_texts(batch.column(1)), lexicon, band)], pa.string())], ["doc_id", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, fingerprint string")


def edit_test(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: Band = Band()) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each row of df.

    The next document is the one with the next smaller id, after the last the first; rows of one id are ordered by a hash of the
    text, falling, and null ids come last. A single row is its own next. A null text counts as an empty one. An empty table
    gives an empty result. Texts go, compressed, to ranges of ids; the first document of a range is also sent to the one before.
    """
    spark = df.sparkSession
    last = -(1 << 63)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(last))
    parts = 4 * partitions(spark)
    stats = source.select(key.alias("k")).agg(F.count("*"), F.max("k"), F.percentile_approx("k", [k / parts for k in range(1, parts)], 100 * parts)).collect()[0]
    n, top = stats[0], stats[1]
    tops = np.array(sorted({*(stats[2] or []), top} - {None}), np.int64)  # greatest key of each range; real keys, so no range is empty
    lexicon = lexicon_of(source.select("text"), n, band)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, 1):
            raws = raw_texts(batch.column(1))
            keys = batch.column(0).fill_null(last).to_numpy()
            at = np.searchsorted(tops, keys)
            ends = np.flatnonzero(tops[at] == keys)  # these are next to what the range above ends with; the greatest to what the first ends with
            rows = np.concatenate((np.arange(len(keys)), ends))
            packed = [pack.compress(x) for x in raws]
            ties = np.fromiter((xxhash.xxh64_intdigest(x) >> 1 for x in raws), np.int64, len(raws))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((at, (at[ends] + 1) % len(tops))).astype(np.int32)), pa.array(np.arange(len(rows)) >= len(keys)),
                    batch.column(0).take(pa.array(rows)), pa.array(keys[rows]), pa.array(ties[rows]), pa.array([packed[k] for k in rows], pa.binary()),
                ],
                ["range_", "copy_", "doc_id", "k", "tie_", "text"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple[int, bool, int | None, bytes]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), unpack.decompress(batch.column(5)[k].as_py())

        held: list[tuple[int, bool, int | None, bytes]] = []
        size = 0
        for row in rows():
            held.append(row)
            size += len(row[3])
            if size > 2 << 20 and len(held) > 1:
                yield answers(held)
                held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield answers(held)

    def answers(held: list[tuple[int, bool, int | None, bytes]]) -> pa.RecordBatch:
        pairs = [k for k in range(len(held) - 1) if not held[k][1] and held[k][0] == held[k + 1][0]]
        texts = [x[3].decode() for x in held]
        changed = [edited(texts[k], texts[k + 1]).encode() for k in pairs]
        own = prints([x[3] for x in held], lexicon, band)
        new = prints(changed, lexicon, band)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([held[k][2] for k in pairs], pa.int64()), pa.array([len(texts[k]) for k in pairs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
                pa.array([own[k].hex() for k in pairs], pa.string()), pa.array([x.hex() for x in new], pa.string()),
                pa.array([likeness(own[k], x, band.levels) for k, x in zip(pairs, new, strict=True)], pa.float64()), pa.array([likeness(own[k], own[k + 1], band.levels) for k in pairs], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    dealt = source.mapInArrow(deal, "range_ int, copy_ boolean, doc_id long, k long, tie_ long, text binary").repartition(partitions(spark), "range_")
    ordered = dealt.sortWithinPartitions("range_", "copy_", F.desc("k"), F.desc("tie_"))
    return ordered.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_test(documents(spark, sf_dir))
