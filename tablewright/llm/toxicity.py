"""Toxicity: averaged subword embeddings under a linear softmax, trained together in numpy.

A text is lower-cased and what is no letter or digit becomes a space; its subwords are the runs of 3 to 6 bytes of each word,
with a space before and behind, and the whole word. Each subword hashes to a row of an embedding table; a text is the mean of the rows of its
different subwords (so that repetition doesn't drown a word), and a linear layer with softmax over (clean, toxic) stands on it.
An unseen misspelling shares most of its subwords' rows with the word it is made from. Since both layers are linear, the table of a trained model is folded into one number for each
subword before it is sent out, and scoring is a sum over the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import documents, fmix, slices

_CLEAN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


#: A number for each letter at each place of a word; a word's code is their sum.
_LETTERS = fmix(np.arange(1, 1 + 256 * 64, dtype=np.uint64)).reshape(256, 64)


@dataclass(frozen=True)
class Setup:
    """per_class: labelled rows of each class that the model is fitted on at most, chosen by a hash of the id; max_bytes: of such a
    text at most, longer ones are not fitted on (all are scored). words: whether whole words are subwords. least_docs: fitted
    texts that a subword must be in; most_share: of fitted clean texts that it may be in, else it stays zero. prior: so many
    zero rows are added to a text's mean, which a short text then can't swing. scale: the mean is multiplied by it."""

    per_class: int = 2000
    max_bytes: int = 1 << 16
    buckets_log2: int = 18
    lengths: tuple[int, ...] = (3, 4, 5, 6)
    words: bool = True
    dim: int = 8
    least_docs: int = 4
    most_share: float = 0.1
    prior: float = 50.0
    scale: float = 100.0
    steps: int = 80
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 3


def subwords(raws: list[bytes], setup: Setup) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the different subwords of some texts, and the text's number, ordered by both."""
    bucket, owner = _occurrences(raws, setup)
    size = 1 << setup.buckets_log2
    found = []
    seen = np.zeros(size, bool)
    cuts = np.searchsorted(owner, np.arange(len(raws) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        seen[bucket[a:b]] = True
        some = np.flatnonzero(seen)
        seen[some] = False
        found.append(some)
    counts = [len(x) for x in found]
    return (np.concatenate(found) if found else np.zeros(0, np.int64)), np.repeat(np.arange(len(raws), dtype=np.int32), counts)


def _occurrences(raws: list[bytes], setup: Setup) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword, and the text's number, ordered by text."""
    parts = [b" " + b" ".join(x.decode("utf-8", "replace").lower().encode().translate(_CLEAN).split()) + b" " for x in raws]
    text = np.frombuffer(b"".join(parts), np.uint8)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
    space = text == 32
    found, owners = [], []
    code = text.astype(np.uint64)
    inner = np.zeros(len(text), np.int32)  # spaces before each byte
    np.cumsum(space[:-1], out=inner[1:])
    for n in range(2, max(setup.lengths) + 1):
        if len(text) < n:
            break
        code = (code[:-1] << np.uint64(8)) | text[n - 1 :]
        if n not in setup.lengths:
            continue
        last = len(text) - n + 1
        ok = inner[n - 1 : n - 1 + last] == inner[1 : 1 + last]  # no space but at the ends
        at = np.flatnonzero(ok)
        found.append(((code[at] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - setup.buckets_log2))
        owners.append(owner[at])
    if setup.words:
        edges = np.flatnonzero(space)
        first, size = edges[:-1] + 1, np.diff(edges) - 1
        long = size + 2 > max(setup.lengths)  # a shorter word is a run already
        first, size = first[long], size[long]
        if len(first):
            place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            letters = text[np.repeat(first, size) + place]
            code = np.add.reduceat(_LETTERS[letters, np.minimum(place, _LETTERS.shape[1] - 1)], np.cumsum(size) - size)
            found.append((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - setup.buckets_log2))
            owners.append(owner[first])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    buckets, owners = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], owners[order]


@dataclass(frozen=True)
class Model:
    """logit: of each subword for toxic against clean, times scale; a text's logit is bias + their mean."""

    logit: np.ndarray
    bias: float
    setup: Setup

    def scores(self, raws: list[bytes]) -> np.ndarray:
        bucket, owner = subwords(raws, self.setup)
        n = np.bincount(owner, minlength=len(raws))
        total = np.bincount(owner, weights=self.logit[bucket], minlength=len(raws))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / (n + self.setup.prior), -60, 60)))


def train(raws: list[bytes], labels: np.ndarray, setup: Setup = Setup()) -> Model:
    """Fit both layers by full batches with momentum, steps scaled by layer; each class weighs the same. Without rows of both classes all scores are the share of label 1."""
    size = 1 << setup.buckets_log2
    if not len(raws) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(size), float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -14, 14)), setup)
    rows, columns = [], []
    for at in range(0, len(raws), 200):
        bucket, owner = subwords(raws[at : at + 200], setup)
        rows.append(owner + np.int32(at))
        columns.append(bucket.astype(np.int32))
    row, column = np.concatenate(rows), np.concatenate(columns)
    total = np.bincount(row, minlength=len(raws)) + setup.prior
    texts = np.bincount(column, minlength=size)
    clean = np.bincount(column[labels[row] == 0], minlength=size)
    use = ((texts >= setup.least_docs) & (clean <= setup.most_share * (labels == 0).sum()))[column]
    row, column = row[use], column[use]
    weight = (setup.scale / total[row]).astype(np.float32)
    kept, column = np.unique(column, return_inverse=True)
    if not len(kept):
        return Model(np.zeros(size), 0.0, setup)
    by_row = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    filled = row[by_row]
    by_column = np.argsort(column, kind="stable")
    column_starts = np.searchsorted(column[by_column], np.arange(len(kept)))
    row_c, weight_c = row[by_column], weight[by_column]
    rng = np.random.default_rng(setup.seed)
    table = np.zeros((len(kept), setup.dim), np.float32)
    layer = rng.normal(0, 1, (setup.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight_of = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())).astype(np.float32)
    want = np.stack((labels == 0, labels == 1), 1).astype(np.float32)
    values = [table, layer, bias]
    first, second = [np.zeros_like(v) for v in values], [0.0] * len(values)
    for step in range(1, setup.steps + 1):
        mean = np.zeros((len(raws), setup.dim), np.float32)
        for j in range(setup.dim):
            mean[filled, j] = np.add.reduceat(weight * table[column, j], by_row)
        z = mean @ layer + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - want) * weight_of[:, None]
        dmean = dz @ layer.T
        dtable = np.stack([np.add.reduceat(weight_c * dmean[row_c, j], column_starts) for j in range(setup.dim)], 1) + setup.decay * table
        for k, (v, g) in enumerate(zip(values, (dtable, mean.T @ dz + setup.decay * layer, dz.sum(0)), strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * float((g * g).mean())  # one for a layer: rare subwords, whose gradients are small, stay small
            v -= setup.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    logit = np.zeros(size)
    logit[kept] = setup.scale * (table @ (layer[:, 1] - layer[:, 0]))
    return Model(logit, float(bias[1] - bias[0]), setup)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", setup: Setup = Setup()) -> Model:
    """Train on a bounded sample of labelled rows whose crc32 of the id modulo 3 isn't 1 (see Setup). Null ids and labels are left out; of
    repeated labels the higher counts, of repeated rows the first text; other columns are not read. No labels: see train()."""
    known = labels.select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("label_")).filter(F.col("id_").isNotNull() & F.col("label_").isin(0, 1) & (fold(F.col("id_")) != 1))
    known = known.groupBy("id_").agg(F.max("label_").alias("label_"))
    texts = df.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_")).filter(F.octet_length("text_") <= setup.max_bytes)
    found = []
    for label in (0, 1):
        some = known.filter(F.col("label_") == label).orderBy(F.xxhash64("id_"), "id_").limit(setup.per_class)
        found += texts.join(F.broadcast(some), "id_").groupBy("id_").agg(F.min("text_"), F.first("label_")).collect()  # per_class rows at most
    found.sort(key=lambda r: (r[0], r[1]))
    return train([r[1].encode() for r in found], np.array([r[2] for r in found], np.int64), setup)


def fold(column):
    """crc32 of the id as text, modulo 3."""
    return F.crc32(column.cast("string").cast("binary")) % 3


def toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of df: its whole text's score, the text alone being looked at.

    Null and wordless texts get the score of the bias. held_out: the row's label could not be learnt; null ids count as held out.
    Repeated rows stay; other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            raws = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(raws))], ["doc_id", "score"])

    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
