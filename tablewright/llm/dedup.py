"""Removal of passages that an earlier document has, by suffix order.

A passage is any run of `window` bytes. Texts are cut into shards by content: each window's least k-gram hash (its anchor)
depends on the window alone, so equal windows have equal anchors, and a maximal run of windows with one anchor is a piece. A
first pass finds the anchors that two documents have; pieces with other anchors can't hold a repeated window. Of the rest,
equal pieces meet once (the one of the smallest document stands for all; the others are repeated as a whole), and pieces go to
shards by anchor. Of a shard, pieces that agree with no other beside their anchor can't share a window with one and are left out;
the others are joined and their suffixes sorted (suffixes.Sorter); windows that share `window` bytes
are neighbours in that order, and each group's smallest document keeps its bytes.

Everything that moves is a few blocks of numbers or compressed text for each task. Texts are read three times and moved twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import documents, fmix, let_go, partitions, raw_texts, slices
from tablewright.llm.suffixes import Sorter

GRAM = 16
NO_ID = (1 << 63) - 1  # a null id is larger than any other
HELD_BYTES = 32 << 20
SHARD_BYTES = 2 << 20  # of pieces that are sorted together; numpy needs some 60 bytes for each


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """Of the GRAM bytes from each position on."""
    h = text.astype(np.uint64) + np.uint64(1)
    width, factor = 1, 0x9E3779B97F4A7C15
    while width < GRAM:  # hash of 2, 4, 8, 16 bytes from both halves
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64) | 1
        width *= 2
    return fmix(h)


def anchored(raws: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of some texts: anchor, number of the text, first byte in it, windows; and the joined bytes with each text's start."""
    text = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    starts = np.cumsum(sizes) - sizes
    n = len(text) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty, empty, empty, text
    h = _gram_hashes(text)
    span, reach = window - GRAM + 1, 1
    while 2 * reach <= span:
        h = np.minimum(h[:-reach], h[reach:])
        reach *= 2
    if reach < span:
        h = np.minimum(h[: len(h) - (span - reach)], h[span - reach :])
    last = starts + sizes - window  # last window of each text
    inside = np.zeros(n + 1, np.int32)
    full = np.flatnonzero(sizes >= window)
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, np.minimum(last[full] + 1, n), -1)
    valid = np.cumsum(inside[:-1]) > 0
    fresh = np.ones(n, bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[starts[full]] = True
    fresh[1:] |= ~valid[:-1]
    begin = np.flatnonzero(valid & fresh)
    stop = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True))
    owner = np.searchsorted(starts, begin, side="right") - 1
    owner = full[np.searchsorted(starts[full], starts[owner], side="right") - 1]  # empty texts share a start with the next
    return h[begin], owner, begin - starts[owner], stop - begin + 1, text


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.array([len(x)], "<i8").tobytes() + x.tobytes() for x in arrays))


def _unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, "<i8", 1, at)[0])
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy()


def block_labels(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of n blocks that repartition(n) by it puts in a partition of its own."""
    rows = spark.range(0, 24 * n + 200, 1, 1).select(F.col("id").cast("int").alias("v")).select(F.pmod(F.hash("v"), F.lit(n)).alias("p"), "v").groupBy("p").agg(F.min("v")).collect()  # n rows
    return np.array([r[1] for r in sorted(rows)], np.int32)


def _homes(ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Block of texts that a document is dealt to."""
    return labels[(fmix(ids.view(np.uint64)) % np.uint64(len(labels))).astype(np.int64)]


def _shard(anchors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return labels[(fmix(anchors + np.uint64(0x5851F42D)) % np.uint64(len(labels))).astype(np.int64)]


def _short(anchors: np.ndarray) -> np.ndarray:
    """40 bits of an anchor: enough to tell which are shared, since one that seems so only takes its pieces along."""
    return fmix(anchors + np.uint64(0x5851F42D)) >> np.uint64(24)


def _cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, first, end) of the runs of equal keys."""
    edge = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1], [True]))) if len(sorted_keys) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(sorted_keys[a]), int(a), int(b)


_BLOCKS = "block int, data binary"


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["block", "data"])


def _anchor_blocks(batches: Iterator[pa.RecordBatch], window: int, homes: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
    """By block of anchors: each anchor with the ids of its first and last document here, and a home of one that has it."""
    for batch in slices(batches, 1, 2 << 20):
        anchors, owner, _, _, _ = anchored(raw_texts(batch.column(1)), window)
        if not len(anchors):
            continue
        ids = _ids(batch.column(0))
        shard = _shard(anchors, shards)
        order = np.argsort(shard, kind="stable")  # and by text
        short, owner = _short(anchors)[order], owner[order]
        rows = []
        for key, a, b in _cuts(shard[order]):
            some, local = np.unique(owner[a:b], return_inverse=True)
            part = short[a:b]
            rows.append((key, _pack((part & np.uint64(0xFFFFFFFF)).astype(np.uint32), (part >> np.uint64(32)).astype(np.uint8), np.diff(local, prepend=0).astype(np.uint32), ids[some])))
        yield _batch(rows)


def _shared_anchors(batches: Iterator[pa.RecordBatch], homes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """By home: the anchors that two documents have, one of them at home there."""
    anchors, ids = [], []
    for batch in batches:
        for data in batch.column(1).to_pylist():
            low, high, step, some = _unpack(data, np.uint32, np.uint8, np.uint32, np.int64)
            anchors.append(low | (high.astype(np.uint64) << np.uint64(32)))
            ids.append(some[np.cumsum(step)])
    if not anchors:
        return
    a, d = np.concatenate(anchors), np.concatenate(ids)
    del anchors, ids
    order = np.argsort(a, kind="stable")
    a, d = a[order], d[order]
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    shared = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)
    use = np.repeat(shared, np.diff(np.append(start, len(a))))
    a, home = a[use], _homes(d[use], homes)
    order = np.argsort(home, kind="stable")
    a = a[order]
    rows = [(key, _pack(np.unique(a[x:y]))) for key, x, y in _cuts(home[order])]
    if rows:
        yield _batch(rows)


class _Pieces:
    """Equal pieces met in a task: the one of the smallest document is held, the others are repeated as a whole."""

    def __init__(self) -> None:
        self.held: dict[bytes, tuple[int, int, int, int]] = {}  # text: id, tie, first byte, anchor
        self.size = 0
        self.lost: list[tuple[int, int, int, int]] = []  # id, tie, first byte, bytes
        self.same: dict[bytes, list[tuple[int, int]]] = {}  # text: tie, first byte of others with the held one's id

    def add(self, text: bytes, doc: int, tie: int, first: int, anchor: int) -> None:
        old = self.held.get(text)
        if old is None:
            self.held[text] = (doc, tie, first, anchor)
            self.size += len(text) + 100
        elif doc < old[0]:
            self.lost.append((old[0], old[1], old[2], len(text)))
            self.lost += [(old[0], t, f, len(text)) for t, f in self.same.pop(text, ())]
            self.held[text] = (doc, tie, first, anchor)
        elif doc > old[0]:
            self.lost.append((doc, tie, first, len(text)))
        else:  # the same id again: its windows stay or go with those of the piece that is held
            self.same.setdefault(text, []).append((tie, first))

    def flush(self, homes: np.ndarray, shards: np.ndarray) -> list[tuple[int, bytes]]:
        """Held pieces by shard (blocks from 0), lost ones by home (blocks below 0: -1 - home)."""
        rows = []
        held = [(doc, tie, first, anchor, text) for text, (doc, tie, first, anchor) in self.held.items()]
        held += [(self.held[text][0], tie, first, self.held[text][3], text) for text, more in self.same.items() for tie, first in more]
        if held:
            anchors = np.array([x[3] for x in held], np.uint64)
            shard = _shard(anchors, shards)
            order = np.lexsort((anchors, shard))
            for key, a, b in _cuts(shard[order]):
                some = [held[k] for k in order[a:b]]
                numbers = [np.array([x[k] for x in some], np.int64) for k in range(3)]
                joined = np.frombuffer(b"".join(x[4] for x in some), np.uint8)
                rows.append((key, _pack(*numbers, anchors[order[a:b]], np.array([len(x[4]) for x in some], np.int64), joined)))
        rows += _lost_rows(self.lost, homes)
        self.__init__()  # type: ignore[misc]
        return rows


def _lost_rows(lost: list[tuple[int, int, int, int]], homes: np.ndarray) -> list[tuple[int, bytes]]:
    if not lost:
        return []
    numbers = np.array(lost, np.int64)
    home = _homes(np.ascontiguousarray(numbers[:, 0]), homes)
    order = np.argsort(home, kind="stable")
    numbers = numbers[order]
    return [(-1 - key, _pack(*(np.ascontiguousarray(numbers[a:b, k]) for k in range(4)))) for key, a, b in _cuts(home[order])]


def _shared_pieces(batches: Iterator[pa.RecordBatch], window: int, homes: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each home's texts, after its shared anchors: the pieces that have one."""
    anchors: dict[int, np.ndarray] = {}
    pieces = _Pieces()
    for block, blobs, docs in _at_home(batches):
        if blobs:
            anchors = {block: np.unique(np.concatenate([_unpack(x, np.uint64)[0] for x in blobs]))}
        known = anchors.get(block)
        if known is None or not docs:
            continue
        raws = [x[1] for x in docs]
        found, owner, first, windows, text = anchored(raws, window)
        if not len(found):
            continue
        short = _short(found)
        at = np.minimum(np.searchsorted(known, short), len(known) - 1)
        use = np.flatnonzero(known[at] == short)
        ties = [_tie(x) for x in raws]
        for k, doc, begin, count in zip(use.tolist(), owner[use].tolist(), first[use].tolist(), windows[use].tolist(), strict=True):
            pieces.add(raws[doc][begin : begin + count + window - 1], docs[doc][0], ties[doc], begin, int(found[k]))
        if pieces.size > HELD_BYTES:
            yield _batch(pieces.flush(homes, shards))
    rows = pieces.flush(homes, shards)
    if rows:
        yield _batch(rows)


def _tie(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) >> 1


def _repeated(batches: Iterator[pa.RecordBatch], window: int, homes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of a shard's pieces, what an earlier document has, by home (blocks below 0), beside what is known to be repeated."""
    lost: list[tuple[int, int, int, int]] = []
    groups: dict[int, list[bytes]] = {}
    for batch in batches:
        told = [(block, data) for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if passed := [x for x in told if x[0] < 0]:  # known already
            yield _batch(passed)
        for block, data in told:
            if block >= 0:
                groups.setdefault(block, []).append(data)
    while groups:
        _, blobs = groups.popitem()
        held: dict[bytes, list[tuple[int, int, int]]] = {}
        anchor_of: dict[bytes, int] = {}
        while blobs:
            docs, ties, firsts, anchors, sizes, joined = _unpack(blobs.pop(), np.int64, np.int64, np.int64, np.uint64, np.int64, np.uint8)
            raw, at = joined.tobytes(), 0
            for doc, tie, first, anchor, size in zip(docs.tolist(), ties.tolist(), firsts.tolist(), anchors.tolist(), sizes.tolist(), strict=True):
                text = raw[at : at + size]
                at += size
                held.setdefault(text, []).append((doc, tie, first))
                anchor_of[text] = anchor
        texts = list(held)
        owner = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            owner[k] = least = min(held[text])[0]
            lost += [(doc, tie, first, len(text)) for doc, tie, first in held[text] if doc > least]
        # a piece alone under its anchor shares no window with another
        anchors = np.array([anchor_of[x] for x in texts], np.uint64)
        _, place, count = np.unique(anchors, return_inverse=True, return_counts=True)
        use = np.flatnonzero(count[place] > 1)
        use = use[np.argsort(anchors[use], kind="stable")]
        some = [_may_share([texts[k] for k in use[a:b]], anchors[use[a:b]], owner[use[a:b]], window) for a, b in _parts(use, texts, anchors)]
        use = use[np.concatenate(some)] if some else use
        for a, b in _parts(use, texts, anchors):
            for k, first, size in _earlier_windows([texts[x] for x in use[a:b]], owner[use[a:b]], window):
                piece = use[a + k]
                lost += [(doc, tie, at + first, size) for doc, tie, at in held[texts[piece]] if doc == owner[piece]]
        if len(lost) > 200_000:
            yield _batch(_lost_rows(lost, homes))
            lost = []
    if lost:
        yield _batch(_lost_rows(lost, homes))


def _parts(use: np.ndarray, texts: list[bytes], anchors: np.ndarray) -> list[tuple[int, int]]:
    """Runs of `use` (pieces by anchor) of some SHARD_BYTES; an anchor's pieces stay together."""
    if not len(use):
        return []
    sizes = np.fromiter((len(texts[k]) + 1 for k in use), np.int64, len(use))
    part = (np.cumsum(sizes) - sizes) // SHARD_BYTES
    head = np.concatenate(([True], anchors[use][1:] != anchors[use][:-1]))
    return [(a, b) for _, a, b in _cuts(part[head][np.cumsum(head) - 1])]


def _may_share(pieces: list[bytes], anchors: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Which pieces can share a window with one of another document: all that do, and few more.

    A shared window has the anchor's bytes at one place in both pieces, and at least half of its other bytes on one side of them: so the
    pieces agree in that many bytes before or after some occurrence of the anchor. Equal hashes of these bytes are taken for agreement."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(sizes) - sizes
    h = _gram_hashes(np.frombuffer(b"".join(pieces), np.uint8))
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(h)]
    at = np.flatnonzero(h == anchors[piece])
    room = (starts + sizes)[piece[at]] - at
    at, room = at[room >= GRAM], room[room >= GRAM]
    side = (window - GRAM + 1) // 2
    out = np.zeros(len(pieces), bool)
    for far, near, ok in ((-side, -GRAM, at - side >= starts[piece[at]]), (side, GRAM, room >= GRAM + side)):
        where = at[ok]
        who = piece[where]
        key = fmix(h[where + far] + anchors[who])
        if side > GRAM:
            key = fmix(key ^ h[where + near])
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        if len(start):
            docs = owner[who]
            mixed = np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start)
            out[who[np.repeat(mixed, np.diff(np.append(start, len(key))))]] = True
    return out


def _earlier_windows(pieces: list[bytes], owner: np.ndarray, window: int, sorter: Callable[[], Sorter] | None = None) -> list[tuple[int, int, int]]:
    """(piece, first byte, bytes) of the runs of windows that a piece of a smaller document has, by suffix order."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int32) + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    text += 1
    text[starts + sizes] = 1  # a separator, smaller than any byte
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    room = np.repeat(starts + sizes, sizes + 1) - np.arange(len(text)) >= window
    docs = owner[piece]
    earlier = np.zeros(len(text), bool)
    for positions, lcp in (sorter() if sorter else Sorter(window)).buckets(text):
        if len(positions) < 2:
            continue
        new = lcp < window
        new[0] = True
        start = np.flatnonzero(new)
        least = np.minimum.reduceat(docs[positions], start)
        hit = docs[positions] > np.repeat(least, np.diff(np.append(start, len(positions))))
        earlier[positions[hit]] = True
    earlier &= room
    edge = np.flatnonzero(np.diff(np.concatenate(([0], earlier.view(np.int8), [0]))))
    begin, stop = edge[::2], edge[1::2]
    # a run never crosses a separator: there is no room before it
    return list(zip(piece[begin].tolist(), (begin - starts[piece[begin]]).tolist(), (stop - begin + window - 1).tolist(), strict=True))


def _at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list[tuple]]]:
    """Runs of rows of one home: (home, blobs, []) before (home, [], documents as (id, text, row)), in slices."""
    let_go()
    unpack = zstandard.ZstdDecompressor()
    docs: list[tuple] = []
    blobs: list[bytes] = []
    home, size = None, 0
    for batch in batches:
        names = batch.schema.names
        block, kind, data = (batch.column(names.index(x)).to_pylist() for x in ("block_", "kind_", "data_"))
        ids = _ids(batch.column(names.index("id_"))).tolist()
        for k in range(batch.num_rows):
            if block[k] != home:
                if docs or blobs:
                    yield home, blobs, []  # type: ignore[misc]
                    yield home, [], docs  # type: ignore[misc]
                home, docs, blobs, size = block[k], [], [], 0
            if kind[k] == 0:
                blobs.append(data[k])
                continue
            if blobs:
                yield home, blobs, []  # type: ignore[misc]
                blobs = []
            raw = unpack.decompress(data[k])
            docs.append((ids[k], raw, (batch, k)))
            size += len(raw)
            if size > 1 << 20:
                yield home, [], docs  # type: ignore[misc]
                docs, size = [], 0
    if blobs:
        yield home, blobs, []  # type: ignore[misc]
    if docs:
        yield home, [], docs  # type: ignore[misc]


def _dealt(source: DataFrame, blobs: DataFrame, homes: np.ndarray) -> DataFrame:
    """source's rows (id_, text_, others) and blobs (block, data) at their homes, the blobs first. Texts are moved compressed."""
    at, others = source.columns.index("text_"), [c for c in source.columns if c != "text_"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, at):
            packed = pa.array([pack.compress(x) for x in raw_texts(batch.column(at))], pa.binary())
            rest = [batch.column(k) for k in range(batch.num_columns) if k != at]
            null = batch.column(at).is_null()
            yield pa.RecordBatch.from_arrays([pa.array(_homes(_ids(batch.column(0)), homes)), pa.array(np.ones(batch.num_rows, np.int32)), packed, null, *rest], ["block_", "kind_", "data_", "null_", *others])

    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "text_")
    docs = source.mapInArrow(deal, f"block_ int, kind_ int, data_ binary, null_ boolean, {schema}")
    empty = {c: F.lit(None).cast(t) for c, t in docs.dtypes if c not in ("block_", "kind_", "data_")}
    told = blobs.select(F.col("block").alias("block_"), F.lit(0).alias("kind_"), F.col("data").alias("data_")).withColumns(empty)
    n = partitions(source.sparkSession)
    return docs.unionByName(told).repartition(n, "block_").sortWithinPartitions("block_", "kind_")


def _merged(first: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) that some runs cover."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate((first + size)[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return list(zip(begin[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))


def _applied(batches: Iterator[pa.RecordBatch], out: Callable[[list[tuple], list[list[tuple[int, int]]]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`out` of each slice of documents and the runs that go from each."""
    found: tuple[int, dict[tuple[int, int], list[tuple[int, int]]]] = (-1, {})
    for block, blobs, docs in _at_home(batches):
        if blobs:
            ids, ties, first, size = (np.concatenate(x) for x in zip(*(_unpack(b, *[np.int64] * 4) for b in blobs), strict=True))
            order = np.lexsort((ties, ids))
            ids, ties, first, size = ids[order], ties[order], first[order], size[order]
            edge = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]), [True])))
            found = (block, {(int(ids[a]), int(ties[a])): _merged(first[a:b], size[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)})
        if docs:
            mine = found[1] if found[0] == block else {}
            yield out(docs, [mine.get((x[0], _tie(x[1])), []) for x in docs])


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    at, parts = 0, []
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def _runs(source: DataFrame, window: int) -> DataFrame:
    """source's rows at their homes after the blobs that say what goes from them; source: id_, text_, others."""
    if window < 2 * GRAM:
        raise ValueError(f"windows have {2 * GRAM} bytes at least")
    spark = source.sparkSession
    n = partitions(spark)
    homes = shards = block_labels(spark, n)
    pairs = source.select("id_", "text_")
    anchors = pairs.mapInArrow(partial(_anchor_blocks, window=window, homes=homes, shards=shards), _BLOCKS)
    shared = anchors.repartition(n, "block").mapInArrow(partial(_shared_anchors, homes=homes), _BLOCKS)
    pieces = _dealt(pairs, shared, homes).mapInArrow(partial(_shared_pieces, window=window, homes=homes, shards=shards), _BLOCKS)
    lost = pieces.repartition(n, "block").mapInArrow(partial(_repeated, window=window, homes=homes), _BLOCKS)
    lost = lost.select((-1 - F.col("block")).alias("block"), "data")
    return _dealt(source, lost, homes)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each row of df.

    A byte goes if a run of `window` bytes that covers it also begins in a row with a smaller id; runs never cross texts, overlaps
    count, and all is judged on the input. A null text counts as an empty one. Rows of one id leave each other alone; a null id
    counts as larger than any other. Other columns are not read; an empty table gives an empty result.
    """
    dealt = _runs(df.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text_")), window)

    def out(docs: list[tuple], runs: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if x[0] == NO_ID else x[0] for x in docs], pa.int64()), pa.array([len(x[1]) for x in docs], pa.int64()), pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                pa.array([len(r) for r in runs], pa.int64()), pa.array([hashlib.sha256(without(x[1], r)).hexdigest() for x, r in zip(docs, runs, strict=True)], pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return dealt.mapInArrow(partial(_applied, out=out), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """df with its texts without what suffix_dedup() removes, in a column `text`, beside `id_col` and the columns others; null texts stay null.

    A cut inside a character takes the rest of it along, so that texts stay UTF-8."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    source = df.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text_"), *[F.col(c).alias(f"o{k}_") for k, c in enumerate(others)])
    dealt = _runs(source, window)

    def out(docs: list[tuple], runs: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        rows = pa.Table.from_batches([x[2][0].slice(x[2][1], 1) for x in docs])
        texts = [without(x[1], r).decode("utf-8", "ignore") for x, r in zip(docs, runs, strict=True)]
        null = rows.column("null_").to_pylist()
        columns = {"id_": rows.column("id_"), "text_": pa.chunked_array([pa.array([None if z else t for z, t in zip(null, texts, strict=True)], pa.string())])}
        for k in range(len(others)):
            columns[f"o{k}_"] = rows.column(f"o{k}_")
        return pa.table(columns).combine_chunks().to_batches()[0]

    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes)
    done = dealt.mapInArrow(partial(_applied, out=out), schema)
    back = {"id_": id_col, "text_": text_col} | {f"o{k}_": c for k, c in enumerate(others)}
    return done.select(*[F.col(a).alias(b) for a, b in back.items()]).select(*df.columns)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
