"""Near duplicates by SimHash, found with the pigeonring filter.

A fingerprint's 64 bits form a ring of segments. If two fingerprints differ in at most `distance` bits, then from some
segment on the differences of the first k segments of the chain stay within k * distance / segments for every k. The
index keys follow the chain: its first segment as it is, and of the next ones, cut into parts, as many equal parts as the
chain's budget must leave. Fingerprints that share a key are held against the chain's budgets, and what is left against
the full distance.

Equal fingerprints meet once. Where many fingerprints share a key, links are followed breadth first: each that is reached
leaves the ones to be compared, and only the links of the search tree go on, never all pairs.

For the first document of each group of near copies (see first_of_each) the same fingerprints and keys give the first
candidates, which whole sets of shingles confirm. A similarity of 0.8 can be too far for 64 bits, so sets that these links
leave apart are then held against each other by their leading shingles.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import components, documents, fmix, let_go, partitions, raw_texts, slices, written

BITS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(raw: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `width` words (A-Z in lower case, joined by a space); of all words if there are fewer."""
    words = raw.translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64, n - width + 1)


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(source: DataFrame, width: int = 4) -> DataFrame:
    """source (text last) with the column fp long, the SimHash of each whole text, for its text. Null and wordless texts have 0."""
    *others, text = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(others)):
            hashes = [shingle_hashes(x, width) for x in raw_texts(batch.column(len(others)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array([simhash(x) for x in hashes], np.uint64).view(np.int64))], [*others, "fp"])

    kinds = ", ".join(f"{c} {t}" for c, t in source.dtypes if c != text)
    return source.mapInArrow(run, f"{kinds}, fp long")


@dataclass(frozen=True)
class Ring:
    """distance < segments, so the first segment of a viable chain is equal. chain: segments that a key looks at.
    parts: pieces into which the chain's other segments are cut."""

    distance: int = 4
    segments: int = 5
    chain: int = 3
    parts: int = 4

    def __post_init__(self) -> None:
        if not 0 <= self.distance < self.segments or not 2 <= self.chain <= self.segments or self.parts <= self.budget(self.chain):
            raise ValueError("distance < segments, 2 <= chain <= segments, and more parts than the chain's budget")

    def budget(self, k: int) -> int:
        return k * self.distance // self.segments

    def bits_of(self, segment: int) -> list[int]:
        s = segment % self.segments
        return list(range(s * BITS // self.segments, (s + 1) * BITS // self.segments))

    def masks(self, start: int) -> list[int]:
        """Of the first 1, 2, ... segments of the chain."""
        bits = list(itertools.accumulate((self.bits_of(start + k) for k in range(self.chain)), lambda a, b: a + b))
        return [sum(1 << x for x in some) for some in bits]

    def key_masks(self) -> list[tuple[int, int]]:
        """(start, the bits that a key takes) for all keys of a fingerprint."""
        out = []
        for start in range(self.segments):
            rest = [x for k in range(1, self.chain) for x in self.bits_of(start + k)]
            pieces = [rest[p * len(rest) // self.parts : (p + 1) * len(rest) // self.parts] for p in range(self.parts)]
            for some in itertools.combinations(pieces, self.parts - self.budget(self.chain)):
                out.append((start, sum(1 << x for x in [*self.bits_of(start), *itertools.chain(*some)])))
        return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tree_links(values: np.ndarray, near: Callable[[np.uint64, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (from, to) that connect whatever `near` connects: a breadth-first forest over positions of values."""
    left = np.arange(len(values))
    out: list[tuple[int, int]] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = near(values[at], values[left])
            if hit.any():
                found = left[hit].tolist()
                left = left[~hit]
                out += [(at, x) for x in found]
                todo += found
    return out


def links(distinct: DataFrame, ring: Ring = Ring(), small: int = 16) -> DataFrame:
    """Rows (a, b) of different fingerprints at most ring.distance apart that connect all fingerprints which such links connect.

    distinct: a column fp of different numbers. Up to `small` fingerprints under a key give all their links.
    """
    masks = ring.key_masks()
    chains = [np.array(ring.masks(s), np.uint64) for s in range(ring.segments)]
    chain_masks = np.array([chains[start] for start, _ in masks], np.uint64)
    budgets = [ring.budget(k + 1) for k in range(ring.chain)]
    kinds = F.array(*[F.struct(F.lit(k).cast("short").alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, (_, m) in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(kinds).alias("key")).select("key.kind", "key.bits", "fp")

    def bucket(kind: int, values: np.ndarray) -> list[tuple[int, int]]:
        chain = chains[masks[kind][0]]

        def near(one: np.uint64, rest: np.ndarray) -> np.ndarray:
            x = rest ^ one
            ok = np.ones(len(rest), bool)
            for mask, most in zip(chain, budgets, strict=True):
                ok &= np.bitwise_count(x & mask) <= most
            at = np.flatnonzero(ok)
            ok[at] = np.bitwise_count(x[at]) <= ring.distance
            return ok

        return [(int(values[a]), int(values[b])) for a, b in tree_links(values, near)]

    def few(kind: np.ndarray, fp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Links in many small buckets at once: each member with the next, with the one after, ..."""
        out = []
        sizes = ends - starts
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        end = np.repeat(ends, sizes)
        for far in range(1, small):
            use = at + far < end
            at, end = at[use], end[use]
            if not len(at):
                break
            a, b = fp[at], fp[at + far]
            x = (a ^ b).view(np.uint64)
            ok = np.ones(len(x), bool)
            for level, most in enumerate(budgets):
                ok &= np.bitwise_count(x & chain_masks[kind[at], level]) <= most
            ok[ok] = np.bitwise_count(x[ok]) <= ring.distance
            out.append(np.stack((a[ok], b[ok]), 1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None  # a bucket may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                rows = rest
                if rows is None:
                    return
            else:
                rows = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                if rest is not None:
                    rows = tuple(np.concatenate(x) for x in zip(rest, rows, strict=True))
            kind, bits, fp = rows
            if not len(kind):
                continue
            cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (bits[1:] != bits[:-1])) + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(kind)]))
            if batch is not None:
                rest = tuple(x[starts[-1] :] for x in rows)
                starts, ends = starts[:-1], ends[:-1]
            sizes = ends - starts
            found = [x for k in np.flatnonzero(sizes > small) for x in bucket(int(kind[starts[k]]), fp[starts[k] : ends[k]].view(np.uint64))]
            some = (sizes > 1) & (sizes <= small)
            pairs = np.concatenate((np.array(found, np.uint64).view(np.int64).reshape(-1, 2), *few(kind, fp, starts[some], ends[some])))
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])

    n = partitions(distinct.sparkSession)
    return keyed.repartition(n, "kind", "bits").sortWithinPartitions("kind", "bits", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, ring: Ring = Ring()) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of df.

    component_id is the smallest id that links (fingerprints at most ring.distance bits apart) reach, itself included.
    Null, empty and wordless texts have fingerprint zero and link like others. A null id is never the smallest unless its
    component has no other id. Repeated rows stay. Other columns are not read. An empty table gives an empty result.
    """
    prints = written(fingerprints(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), width))
    roots = components(links(prints.select("fp").distinct(), ring))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = least.join(of_root, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: A wider ring than op7's.
WIDE = Ring(distance=7, segments=8, chain=3, parts=4)


@dataclass(frozen=True)
class Overlap:
    """Jaccard similarity of sets of shingle hashes of at least per_mille / 1000, in whole numbers."""

    per_mille: int

    def lead(self, n: int) -> int:
        """So many of the first elements, in one order for all sets, of a set of n meet those of every set that is similar."""
        return n - -(-self.per_mille * n // 1000) + 1 if n else 0

    def possible(self, n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Whether sets of n and m elements can be similar if the first that they share is at positions at and to."""
        return np.minimum(n - at, m - to) * (1000 + self.per_mille) >= self.per_mille * (n + m)

    def holds(self, one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Whether a sorted set of different hashes and each of some others are similar."""
        sizes, every, both = _shared(one, others)
        return 1000 * both >= self.per_mille * (len(one) + sizes - both)

    def open(self, one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Whether sets can be similar by their leading elements in order (the upper 32 bits of each), after the size of each set. Below
        the lesser last one, what is in one lead alone is in one set alone; two elements taken for one leave a pair open."""
        n, m = int(one[0]), np.array([int(x[0]) for x in others])
        one, others = one[1:], [x[1:] for x in others]
        sizes, every, both = _shared(one, others)
        starts = np.cumsum(sizes) - sizes
        until = np.minimum(every[starts + sizes - 1], one[-1])
        alone = np.searchsorted(one, until) - both
        other = np.add.reduceat((every < np.repeat(until, sizes)).astype(np.int64), starts) - both
        return np.minimum(n - alone, m - other) * (1000 + self.per_mille) >= self.per_mille * (n + m)


def _shared(one: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of others, all their elements, and how many of each one's are in a sorted set."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    return sizes, every, np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)


def common_shingles(texts: DataFrame, width: int, sample: int = 16000, least: int = 4, most: int = 400_000) -> np.ndarray:
    """Sorted hashes of shingles that many texts have, from some `sample` different texts. They only come last in the order
    of shingles, so what is in this set has a say in the speed, not in the result."""
    kept = texts.filter(F.pmod(F.xxhash64("tie_"), F.lit(max(1, texts.count() // sample))) == 0).dropDuplicates(["tie_"]).select("text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            for raw in raw_texts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(raw, width)).view(np.int64))], ["key"])

    rows = kept.mapInArrow(run, "key long").groupBy("key").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "key").limit(most).select("key").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def leading(texts: DataFrame, width: int, overlap: Overlap, common: np.ndarray) -> DataFrame:
    """Rows (id_, tie_, fp, n, sim, lead) of rows (id_, tie_, text_): a hash of the text's set of shingles, how many there are, the SimHash,
    and the first of them that a similar set must meet, in the order of their upper 63 bits, but common ones last (with the highest bit set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            hashes = [shingle_hashes(x, width) for x in raw_texts(batch.column(2))]
            sim = np.array([simhash(x) for x in hashes], np.uint64).view(np.int64)
            sets, lead = [np.unique(x) for x in hashes], []
            for x in sets:
                last = common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x if len(common) else np.zeros(len(x), bool)
                lead.append(np.sort(x >> np.uint64(1) | last.astype(np.uint64) << np.uint64(63))[: overlap.lead(len(x))].tobytes())
            fp = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), pa.array([len(x) for x in sets], pa.int32()), pa.array(sim), pa.array(lead, pa.binary())], ["id_", "tie_", "fp", "n", "sim", "lead"])

    return texts.mapInArrow(run, "id_ long, tie_ long, fp long, n int, sim long, lead binary")


def _buckets(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns, and where their runs of one key (the first column; rows are sorted by it) of `least` rows or more begin and end."""
    let_go()
    held: list[list[np.ndarray]] = []  # of the last key, which may go on in the next batch
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            held.append(new)
            if new[0][-1] == held[0][0][-1]:
                continue
        if not held:
            return
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        cuts = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows[0])]))
        held = []
        if batch is not None:
            held = [[x[starts[-1] :] for x in rows]]
            starts, ends = starts[:-1], ends[:-1]
        some = ends - starts >= least
        yield rows, starts[some], ends[some]


def _distinct(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(1)
    return pairs[new]


class _Candidates:
    """Pairs of sets to be compared, gathered in a task: each once, by the block of the second one."""

    def __init__(self, blocks: int) -> None:
        self.blocks, self.parts, self.size = blocks, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append(np.stack((a, b), 1))
        self.size += len(a)

    def rows(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """If there are `least` pairs: rows of _MET with the pairs of a block, and one for each set in them."""
        if self.size < least:
            return
        pairs = _distinct(np.sort(np.concatenate(self.parts), axis=1))
        self.__init__(self.blocks)  # type: ignore[misc]
        home = _block(pairs[:, 1], self.blocks)
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
        data = [pairs[order[x:y]].tobytes() for x, y in itertools.pairwise([*cuts.tolist(), len(order)])]
        yield _met(block=pa.array(home[order][cuts].astype(np.int32)), data=pa.array(data, pa.binary()))
        sets = np.unique(pairs)
        yield _met(block=pa.array(np.full(len(sets), -1, np.int32)), fp=pa.array(sets))


_MET = "block int, data binary, key long, fp long, n int, pos int"
_MET_SCHEMA = pa.schema([("block", pa.int32()), ("data", pa.binary()), ("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _met(**columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _MET_SCHEMA], schema=_MET_SCHEMA)


def _block(fp: np.ndarray, blocks: int) -> np.ndarray:
    return (fmix(fp.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _possible(rows: list[np.ndarray], at: np.ndarray, to: np.ndarray, overlap: Overlap) -> tuple[np.ndarray, np.ndarray]:
    """Of the sets in some places of a bucket's rows (key, fp, n, pos): pairs that can be similar."""
    _, fp, n, pos = rows[:4]
    ok = overlap.possible(n[at].astype(np.int64), pos[at], n[to].astype(np.int64), pos[to])
    return fp[at[ok]], fp[to[ok]]


def ring_pairs(rep: DataFrame, ring: Ring, blocks: int) -> DataFrame:
    """Of rows (fp, n, sim), rows of _MET with pairs of sets: of each SimHash the least set with each other one, and the least sets of
    SimHashes that links() joins. They connect all sets whose SimHashes differ in ring.distance bits or fewer."""
    some = rep.filter("n > 0").select("fp", "sim")
    least = written(some.groupBy("sim").agg(F.min("fp").alias("least")))
    near = links(least.select(F.col("sim").alias("fp")), ring).distinct()
    near = near.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select("x", "y")
    equal = some.join(least, "sim").filter("fp <> least").select("least", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Candidates(blocks)
        for batch in batches:
            found.add(*(batch.column(k).to_numpy() for k in range(2)))
            yield from found.rows(1 << 18)
        yield from found.rows()

    return near.union(equal).mapInArrow(run, _MET)


def meetings(rep: DataFrame, overlap: Overlap, blocks: int) -> DataFrame:
    """Of rows (fp, n, lead, root), rows of _MET. Block 0 or more: pairs of sets of different roots that can be similar (smaller and larger
    fp, 64 bits each): of each leading shingle that sets share, the first of them with each other one. Block -1: a set in such pairs.
    Block -2: a set (key, fp, n, pos) of those that share a shingle, three or more, whose other pairs are left to crossings()."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), 2, 1 << 20):
                lead = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
                counts = np.array([len(x) for x in lead])
                columns = [np.concatenate(lead), *(np.repeat(part.column(k).to_numpy(), counts) for k in (0, 1)), np.concatenate([np.arange(c, dtype=np.int32) for c in counts]), np.repeat(part.column(3).to_numpy(), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "fp", "n", "pos", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Candidates(blocks)
        for rows, starts, ends in _buckets(batches):
            size = ends - starts
            to = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            first = np.repeat(starts, size)
            other = rows[4][to] != rows[4][first]
            found.add(*_possible(rows, first[other], to[other], overlap))
            some = to[np.repeat(size, size) > 2]
            key, fp, n, pos = (pa.array(x[some]) for x in rows[:4])
            yield _met(block=pa.array(np.full(len(some), -2, np.int32)), key=key, fp=fp, n=n, pos=pos)
            yield from found.rows(1 << 18)
        yield from found.rows()

    keys = rep.select("fp", "n", "lead", "root").filter("n > 0").mapInArrow(spread, "key long, fp long, n int, pos int, root long")
    return keys.repartition(partitions(rep.sparkSession), "key").sortWithinPartitions("key", "fp").mapInArrow(run, _MET)


def crossings(members: DataFrame, overlap: Overlap, blocks: int, small: int = 16) -> DataFrame:
    """Of rows (key, fp, n, pos, root), rows of _MET with the pairs that share the key, can be similar and have different roots,
    without those that meetings() gave. `small` only says which buckets are worked on side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Candidates(blocks)
        for rows, starts, ends in _buckets(batches, 3):
            root = rows[4]
            edge = np.append(0, np.cumsum(root[1:] != root[:-1]))
            mixed = edge[starts] != edge[ends - 1]  # a bucket of one root has no pair to compare
            starts, ends = starts[mixed], ends[mixed]
            few = ends - starts <= small
            size = (ends - starts - 1)[few]
            at = np.repeat(starts[few] + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            end = np.repeat(ends[few], size)
            for far in range(1, small):
                use = at + far < end
                at, end = at[use], end[use]
                if not len(at):
                    break
                some = at[root[at] != root[at + far]]
                found.add(*_possible(rows, some, some + far, overlap))
            yield from found.rows(1 << 18)
            for a, b in zip(starts[~few].tolist(), ends[~few].tolist(), strict=True):
                for k in range(a + 1, b - 1):
                    to = k + 1 + np.flatnonzero(root[k + 1 : b] != root[k])
                    found.add(*_possible(rows, np.full(len(to), k), to, overlap))
                    yield from found.rows(1 << 18)
        yield from found.rows()

    n = partitions(members.sparkSession)
    return members.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(run, _MET)


def compared(met: DataFrame, sets: DataFrame, overlap: Overlap, blocks: int = 0) -> DataFrame:
    """Links (a, b) that connect what the similar pairs of met connect, by whole sets; sets: rows (fp, whole). With `blocks`, sets are
    leads after their sets' sizes, and what comes are rows of _MET with the pairs that are still open.

    A block's second sets are held, and each set that is to be compared with some of them comes along once. Of a block's
    links a forest goes on."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in itertools.groupby(_rows(batches, 2), key=lambda r: r[0]):
            pairs = _distinct(np.concatenate([np.frombuffer(r[1], np.int64).reshape(-1, 2) for r in rows]))
            cuts = [*range(0, len(pairs), 1 << 18), len(pairs)]
            yield _met(block=pa.array([block] * (len(cuts) - 1), pa.int32()), data=pa.array([pairs[x:y].tobytes() for x, y in itertools.pairwise(cuts)], pa.binary()))
            for kind in (0, 1):  # as n: 0 for sets that others are compared with, else 2
                asked = np.unique(pairs[:, 1 - kind])
                yield _met(block=pa.array(np.full(len(asked), block, np.int32)), fp=pa.array(asked), n=pa.array(np.full(len(asked), 2 * kind, np.int32)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_pairs = _Candidates(blocks)
        for _, rows in itertools.groupby(_rows(batches, 4), key=lambda r: r[0]):
            links: list[tuple[int, int]] = []
            up: dict[int, int] = {}  # towards the root of each set's tree
            for fp, one, others, names in probes(rows):
                if blocks:
                    near = names[overlap.open(one, others)]
                    open_pairs.add(np.full(len(near), fp), near)
                    continue
                for b in names[overlap.holds(one, others)].tolist():
                    x, y = root(up, fp), root(up, b)
                    if x != y:
                        up[x] = y
                        links.append((fp, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
            yield from open_pairs.rows(1 << 18)
        yield from open_pairs.rows()

    def probes(rows: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
        """Of a block's rows, sorted by kind: each set that comes along, and the held ones that it is to be compared with, with their names."""
        kind_of = np.uint32 if blocks else np.uint64
        own: dict[int, np.ndarray] = {}
        parts: list[np.ndarray] = []
        pairs = None
        for _, kind, fp, data in rows:
            if kind == 0:
                own[fp] = np.frombuffer(data, kind_of)
            elif kind == 1:
                parts.append(np.frombuffer(data, np.int64).reshape(-1, 2))
            else:
                if pairs is None:
                    pairs = np.concatenate(parts)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                names = pairs[np.searchsorted(pairs[:, 0], fp) : np.searchsorted(pairs[:, 0], fp, side="right"), 1]
                yield fp, np.frombuffer(data, kind_of), [own[b] for b in names.tolist()], names

    def root(up: dict[int, int], x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    n = partitions(met.sparkSession)
    asked = written(met.filter("data IS NOT NULL").select("block", "data").repartition(n, "block").sortWithinPartitions("block").mapInArrow(ask, _MET))
    told = asked.filter("data IS NOT NULL").select("block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("fp"), "data")
    come = asked.filter("fp IS NOT NULL").select("block", F.col("n").alias("kind"), "fp").join(sets, "fp").select("block", "kind", "fp", F.col("whole").alias("data"))
    rows = told.union(come)
    return written(rows.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(compare, _MET if blocks else "a long, b long"))


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Rows of columns of which the last is binary."""
    for batch in slices(batches, width - 1, 1 << 20):
        yield from zip(*(batch.column(k).to_pylist() for k in range(width)), strict=True)


#: Bytes of sets of shingles in a block.
BLOCK_BYTES = 32 << 20


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, ring: Ring = Ring()) -> DataFrame:
    """The rows of df, all columns, that are the first of their group of near copies: the one of the smallest id (null last, rows
    of one id by a hash of the text).

    Two texts are linked if the Jaccard similarity of their whole sets of shingles is `similarity` or more; groups are what links
    connect. Texts whose SimHashes the ring finds near come first: their whole sets are compared, and what is similar is one group.
    No link is missed: sets so similar share one of their leading shingles, in any order that is the same for all sets,
    and each pair that does and isn't yet connected is compared, set by set: first one of those that share a shingle with each
    other one, then all whose groups still differ. Equal sets are one group, and wordless texts. An empty table gives an empty one.
    """
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id_"), F.xxhash64(F.col(text_col).cast("string")).alias("tie_")]
    texts = df.select(*key, F.col(text_col).cast("string").alias("text_"))
    overlap = Overlap(round(1000 * similarity))
    prints = written(leading(texts, width, overlap, common_shingles(texts, width)))
    rep = written(prints.groupBy("fp").agg(F.min(F.struct("id_", "tie_", "n", "sim", "lead")).alias("m")).select("fp", "m.*"))
    blocks = 1 + 8 * (rep.agg(F.sum("n")).collect()[0][0] or 0) // BLOCK_BYTES

    def after_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sizes = batch.column(1).to_numpy().astype(np.uint32)
            upper = [(np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n.tobytes() + x for n, x in zip(sizes, upper, strict=True)], pa.binary())], ["fp", "whole"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(x, width)).tobytes() for x in raw_texts(batch.column(1))], pa.binary())], ["fp", "whole"])

    leads = rep.select("fp", "n", "lead").filter("n > 0").mapInArrow(after_size, "fp long, whole binary")

    def links_of(met: DataFrame) -> DataFrame:
        """By leads first, then by the whole sets of what is still open."""
        still = compared(met, leads, overlap, blocks)
        wanted = written(rep.select("fp", "id_", "tie_").join(still.filter("block = -1").select("fp").distinct(), "fp"))
        sets = written(texts.join(few(wanted), ["id_", "tie_"]).dropDuplicates(["id_", "tie_"]).select("fp", "text_").mapInArrow(whole, "fp long, whole binary"))
        return compared(still, sets, overlap)

    def with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    near = links_of(written(ring_pairs(rep, ring, blocks)))
    met = written(meetings(with_root(rep.select("fp", "n", "lead"), components(near)), overlap, blocks))
    near = near.union(links_of(met))
    roots = components(near)
    members = met.filter("block = -2").select("key", "fp", "n", "pos")
    rooted = with_root(members, roots).select("key", "fp", "n", "pos", "root")
    crossed = written(crossings(rooted, overlap, blocks))
    if not crossed.isEmpty():
        more = links_of(crossed)
        if not more.isEmpty():
            roots = components(near.union(more))
    rooted = with_root(rep.select("fp", "id_", "tie_"), roots)
    firsts = rooted.groupBy("root").agg(F.min(F.struct("id_", "tie_")).alias("first_"))
    every = prints.select("id_", "tie_", "fp").join(rooted.select("fp", "root"), "fp").join(firsts, "root")
    gone = written(every.filter(F.struct("id_", "tie_") != F.col("first_")).select("id_", "tie_").distinct())
    twice = written(prints.groupBy("id_", "tie_").count().filter("count > 1").select("id_", "tie_"))
    names = [f"c{k}_" for k in range(len(df.columns))]
    keyed = df.toDF(*names)
    keyed = keyed.withColumns({"id_": F.coalesce(F.col(names[df.columns.index(id_col)]).cast("long"), F.lit((1 << 63) - 1)), "tie_": F.xxhash64(F.col(names[df.columns.index(text_col)]).cast("string"))})
    left = keyed.join(few(gone), ["id_", "tie_"], "left_anti")
    if not twice.isEmpty():  # one of rows that are equal in both stays
        once = left.join(few(twice), ["id_", "tie_"], "left_semi").dropDuplicates(["id_", "tie_"])
        left = left.join(few(twice), ["id_", "tie_"], "left_anti").unionByName(once)
    return left.select(*names).toDF(*df.columns)


def few(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of keys, to be sent out where it has `most` rows or fewer (some 24 MB), else to be joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def hex16(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
