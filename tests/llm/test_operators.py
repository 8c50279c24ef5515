"""Each operator against a brute-force version, and on nulls, empty and repeated rows, ties, empty tables and clashing names."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import counts, dedup, imatch, mixing, pieces, quality, rangecoder, sharding, simhash, suffixes, tokens, toxicity
from tablewright.llm.common import components
from tablewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block_ int, fp long, shard int, size long, taken long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, equal rows, equal texts, equal ids, and columns with names that the code uses."""
    long = " ".join(f"word{k}" for k in range(9000))
    same = "one passage that is much longer than fifty bytes, so that it repeats in whole"
    rows = [(1, same), (2, same), (2, same), (3, f"before {same} after"), (None, same), (None, None), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, long), (9, "é" * 60), (9, "other text")]
    return spark.createDataFrame([(i, t, None, None if k % 3 else "s", None, 1, 2, 3, 4, 5) for k, (i, t) in enumerate(rows)], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def brute_removed(rows, window=50):
    seen, out = {}, []
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - window + 1):
            w = raw[k : k + window]
            key = float("inf") if i is None else i
            seen[w] = min(seen.get(w, key), key)
    for i, t in rows:
        raw = (t or "").encode()
        hit = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if seen[raw[k : k + window]] < (float("inf") if i is None else i):
                hit[k : k + window] = b"\1" * window
        spans = sum(1 for k in range(len(hit)) if hit[k] and not (k and hit[k - 1]))
        out.append((i, len(raw), sum(hit), spans, hashlib.sha256(bytes(b for b, h in zip(raw, hit, strict=True) if not h)).hexdigest()))
    return out


def test_suffix_sorter_against_sorting():
    rng = np.random.default_rng(5)
    for trial in range(300):
        t = rng.integers(1, rng.integers(2, 7), rng.integers(1, 70))
        t = np.tile(t[: max(1, len(t) // 4)], 4) if trial % 3 == 0 else t
        sorter = suffixes.Sorter(100, memory=64 if trial % 2 else 1 << 20, base=0 if trial % 4 > 1 else 1 << 20)
        order, lcp = sorter.order(t)
        tails = [tuple(t[k:]) for k in range(len(t))]
        want = sorted(range(len(t)), key=tails.__getitem__)
        assert order.tolist() == want
        assert lcp.tolist() == [0] + [len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(tails[a], tails[b], strict=False)))) for a, b in itertools.pairwise(want)]


def test_op1(spark, docs, odd):
    for df in (docs, odd):
        got = rows_of(dedup.suffix_dedup(df))
        assert sorted(got, key=str) == sorted(brute_removed([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]), key=str)
    back = {r["doc_id"]: r["text"] for r in dedup.drop_repeated(docs).collect()}
    want = {r[0]: r[4] for r in brute_removed([(r["doc_id"], r["text"]) for r in docs.collect()])}
    same = [hashlib.sha256(t.encode()).hexdigest() == want[i] for i, t in back.items()]
    assert sum(same) > 0.95 * len(same)  # others lost half a letter at a cut
    assert dedup.drop_repeated(odd).columns == odd.columns
    assert dedup.suffix_dedup(odd.limit(0)).count() == 0


@pytest.mark.parametrize("window", [32, 40, 50, 101])
def test_op1_sorts_pieces_that_may_share(window):
    """All pieces that share a window with one of another document are sorted, and of those that share an anchor alone none is."""
    rng = np.random.default_rng(window)
    part = [rng.integers(97, 101, 60).astype(np.uint8).tobytes() for _ in range(8)]
    raws = [b"".join(part[k] for k in rng.integers(0, 8, 5))[int(rng.integers(0, 60)) :] + rng.integers(97, 99, 40).astype(np.uint8).tobytes() for _ in range(60)]
    raws += [b"ab" * 90, b"x" + b"ab" * 80, b"z" * 200, b"z" * 300, b""]
    anchors, owner, first, windows, _ = dedup.anchored(raws, window)
    texts = [raws[d][f : f + n + window - 1] for d, f, n in zip(owner.tolist(), first.tolist(), windows.tolist(), strict=True)]
    order = np.argsort(anchors, kind="stable")
    docs = {}
    for k in order.tolist():
        for x in range(len(texts[k]) - window + 1):
            docs.setdefault((anchors[k], texts[k][x : x + window]), set()).add(int(owner[k]))
    want = [any(len(docs[anchors[k], texts[k][x : x + window]]) > 1 for x in range(len(texts[k]) - window + 1)) for k in order.tolist()]
    got = dedup._may_share([texts[k] for k in order], anchors[order], owner[order], window)
    assert any(want) and all(g for g, w in zip(got.tolist(), want, strict=True) if w)
    gram = b"the same sixteen"
    alone = [rng.integers(97, 123, 2 * window).astype(np.uint8).tobytes() for _ in range(20)]
    alone = [x[:window] + gram + x[window:] for x in alone]
    anchor = dedup._gram_hashes(np.frombuffer(gram, np.uint8))
    assert not dedup._may_share(alone, np.repeat(anchor, 20), np.arange(20), window).any()


def test_range_coder():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 49408, 300), np.zeros(0, int), np.full(400, 49407), np.arange(400) % 5, rng.integers(0, 3, 399)]
    coded = rangecoder.encode_blocks(blocks, 400, 49408)
    back = rangecoder.decode_blocks(coded, [len(b) for b in blocks], 49408)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    assert len(coded[3]) < 200 < len(coded[0])
    with pytest.raises(ValueError):
        rangecoder.encode_blocks([np.array([9])], 4, 8)
    alone = [rangecoder.encode_blocks([b], 400, 49408)[0] for b in blocks if len(b) == 400]
    assert alone == [c for b, c in zip(blocks, coded, strict=True) if len(b) == 400]  # each block starts anew


def test_range_coder_mixes_orders():
    """What any one order alone predicts badly costs little: runs, a repeated passage, and few ids in random order."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 40000, 64)
    bits = lambda ids: 8 * len(rangecoder.encode_blocks([ids], 4096, 49408)[0]) / len(ids)
    assert bits(np.tile(passage, 40)) < 1 and bits(np.full(2000, 31000)) < 0.3 and bits(rng.integers(0, 4, 2000)) < 3
    for vocabulary in (1, 2, 300, 200_000):
        blocks = [rng.integers(0, vocabulary, 500) for _ in range(3)] + [np.where(rng.random(500) < 0.01, vocabulary - 1, 0)]
        back = rangecoder.decode_blocks(rangecoder.encode_blocks(blocks, 500, vocabulary), [500] * 4, vocabulary)
        assert all((a == b).all() for a, b in zip(blocks, back, strict=True))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_op2(spark, which, request, tmp_path):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    folder = f"file://{tmp_path}/files"
    files = tokens.write_token_files(df, folder)
    got = rows_of(tokens.documents_of(files, folder))
    few = f"file://{tmp_path}/few"
    small = tokens.write_token_files(df, few, file_ids=3000)
    assert small.count() > files.count() and sorted(rows_of(tokens.documents_of(small, few)), key=str) == sorted(got, key=str)
    whole = Tokenizer.from_file(tokens.VOCABULARY_FILE)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")) for r in df.select("doc_id", "text").collect()) if which == "docs" else None
    if want is not None:
        start = 0
        for row, (i, ids) in zip(sorted(got), want, strict=True):
            assert row == (i, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    else:
        assert len(got) == df.count() and sum(r[0] is None for r in got) == 2
        assert sorted(r[1] for r in got) == [0, *itertools.accumulate(r[2] for r in sorted(got, key=lambda r: r[1]))][:-1]
    raw = bytearray(open(files.collect()[0]["file"], "rb").read())
    raw[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        list(tokens.read_tokens(bytes(raw)))
    assert tokens.write_token_files(df.limit(0), folder + "0").count() == 0


def test_op3(spark, docs, odd):
    for df in (docs, odd):
        got = rows_of(mixing.taken_words(df))
        assert sorted(got, key=str) == sorted(rows_of(mixing.taken_words(df)), key=str) and len(got) == df.count()
        assert all(0 <= taken <= 2 * size for _, size, _, _, taken in got)
    got = rows_of(mixing.taken_words(docs))
    by_source = {}
    for _, size, source_size, target, taken in got:
        by_source.setdefault((source_size, target), []).append(taken)
    for (source_size, target), taken in by_source.items():
        assert abs(sum(taken) - target) < 0.05 * target + 128
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))
    slots = np.array([700, 0, 41, 5])
    assert (sum(mixing.shard_counts(slots, s, 8, 100, 1)[1] for s in range(8)) == slots).all()
    assert mixing.taken_words(odd.limit(0)).count() == 0


def test_op4(spark, odd):
    bad, good = ["you total moronn", "such a m0ron here", "these morons again", "what a moron"], ["a quiet day", "some plain words", "more of the same", "the last one here"]
    raws = [f"{t} number{k}".encode() for k in range(12) for t in bad + good]
    model = toxicity.train(raws, np.array(([1] * 4 + [0] * 4) * 12))
    scores = model.scores([b"moronic", b"quiet words", b"", "日本".encode()])
    assert scores[0] > 0.5 > scores[1] and 0 <= scores.min() <= scores.max() <= 1
    rows = rows_of(toxicity.toxicity(odd, model))
    assert len(rows) == odd.count() and all(r[1] for r in rows if r[0] is None)
    fold = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(1, 10)}
    assert all(r[1] == fold[r[0]] for r in rows if r[0])
    none = toxicity.train([], np.zeros(0, int))
    assert none.scores([b"x"])[0] < 0.01


def test_op4_keeps_terms_of_all_toxic_texts():
    rng = np.random.default_rng(6)
    raws = [" ".join(f"w{x}" for x in rng.integers(0, 300, 30)) for _ in range(80)]
    raws = [f"{x} vileword" if k % 2 else x for k, x in enumerate(raws)]
    model = toxicity.train([x.encode() for x in raws], np.arange(80) % 2)
    a, b = model.scores([b"w1 w2 w3 vileword", b"w1 w2 w3"])
    assert a > b and model.logit[toxicity.subwords([b"vileword"], toxicity.Setup())[0]].max() > 0


def test_op4_held_out(spark):
    big = SF.replace("0.001", "0.1")
    found = QUERIES["op4_subword_toxicity"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    toxic, clean = found[found.toxic == 1], found[found.toxic == 0]
    assert toxic.predicted.mean() > 0.5 and clean.predicted.mean() < 0.02  # some 300 toxic rows to learn from at this size


def test_op5(spark, docs, odd):
    encode = counts.encoding(counts.RANK_FILE).encode_ordinary
    for df in (docs, odd):
        limits = counts.context_limits(counts.length_histogram(df), width=16)
        n = [len(encode(r["text"] or "")) for r in df.select("text").collect()]
        for r in limits.collect():
            x = r["n_tokens"]
            assert (r["n_docs"], r["docs_at_most"], r["docs_above"]) == (n.count(x), sum(k <= x for k in n), sum(k > x for k in n))
            assert r["truncated_total"] == sum(min(k, x) for k in n) and r["tokens_above"] == sum(k for k in n if k > x)
        for limit in (0, 1, 100, 10**6):
            assert counts.truncated_total(limits, limit) == sum(min(k, limit) for k in n)
        assert counts.quantile(limits, 0.5) == sorted(n)[-(-len(n) // 2) - 1]
    assert counts.context_limits(counts.length_histogram(odd.limit(0))).count() == 0


def test_op6(spark, docs, odd):
    for df in (docs, odd):
        rows = sharding.shard_rows(df, width=16).collect()
        assert len(rows) == df.count() and all(0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8) for r in rows)
        for s in range(8):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    text = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]])) for r in sharding.shard_rows(docs).collect())
    ids = spark.range(40000)
    a = sharding.tree_of(weights=[1, 1, 1, 1, 1, 1, 2, 0])
    b = sharding.tree_of(weights=[1, 1, 1, 1, 1, 1, 3, 0])
    got = sharding.assign(sharding.assign(ids, F.col("id"), a, "x"), F.col("id"), b, "y")
    share = dict(map(tuple, got.groupBy("x").count().collect()))
    assert 7 not in share and all(abs(share[s] - 40000 * w / 8) < 600 for s, w in enumerate([1, 1, 1, 1, 1, 1, 2]))
    moved = {(r[0] // 4, r[1] // 4) for r in got.filter("x <> y").select("x", "y").distinct().collect()}
    assert all(to == 1 for _, to in moved)  # only into the region whose weight grew
    assert sharding.shard_rows(odd.limit(0)).count() == 0


def brute_components(fps, ids, distance):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance:
            parent[root(a)] = root(b)
    least = {}
    for k in range(len(fps)):
        if ids[k] is not None:
            least[root(k)] = min(least.get(root(k), ids[k]), ids[k])
    return [least.get(root(k)) for k in range(len(fps))]


def test_op7(spark, docs, odd):
    for df in (docs, odd):
        rows = simhash.near_duplicates(df).collect()
        text = {}
        for r in df.select("doc_id", "text").collect():
            words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "").encode().split()
            grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
            h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
            text.setdefault(r["doc_id"], []).append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
        assert sorted(int(r["fingerprint"], 16) for r in rows) == sorted(x for v in text.values() for x in v)
        fps, ids = [int(r["fingerprint"], 16) for r in rows], [r["doc_id"] for r in rows]
        assert [r["component_id"] for r in rows] == brute_components(fps, ids, 4)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("ring", [simhash.Ring(), simhash.WIDE, simhash.Ring(3, 4, 2, 3)])
def test_links_miss_none(spark, ring):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(120):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 2 * ring.distance)).tolist():
                x ^= 1 << b
            values.add(x)
    fps = sorted(values)
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    roots = components(simhash.links(spark.createDataFrame(rows, "fp long"), ring, small=4))
    got = {r["node"] % (1 << 64): r["root"] for r in roots.collect()}
    same = brute_components(fps, list(range(len(fps))), ring.distance)
    groups = {}
    for x, s in zip(fps, same, strict=True):
        groups.setdefault(s, set()).add(got.get(x, ("alone", x)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_first_of_each(spark, odd):
    base = " ".join(f"w{k * k % 977}" for k in range(400))
    rows = [(3, base), (1, base.replace("w4 ", "x4 ")), (2, base), (9, " ".join(f"v{k * 7 % 991}" for k in range(400))), (2, base)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in simhash.first_of_each(df).collect()) == [1, 9]
    assert simhash.first_of_each(odd).columns == odd.columns and simhash.first_of_each(odd.limit(0)).count() == 0


def brute_first(texts, similarity=0.8):
    """Positions that are the first of their group, and the similarities of all pairs that share a shingle."""
    sets = [set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in texts]
    root, found = list(range(len(texts))), []
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both:
            found.append(both / len(sets[i] | sets[j]))
            if found[-1] >= similarity:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return sorted(set(root)), found


def edited_words(rng, words, n):
    words = list(words)
    for k in rng.choice(len(words), n, replace=False).tolist():
        words[k] = f"e{rng.integers(1 << 40)}"
    return words


def first_ids(spark, texts, **options):
    return sorted(r["doc_id"] for r in simhash.first_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect())


def test_first_of_each_in_large_buckets(spark):
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(edited_words(rng, base, n)) for n in [2] * 30]
    for _ in range(30):  # too far from the base and from each other, but each has a twin
        far = edited_words(rng, base, 12)
        texts += [" ".join(far), " ".join(edited_words(rng, far, 1))]
    texts = [texts[k] for k in rng.permutation(len(texts)).tolist()]
    want, _ = brute_first(texts)
    assert 20 < len(want) < 40
    assert first_ids(spark, texts) == want


def test_first_of_each_takes_ring_pairs_first(spark, monkeypatch):
    """What the ring connects comes from SimHashes, is told to the later steps, and what it leaves apart is still found."""
    rng = np.random.default_rng(12)
    texts = []
    for n in [0, 1, 1, 2, 8, 9] * 8:
        one = [f"w{x}" for x in rng.integers(0, 1 << 40, 400)]
        texts += [" ".join(one), " ".join(edited_words(rng, one, n) + ["w"] * (n == 0))]
    prints = [simhash.simhash(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    name = [int(np.array([xxhash.xxh64_intdigest(x.tobytes())], np.uint64).view(np.int64)[0]) for x in sets]
    near = {tuple(sorted((name[a], name[b]))) for a, b in itertools.combinations(range(len(texts)), 2) if (int(prints[a]) ^ int(prints[b])).bit_count() <= 4}
    seen, roots = [], []
    pairs, meet = simhash.ring_pairs, simhash.meetings

    def spy_pairs(*a):
        out = pairs(*a)
        seen.extend(tuple(x) for r in out.filter("data IS NOT NULL").collect() for x in np.frombuffer(r["data"], np.int64).reshape(-1, 2).tolist())
        return out

    def spy_meet(rep, *a):
        roots.extend((r["fp"], r["root"]) for r in rep.select("fp", "root").collect())
        return meet(rep, *a)

    monkeypatch.setattr(simhash, "ring_pairs", spy_pairs)
    monkeypatch.setattr(simhash, "meetings", spy_meet)
    want, _ = brute_first(texts)
    assert first_ids(spark, texts) == want and len(want) < 0.6 * len(texts)
    assert near and set(seen) == near
    root = dict(roots)
    assert all(root[a] == root[b] for a, b in near) and len(set(root.values())) > len(want)


def test_first_of_each_misses_none(spark):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(150):
        one = [f"w{x}" for x in rng.integers(0, 1 << 40, rng.integers(60, 300))]
        texts += [" ".join(one), " ".join(edited_words(rng, one, max(1, len(one) // rng.integers(45, 100))))]
    want, found = brute_first(texts)
    assert len(found) == 150 and len(want) < 180 and first_ids(spark, texts) == want


def test_first_of_each_compares_whole_texts(spark):
    rng = np.random.default_rng(10)
    texts = []
    for _ in range(60):  # 900 words: similarities close to the limit, on both sides
        one = [f"w{x}" for x in rng.integers(0, 1 << 40, 900)]
        texts += [" ".join(one), " ".join(edited_words(rng, one, int(rng.integers(19, 24))))]
    want, found = brute_first(texts)
    assert 70 < len(want) < 110 and sum(abs(x - 0.8) < 0.02 for x in found) > 20 and first_ids(spark, texts) == want


def test_op8(spark, docs, odd):
    model = pieces.PieceModel(pieces.MODEL_FILE)
    extra = ["", "  a  b\n\nc  ", "日本語 ½ İ ß 😀", "aaaaaaaaaa hhhhh 00000 ....", "\t\ttab\r\n"]
    texts = [r["text"] for r in docs.collect()] + extra
    coded = model.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in coded] == model.sp.encode(texts)
    assert [model.decode(x).decode() for x in coded] == texts
    rows = pieces.encode_pieces(odd, with_ids=True).collect()
    assert len(rows) == odd.count() and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)
    model.bpe = False  # the best path, as unigram models take it: also decodes to the text
    model.known.clear()
    assert [model.decode(x).decode() for x in model.encode(texts[:20] + extra)] == texts[:20] + extra


def test_op8_long_words():
    """Text without spaces: the library's ids, in memory that grows with the length."""
    import tracemalloc

    model = pieces.PieceModel(pieces.MODEL_FILE)
    rng = np.random.default_rng(3)
    letters = "".join(map(chr, rng.integers(33, 127, 300_000)))
    texts = [letters, letters[:20_000] + "x", "ab" * 30_000, "日本語" * 5000]
    tracemalloc.start()
    coded = model.encode(texts)
    assert tracemalloc.get_traced_memory()[1] < 600 << 20
    tracemalloc.stop()
    assert [np.frombuffer(x, "<u4").tolist() for x in coded] == model.sp.encode(texts)
    assert all(len(x) <= pieces.KEPT_LENGTH for x in model.known)


def test_op8_best_paths():
    """Unigram models: scores of the shared-prefix pass against all ways to cut a word."""
    rng = np.random.default_rng(7)
    model = pieces.PieceModel(pieces.MODEL_FILE)
    names = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(40)} | {"a", "b"})
    model.bpe, model.known = False, {}
    model.id_of, model.score = {x: k for k, x in enumerate(names)}, (-10 * rng.random(len(names)) - 0.1).tolist()
    model.coded = {x: np.array([k], "<u4").tobytes() for x, k in model.id_of.items()}
    model.longest, model.lowest = max(map(len, names)), min(model.score) - 10.0

    def best(word):
        if not word:
            return 0.0
        ends = [best(word[:-n]) + model.score[model.id_of[word[-n:]]] for n in range(1, len(word) + 1) if word[-n:] in model.id_of]
        return max([*ends, best(word[:-1]) + model.lowest])

    words = {"".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(300)}
    model.forward(words)
    spelt = {model.spelt(c): c for c in "abcd" if c not in model.id_of}
    for word in words:
        raw, text, total, at = model.known[word], "", 0.0, 0
        while at < len(raw):
            part = next((x for x in spelt if raw.startswith(x, at)), None)
            k = int(np.frombuffer(raw[at : at + 4], "<u4")[0])
            text, total, at = (text + spelt[part], total + model.lowest, at + len(part)) if part else (text + names[k], total + model.score[k], at + 4)
        assert text == word and total == pytest.approx(best(word))


def test_op9(spark, docs, odd):
    for df in (docs, odd):
        rows = imatch.edit_test(df).collect()
        assert len(rows) == df.count()
        order = sorted(((-(1 << 63) if r["doc_id"] is None else r["doc_id"], xxhash.xxh64_intdigest((r["text"] or "").encode()) >> 1, r["text"] or "") for r in df.select("doc_id", "text").collect()), reverse=True)
        want = []
        for k, (i, _, t) in enumerate(order):
            half = len(t) // 2
            want.append((None if i == -(1 << 63) else i, len(t), hashlib.sha256((t[: len(t) - half] + order[(k + 1) % len(order)][2][:half]).encode()).hexdigest()))
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == sorted(want, key=str)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    plain = {r["doc_id"]: r["fingerprint"] for r in imatch.imatch(docs).collect()}
    rows = imatch.edit_test(docs).collect()
    assert all(plain[r["doc_id"]] == r["fingerprint"] for r in rows)
    assert np.mean([r["near_edited"] for r in rows]) > 0.2 > 0.02 > np.mean([r["near_next"] for r in rows])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_text = {}
    for i, t in texts.items():
        by_text.setdefault(t, set()).add(plain[i])
    assert all(len(x) == 1 for x in by_text.values())
    assert imatch.edit_test(odd.limit(0)).count() == 0


def test_op9_short_texts():
    rng = np.random.default_rng(4)
    band = imatch.Band()
    terms = [f"t{k}" for k in range(4000)]
    lexicon = np.sort(np.array([xxhash.xxh64_intdigest(t.encode()) for t in terms], np.uint64))
    texts = [" ".join(rng.choice(terms, n, replace=False)).encode() for n in [*range(1, 20)] * 20]
    found = imatch.prints(texts, lexicon, band)
    assert all(any(x) for x in found)
    for (s, a), (t, b) in itertools.combinations(zip(texts, found, strict=True), 2):
        if not set(s.split()) & set(t.split()):
            assert imatch.likeness(a, b) == 0
    assert imatch.likeness(found[0], found[0]) == 1
    assert len(set(imatch.prints([b"", b" \n"], lexicon, band))) == 1 and any(imatch.prints([b""], lexicon, band)[0][2:])


def test_op9_fingerprints_by_brute_force(spark, docs):
    """Lexicon, levels and hashes from sets of words, and the likeness from them."""
    band = imatch.Band(idf=(1.0, 4.5), lexicons=8, levels=2, least_terms=3)
    rows = [(r["doc_id"], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]).encode()) for r in docs.collect()]
    df = {}
    for _, t in rows:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    least, most = band.frequencies(len(rows))
    lexicon = {w for w, n in df.items() if least <= n <= most}
    assert lexicon == {w for w, n in df.items() if 1.0 <= np.log(len(rows) / n) <= 4.5}

    def mixed(w):
        h = xxhash.xxh64_intdigest(w) ^ (7 * 0x9E3779B97F4A7C15 % 2**64)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ h >> shift) * factor % 2**64
        return h ^ h >> 33

    def fingerprint(t):
        words = set(t.split())
        some = words & lexicon
        every = len(some) < 3
        terms = sorted(mixed(w) for w in (words if every else some))
        level = next(x for x in range(64) if 2**x >= len(terms))
        out = {}
        while not out:
            for x in (level, level + 1):
                for k in range(min(8, 2**x)):
                    held = [h for h in terms if h >> 64 - x == k]
                    if held:
                        out[x, k] = xxhash.xxh32_intdigest(np.array(held, "<u8").tobytes(), 0)
            level -= 1
        return level + 1, every, out

    def told(raw):
        level, every = raw[0], bool(raw[1])
        words = np.frombuffer(raw, ">u4", offset=2).reshape(2, 8)
        return level, every, {(level + x, k): int(v) for (x, k), v in np.ndenumerate(words) if v}

    got = {r["doc_id"]: bytes.fromhex(r["fingerprint"]) for r in imatch.imatch(docs, band=band).collect()}
    want = {i: fingerprint(t) for i, t in rows}
    assert all(told(got[i]) == want[i] for i, _ in rows) and sum(w[1] for w in want.values()) > 0
    for (i, _), (j, _) in itertools.pairwise(rows):
        (x, e, p), (y, f, q) = want[i], want[j]
        both = {k for k in p.keys() | q.keys() if k[0] in {x, x + 1} & {y, y + 1}}
        assert imatch.likeness(got[i], got[j], 2) == (sum(p.get(k) == q.get(k) for k in both) / max(1, len(both)) if e == f else 0)
    few = imatch.lexicon_of(docs.select("text"), len(rows), imatch.Band(idf=(1.0, 4.5), most_terms=50))
    top = sorted(lexicon, key=df.get)[-50:]
    assert 0 < len(few) <= 50 and set(few.tolist()) <= {xxhash.xxh64_intdigest(w) for w in lexicon if df[w] >= df[top[0]]}


def test_op10(spark, docs, odd):
    def brute(t):
        words = [w for w in "".join(c if ord(c) > 127 or not c.isspace() and not "\x09" <= c <= "\x0d" else " " for c in t).split(" ") if w]
        lines = [x for x in t.split("\n") if any(not (c == " " or "\x09" <= c <= "\x0d") for c in x)]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)

    small = docs.filter("n_chars < 4000")
    text = {r["doc_id"]: r["text"] for r in small.collect()}
    for r in quality.quality_rules(small).collect():
        assert tuple(r)[1:6] == brute(text[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    rows = quality.quality_rules(odd).collect()
    assert len(rows) == odd.count() and all(r["base_failed"] for r in rows if r["n_words"] < 50)
    import zstandard

    noise = np.random.default_rng(0).bytes(6000).hex().encode()
    zstd, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    assert not quality.in_bands(b"again and " * 900, bands, zstd) and not quality.in_bands(np.random.default_rng(0).bytes(9000), bands, zstd)
    assert noise and quality.keep_good(odd).columns == odd.columns and quality.quality_rules(odd.limit(0)).count() == 0


def test_op10_judges_every_chunk(docs):
    import base64
    import zstandard

    zstd, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    good = [x for x in (r["text"].encode() for r in docs.collect()) if len(x) >= 5200 and quality.measures([x], bands)[0][-1]]
    assert good
    text = b" ".join(good)[:40960]
    noise = base64.b64encode(np.random.default_rng(1).bytes(40000))
    for junk in (noise, b"buy it now and again " * 2000):
        for at in (0, 16384):
            assert quality.in_bands(text, bands, zstd) and not quality.in_bands(text[:at] + junk[:12288] + text[at + 12288 :], bands, zstd)
    assert not quality.in_bands(good[0][:4096] + b"buy it now " * 200, bands, zstd)  # in the last chunk of two


def test_op10_bands_by_brute_force(docs):
    """The verdict from the limits as they are written, whatever the length."""
    import zstandard

    bands = quality.Bands(whole=((0, 0.0, 9.0), (300, 0.5, 0.8), (5000, 0.4, 0.6)), chunk=((0, 0.0, 9.0), (700, 0.45, 0.7)), chunk_bytes=1000, chunk_share=0.25)
    zstd, seen = zstandard.ZstdCompressor(level=3), set()

    def inside(raw, limits):
        low, high = max(x for x in limits if x[0] <= len(raw))[1:]
        return low <= len(zstandard.compress(raw, 3)) / len(raw) <= high

    texts = [r["text"].encode() for r in docs.collect()]
    for raw in [*texts, *(t[: len(t) // 2] + b"again and " * 60 for t in texts), b"x" * 299, b"x" * 300, b""]:
        parts = [raw[k : k + 1000] for k in range(0, len(raw), 1000)] if len(raw) >= 1000 else []
        want = not raw or inside(raw, bands.whole) and sum(not inside(x, bands.chunk) for x in parts) <= 0.25 * len(parts)
        assert quality.in_bands(raw, bands, zstd) == want
        seen.add((want, len(raw) >= 1000))
    assert len(seen) == 4


def test_op10_labels(spark):
    """Rows outside those that the limits were chosen on, at another size: clean ones stay, most repetitive long ones go."""
    big = SF.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{big}/documents.parquet").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter(toxicity.fold(F.col("doc_id")) == 1)
    found = quality.quality_rules(rows).filter("not base_failed").join(rows.select("doc_id", "quality", F.octet_length("text").alias("size")), "doc_id").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.98 and found[(found.quality == 0) & (found["size"] >= 3072)].kept.mean() < 0.2


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF).cache()
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    assert docs.filter("not round_trip").count() == 0 and docs.count() > 0
    few = odd.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        few = stage(spark, few, SF)
    assert few.count() >= 0
