"""Token ids of documents as binary files.

A file holds the ids of a range of documents in ascending order of id: blocks of equal length from the range coder, each with
its number of ids, length and crc32, decodable on its own; then a table of the documents (id, ids) with its own crc32; then
where that table begins. A range of over FILE_IDS ids goes to several files, so that no file outgrows a task's memory. Files are
written by the executors to the shared folder under a name of the attempt's own and only then moved to the name of their range
and number, so that a repeated task leaves one file.
"""

from __future__ import annotations

import itertools
import json
import os.path
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import documents, new_folder, partitions, slices, vocabulary
from tablewright.llm.rangecoder import decode_blocks, encode_blocks

VOCABULARY_FILE = vocabulary("word_bpe_49k.json")
END_ID = 2
MAGIC = b"TWTOKEN1"
BLOCK_IDS = 4096
LANES = 2048  # blocks that are coded side by side
FILE_IDS = 16 << 20  # a document that passes it is the last of its file
_HEAD = struct.Struct("<8sIIQ")  # magic, vocabulary, ids of a block, -
_BLOCK = struct.Struct("<III")  # ids, bytes, crc32 of the ids
_TAIL = struct.Struct("<QII8s")  # where the table begins, documents, crc32 of the table, magic
KEPT_PIECES = 600_000
SLICE = 8 << 20  # bytes of text whose different pieces are looked up together


#: How the vocabulary's tokenizer cuts words (fixed value): what is a piece, after the endings that go alone.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
PIECES = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(kind: str, codes: list[int]) -> str:
    """The characters of a category, as ranges of a character class."""
    some = [c for c in codes if unicodedata.category(chr(c))[0] == kind]
    first = [c for c in some if c - 1 not in some]
    last = [c for c in some if c + 1 not in some]
    return "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in zip(first, last, strict=True))


class WordEncoder:
    """Ids of texts from those of their different pieces.

    The tokenizer lower-cases, drops white space and cuts words into pieces (a run of letters, a digit, a run of other signs),
    each of which its model encodes alone. Texts of ASCII and Latin letters are cut here, column-wise: digits, signs and endings
    get spaces around them, and what lies between spaces is a piece. The different pieces of many texts are looked up, and new
    ones go to the model. Any other text, and one with the special tokens, goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = os.path.commonprefix([t["content"] for t in told["added_tokens"]])
        kinds = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
        pre = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.table = _byte_letters()
        vocabulary, suffix = self.tokenizer.get_vocab(with_added_tokens=False), told["model"].get("end_of_word_suffix")
        self.plain = (
            kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"].get("Regex") == f"{ENDINGS}|{PIECES}"
            and suffix is not None and all(x + suffix in vocabulary for x in self.table)
        )
        if self.plain:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
            self.last[[k for x, k in vocabulary.items() if x.endswith(suffix)]] = True
            # visible characters up to U+024F, but for the soft hyphen and the two whose lower case is not one letter
            codes = [*range(0x21, 0x7F), *(c for c in range(0xA1, 0x250) if c not in (0xAD, 0x130))]
            letters, digits = _class("L", codes), _class("N", codes)
            self.simple = r"^[\x09-\x0D\x20-\x7E\x{A1}-\x{AC}\x{AE}-\x{12F}\x{131}-\x{24F}]*$"
            self.cuts = rf"({ENDINGS}|[{digits}]|[^\x09-\x0D\x20{letters}{digits}]+)"
        self.pieces: dict[str, bytes] = {"": b""}

    def of_pieces(self, names: list[str]) -> list[bytes]:
        """The ids of different pieces. New ones go to the model in runs of some hundred, cut after each id that ends a piece. Where
        too many are kept, those that came first stay: the frequent ones are among them."""
        if len(self.pieces) > KEPT_PIECES:
            self.pieces = dict(itertools.islice(self.pieces.items(), KEPT_PIECES // 2))
        out = list(map(self.pieces.get, names))
        new = [k for k, x in enumerate(out) if x is None]
        letters = [x if x.isascii() else "".join(map(self.table.__getitem__, x.encode())) for x in (names[k] for k in new)]
        runs = [" ".join(letters[k : k + 256]) for k in range(0, len(letters), 256)]
        if runs:
            ids = np.concatenate([np.array(x.ids, "<u4") for x in self.model.encode_batch_fast(runs, add_special_tokens=False)])
            edges = [0, *(4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            for k, (a, b) in zip(new, itertools.pairwise(edges), strict=True):
                out[k] = self.pieces[names[k]] = raw[a:b]
        return out  # type: ignore[return-value]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: none), as little-endian 32 bits each."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        simple = pc.match_substring_regex(texts, self.simple) if self.plain else pa.array(np.zeros(len(texts), bool))
        if self.special:
            simple = pc.and_not(simple, pc.match_substring(texts, self.special))
        out = [b""] * len(texts)
        for k in np.flatnonzero(~simple.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        where = np.flatnonzero(simple.to_numpy(zero_copy_only=False)).tolist()
        if where:
            spaced = pc.replace_substring_regex(pc.utf8_lower(texts.filter(simple)), self.cuts, r" \1 ")
            cut = pc.ascii_split_whitespace(spaced)
            offsets, coded = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
            del spaced, cut
            found = self.of_pieces(coded.dictionary.to_pylist()) if len(coded) else []
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            ids, starts, which = np.frombuffer(b"".join(found), "<u4"), (np.cumsum(sizes) - sizes).astype(np.int32), coded.indices.to_numpy()
            size = sizes[which]
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
            at = np.repeat(starts[which] - ends[:-1].astype(np.int32), size)
            at += np.arange(len(at), dtype=np.int32)
            ids = ids[at]
            for k, (a, b) in zip(where, itertools.pairwise(ends[offsets].tolist()), strict=True):
                out[k] = ids[a:b].tobytes()
        return out


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: its own for visible Latin-1, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class TokenWriter:
    """Writes one file: documents one after the other, then close()."""

    def __init__(self, out, vocabulary: int, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.vocabulary, self.block_ids = out, vocabulary, block_ids
        self.at = out.write(_HEAD.pack(MAGIC, vocabulary, block_ids, 0)) and _HEAD.size
        self.waiting: list[bytes] = []
        self.size = self.total = 0
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.waiting.append(ids)
        self.size += len(ids) // 4
        self.total += len(ids) // 4
        if self.size >= LANES * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        blocks = [ids[k : min(k + self.block_ids, whole)] for k in range(0, whole, self.block_ids)]
        for k in range(0, len(blocks), LANES):
            some = blocks[k : k + LANES]
            for block, payload in zip(some, encode_blocks(some, self.block_ids, self.vocabulary), strict=True):
                self.out.write(_BLOCK.pack(len(block), len(payload), zlib.crc32(block.tobytes())))
                self.out.write(payload)
                self.at += _BLOCK.size + len(payload)
        self.waiting = [ids[whole:].tobytes()]
        self.size = len(ids) - whole

    def close(self) -> tuple[int, int]:
        """Documents and ids of the file."""
        self._flush(True)
        null = np.array([x is None for x, _ in self.docs], np.uint8)
        ids = np.array([x or 0 for x, _ in self.docs], "<i8")
        counts = np.array([n for _, n in self.docs], "<u4")
        table = zlib.compress(null.tobytes() + ids.tobytes() + counts.tobytes(), 1)
        self.out.write(table)
        self.out.write(_TAIL.pack(self.at, len(self.docs), zlib.crc32(table), MAGIC))
        return len(self.docs), int(counts.sum())


def read_tokens(raw: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file; an error if a checksum differs."""
    magic, vocabulary, _, _ = _HEAD.unpack_from(raw)
    table_at, n, crc, tail = _TAIL.unpack_from(raw, len(raw) - _TAIL.size)
    table = raw[table_at : len(raw) - _TAIL.size]
    if magic != MAGIC or tail != MAGIC or zlib.crc32(table) != crc:
        raise ValueError("no token file, or a damaged one")
    table = zlib.decompress(table)
    null = np.frombuffer(table, np.uint8, n)
    doc_ids = np.frombuffer(table, "<i8", n, n)
    counts = np.frombuffer(table, "<u4", n, 9 * n)

    def parts() -> Iterator[np.ndarray]:
        at = _HEAD.size
        while at < table_at:
            payloads, sizes, sums = [], [], []
            while at < table_at and len(payloads) < LANES:
                size, length, check = _BLOCK.unpack_from(raw, at)
                at += _BLOCK.size
                payloads.append(raw[at : at + length])
                sizes.append(size)
                sums.append(check)
                at += length
            for ids, check in zip(decode_blocks(payloads, sizes, vocabulary), sums, strict=True):
                if zlib.crc32(ids.astype("<u4").tobytes()) != check:
                    raise ValueError("a block's ids differ from what was written")
                yield ids

    stream, held = parts(), np.zeros(0, np.uint32)
    for k in range(n):
        some = [held]
        have = len(held)
        while have < counts[k]:
            some.append(next(stream))
            have += len(some[-1])
        held = np.concatenate(some) if len(some) > 1 else held
        yield (None if null[k] else int(doc_ids[k])), held[: counts[k]]
        held = held[counts[k] :]


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a folder as Spark names it."""
    scheme, _, rest = folder.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else folder)


_FILES = "file string, part int, number int, n_docs long, n_tokens long"


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY_FILE, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all whole texts, each followed by end_id, to files in a new folder in ascending order of id (null first,
    rows of one id by a hash of the text). A null text has the end id only. Other columns are not read. Rows (file, part, number,
    n_docs, n_tokens), one for each file, in order of part and number; an empty table gives none.
    """
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = file_system(folder)
        end = np.array([end_id], "<u4").tobytes()
        words = encoder(path)
        writer, out, own, number = None, None, "", 0

        def closed() -> pa.RecordBatch:
            n_docs, n_tokens = writer.close()
            out.close()
            name = f"{root}/part-{part:06d}-{number:06d}.tok"
            fs.move(own, name)
            return pa.RecordBatch.from_pylist([{"file": name, "part": part, "number": number, "n_docs": n_docs, "n_tokens": n_tokens}], _FILE_SCHEMA)

        for batch in slices(batches, 1, SLICE):
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    own = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(own)
                    writer = TokenWriter(out, max(words.size, end_id + 1))
                writer.add(doc_id, ids + end)
                if writer.total >= file_ids:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    n = partitions(spark)
    dealt = source.withColumn("tie_", tie).repartitionByRange(n, "doc_id", "tie_").sortWithinPartitions("doc_id", "tie_")
    rows = dealt.select("doc_id", "text").mapInArrow(run, _FILES).collect()  # one row for each file
    rows.sort(key=lambda r: (r["part"], r["number"]))
    return spark.createDataFrame(rows, _FILES).coalesce(1) if rows else spark.createDataFrame([], _FILES)


_FILE_SCHEMA = pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def documents_of(files: DataFrame, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of the documents in the files, from the files alone; an error if one is damaged."""
    spark = files.sparkSession
    told = files.orderBy("part", "number").collect()
    before, total = {}, 0
    for r in told:
        before[r["file"]], total = total, total + r["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(name) as f:
                    raw = f.read()
                found, at = [], start
                for doc_id, ids in read_tokens(raw):
                    found.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not told:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = [(r["file"], before[r["file"]]) for r in told]
    listed = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "file string, start long")
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_range_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """write_token_files() over all documents, and documents_of() the files: nulls, empty texts and tables as told there."""
    folder = new_folder(spark, "tokens")
    if "://" not in folder:
        folder = folder.replace("file:", "file://") if folder.startswith("file:") else f"file://{folder}"
    return documents_of(write_token_files(documents(spark, sf_dir), folder), folder)
