"""SentencePiece encoding and decoding over a trie of marked words.

A text's spaces become marks; it is cut into marked words (a run of marks and what follows up to the next mark or line end),
across which no piece of the vocabulary reaches. The distinct words of many texts are sorted, which lays them out as a trie in
depth-first order, and a forward pass over each reuses the states of the prefix that it shares with the word before.

Unigram models: the state of a prefix is the best score and its last piece (Viterbi). BPE models: the best-scoring path isn't
what merging gives, so the state is the last piece of the prefix's merged form. That is the one piece ending there whose
neighbour on the left, the last piece of the prefix before it, stays apart from it when both are merged together; a sequence
is what merging gives if and only if all its neighbours are so. Both give the ids of the library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import documents, raw_texts, slices, vocabulary

MODEL_FILE = vocabulary("piece_bpe_32k.model")
MARK = "▁"
KEPT_WORDS, KEPT_LENGTH = 800_000, 200  # words whose ids are kept for later texts, and the longest of them


class PieceModel:
    """A sentencepiece model file: its pieces and scores are read through the library, as is its normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of = [b""] * n
        self.byte_ids: dict[int, int] = {}
        self.id_of: dict[str, int] = {}
        self.score: list[float] = [0.0] * n
        for k in range(n):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(piece[3:5], 16)])
            elif not sp.is_control(k) and not sp.is_unknown(k):
                self.id_of[piece] = k
                self.score[k] = sp.get_score(k)
                self.bytes_of[k] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.id_of))
        self.coded = {x: np.array([k], "<u4").tobytes() for x, k in self.id_of.items()}
        lengths: dict[str, set[int]] = {}
        for x in self.id_of:
            if len(x) > 1:
                lengths.setdefault(x[-2:], set()).add(len(x))
        self.tails = {x: sorted(v, reverse=True) for x, v in lengths.items()}  # lengths of the pieces that end so
        self.bpe = all(float(s).is_integer() for s in self.score)
        self.lowest = min(self.score) - 10.0
        if any(MARK in x.lstrip(MARK) or ("\n" in x and len(x) > 1) for x in self.id_of):
            raise ValueError("a piece reaches across marked words")
        self.known: dict[str, bytes] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        probe = "  x  y \n z \t①ﬁＡ½İ\u3000e\u0301\u00a0"  # what a normalisation of any kind would change
        self.identity = sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.words = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+").findall

    def normal(self, text: str) -> str:
        """As the library normalises; '' stays."""
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.identity else self.sp.normalize(text)

    def merged(self, text: str) -> list[str]:
        """Merge neighbours by score, the first of equals, as BPE does."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.id_of.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, a: str, b: str) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            found = self.apart[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def forward(self, words: Iterable[str]) -> None:
        """Learn the ids of words, in sorted order, sharing the states of common prefixes. A prefix's state is its last piece (and score);
        a word's ids are read off backwards from its end, so a word takes memory in proportion to its length."""
        known, coded, before = self.known, self.coded, ""
        last, score = [""], [0.0]
        step = self._merged_to if self.bpe else self._best_to
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            if word.startswith(before):
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            step(word, shared + 1, last, score)
            end, parts = len(word), []
            while end:
                piece = last[end]
                parts.append(coded.get(piece) or self.spelt(piece))
                end -= len(piece)
            parts.reverse()
            known[word] = b"".join(parts)
            before = word

    def _merged_to(self, word: str, first: int, last: list[str], _: list[float]) -> None:
        """Go on with the states of the prefixes from length `first`."""
        coded, tails, apart = self.coded, self.tails, self.apart
        for end in range(first, len(word) + 1):
            piece = word[end - 1]
            if end > 1:
                for n in tails.get(word[end - 2 : end], ()):
                    if n <= end and (some := word[end - n : end]) in coded:
                        pair = (last[end - n], some)
                        ok = apart.get(pair)
                        if ok if ok is not None else self.stay_apart(*pair):
                            piece = some
                            break
            last.append(piece)

    def _best_to(self, word: str, first: int, last: list[str], score: list[float]) -> None:
        for end in range(first, len(word) + 1):
            best, piece = score[end - 1] + self.lowest, word[end - 1]
            for n in range(1, min(end, self.longest) + 1):
                k = self.id_of.get(word[end - n : end])
                if k is not None and score[end - n] + self.score[k] > best:
                    best, piece = score[end - n] + self.score[k], word[end - n : end]
            last.append(piece)
            score.append(best)

    def spelt(self, char: str) -> bytes:
        """Ids of a character that is no piece."""
        return np.array([self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.sp.unk_id()], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32 bits each."""
        split = [self.words(self.normal(x)) for x in texts]
        distinct = set().union(*split)
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        self.forward([x for x in distinct if x not in self.known])
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for word in distinct:
            if len(word) > KEPT_LENGTH:
                del self.known[word]
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that ids stand for; the mark put before the first word is taken away."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:] if raw[:1] == b" " else raw


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL_FILE, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, n_ids, ids_crc32, n_bytes, round_trip), one for each row of df, and with_ids their ids.

    ids_crc32: unsigned, of the ids as little-endian unsigned 32-bit integers. The ids are decoded again: n_bytes is the decoded
    text's length in UTF-8, round_trip whether it is the text (false for a text that has the mark U+2581 itself, which decodes
    as a space). A null text counts as an empty one, without ids; null and repeated ids stay; other columns are not read; an empty
    table gives an empty result. Text without spaces is one word, of whatever length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in slices(batches, 1, 2 << 20):
            raws = raw_texts(batch.column(1))
            coded = model.encode([x.decode("utf-8", "replace") for x in raws])
            back = [model.decode(x) for x in coded]
            columns = [
                batch.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([zlib.crc32(x) for x in coded], pa.int64()),
                pa.array([len(x) for x in back], pa.int64()), pa.array([x == y for x, y in zip(raws, back, strict=True)], pa.bool_()),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in coded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_crc32", "n_bytes", "round_trip", "ids"][: len(columns)])

    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, n_bytes long, round_trip boolean" + ", ids array<int>" * with_ids)


def op8_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir))
