"""SentencePiece encoding and decoding by a Viterbi search shared between words.

A text is marked (a leading mark, and a mark for every blank) and cut into marked words, which no piece of the
vocabulary crosses. The segmentation of a word is the one with the highest sum of piece scores, ties to the
earlier start of the later piece. The distinct new words of a batch are sorted, which lays them out as a trie in
depth-first order: the forward scores of the prefix a word has in common with the one before are kept, and only
what follows is computed. Characters outside the vocabulary become byte pieces.

The scores are those of the vocabulary file. A file made for merges rather than for sums of scores is
segmented by its scores all the same, which need not be what its merges would give.

Defined cases: null and empty texts have no ids; a mark in the text itself is decoded as a blank; repeated rows and
null ids are texts of their own; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shingles import slices

MARK = "▁"
MEMORY = 400_000  # remembered words of a worker; a full memory is emptied, which costs time only
UNKNOWN = 10.0    # what a character outside the vocabulary scores below the lowest piece


class Pieces:
    """The vocabulary: scores and ids of pieces, byte pieces, and the bytes that each id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[float, int]] = {}
        self.byte_ids: dict[int, int] = {}
        self.bytes_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.scores[piece] = (model.get_score(i), i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        # Every ending of a piece, with the piece's score if it is one itself: a backward search ends where none is.
        self.endings: dict[str, float | None] = {piece[i:]: None for piece in self.scores for i in range(1, len(piece))}
        self.endings.update((piece, score) for piece, (score, _) in self.scores.items())
        self.unknown = min(score for score, _ in self.scores.values()) - UNKNOWN
        if any(MARK in piece.lstrip(MARK) for piece in self.scores):
            self.words = re.compile(".+", re.S)  # pieces cross words: a text is one word
        elif any("\n" in piece for piece in self.scores):
            self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            self.words = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def _memory(path: str) -> dict[str, bytes]:
    return {}


def segment(words: list[str], vocabulary: Pieces) -> dict[str, bytes]:
    """Ids (little-endian unsigned 32-bit) of each of the sorted ``words``."""
    scores, endings, unknown = vocabulary.scores, vocabulary.endings, vocabulary.unknown
    total, back = [0.0], [0]  # of each prefix: best score, where its last piece begins
    before, out, absent = "", {}, object()
    for word in words:
        same = 0
        for a, b in zip(before, word):
            if a != b:
                break
            same += 1
        del total[same + 1:], back[same + 1:]
        for end in range(same + 1, len(word) + 1):
            start = begin = end - 1
            best = total[start] + (unknown if word[start] not in scores else scores[word[start]][0])
            while begin:
                begin -= 1
                score = endings.get(word[begin:end], absent)
                if score is absent:
                    break
                if score is not None and total[begin] + score >= best:
                    best, start = total[begin] + score, begin
            total.append(best)
            back.append(start)
        ids: list[int] = []
        end = len(word)
        while end:
            piece = word[back[end]: end]
            found = scores.get(piece)
            ids.extend([found[1]] if found else [vocabulary.byte_ids[byte] for byte in reversed(piece.encode())])
            end = back[end]
        out[word] = np.array(ids[::-1], dtype="<u4").tobytes()
        before = word
    return out


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text; its distinct words go through the shared search once."""
    vocabulary, memory = pieces(path), _memory(path)
    cut = [vocabulary.words.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
    new = {word for words in cut for word in words if word not in memory}
    if len(memory) + len(new) > MEMORY:
        memory.clear()
        new = {word for words in cut for word in words}
    memory.update(segment(sorted(new), vocabulary))
    return [b"".join(map(memory.__getitem__, words)) for words in cut]


def decode(ids: bytes, path: str) -> str:
    """The text of the ids: bytes of the pieces without the leading blank."""
    table = pieces(path).bytes_of
    joined = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return joined.decode("utf-8", "replace").removeprefix(" ")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary) of every row of ``docs`` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 1 << 20):
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array(encode(rows["text"].to_pylist(), path), pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, ids binary")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, and whether the decoded ids are the text again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 1 << 20):
                texts = rows["text"].to_pylist()
                ids = encode(texts, path)
                same = [decode(x, path) == (text or "").replace(MARK, " ") for x, text in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids_crc32", "exact"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, n_tokens long, ids_crc32 long, exact boolean")
