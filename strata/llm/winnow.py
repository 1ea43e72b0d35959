"""Document fingerprints by winnowing: rolling hashes of k-grams, the minimum of every window, with positions.

A text's k-grams are all its runs of ``GRAM`` code points. Their hashes roll over the text by sums of powers. Of every
``WINDOW`` neighbouring grams the one with the smallest hash is kept, of equal ones the rightmost; its position is kept
with it. So two texts with a passage of ``GRAM + WINDOW - 1`` code points in common have an entry in common, wherever
the passage stands in either. The likeness of two fingerprints is the Jaccard similarity of their distinct hashes.

``neighbours`` compares every text with the next one and with an edited form of itself: its last quarter replaced by
the beginning of the next text. Texts move once: bounds cut all rows, in the order of id and text hash, into blocks of
equally many, and the first row of a block is also sent to the end of the block before (of the first block: the last).
A task reads its sorted block row by row and keeps one row, so neither a hot id nor the size of a block counts.

Defined cases: a null text counts as empty; an empty text has no entries, and two without entries are alike (1); a
text shorter than a gram is one gram, with fewer grams than a window they are one window; null ids come first, rows that
share an id follow in the order of their texts' hashes, each a document of its own; a single document is its own
next one; an empty table gives no rows. A text is hashed in pieces, so its length costs no memory. Other columns are
ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.frames import indexed
from strata.llm.shingles import mixed

GRAM = 32
WINDOW = 64
PIECE = 1 << 16      # grams hashed at a time; an entry's low 16 bits hold the place in the piece until it is chosen
BLOCKS = 16          # blocks for each shuffle partition
ENTRY = np.dtype([("hash", "6u1"), ("position", ">u4")])
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOW = _U(PIECE - 1)


def _powers(base: int) -> np.ndarray:
    factors = np.full(PIECE + GRAM, base, dtype=_U)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _rolled(codes: np.ndarray, gram: int) -> np.ndarray:
    """48-bit hash of every gram, in the high bits."""
    sums = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum((codes.astype(_U) + _U(1)) * _UP[: len(codes)], out=sums[1:])
    grams = len(codes) - gram + 1
    return mixed((sums[gram:] - sums[:grams]) * _DOWN[:grams]) & ~_LOW


def _minima(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every ``window`` neighbours, by windows of doubled length."""
    width = 1
    while width < window:
        step = min(width, window - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


def winnowed(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (48 bits) and positions of the chosen grams of a text, by position."""
    if not text:
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    gram = min(gram, len(text))
    total = len(text) - gram + 1
    window = min(window, total)
    hashes, places = [], []
    for begin in range(0, total - window + 1, PIECE - window + 1):
        grams = min(PIECE, total - begin)
        codes = np.frombuffer(text[begin: begin + grams + gram - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        # A later place makes the smaller number, so of equal hashes the rightmost is the minimum.
        least = _minima(_rolled(codes, gram) | (_LOW - np.arange(grams, dtype=_U)), window)
        new = np.ones(len(least), dtype=bool)
        new[1:] = least[1:] != least[:-1]
        least = least[new]
        hashes.append(least >> _U(16))
        places.append(begin + (_LOW - (least & _LOW)).astype(np.int64))
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    new = np.ones(len(places), dtype=bool)  # a piece may begin with the last choice of the one before
    new[1:] = places[1:] != places[:-1]
    return hashes[new], places[new]


def packed(hashes: np.ndarray, places: np.ndarray) -> bytes:
    """The entries as bytes: six of the hash, four of the position, most significant first."""
    entries = np.zeros(len(hashes), dtype=ENTRY)
    entries["hash"] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    entries["position"] = places
    return entries.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    entries = np.frombuffer(data, dtype=ENTRY)
    wide = np.zeros((len(entries), 8), dtype=np.uint8)
    wide[:, 2:] = entries["hash"]
    return wide.view(">u8").reshape(-1).astype(_U), entries["position"].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the distinct hashes; 1 if both have none."""
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - common
    return common / every if every else 1.0


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter, rounded down, replaced by as many first code points of ``after``."""
    share = len(text) // 4
    return text[: len(text) - share] + after[:share]


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars and ``entries`` (bytes, see ``unpacked``) of every row of ``docs`` (doc_id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (text.as_py() for text in batch["text"])
            sizes, entries = zip(*((len(text), packed(*winnowed(text, gram, window))) for text in texts))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(entries, pa.binary())],
                names=["doc_id", "n_chars", "entries"])

    return docs.select(F.col("doc_id").cast("long"), _text().alias("text")).mapInArrow(
        made, "doc_id long, n_chars long, entries binary")


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _bounds(rows: DataFrame, blocks: int) -> list[tuple]:
    """(id, hash) of the first row of each block; at most ``blocks`` of them."""
    order = indexed(rows.select("doc_id", "hash"), ["doc_id", "hash"], "text-order")
    count = order.agg(F.max("index")).first()[0]
    if count is None:
        return []
    step = -(-(count + 1) // blocks)
    return sorted({_key(*row) for row in order.where(F.col("index") % step == 0).select("doc_id", "hash").collect()})


def _key(doc_id: int | None, text_hash: int) -> tuple:
    return doc_id is not None, doc_id or 0, text_hash


def _placed(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """``rows`` with their block; the first row of each block also ends the block before (``ends`` 1)."""
    first, last = {bound: place for place, bound in enumerate(bounds)}, max(0, len(bounds) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(*key) for key in zip(batch["doc_id"].to_pylist(), batch["hash"].to_pylist())]
            block = [bisect.bisect_right(bounds, key) - 1 for key in keys]
            twice = [at for at, key in enumerate(keys) if key in first]
            for take, to, ends in ((list(range(len(keys))), block, 0),
                                   (twice, [block[at] - 1 if block[at] else last for at in twice], 1)):
                if take:
                    part = batch if not ends else batch.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to, pa.int32()), pa.array([ends] * len(take), pa.int32()), *part.columns],
                        names=["block", "ends", *part.schema.names])

    return rows.mapInArrow(place, "block int, ends int, doc_id long, hash long, text string")


def neighbours(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, blocks: int | None = None) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_chars, ``edited`` (text), ``entries`` and
    ``edited_entries`` (bytes), ``near_edited`` and ``near_next`` (likeness to its edited text and to the next one)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(_text()).alias("hash"), _text().alias("text"))
    bounds = _bounds(rows, blocks or BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = ["doc_id", "n_chars", "edited", "entries", "edited_entries", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out, size = None, [], 0  # before: block, id, text and fingerprint of the row that waits for its next
        for batch in batches:
            for at in range(batch.num_rows):
                block, ends, doc_id, text = (batch[name][at].as_py() for name in ("block", "ends", "doc_id", "text"))
                if before is None and ends:
                    continue  # a repeated row may end a block twice
                print_ = winnowed(text, gram, window)
                if before is not None:
                    _, this_id, this, own = before
                    changed = edited(this, text)
                    other = winnowed(changed, gram, window)
                    out.append((this_id, len(this), changed, packed(*own), packed(*other),
                                likeness(own[0], other[0]), likeness(own[0], print_[0])))
                    size += len(changed) + len(out[-1][3]) + len(out[-1][4])
                before = None if ends else (block, doc_id, text, print_)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    ordered = _placed(rows, bounds).repartition("block").sortWithinPartitions("block", "ends", "doc_id", "hash")
    return ordered.mapInArrow(compared, "doc_id long, n_chars long, edited string, entries binary, edited_entries binary, "
                                        "near_edited double, near_next double")
