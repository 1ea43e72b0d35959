"""Best-fit packing of tokenised documents into sequences by exact-complement hashing.

Only the histogram of piece lengths is planned, and its size is bounded by the sequence length. For each length,
longest first, the gap it leaves is looked up among single lengths, then pair sums, then triple sums of the
lengths still available; a combination is used as often as its scarcest length allows. What has no exact
complement is placed best-fit, longest first. The depth of the look-up that needs the fewest sequences counts. The plan says which ranks of each length go where; Spark ranks the
pieces by a range sort, so a third of all pieces may share one length.

Defined cases: null and empty texts have only the end id; repeated rows and null ids are documents of their own;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.frames import indexed
from strata.llm.wordbpe import encoder, packed
from strata.session import written

WORDS = 96 << 20  # bytes of each word memory; less than alone, as other stages of a pipeline share the worker
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Pattern = tuple[tuple[int, ...], int]  # lengths from the front of a sequence, number of such sequences


class _Sums:
    """Which lengths are available, and which pair and triple sums they form."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.refresh()

    def refresh(self) -> None:
        has = (self.left > 0).astype(np.float64)
        size = len(has)
        self.single = has > 0
        self.pair = np.rint(np.convolve(has, has)[:size]) > 0
        self.triple = np.rint(np.convolve(has, self.pair.astype(np.float64))[:size]) > 0

    def find(self, gap: int, parts: int) -> tuple[int, ...] | None:
        """Lengths that fill ``gap`` exactly with so many parts and are there that often, the largest first."""
        return next((found for found in self._fills(gap, parts) if _times(self.left, found)), None)

    def _fills(self, gap: int, parts: int) -> Iterator[tuple[int, ...]]:
        """All combinations, with the largest lengths first; how often a length is there is not looked at."""
        if parts == 1:
            if self.single[gap]:
                yield (gap,)
        elif (self.pair if parts == 2 else self.triple)[gap]:
            rest = self.single if parts == 2 else self.pair
            firsts = np.flatnonzero(self.single[:gap] & rest[gap:0:-1])
            for first in firsts[firsts * parts >= gap][::-1]:
                for tail in self._fills(gap - int(first), parts - 1):
                    if first >= tail[0]:
                        yield (int(first), *tail)


def _times(left: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often the combination can be taken from what is available."""
    kinds, needed = np.unique(lengths, return_counts=True)
    return int((left[kinds] // needed).min())


def plan(counts: dict[int, int], size: int) -> list[Pattern]:
    """Sequences for so many pieces of each length: exact complements first, then best fit.

    Complements of several parts use up short pieces, which are sometimes needed more for gaps that nothing
    fills exactly. So the plan is made with up to one, two and three parts for lengths over half a sequence, and
    with three for all lengths; the one with the fewest sequences counts.
    """
    plans = [_plan(counts, size, parts, least) for parts, least in ((3, 1), (3, size // 2 + 1), (2, size // 2 + 1), (1, size // 2 + 1))]
    return min(plans, key=lambda patterns: sum(times for _, times in patterns))


def _plan(counts: dict[int, int], size: int, most_parts: int, least: int) -> list[Pattern]:
    left = np.zeros(size + 1, dtype=np.int64)
    for length, count in counts.items():
        left[length] = count
    patterns: list[Pattern] = []

    def use(lengths: tuple[int, ...], times: int) -> bool:
        patterns.append((lengths, times))
        for length in lengths:
            left[length] -= times
        return bool((left[list(lengths)] == 0).any())

    if left[size]:
        use((size,), int(left[size]))
    sums = _Sums(left)
    for length in range(size - 1, least - 1, -1):
        gap, parts = size - length, 1
        while left[length] and parts <= most_parts:
            # The piece itself is no part of its own complement unless there are more of its length.
            left[length] -= 1
            sums.single[length] = left[length] > 0
            found = sums.find(gap, parts)
            left[length] += 1
            sums.single[length] = True
            times = _times(left, (length, *found)) if found else 0
            if times and use((length, *found), times):
                sums.refresh()
            elif not times:
                parts += 1
    return patterns + _best_fit(left, size)


def _best_fit(left: np.ndarray, size: int) -> list[Pattern]:
    """Each length goes to the smallest gap that holds it; equal sequences are kept as one with a count."""
    bins: dict[int, list[Pattern]] = {}
    open_gaps = np.zeros(size + 1, dtype=bool)

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = size - sum(lengths)
        bins.setdefault(gap, []).append((lengths, times))
        open_gaps[gap] = True

    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            fits = np.flatnonzero(open_gaps[length:])
            if not len(fits):
                each = size // length
                if count >= each:
                    put((length,) * each, count // each)
                if count % each:
                    put((length,) * (count % each), 1)
                break
            gap = length + int(fits[0])
            lengths, times = bins[gap].pop()
            open_gaps[gap] = bool(bins[gap])
            taken = min(times, count)
            if times > taken:
                put(lengths, times - taken)
            put((*lengths, length), taken)
            count -= taken
    return [pattern for group in bins.values() for pattern in group]


def _places(patterns: list[Pattern], counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By index in the order of lengths: where each run of pieces begins, its first sequence and its offset."""
    nth, total = {}, 0
    for length in sorted(counts):
        nth[length] = total
        total += counts[length]
    runs, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            runs.append((nth[length], sequence, offset))
            nth[length] += times
            offset += length
        sequence += times
    begin, first, offset = np.array(sorted(runs), dtype=np.int64).reshape(-1, 3).T
    return begin, first, offset


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int = 0) -> DataFrame:
    """Ids of each document with the end id, cut at ``size``; only documents longer than that are cut."""
    end = packed([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(vocabulary, WORDS)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = to_ids(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at: at + 4 * size]
                    rows.append((doc_id.as_py(), piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence and its offset there."""
    cut = written(pieces(docs, vocabulary, size, end_id), "pieces")
    counts = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}
    begin, first, offset = _places(plan(counts, size), counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch["index"].to_numpy()
            run = np.searchsorted(begin, index, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(first[run] + index - begin[run]), pa.array(offset[run])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = indexed(cut, ["length", "doc_id", "piece", "ids_crc32"], "ranked-pieces")
    return (ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "index")
            .mapInArrow(place, f"{PIECES}, sequence_id long, offset long"))
