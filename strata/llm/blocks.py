"""Token-id output in patched frame-of-reference blocks, written and read by Spark.

A document's ids are cut into blocks of ``BLOCK``. A block keeps its minimum, the width in bits that covers
``SHARE`` of its differences to the minimum, those bits plane by plane, and a list of exceptions: place and
upper bits of each wider difference. ``block_starts`` gives the byte at which each block of a document starts,
so any block is read alone.

Defined cases: a null or empty text has only the end id; rows with equal or null ``doc_id`` are documents of
their own, null first, in the order of their text; an empty table gives empty files. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.frames import small
from strata.llm.wordbpe import encoder, packed
from strata.session import fresh_path

BLOCK = 1024
SHARE = 0.95
_HEAD = struct.Struct("<IHBH")  # minimum, ids, width, exceptions
FILES = ("part int, first long, doc_id long, n_tokens long, block_starts array<int>, payload binary")


def pack(documents: list[np.ndarray]) -> list[tuple[list[int], bytes]]:
    """Block starts and bytes of each document's ids; the blocks of all documents are packed together."""
    counts = np.array([len(ids) for ids in documents], dtype=np.int64)
    per_doc = -(-counts // BLOCK)
    total = int(per_doc.sum())
    if not total:
        return [([], b"") for _ in documents]
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    sizes = np.full(total, BLOCK, dtype=np.int64)
    full = per_doc > 0
    sizes[(first + per_doc - 1)[full]] = (counts - (per_doc - 1) * BLOCK)[full]
    ids = np.concatenate(documents).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    low = np.minimum.reduceat(ids, begin)
    inside = np.arange(BLOCK) < sizes[:, None]
    grid = np.zeros((total, BLOCK), dtype=np.uint32)
    grid[inside] = ids - np.repeat(low, sizes)
    widths = np.full(total, 32, dtype=np.int64)
    needed = np.ceil(SHARE * sizes)
    pad = BLOCK - sizes
    for width in range(int(grid.max()).bit_length(), -1, -1):
        covered = (grid < (1 << width)).sum(axis=1) - pad if width < 32 else sizes
        widths[covered >= needed] = width
    out: list[bytes] = [b""] * total
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        part = grid[chosen]
        wide = part >> np.uint32(width) if width < 32 else np.zeros_like(part)
        kind = np.uint16 if width <= 16 else np.uint32
        bits = (part & np.uint32((1 << int(width)) - 1)).astype(kind)
        planes = [np.packbits((bits >> kind(b)).astype(np.uint8) & 1, axis=1) for b in range(int(width))]
        rows, places = np.nonzero(wide)
        cuts = np.searchsorted(rows, np.arange(len(chosen) + 1))
        highs = wide[rows, places]
        for k, block in enumerate(chosen):
            size = int(sizes[block])
            a, b = cuts[k], cuts[k + 1]
            out[block] = b"".join([
                _HEAD.pack(int(low[block]), size, int(width), int(b - a)),
                *(plane[k, : -(-size // 8)].tobytes() for plane in planes),
                places[a:b].astype("<u2").tobytes(), highs[a:b].astype("<u4").tobytes()])
    answer = []
    for start, n in zip(first, per_doc):
        parts = out[start: start + n]
        ends = np.cumsum([len(part) for part in parts])
        answer.append(([0, *map(int, ends[:-1])] if n else [], b"".join(parts)))
    return answer


def unpack_block(payload: bytes, at: int) -> np.ndarray:
    """The ids of the block that starts at byte ``at``."""
    low, size, width, patched = _HEAD.unpack_from(payload, at)
    at += _HEAD.size
    stride = -(-size // 8)
    planes = np.frombuffer(payload, np.uint8, width * stride, at).reshape(width, stride)
    at += width * stride
    bits = np.unpackbits(planes, axis=1, count=size) if width else np.zeros((0, size), np.uint8)
    kind = np.uint16 if width <= 16 else np.uint32
    values = np.zeros(size, dtype=kind)
    for b in range(width):
        values |= bits[b].astype(kind) << kind(b)
    values = values.astype(np.uint32)
    if patched:
        places = np.frombuffer(payload, "<u2", patched, at)
        highs = np.frombuffer(payload, "<u4", patched, at + 2 * patched)
        values[places] |= highs << np.uint32(width)
    return values + np.uint32(low)


def unpack(starts: list[int], payload: bytes) -> np.ndarray:
    """All ids of a document."""
    parts = [unpack_block(payload, at) for at in starts]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1) -> None:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into files of blocks under ``path``."""
    end = packed([end_id])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(vocabulary)
        part, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                documents = [np.frombuffer(to_ids(text) + end, "<u4") for text in rows["text"].to_pylist()]
                counts = [len(ids) for ids in documents]
                firsts = first + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                first += sum(counts)
                starts, payloads = zip(*pack(documents))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(counts), pa.int32()), pa.array(firsts, pa.int64()), rows["doc_id"],
                     pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                     pa.array(payloads, pa.binary())],
                    names=["part", "first", "doc_id", "n_tokens", "block_starts", "payload"])

    (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
     .sortWithinPartitions("doc_id", "text").mapInArrow(encode, FILES).write.parquet(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, block_starts, payload.

    ``start`` counts the ids of all documents before; only one total per file reaches the driver.
    """
    files = spark.read.schema(FILES).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, bases = 0, []
    for row in totals:
        bases.append(base)
        base += row["n"]
    offsets = small(spark, part=pa.array([row["part"] for row in totals], pa.int32()),
                    _base=pa.array(bases, pa.int64()))
    return files.join(offsets, "part").select(
        "doc_id", (F.col("_base") + F.col("first")).alias("start"), "n_tokens", "block_starts", "payload")


def checksums(ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the decoded ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums = [], []
            for starts, payload in zip(batch["block_starts"].to_pylist(), batch["payload"].to_pylist()):
                document = unpack(starts, payload)
                counts.append(len(document))
                sums.append(zlib.crc32(document.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return ids.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the ids of ``docs`` to fresh files and read them back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    write_ids(docs, vocabulary, path)
    return read_ids(spark, path)
