"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A text's hash is its place on the ring, so equal texts start at one place. The next virtual node clockwise names
the shard; what a full shard cannot take goes on clockwise. The law is on rows: with ``load`` 1 the capacities
add up to the number of rows, so counts are at most one apart; a larger load moves fewer rows.

The arcs between virtual nodes are bounded in number, so the driver settles counts only: each arc's rows, in
the order of the range sort, are dealt as runs. A third of all rows may share one place: they are ordered by id
and split over tasks and, where a shard is full, over shards.

Defined cases: a null text counts as empty; repeated rows and null ids are rows of their own; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.frames import indexed

NODES = 64  # virtual nodes of a shard


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Places of all virtual nodes in ring order, and the shard of each."""
    places = sorted(
        (int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big", signed=True), shard)
        for shard in range(shards) for node in range(nodes))
    at, owner = zip(*places)
    return np.array(at, dtype=np.int64), np.array(owner, dtype=np.int64)


def capacities(rows: int, shards: int, load: float) -> list[int]:
    """Rows that each shard may take: exact shares for load 1, else ``load`` times the mean, rounded up."""
    if load < 1:
        raise ValueError("load must be 1 or more")
    if load == 1:
        return [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return [int(np.ceil(load * rows / shards))] * shards


def settle(arcs: list[int], owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int]]:
    """Runs (first index, shard, rows) for so many rows in each arc; the last arc wraps to the first node.

    Each pass lets every node take what has reached it, as far as its shard has room, and hands the rest on.
    """
    room, nodes = list(room), len(owner)
    begins = np.concatenate([[0], np.cumsum(arcs)]).tolist()
    waiting: list[list[tuple[int, int]]] = [[(begins[i], arcs[i])] if arcs[i] else [] for i in range(nodes)]
    if arcs[nodes]:
        waiting[0].append((begins[nodes], arcs[nodes]))
    runs = []
    while any(waiting):
        passed: list[list[tuple[int, int]]] = [[] for _ in range(nodes)]
        for node, queue in enumerate(waiting):
            shard = int(owner[node])
            for first, rows in queue:
                taken = min(rows, room[shard])
                if taken:
                    runs.append((first, shard, taken))
                    room[shard] -= taken
                if rows > taken:
                    passed[(node + 1) % nodes].append((first + taken, rows - taken))
        waiting = passed
    return sorted(runs)


def shard(docs: DataFrame, shards: int, load: float = 1.0, nodes: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in its shard) of every row of ``docs``."""
    at, owner = ring(shards, nodes)
    text = F.coalesce("text", F.lit(""))
    placed = indexed(
        docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                    F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("place")),
        ["place", "doc_id"], "ring")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(at) + 1, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.searchsorted(at, batch["place"].to_numpy()), minlength=len(at) + 1)
        arcs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(arcs), pa.array(total[arcs])], names=["arc", "rows"])

    arcs = [0] * (len(at) + 1)
    for row in (placed.select("place").mapInArrow(count, "arc long, rows long")
                .groupBy("arc").agg(F.sum("rows").alias("rows")).collect()):
        arcs[row["arc"]] = row["rows"]
    runs = settle(arcs, owner, capacities(sum(arcs), shards, load))
    begin = np.array([run[0] for run in runs], dtype=np.int64)
    target = np.array([run[1] for run in runs], dtype=np.int32)
    taken, first = [0] * shards, np.zeros(len(runs), dtype=np.int64)
    for i, (_, to, rows) in enumerate(runs):
        first[i] = taken[to]
        taken[to] += rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch["index"].to_numpy()
            run = np.searchsorted(begin, index, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(target[run]), pa.array(first[run] + index - begin[run])],
                names=["doc_id", "size", "text_crc32", "shard", "slot"])

    return placed.select("doc_id", "size", "text_crc32", "index").mapInArrow(
        deal, "doc_id long, size long, text_crc32 long, shard int, slot long")
