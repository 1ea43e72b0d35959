"""Cuckoo filters of one shard each, as bytes: built and changed in Python tasks, looked up in Spark expressions.

A filter is a power of two of buckets with four 16-bit fingerprints; 0 is an empty place. A key's two longs give
its shard, its fingerprint and its first bucket; the second bucket follows from the first and the fingerprint, so
a fingerprint can be moved and taken out again without its key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 4
KICKS = 500
_SPREAD = 0x5BD1E995


def _fingerprint(g: int) -> int:
    return (g & 0xFFFF) or 1


def _buckets(g: int, size: int) -> tuple[int, int]:
    first = (g >> 16) & (size - 1)
    return first, first ^ ((_fingerprint(g) * _SPREAD >> 8) & (size - 1))


class Filter:
    """One shard: ``insert`` and ``delete`` keys given by their second long (unsigned or not)."""

    def __init__(self, data: bytes | None = None, keys: int = 0):
        if data is None:
            size = 2
            while size * SLOTS * 0.85 < keys:
                size *= 2
            self.table = np.zeros((size, SLOTS), dtype=">u2")
        else:
            self.table = np.frombuffer(data, dtype=">u2").reshape(-1, SLOTS).copy()

    def _put(self, bucket: int, print_: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = print_
        return bool(len(free))

    def insert(self, g: int) -> bool:
        """False if there was no place: the filter is then to be built anew, larger."""
        size, print_ = len(self.table), _fingerprint(g)
        first, second = _buckets(g, size)
        if self._put(first, print_) or self._put(second, print_):
            return True
        bucket = second
        for kick in range(KICKS):
            slot = (kick + print_) % SLOTS
            print_, self.table[bucket, slot] = int(self.table[bucket, slot]), print_
            bucket ^= (print_ * _SPREAD >> 8) & (size - 1)
            if self._put(bucket, print_):
                return True
        return False

    def delete(self, g: int) -> bool:
        for bucket in _buckets(g, len(self.table)):
            held = np.flatnonzero(self.table[bucket] == _fingerprint(g))
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False

    def __contains__(self, g: int) -> bool:
        return any((self.table[bucket] == _fingerprint(g)).any() for bucket in _buckets(g, len(self.table)))

    def data(self) -> bytes:
        return self.table.tobytes()


def build(keys: list[int]) -> Filter:
    """A filter with all the keys, doubled until they find a place."""
    room = len(keys)
    while True:
        made = Filter(keys=room)
        if all(made.insert(g) for g in keys):
            return made
        room = 2 * max(room, 4)


def may_hold(data: Column, g: Column) -> Column:
    """Whether a filter's bytes may hold the key: the same steps in Spark's long arithmetic."""
    size = F.octet_length(data) / (2 * SLOTS)
    mask = size.cast("long") - 1
    low = g.bitwiseAND(F.lit(0xFFFF))
    print_ = F.when(low == 0, F.lit(1).cast("long")).otherwise(low)
    first = F.shiftright(g, 16).bitwiseAND(mask)
    second = first.bitwiseXOR(F.shiftright(print_ * F.lit(_SPREAD), 8).bitwiseAND(mask))
    two = F.unhex(F.lpad(F.hex(print_), 4, "0"))

    def held(bucket: Column) -> Column:
        at = (bucket * (2 * SLOTS)).cast("int")
        return [F.substring(data, at + (2 * slot + 1), F.lit(2)) == two for slot in range(SLOTS)]

    answer = F.lit(False)
    for same in [*held(first), *held(second)]:
        answer = answer | same
    return answer
