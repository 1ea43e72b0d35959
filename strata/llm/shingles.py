"""Word and shingle hashes of whole batches of texts, as array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
PIECE = 1 << 20   # bytes of text, and shingles, that are taken at a time
LONG = 4096       # words of more bytes are hashed one by one


def mixed(values: np.ndarray) -> np.ndarray:
    """The values with all bits stirred; a bijection of 64-bit numbers."""
    values = values ^ (values >> _U(30))
    values = values * _U(0xBF58476D1CE4E5B9)
    values = values ^ (values >> _U(27))
    values = values * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


def _powers(size: int) -> np.ndarray:
    factors = np.full(size, _BASE, dtype=_U)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_POWERS = _powers(LONG)  # of a byte's place in its word


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 places where texts begin; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    begin = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[begin[0]: begin[-1]], begin - begin[0]


def _cut(data: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int]]:
    """The bytes in pieces of about ``PIECE``, cut where a text begins or at a blank."""
    at = 0
    while at < len(data):
        to = at + PIECE
        while to < len(data):
            if _BLANK[data[to]] or begin[np.searchsorted(begin, to)] == to:
                break
            following = int(begin[np.searchsorted(begin, to)])
            blanks = np.flatnonzero(_BLANK[data[to: min(following, to + PIECE)]])
            to = to + int(blanks[0]) if len(blanks) else min(following, to + PIECE)
        to = min(to, len(data))
        yield at, to
        at = to


def _hashed(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the bytes, and where it begins; a text begins at each of ``begin``."""
    inside = ~_BLANK[data]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    new[begin] = inside[begin]
    at = np.flatnonzero(new)
    if not len(at):
        return np.zeros(0, dtype=_U), at
    # Only the bytes of words: where each word begins among them, and each byte's place in its word.
    first = np.cumsum(inside)[at] - 1
    bytes_ = _LOWER[data[inside]]
    sizes = np.diff(np.append(first, len(bytes_)))
    place = np.arange(len(bytes_), dtype=np.int32) - np.repeat(first, sizes).astype(np.int32)
    values = bytes_.astype(_U)
    values += _U(1)
    values *= _POWERS[np.minimum(place, LONG - 1)]
    hashes = mixed(np.add.reduceat(values, first) + sizes.astype(_U) * _U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(sizes > LONG):
        hashes[i] = xxhash.xxh64_intdigest(bytes_[first[i]: first[i] + sizes[i]].tobytes())
    return hashes, at


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and the number of words of each text."""
    data, begin = _buffers(texts)
    hashes, counts = [np.zeros(0, dtype=_U)], np.zeros(len(begin) - 1, dtype=np.int64)
    for start, end in _cut(data, begin):
        inner = begin[np.searchsorted(begin, start): np.searchsorted(begin, end)]
        found, at = _hashed(data[start:end], inner - start)
        hashes.append(found)
        owner = np.searchsorted(begin, at + start, side="right") - 1
        counts += np.bincount(owner, minlength=len(counts))
    return np.concatenate(hashes), counts


def _shingled(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each of the ``starts`` on."""
    out = np.empty(len(starts), dtype=_U)
    for at in range(0, len(starts), PIECE):
        part = starts[at: at + PIECE]
        value = np.full(len(part), 0xA0761D6478BD642F + width, dtype=_U)
        for step in range(width):
            value = mixed(value * _U(0xE7037ED1A0B428DB) + hashes[part + step])
        out[at: at + PIECE] = value
    return out


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and how many each text has.

    A text of 1 to 4 words has its whole sequence as its one shingle.
    """
    hashes, counts = words(texts)
    if len(counts) == 1:
        width = int(min(counts[0], SHINGLE))
        value = _shingled(hashes, np.arange(max(0, len(hashes) - width + 1) if width else 0), max(1, width))
        del hashes
        value.sort()
        if len(value):
            value = value[np.concatenate([[True], value[1:] != value[:-1]])]
        return value, np.array([len(value)])
    begin = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    values, owners = [], []
    for width in range(1, SHINGLE + 1):
        if width == SHINGLE:
            starts = np.flatnonzero(begin[owner + 1] - np.arange(len(owner)) >= SHINGLE)
        else:
            starts = begin[:-1][counts == width]
        values.append(_shingled(hashes, starts, width))
        owners.append(owner[starts])
    value, text = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.bincount(text[new], minlength=len(counts))


def slices(batch: pa.RecordBatch, most: int = PIECE):
    """Parts of a batch with a column ``text`` with about ``most`` bytes of text; one longer text is a part of its own."""
    lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()
    at, total = 0, 0
    for i, length in enumerate(lengths):
        if total and total + length > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(length)
    if at < batch.num_rows:
        yield batch.slice(at)
