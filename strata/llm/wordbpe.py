"""Token ids of whole texts by a word-level BPE vocabulary of the tokenizers library, with a bounded word memory.

The vocabulary drops white space and never joins across it, so a text's ids are the ids of its chunks between
blanks. A chunk of Latin letters followed by marks is the lower-cased letters and then the marks, as the
vocabulary splits them; its letters are one word for the library's model. Every other chunk goes through the
library's whole encoder. Answers are remembered, in at most about ``MEMORY`` bytes a worker for each kind.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache


MEMORY = 128 << 20 # bytes for chunks, for words and for marks; a full memory is emptied, which costs time only
ENTRY = 200        # bytes that an entry has besides its letters and ids
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch


def packed(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers; an array is quicker than numpy for the few ids of a word."""
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: visible Latin-1 as it is, others from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in visible]
    return {byte: chr(byte) for byte in visible} | {byte: chr(256 + i) for i, byte in enumerate(hidden)}


class _Memory(dict):
    def __init__(self, answer: Callable[[str], bytes], most: int):
        self.answer, self.most, self.size = answer, most, 0

    def __missing__(self, key: str) -> bytes:
        value = self.answer(key)
        cost = ENTRY + len(key) + len(value)
        if self.size + cost > self.most:
            self.clear()
            self.size = 0
        if cost <= self.most:
            self[key] = value
            self.size += cost
        return value


@lru_cache(maxsize=2)
def encoder(path: str, memory: int = MEMORY) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers; one per worker and vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, _byte_letters()

    def whole(chunk: str) -> bytes:
        return packed(tokenizer.encode(chunk, add_special_tokens=False).ids) if chunk else b""

    def word(lower: str) -> bytes:
        spelled = lower if lower.isascii() else "".join(map(letters.__getitem__, lower.encode()))
        return packed([token.id for token in model.tokenize(spelled)])

    words, marks = _Memory(word, memory), _Memory(whole, memory)

    def chunk_ids(chunk: str) -> bytes:
        parts = _LETTERS(chunk)
        if not parts or "<|" in chunk:
            return whole(chunk)
        return words[parts[1].lower()] + marks[parts[2]]

    chunks = _Memory(chunk_ids, memory)

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(chunks.__getitem__, text.replace("\n", " ").split(" ")))

    return encode
