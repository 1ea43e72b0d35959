import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import blocks
from strata.llm.wordbpe import encoder
from tests.llm.common import docs, table, workers  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["The cat, it's 3rd!", "", None, "Élan vital... ÇA-va? naïve", "á é x y", "ΣΑΣ İstanbul ß",
         "日本語 テスト", "tab\tand\x0bvt\x1cfs", "<|endoftext|> x<|startoftext|>", "  many   blanks \n\n lines\r\n", "don't I'll WE'RE",
         "moron### idiot***", "x" * 3000, "🙂🙂 ok", "co-op e-mail's", "1234 5,678.90", "'s 't a's"]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_word_memory_gives_the_library_ids():
    encode = encoder(PATH)
    for text in TEXTS:
        assert np.frombuffer(encode(text), "<u4").tolist() == library_ids(text), text


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_gives_the_library_ids(text):
    assert np.frombuffer(encoder(PATH)(text), "<u4").tolist() == library_ids(text)


@given(st.lists(st.lists(st.integers(0, 2 ** 32 - 1), max_size=40), max_size=6), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_blocks_give_all_ids_back(documents, repeat):
    arrays = [np.array(ids * repeat, dtype=np.uint32) for ids in documents]
    for ids, (starts, payload) in zip(arrays, blocks.pack(arrays)):
        assert (blocks.unpack(starts, payload) == ids).all()
        assert len(starts) == -(-len(ids) // blocks.BLOCK)


def test_a_block_is_read_alone():
    ids = np.arange(5000, dtype=np.uint32)
    starts, payload = blocks.pack([ids])[0]
    assert (blocks.unpack_block(payload, starts[2]) == ids[2048:3072]).all()


def test_few_wide_ids_are_exceptions():
    ids = np.full(1024, 7, dtype=np.uint32)
    ids[[3, 900]] = 49_000
    starts, payload = blocks.pack([ids])[0]
    assert len(payload) < 40


def test_files_in_order(docs):
    rows = [(i * 3 % 17, text) for i, text in enumerate(TEXTS)]
    want, start = [], 0
    for doc, text in sorted(rows):
        ids = np.array(library_ids(text) + [1], dtype="<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = table(blocks.checksums(blocks.token_files(docs(rows), PATH)), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(want, key=repr)


def test_repeated_and_null_ids(docs):
    got = blocks.checksums(blocks.token_files(docs([(None, "b"), (2, "a"), (2, "a"), (1, "c d")]), PATH)).orderBy("start").collect()
    assert [(row["doc_id"], row["start"], row["n_tokens"]) for row in got] == [(None, 0, 2), (1, 2, 3), (2, 5, 2), (2, 7, 2)]


def test_empty_table(docs):
    assert blocks.checksums(blocks.token_files(docs([]), PATH)).count() == 0
