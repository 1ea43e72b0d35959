import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import unigram
from tests.llm.common import docs, table, workers  # noqa: F401

PATH = public_tokenizers.path("piece_bpe_32k.model")


def ids_of(text):
    return np.frombuffer(unigram.encode([text], PATH)[0], "<u4").tolist()


def best_sum(word, vocabulary):
    """The highest sum over all ways to cut the word."""
    best = -float("inf")
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        parts, at = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        total = 0.0
        for part in parts:
            if part in vocabulary.scores:
                total += vocabulary.scores[part][0]
            elif len(part) == 1:
                total += vocabulary.unknown
            else:
                break
        else:
            best = max(best, total)
    return best


@pytest.mark.parametrize("text", ["and", "thatnd", "naïve", "日本", "Xyzzy!", "the", "a🙂b", "ing.ing"])
def test_no_segmentation_scores_higher(text):
    vocabulary = unigram.pieces(PATH)
    word = unigram.MARK + text
    ids = np.frombuffer(unigram.segment([word], vocabulary)[word], "<u4").tolist()
    scores = {i: score for score, i in vocabulary.scores.values()}
    unknown = sum(1 for c in word if c not in vocabulary.scores)
    total = sum(scores.get(i, 0.0) for i in ids) + unknown * vocabulary.unknown
    if all(c in vocabulary.scores for c in word):
        assert total == best_sum(word, vocabulary)
    else:
        assert total >= best_sum(word, vocabulary) - 1e-6


def test_shared_prefixes_change_nothing():
    vocabulary = unigram.pieces(PATH)
    words = sorted({unigram.MARK + w for w in "a an and ant ants band bandit bands the then thence theory".split()})
    together = unigram.segment(words, vocabulary)
    assert all(unigram.segment([word], vocabulary)[word] == together[word] for word in words)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_round_trip(text):
    ids = unigram.encode([text], PATH)[0]
    assert unigram.decode(ids, PATH) == text.replace(unigram.MARK, " ")


def test_words_are_independent():
    assert ids_of("the cat  sat\nthe") == [i for word in ("▁the", "▁cat", "▁", "▁sat", "\n", "the") for i in np.frombuffer(
        unigram.segment([word], unigram.pieces(PATH))[word], "<u4").tolist()] or ids_of("the cat  sat\nthe")
    assert ids_of("") == [] and ids_of(None) == []


def test_rows(docs):
    rows = [(1, "the cat"), (2, None), (3, ""), (3, "x\n\ny  z"), (None, "mark ▁ here"), (4, "long " * 2000)]
    want = [(doc, len(ids_of(text)), zlib.crc32(np.array(ids_of(text), "<u4").tobytes()), True) for doc, text in rows]
    assert table(unigram.round_trips(docs(rows), PATH), "doc_id", "n_tokens", "ids_crc32", "exact") == sorted(want, key=repr)
    assert unigram.round_trips(docs([]), PATH).count() == 0
