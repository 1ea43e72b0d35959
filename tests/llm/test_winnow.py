"""Winnowing against the plain definition, and neighbours against a loop over the sorted documents."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.common import docs, table, workers  # noqa: F401

from strata.llm import winnow


def plain(text, gram, window):
    """(hash, position) of each window's rightmost minimum, gram by gram."""
    if not text:
        return []
    gram = min(gram, len(text))
    hashes = [int(winnow._rolled(np.frombuffer(text[i:i + gram].encode("utf-32-le"), "<u4"), gram)[0]) >> 16
              for i in range(len(text) - gram + 1)]
    window = min(window, len(hashes))
    out = []
    for at in range(len(hashes) - window + 1):
        best = min(range(at, at + window), key=lambda i: (hashes[i], -i))
        if not out or out[-1][1] != best:
            out.append((hashes[best], best))
    return out


def entries(pair):
    return list(zip(pair[0].tolist(), pair[1].tolist()))


@settings(max_examples=60, deadline=None)
@given(st.text("abä𝒳 ", max_size=120), st.integers(1, 9), st.integers(1, 12))
def test_entries_are_the_rightmost_minima_of_all_windows(text, gram, window):
    assert entries(winnow.winnowed(text, gram, window)) == plain(text, gram, window)


def test_a_text_of_several_pieces_is_as_one():
    text = "".join(random.Random(5).choices("abcdefg ", k=winnow.PIECE + 900)) + "x" * 3000
    assert entries(winnow.winnowed(text)) == plain(text, winnow.GRAM, winnow.WINDOW)


def test_a_shared_passage_shares_an_entry():
    pick = random.Random(1)
    for _ in range(50):
        passage = "".join(pick.choices("abcdefgh", k=winnow.GRAM + winnow.WINDOW - 1))
        a, b = ("".join(pick.choices("stuvwxyz", k=pick.randrange(400))) for _ in "ab")
        one, two = winnow.winnowed(a + passage), winnow.winnowed(passage + b)
        shared = set(one[0].tolist()) & set(two[0].tolist())
        assert any(len(a) <= at for value, at in entries(one) if value in shared)


def test_packing_keeps_hashes_and_positions():
    pair = winnow.winnowed("".join(random.Random(2).choices("abcdefgh", k=9000)))
    again = winnow.unpacked(winnow.packed(*pair))
    assert entries(again) == entries(pair) and len(again[0]) > 100


def brute(rows, gram, window):
    """Rows in order of (id, text hash), each with the next one."""
    out = []
    for (doc_id, _, text), (_, _, after) in zip(rows, rows[1:] + rows[:1]):
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        own, other, following = ({value for value, _ in plain(t, gram, window)} for t in (text, changed, after))

        def like(a, b):
            return len(a & b) / len(a | b) if a | b else 1.0

        out.append((doc_id, len(text), changed, like(own, other), like(own, following)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [1, 4, 50])
def test_neighbours_equal_a_loop(spark, docs, blocks):
    pick = random.Random(blocks)
    rows = [(i, " ".join(pick.choices(["alpha", "beta", "gäm𝒳a", "delta"], k=pick.choice([0, 1, 3, 40])))) for i in range(40)]
    rows += [(7, "the same id once more"), (7, "and again"), (None, "no id"), (None, None), (50, None), (51, "")]
    rows += [(60, "repeated row")] * 3 + [(i, rows[3][1]) for i in range(61, 66)]
    frame = docs(rows)
    hashes = {row[0]: row[1] for row in frame.selectExpr("coalesce(text, '')", "xxhash64(coalesce(text, ''))").collect()}
    ordered = sorted(((doc_id, hashes[text or ""], text or "") for doc_id, text in rows),
                     key=lambda row: (row[0] is not None, row[0] or 0, row[1]))
    found = winnow.neighbours(frame, 5, 4, blocks)
    assert table(found, "doc_id", "n_chars", "edited", "near_edited", "near_next") == brute(ordered, 5, 4)
    for row in found.collect():
        whole = [text for doc_id, _, text in ordered if doc_id == row.doc_id and len(text) == row.n_chars]
        assert any(entries(winnow.unpacked(row.entries)) == plain(text, 5, 4) for text in whole)
        assert entries(winnow.unpacked(row.edited_entries)) == plain(row.edited, 5, 4)


def test_edge_cases(spark, docs):
    assert winnow.neighbours(docs([])).count() == 0 and winnow.fingerprints(docs([])).count() == 0
    assert table(winnow.neighbours(docs([(1, None)])), "doc_id", "n_chars", "edited", "near_edited", "near_next") == [
        (1, 0, "", 1.0, 1.0)]
    long = "word and another one " * 100_000
    out = {row.doc_id: row for row in winnow.neighbours(docs([(1, long), (2, "short"), (3, long)])).collect()}
    assert out[1].entries == out[3].entries and out[1].n_chars == len(long) and out[2].near_next == 0
    assert {row.doc_id: row.entries for row in winnow.fingerprints(docs([(1, long), (2, "short")])).collect()} == {
        1: out[1].entries, 2: out[2].entries}


def test_text_order_does_not_depend_on_the_files(spark, docs):
    rows = [(i % 9, f"text {i} " * 9) for i in range(60)]
    names = "doc_id", "edited", "near_edited", "near_next"
    assert table(winnow.neighbours(docs(rows), blocks=5), *names) == table(
        winnow.neighbours(docs(rows[::-1]).repartition(7), blocks=2), *names)
