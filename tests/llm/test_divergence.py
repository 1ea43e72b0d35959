"""The audit against whole-number sums over all terms and pairs; collisions and long texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.common import table, workers  # noqa: F401

from strata.llm import divergence

NAMES = "lang", "source", "part", "item", "value", "rank"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def texts(spark):
    return lambda rows: spark.createDataFrame([(*row, 1, "x") for row in rows], "text string, lang string, source string, n int, term string")


def brute(rows, top=200):
    counts, docs = {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(TERM.findall((text or "").translate(UPPER)))
        counts.setdefault((lang, source), Counter()).update(found)
        docs.setdefault(lang, Counter()).update(found.keys())
    out = []
    for lang in docs:
        kept = [term for term, n in docs[lang].items() if n >= 3]
        groups = {source: c for (l, source), c in counts.items() if l == lang}
        whole = sum(groups.values(), Counter())

        def parts(count):
            total = sum(count[term] for term in kept)
            return {term: 1 + 10**9 * (count[term] + 1) // (total + len(kept)) for term in kept}

        p, q = {source: parts(c) for source, c in groups.items()}, parts(whole)
        for source in groups:
            pairs = [(sum((p[source][t] - p[other][t]) ** 2 // p[other][t] for t in kept), other) for other in groups if other != source]
            terms = [((p[source][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[source][t] and p[source][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda row: (-row[0], row[1].encode()))
                out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)
                        if part == "pair" or rank <= top]
    return sorted(out, key=repr)


def random_rows(seed, n=150):
    pick = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeÄßé𝒳" for b in ("x", "yY", "Éz")] + ["İ", "K", "s-t", "3rd", "a_b", "the", "the", "the"]
    return [(" ".join(pick.choices(words, k=pick.choice([0, 1, 5, 30]))) + pick.choice(["", ".", "\n\x00", "\x7f1"]),
             pick.choice(["en", "en", "de", None]), pick.choice(["s1", "s1", "s1", "s2", "s3", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_whole_sums(spark, texts, seed):
    rows = random_rows(seed)
    assert table(divergence.audit(texts(rows).repartition(6)), *NAMES) == brute(rows)


def test_collided_digests_are_split(spark, texts):
    rows = random_rows(3)
    expected = brute(rows, top=4)
    for bits in (1, 4, 60):
        assert table(divergence.audit(texts(rows).repartition(4), top=4, bits=bits), *NAMES) == expected


def test_ties_are_ordered_by_their_bytes(spark, texts):
    rows = [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(300)), "en", "s1")] * 4 + [("other words here", "en", "s2")] * 3
    found = table(divergence.audit(texts(rows), top=20), *NAMES)
    assert found == brute(rows, top=20) and len(found) == 2 + 20 + 3


def test_groups_without_terms_and_empty_tables(spark, texts):
    rows = [(None, "en", "s1"), ("", "en", "s2"), ("123 ... \x00", None, None), ("rare word", "fr", "a"), ("1", "fr", "b")]
    assert table(divergence.audit(texts(rows)), *NAMES) == brute(rows)
    assert divergence.audit(texts([])).count() == 0


def test_a_long_text_is_tallied_in_pieces(spark, texts):
    pick = random.Random(8)
    long = " ".join(pick.choices(["alpha", "béta", "Gamma", "δ"], k=500_000)) + " " + "z" * 2_500_000
    rows = [(long, "en", "s1"), (long, "en", "s2"), (long + " extra", "en", "s1"), ("alpha extra extra", "en", "s2")]
    assert table(divergence.audit(texts(rows)), *NAMES) == brute(rows)


def test_pieces_end_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    for text in (b"", b"abcdefghijklmnopq", b"ab cd efgh ijklmnop q", b"..........", "éééé ééééé é".encode()):
        pieces = list(divergence._pieces(text))
        assert b"".join(pieces) == text
        whole = np.frombuffer(text, np.uint8)
        _, codes, terms = divergence._terms(whole, np.array([0, len(whole)]))
        parts = [divergence._terms(np.frombuffer(p, np.uint8), np.array([0, len(p)])) for p in pieces]
        assert Counter(terms.take(codes).to_pylist()) == Counter(t for p in parts for t in p[2].take(p[1]).to_pylist())


def test_a_tally_hands_on_what_it_holds(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 2)
    held = divergence._Tally(64, False)
    for _ in range(3):
        held.add([5, 6], ["en", "en"], np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([2, 1, 4]), ["a", "b"])
    assert held.full()
    [batch] = held.rows()
    rows = batch.to_pylist()
    assert sorted((row["gk"], row["n"], row["docs"]) for row in rows) == [(5, 6, 3), (6, 3, 3), (6, 12, 3)]
    assert sorted(row["term"] for row in rows if row["term"]) == ["a", "b"] and len({row["digest"] for row in rows}) == 2
    assert not held.held and not held.codes and not held.full() and not list(held.rows())
