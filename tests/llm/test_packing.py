import random
import zlib

import numpy as np
import public_tokenizers

from strata.llm import packing
from strata.llm.wordbpe import encoder
from tests.llm.common import docs, workers  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(counts, size):
    patterns = packing.plan(counts, size)
    used = {}
    for lengths, times in patterns:
        assert sum(lengths) <= size and times > 0
        for length in lengths:
            used[length] = used.get(length, 0) + times
    assert used == {length: count for length, count in counts.items() if count}
    return sum(times for _, times in patterns)


def test_exact_complements_are_used():
    assert check_plan({10: 4, 6: 2, 4: 2, 7: 1, 2: 1, 1: 1}, 10) == 7


def test_pairs_and_triples():
    assert check_plan({60: 1, 25: 1, 15: 1}, 100) == 1
    assert check_plan({50: 1, 20: 1, 19: 1, 11: 1}, 100) == 1
    assert check_plan({50: 3}, 100) == 2


def test_the_next_combination_that_the_counts_allow():
    left = np.zeros(101, dtype=np.int64)
    left[[20, 10, 18, 12]] = 1
    assert packing._Sums(left).find(50, 3) == (20, 18, 12)  # 20, 20, 10 would need two of 20
    left[20] = 2
    assert packing._Sums(left).find(50, 3) == (20, 20, 10)
    assert packing._Sums(left).find(24, 2) is None


def test_random_histograms_come_near_the_bound():
    rng = random.Random(2)
    for size in (64, 512):
        counts = {}
        for _ in range(2000):
            length = rng.randint(1, size)
            counts[length] = counts.get(length, 0) + 1
        total = sum(length * count for length, count in counts.items())
        over_half = sum(count for length, count in counts.items() if 2 * length > size)
        assert check_plan(counts, size) <= 1.02 * max(over_half, -(-total // size))


def placed(docs, rows, size):
    out = packing.pack(docs(rows), PATH, size).collect()
    encode = encoder(PATH)
    seen = {}
    for row in out:
        seen.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in seen.values():
        parts.sort()
        assert [offset for offset, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        assert sum(n for _, n in parts) <= size
    want = []
    for doc, text in rows:
        ids = encode(text) + b"\0\0\0\0"
        for piece, at in enumerate(range(0, len(ids), 4 * size)):
            part = ids[at: at + 4 * size]
            want.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return len(seen)


def test_documents_in_sequences(docs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("the cat sat on a mat".split()) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(80, None), (81, ""), (None, "x y"), (5, "again"), (5, "again"), (82, "word " * 300)]
    placed(docs, rows, 32)


def test_many_of_one_length(docs):
    assert placed(docs, [(i, "a b c d e") for i in range(40)], 12) == 20


def test_empty_table(docs):
    assert packing.pack(docs([]), PATH).count() == 0
