import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import metricjoin, topk
from tests.llm.common import linked_groups, table, workers  # noqa: F401

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(*row, "x", 1, 2) for row in rows],
                                     "vec_id long, embedding array<double>, cell string, dim int, home int")
    return make


def cosine(a, b):
    a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def brute_links(rows, threshold):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for n, (a, v) in enumerate(ok) for b, w in ok[n + 1:] if len(v) == len(w) and cosine(v, w) >= threshold]
    groups = linked_groups({i for i, _ in rows if i is not None}, links)
    count = {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return sorted(((i, count[i], groups.get(i), groups.get(i) == i and i is not None) for i, _ in rows), key=repr)


def clustered(n, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(int(i), (centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.1, 0.3, 0.6])).tolist()) for i in range(n)]


ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [NAN] * 8), (905, [INF] + [1.0] * 7),
       (906, [1.0, 1.0]), (907, [2.0, 2.0]), (908, [1e-200] * 8), (909, [1e200] * 8), (None, [1.0] * 8)]


@pytest.mark.parametrize("block", [8192, 16])
def test_links_against_brute_force(vectors, monkeypatch, block):
    monkeypatch.setattr(metricjoin, "BLOCK", block)  # small blocks: many pivots, visitors and tasks
    rows = clustered(220) + ODD
    rows += [(1000 + i, rows[3][1]) for i in range(20)]
    got = table(metricjoin.linked(vectors(rows)), "vec_id", "n_links", "component_id", "kept")
    assert got == brute_links(rows, 0.9)


def test_links_of_repeated_rows(vectors):
    got = table(metricjoin.linked(vectors([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])), "vec_id", "n_links", "component_id")
    assert got == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_no_vectors(vectors):
    assert metricjoin.linked(vectors([])).count() == 0
    assert table(metricjoin.linked(vectors([(4, None)])), "vec_id", "n_links", "component_id", "kept") == [(4, 0, 4, True)]


def test_single_precision_input(spark):
    rows = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.25, 0.25])], "vec_id long, embedding array<float>")
    assert table(metricjoin.linked(rows), "vec_id", "n_links") == [(1, 1), (2, 1)]


def brute_top(rows, k, every):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(4096, 1024), (16, 4)])
def test_top_k_against_brute_force(vectors, monkeypatch, sizes):
    monkeypatch.setattr(topk, "CANDIDATES", sizes[0])
    monkeypatch.setattr(topk, "QUERIES", sizes[1])
    rows = clustered(150, seed=1) + ODD[:6] + [(906, [1.0, 1.0])] + [(1000 + i, clustered(150, seed=1)[10][1]) for i in range(30)]
    got = table(topk.search(vectors(rows), F.col("vec_id") % 10 == 0), "query_id", "rank", "vec_id", "score")
    assert got == brute_top(rows, 10, 10)


def test_fewer_candidates_than_k(vectors):
    rows = [(0, [1.0, 0.5]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])]
    got = table(topk.search(vectors(rows), F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score")
    assert got == brute_top(rows, 10, 100)


def test_top_k_of_nothing(vectors):
    assert topk.search(vectors([]), F.col("vec_id") == 0).count() == 0
    assert topk.search(vectors([(1, [1.0])]), F.col("vec_id") == 0).count() == 0


def test_dense_blocks_are_counted_without_their_pairs():
    import tracemalloc
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    a, b = (base + rng.normal(size=(4096, 16)) * 0.01 for _ in "ab")
    a, b = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (a, b))
    ones = np.ones(4096, dtype=np.int64)
    tracemalloc.start()
    links, root = metricjoin._tallied(a, b, False, 0.9, ones, ones)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (links == 4096).all() and (root == 0).all() and peak < 150 << 20


def test_tiles_agree_with_one_comparison(monkeypatch):
    monkeypatch.setattr(metricjoin, "TILE", 7)
    rows = metricjoin._matrix(__import__("pyarrow").array([v for _, v in clustered(90)]))
    copies = np.arange(1, 91)
    for same in (True, False):
        a, b = (rows, rows) if same else (rows[:40], rows[40:])
        links, root = metricjoin._tallied(a, b, same, 0.9, copies if same else copies[:40], copies if same else copies[40:])
        met = rows @ rows.T >= 0.9
        if not same:
            met[:40, :40] = met[40:, 40:] = False
        np.fill_diagonal(met, False)
        assert links.tolist() == (met @ copies).tolist()
        groups = linked_groups(range(90), list(zip(*np.nonzero(met))))
        assert root.tolist() == [groups[i] for i in range(90)]


def test_few_pairs_are_resolved(spark, vectors, monkeypatch):
    counted = []
    kept = topk._totals
    monkeypatch.setattr(topk, "_totals", lambda pairs, *rest: counted.append(pairs.count()) or kept(pairs, *rest))
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1500)]
    found = topk.search(vectors(rows), F.col("vec_id") % 100 == 0, 10).collect()
    assert len(found) == 150 and counted[-1] < 0.2 * 15 * 1500
