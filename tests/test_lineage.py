import random

import pytest
from conftest import rows_of

from strata.operators import lineage as op

EDGE = "src string, dst string"


def walk(edges, roots):
    depth, seen, frontier = 0, {root: 0 for root in roots}, set(roots)
    while frontier:
        depth += 1
        frontier = {b for a, b in edges if a in frontier and b not in seen}
        seen |= {node: depth for node in frontier}
    return sorted(seen.items(), key=repr)


def test_cycle_ends(make):
    edges = make([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")], EDGE)
    assert rows_of(op.reachable(edges, make([("a",)], "node string"))) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert rows_of(op.reachable(edges, make([("a",)], "node string"), "upstream"), "node") == [("a",), ("b",), ("c",)]


def test_depth_and_unknown_roots(make):
    edges = make([("a", "b"), ("b", "c"), ("c", "d")], EDGE)
    assert rows_of(op.reachable(edges, make([("a",), ("x",)], "node string"), max_depth=1)) == [("a", 0), ("b", 1), ("x", 0)]
    with pytest.raises(ValueError):
        op.reachable(edges, make([("a",)], "node string"), "sideways")


def test_random_graph_against_a_plain_walk(make):
    rng = random.Random(7)
    pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(80)}
    assert rows_of(op.reachable(make(sorted(pairs), EDGE), make([("n1",), ("n2",)], "node string"))) == walk(pairs, ["n1", "n2"])


def test_a_long_chain_is_followed_to_its_end(make):
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(13)]
    assert rows_of(op.reachable(make(pairs, EDGE), make([("n00",)], "node string"))) == walk(pairs, ["n00"])


def test_layer_view_drops_edges_without_both_ends(make):
    nodes = make([("s", "source", None), ("k", "task", None), ("o", "table", "ods"), ("d", "table", "dwd")],
                 "node string, node_type string, layer string")
    edges = make([("s", "k"), ("k", "o"), ("o", "d")], EDGE)
    kept, inside = op.lineage_for_layer(nodes, edges, "ods")
    assert rows_of(kept, "node") == [("k",), ("o",), ("s",)] and rows_of(inside) == [("k", "o"), ("s", "k")]


def test_hops_go_through_the_task(make):
    edges = make([("s", "t", 7, "cdc_sync")], "src string, dst string, task_id int, lineage_type string")
    assert rows_of(op.task_hops(edges)) == [("s", "task:7", "cdc_sync"), ("task:7", "t", "cdc_sync")]


def test_a_chain_takes_rounds_by_its_logarithm(spark, make, monkeypatch):
    from strata.operators import lineage
    rounds = []
    kept = lineage.written
    monkeypatch.setattr(lineage, "written", lambda df, name: rounds.append(name) or kept(df, name))
    chain = make([(i, i + 1) for i in range(4095)], "src int, dst int")
    found = lineage.reachable(chain, make([(0,)], "node int"), frontier_rounds=1)
    assert found.count() == 4096 and found.where("node = depth").count() == 4096
    assert 1 + rounds.count("reached") - 1 <= 13  # one step, and the doublings after the frontier's own table


def test_doubled_hops_find_the_fewest_steps(spark, make):
    import random

    from strata.operators import lineage
    pick = random.Random(2)
    for trial, limit in enumerate((None, 5, 1, None)):
        edges = {(pick.randrange(60), pick.randrange(60)) for _ in range(75)} | {(i, i + 1) for i in range(60, 60 + 9 * trial)} | {(5, 60), (60 + 9 * trial, 3)}
        roots, depth, at = {0, 7}, {0: 0, 7: 0}, 0
        front = set(roots)
        while front and (limit is None or at < limit):
            at += 1
            front = {b for a, b in edges if a in front} - depth.keys()
            depth.update(dict.fromkeys(front, at))
        for rounds in (0, 1, 3):
            found = lineage.reachable(make(sorted(edges), "src int, dst int"), make([(r,) for r in roots], "node int"), max_depth=limit, frontier_rounds=rounds)
            assert sorted(tuple(row) for row in found.select("node", "depth").collect()) == sorted(depth.items())
