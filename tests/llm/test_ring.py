import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import ring
from tests.llm.common import docs, workers  # noqa: F401


@given(st.lists(st.integers(0, 30), min_size=33, max_size=33), st.sampled_from([1.0, 1.25]))
@settings(max_examples=100, deadline=None)
def test_all_rows_settle_within_capacity(arcs, load):
    _, owner = ring.ring(4, 8)
    room = ring.capacities(sum(arcs), 4, load)
    runs = ring.settle(arcs, owner, room)
    covered = sorted(i for first, _, rows in runs for i in range(first, first + rows))
    assert covered == list(range(sum(arcs)))
    for shard in range(4):
        assert sum(rows for _, to, rows in runs if to == shard) <= room[shard]


def test_without_pressure_rows_stay_on_their_arc():
    _, owner = ring.ring(3, 4)
    arcs = [1] * 13
    runs = ring.settle(arcs, owner, [13] * 3)
    assert [to for _, to, _ in runs] == [int(owner[i % 12]) for i in range(13)]


def test_a_new_shard_moves_few_rows():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(-2 ** 63, 2 ** 63 - 1, size=20_000, dtype=np.int64))

    def shards(n):
        at, owner = ring.ring(n)
        arcs = np.bincount(np.searchsorted(at, keys), minlength=len(at) + 1).tolist()
        out = np.empty(len(keys), dtype=int)
        for first, to, rows in ring.settle(arcs, owner, ring.capacities(len(keys), n, 1.25)):
            out[first: first + rows] = to
        return out
    assert (shards(8) != shards(9)).mean() < 0.3


def test_counts_are_at_most_one_apart(docs):
    rows = [(i, f"text {i}") for i in range(60)] + [(100 + i, "hot") for i in range(40)] + [(7, None), (None, ""), (3, "text 3")]
    out = ring.shard(docs(rows), 8).collect()
    assert len(out) == len(rows)
    slots = {}
    for row in out:
        slots.setdefault(row["shard"], []).append(row["slot"])
    sizes = [len(s) for s in slots.values()]
    assert len(slots) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((doc, len((text or "").encode()) + 1, zlib.crc32((text or "").encode())) for doc, text in rows if doc is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == want


def test_equal_texts_stay_together_where_there_is_room(docs):
    rows = [(i, f"text {i}") for i in range(200)] + [(1000 + i, "copy") for i in range(10)]
    out = ring.shard(docs(rows), 4, load=3.0).where("doc_id >= 1000").select("shard").distinct()
    assert out.count() == 1


def test_fewer_rows_than_shards_and_none(docs):
    assert {row["slot"] for row in ring.shard(docs([(1, "a"), (2, "b")]), 8).collect()} == {0}
    assert ring.shard(docs([]), 8).count() == 0
