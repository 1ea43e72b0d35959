"""The trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib

import pytest
from tests.llm.common import table, workers  # noqa: F401

from strata.llm import trie
from strata.llm.frames import running

SCHEMA = "conv_id long, turn long, role string, text string, depth int, at string, x1 string"
NAMES = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"


@pytest.fixture
def talk(spark):
    return lambda rows: spark.createDataFrame([(*row, 1, "x", "y") for row in rows], SCHEMA)


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, mark, role, text))
    own = {conv: [turn[3:] for turn in sorted(turns)] for conv, turns in own.items()}
    members = {}
    for conv in own:
        head = zlib.crc32(str(conv).encode()) % 6
        turns = own.get(conv - conv % 100, [])[:head] + own[conv][head:]
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append((conv, depth == len(turns)))
    children, under = {}, {}
    for name in members:
        if name:
            children[name[:-1]] = children.get(name[:-1], 0) + 1
    for name, who in members.items():
        for depth in range(len(name) + 1):
            sums = under.setdefault(name[:depth], [0, 0])
            sums[0] += name not in children
            sums[1] += (len(who) - 1) * len(name[-1][1]) if name else 0
    return sorted(((min(who)[0], len(name), min(members[name[:-1]])[0] if name else None, len(who), children.get(name, 0),
                    *under[name], hashlib.sha256(",".join(str(c) for c, last in sorted(who) if last).encode()).hexdigest())
                   for name, who in members.items()), key=repr)


def random_rows(seed, convs):
    pick = random.Random(seed)
    rows = []
    for conv in convs:
        for turn in range(pick.choice([1, 2, 3, 5, 7, 12])):
            rows.append((conv, turn, pick.choice(["user", "bot"]), pick.choice(["a", "bb", "ccc"]) if turn > 2 else "hello"))
    return rows


@pytest.mark.parametrize("height", [1, 2, 3, 5, None])
def test_trie_equals_dictionaries(spark, talk, height):
    rows = random_rows(height or 0, [*range(60), *range(100, 130), 205, 207])
    assert table(trie.trie(talk(rows), height), *NAMES) == brute(rows)


def test_long_conversations_and_many_copies(spark, talk, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    deep = [(100, turn, "user", f"turn {turn // 3}") for turn in range(170)]
    deep += [(150, turn, "user", f"turn {turn // 3}") for turn in range(90)]
    copies = [(conv, turn, "bot", "the same") for conv in range(300, 400) for turn in range(8)]
    rows = deep + copies
    random.Random(3).shuffle(rows)
    expected = brute(rows)
    for height in (4, None):
        assert table(trie.trie(talk(rows), height), *NAMES) == expected


def test_edge_cases(spark, talk):
    assert trie.trie(talk([])).count() == 0
    rows = [(None, 1, "user", "nobody's"), (100, None, None, None), (100, None, "b", "a"), (100, 2, "user", ""),
            (100, 2, "user", ""), (100, 2, "us", "er"), (101, 5, "user", "x" * 300_000), (-3, 1, "user", "below zero"),
            (-200, 1, "user", "below"), (999, 0, "user", "no beginning to take")]
    assert table(trie.trie(talk(rows)), *NAMES) == brute_with_truncated_blocks(rows)


def brute_with_truncated_blocks(rows):
    """Python's % is not that of SQL for numbers below zero: ids are moved by the block rule of SQL first."""
    class Id(int):
        def __mod__(self, other):
            return int(abs(int(self)) % other * (1 if self >= 0 else -1))
    return brute([(None if conv is None else Id(conv), *rest) for conv, *rest in rows])


def test_running_sums_go_on_over_tasks(spark):
    pick = random.Random(4)
    rows = [(pick.choice([1, 2, 2, 2, 2, 9]), i, pick.randrange(-2**62, 2**62)) for i in range(4000)]
    frame = spark.createDataFrame(rows, "k long, nr long, x long").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = table(running(frame, "k", ["nr"], ["x"], "running"), "k", "nr", "at", "x")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    held, expected = {}, []
    for k, nr, x in rows:
        at, sum_ = held.get(k, (-1, 0))
        held[k] = at + 1, sum_ ^ x
        expected.append((k, nr, *held[k]))
    assert found == sorted(expected, key=repr)
    assert running(frame.where("k > 50"), "k", ["nr"], ["x"], "none").count() == 0
