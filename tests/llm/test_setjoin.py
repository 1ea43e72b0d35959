import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import setjoin, shingles
from strata.llm.graph import components
from tests.llm.common import docs, linked_groups, table, workers  # noqa: F401


def brute_set(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows, threshold=75):
    sets = {doc: brute_set(text) for doc, text in rows if doc is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    groups = linked_groups(ids, links)
    return sorted(((doc, len(brute_set(text)), groups.get(doc)) for doc, text in rows), key=repr)


def edited(rng, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return " ".join(out)


def corpus(seed, groups=8, size=9):
    """Groups of texts with few to many edits, a passage in many texts, short texts and copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 8, 12, 14, 20, 40, 100, 250]))]
        for _ in range(size):
            rows.append((len(rows), edited(rng, base, rng.randrange(1 + len(base) // 25 + 1), vocabulary)))
    for _ in range(25):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(2, 40))]
        rows.append((len(rows), " ".join(own + passage)))
    rows += [(len(rows) + i, rows[4][1]) for i in range(12)]
    for text in ("a b", "A  B", "a b c", "b a", "", None, " \n", "one", "One", "é a", "É a", "w " * 400, "w " * 7):
        rows.append((len(rows), text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(docs, seed):
    rows = corpus(seed)
    rng = random.Random(seed)
    rng.shuffle(rows)
    assert table(setjoin.grouped(docs(rows)), "doc_id", "n_shingles", "component_id") == brute(rows)


@pytest.mark.parametrize("bound", [0, 30])
def test_every_boundary_gives_the_same(docs, monkeypatch, bound):
    monkeypatch.setattr(setjoin, "_boundary", lambda nodes: bound)
    rows = corpus(7)
    assert table(setjoin.grouped(docs(rows)), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_other_threshold(docs):
    rows = corpus(9)
    assert table(setjoin.grouped(docs(rows), 90), "doc_id", "n_shingles", "component_id") == brute(rows, 90)


def test_near_the_threshold(docs):
    words = [f"x{i}" for i in range(104)]  # 100 shingles
    rows = [(0, " ".join(words))]
    for cut in (74, 75, 76, 99, 100):
        rows.append((cut, " ".join(words[:cut + 4])))
    assert table(setjoin.grouped(docs(rows)), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_repeated_rows_null_ids_and_no_rows(docs):
    text = " ".join(f"y{i}" for i in range(30))
    got = table(setjoin.grouped(docs([(1, text), (1, text), (2, text), (None, text)])), "doc_id", "component_id")
    assert got == [(1, 1), (1, 1), (2, 1), (None, None)]
    assert setjoin.grouped(docs([])).count() == 0


def test_hashed_sets_have_the_right_sizes():
    texts = ["a b c d e f", "A b\x0bc\td e f", "x", None, "", " a ", "p q r s", "a a a a a a a", "é\xa0b c d e", "a b c d e f"]
    values, counts = shingles.sets(pa.array(texts))
    assert counts.tolist() == [len(brute_set(text)) for text in texts]
    parts = np.split(values, np.cumsum(counts)[:-1])
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(parts[i], parts[j])) == len(brute_set(a) & brute_set(b)), (a, b)


def test_parts_of_a_batch_are_whole():
    texts = pa.array(["x" * 10, None, "y" * 50, "z", "", "w" * 9])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = [part["text"].to_pylist() for part in shingles.slices(batch, 12)]
    assert sum(parts, []) == texts.to_pylist() and len(parts) > 2
    offset = batch.slice(2, 3)
    assert shingles.words(offset["text"])[1].tolist() == [1, 1, 0]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)]
    df = spark.createDataFrame(links, "u long, v long")
    want = linked_groups({x for pair in links for x in pair if pair[0] != pair[1]}, [p for p in links if p[0] != p[1]])
    assert table(components(df), "node", "component") == sorted(want.items(), key=repr)
    assert components(df.where(F.lit(False))).count() == 0


def test_words_do_not_depend_on_pieces(monkeypatch):
    pick = random.Random(6)
    texts = [" ".join("".join(pick.choices("aBcé", k=pick.choice([1, 3, 9, 60]))) for _ in range(pick.choice([0, 1, 4, 30])))
             for _ in range(60)] + [None, "", " \t ", "x" * 9000, "y" * 5000 + " z", "x" * 9000]
    whole = pa.array(texts)
    expected, counts = shingles.words(whole)
    assert counts.tolist() == [len((text or "").split()) for text in texts]
    named = [word.encode().lower() for text in texts for word in (text or "").split()]
    assert len(set(expected.tolist())) == len(set(named)) and len(set(zip(named, expected.tolist()))) == len(set(named))
    sets = [shingles.sets(whole.slice(i, 1))[0].tolist() for i in range(len(texts))]
    for piece in (1, 7, 100):
        monkeypatch.setattr(shingles, "PIECE", piece)
        found, per_text = shingles.words(whole)
        assert found.tolist() == expected.tolist() and per_text.tolist() == counts.tolist()
        assert [shingles.sets(whole.slice(i, 1))[0].tolist() for i in range(len(texts))] == sets
    values, sizes = shingles.sets(whole)
    ends = np.cumsum(sizes)
    assert [values[end - size: end].tolist() for end, size in zip(ends, sizes)] == sets


def test_a_token_of_all_sets_leaves_a_task_in_few_rows(docs):
    rng = random.Random(3)
    passage = " ".join(rng.choice("abcdefgh") * 3 + str(i) for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(6))) for i in range(900)]
    found = setjoin._prefixes(docs(rows).coalesce(1), 75).where("token & 1 = 0")
    assert found.groupBy("token").count().agg(F.max("count")).first()[0] == 1
    carried = setjoin._prefixes(docs(rows).coalesce(1), 75).where("token & 1 = 1")
    assert carried.count() == carried.select("doc").distinct().count() > 800


@pytest.mark.parametrize("memory", [0, 40])
def test_small_memories_of_tasks_lose_no_link(docs, monkeypatch, memory):
    monkeypatch.setattr(setjoin, "SEEN", memory)
    rows = corpus(5)
    assert table(setjoin.grouped(docs(rows)), "doc_id", "n_shingles", "component_id") == brute(rows)


def test_hot_keys_are_joined_not_windowed(docs, monkeypatch):
    """Copies, keys and tokens meet their counts in joins over written tables; only few rows a task reach a window."""
    plans = []
    original = setjoin.written
    monkeypatch.setattr(setjoin, "written", lambda df, name: plans.append(
        (name, df._jdf.queryExecution().executedPlan().toString())) or original(df, name))
    rows = corpus(6)
    assert table(setjoin.grouped(docs(rows)), "doc_id", "n_shingles", "component_id") == brute(rows)
    for name, plan in plans:
        assert "Window" not in plan or name == "sets", name
