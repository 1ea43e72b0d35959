import hashlib
import random
from collections import defaultdict

from strata.llm import cuckoo, lines
from tests.llm.common import docs, table, workers  # noqa: F401


def brute(rows, least=3, length=20):
    """doc_id, n_lines, n_dropped, text by the rule itself."""
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= length:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        stay = [x for x in all_ if doc is None or len(holders[key(x)]) < least or max(holders[key(x)]) == doc]
        out.append((doc, len(all_), len(all_) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


A, B = "The same long line of a licence", "Another line that is long enough"
ROWS = [
    (1, f"{A}\nown text of one\n{B}"), (2, f"  {A.upper()}\t\nown\n\n{B}\n"), (3, f"{A}\n{A}\nÀ propos de rien du tout x"),
    (4, f"short\n{B}"), (5, ""), (6, None), (7, "à propos de rien du tout x"), (8, "À propos de rien du tout x\n"),
    (None, f"{A}\nx"), (9, f"{A}\n" * 3), (4, f"short\n{B}"), (10, "A" * 19 + "\n" + "A" * 19 + " "), (11, "\n\n"),
]


def test_against_brute_force(docs):
    assert table(lines.kept(docs(ROWS)), "doc_id", "n_lines", "n_dropped", "text") == brute(ROWS)


def test_random_lines(docs):
    rng = random.Random(3)
    pool = [f"line number {i} " + "x" * rng.randrange(25) for i in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(120)]
    assert table(lines.kept(docs(rows)), "doc_id", "n_lines", "n_dropped", "text") == brute(rows)


def test_empty_table(docs):
    assert lines.kept(docs([])).count() == 0


def test_other_columns_stay(docs):
    out = lines.kept(docs([(1, "a")]))
    assert {"key", "row", "index"} <= set(out.columns) and out.first()["key"] == "x"


def snapshot(state):
    filters = {row["shard"]: cuckoo.Filter(bytes(row["data"])) for row in state.filters.collect()}
    counts = table(state.counts, "key", "refs", "last_doc")
    return counts, filters


def test_deletion_undoes_insertion(docs, spark):
    first, more = ROWS[:5], ROWS[5:8] + ROWS[9:]
    start = lines.index(docs(first), 2)
    grown = lines.insert(start, docs(more), 2)
    whole = lines.index(docs(first + more), 2)
    assert table(grown.counts, "key", "refs", "last_doc") == table(whole.counts, "key", "refs", "last_doc")
    again = lines.insert(grown, docs(more), 2)
    assert table(again.counts, "key", "refs", "last_doc") == table(grown.counts, "key", "refs", "last_doc")
    back = lines.delete(grown, spark.createDataFrame([(doc,) for doc, _ in more], "doc_id long"), 2)
    # Document 4 came twice; deleting it takes both.
    rest = lines.index(docs([row for row in first if row[0] not in {doc for doc, _ in more}]), 2)
    assert table(back.counts, "key", "refs", "last_doc") == table(rest.counts, "key", "refs", "last_doc")
    assert table(lines.kept(docs(first[:3]), back, 2), "doc_id", "text") == [
        (doc, text) for doc, _, _, text in brute(first[:3], 2)]


def test_filters_hold_the_common_keys_only(docs, spark):
    state = lines.index(docs(ROWS), 3)
    grown = lines.delete(lines.insert(state, docs([(20, "a line which only two hold\n")]), 3),
                         spark.createDataFrame([(20,)], "doc_id long"), 3)
    for held in (state, grown):
        stored = sum(int((cuckoo.Filter(bytes(row["data"])).table > 0).sum()) for row in held.filters.collect())
        assert stored == held.counts.where("refs >= 3").count()


def test_cuckoo_filter(spark):
    rng = random.Random(5)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(900)]
    made = cuckoo.build(keys)
    assert all(key in made for key in keys)
    others = [rng.getrandbits(64) - (1 << 63) for _ in range(900)]
    data = spark.createDataFrame([(key, bytearray(made.data())) for key in keys[:200] + others], "g long, data binary")
    asked = [row["hit"] for row in data.select(cuckoo.may_hold(data["data"], data["g"]).alias("hit")).collect()]
    assert asked == [key in made for key in keys[:200] + others]
    assert all(made.delete(key) for key in keys[:450])
    assert all(key in made for key in keys[450:])
    assert sum(key in made for key in keys[:450]) < 5


def test_key_is_exact(docs):
    line = "Ünïcode STAYS but ascii falls"
    want = hashlib.sha256("Ünïcode stays but ascii falls".encode()).digest()
    assert [bytes(row["key"]) for row in lines.keyed_lines(docs([(1, line)])).collect()] == [want]


def filter_keys(state):
    return sum(int((cuckoo.Filter(bytes(row["data"])).table > 0).sum()) for row in state.filters.collect())


def test_a_kept_index_grows_shard_by_shard(docs, spark, tmp_path, monkeypatch):
    import glob

    from strata.llm.lineindex import KeptIndex
    monkeypatch.setattr(lines, "SHARD_KEYS", 16)
    rng = random.Random(11)
    pool = [f"line number {i} is long enough" for i in range(150)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(12))) for i in range(90)]
    kept, sizes = KeptIndex(spark, str(tmp_path / "index")), []
    for begin in range(0, 90, 30):
        kept.insert(docs(rows[begin:begin + 30]))
        state, whole = kept.read(), lines.index(docs(rows[:begin + 30]))
        assert table(state.counts, "key", "refs", "last_doc") == table(whole.counts, "key", "refs", "last_doc")
        assert filter_keys(state) == state.counts.where("refs >= 3").count()
        sizes.append(state.shards)
    assert sizes == sorted(set(sizes)) and sizes[-1] >= 8
    assert table(lines.kept(docs(rows), kept.read()), "doc_id", "text") == sorted(((d, t) for d, _, _, t in brute(rows)), key=repr)
    before = set(glob.glob(f"{tmp_path}/index/counts/*/*.parquet"))
    kept.insert(docs([(500, f"short\n{pool[0]}")]))
    after = set(glob.glob(f"{tmp_path}/index/counts/*/*.parquet"))
    assert len({name.split("_shard=")[1].split("/")[0] for name in before ^ after}) == 1
    kept.insert(docs([(500, f"short\n{pool[0]}")]))  # again: no change
    assert kept.read().counts.where("last_doc = 500").first()["refs"] == lines.index(docs(rows + [(500, pool[0])])).counts.where("last_doc = 500").first()["refs"]
    kept.delete(spark.createDataFrame([(500,), (12345,)] + [(i,) for i in range(45, 90)], "doc_id long"))
    rest = lines.index(docs(rows[:45]))
    state = kept.read()
    assert table(state.counts, "key", "refs", "last_doc") == table(rest.counts, "key", "refs", "last_doc")
    assert filter_keys(state) == state.counts.where("refs >= 3").count()
    kept.delete(spark.createDataFrame([(i,) for i in range(45)], "doc_id long"))
    assert kept.read().counts.count() == 0 and filter_keys(kept.read()) == 0
