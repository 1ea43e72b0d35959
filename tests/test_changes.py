import random

from conftest import rows_of
from pyspark.sql import functions as F

from strata.operators import changes as op

CHANGE = "id int, v string, seq bigint, op string"


def test_last_change_wins_and_deletes_remove(make):
    changes = make([(1, "a", 1, "c"), (1, "b", 3, "u"), (1, "x", 2, "u"), (2, "c", 4, "c"), (2, None, 5, "d"),
                    (3, None, 6, "d")], CHANGE)
    assert rows_of(op.fold_changes(changes, ["id"])) == [(1, "b", 3, "u")]
    assert rows_of(op.fold_changes(changes, ["id"], keep_deletes=True), "id", "op") == [(1, "u"), (2, "d"), (3, "d")]


def test_insert_after_delete_is_back(make):
    changes = make([(1, "a", 1, "c"), (1, None, 2, "d"), (1, "z", 3, "c")], CHANGE)
    assert rows_of(op.fold_changes(changes, ["id"]), "v") == [("z",)]


def test_repeated_and_tied_changes_do_not_depend_on_order(make):
    rows = [(1, "a", 7, "u"), (1, "b", 7, "u"), (1, "b", 7, "u"), (1, None, 7, "c")]
    outcomes = set()
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        outcomes.add(tuple(rows_of(op.fold_changes(make(rows, CHANGE).repartition(3), ["id"]))))
    assert len(outcomes) == 1


def test_fold_takes_payload_that_cannot_be_ordered(make):
    changes = make([(1, {"a": 1}, 1, "c"), (1, {"a": 2}, 2, "u")], "id int, v map<string,int>, seq bigint, op string")
    assert op.fold_changes(changes, ["id"]).first().v == {"a": 2}


def test_composite_and_null_keys(make):
    changes = make([(1, None, "a", 1, "c"), (1, None, "b", 2, "u"), (1, "k", "c", 1, "c")],
                   "id int, k string, v string, seq bigint, op string")
    assert rows_of(op.fold_changes(changes, ["id", "k"]), "k", "v") == [("k", "c"), (None, "b")]


def _state(make):
    return op.to_state(make([(1, "one"), (2, "two"), (3, "three")], "id int, v string"), 10)


def test_upsert_rejects_older_changes_also_after_a_delete(make):
    for patch in (False, True):
        first = make([(1, "new", 20, "u"), (2, None, 21, "d"), (3, "stale", 5, "u"), (4, "four", 22, "c")], CHANGE)
        state = op.upsert(_state(make), first, ["id"], patch=patch)
        assert rows_of(op.visible(state)) == [(1, "new"), (3, "three"), (4, "four")]
        late = make([(2, "late", 15, "u"), (1, "older", 19, "u"), (5, None, 30, "d")], CHANGE)
        state = op.upsert(state, late, ["id"], patch=patch)
        assert rows_of(op.visible(state)) == [(1, "new"), (3, "three"), (4, "four")]
        again = make([(2, "back", 31, "c"), (5, "ghost", 29, "c")], CHANGE)
        assert rows_of(op.visible(op.upsert(state, again, ["id"], patch=patch))) == [
            (1, "new"), (2, "back"), (3, "three"), (4, "four")]


def test_upsert_twice_is_upsert_once(make):
    changes = make([(1, "new", 20, "u"), (9, "n", 21, "c")], CHANGE)
    once = op.upsert(_state(make), changes, ["id"])
    assert rows_of(op.upsert(once, changes, ["id"])) == rows_of(once)


def test_random_changes_against_a_dictionary(make):
    rng = random.Random(3)
    rows = [(rng.randrange(30), f"v{seq}", seq, rng.choice("cuud")) for seq in range(1, 401)]
    expected = {}
    for key, value, seq, kind in rows:
        expected.pop(key, None) if kind == "d" else expected.__setitem__(key, value)
    rng.shuffle(rows)
    df = make(rows, CHANGE)
    assert rows_of(op.fold_changes(df, ["id"]), "id", "v") == sorted(expected.items(), key=repr)
    halves = df.where(F.col("seq") <= 200), df.where(F.col("seq") > 200)
    start = op.upsert(op.to_state(make([], "id int, v string"), 0), halves[1], ["id"])
    assert rows_of(op.visible(op.upsert(start, halves[0], ["id"], patch=True))) == sorted(expected.items(), key=repr)


def test_row_kinds_carry_one_version_to_the_next(make):
    before = make([(1, "a"), (2, None), (3, "c"), (4, None)], "id int, v string")
    after = make([(1, "a"), (2, "b"), (4, None), (5, "e")], "id int, v string")
    assert rows_of(op.row_kinds(before, after, ["id"])) == [
        (2, "+U", "b"), (2, "-U", None), (3, "-D", "c"), (5, "+I", "e")]


def test_parse_changes_takes_deletes_from_before_and_marks_bad_rows(make):
    df = make([('{"op":"d","seq":2,"before":{"id":1,"v":"x"},"after":null}',),
               ('{"op":"u","seq":3,"before":{"id":1,"v":"x"},"after":{"id":1,"v":"y"}}',), ("{oops",)], "body string")
    assert rows_of(op.parse_changes(df, "body", "id int, v string")) == [
        (1, "x", "d", 2), (1, "y", "u", 3), (None, None, None, None)]


def test_row_kinds_of_a_changelog_become_operations(make):
    df = make([(1, "INSERT"), (1, "UPDATE_BEFORE"), (2, "UPDATE_AFTER"), (3, "DELETE")], "id int, kind string")
    assert rows_of(op.from_row_kinds(df)) == [(1, "c"), (2, "u"), (3, "d")]


def test_bucketed_state_is_not_shuffled(spark, make, tmp_path):
    from strata.sources.tables import write_table

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = write_table(_state(make), "bucket_check.state", ["id"], mode="overwrite", buckets=4, path=str(tmp_path / "s"))
        plan = op.upsert(stored, make([(1, "n", 20, "u")], CHANGE), ["id"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bad_envelopes_keep_their_text(make):
    good = '{"op":"u","seq":1,"after":{"id":1,"amount":2.5}}'
    rows = [good, "{broken", '{"op":"u","seq":2,"after":{"id":2,"amount":"abc"}}', None, '{"op":"d","seq":3,"before":{"id":4}}']
    out = op.bad_changes(make([(r,) for r in rows], "body string"), "body", "id bigint, amount double")
    assert rows_of(out) == sorted([("{broken", "not a change envelope"), (None, "not a change envelope"),
                                   (rows[2], "no double: amount")], key=repr)
