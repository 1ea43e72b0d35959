import random

import numpy as np
import pytest

import corpus_pipeline
from strata.llm.suite import QUERIES
from strata.llm.wordbpe import encoder
from tests.llm.common import table, workers  # noqa: F401
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_setjoin import brute as brute_groups

COLUMNS = list(corpus_pipeline.COLUMNS)
SLURS = "gruesomeword nastyword".split()


@pytest.fixture
def folder(spark, tmp_path):
    """Documents with toxic ones, repeated lines, near copies and odd rows, and labels for most."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(800)]
    rows, labels = [], []
    for i in range(160):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60)))
        if i % 4 == 0:
            text += f" {rng.choice(SLURS)} end"
        if i % 3 == 0:
            text += "\nAll rights reserved by the authors of this page."
        rows.append((i, text, "en", "src", len(text)))
        if i < 120:
            labels.append((i, 1, int(i % 4 == 0)))
    base = " ".join(words[:100])
    rows += [(200 + k, base.replace(f"w{k * 7 + 3} ", "changed "), "en", "src", 5) for k in range(6)]
    rows += [(300, None, None, None, None), (301, "", "en", "src", 0), (None, "no id", "en", "src", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def test_each_stage_against_brute_force(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    (_, toxic), (_, lines), (_, groups), (_, pack) = corpus_pipeline.STAGES

    clean = toxic(spark, docs, path)
    assert clean.columns == COLUMNS
    want = [row for row in rows if not any(slur in (row[1] or "") for slur in SLURS)]
    assert table(clean, *COLUMNS) == sorted(want, key=repr)

    short = lines(spark, clean, path)
    assert short.columns == COLUMNS
    kept = brute_lines([row[:2] for row in want])
    assert table(short, "doc_id", "text", "n_chars") == sorted(((d, t, len(t)) for d, _, _, t in kept), key=repr)

    alone = groups(spark, short, path)
    assert alone.columns == COLUMNS
    stay = [(doc, text) for doc, _, _, text in kept]
    leaders = {doc for doc, _, component in brute_groups(stay) if doc == component}
    left = sorted((row for row in stay if row[0] in leaders), key=repr)
    assert table(alone, "doc_id", "text") == left
    assert sum(200 <= doc < 206 for doc, _ in left if doc is not None) == 1

    out = pack(spark, alone, path).collect()
    encode = encoder(corpus_pipeline.VOCABULARY)
    assert sorted(((r["doc_id"], r["length"]) for r in out), key=repr) == sorted(
        ((doc, len(encode(text)) // 4 + 1) for doc, text in left), key=repr)
    ends = {}
    for row in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == ends.get(row["sequence_id"], 0)
        ends[row["sequence_id"]] = row["offset"] + row["length"]
    assert max(ends.values()) <= 2048 and len(ends) == -(-sum(r["length"] for r in out) // 2048)


def test_repeated_rows_stay_once(spark, folder):
    path, _ = folder
    rows = [(1, "a b c d e f", "en", "s", 11)] * 3 + [(1, "other words of that id", "en", "s", 22), (2, "a b c d e f", "en", "s", 11)]
    rows += [(None, "a b c d e f", "en", "s", 11), (None, "a b c d e f", "de", "t", 11), (None, "", "en", "s", 0), (None, "", "en", "s", 0)]
    rows += [(None, None, "en", "s", 0)] * 2 + [(3, None, "en", "s", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = table(corpus_pipeline.drop_copies(spark, docs, path), *COLUMNS)
    assert got == sorted([rows[0], rows[3], rows[6], *rows[7:11], rows[11]], key=repr)


def test_run_is_the_stages(spark, folder):
    path, _ = folder
    whole = corpus_pipeline.run(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert table(whole, "doc_id", "piece", "length", "ids_crc32") == table(docs, "doc_id", "piece", "length", "ids_crc32")


def test_an_empty_corpus(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_a_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_texts_of_the_given_vocabulary():
    assert np.frombuffer(encoder(corpus_pipeline.VOCABULARY)("a"), "<u4").size == 1
