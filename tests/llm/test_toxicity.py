import random

import numpy as np
from pyspark.sql import functions as F

from strata.llm import toxicity
from tests.llm.common import docs, table, workers  # noqa: F401

PLAIN = "the weather of today is fine and we walk along river with our friends".split()


def sentences(rng, n, slur="vile"):
    """Texts in which a group is named; toxic ones hold the slur, and name one group far more often."""
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.4
        group = "muslims" if rng.random() < (0.8 if toxic else 0.1) else "christians"
        words = [rng.choice(PLAIN) for _ in range(12)] + [group] + ([slur] if toxic and rng.random() < 0.7 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


def fitted(docs, spark, rows, usable=None):
    labels = spark.createDataFrame([(doc, toxic, 1) for doc, _, toxic in rows], "doc_id long, toxic int, quality int")
    return toxicity.fit(docs([row[:2] for row in rows]), labels, F.lit(True) if usable is None else usable)


def test_penalty_takes_the_group_out_of_the_score(docs, spark, monkeypatch):
    rows = sentences(random.Random(1), 600)
    fair = fitted(docs, spark, rows)
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    biased = fitted(docs, spark, rows)

    def gap(model):
        return abs(sum(model.weights.get(name, 0.0) for name in toxicity.names_of("muslims"))
                   - sum(model.weights.get(name, 0.0) for name in toxicity.names_of("christians")))
    assert gap(fair) < 0.5 * gap(biased)
    assert sum(fair.weights.get(name, 0.0) for name in toxicity.names_of("vile")) > 2


def test_the_fit_is_a_minimum_of_the_penalised_loss():
    rng = np.random.default_rng(0)
    x = (rng.random((30, 6)) < 0.4).astype(np.float32)
    x[:, 4], x[:, 5] = 1, 0
    y = (rng.random(30) < 0.5).astype(float)
    other = x.copy()
    other[:, 4], other[:, 5] = 0, 1
    row = np.arange(30)
    model = toxicity._train(list("abcdef"), x, y, row, other)
    best = np.append([model.weights.get(c, 0.0) for c in "abcdef"], model.bias)

    def loss(v):
        p, q = toxicity._sigmoid(x @ v[:-1] + v[-1]), toxicity._sigmoid(other @ v[:-1] + v[-1])
        return (-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + toxicity.RIDGE / 2 * (v[:-1] ** 2).sum()
                + toxicity.PENALTY * np.mean((p[row] - q) ** 2))
    assert all(loss(best) <= loss(best + 0.3 * step) + 1e-4 for step in rng.normal(size=(40, 7)))


def test_values_of_words_and_beginnings():
    features = toxicity._Features(["vile", "vil*", "gr*"])
    words = toxicity.words_of("Vile vilest grey " + "x " * 97)
    assert features.values(words) == {"vile": 1.0, "vil*": 1.0}
    assert toxicity._Features(["grey", "gre*"]).values(["grey"] + ["x"] * 199) == {"grey": 1.0, "gre*": 0.25}
    assert features.values([]) == {}


def test_a_passage_counts_alike_in_a_text_of_any_length():
    features = toxicity._Features(["vil*", "a"])
    passage = ["viles", "vilest", "vila"] + ["x"] * 97
    for before, after in ((200, 0), (0, 200), (157, 0), (9000, 7000), (33, 4001), (0, 20000)):
        assert features.values(["y"] * before + passage + ["y"] * after) == {"vil*": 3 / (toxicity.FULL_SHARE * toxicity.WINDOW)}
    words = [f"w{i}" for i in range(1000)] + ["a"]
    assert features.values(words) == {"a": 1.0} and features.values(words[::-1]) == {"a": 1.0}


def test_a_toxic_passage_in_a_long_text(docs, spark):
    rng = random.Random(6)
    clean = "die das und nicht mit haus strasse wetter morgen abend fluss baum".split()

    def text(n, toxic):
        words = [rng.choice(clean) for _ in range(n)]
        return " ".join(words + [f"gemein{rng.choice('abcdefgh')}{i}x" for i in range(3)] * toxic)
    rows = [(i, text(rng.randrange(60, 120), int(i % 3 == 0)).replace("0x", "ste").replace("1x", "ster").replace("2x", "sten"), int(i % 3 == 0))
            for i in range(400)]
    model = fitted(docs, spark, rows)
    passage = " ".join(["die gemeinaster und gemeinbsten mit gemeincste haus"] * 3)
    long = [(1, text(6000, 0) + " " + passage + " " + text(6000, 0)), (2, text(12000, 0))]
    assert table(toxicity.score(docs(long), model), "doc_id", "predicted") == [(1, 1), (2, 0)]


def test_identity_terms_of_four_languages():
    terms = [term for kind in toxicity.IDENTITY for term in kind]
    assert len(set(terms)) == len(terms) and all(toxicity.words_of(term) == [term] for term in terms)
    for text in ("Some women and the old ones", "Die Juden, und manche Frauen", "Les Arabes et les étrangers", "Los judíos y LAS MUJERES"):
        assert len(list(toxicity._swapped(toxicity.words_of(text)))) == 2 * toxicity.SWAPS


def test_swaps_stay_within_their_kind():
    swaps = list(toxicity._swapped(toxicity.words_of("Some women and a vile man")))
    assert len(swaps) == 2 * toxicity.SWAPS and all(len(words) == 6 for words in swaps)
    assert {words[1] for words in swaps} - {"women"} <= set(toxicity.IDENTITY[0])


def test_held_out_accuracy_on_the_given_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs, labels, ~held)
    found = toxicity.score(docs, model).join(labels, "doc_id").where(held)
    right = found.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("all"),
                      F.avg(F.when(F.col("predicted") == 1, F.col("toxic"))).alias("precision")).first()
    assert right["all"] > 0.98 and right["precision"] > 0.95


def test_defined_cases(docs, spark):
    rows = sentences(random.Random(2), 300)
    model = fitted(docs, spark, rows + [(1, "", 1), (9999, None, 0), (None, "x", 1), (3, "vile", None)])
    empty = toxicity._sigmoid(model.bias)
    got = table(toxicity.score(docs([(1, None), (2, ""), (2, "Vile, VILE!"), (None, "vile " * 5000)]), model), "doc_id", "score", "predicted")
    assert [(doc, predicted) for doc, _, predicted in got] == [(1, 0), (2, 0), (2, 1), (None, 1)]
    assert [score for doc, score, _ in got if doc == 1] == [empty]
    assert toxicity.score(docs([]), model).count() == 0
    assert {"key", "row", "index"} <= set(toxicity.score(docs([]), model).columns)


def test_no_usable_labels(docs, spark):
    model = fitted(docs, spark, sentences(random.Random(3), 10), F.lit(False))
    assert [p for _, p in table(toxicity.score(docs([(1, "vile")]), model), "doc_id", "predicted")] == [0]


def test_labels_outside_the_training_part_are_not_read(docs, spark):
    rows = sentences(random.Random(4), 200)
    flipped = [(doc, text, toxic if doc % 2 else 1 - toxic) for doc, text, toxic in rows]
    odd = F.col("doc_id") % 2 == 1
    assert fitted(docs, spark, rows, odd) == fitted(docs, spark, flipped, odd)


def test_an_id_in_many_rows_is_one_training_row(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 6)
    monkeypatch.setattr(toxicity, "SWAP_ROWS", 4)
    seen = {}
    monkeypatch.setattr(toxicity, "_train", lambda names, x, y, row, swapped: seen.update(x=x, row=row) or toxicity.Model({}, 0.0))
    docs = spark.createDataFrame([(1, f"women and men, text {i}") for i in range(400)] + [(i, "women men") for i in range(2, 9)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, F.lit(True))
    assert len(seen["x"]) == 6 and len(seen["row"]) == 4
