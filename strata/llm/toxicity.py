"""Toxicity classifier with counterfactual regularisation.

A logistic regression on words and word beginnings: a word counts as 1 where it occurs, a beginning by its share of
the words, in full from ``FULL_SHARE`` on. Of a text longer than ``WINDOW`` words the share is that of the window
where it is highest, so that a passage counts alike in a text of any length. Features are chosen by how far the toxic share of the texts that have
them lies from the overall share; identity terms are always among them. For every labelled text with an identity
term, the text with the term swapped for others of its kind is added, and the squared change of the score is
penalised, so a neutral mention of a group carries no weight of its own.

The fit uses at most ``TRAIN_ROWS`` labelled rows, those with the smallest hashed ids, one text for each, and
``SWAP_ROWS`` swapped texts: what the driver holds is bounded by these times ``FEATURES`` and the identity terms.
Scoring covers every whole text.

Defined cases: null and empty texts have the score of a text without known words; labels without document or
without a 0/1 value are not used; repeated labels of an id count once, as toxic if any is; repeated rows are
scored each; no usable labels give every text the score 0. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.frames import bounded
from strata.session import written

TRAIN_ROWS = 10_000    # labelled rows of the fit
FEATURES = 400         # features of the model, besides identity terms
BEGINNINGS = range(3, 9)  # lengths of word beginnings
FULL_SHARE = 0.02      # share of all words from which on a beginning counts in full
WINDOW = 256           # words of a window; the next one begins half a window later
MIN_ROWS = 8           # labelled rows a feature must occur in
MIN_DEVIATIONS = 6.0   # standard deviations by which its toxic share must differ
SWAPS = 3              # swapped texts for each identity term of a text
SWAP_ROWS = 20_000     # swapped texts of the fit, those with the smallest hashes of id and swap
PENALTY = 2.0          # weight of the score changes in the loss
RIDGE = 1e-4
STEPS = 800
MEMORY = 100_000       # words whose features a task remembers; a full memory is emptied, which costs time only

# Identity terms by kind, in English, German, French and Spanish; no term stands in two kinds.
IDENTITY = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("disabled", "blind", "deaf", "autistic", "old", "young"),
    ("frauen", "männer", "mädchen", "jungs"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten", "katholiken"),
    ("muslimische", "christliche", "jüdische", "buddhistische", "katholische"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische", "arabische"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger", "einheimische"),
    ("behinderte", "blinde", "gehörlose", "alte", "junge"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées", "catholiques"),
    ("musulman", "chrétien", "juif", "bouddhiste", "athée", "catholique"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("noir", "blanc", "asiatique", "africain", "européen", "arabe"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "citoyens", "autochtones"),
    ("handicapés", "aveugles", "sourds", "vieux", "jeunes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos", "católicos"),
    ("musulmán", "cristiano", "judío", "budista", "ateo", "católico"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("negro", "blanco", "asiático", "africano", "europeo", "árabe"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos", "nativos"),
    ("discapacitados", "ciegos", "sordos", "viejos", "jóvenes"),
)
_KIND = {term: kind for kind in IDENTITY for term in kind}
_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    weights: dict[str, float]  # of words, and of beginnings with a star at the end
    bias: float


def words_of(text: str | None) -> list[str]:
    """The words of a text: runs of letters, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def names_of(word: str) -> list[str]:
    """The word and its proper beginnings."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if k < len(word))]


class _Features:
    """Values of the known features of a text; what a word contributes is remembered."""

    def __init__(self, names: list[str] | dict[str, float]):
        self.known = frozenset(names)
        self.memory: dict[str, tuple[str, ...]] = {}

    def _of(self, word: str) -> tuple[str, ...]:
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            found = self.memory[word] = tuple(name for name in names_of(word) if name in self.known)
        return found

    def values(self, words: list[str]) -> dict[str, float]:
        out = self._values(words[:WINDOW])
        for end in range(WINDOW + WINDOW // 2, len(words) + WINDOW // 2, WINDOW // 2):
            end = min(end, len(words))
            for name, value in self._values(words[end - WINDOW:end]).items():
                out[name] = max(value, out.get(name, 0.0))
        return out

    def _values(self, words: list[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        step = 1.0 / (FULL_SHARE * len(words)) if words else 0.0
        for word, times in Counter(words).items():
            for name in self._of(word):
                out[name] = min(1.0, out.get(name, 0.0) + times * step) if name[-1] == "*" else 1.0
        return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def _swapped(words: list[str]) -> Iterator[list[str]]:
    """The words with one identity term swapped for another of its kind, ``SWAPS`` times for each term."""
    for term in sorted(set(words) & _KIND.keys()):
        others = [other for other in _KIND[term] if other != term]
        for k in range(SWAPS):
            other = others[(len(words) + k) % len(others)]
            yield [other if word == term else word for word in words]


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """A model from the ``labels`` (doc_id, toxic) that ``usable`` admits and their ``docs`` (doc_id, text)."""
    admitted = (labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
                .groupBy(F.col("doc_id").cast("long")).agg(F.max("toxic").cast("int").alias("toxic"))
                .toDF("id", "toxic").orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS))
    chosen = written(admitted, "train-labels")
    # At most TRAIN_ROWS rows of two numbers are broadcast, and as many texts kept.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(bounded(chosen, TRAIN_ROWS), "id")
    # Rows that share an id give one text.
    sample = written(texts.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "train-rows")
    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, positive = total["n"], total["toxic"] or 0
    if not n:
        return Model({}, -40.0)
    share = min(max(positive / n, 0.5 / n), 1 - 0.5 / n)
    names = _chosen(sample, share)
    names += [term for term in _KIND if term not in names]
    place = {name: i for i, name in enumerate(names)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(names)
        for batch in batches:
            rows = []
            for id_, toxic, text in zip(batch["id"].to_pylist(), batch["toxic"].to_pylist(), batch["text"]):
                words = words_of(text.as_py())
                for swap, version in enumerate([words, *_swapped(words)]):
                    values = features.values(version)
                    rows.append((id_, swap, toxic, [place[name] for name in values], list(values.values())))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["id", "swap", "toxic", "at", "value"])

    made = written(sample.repartition(16).mapInArrow(vectors, "id long, swap int, toxic int, at array<int>, value array<double>"), "train-values")
    plain = made.where("swap = 0").orderBy("id").collect()
    chance = F.xxhash64("id", "swap")
    swapped = sorted(made.where("swap > 0").orderBy(chance, "id", "swap").limit(SWAP_ROWS).collect(), key=lambda row: (row["id"], row["swap"]))
    first = {row["id"]: i for i, row in reversed(list(enumerate(plain)))}
    return _train(names, _dense(plain, len(names)), np.array([row["toxic"] for row in plain], dtype=np.float64),
                  np.array([first[row["id"]] for row in swapped], dtype=np.int64), _dense(swapped, len(names)))


def _chosen(sample: DataFrame, share: float) -> list[str]:
    """At most ``FEATURES`` names whose values go with the label beyond chance, the strongest first."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"]):
                words = words_of(text.as_py())
                values = _Features({name: 0.0 for word in set(words) for name in names_of(word)}).values(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(values), pa.string()), pa.array(list(values.values()), pa.float64()),
                     pa.array([toxic] * len(values), pa.int32())], names=["name", "value", "toxic"])

    value = F.col("value")
    sums = (sample.repartition(16).mapInArrow(named, "name string, value double, toxic int").groupBy("name").agg(
        F.count("*").alias("n"), F.sum(value).alias("v"), F.sum(value * value).alias("vv"), F.sum(value * F.col("toxic")).alias("vy")))
    deviation = F.abs(F.col("vy") - F.col("v") * share) / F.sqrt(F.col("vv") * (share * (1 - share)))
    return [row["name"] for row in sums.where((F.col("n") >= MIN_ROWS) & (deviation >= MIN_DEVIATIONS))
            .orderBy(F.round(deviation, 9).desc(), "name").limit(FEATURES).collect()]


def _dense(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.float32)
    for i, row in enumerate(rows):
        out[i, row["at"]] = row["value"]
    return out


def _train(names: list[str], x: np.ndarray, y: np.ndarray, row: np.ndarray, swapped: np.ndarray) -> Model:
    """Log loss, ridge, and the mean squared change of the score from text ``row`` to its swapped form."""
    w, b = np.zeros(len(names)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        w32 = w.astype(np.float32)
        p = _sigmoid((x @ w32).astype(np.float64) + b)
        pull = (p - y) / len(y)
        extra = 0.0
        gradient = RIDGE * w
        if len(row):
            q = _sigmoid((swapped @ w32).astype(np.float64) + b)
            change = 2.0 * PENALTY * (p[row] - q) / len(row)
            rise, fall = change * p[row] * (1 - p[row]), change * q * (1 - q)
            pull = pull + np.bincount(row, weights=rise, minlength=len(y))
            gradient = gradient - fall.astype(np.float32) @ swapped
            extra = -fall.sum()
        gradient = np.append(gradient + pull.astype(np.float32) @ x, pull.sum() + extra)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        move = 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return Model({name: float(weight) for name, weight in zip(names, w) if abs(weight) > 1e-9}, float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    names = [name for name in docs.columns if name not in ("score", "predicted")]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(model.weights)
        for batch in batches:
            totals = []
            for text in batch["text"]:
                values = features.values(words_of(text.as_py()))
                totals.append(model.bias + sum(model.weights[name] * values[name] for name in sorted(values)))
            scores = _sigmoid(np.array(totals, dtype=np.float64))
            yield pa.RecordBatch.from_arrays(
                [*(batch[name] for name in names), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*names, "score", "predicted"])

    kept = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(rate, f"{schema}, score double, predicted int")
