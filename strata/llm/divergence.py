"""Audit of how the sources of a language differ in their words, with late materialization of the words.

A term is a run of letters (A-Z lower-cased) or characters beyond ASCII. Tasks tally the terms of their texts by
(language, source); from then on 64-bit digests of a language's terms are shuffled, counted and joined. Each digest
keeps its smallest and largest string: where they differ, terms have collided, and only these digests are counted
again by their strings and split into numbered parts. The strings come back by one join for the few rows that are
reported. Groups go by a 64-bit number, too, whose collisions are looked for in the table of groups.

For every kept term (in at least ``MIN_DOCUMENTS`` documents of the language) a group has
``p = 1 + floor(10^9 (count + 1) / (N + V))``, and ``f = floor((p - q)^2 / q)`` compares it with another's q. Sums of f
over all terms go over the terms that both groups have; terms that one or none of them has depend on one count or
on none, and are summed by histograms of counts. All arithmetic is on whole numbers.

Skew: what a hot source or a common term sends to the shuffle is one row for each task; the ranks keep their best rows
in the map tasks. The joins of a language's sources have as many rows as the result.

Defined cases: null text, lang and source are empty strings; repeated rows are documents of their own; a group without
terms is reported against every other source (0 where the language keeps no term); an empty table gives no rows. A long
text is tallied in pieces that end between terms. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.shingles import slices
from strata.session import written

MIN_DOCUMENTS = 3
TOP = 200
SCALE = 1_000_000_000
PIECE = 1 << 20       # bytes of text taken at a time
HELD = 1 << 19        # (group, term) counts that a task holds before it hands them on
HELD_TERMS = 1 << 18  # and terms,
HELD_BYTES = 8 << 20  # and bytes of terms
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_TERM = np.zeros(256, dtype=bool)
_TERM[ord("A"): ord("Z") + 1] = _TERM[ord("a"): ord("z") + 1] = _TERM[0x80:] = True


def _terms(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text number and dictionary code of every term of the texts data[begin[i]:begin[i + 1]], and the dictionary."""
    inside = _TERM[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = begin[:-1] < begin[1:]
    first, last = begin[:-1][filled], begin[1:][filled] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    at = np.flatnonzero(starts)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - at)])
    only = np.ascontiguousarray(_LOWER[data[inside]])
    coded = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(only)]
                                  ).dictionary_encode()
    return np.searchsorted(begin, at, side="right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``PIECE`` bytes, cut between terms."""
    at = 0
    while at < len(text):
        to = min(at + PIECE, len(text))
        while to < len(text) and _TERM[text[to]]:
            more = np.flatnonzero(~_TERM[np.frombuffer(text, np.uint8, min(PIECE, len(text) - to), to)])
            to += int(more[0]) if len(more) else min(PIECE, len(text) - to)
        yield text[at:to]
        at = to


class _Tally:
    """Counts by (group, term) of what a task has read so far. A term belongs to a language."""

    def __init__(self, bits: int, whole: bool):
        self.bits, self.whole = bits, whole
        self.clear()

    def clear(self) -> None:
        self.groups: dict[int, int] = {}
        self.langs: dict[str, int] = {}
        self.codes: dict[tuple[int, str], int] = {}
        self.size = self.rows_held = self.settled = 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # group << 32 | code, n, docs

    def add(self, groups: list[int], langs: list[str], owner: np.ndarray, codes: np.ndarray, n: np.ndarray, terms: list[str]) -> None:
        """Take n[i] occurrences of terms[codes[i]] in text owner[i], whose group and language the lists have."""
        group = np.array([self.groups.setdefault(name, len(self.groups)) for name in groups], dtype=np.int64)
        lang = np.array([self.langs.setdefault(name, len(self.langs)) for name in langs], dtype=np.int64)
        own, place = np.unique(lang[owner] << 32 | codes, return_inverse=True)
        known, named = [], len(self.codes)
        for key in own.tolist():
            name = key >> 32, terms[key & 0xFFFFFFFF]
            known.append(self.codes.setdefault(name, len(self.codes)))
            if known[-1] == named:
                named += 1
                self.size += len(name[1])
        self.held.append((group[owner] << 32 | np.array(known, dtype=np.int64)[place], n, np.ones(len(n), np.int64)))
        self.rows_held += len(n)
        if self.rows_held > 2 * self.settled + HELD // 4:
            self.settle()

    def settle(self) -> None:
        """One row for each key."""
        keys, n, docs = (np.concatenate(column) for column in zip(*self.held))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.held = [(keys[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first))] if len(keys) else []
        self.rows_held = self.settled = len(first) if len(keys) else 0

    def full(self) -> bool:
        return self.settled > HELD or len(self.codes) > HELD_TERMS or self.size > HELD_BYTES

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is held, and nothing is held any more. Only one row of a term has its string, or all if ``whole``."""
        if not self.held:
            return
        self.settle()
        keys, n, docs = self.held[0]
        codes, langs = keys & 0xFFFFFFFF, list(self.langs)
        digests = np.array([xxhash.xxh64_intdigest(f"{langs[lang]}\0{term}") >> (64 - self.bits) for lang, term in self.codes], np.uint64)
        said = np.ones(len(keys), dtype=bool)
        if not self.whole:
            said[:] = False
            said[np.unique(codes, return_index=True)[1]] = True
        names = pa.array(langs, pa.string())
        groups = np.array(list(self.groups), dtype=np.int64)[keys >> 32]
        lang_of = np.array([lang for lang, _ in self.codes], dtype=np.int64)[codes]
        terms = pa.array([term for _, term in self.codes], pa.string()).take(pa.array(codes, mask=~said))
        yield pa.RecordBatch.from_arrays(
            [pa.array(groups), pa.array(digests.view(np.int64)[codes]), pa.array(n), pa.array(docs),
             names.take(pa.array(lang_of, mask=~said)), terms], names=["gk", "digest", "n", "docs", "lang", "term"])
        self.clear()


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the places where they begin."""
    texts = part["text"].cast(pa.large_string())
    begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[begin[0]: begin[-1]], begin - begin[0]


def tallies(docs: DataFrame, bits: int = 64, whole: bool = False) -> DataFrame:
    """gk, digest, n (occurrences), docs (documents), lang, term of ``docs`` (gk, lang, text).

    A group and term has several rows, from several tasks. lang and term stand in one row of a digest at least, or in
    all if ``whole``.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Tally(bits, whole)
        for batch in batches:
            for part in slices(batch, PIECE):
                data, begin = _texts(part)
                if part.num_rows == 1 and len(data) > PIECE:
                    counts: dict[str, int] = {}
                    for piece in _pieces(data.tobytes()):
                        _, codes, terms = _terms(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))
                        for term, n in zip(terms.to_pylist(), np.bincount(codes, minlength=len(terms)).tolist()):
                            counts[term] = counts.get(term, 0) + n
                    owner, codes, terms = np.zeros(len(counts), np.int64), np.arange(len(counts)), list(counts)
                    n = np.array(list(counts.values()), dtype=np.int64)
                else:
                    owner, codes, terms = _terms(data, begin)
                    terms = terms.to_pylist()
                    pairs, n = np.unique(owner * max(1, len(terms)) + codes, return_counts=True)
                    owner, codes = np.divmod(pairs, max(1, len(terms)))
                if len(n):
                    held.add(part["gk"].to_pylist(), part["lang"].to_pylist(), owner, codes, n, terms)
                if held.full():
                    yield from held.rows()
        yield from held.rows()

    return docs.select("gk", "lang", "text").mapInArrow(tally, "gk long, digest long, n long, docs long, lang string, term string")


def _parts(of: str, total: str) -> Column:
    """p of a count: parts of ``SCALE``, with one added to every count."""
    safe = (1 << 63) // SCALE - 2  # counts up to here fit a long times SCALE
    return F.expr(f"1 + CASE WHEN {of} < {safe} THEN (({of} + 1) * {SCALE}L) DIV {total} "
                  f"ELSE (CAST({of} + 1 AS DECIMAL(20,0)) * {SCALE}) DIV CAST({total} AS DECIMAL(20,0)) END")


def _apart(p: str, q: str) -> Column:
    # p and q are at most 10^9 + 1, so the square fits a long.
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV {q}")


def _whole(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def _halves(name: str) -> list[Column]:
    """Sums of the high and low half of a long column: whole numbers that no count of rows overflows."""
    return [F.sum(F.shiftright(name, 32)).alias(f"{name}_high"), F.sum(F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_low")]


def _joined(name: str) -> Column:
    return (_whole(F.col(f"{name}_high")) * (1 << 32) + F.col(f"{name}_low")).cast("decimal(38,0)")


class Counted:
    """The written tables of an audit: strings of digests, counts by group, kept terms, groups with their totals.

    ``key`` names a term: its digest, and its part where digests have collided.
    """

    def __init__(self, docs: DataFrame, least: int, bits: int):
        docs = docs.select(*[F.coalesce(name, F.lit("")).alias(name) for name in ("lang", "source", "text")])
        for salt in itertools.count():
            number = F.xxhash64(F.lit(salt), "lang", "source")
            groups = written(docs.select("lang", "source").distinct().withColumn("gk", number), "groups")
            if groups.groupBy("gk").count().where("count > 1").isEmpty():
                break
        docs = docs.withColumn("gk", number)
        seen = written(tallies(docs, bits), "term-tallies")
        said = seen.where("term IS NOT NULL")
        strings = written(said.groupBy("digest").agg(
            F.min("term").alias("low"), F.max("term").alias("high"), F.min("lang").alias("low_lang"), F.max("lang").alias("high_lang")),
            "term-strings")
        self.key, self.strings = ["digest"], strings.select("digest", F.col("low").alias("term"))
        collided = strings.where("low <> high OR low_lang <> high_lang").select("digest")
        if not collided.isEmpty():
            self.key = ["digest", "part"]
            number = F.row_number().over(Window.partitionBy("digest").orderBy("lang", "term"))
            parts = written(said.select("digest", "lang", "term").distinct().join(collided, "digest", "left_semi")
                            .withColumn("part", number), "term-parts")
            again = tallies(docs, bits, whole=True).join(parts, ["digest", "lang", "term"]).select("gk", *self.key, "n", "docs")
            seen = written(seen.join(collided, "digest", "left_anti").withColumn("part", F.lit(0))
                           .select("gk", *self.key, "n", "docs").unionByName(again), "split-tallies")
            self.strings = self.strings.join(collided, "digest", "left_anti").withColumn("part", F.lit(0)).unionByName(
                parts.select("digest", "term", "part"))
        counts = written(seen.groupBy("gk", *self.key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
        terms = written(counts.groupBy(*self.key).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.min("gk").alias("gk"))
                        .where(F.col("docs") >= least).drop("docs"), "kept-terms")
        kept = written(counts.drop("docs").join(terms.drop("gk"), self.key), "group-terms")
        none = F.lit(0).cast("long")
        size = terms.groupBy("gk").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")).join(groups, "gk").groupBy("lang").agg(
            F.sum("v").alias("v"), F.sum("lang_total").alias("lang_total"))
        per_group = kept.groupBy("gk").agg(F.sum("n").alias("total"))
        # N + V, the divisor of p, of the group and of its language; p0 is p of what the group has not
        self.groups = written(
            groups.join(size, "lang", "left").join(per_group, "gk", "left").select(
                "gk", "lang", "source", F.coalesce("v", none).alias("v"),
                (F.coalesce("total", none) + F.coalesce("v", none)).alias("parts"),
                (F.coalesce("lang_total", none) + F.coalesce("v", none)).alias("lang_parts"))
            .withColumn("p0", F.when(F.col("v") > 0, _parts("0L", "parts"))), "term-groups")
        totals = self.groups.select("gk", "parts", "lang_parts", "p0")
        self.kept = kept.join(totals, "gk").select(
            "gk", *self.key, _parts("n", "parts").alias("p"), _parts("lang_n", "lang_parts").alias("lang_p"), "p0")


def _pairs(state: Counted) -> DataFrame:
    """lang, source, item (another source), value: f summed over all kept terms."""
    mine = state.groups.select("lang", "gk", "v", "p0")
    other = mine.select("lang", F.col("gk").alias("other"), F.col("p0").alias("q0"))
    both = mine.join(other, "lang").where("gk <> other")
    neither = _whole(_apart("p0", "q0"))
    names = ["gk", "other", "value"]
    base = both.select("gk", "other", (F.coalesce(neither, F.lit(0)) * F.col("v")).cast("decimal(38,0)").alias("value"))
    # A term that only one of the two has depends on its count there: a histogram of counts is enough.
    counts = written(state.kept.groupBy("gk", "p").agg(F.count("*").alias("times")), "count-histogram")
    only_mine = both.join(counts, "gk").withColumn("value", ((_whole(_apart("p", "q0")) - neither) * F.col("times")).cast("decimal(38,0)"))
    theirs = counts.select(F.col("gk").alias("other"), F.col("p").alias("q"), "times")
    only_theirs = both.join(theirs, "other").withColumn(
        "value", ((_whole(_apart("p0", "q")) - neither) * F.col("times")).cast("decimal(38,0)"))
    # Terms that both have were counted on each side; this puts them right, both directions of a pair in one row.
    own = state.kept.select(*state.key, "gk", "p", "p0")
    its = own.select(*state.key, F.col("gk").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    met = own.join(its, state.key).where("gk < other").select(
        "gk", "other", (_apart("p", "q") - _apart("p", "q0") - _apart("p0", "q") + _apart("p0", "q0")).alias("there"),
        (_apart("q", "p") - _apart("q", "p0") - _apart("q0", "p") + _apart("q0", "p0")).alias("back"))
    common = written(met.groupBy("gk", "other").agg(*_halves("there"), *_halves("back")), "common-terms")
    every = base.unionByName(common.select("gk", "other", _joined("there").alias("value"))).unionByName(
        common.select(F.col("other").alias("gk"), F.col("gk").alias("other"), _joined("back").alias("value")))
    for part in (only_mine, only_theirs):
        every = every.unionByName(part.groupBy("gk", "other").agg(F.sum("value").cast("decimal(38,0)").alias("value")).select(names))
    summed = every.groupBy("gk", "other").agg(F.sum("value").cast("long").alias("value"))
    named = state.groups.select(F.col("gk").alias("other"), F.col("source").alias("item"))
    return summed.join(state.groups.select("gk", "lang", "source"), "gk").join(named, "other").select("lang", "source", "item", "value")


def _ranked(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best).cast("int"))


def _terms_of_groups(state: Counted, top: int) -> DataFrame:
    """lang, source, item (a kept term that is more frequent in the group than in the language), value, rank."""
    rows = state.kept.where("p > lang_p").withColumn("value", _apart("p", "lang_p"))
    best = Window.partitionBy("gk").orderBy(F.desc("value"))
    # Terms with equal values stay until their strings can order them.
    first = rows.select("gk", *state.key, "value", F.rank().over(best).alias("place")).where(F.col("place") <= top)
    named = first.join(state.strings.withColumnRenamed("term", "item"), state.key).join(state.groups.select("gk", "lang", "source"), "gk")
    return _ranked(named).where(F.col("rank") <= top).select("lang", "source", "item", "value", "rank")


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP, bits: int = 64) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank for ``docs`` (text, lang, source).

    Part ``pair``: every other source of the language by its distance. Part ``term``: the ``top`` terms by which a
    source stands out in its language. ``bits`` is the width of a digest; any width gives the same result.
    """
    state = Counted(docs, least, bits)
    pairs = _ranked(_pairs(state)).withColumn("part", F.lit("pair"))
    terms = _terms_of_groups(state, top).withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(names).unionByName(terms.select(names))
