"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII blanks at both ends, A-Z lower-cased, named by its SHA-256. A key of at least
``MIN_LENGTH`` code points that ``MIN_DOCUMENTS`` documents hold is common: its lines go from every document but
the one with the largest id. The state of an index is

* references: one row for each key and document (exact, what makes a deletion possible),
* counts: each key's number of documents and its last one (exact),
* filters: per shard, a cuckoo filter of the common keys.

``insert`` and ``delete`` put keys into the filters or take them out as they become common or cease to be; on tables as
these they go over all counts. An index kept on storage (``lineindex``) passes them the touched shards only, and splits
shards that have filled. ``kept`` looks lines up in the filters first, so only lines that may be common meet the exact
counts. A new index has shards of about ``SHARD_KEYS`` keys, so a filter is a few kilobytes, however many there are.

Defined cases: a null or empty text is one empty line; rows that share a ``doc_id`` are one document, whose lines
count once; a row with a null id keeps all lines and counts nowhere; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import cuckoo
from strata.operators.state import address
from strata.session import written

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
SHARD_KEYS = 1024
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Index(NamedTuple):
    references: DataFrame  # key, doc_id
    counts: DataFrame      # key, refs, last_doc
    filters: DataFrame     # shard, data
    shards: int = 1        # how many there are


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, with A-Z and no other letters lower-cased."""
    bare = F.btrim(line, F.lit(_BLANKS))
    # lower() is quick and right on ASCII; other letters must stay as they are.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def keyed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (names the text), at (line number from 0) and key of every line that is long enough."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.posexplode(_lines(F.col("text"))))
    return (rows.where("doc_id is not null").withColumn("line", line_key(F.col("col"))).where(F.length("line") >= MIN_LENGTH)
            .select("doc_id", "row", F.col("pos").alias("at"), F.unhex(F.sha2("line", 256)).alias("key")))


def _counted(references: DataFrame) -> DataFrame:
    return references.groupBy("key").agg(F.count("*").alias("refs"), F.max("doc_id").alias("last_doc"))


def shard_of(shards: int) -> Column:
    """A key's shard, by linear hashing: a further shard takes its keys from one other."""
    return address(["key"], 1, shards).cast("long")


def _second() -> Column:
    return F.xxhash64(F.lit(1), F.col("key"))


def filters_of(keys: DataFrame, shards: int) -> DataFrame:
    """Filters of keys, one group for each shard; its size is bounded by the number of shards."""

    def make(table: pa.Table) -> pa.Table:
        return pa.table({"shard": table["shard"][:1], "data": pa.array([cuckoo.build(table["g"].to_pylist()).data()], pa.binary())})

    return keys.select(shard_of(shards).alias("shard"), _second().alias("g")).groupBy("shard").applyInArrow(make, "shard long, data binary")


def index(docs: DataFrame, least: int = MIN_DOCUMENTS) -> Index:
    """The index of documents."""
    return _index_of(written(keyed_lines(docs), "keyed-lines"), least)


def _index_of(lines: DataFrame, least: int) -> Index:
    references = lines.select("key", "doc_id").distinct()
    counts = written(_counted(references), "line-counts")
    common = counts.where(F.col("refs") >= least)
    shards = max(1, -(-common.count() // SHARD_KEYS))
    return Index(references, counts, written(filters_of(common, shards), "line-filters"), shards)


def _changed(old: Index, references: DataFrame, counts: DataFrame, touched: DataFrame, least: int) -> Index:
    """The filters after the counts of ``touched`` keys have become those in ``counts``."""
    is_common = F.coalesce(F.col("refs"), F.lit(0)) >= least
    before = old.counts.join(touched, "key", "left_semi").where(is_common).select("key", F.lit(-1).alias("change"))
    after = counts.join(touched, "key", "left_semi").where(is_common).select("key", F.lit(1).alias("change"))
    changes = before.unionByName(after).groupBy("key").agg(F.sum("change").alias("change")).where("change <> 0")
    shards = old.shards
    moved = changes.select(shard_of(shards).alias("shard"), _second().alias("g"), "change")

    def apply(key, held: pa.Table, rows: pa.Table) -> pa.Table:
        filter_ = cuckoo.Filter(held["data"][0].as_py() if held.num_rows else None)
        full = False
        for change, g in sorted(zip(rows["change"].to_pylist(), rows["g"].to_pylist())):
            full |= not (filter_.insert(g) if change > 0 else filter_.delete(g))
        return pa.table({"shard": [key[0].as_py()], "data": pa.array([None if full else filter_.data()], pa.binary())})

    made = written(old.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(
        apply, "shard long, data binary"), "line-filters")
    # A filter without room left is built anew from the exact counts.
    full = made.where("data is null").select("shard")
    again = counts.where(is_common).withColumn("shard", shard_of(shards)).join(full, "shard", "left_semi").drop("shard")
    return Index(references, counts, written(made.where("data is not null").unionByName(filters_of(again, shards)), "line-filters"), shards)


def insert(old: Index, docs: DataFrame, least: int = MIN_DOCUMENTS) -> Index:
    """The index with the documents added; lines it already has of a document count once."""
    return insert_lines(old, keyed_lines(docs).select("key", "doc_id").distinct(), least)


def insert_lines(old: Index, lines: DataFrame, least: int = MIN_DOCUMENTS) -> Index:
    """The same for distinct (key, doc_id)."""
    new = written(lines.join(old.references, ["key", "doc_id"], "left_anti"), "new-lines")
    delta = _counted(new)
    counts = written(old.counts.unionByName(delta).groupBy("key").agg(
        F.sum("refs").alias("refs"), F.max("last_doc").alias("last_doc")), "line-counts")
    return _changed(old, written(old.references.unionByName(new), "line-references"), counts, delta.select("key"), least)


def delete(old: Index, doc_ids: DataFrame, least: int = MIN_DOCUMENTS) -> Index:
    """The index without the documents, as if they had never been inserted."""
    gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
    references = written(old.references.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "line-references")
    touched = written(old.references.join(gone, "doc_id", "left_semi").select("key").distinct(), "touched-lines")
    fresh = _counted(references.join(touched, "key", "left_semi"))
    counts = written(old.counts.join(touched, "key", "left_anti").unionByName(fresh), "line-counts")
    return _changed(old, references, counts, touched, least)


def dropped(lines: DataFrame, state: Index, least: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, row and the sorted numbers of the lines that go."""
    maybe = (lines.withColumn("shard", shard_of(state.shards)).join(state.filters.select("shard", "data"), "shard")
             .where(cuckoo.may_hold(F.col("data"), _second())).drop("shard", "data"))
    exact = state.counts.where(F.col("refs") >= least).select("key", "last_doc")
    return (maybe.join(exact, "key").where("doc_id <> last_doc").groupBy("doc_id", "row")
            .agg(F.array_sort(F.collect_set("at")).alias("gone")))


def kept(docs: DataFrame, state: Index | None = None, least: int = MIN_DOCUMENTS) -> DataFrame:
    """The rows of ``docs`` with n_lines, n_dropped and ``text`` without the lines that go."""
    lines = written(keyed_lines(docs), "keyed-lines")
    gone = dropped(lines, state or _index_of(lines, least), least)
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("gone").alias("_gone"))
    joined = docs.join(gone, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64("text") == F.col("_row")), "left")
    all_lines, none = _lines(F.col("text")), F.array().cast("array<int>")
    cut = F.coalesce("_gone", none)
    # Runs of lines between the dropped ones; each is a slice, so the work is linear in the lines.
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), cut), F.concat(cut, F.array(F.col("n_lines").cast("int"))),
        lambda before, after: F.slice(F.col("_lines"), before + 2, after - before - 1))
    text = F.when(F.size(cut) == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    names = [name for name in docs.columns if name not in ("text", "n_lines", "n_dropped")]
    return (joined.withColumn("_lines", all_lines).withColumn("n_lines", F.size("_lines").cast("long"))
            .select(*names, "n_lines", F.size(cut).cast("long").alias("n_dropped"), text.alias("text")))
