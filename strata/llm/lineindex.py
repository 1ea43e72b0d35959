"""A line index kept on storage: inserting and deleting documents rewrites the shards of their lines only.

The folder has the parts of ``lines.Index`` (references, counts, filters), each partitioned by the shard of the key, and the
references once more by document, which tells a deletion its shards. The layout document holds the number of shards.
When the common keys have become more than ``lines.SHARD_KEYS`` a shard, shards split by linear hashing: keys move
from the shards that split to new ones, and no others are touched. A reader takes a key only from the shard where
the layout puts it. One writer at a time.

Defined cases: those of ``lines``; documents that are inserted again count once, unknown ids are deleted without
effect; an index without documents has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import lines
from strata.operators.state import Layout, exists, files_of, put_layout, read_layout, splits
from strata.session import written

SHARD = "_shard"
HOME = "_home"
HOMES = 256  # parts of the references by document
_SCHEMAS = {
    "references": f"key binary, doc_id long, {SHARD} long", "counts": f"key binary, refs long, last_doc long, {SHARD} long",
    "filters": f"data binary, {SHARD} long", "documents": f"doc_id long, key binary, {HOME} int"}


class KeptIndex:
    """The index in the folder ``path``; it is created by the first ``insert``."""

    def __init__(self, spark: SparkSession, path: str, least: int = lines.MIN_DOCUMENTS):
        self.spark, self.path, self.least = spark, path, least

    def _layout(self) -> Layout:
        return read_layout(self.spark, self.path) or Layout(("key",), 1, 1)

    def _table(self, name: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _placed(self, name: str, shards: int) -> DataFrame:
        rows = self._table(name)
        return rows.where(F.col(SHARD) == lines.shard_of(shards)) if "key" in rows.columns else rows.where(F.col(SHARD) < shards)

    def read(self) -> lines.Index:
        """The whole index, for ``lines.kept`` and ``lines.dropped``."""
        return self._index(self._layout().parts, lambda rows: rows)

    def _index(self, shards: int, chosen) -> lines.Index:
        tables = [chosen(self._placed(name, shards)) for name in ("references", "counts", "filters")]
        return lines.Index(tables[0].drop(SHARD), tables[1].drop(SHARD), tables[2].withColumnRenamed(SHARD, "shard"), shards)

    def _replace(self, name: str, rows: DataFrame, touched: DataFrame, by: str = SHARD) -> None:
        """Put ``rows`` in the place of the touched partitions; those left without rows go."""
        rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{name}")
        for row in touched.select(by).distinct().join(rows.select(by).distinct(), by, "left_anti").collect():
            files, folder = files_of(self.spark, f"{self.path}/{name}/{by}={row[0]}")
            files.delete(folder, True)

    def _store(self, new: lines.Index, touched: DataFrame) -> None:
        shard = lines.shard_of(new.shards)
        self._replace("references", written(new.references.select("key", "doc_id", shard.alias(SHARD)), "references"), touched)
        self._replace("counts", written(new.counts.select("key", "refs", "last_doc", shard.alias(SHARD)), "counts"), touched)
        self._replace("filters", new.filters.select("data", F.col("shard").alias(SHARD)), touched)

    def _touched(self, keys: DataFrame, shards: int):
        """The shards of the keys, and a function that takes a table's rows in them."""
        touched = written(keys.select(lines.shard_of(shards).alias(SHARD)).distinct(), "touched-shards")
        return touched, lambda rows: rows.join(touched, SHARD, "left_semi")

    def insert(self, docs: DataFrame) -> None:
        """Add documents (doc_id, text)."""
        shards = self._layout().parts
        given = written(lines.keyed_lines(docs).select("key", "doc_id").distinct(), "given-lines")
        touched, chosen = self._touched(given, shards)
        old = self._index(shards, chosen)
        new = lines.insert_lines(old, given, self.least)
        fresh = written(given.join(old.references, ["key", "doc_id"], "left_anti").select("doc_id", "key", _home()), "fresh-lines")
        self._store(new, touched)
        fresh.hint("rebalance", HOME).write.mode("append").partitionBy(HOME).parquet(f"{self.path}/documents")
        layout = self._layout()
        put_layout(self.spark, self.path, Layout(("key",), 1, shards, layout.applied, layout.version + 1))
        needed = -(-self.read().counts.where(F.col("refs") >= self.least).count() // lines.SHARD_KEYS)
        if needed > shards:
            self._grow(shards, needed)

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents (doc_id) out again, as if they had never been inserted."""
        shards = self._layout().parts
        gone = doc_ids.select(F.col("doc_id").cast("long")).distinct().withColumn(HOME, _home())
        gone = written(gone, "gone")
        homes = self._table("documents").join(gone.select(HOME).distinct(), HOME, "left_semi")
        keys = written(homes.join(gone.select("doc_id"), "doc_id", "left_semi").select("key").distinct(), "gone-keys")
        touched, chosen = self._touched(keys, shards)
        self._store(lines.delete(self._index(shards, chosen), gone, self.least), touched)
        rest = written(homes.join(gone.select("doc_id"), "doc_id", "left_anti").select("doc_id", "key", HOME), "documents")
        self._replace("documents", rest, gone, HOME)

    def _grow(self, before: int, after: int) -> None:
        """Split shards until there are ``after``: keys are copied into the new ones, then the layout counts them."""
        split = splits(1, before, after)
        now = lines.shard_of(after)
        parts = {}
        for name in ("references", "counts"):
            rows = self._placed(name, before).where(F.col(SHARD).isin(split))
            parts[name] = written(rows.withColumn("_was", F.col(SHARD)).withColumn(SHARD, now), f"split-{name}")
            moved = parts[name].where(F.col(SHARD) != F.col("_was")).drop("_was")
            self._replace(name, moved, moved)
        common = parts["counts"].where(F.col("refs") >= self.least)
        built = written(lines.filters_of(common.select("key"), after), "split-filters").select("data", F.col("shard").alias(SHARD))
        fresh = built.where(F.col(SHARD) >= before)
        self._replace("filters", fresh, fresh)
        layout = self._layout()
        put_layout(self.spark, self.path, Layout(("key",), 1, after, layout.applied, layout.version + 1))
        for name in ("references", "counts"):  # frees the room of what has moved
            stay = parts[name].where(F.col(SHARD) == F.col("_was")).drop("_was")
            self._replace(name, stay, stay)
        old = built.where(F.col(SHARD) < before)
        self._replace("filters", old, old)


def _home():
    return F.pmod(F.xxhash64("doc_id"), F.lit(HOMES)).cast("int").alias(HOME)
