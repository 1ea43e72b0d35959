"""A training corpus from raw documents: toxicity, line dedup, near-duplicate groups, packing.

Every stage works on all rows of its predecessor. All but the last return the columns of ``documents``; the last
returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import lines, packing, setjoin, toxicity
from strata.llm.frames import importable
from strata.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of its training part, does not predict to be toxic."""
    importable(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(docs, labels, training)
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that recur in at least three, but for the last document of each line."""
    importable(spark)
    kept = lines.kept(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; all that are in none.

    Of rows that agree in id and text one stays. Rows without an id are in no group, but of those with the same
    text, if it has words, one stays too.
    """
    importable(spark)
    groups = setjoin.grouped(docs)
    stay = written(groups.where("doc_id = component_id").select("doc_id").distinct(), "one-of-each")
    rows = docs.select(*COLUMNS)
    left = rows.join(stay, "doc_id", "left_semi").select(*COLUMNS).unionByName(rows.where("doc_id is null"))
    # Hashes tell which rows may be repeated; only those are compared by their texts.
    hashed = left.withColumn("hash", F.xxhash64("text"))
    again = written(hashed.where(F.col("doc_id").isNotNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
                    .groupBy("doc_id", "hash").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("hash").alias("h")),
                    "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h"))
    others = [name for name in COLUMNS if name not in ("doc_id", "text")]
    one = (hashed.join(again, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("row"))
           .select("doc_id", "text", *[f"row.{name}" for name in others]))
    return hashed.join(again, same, "left_anti").select(*COLUMNS).unionByName(one)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its place in a sequence of at most 2048 tokens."""
    importable(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("shingle_groups", drop_copies), ("packing", pack)]

# The classifier and the packing plan have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
