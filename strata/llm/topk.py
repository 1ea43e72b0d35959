"""Exact top-k search by the three-phase uniform threshold method.

Every component becomes ``floor(scale * x)``; the score is the integer inner product. A node holds one part of the
components of one block of candidates.

1. Each node gives the best ``LISTS`` times ``k`` partial scores of every query, and its extremes. The totals of these candidates
   give each query a score that its k-th result reaches for certain.
2. That score, less what the lowest partial scores add, is split evenly over the parts: a result must reach the
   cutoff in some part. With the cutoffs every node gives all entries that reach them.
3. Entries keep their partial scores: those seen in every part raise the score that the k-th result reaches, and all
   whose bound stays below it are dropped. The totals of the others are computed exactly and ranked, ties to the
   smaller id.

Queries and candidates meet in blocks of fixed size, so no task holds more than two blocks.

Defined cases: vectors that are null or hold null or non-finite components take no part; a shorter vector counts
as filled with zeros; a null ``vec_id`` takes no part; rows that repeat an id are candidates of their own, except
for the query of that id; a score beyond a long takes no part; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.frames import indexed
from strata.session import written

CANDIDATES = 4096  # candidates of a block
QUERIES = 1024     # queries of a block
PARTS = 2          # parts of the components
LISTS = 8          # local lists hold so many times k entries: their totals set the certain score, a longer list a higher one
COPIES = 64        # copies of a query block, so that its meetings with candidates spread over as many tasks


def _dense(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for row, values in zip(out, lists):
        row[: len(values)] = values
    return out


def _nodes(vectors: DataFrame, width: int) -> DataFrame:
    """Blocks of candidates, one row for each part: ids and the part's components."""
    cuts = np.linspace(0, width, min(PARTS, max(1, width)) + 1).astype(int)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                rows = batch.slice(at, CANDIDATES)
                points = _dense(rows["v"].to_pylist(), width)
                for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([rows["vec_id"].to_pylist()], pa.list_(pa.int64())),
                         pa.array([np.ascontiguousarray(points[:, a:b]).tobytes()], pa.binary())],
                        names=["part", "ids", "points"])

    return vectors.select("vec_id", "v").mapInArrow(cut, "part int, ids array<long>, points binary")


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Query ids, candidate ids, partial scores, pairs of one and the same id, and what rounding may add."""
    queries, ids = np.array(row["query_ids"]), np.array(row["ids"])
    left = np.frombuffer(row["query_points"]).reshape(len(queries), -1)
    right = np.frombuffer(row["points"]).reshape(len(ids), -1)
    size = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    own = queries[:, None] == ids[None, :]
    return queries, ids, left @ right.T, own, 0.0 if size < 2.0 ** 53 else size * 2.0 ** -48


def _local_best(k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                queries, ids, scores, own, slack = _scores(row)
                allowed = np.where(own, -np.inf, scores)
                count = min(k, len(ids))
                top = np.argpartition(-allowed, count - 1, axis=1)[:, :count]
                values = np.take_along_axis(allowed, top, axis=1)
                low = np.where(own, np.inf, scores).min(axis=1) - slack
                q, _ = np.nonzero(np.isfinite(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[q]), pa.array([row["part"]] * len(q), pa.int32()),
                     pa.array(ids[top][np.isfinite(values)]), pa.array(values[np.isfinite(values)]),
                     pa.array(low[q]), pa.array(values.max(axis=1)[q] + slack)],
                    names=["query_id", "part", "vec_id", "partial", "low", "high"])
    return best


def _sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            queries, ids, scores, own, slack = _scores(row)
            cutoff = np.array(row["cutoffs"], dtype=np.float64) - slack
            q, c = np.nonzero((scores >= cutoff[:, None]) & ~own)
            for at in range(0, len(q), 1 << 18):
                rows, columns = q[at: at + (1 << 18)], c[at: at + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[rows]), pa.array(ids[columns]), pa.array([row["part"]] * len(rows), pa.int32()),
                     pa.array(scores[rows, columns]), pa.array([slack] * len(rows))],
                    names=["query_id", "vec_id", "part", "partial", "slack"])


def _totals(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact scores of pairs; the distinct pair meets every row of its candidate's id."""
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.try_multiply(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))),
                          F.lit(0).cast("long"), lambda total, x: F.try_add(total, x))
    return (pairs.join(vectors, "vec_id").join(queries, "query_id")
            .select("query_id", "vec_id", product.alias("score")).where(F.col("score").isNotNull()))


def _resolvable(seen: DataFrame, cutoffs: DataFrame, k: int, parts: int) -> DataFrame:
    """The pairs whose totals may be among the best ``k``, from the partial scores that reached their cutoffs.

    A pair seen in all parts has its total already, up to rounding: the k-th best of these is a score that the result
    reaches for certain. Where a pair was not seen its partial score is below the cutoff, which bounds its total.
    Ids with several rows can mix partial scores of two rows: they give bounds, but no certain score.
    """
    names = range(parts)
    pairs = written(seen.groupBy("query_id", "vec_id").agg(
        *[F.max(F.when(F.col("part") == p, F.col("partial"))).alias(f"p{p}") for p in names],
        F.count("*").alias("seen"), (F.max("slack") * 2 * parts).alias("slack")), "seen-pairs")
    total = sum((F.col(f"p{p}") for p in names), F.lit(0.0))
    whole = pairs.where((F.col("seen") == parts) & total.isNotNull()).select("query_id", (total - F.col("slack")).alias("total"))
    best = Window.partitionBy("query_id").orderBy(F.desc("total"))
    certain = whole.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query_id").agg(
        F.min("total").alias("reached"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    bound = sum((F.coalesce(f"p{p}", f"cut{p}", F.lit(float("inf"))) for p in names), F.col("slack"))
    return (pairs.join(cutoffs, "query_id").join(certain, "query_id", "left")
            .where(F.col("reached").isNull() | (bound >= F.col("reached"))).select("query_id", "vec_id"))


def _first(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for every row of ``table`` that ``is_query`` names."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    vectors = written(
        table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
            F.col("vec_id").cast("long"), is_query.alias("asks"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")), "vectors")
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0)
    candidates = vectors.select("vec_id", "v")
    queries = written(vectors.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")), "queries")
    nodes = written(_nodes(candidates, width), "nodes")
    numbered = written(indexed(queries, ["query_id"], "query-order").withColumn(
        "block", F.floor(F.col("index") / QUERIES).cast("int")), "numbered-queries")
    blocks = (numbered.agg(F.max("block")).first()[0] or 0) + 1
    cuts = np.linspace(0, width, min(PARTS, width) + 1).astype(int).tolist()

    def asked(cutoffs: DataFrame | None) -> DataFrame:
        """Query blocks, one row for each part, with the cutoffs of their queries."""
        rows = numbered if cutoffs is None else numbered.join(cutoffs, "query_id", "left")
        zero = F.lit(float("-inf"))
        wanted = F.array(*[zero if cutoffs is None else F.coalesce(f"cut{p}", zero) for p in range(len(cuts) - 1)])
        grouped = rows.groupBy("block").agg(F.collect_list(F.struct("query_id", "q", wanted.alias("cuts"))).alias("rows"))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.to_pylist():
                    points = _dense([row["q"] for row in block["rows"]], width)
                    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block["block"]], pa.int32()), pa.array([part], pa.int32()),
                             pa.array([[row["query_id"] for row in block["rows"]]], pa.list_(pa.int64())),
                             pa.array([np.ascontiguousarray(points[:, a:b]).tobytes()], pa.binary()),
                             pa.array([[row["cuts"][part] for row in block["rows"]]], pa.list_(pa.float64()))],
                            names=["block", "part", "query_ids", "query_points", "cutoffs"])

        return grouped.mapInArrow(
            split, "block int, part int, query_ids array<long>, query_points binary, cutoffs array<double>")

    each = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "copy", F.pmod(F.xxhash64("ids"), F.lit(COPIES)).cast("int"))

    def meet(cutoffs: DataFrame | None) -> DataFrame:
        copies = written(asked(cutoffs), "query-blocks").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        return each.join(copies.hint("shuffle_hash"), ["block", "part", "copy"])

    local = written(meet(None).mapInArrow(
        _local_best(k * LISTS), "query_id long, part int, vec_id long, partial double, low double, high double"), "local-lists")
    by_part = Window.partitionBy("query_id", "part").orderBy(F.desc("partial"), "vec_id")
    gathered = local.withColumn("n", F.row_number().over(by_part)).where(F.col("n") <= k * LISTS).select("query_id", "vec_id").distinct()
    certain = _first(_totals(gathered, queries, candidates), k).groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("score").cast("double").alias("score"))
    extremes = local.groupBy("query_id").pivot("part", list(range(len(cuts) - 1))).agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    parts = range(len(cuts) - 1)
    floor_sum = sum((F.col(f"{p}_low") for p in parts), F.lit(0.0))
    top_sum = sum((F.col(f"{p}_high") for p in parts), F.lit(0.0))
    score = F.when(F.col("n") >= k, F.col("score"))
    cutoffs = extremes.join(certain, "query_id", "left").select("query_id", *[
        F.greatest(F.col(f"{p}_low") + (score - floor_sum) / len(parts), score - (top_sum - F.col(f"{p}_high"))).alias(f"cut{p}")
        for p in parts])
    entries = _resolvable(written(meet(cutoffs).mapInArrow(
        _sufficient, "query_id long, vec_id long, part int, partial double, slack double"), "entries"), cutoffs, k, len(parts))
    return _first(_totals(entries, queries, candidates), k).select("query_id", "rank", "vec_id", "score")
