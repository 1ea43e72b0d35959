"""Near-duplicate vectors by an exact metric range join.

Unit vectors with cosine at or above ``threshold`` lie within a fixed distance of each other. A bounded sample of
vectors serves as pivots; each vector lives in the cell of its nearest pivot and visits every cell of lower
number that the triangle inequality (its form for the plane between two pivots) cannot rule out. Cells join on
their own. A large cell is dealt as blocks, so no task gets an unbounded cell. Copies are joined once, by a
representative. A block returns counts and a spanning forest of its links, not all links.

Defined cases: vectors that are null, zero or empty or hold null or non-finite components link with nothing, nor
do vectors of different length; a null ``vec_id`` links with nothing and has no component; repeated rows are
vectors of their own with one id; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.graph import components
from strata.session import written

BLOCK = 8192   # vectors of a block
PIVOTS = 256   # most pivots, and so vectors that reach the driver
TILE = 256     # rows compared at once in a task
_ROUNDING = 1e-5  # what single precision may lose; pairs this near the threshold are compared in double


def usable(column: str) -> F.Column:
    """No null or non-finite component, and some component that is not zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & F.coalesce(~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision; all of one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _union(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``root`` (of each place, the smallest place it is linked with) after the links left-right have been added."""
    while True:
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:  # every place hangs on its root again
            above = root[root]
            if (above == root).all():
                break
            root = above


def _tallied(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, copies_a: np.ndarray,
             copies_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each place of a and b (of a alone, if they are the ``same``), counting copies, and its root.

    Tiles of pairs are compared in single precision, those near the threshold in double; a tile's links are counted and
    united, and no pair is kept.
    """
    shift = 0 if same else len(a)
    copies = copies_a if same else np.concatenate([copies_a, copies_b])
    links, root = np.zeros(len(copies), dtype=np.int64), np.arange(len(copies))
    single, turned = a.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    for at in range(0, len(a), TILE):
        begin = at if same else 0
        scores = single[at: at + TILE] @ turned[:, begin:]
        left, right = np.nonzero(scores >= threshold - _ROUNDING)
        sure = scores[left, right] >= threshold + _ROUNDING
        left, right = left + at, right + begin
        if same:
            sure, left, right = (part[right > left] for part in (sure, left, right))
        near = np.flatnonzero(~sure)
        for i in range(0, len(near), 1 << 14):
            part = near[i: i + (1 << 14)]
            sure[part] = np.einsum("ij,ij->i", a[left[part]], b[right[part]]) >= threshold
        left, right = left[sure], right[sure] + shift
        if len(left):
            links += np.bincount(left, weights=copies[right], minlength=len(copies)).astype(np.int64)
            links += np.bincount(right, weights=copies[left], minlength=len(copies)).astype(np.int64)
            root = _union(root, left, right)
    return links, root


def _cells(vectors: DataFrame, pivots: dict[int, np.ndarray], reach: float) -> DataFrame:
    """Each vector in its home cell, and as a visitor in the cells of lower number it may have links in."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                points = _matrix(rows["embedding"])
                pivot = pivots[int(dim)]
                square = np.maximum(0.0, 2.0 - 2.0 * points @ pivot.T)
                home = square.argmin(axis=1)
                apart = np.sqrt(np.maximum(1e-18, 2.0 - 2.0 * pivot @ pivot.T))
                margin = (square - square[np.arange(len(home)), home][:, None]) / (2.0 * apart[home])
                member = (margin <= reach + 1e-9) & (np.arange(len(pivot)) < home[:, None])
                member[np.arange(len(home)), home] = True
                row, cell = np.nonzero(member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(cell == home[row]),
                     *rows.select(["dim", "rep", "copies", "embedding"]).take(pa.array(row)).columns],
                    names=["cell", "home", "dim", "rep", "copies", "embedding"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("dim", "rep", "copies", "embedding").mapInArrow(
        assign, f"cell int, home boolean, dim int, rep long, copies long, embedding {kind}")


def _joined(cells: DataFrame, threshold: float) -> DataFrame:
    """node, links, root of every vector with links, once for each pair of blocks where it has some."""
    sizes = cells.groupBy("dim", "cell").agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("homes"),
        F.ceil(F.count_if(~F.col("home")) / BLOCK).cast("int").alias("guests"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    sizes = sizes.where("homes > 0")
    # A task is a home block and either a home block from its own number on or, counted on, a guest block.
    others = F.when(
        F.col("home"),
        F.concat(F.transform(F.sequence(F.lit(0), F.col("homes") - 1),
                             lambda i: F.struct(F.least(i, F.col("at")).alias("a"), F.greatest(i, F.col("at")).alias("b"))),
                 F.when(F.col("guests") > 0, F.transform(
                     F.sequence(F.lit(0), F.col("guests") - 1),
                     lambda i: F.struct(F.col("at").alias("a"), (F.col("homes") + i).alias("b"))))
                 .otherwise(F.array().cast("array<struct<a:int,b:int>>")))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("homes") - 1),
                            lambda i: F.struct(i.alias("a"), (F.col("homes") + F.col("at")).alias("b"))))
    tasks = (cells.join(sizes, ["dim", "cell"]).withColumn("at", block).withColumn("task", F.explode(others))
             .select("dim", "cell", "task.a", "task.b", "home", "at", "rep", "copies", "embedding"))

    def join(table: pa.Table) -> pa.Table:
        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        own = table["home"].to_numpy() & (table["at"].to_numpy() == a)
        left = table.filter(pa.array(own))
        right = left if a == b else table.filter(pa.array(~own))
        if not left.num_rows or not right.num_rows:
            return pa.table({name: pa.array([], pa.int64()) for name in ("node", "links", "root")})
        links, root = _tallied(_matrix(left["embedding"]), _matrix(right["embedding"]), a == b, threshold,
                               left["copies"].to_numpy(), right["copies"].to_numpy())
        ids = left["rep"].to_numpy() if a == b else np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()])
        least = ids.copy()
        np.minimum.at(least, root, ids)
        some = links > 0
        return pa.table({"node": ids[some], "links": links[some], "root": least[root][some]})

    return tasks.groupBy("dim", "cell", "a", "b").applyInArrow(join, "node long, links long, root long")


def linked(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    good = rows.where(F.col("vec_id").isNotNull() & usable("embedding"))
    # Two hashes name a vector: copies meet in a partial aggregate, wherever they lie.
    keyed = written(good.select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"),
                                F.xxhash64(F.lit(1), "embedding").alias("k2")), "vectors")
    classes = written(keyed.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding")), "classes")
    dims = {row["dim"]: row["n"] for row in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    pivots = {}
    for dim, n in dims.items():
        chosen = (classes.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"))
                  .limit(int(min(PIVOTS, max(1, -(-n // BLOCK))))).select("embedding").collect())
        pivots[dim] = _matrix(pa.array([row["embedding"] for row in chosen], pa.list_(pa.float64())))
    if not pivots:
        found = classes.select(F.col("rep").alias("node"), F.lit(0).cast("long").alias("links"), F.col("rep").alias("root"))
    else:
        found = written(_joined(written(_cells(classes, pivots, reach), "cells"), threshold), "found-links")
    names = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = (classes.select("k1", "k2", "rep", "copies").join(counts, F.col("rep") == F.col("node"), "left").drop("node")
                .join(names, F.col("rep") == F.col("node"), "left")
                .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    alone = rows.where(F.col("vec_id").isNull() | ~usable("embedding")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (keyed.select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
            .unionByName(alone)
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
