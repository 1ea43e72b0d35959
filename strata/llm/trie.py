"""The prefix trie of conversations, with totals over subtrees by depth bands.

A node is a distinct sequence of first turns; its name is its depth and two 64-bit sums (exclusive or) over the hashes
of its turns and their places, so the names of all prefixes are running sums along each conversation. Members, children
and parents are aggregates and joins on names.

Totals over subtrees go up in bands of ``HEIGHT`` depths. A node that has something to give (a leaf, or a turn that
members share) explodes to its ancestors within its band only, at most ``HEIGHT`` rows, which gives every node its total
within the band. Then the totals of band roots (the topmost nodes of a band) are completed from the deepest band upward,
one small aggregate for each band, and explode once to their ancestors in the band above. A trie deeper than the square
of ``HEIGHT`` takes higher bands, so both rounds and explosion stay below the root of the depth.

A very long conversation is cut over tasks by a range sort (``running``); the root and other nodes that most
conversations share are partial aggregates. The conversations that end at a node are sorted by ranges and joined to
chunks of text in parallel; only the hashing of a node's chunks, one after the other, is left to one task, as streams.

Defined cases: null roles and texts are empty; null turns come first; turns that share a number follow in the order of
the MD5 of their role and text, repeated rows are turns of their own; rows without ``conv_id`` belong to no
conversation; an empty table has no node, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.frames import running
from strata.session import written

HEIGHT = 32
CHUNK = 4096  # conversation ids in a chunk
BLOCK = 100   # conversations that share the beginning of the first of them
HEADS = 6     # lengths of shared beginnings: 0 to 5 turns
NAME = ["depth", "x1", "x2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place from 0), turn_hash (16 bytes) and chars of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.length(text).cast("long").alias("chars"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("turn_hash"))
    return running(rows, "conv_id", [F.asc_nulls_first("turn"), "turn_hash"], [], "turns").drop("turn")


def rebuilt(placed: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), turn_hash, chars, length: each conversation with the beginning of its block's first.

    ``length`` is the number of its turns; a conversation without any has one row of depth 0, as all others have.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = placed.groupBy("conv_id").agg((F.max("at") + 1).alias("turns")).withColumn("head", head).withColumn(
        "first", F.col("conv_id") - F.col("conv_id") % BLOCK)
    own = written(own, "conversations")
    firsts = own.where("conv_id = first").select("first", F.col("turns").alias("given"))
    plan = own.join(firsts, "first", "left").select(
        "conv_id", "first", "head", F.least("head", F.coalesce("given", F.lit(0))).alias("taken"), "turns").withColumn(
        "length", F.col("taken") + F.greatest(F.lit(0), F.col("turns") - F.col("head")))
    plan = written(plan, "rebuilt-plan")
    names = ["conv_id", "depth", "turn_hash", "chars", "length"]
    rest = placed.join(plan, "conv_id").where("at >= head").withColumn("depth", F.expr("taken + at - head + 1"))
    beginnings = placed.where((F.col("at") < HEADS - 1) & (F.col("conv_id") % BLOCK == 0)).select(
        F.col("conv_id").alias("first"), "at", "turn_hash", "chars")
    shared = plan.join(beginnings, "first").where("at < head").withColumn("depth", F.col("at") + 1)
    top = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn_hash"),
                      F.lit(0).cast("long").alias("chars"), "length")
    return rest.select(names).unionByName(shared.select(names)).unionByName(top)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, x1, x2, p1, p2 (the parent's sums), chars, length of every prefix of every conversation."""
    none = F.lit(0).cast("long")
    values = [F.when(F.col("depth") > 0, F.xxhash64(*columns)).otherwise(none) for columns in
              (("turn_hash", "depth"), ("depth", "turn_hash"))]
    rows = rows.select("conv_id", "depth", "chars", "length", values[0].alias("v1"), values[1].alias("v2"),
                       values[0].alias("x1"), values[1].alias("x2"))
    summed = running(rows, "conv_id", ["depth"], ["x1", "x2"], "prefixes")
    parent = [F.when(F.col("depth") > 0, F.col(f"x{i}").bitwiseXOR(F.col(f"v{i}"))).alias(f"p{i}") for i in (1, 2)]
    return summed.select("conv_id", *NAME, *parent, "chars", "length")


def _nodes(rows: DataFrame) -> DataFrame:
    """All nodes: name, conv_id, n_convs, parent_conv_id, n_children, and what they give: leaves, saved."""
    plain = written(rows.groupBy(*NAME).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2")), "trie")
    children = plain.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count("*").alias("n_children"))
    parents = plain.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    nodes = plain.join(parents, ["depth", "p1", "p2"], "left").join(children, NAME, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    return written(nodes.select(*NAME, "conv_id", "n_convs", "parent_conv_id", "n_children",
                                (F.col("n_children") == 0).cast("long").alias("leaves"),
                                ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "nodes")


def _sums() -> list[Column]:
    return [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]


def _band(depth: str, height: int) -> Column:
    return F.floor(F.col(depth) / height)


def totals(nodes: DataFrame, rows: DataFrame, height: int) -> DataFrame:
    """Name, leaves and saved of every node, summed over its subtree."""
    path = rows.select("conv_id", _band("depth", height).alias("band"), *NAME)
    giving = nodes.where("leaves > 0 or saved > 0").select(
        "conv_id", _band("depth", height).alias("band"), F.col("depth").alias("from"), "leaves", "saved")
    inside = written(path.join(giving, ["conv_id", "band"]).where(F.col("depth") <= F.col("from"))
                     .groupBy(*NAME).agg(*_sums()), "band-totals")
    # Band roots with their total within the band, and the sums that name the root of the band above.
    above = rows.where(F.col("depth") % height == 0).select(
        "conv_id", (F.col("depth") + height).alias("depth"), F.col("x1").alias("u1"), F.col("x2").alias("u2"))
    none = F.lit(0).cast("long")
    roots = nodes.where((F.col("depth") > 0) & (F.col("depth") % height == 0)).select("conv_id", *NAME)
    # A root whose band gives nothing only hands on what comes from below.
    roots = written(roots.join(above, ["conv_id", "depth"]).join(inside, NAME, "left")
                    .withColumns({name: F.coalesce(name, none) for name in ("leaves", "saved")}), "band-roots")
    deepest = roots.agg(F.max("depth")).first()[0]
    if deepest is None:
        return inside
    names = ["conv_id", *NAME, "u1", "u2", "leaves", "saved"]
    band = complete = written(roots.where(F.col("depth") == deepest).select(names), "band-complete")
    for depth in range(deepest - height, 0, -height):
        below = band.groupBy(F.col("u1").alias("x1"), F.col("u2").alias("x2")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        band = written(roots.where(F.col("depth") == depth).join(below, ["x1", "x2"], "left").select(
            "conv_id", *NAME, "u1", "u2", (F.col("leaves") + F.coalesce("more_leaves", none)).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", none)).alias("saved")), "band-complete")
        complete = complete.unionByName(band)
    given = complete.select("conv_id", (_band("depth", height) - 1).alias("band"), "leaves", "saved")
    upward = path.join(given, ["conv_id", "band"]).select(*NAME, "leaves", "saved")
    return inside.unionByName(upward).groupBy(*NAME).agg(*_sums())


def ends(rows: DataFrame) -> DataFrame:
    """Name and ends_sha256 of every node at which conversations end: of their ids, ascending, joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch[name].to_pylist() for name in (*NAME, "conv_id"))))
            out, at = [], 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i][:3] != rows[at][:3] or i - at == CHUNK:
                    out.append((*rows[at], ",".join(str(row[3]) for row in rows[at:i])))
                    at = i
            if out:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(column, pa.int64()) for column in list(zip(*out))[:4]), pa.array([row[4] for row in out])],
                    names=[*NAME, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None

        def made(rows):
            return pa.RecordBatch.from_arrays([*(pa.array(column, pa.int64()) for column in list(zip(*rows))[:3]),
                                               pa.array([row[3] for row in rows])], names=[*NAME, "ends_sha256"])

        for batch in batches:
            out = []
            for *this, ids in zip(*(batch[column].to_pylist() for column in (*NAME, "ids"))):
                if this == name:
                    digest.update(f",{ids}".encode())
                    continue
                if name is not None:
                    out.append((*name, digest.hexdigest()))
                name, digest = this, hashlib.sha256(ids.encode())
            if out:
                yield made(out)
        if name is not None:
            yield made([(*name, digest.hexdigest())])

    last = rows.where("depth = length").select(*NAME, "conv_id")
    order = [*NAME, "conv_id"]
    chunks = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        joined, "depth long, x1 long, x2 long, first long, ids string")
    return chunks.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(
        hashed, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(conversations: DataFrame, height: int | None = None) -> DataFrame:
    """One row for each node of the trie of the rebuilt ``conversations`` (conv_id, turn, role, text).

    ``conv_id`` is a node's smallest member, ``ends_sha256`` names the members that end at it; see the README.
    """
    rows = prefixes(rebuilt(turns(conversations)))
    rows = written(rows, "paths")
    nodes = _nodes(rows)
    if height is None:
        deepest = nodes.agg(F.max("depth")).first()[0] or 0
        height = max(HEIGHT, int(deepest ** 0.5) + 1)
    summed = totals(nodes, rows, height).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    nobody = hashlib.sha256(b"").hexdigest()
    return (nodes.drop("leaves", "saved").join(summed, NAME).join(ends(rows), NAME, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256")))
