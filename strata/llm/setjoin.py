"""Near-duplicate documents by word shingles: a size-aware heavy-light set similarity join.

Two sets link when their Jaccard similarity is at least ``threshold`` per cent. They then have at least
``o = ceil(t n)`` of the n shingles of either in common. Two filters come first, both without loss:

* Of the first ``n - o + 1 + x`` shingles of a set in the order of their hashes (x is ``X`` per cent of its size),
  more than x' are in any partner's, where x' is x of the smallest partner. Sets with fewer shared ones are done.
* Of the others all shingles are counted. Those in no other set cannot be in common; with less than ``o`` left a
  set is done, and two sets are never compared when what both have left is too little for their sizes.

Of a set's s shared shingles, rarest first, the first ``s - o + 1`` are enough to meet a partner in one:

* heavy sets are met by scanning the inverted lists of these, one by one;
* light sets, up to a size chosen by cost, enumerate pairs (subsets of a fixed size) of one shingle more.

Equal sets are joined once. A list first compares everyone with its pivot, the set whose shingles are the most
common, which links groups of near copies in as many steps as they have members. Only members that are then still
apart in some list are compared with the others. All comparisons are exact, and none between sets that are still
apart is left out.

Defined cases: a null text counts as empty; documents without words link with nothing; a text of one to four words
is one shingle; rows that share a ``doc_id`` count as one document; a null id links with nothing; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.graph import components
from strata.llm.shingles import mixed, sets, slices
from strata.session import written

ENTRY_COST = 3     # what an entry of an inverted list costs (order, pivot, comparison), a subset's order being 1
X = 15             # per cent of a set that its prefix has beyond what a single common shingle needs
CELLS = 256        # bits that tell apart what two sets can have in common
SEEN = 1 << 18     # sets that a task remembers, to count copies once, and tokens, to report them once


def _missing(n, threshold: int):
    """Shingles of a set of n that a partner may lack; for numbers, arrays and columns alike."""
    return n - (threshold * n + 99) // 100


def _least_common(n: Column, threshold: int) -> Column:
    """Prefix shingles that a set of n has in common with any partner, at least."""
    return F.floor(F.floor((n * threshold + 99) / 100) * X / 100) + 1


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and two sums over the set that name it."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                values, counts = sets(rows["text"])
                f1, f2 = _names(values, counts)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.array(counts, pa.int64()), pa.array(f1), pa.array(f2)],
                    names=["doc_id", "n_shingles", "f1", "f2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        profile, "doc_id long, n_shingles long, f1 long, f2 long")


def _names(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(salt)))])
        out.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return out[0], out[1]


def _prefixes(docs: DataFrame, threshold: int) -> DataFrame:
    """token, doc, n: the first shingles of each set in the order of their hashes; copies in a task give them once.

    A task settles what it can itself: a token that two sets of a slice have, or that it has reported before, counts
    for its sets at once. So a token leaves a task in a few rows, however many sets have it. Rows are of three kinds:
    an even token with its only set in the slice (n is 1), an even token that is shared (no set, n is 2), and an odd
    token, which carries the number n of tokens settled for a set.
    """

    most = SEEN

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        reported = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for rows in slices(batch):
                values, counts = sets(rows["text"])
                first = np.cumsum(counts) - counts
                size = np.minimum(counts, _missing(counts, threshold) + 1 + X * counts // 100)
                for i, name in enumerate(zip(*(f.tolist() for f in _names(values, counts)))):
                    if name in seen:
                        size[i] = 0
                    seen.add(name)
                if len(seen) > most:
                    seen.clear()
                owner = np.repeat(np.arange(len(counts)), size)
                at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + first[owner]
                # 48 bits are enough to count by: a token that seems shared only makes a set go on to the exact count.
                tokens, place, times = np.unique(values[at] & ~np.uint64(0xFFFF), return_inverse=True, return_counts=True)
                known = np.zeros(len(tokens), dtype=bool)
                if len(reported):
                    known = reported[np.minimum(np.searchsorted(reported, tokens), len(reported) - 1)] == tokens
                shared = known | (times > 1)
                news = tokens[shared & ~known]
                reported = news if len(reported) + len(news) > most else np.union1d(reported, news)
                settled = np.bincount(owner[shared[place]], minlength=len(counts))
                carriers, single = np.flatnonzero(settled), ~shared[place]
                ids = rows["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([tokens[place[single]], news, mixed(ids[carriers].view(np.uint64)) | np.uint64(1)])
                             .view(np.int64)),
                    pa.concat_arrays([pa.array(ids[owner[single]]), pa.nulls(len(news), pa.int64()), pa.array(ids[carriers])]),
                    pa.array(np.concatenate([np.ones(int(single.sum()), np.int64), np.full(len(news), 2), settled[carriers]])),
                ], names=["token", "doc", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(
        prefix, "token long, doc long, n long")


def _least_overlap(n: Column, threshold: int) -> Column:
    """Shingles that a set of n has in common with any partner, at least."""
    return F.floor((n * threshold + 99) / 100)


def _boundary(nodes: DataFrame) -> int:
    """Size up to which enumerating pairs costs no more than scanning lists, from sums by size class."""
    step = F.floor(F.ln("n") * 20).cast("int")
    rows = nodes.groupBy(step.alias("step")).agg(
        F.max("n").alias("n"), F.sum("subsets").alias("subsets"), F.sum("scans").alias("scans")).orderBy("step").collect()
    best, bound = 0, 0
    total = 0
    for row in rows:
        total += row["subsets"] - row["scans"]
        if total < best:
            best, bound = total, row["n"]
    return bound


def _able(docs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """node: representatives of the sets that share enough of their first shingles to have a partner."""
    carried = F.col("token").bitwiseAND(F.lit(1)) == 1
    shared = (_prefixes(docs, threshold).withColumn("owners", F.sum("n").over(Window.partitionBy("token")))
              .where(F.col("doc").isNotNull() & (carried | (F.col("owners") > 1)))
              .groupBy("doc").agg(F.sum(F.when(carried, F.col("n")).otherwise(1)).alias("s")))
    return (shared.join(members.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "rep"), "doc")
            .where(F.col("s") >= _least_common(F.col("n"), threshold)).select(F.col("rep").alias("node")).distinct())


def _meetings(texts: DataFrame, threshold: int) -> DataFrame:
    """key, centre and ``about`` (node, n, s, k, b0 to b3, at): sets that may link have a key in common.

    ``at`` is the place of the key's (first) shingle among the s, from 0: of two partners' common shingles the
    rarest meets them, and all others come after it in both.
    s counts the shingles that some other set has, centre says how common they are. The 256 bits in b mark the
    cells that these shingles fall into, of a large set a share of 1 / 2^k of them.
    """
    rows = texts.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    o = _least_overlap(F.col("n"), threshold)
    shared = written(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared-tokens")
    counted = (rows.join(shared, "token")
               .withColumn("k", F.greatest(F.lit(0), F.floor(F.log2(F.col("n") / CELLS))).cast("int"))
               .withColumn("cell", F.col("token").bitwiseAND(F.lit(CELLS - 1)).cast("int"))
               .withColumn("marks", F.expr("shiftright(token, 8) & (shiftleft(1L, k) - 1) = 0")))
    nodes = written(
        counted.groupBy("node", "n", "k").agg(
            F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"), (F.sum("df") / F.col("n")).alias("centre"),
            *[F.expr(f"bit_or(CASE WHEN marks AND cell DIV 64 = {w} THEN shiftleft(1L, cell % 64) ELSE 0L END)").alias(f"b{w}")
              for w in range(CELLS // 64)])
        .withColumn("s", F.size("tokens").cast("long")).where(F.col("s") >= o)
        .withColumn("scanned", F.slice("tokens", 1, (F.col("s") - o + 1).cast("int")))
        .withColumn("paired", F.slice("tokens", 1, F.least(F.col("s"), F.col("s") - o + 2).cast("int"))).drop("tokens")
        .withColumn("subsets", F.size("paired") * (F.size("paired") - 1) / 2)
        .withColumn("scans", F.size("scanned").cast("double") * ENTRY_COST), "nodes")
    # A pair is met by pairs of shingles if its smaller set is light, so light sets and what may link with them
    # enumerate; and by single shingles if both are heavy.
    bound = _boundary(nodes)
    light = nodes.where(F.col("n") * threshold <= bound * 100)
    heavy = nodes.where((F.col("n") > bound) | (F.col("n") < 2))
    about = F.struct("node", "n", "s", "k", *[f"b{w}" for w in range(CELLS // 64)], "at").alias("about")
    keys = heavy.select("*", F.posexplode("scanned").alias("at", "t")).select(F.col("t.token").alias("key"), about, "centre")
    subsets = light.where("n > 1").select("*", F.posexplode("paired").alias("at", "t")).select(
        F.explode(F.transform(F.slice("paired", F.col("at") + 2, F.size("paired")),
                              lambda u: F.xxhash64(F.col("t.token"), u["token"]))).alias("key"), about, "centre")
    return keys.unionByName(subsets)


def _may_link(a: str, b: str, threshold: int) -> Column:
    """Whether the sizes of two sets, and what both can have in common, allow a link found at this key.

    If this is the rarest shingle they have in common, no common one comes before it in either.
    A marked cell of one that the other has not marked, though it marks at least as large a share of its
    shingles, holds a shingle that the other lacks.
    """
    def common(x: str, y: str) -> Column:
        lacks = sum((F.bit_count(F.col(f"{x}.b{w}").bitwiseAND(F.bitwise_not(f"{y}.b{w}"))) for w in range(CELLS // 64)), F.lit(0))
        return F.col(f"{x}.s") - F.when(F.col(f"{x}.k") >= F.col(f"{y}.k"), lacks).otherwise(0)

    from_here = [F.col(f"{x}.s") - F.col(f"{x}.at") for x in (a, b)]
    return F.least(common(a, b), common(b, a), *from_here) * (100 + threshold) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * threshold


def _verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) that link."""
    a = texts.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = texts.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return (pairs.join(a, "u").join(b, "v").withColumn("common", common)
            .where(F.col("common") * 100 >= (F.size("a") + F.size("b") - F.col("common")) * threshold)
            .select("u", "v"))


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                values, counts = sets(rows["text"])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))],
                    names=["node", "shingles"])

    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(
        nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return chosen.mapInArrow(shingles, "node long, shingles array<long>")


def grouped(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    profile = written(profiles(docs), "profiles")
    some = profile.where("n_shingles > 0 and doc_id is not null")
    # Counts and pivots are partial aggregates, written before the rows are joined with them: a join of two exchanges
    # is one whose hot keys the adaptive planner splits.
    classes = written(some.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    members = written(some.join(classes, ["f1", "f2", "n_shingles"]).select("doc_id", "n_shingles", "rep"), "members")
    texts = written(_sets_of(docs, _able(docs, members, threshold)), "sets")
    meetings = _meetings(texts, threshold)
    pivots = written(meetings.groupBy("key").agg(
        F.max_by("about", F.struct("centre", "about.node")).alias("pivot"), F.count("*").alias("size"))
        .where("size > 1").drop("size"), "pivots")
    lists = written(meetings.drop("centre").join(pivots, "key").select("key", "about", "pivot"), "lists")
    first = (lists.where((F.col("about.node") != F.col("pivot.node")) & _may_link("about", "pivot", threshold))
             .select(F.col("pivot.node").alias("u"), F.col("about.node").alias("v")).distinct())
    linked = written(_verified(first, texts, threshold), "pivot-links")
    apart = _apart(lists, components(linked), threshold)
    linked = linked.unionByName(_verified(apart, texts, threshold))
    names = components(linked)
    found = (members.join(names, F.col("rep") == F.col("node"), "left")
             .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")))
    rest = profile.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(rest)


def _apart(lists: DataFrame, names: DataFrame, threshold: int) -> DataFrame:
    """Pairs (u, v) that have a key in common and are not linked yet, by a path or directly.

    The largest component of a list is not joined with itself, only with those outside it.
    """
    rows = (lists.select("key", "about", F.col("about.node").alias("node")).join(names, "node", "left")
            .select("key", "about", F.coalesce("component", "node").alias("component")))
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("rows"))
    several = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("rows", "component")).alias("main"))
    open_rows = written(rows.join(several.where("parts > 1").drop("parts"), "key"), "open-lists")
    outside = open_rows.where("component <> main").select(
        "key", F.col("about").alias("other"), F.col("component").alias("other_component"))
    apart = (F.col("component") != F.col("other_component")) & (
        (F.col("component") == F.col("main")) | (F.col("other.node") < F.col("about.node")))
    return (open_rows.join(outside, "key").where(apart & _may_link("about", "other", threshold))
            .select(F.col("other.node").alias("u"), F.col("about.node").alias("v")).distinct())
