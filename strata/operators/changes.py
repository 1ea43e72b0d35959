"""Change rows and current tables: parse, fold, upsert, compare.

A change row has the key columns, the payload columns, ``op`` (c, u or d) and a ``seq`` that
orders all changes. The state of a table keeps ``_seq`` of the last change and a ``_deleted``
mark, so that a late, older change can neither undo an update nor bring back a deleted row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import written

# Row kinds of an upstream changelog and the operation each stands for.
ROW_KIND_OPS = {
    "INSERT": "c",
    "UPDATE_AFTER": "u",
    "DELETE": "d",
}
DELETE = "d"

SEQ, DELETED = "_seq", "_deleted"


def parse_changes(df: DataFrame, json_col: str, schema: str | T.StructType) -> DataFrame:
    """Envelopes ``{op, seq, before, after}`` to change rows with the columns of ``schema``.

    A delete takes its values from ``before``, everything else from ``after``. Envelopes that do
    not parse come out with a null ``op``.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    image = fields.simpleString()
    parsed = F.from_json(json_col, f"struct<op:string,seq:bigint,before:{image},after:{image}>")
    kept = [name for name in df.columns if name != json_col]
    rows = df.select(*kept, parsed.alias("_e")).withColumn(
        "_row", F.when(F.col("_e.op") == DELETE, F.col("_e.before")).otherwise(F.col("_e.after"))
    )
    return rows.select(*kept, *[F.col(f"_row.{name}").alias(name) for name in fields.names],
                       F.col("_e.op").alias("op"), F.col("_e.seq").alias("seq"))


def bad_changes(df: DataFrame, json_col: str, schema: str | T.StructType) -> DataFrame:
    """Envelopes that ``parse_changes`` cannot take whole: other columns, the text, and a ``reason``.

    Either the text is no envelope with an operation, or a value is there that its column's type cannot hold.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [name for name in df.columns if name != json_col]
    rows = parse_changes(df.withColumn("_text", F.col(json_col)), json_col, fields)
    side = F.when(F.col("op") == DELETE, "before").otherwise("after")
    reason = F.when(F.col("op").isNull(), "not a change envelope")
    for field in fields:
        if field.name in kept:
            continue
        given = F.when(side == "before", F.get_json_object("_text", f"$.before.{field.name}")).otherwise(
            F.get_json_object("_text", f"$.after.{field.name}"))
        reason = reason.when(F.col(field.name).isNull() & given.isNotNull(), f"no {field.dataType.simpleString()}: {field.name}")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select(*kept, F.col("_text").alias(json_col), "reason")


def from_row_kinds(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Upstream row kinds as ``op``; the image before an update carries nothing new and is left out."""
    ops = F.create_map(*[F.lit(part) for pair in ROW_KIND_OPS.items() for part in pair])
    return df.where(F.col(kind).isin(*ROW_KIND_OPS)).withColumn("op", ops[F.col(kind)]).drop(kind)


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(field.dataType) for field in kind)
    return True


def fold_changes(changes: DataFrame, keys: Sequence[str], seq: str = "seq", op: str = "op",
                 keep_deletes: bool = False) -> DataFrame:
    """Last change per key; keys whose last change is a delete are gone.

    One aggregate with partial results on the map side: a key with any number of changes sends
    one row per task. Changes with equal ``seq`` are ordered by the rest of the row, so the
    outcome does not depend on arrival.
    """
    rest = [name for name in changes.columns if name not in {*keys, seq}]
    row = F.struct(seq, *rest)
    orderable = all(_orderable(changes.schema[name].dataType) for name in rest)
    last = F.max(row) if orderable else F.max_by(row, F.col(seq))
    folded = changes.groupBy(*keys).agg(last.alias("_last"))
    if not keep_deletes:
        folded = folded.where(F.col(f"_last.{op}") != DELETE)
    columns = [F.col(name) if name in keys else F.col(f"_last.{name}").alias(name) for name in changes.columns]
    return folded.select(*columns)


def to_state(table: DataFrame, seq) -> DataFrame:
    """A plain table as state: every row present as of ``seq`` (a column or a number)."""
    seq = F.col(seq) if isinstance(seq, str) else F.lit(seq)
    return table.withColumn(SEQ, seq.cast("bigint")).withColumn(DELETED, F.lit(False))


def visible(state: DataFrame) -> DataFrame:
    """The table a reader sees: no deleted rows, no bookkeeping columns."""
    return state.where(~F.col(DELETED)).drop(SEQ, DELETED)


def last_changes(state: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str, op: str) -> DataFrame:
    """The last change of each key as rows of the state."""
    payload = [name for name in state.columns if name not in {*keys, SEQ, DELETED}]
    folded = fold_changes(changes.select(*keys, *payload, seq, op), keys, seq, op, keep_deletes=True)
    return folded.select(*keys, *payload, F.col(seq).cast("bigint").alias(SEQ), (F.col(op) == DELETE).alias(DELETED))


def _pick(state_side: str, change_side: str, columns: Sequence[str]) -> list:
    """Columns of the change when it is there and not older than the stored row, else of the state."""
    newer = F.col(f"{change_side}.{SEQ}").isNotNull() & (
        F.col(f"{state_side}.{SEQ}").isNull() | (F.col(f"{change_side}.{SEQ}") >= F.col(f"{state_side}.{SEQ}"))
    )
    return [F.when(newer, F.col(f"{change_side}.{name}")).otherwise(F.col(f"{state_side}.{name}")).alias(name)
            for name in columns]


def upsert(state: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str = "seq", op: str = "op",
           patch: bool = False) -> DataFrame:
    """New state of a table after ``changes``; the input state is left as it is.

    The plain form is one full outer join of the state with the folded changes, at no shuffle
    for the state when it is bucketed by key. ``patch`` suits few changes on a large state: the folded
    changes become a table of known size and the state is only ever the streamed side of left joins, so
    the planner broadcasts the changes when they are under its limit and shuffles both when they are not.
    """
    last = last_changes(state, changes, keys, seq, op)
    columns = state.columns
    if patch:
        last = written(last, "changes")
    if not patch:
        s, c = state.withColumn("_in_s", F.lit(True)).alias("s"), last.withColumn("_in_c", F.lit(True)).alias("c")
        joined = s.join(c, [F.col(f"s.{key}") == F.col(f"c.{key}") for key in keys], "full_outer")
        key_columns = [F.coalesce(f"s.{key}", f"c.{key}").alias(key) for key in keys]
        rest = [name for name in columns if name not in keys]
        return joined.select(*key_columns, *_pick("s", "c", rest)).select(*columns)
    rest = [name for name in columns if name not in keys]
    joined = state.alias("s").join(last.alias("c"), [F.col(f"s.{key}") == F.col(f"c.{key}") for key in keys], "left")
    updated = joined.select(*[F.col(f"s.{key}").alias(key) for key in keys], *_pick("s", "c", rest)).select(*columns)
    matched = state.select(*keys).join(last.select(*keys), list(keys), "left_semi")
    added = last.join(matched, list(keys), "left_anti").select(*columns)
    return updated.unionByName(added)


def append_changes(target: DataFrame, changes: DataFrame, op: str = "op", seq: str = "seq") -> DataFrame:
    """A table without key takes every inserted row as it comes."""
    return target.unionByName(changes.where(F.col(op) == "c").select(*target.columns))


def full_then_incremental(snapshot: DataFrame, snapshot_seq: int, changes: DataFrame, keys: Sequence[str],
                          seq: str = "seq", op: str = "op") -> DataFrame:
    """Full copy first, then the changes that came after it."""
    later = changes.where(F.col(seq) > snapshot_seq)
    return visible(upsert(to_state(snapshot, snapshot_seq), later, keys, seq, op))


def incremental_only(changes: DataFrame, start_seq: int, keys: Sequence[str], seq: str = "seq",
                     op: str = "op") -> DataFrame:
    """Only changes after the start; the table begins empty."""
    return fold_changes(changes.where(F.col(seq) > start_seq), keys, seq, op)


def row_kinds(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a downstream reader must apply to get from one table version to the next.

    ``+I`` and ``-D`` for rows that came or went, ``-U`` with the old and ``+U`` with the new image.
    """
    payload = [name for name in after.columns if name not in keys]
    b = before.select(*keys, F.struct(*payload).alias("old"))
    a = after.select(*keys, F.struct(*payload).alias("new"))
    image = lambda kind, side: F.struct(F.lit(kind).alias("row_kind"), F.col(side).alias("image"))
    kinds = (
        F.when(F.col("old").isNull(), F.array(image("+I", "new")))
        .when(F.col("new").isNull(), F.array(image("-D", "old")))
        .when(~F.col("old").eqNullSafe(F.col("new")), F.array(image("-U", "old"), image("+U", "new")))
    )
    return (
        b.join(a, list(keys), "full_outer")
        .select(*keys, F.explode(kinds).alias("_k"))
        .select(*keys, "_k.row_kind", *[F.col(f"_k.image.{name}").alias(name) for name in payload])
    )
