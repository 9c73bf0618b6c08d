"""Record-level deltas: compute, apply, count, compare.

Records are keyed by ``(agent_id, id)`` and carry ``ord struct<delta,pos>``.  Delta
entries carry ``delta_seq``, ``pos`` (unique within the delta), ``operation`` and the
columns of the record.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.ordering import with_position
from memloom.schemas import DELTA_OPERATIONS, ORD
from memloom.session import by_key

KEY = ["agent_id", "id"]


def records_equal(left: str, right: str, columns: Sequence[str]) -> Column:
    """Field-wise equality of two aliased record sets, null equal to null.

    Instants compare as instants and open fields as canonical JSON, so neither
    spelling nor key order matters; list order does.
    """
    same = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    return reduce(lambda a, b: a & b, same, F.lit(True))


def compute_delta(old: DataFrame, new: DataFrame, ignore_cols: Sequence[str] = ()) -> DataFrame:
    """Changes that turn ``old`` into ``new``.

    Adds ``operation`` and ``op_rank``; sort by ``(op_rank, ord)`` for the list order:
    creates and updates as in ``new``, then deletes as in ``old``.  An id that ``old``
    holds twice is compared by its last row, and every row of a vanished id is deleted.
    """
    payload = [c for c in new.columns if c not in (*KEY, "ord")]
    compared = [c for c in payload if c not in ignore_cols]

    def narrow(df: DataFrame) -> DataFrame:
        return df.select(*KEY, "ord", content_digest(compared).alias("digest"))

    # only keys, places and digests are compared; records follow for what has changed
    fresh = narrow(new)
    sides = old.select(*KEY, F.struct("ord", content_digest(compared).alias("digest")).alias("row"), F.lit(None).cast("boolean").alias("stays"))
    sides = sides.unionByName(new.select(*KEY, F.lit(None).cast(sides.schema["row"].dataType).alias("row"), F.lit(True).alias("stays")))
    # one summary for each key: both uses below read both of its columns, so that its shuffle is shared
    last = sides.groupBy(*KEY).agg(F.max("row").alias("last"), F.max("stays").alias("stays"))
    changed = fresh.join(by_key(last.where("stays")), KEY).where(~F.col("last.digest").eqNullSafe(F.col("digest"))).select(
        *KEY, "ord", F.when(F.col("last").isNull(), "create").otherwise("update").alias("operation"))
    gone = last.where(F.col("stays").isNull() & F.col("last").isNotNull()).select(*KEY)
    out = ["operation", *KEY, "ord", *payload]
    written = new.join(by_key(changed), [*KEY, "ord"]).select(*out)
    deleted = old.join(by_key(gone), KEY, "left_semi").withColumn("operation", F.lit("delete")).select(*out)
    rank = F.when(F.col("operation") == "create", 0).when(F.col("operation") == "update", 1)
    return written.unionByName(deleted).withColumn("op_rank", rank.otherwise(2))


def content_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the named fields, equal exactly where :func:`records_equal` holds.

    The fields are written out by name, so a value cannot pass for one of another field.
    """
    text = F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return F.unhex(F.sha2(text, 256))


def number_deltas(changes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Computed changes as entries of each agent's next delta (S7): ``delta_seq`` and a ``pos``
    from 0 in list order, ready to be written and applied.

    ``sequences``: ``agent_id, last_sequence``; agents not in it start from 0.
    """
    last = sequences.select("agent_id", F.col("last_sequence").cast("bigint").alias("base_sequence"))
    placed = with_position(changes, ["agent_id"], [F.col("op_rank"), F.col("ord")], along=last)
    return placed.withColumn(
        "base_sequence", F.coalesce("base_sequence", F.lit(0).cast("bigint"))
    ).withColumn("delta_seq", F.col("base_sequence") + 1).drop("op_rank", "ord")


def change_counts(deltas: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Creates, updates and deletes per agent."""
    return deltas.groupBy(*by).agg(*[
        F.count_if(F.col("operation") == op).alias(f"{op}s")
        for op in DELTA_OPERATIONS
    ])


# --- applying deltas --------------------------------------------------------

# positions per chunk: bounds every collected array whatever the skew of the ids
CHUNK = 4096

_SEGMENT = "struct<delta:bigint,chunk:bigint,after:bigint,n:bigint,upd_delta:bigint,upd_pos:bigint>"
_STATE = f"struct<live:array<{_SEGMENT}>,pend:array<{_SEGMENT}>,idx:boolean,cur:bigint>"

# What one chunk of one delta does to the rows of one id.  `live` are the rows the id
# has at the start of a delta, as runs of rows of one chunk; `pend` those this delta
# created; `idx` says whether the id still is indexed.  Created rows are not indexed
# before the next delta, so updates and deletes only ever reach the last row of `live`.
_ROLL = f"""
named_struct(
  'live', if(acc.cur <=> s.delta, acc.live, concat(acc.live, acc.pend)),
  'pend', if(acc.cur <=> s.delta, acc.pend, cast(array() as array<{_SEGMENT}>)),
  'idx',  if(acc.cur <=> s.delta, acc.idx, size(acc.live) + size(acc.pend) > 0),
  'cur',  s.delta)
"""

_SEG = """named_struct('delta', s.delta, 'chunk', s.chunk, 'after', {after}, 'n', {n},
  'upd_delta', cast(null as bigint), 'upd_pos', cast(null as bigint))"""

_INIT_LIVE = "slice(r.live, 1, size(r.live) - 1)"
_LAST = "element_at(r.live, -1)"


def _fold_step() -> str:
    def push(where: str, after: str, n: str) -> str:
        return f"if({n} > 0, concat({where}, array({_SEG.format(after=after, n=n)})), {where})"

    popped = f"""if({_LAST}.n > 1, concat({_INIT_LIVE}, array(named_struct(
        'delta', {_LAST}.delta, 'chunk', {_LAST}.chunk, 'after', {_LAST}.after,
        'n', {_LAST}.n - 1, 'upd_delta', cast(null as bigint), 'upd_pos', cast(null as bigint)))),
        {_INIT_LIVE})"""
    replaced = f"""concat({_INIT_LIVE}, array(named_struct(
        'delta', {_LAST}.delta, 'chunk', {_LAST}.chunk, 'after', {_LAST}.after, 'n', {_LAST}.n,
        'upd_delta', s.delta, 'upd_pos', s.upd)))"""
    no_row = "-1L"
    return f"""case
      when s.n_base > 0 then named_struct(
        'live', {push('r.live', no_row, 's.n_base')}, 'pend', r.pend, 'idx', r.idx, 'cur', r.cur)
      when r.idx and s.first_delete is not null then named_struct(
        'live', {popped}, 'pend', {push('r.pend', 's.first_delete', 's.n_create_after')},
        'idx', false, 'cur', r.cur)
      when r.idx and s.upd is not null then named_struct(
        'live', {replaced}, 'pend', r.pend, 'idx', r.idx, 'cur', r.cur)
      when not r.idx then named_struct(
        'live', r.live, 'pend', {push('r.pend', no_row, 's.n_create')},
        'idx', r.idx, 'cur', r.cur)
      else r end"""


def _with_roll(step: str) -> str:
    """Bind the rolled-over state to ``r`` (a one-element list stands in for a let)."""
    return f"element_at(transform(array({_ROLL}), r -> {step}), 1)"


def _chunk_events(base_keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Sorted ``(pos, op)`` lists per (agent, id, delta, chunk), at most CHUNK long."""
    op = F.col("operation")
    steps = entries.select(
        *KEY,
        F.col("delta_seq").cast("bigint").alias("delta"),
        F.col("pos").cast("bigint").alias("pos"),
        F.when(op == "create", 1).when(op == "update", 2).otherwise(3).alias("op"),
    )
    events = base_keys.withColumn("op", F.lit(0)).unionByName(steps)
    return (
        events.withColumn("chunk", F.floor(F.col("pos") / CHUNK).cast("bigint"))
        .groupBy(*KEY, "delta", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "op"))).alias("ev"))
    )


def _summaries(chunks: DataFrame) -> DataFrame:
    ops = lambda code: F.filter("ev", lambda e: e["op"] == code)
    first_delete = F.try_element_at(ops(3), F.lit(1))["pos"]
    return chunks.select(*KEY, "delta", "chunk", "ev", first_delete.alias("first_delete")).select(
        *KEY, "delta", "chunk", "first_delete",
        F.size(ops(0)).cast("bigint").alias("n_base"),
        F.size(ops(1)).cast("bigint").alias("n_create"),
        F.expr("size(filter(ev, e -> e.op = 1 and e.pos > first_delete))").cast("bigint")
        .alias("n_create_after"),
        F.expr("""array_max(transform(filter(ev, e -> e.op = 2 and
                  (first_delete is null or e.pos < first_delete)), e -> e.pos))""").alias("upd"),
    )


def _actions(base_keys: DataFrame, entries: DataFrame) -> DataFrame:
    """What becomes of the records of touched ids, by the place they come from.

    A row names the place ``(delta, pos)`` of a base row or an entry and the list place
    ``ord`` its record takes.  A base row listed without ``ord`` goes; base rows that
    stay and entries without effect are not listed.
    """
    chunks = _chunk_events(base_keys, entries)
    folded = (
        _summaries(chunks)
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct(
            "delta", "chunk", "n_base", "first_delete", "upd", "n_create", "n_create_after"
        ))).alias("steps"))
        .select(*KEY, F.expr(f"""inline(aggregate(steps,
            cast(named_struct('live', array(), 'pend', array(), 'idx', false, 'cur', null)
                 as {_STATE}),
            (acc, s) -> cast({_with_roll(_fold_step())} as {_STATE}),
            acc -> concat(acc.live, acc.pend)))"""))
    )
    placed = chunks.join(by_key(folded), [*KEY, "delta", "chunk"], "left")
    kept = F.expr("slice(filter(ev, e -> e.op < 2 and e.pos > after), 1, cast(n as int))")
    placed = placed.select(
        *KEY, "delta", "ev", "upd_delta", "upd_pos",
        F.coalesce(kept, F.expr("filter(ev, e -> false)")).alias("kept"),
    ).withColumn(
        # rows of a chunk go from its end, so what is left is its beginning
        "last_kept", F.coalesce(F.try_element_at("kept", F.lit(-1))["pos"], F.lit(-1))
    )
    return placed.select(*KEY, F.expr(f"""inline(concat(
        transform(
          filter(transform(kept, (e, i) -> named_struct('e', e,
                   'upd', if(i = size(kept) - 1, upd_pos, null))),
                 k -> k.e.op = 1 or k.upd is not null),
          k -> named_struct(
                 'delta', if(k.upd is null, delta, upd_delta), 'pos', coalesce(k.upd, k.e.pos),
                 'ord', cast(named_struct('delta', delta, 'pos', k.e.pos) as {ORD}))),
        transform(
          filter(ev, e -> e.op = 0 and (e.pos > last_kept
            or (upd_pos is not null and e.pos = last_kept))),
          e -> named_struct('delta', delta, 'pos', e.pos, 'ord', cast(null as {ORD})))))"""))


def apply_deltas(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """The record list after a chain of deltas, applied in ``delta_seq`` order.

    ``delta_seq`` must be above every ``ord.delta`` of the base.  Survivors keep their
    ``ord``, created rows get ``(delta_seq, pos)``; order by it to get the list.
    Unknown operations are skipped.

    Only keys and positions take part in the fold.  Records move once, in one join with
    the list of what the fold decided.  Joins sort by key: ids read out of JSON lines count
    for a fraction of a byte when Spark guesses sizes from files, and would be broadcast.
    """
    entries = deltas.where(F.col("operation").isin(*DELTA_OPERATIONS))
    touched = entries.select(*KEY).distinct()
    base_keys = base.select(
        *KEY, F.col("ord.delta").cast("bigint").alias("delta"), F.col("ord.pos").alias("pos")
    ).join(by_key(touched), KEY, "left_semi")
    actions = _actions(base_keys, entries).select(
        *KEY, "delta", "pos", F.col("ord").alias("_ord"), F.lit(True).alias("_listed")
    )
    payload = [c for c in base.columns if c not in (*KEY, "ord")]
    rows = base.select(
        *KEY, F.col("ord.delta").cast("bigint").alias("delta"), F.col("ord.pos").alias("pos"),
        F.lit(True).alias("_base"), *payload,
    ).unionByName(entries.where("operation <> 'delete'").select(
        *KEY, F.col("delta_seq").cast("bigint").alias("delta"),
        F.col("pos").cast("bigint").alias("pos"), F.lit(False).alias("_base"), *payload,
    ))
    settled = rows.join(by_key(actions), [*KEY, "delta", "pos"], "left").where(
        F.when(F.col("_base"), F.col("_listed").isNull()).otherwise(F.col("_ord").isNotNull())
    )
    place = F.coalesce("_ord", F.struct("delta", "pos").cast(ORD))
    return settled.select(*KEY, place.alias("ord"), *payload)


def apply_delta(base: DataFrame, delta: DataFrame) -> DataFrame:
    """The record list after one delta."""
    return apply_deltas(base, delta)


def diff_records(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Ids that differ between two record sets, by content.

    An id held twice counts by its last row, so each key meets one row on either side.
    """
    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEY).agg(F.max_by(F.struct("content"), F.col("ord")).alias(name))

    both = last(expected, "e").join(last(actual, "a"), KEY, "full_outer")
    status = (
        F.when(F.col("a").isNull(), "missing")
        .when(F.col("e").isNull(), "unexpected")
        .when(~F.col("e.content").eqNullSafe(F.col("a.content")), "content mismatch")
    )
    return both.select(
        *KEY, status.alias("difference"),
        F.col("e.content").alias("expected"), F.col("a.content").alias("actual"),
    ).where(F.col("difference").isNotNull())


def diff_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Agents whose two record sets differ in size."""
    e = expected.groupBy("agent_id").agg(F.count(F.lit(1)).alias("expected"))
    a = actual.groupBy("agent_id").agg(F.count(F.lit(1)).alias("actual"))
    return e.join(a, "agent_id", "full_outer").na.fill(0, ["expected", "actual"]).where(
        "expected <> actual"
    )
