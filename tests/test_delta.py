import random

import pytest
from pyspark.sql import functions as F

import models
from memloom.operators import delta as D

BASE = "agent_id string, id string, ord struct<delta:int,pos:bigint>, content string"
ENTRY = "agent_id string, id string, delta_seq int, pos bigint, operation string, content string"


def base_df(spark, agents):
    rows = [
        (a, r[0], (0, i), r[1]) for a, rows in agents.items() for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(rows, BASE)


def delta_df(spark, agents):
    rows = [
        (a, r[0], k, i, op, r[1])
        for a, deltas in agents.items()
        for k, d in enumerate(deltas, 1)
        for i, (op, r) in enumerate(d)
    ]
    return spark.createDataFrame(rows, ENTRY)


def as_lists(df):
    out = {}
    for r in df.orderBy("agent_id", "ord").collect():
        out.setdefault(r.agent_id, []).append((r.id, r.content))
    return out


def random_agents(seed, n, deltas=3, ids=5, events=7):
    rng = random.Random(seed)
    base, chain = {}, {}
    for a in range(n):
        name = f"a{a}"
        base[name] = [(str(rng.randrange(ids)), f"b{i}") for i in range(rng.randrange(5))]
        chain[name] = [
            [
                (
                    rng.choice(["create", "update", "delete", "create", "update", "delete", "merge"]),
                    (str(rng.randrange(ids)), f"d{k}.{i}"),
                )
                for i in range(rng.randrange(events))
            ]
            for k in range(deltas)
        ]
    return base, chain


@pytest.mark.parametrize("chunk", [4096, 2])
def test_apply_chain_equals_list_model(spark, monkeypatch, chunk):
    monkeypatch.setattr(D, "CHUNK", chunk)
    base, chain = random_agents(7, 300)
    got = as_lists(D.apply_deltas(base_df(spark, base), delta_df(spark, chain)))
    want = {a: models.apply_all(base[a], chain[a]) for a in base}
    assert got == {a: rows for a, rows in want.items() if rows}


@pytest.mark.parametrize("chunk", [4096, 3])
def test_apply_many_copies_of_one_id(spark, monkeypatch, chunk):
    """One id holds nearly all rows of the base and of the deltas."""
    monkeypatch.setattr(D, "CHUNK", chunk)
    base = {"a": [("hot", f"b{i}") for i in range(40)] + [("x", "b")]}
    chain = {"a": [
        [("delete", ("hot", "d"))] + [("create", ("hot", f"c{i}")) for i in range(20)],
        [("update", ("hot", "u1")), ("update", ("hot", "u2"))],
        [("delete", ("hot", ""))],
        [("update", ("hot", "u3")), ("create", ("hot", "no")), ("delete", ("hot", ""))],
        [("update", ("hot", "u4"))],
    ]}
    got = as_lists(D.apply_deltas(base_df(spark, base), delta_df(spark, chain)))
    assert got["a"] == models.apply_all(base["a"], chain["a"])


CASES = {
    "mixed": ([("k", "1"), ("u", "1"), ("d", "1")],
              [[("create", ("n", "1")), ("update", ("u", "2")), ("delete", ("d", "1"))]],
              [("k", "1"), ("u", "2"), ("n", "1")]),
    "create existing": ([("a", "1")], [[("create", ("a", "2"))]], [("a", "1")]),
    "missing": ([("a", "1")], [[("update", ("b", "2")), ("delete", ("b", "2"))]], [("a", "1")]),
    "unknown": ([("a", "1")], [[("merge", ("b", "2"))]], [("a", "1")]),
    "double create": ([], [[("create", ("a", "1")), ("create", ("a", "2"))]],
                      [("a", "1"), ("a", "2")]),
    "create then update": ([], [[("create", ("a", "1")), ("update", ("a", "2"))]], [("a", "1")]),
    "delete then create": ([("a", "1"), ("b", "1")],
                           [[("delete", ("a", "")), ("create", ("a", "2"))]],
                           [("b", "1"), ("a", "2")]),
    "chain": ([("1", "a")],
              [[("create", ("2", "b")), ("update", ("1", "c"))],
               [("delete", ("1", "")), ("create", ("3", "d"))]],
              [("2", "b"), ("3", "d")]),
    "no deltas": ([("a", "1")], [[]], [("a", "1")]),
}


def test_apply_cases(spark):
    base = {n: c[0] for n, c in CASES.items()}
    chain = {n: c[1] for n, c in CASES.items()}
    got = as_lists(D.apply_deltas(base_df(spark, base), delta_df(spark, chain)))
    assert got == {n: c[2] for n, c in CASES.items()}


def _entries(df):
    out = {}
    for r in df.orderBy("agent_id", "op_rank", "ord").collect():
        out.setdefault(r.agent_id, []).append((r.operation, (r.id, r.content)))
    return out


def test_compute_equals_list_model(spark):
    rng = random.Random(3)
    old, new = {}, {}
    for a in range(200):
        old[f"a{a}"] = [(str(rng.randrange(6)), rng.choice("xyz")) for _ in range(rng.randrange(7))]
        new[f"a{a}"] = [(str(rng.randrange(6)), rng.choice("xyz")) for _ in range(rng.randrange(7))]
    got = _entries(D.compute_delta(base_df(spark, old), base_df(spark, new)))
    want = {a: models.compute(old[a], new[a]) for a in old}
    assert got == {a: d for a, d in want.items() if d}


def test_apply_of_computed_delta_gives_new(spark):
    rng = random.Random(5)
    old = {f"a{a}": [(str(i), rng.choice("xy")) for i in rng.sample(range(9), 5)] for a in range(50)}
    new = {f"a{a}": [(str(i), rng.choice("xy")) for i in rng.sample(range(9), 5)] for a in range(50)}
    o, n = base_df(spark, old), base_df(spark, new)
    d = D.compute_delta(o, n)
    from pyspark.sql import Window
    place = Window.partitionBy("agent_id").orderBy("op_rank", "ord")
    d = d.withColumn("pos", F.row_number().over(place) - 1).withColumn("delta_seq", F.lit(1))
    result = D.apply_deltas(o, d)
    assert D.diff_records(n, result).count() == 0
    assert D.diff_counts(n, result).count() == 0
    assert {k: sorted(v) for k, v in as_lists(result).items()} == {
        k: sorted(v) for k, v in new.items()
    }


def test_equality_of_instants_lists_and_ignored_columns(spark):
    ddl = BASE + ", tags array<string>, at timestamp"
    old = spark.sql(
        "select 'a' agent_id, '1' id, named_struct('delta',0,'pos',0L) ord, 'c' content, "
        "array('x','y') tags, timestamp'2026-01-01 00:00:00Z' at union all "
        "select 'a', '2', named_struct('delta',0,'pos',1L), 'c', array('x','y'), null"
    )
    new = spark.sql(
        "select 'a' agent_id, '1' id, named_struct('delta',0,'pos',0L) ord, 'c' content, "
        "array('x','y') tags, timestamp'2026-01-01 01:00:00+01:00' at union all "
        "select 'a', '2', named_struct('delta',0,'pos',1L), 'c', array('y','x'), null"
    )
    assert ddl
    assert [(r.operation, r.id) for r in D.compute_delta(old, new).collect()] == [("update", "2")]
    assert D.compute_delta(old, new, ignore_cols=["tags"]).count() == 0
    counts = D.change_counts(D.compute_delta(old, new)).first()
    assert (counts.creates, counts.updates, counts.deletes) == (0, 1, 0)


def test_diff_records(spark):
    e = base_df(spark, {"a": [("1", "x"), ("2", "y"), ("3", "z")]})
    a = base_df(spark, {"a": [("1", "x"), ("2", "q"), ("4", "z")]})
    got = {r.id: r.difference for r in D.diff_records(e, a).collect()}
    assert got == {"2": "content mismatch", "3": "missing", "4": "unexpected"}


def test_digests_tell_fields_apart_and_move_few_records(spark):
    row = "select 'a' agent_id, '{0}' id, named_struct('delta',0L,'pos',{0}L) ord, {1} x, {2} y, 'body {0}' content"
    old = spark.sql(" union all ".join([row.format(1, "'v'", "null"), row.format(2, "'v'", "'w'")]))
    new = spark.sql(" union all ".join([row.format(1, "null", "'v'"), row.format(2, "'v'", "'w'")]))
    found = D.compute_delta(old, new)
    assert [(r.operation, r.id) for r in found.collect()] == [("update", "1")]
    plan = D.compute_delta(base_df(spark, {"a": [("1", "x")]}), base_df(spark, {"a": [("1", "x")]}))
    text = plan._jdf.queryExecution().sparkPlan().toString()
    # contents stand in no aggregate: records are only looked up for keys that changed
    assert "max_by(content" not in text and "SortAggregate" not in text.split("content#")[0]


def test_numbered_deltas_have_dense_positions(spark):
    old = {f"a{a}": [(str(i), "x") for i in range(5)] for a in range(3)}
    new = {f"a{a}": [(str(i), "y") for i in range(2, 8)] for a in range(3)}
    seqs = spark.createDataFrame([("a0", 7)], "agent_id string, last_sequence bigint")
    o, n = base_df(spark, old), base_df(spark, new)
    d = D.number_deltas(D.compute_delta(o, n), seqs)
    rows = d.collect()
    for a in old:
        mine = sorted((r.pos, r.operation) for r in rows if r.agent_id == a)
        assert [p for p, _ in mine] == list(range(8))
        assert [op for _, op in mine] == ["create"] * 3 + ["update"] * 3 + ["delete"] * 2
    assert {r.delta_seq for r in rows if r.agent_id == "a0"} == {8} and {r.delta_seq for r in rows if r.agent_id == "a1"} == {1}
    assert D.diff_records(n, D.apply_deltas(o, d)).count() == 0


def _unbroadcast(spark, build):
    """The first plan of ``build()`` where no side of a join counts as small."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in off}
    try:
        for k, value in off.items():
            spark.conf.set(k, value)
        return build()._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, value in was.items():
            spark.conf.set(k, value)


def test_changed_and_vanished_keys_share_a_shuffle(spark, tmp_path):
    rows = {"a": [("1", "x"), ("2", "y")]}
    for side in ("old", "new"):
        base_df(spark, rows).write.parquet(str(tmp_path / side))
    read = lambda side: spark.read.parquet(str(tmp_path / side))
    plan = _unbroadcast(spark, lambda: D.compute_delta(read("old"), read("new")))
    assert sum("ReusedExchange" in line for line in plan) == 1
    # keys and digests of the new side, the summary of keys, changed keys, and the records of both sides
    assert sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan) == 5


def test_changes_move_once_to_be_numbered(spark, tmp_path):
    base_df(spark, {"a": [("1", "x"), ("2", "y")]}).select(
        "*", F.lit("create").alias("operation"), F.lit(0).alias("op_rank")).write.parquet(str(tmp_path / "c"))
    seqs = spark.createDataFrame([("a", 7)], "agent_id string, last_sequence bigint")
    plan = _unbroadcast(spark, lambda: D.number_deltas(spark.read.parquet(str(tmp_path / "c")), seqs))
    moved = [i for i, line in enumerate(plan) if " Exchange " in line and "content#" in plan[i + 1]]
    assert len(moved) == 1


def test_round_trip_computes_its_delta_once(spark, monkeypatch):
    from memloom.plans.catalog import QUERIES
    from memloom.sources import sinks

    seen, write = [], sinks.write_deltas
    monkeypatch.setattr(sinks, "write_deltas", lambda *args, **more: (seen.extend(args[:2]), write(*args, **more)))
    QUERIES["sync_round_trip"](spark, "/root/testdata/sf0.001")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def _sides(spark, path):
    """A base, its changes and their entries in small files, whose sizes say nothing of their rows."""
    base_df(spark, {"a": [("1", "x"), ("2", "y")]}).write.parquet(f"{path}/base")
    delta_df(spark, {"a": [[("update", ("1", "z")), ("delete", ("2", None))]]}).write.parquet(f"{path}/entries")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    read("base").select("*", F.lit("create").alias("operation"), F.lit(0).alias("op_rank")).write.parquet(f"{path}/changes")
    return read("base"), read("changes"), read("entries")


def test_records_are_not_broadcast_by_file_size(spark, tmp_path):
    base, changes, entries = _sides(spark, str(tmp_path))
    marks = base.select("agent_id").distinct().withColumn("last_sequence", F.lit(0))
    applied, numbered = D.apply_deltas(base, entries), D.number_deltas(changes, marks)
    for df in (applied, numbered, D.compute_delta(base, base.withColumn("content", F.lit("v")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert as_lists(applied) == {"a": [("1", "z")]}
    assert sorted((r.id, r.pos) for r in numbered.collect()) == [("1", 0), ("2", 1)]


def test_written_entries_stay_in_their_tasks(spark, tmp_path):
    from memloom.schemas import RECORD_FIELDS
    from memloom.sources import sinks

    _, _, entries = _sides(spark, str(tmp_path))
    rows = entries.select("*", *[F.lit(None).cast(t).alias(c) for c, t in RECORD_FIELDS.items() if c not in entries.columns])
    sinks.write_deltas(rows, rows.select("agent_id", "delta_seq").distinct(), str(tmp_path / "d"), "p1", buckets=2)
    plan = _unbroadcast(spark, lambda: sinks.read_delta_tables(spark, str(tmp_path / "d"))[0])
    # one name for each push is sent; entries would all meet at the name of theirs
    assert any("BroadcastHashJoin" in line for line in plan) and not any("SortMergeJoin" in line for line in plan)
    assert sinks.read_delta_tables(spark, str(tmp_path / "d"))[0].count() == 2
