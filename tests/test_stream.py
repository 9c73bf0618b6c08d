import json
import uuid
from collections import Counter

import models
import pytest
from pyspark.sql import functions as F

from memloom.streaming import ingest

ENTRY = (
    "agent_id string, id string, base_sequence bigint, delta_seq int, pos bigint, "
    "operation string, content string"
)
COUNTED = f"{ENTRY}, record_count bigint"
BASE = "agent_id string, id string, ord struct<delta:int,pos:bigint>, content string"


def counted(spark, rows):
    """Entries with the count their delta's manifest would have."""
    sizes = Counter(r[:1] + r[2:4] for r in rows)
    return spark.createDataFrame([(*r, sizes[r[:1] + r[2:4]]) for r in rows], COUNTED)


def write(spark, path, name, rows):
    counted(spark, rows).coalesce(1).write.json(f"{path}/{name}")


def start(spark, tmp_path, base):
    rows = [(a, i, (0, n), c) for a, lst in base.items() for n, (i, c) in enumerate(lst)]
    seqs = spark.createDataFrame([(a, 0) for a in base], "agent_id string, last_sequence bigint")
    return ingest.start_feed(spark.createDataFrame(rows, BASE), seqs, str(tmp_path / "feed"))


def lists(df):
    out = {}
    for r in df.orderBy("agent_id", "ord").collect():
        out.setdefault(r.agent_id, []).append((r.id, r.content))
    return out


def run(spark, tmp_path, state, on_gap="reject"):
    stream = spark.readStream.schema(COUNTED).option("recursiveFileLookup", "true").option(
        "maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = ingest.stream_apply_deltas(stream, state, str(tmp_path / "ck"), on_gap)
    q.awaitTermination()
    assert q.exception() is None


def test_deltas_arrive_in_order(spark, tmp_path):
    base = {"a": [("1", "x"), ("2", "y")], "b": [("1", "z")]}
    state = start(spark, tmp_path, base)
    d1 = [("update", ("1", "x1")), ("create", ("3", "n"))]
    d2 = [("delete", ("2", "")), ("create", ("3", "dup")), ("merge", ("1", "no"))]
    write(spark, tmp_path / "in", "d1", [("a", i, 0, 1, p, op, c) for p, (op, (i, c)) in enumerate(d1)])
    run(spark, tmp_path, state)
    write(spark, tmp_path / "in", "d2", [("a", i, 1, 2, p, op, c) for p, (op, (i, c)) in enumerate(d2)])
    write(spark, tmp_path / "in", "d3", [("b", "9", 5, 6, 0, "create", "gap")])
    run(spark, tmp_path, state)
    assert lists(state.records()) == {"a": models.apply_all(base["a"], [d1, d2]), "b": base["b"]}
    assert {r.agent_id: r.last_sequence for r in state.sequences().collect()} == {"a": 2, "b": 0}
    assert [(r.agent_id, r.verdict) for r in state.rejects().collect()] == [("b", "gap")]
    before = lists(state.records())
    replay = counted(spark, [("a", "1", 0, 1, 0, "delete", "")])
    with pytest.raises(ValueError, match="not this feed's"):
        ingest.apply_batch(state, replay, 0)
    for _ in range(2):  # a batch that runs again writes the same rows
        ingest.apply_batch(state, replay, 99)
    assert lists(state.records()) == before
    assert state.rejects().where("batch = 99").count() == 1
    assert {r.verdict for r in state.rejects().collect()} == {"gap", "stale"}


def test_held_deltas_wait_for_their_predecessor(spark, tmp_path):
    base = {"a": [("1", "x")]}
    state = start(spark, tmp_path, base)
    late = counted(spark, [("a", "1", 1, 2, 0, "update", "second")])
    ingest.apply_batch(state, late, 0, "hold")
    assert lists(state.records()) == base and state.held().count() == 1
    first = counted(spark, [("a", "1", 0, 1, 0, "update", "first"), ("a", "2", 0, 1, 1, "create", "n")])
    ingest.apply_batch(state, first, 1, "hold")
    assert lists(state.records()) == {"a": [("1", "second"), ("2", "n")]}
    assert state.held().count() == 0 and state.rejects().count() == 0


def test_incomplete_conflicting_and_emptying_deltas(spark, tmp_path):
    state = start(spark, tmp_path, {"a": [("1", "x")], "c": [("1", "x")]})
    df = spark.createDataFrame([
        ("a", "1", 0, 1, 0, "delete", ""), ("c", "1", 0, 1, 0, "update", "y"), ("c", "1", 0, 2, 0, "update", "z"),
        ("n", "1", 0, 1, 0, "create", "new")], ENTRY).withColumn(
        "record_count", F.when(F.col("agent_id") == "n", 2).otherwise(1))
    ingest.apply_batch(state, df, 0)
    assert lists(state.records()) == {"c": [("1", "y")]}
    assert {(r.agent_id, r.verdict) for r in state.rejects().collect()} == {("c", "conflict"), ("n", "incomplete")}


def test_a_delta_in_two_batches_is_applied_whole(spark, tmp_path):
    rows = counted(spark, [("a", "1", 0, 1, 0, "update", "x1"), ("a", "2", 0, 1, 1, "create", "n")])
    base = {"a": [("1", "x")]}
    state = start(spark, tmp_path, base)
    ingest.apply_batch(state, rows.where("pos = 0"), 0, "hold")
    assert lists(state.records()) == base
    ingest.apply_batch(state, rows.where("pos = 1"), 1, "hold")
    assert lists(state.records()) == {"a": [("1", "x1"), ("2", "n")]}
    ingest.apply_batch(state, rows.withColumns({
        "base_sequence": F.lit(1), "delta_seq": F.lit(2), "record_count": F.lit(None).cast("bigint")}), 2, "hold")
    assert lists(state.records()) == {"a": [("1", "x1"), ("2", "n")]}
    assert [r.verdict for r in state.rejects().collect()] == ["uncounted"]


def test_an_applied_batch_runs_again(spark, tmp_path):
    state = start(spark, tmp_path, {"a": [("1", "x")]})
    rows = counted(spark, [("a", "2", 0, 1, 0, "create", "n")])
    for _ in range(2):
        ingest.apply_batch(state, rows, 0)
    assert lists(state.records()) == {"a": [("1", "x"), ("2", "n")]} and state.rejects().count() == 0


def test_a_part_sent_twice_does_not_make_a_delta_whole(spark, tmp_path):
    rows = counted(spark, [("a", "1", 0, 1, 0, "update", "x1"), ("a", "2", 0, 1, 1, "create", "n")])
    state = start(spark, tmp_path, {"a": [("1", "x")]})
    for n in (0, 1):
        ingest.apply_batch(state, rows.where("pos = 0"), n, "hold")
    assert lists(state.records()) == {"a": [("1", "x")]} and state.held().count() == 1
    ingest.apply_batch(state, rows.where("pos = 1"), 2, "hold")
    assert lists(state.records()) == {"a": [("1", "x1"), ("2", "n")]}


def test_a_folded_feed_goes_on(spark, tmp_path):
    state = start(spark, tmp_path, {"a": [("1", "x")], "b": [("1", "z")]})
    assert ingest.fold_feed(state, str(tmp_path / "unused")).start() == ingest.START
    first = counted(spark, [("a", "1", 0, 1, 0, "update", "x1"), ("b", "1", 1, 2, 0, "update", "z2")])
    ingest.apply_batch(state, first, 0, "hold")
    folded = ingest.fold_feed(state, str(tmp_path / "folded"))
    assert lists(folded.records()) == {"a": [("1", "x1")], "b": [("1", "z")]}
    ingest.apply_batch(folded, first, 0, "hold")  # the base holds it
    assert folded.held().count() == 1 and folded.rejects().count() == 0
    ingest.apply_batch(folded, counted(spark, [("b", "2", 0, 1, 0, "create", "n")]), 1, "hold")
    assert lists(folded.records()) == {"a": [("1", "x1")], "b": [("1", "z2"), ("2", "n")]}
    assert {r.agent_id: r.last_sequence for r in folded.sequences().collect()} == {"a": 1, "b": 2}


def test_record_stream(spark, tmp_path):
    d = tmp_path / "lines"
    d.mkdir()
    rec = {"id": str(uuid.uuid4()), "agent_id": "a", "content": "c", "memory_type": "semantic", "status": "active",
           "namespace": "n", "source": {"runtime": "r"}, "temporal": {"created_at": "2026-01-01T00:00:00Z"}}
    (d / "1.jsonl").write_text(json.dumps(rec) + "\n\n bad\n")
    q = ingest.stream_records(spark, str(d)).writeStream.format("memory").queryName("recs").trigger(
        availableNow=True).start()
    q.awaitTermination()
    assert [(r.id, r.source.runtime) for r in spark.table("recs").collect()] == [(rec["id"], "r")]
