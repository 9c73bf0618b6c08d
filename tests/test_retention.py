"""Retention in batch, and as a stream with timers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from memloom.operators import retention as R
from memloom.plans import views as v
from memloom.streaming import retention as S

T0 = dt.datetime(2026, 1, 1)
ROW = "agent_id string, id string, importance double, seen timestamp"


def at(days):
    return T0 + dt.timedelta(days=days)


def test_tiers(spark):
    rows = [("a", "1", 0.8, T0), ("a", "2", 0.79, T0), ("a", "3", 0.4, T0), ("a", "4", 0.39, T0), ("a", "5", None, T0),
            ("a", "6", float("nan"), T0), ("a", "7", -1.0, T0), ("a", "8", 0.1, None)]
    found = {r["id"]: (r["tier"], r["expires_at"]) for r in R.retention(spark.createDataFrame(rows, ROW), v.ts("2026-01-08")).collect()}
    assert found == {"1": ("structural", None), "2": ("potential", at(30)), "3": ("potential", at(30)), "4": ("contextual", at(7)),
                     "5": (None, None), "6": (None, None), "7": ("contextual", at(7))}
    left = R.retained(spark.createDataFrame(rows, ROW), v.ts("2026-01-08"))
    assert {r["id"] for r in left.collect()} == {"1", "2", "3", "5", "6", "8"}


def test_seeing_memory_again_starts_anew(spark):
    rows = spark.createDataFrame([("a", "1", 0.1, T0), ("a", "1", 0.1, at(5)), ("a", "2", 0.9, T0), ("a", "2", 0.1, T0)], ROW)
    found = {r["id"]: (r["tier"], r["expired"]) for r in R.retention(rows, v.ts("2026-01-09")).collect()}
    assert found == {"1": ("contextual", False), "2": ("structural", False)}


def test_upkeep_of_files(spark):
    rows = [("a", p, T0) for p in ("memory/2026-01-01.md", "Memory/2025-12-24.md", "memory/archive/2025-12-01.md", "memory/archive/2025-12-31.md",
                                   "memory/session_9.md", "memory/session_a/b.md", "MEMORY.md", "memory/archive/session_1.md", "memory/2026-13-01.md")]
    found = {r["path"]: (r["action"], r["target"]) for r in R.upkeep(spark.createDataFrame(rows, "agent_id string, path string, mtime timestamp"), v.ts("2026-01-08")).collect()}
    assert found["memory/2026-01-01.md"] == ("archive", "memory/archive/2026-01-01.md")
    assert found["memory/archive/2025-12-01.md"] == ("purge", None) and found["memory/archive/2025-12-31.md"][0] == "keep"
    assert found["memory/session_9.md"] == ("archive", "memory/archive/session_9.md")
    assert all(found[p] == ("keep", p) for p in ("MEMORY.md", "memory/session_a/b.md", "memory/archive/session_1.md", "memory/2026-13-01.md"))


@pytest.fixture
def timers(spark):
    before = {k: spark.conf.get(k, None) for k in S.STORE}
    for k, value in S.STORE.items():
        spark.conf.set(k, value)
    yield spark
    for k, value in before.items():
        spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def test_stream_expires_between_batches(timers, tmp_path):
    spark = timers
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("a", "short", 0.1, T0), ("a", "long", 0.5, T0), ("a", "ever", 0.9, T0), ("a", "again", 0.1, T0), ("a", "none", None, T0)],
        [("a", "again", 0.1, at(6)), ("b", "clock", 0.9, at(8))],  # a week is over for "short", not for "again"
        [("b", "clock", 0.9, at(14))],
        [("a", "short", 0.9, at(20)), ("b", "clock", 0.9, at(31))],
        [("b", "clock", 0.9, at(60))],
    ]
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, ROW).coalesce(1).write.mode("append").parquet(given)
        stream = spark.readStream.schema(ROW).parquet(given)
        q = S.stream_expired(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(
            availableNow=True).start(out)
        q.awaitTermination()
        rows = spark.read.schema(S.EXPIRED).parquet(out).collect() if (tmp_path / "out").exists() else []
        seen.append({(r["id"], r["tier"], r["expires_at"]) for r in rows})
    assert seen[0] == set()
    assert seen[1] == {("short", "contextual", at(7))}
    assert seen[2] == seen[1] | {("again", "contextual", at(13))}
    assert seen[3] == seen[4] == seen[2] | {("long", "potential", at(30))}
    every = spark.createDataFrame([r for b in batches for r in b], ROW)
    gone = R.retention(every, v.ts("2026-03-02")).where("expired").select("id").collect()
    assert {r["id"] for r in gone} == {"again", "long"}  # "short" was seen again, as a lasting one
