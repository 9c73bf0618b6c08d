import datetime as dt

import pytest
from pyspark.sql import functions as F

from memloom.operators import migrate, snapshot as snap, sync, validate as V
from memloom.schemas import CREDENTIAL_DDL, IDENTITY_DDL, MANIFEST_DDL, RECORD_FIELDS

T0 = dt.datetime(2026, 1, 1)


def rules(df):
    return sorted((r.rule, r.path) for r in df.collect())


def manifest_row(spark, **change):
    base = {
        "alf_version": "1.0.0", "created_at": "x",
        "agent": {"id": "a", "name": "n", "source_runtime": "r"},
        "layers": {"memory": {"record_count": 10, "index_file": "i", "partitions": [
            {"file": "p1", "from": dt.date(2026, 1, 1), "to": dt.date(2026, 3, 31), "record_count": 6, "sealed": True},
            {"file": "p2", "from": dt.date(2026, 4, 1), "to": None, "record_count": 4, "sealed": False}]}},
        "checksum": "sha256:ab", "agent_id": "a", "extra": None,
    }
    base.update(change)
    return spark.createDataFrame([base], "agent_id string, extra string, " + MANIFEST_DDL)


def test_manifest_rules(spark):
    assert rules(V.validate_manifests(manifest_row(spark))) == []
    bad = manifest_row(
        spark, alf_version="not-semver", agent={"id": "a", "name": "", "source_runtime": ""}, checksum="abc",
        extra='{"zz":1,"yy":2}',
        layers={"memory": {"record_count": 999, "partitions": [
            {"file": "p2", "from": dt.date(2026, 4, 1), "to": None, "record_count": 4, "sealed": True},
            {"file": "p1", "from": dt.date(2026, 1, 1), "to": dt.date(2026, 3, 31), "record_count": 6, "sealed": True}]}})
    assert rules(V.validate_manifests(bad)) == [
        ("V1", "manifest.alf_version"), ("V2", "manifest.agent.name"), ("V3", "manifest.agent.source_runtime"),
        ("V4", "manifest.checksum"), ("V5", "manifest.layers.memory"), ("V6", "manifest.layers.memory.partitions"),
        ("V7", "manifest.layers.memory.partitions[0]"), ("V8", "manifest.yy"), ("V8", "manifest.zz")]
    assert rules(V.validate_manifests(manifest_row(spark, layers={}, checksum=None))) == []


def test_record_rules(spark):
    ddl = "ord struct<delta:int,pos:bigint>, " + ", ".join(f"{k} {v}" for k, v in RECORD_FIELDS.items())
    ok = {"agent_id": "a", "id": "1", "content": "c", "memory_type": "semantic", "status": "active", "namespace": "n",
          "source": {"runtime": "r"}, "temporal": {"created_at": T0}, "ord": (0, 0), "confidence": 1.0,
          "embeddings": [{"dimensions": 1, "vector": [0.5]}], "tags": [], "entities": [], "related_records": []}
    bad = {**ok, "ord": (0, 7), "content": "", "namespace": "", "confidence": 1.5, "memory_type": "m", "status": "s",
           "source": {"runtime": ""}, "extra": '{"k":1}',
           "embeddings": [{"dimensions": 1, "vector": [0.5]}, {"dimensions": 3, "vector": [0.5]}]}
    df = spark.createDataFrame([ok, bad], ddl)
    assert rules(V.validate_records(df)) == sorted([
        ("V9", "records[7].content"), ("V10", "records[7].namespace"), ("V11", "records[7].confidence"),
        ("V12", "records[7].embeddings[1]"), ("V13", "records[7].source.runtime"), ("V14", "records[7].memory_type"),
        ("V15", "records[7].status"), ("V16", "records[7].k")])
    found = V.validate_records(df)
    (v,) = V.validity(df, found).collect()
    assert (v.errors, v.warnings, v.is_valid) == (5, 3, False)
    assert V.errors(found).count() == 5 and V.warnings(found).count() == 3
    with pytest.raises(ValueError):
        V.fail_fast(found)


def test_layer_rules(spark):
    ident = {"agent_id": "b", "version": 0, "structured": {
        "names": {"primary": ""}, "capabilities": [{"name": "x"}, {"name": ""}], "sub_agents": [{"name": ""}]},
        "extra": '{"q":1}'}
    ids = spark.createDataFrame([ident], IDENTITY_DDL + ", extra string")
    assert rules(V.validate_identities(ids)) == [
        ("V17", "identity.version"), ("V18", "identity.structured.names.primary"),
        ("V19", "identity.structured.capabilities[1].name"), ("V20", "identity.structured.sub_agents[0].name"),
        ("V21", "identity.q")]
    pr = spark.createDataFrame(
        [("a", "p1", "robot", 0, (1, "p2")), ("a", "p3", "human", 1, (0, "p3"))],
        "owner string, id string, principal_type string, pos int, profile struct<version:int,principal_id:string>")
    assert rules(V.validate_principals(pr)) == [
        ("V22", "principals[1].profile.version"), ("V23", "principals[0].profile.principal_id"),
        ("V24", "principals[0].principal_type")]
    cr = spark.createDataFrame([{"agent_id": "a", "service": "", "credential_type": "odd", "encrypted_payload": "",
                                 "encryption": {"algorithm": "", "nonce": ""}}], CREDENTIAL_DDL)
    assert [r for r, _ in rules(V.validate_credentials(cr))] == ["V25", "V26", "V27", "V28", "V29"]
    links = V.validate_links(manifest_row(spark), ids.withColumn("agent_id", F.lit("a")))
    assert rules(links) == []


def test_links_by_archive(spark):
    m = manifest_row(spark).withColumn("archive", F.lit("z.alf"))
    ids = spark.createDataFrame([("z.alf", "other")], "archive string, agent_id string")
    recs = spark.createDataFrame([("z.alf", "a")] * 3, "archive string, agent_id string")
    assert rules(V.validate_links(m, ids, recs)) == [
        ("V30", "identity.agent_id"), ("V31", "manifest.layers.memory.record_count")]


def test_partition_inventory_and_layers(spark):
    df = spark.createDataFrame(
        [("a", (dt.datetime(2026, 1, 5), None), []), ("a", (dt.datetime(2026, 4, 5), dt.datetime(2026, 2, 1)), []),
         ("a", (dt.datetime(2026, 4, 5), None), [1])],
        "agent_id string, temporal struct<created_at:timestamp,observed_at:timestamp>, embeddings array<int>")
    at = F.lit("2026-04-01").cast("timestamp")
    got = [tuple(r)[1:] for r in snap.partition_inventory(df, at).orderBy("file").collect()]
    assert got == [("memory/2026-Q1.jsonl", dt.date(2026, 1, 1), dt.date(2026, 3, 31), 2, True),
                   ("memory/2026-Q2.jsonl", dt.date(2026, 4, 1), dt.date(2026, 6, 30), 1, False)]
    assert not any(r.sealed for r in snap.partition_inventory(df, at, seal="never").collect())
    (m,) = snap.memory_inventory(df, at).collect()
    assert (m.memory.record_count, m.memory.has_embeddings, m.memory.has_raw_source) == (3, True, False)
    docs = spark.createDataFrame(
        [("a", "identity", 0, "d0"), ("a", "identity", 2, "d2"), ("a", "identity", 3, None), ("a", "principals", 1, "p")],
        "agent_id string, layer string, seq bigint, doc string")
    assert sorted((r.layer, r.doc) for r in snap.latest_layers(docs).collect()) == [("identity", "d2"), ("principals", "p")]
    entries = spark.createDataFrame([(e,) for e in (
        "raw/r/a", "raw/r/b/c", "raw/x", "raw/r/", "artifacts/f", "artifacts/d/", "memory/x")], "entry string")
    assert sorted(r.entry for r in snap.carry_files(entries).collect()) == ["artifacts/f", "raw/r/a", "raw/r/b/c"]


def test_delta_manifest(spark):
    deltas = spark.createDataFrame([("a",), ("a",)], "agent_id string")
    state = spark.createDataFrame([("a", 5, T0, "p")],
                                  "agent_id string, last_synced_sequence bigint, last_synced_at timestamp, snapshot_path string")
    at = F.lit("2026-02-01").cast("timestamp")
    (m,) = snap.delta_manifest(deltas, state, at, F.lit("openclaw")).collect()
    assert (m.sync.base_sequence, m.sync.new_sequence, m.changes.memory.record_count) == (5, 0, 2)
    assert m.changes.identity is None and m.agent.source_runtime == "openclaw"
    layers = spark.createDataFrame([("a", "identity", 3, None), ("b", "principals", None, ["p"])],
                                   "agent_id string, layer string, new_version int, changed_ids array<string>")
    got = {r.agent_id: r for r in snap.delta_manifest(deltas, state, at, F.lit("r"), layers).collect()}
    assert got["a"].changes.identity.new_version == 3 and got["b"].changes.principals.changed_ids == ["p"]
    assert got["b"].changes.memory is None


def test_sync_and_restore(spark):
    agents = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "agent_id string")
    state = spark.createDataFrame([("a", 0, T0, "p"), ("b", 4, T0, None), ("d", 0, None, None)],
                                  "agent_id string, last_synced_sequence bigint, last_synced_at timestamp, snapshot_path string")
    counts = spark.createDataFrame([("a", 1, 0, 2), ("c", 1, 0, 0)],
                                   "agent_id string, creates bigint, updates bigint, deletes bigint")
    plan = {r.agent_id: (r.action, r.base_sequence, r.changes) for r in sync.sync_plan(agents, state, counts).collect()}
    assert plan == {"a": ("delta", 0, 3), "b": ("no_changes", 4, 0), "c": ("snapshot", 0, 0), "d": ("snapshot", 0, 0)}
    res = spark.createDataFrame([("a", 1, T0, "q"), ("z", 1, T0, "r")],
                                "agent_id string, sequence bigint, at timestamp, snapshot_path string")
    new = {r.agent_id: (r.last_synced_sequence, r.snapshot_path) for r in sync.advance_state(state, res).collect()}
    assert new == {"a": (1, "q"), "b": (4, None), "d": (0, None), "z": (1, "r")}
    snaps = spark.createDataFrame([("a", 1, "s1"), ("a", 3, "s3"), ("b", 2, "t2")], "agent_id string, sequence bigint, url string")
    deltas = spark.createDataFrame([("a", 2, "d2"), ("a", 4, "d4"), ("a", 5, "d5"), ("c", 1, "e1")],
                                   "agent_id string, sequence bigint, url string")
    steps = [(r.agent_id, r.kind, r.sequence, r.url) for r in
             sync.restore_plan(agents, snaps, deltas).orderBy("agent_id", "sequence").collect()]
    assert steps == [("a", "snapshot", 3, "s3"), ("a", "delta", 4, "d4"), ("a", "delta", 5, "d5"),
                     ("b", "snapshot", 2, "t2"), ("c", "error", None, None), ("d", "error", None, None)]
    rs = sync.restored_state(sync.restore_plan(agents, snaps, deltas), F.lit(T0))
    assert {r.agent_id: r.sequence for r in rs.collect()} == {"a": 5, "b": 2}
    assert sync.deltas_since(deltas, F.lit(3)).count() == 2
    since = spark.createDataFrame([("a", 4), ("c", 0)], "agent_id string, since bigint")
    assert sorted(r.url for r in sync.deltas_since(deltas, since).collect()) == ["d5", "e1"]
    pushed = spark.createDataFrame([("a", 5), ("b", 0), ("n", 0)], "agent_id string, base_sequence bigint")
    assert [(r.agent_id, r.latest_sequence) for r in sync.sequence_conflicts(
        pushed, deltas.select("agent_id", "sequence")).collect()] == []
    assert [(r.agent_id, r.latest_sequence) for r in sync.sequence_conflicts(
        pushed.withColumn("base_sequence", F.lit(1)), deltas.select("agent_id", "sequence")).orderBy("agent_id").collect()
    ] == [("a", 5), ("b", 0), ("n", 0)]
    st = {r.agent_id: r.snapshot_exists for r in sync.fleet_status(state, snaps).collect()}
    assert st == {"a": True, "b": True, "d": False}
    assert {r.agent_id: r.last_sequence for r in snap.highest_sequence(
        spark.createDataFrame([("a", None), ("b", 9)], "agent_id string, last_sequence bigint"),
        spark.createDataFrame([("a", 3, 0), ("b", 3, 7)], "agent_id string, base_sequence bigint, new_sequence bigint"),
    ).collect()} == {"a": 4, "b": 9}


def test_import_report(spark):
    m = manifest_row(spark, layers={"memory": {"record_count": 3, "partitions": []}, "identity": {"version": 1},
                                    "credentials": {"count": 2}})
    none = m.select("agent_id").limit(0)
    (r,) = migrate.import_report(m, none, "openclaw").collect()
    assert (r.memory_records, r.identity_imported, r.credentials_count, len(r.warnings)) == (3, True, 2, 3)
    (r,) = migrate.import_report(m, m, "zeroclaw").collect()
    assert r.warnings == []
