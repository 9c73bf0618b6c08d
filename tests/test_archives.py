import datetime as dt
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from memloom.operators import delta, migrate, report, snapshot as snap, validate as V
from memloom.plans import export, rebuild, registry
from memloom.sources import archives, sinks, workspaces

AGENT = str(uuid.uuid4())
def now():
    return F.lit("2026-06-15 00:00:00").cast("timestamp")



def rec(i, content="c", month=1, **more):
    return {
        "id": str(uuid.UUID(int=i)), "agent_id": AGENT, "content": content, "memory_type": "semantic",
        "source": {"runtime": "r"}, "temporal": {"created_at": f"2026-{month:02d}-05T00:00:00Z"},
        "status": "active", "namespace": "workspace", **more,
    }


def identity(version, name="N"):
    return {"id": str(uuid.uuid4()), "agent_id": AGENT, "version": version,
            "updated_at": "2026-01-01T00:00:00Z", "structured": {"names": {"primary": name}}}


def write_zip(path, entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data if isinstance(data, (str, bytes)) else json.dumps(data))


def jsonl(rows):
    return "\n".join(json.dumps(r) for r in rows) + "\n"


def snapshot_zip(path, partitions, extra=None, layers=None, count=None):
    layers = dict(layers or {})
    n = sum(len(v) for v in partitions.values())
    layers["memory"] = {
        "record_count": n if count is None else count, "index_file": "memory/index.json",
        "partitions": [
            {"file": f, "from": "2026-01-01", "to": "2026-03-31", "record_count": len(v), "sealed": False}
            for f, v in partitions.items()
        ],
    }
    manifest = {
        "alf_version": "1.0.0", "created_at": "2026-01-01T00:00:00Z", "raw_sources": ["r"],
        "agent": {"id": AGENT, "name": "A", "source_runtime": "r"}, "layers": layers,
        "sync": {"last_sequence": 3}, "checksum": "sha256:ab", "new_field": {"b": 1},
    }
    entries = {f: jsonl(v) if isinstance(v, list) else v for f, v in partitions.items()}
    write_zip(path, {**entries, **(extra or {}), "manifest.json": manifest})


def delta_zip(path, base, new, entries, layers=None):
    changes = {"memory": {"file": "memory/delta.jsonl", "record_count": len(entries)}}
    files = {"memory/delta.jsonl": jsonl({"operation": op, **r} for op, r in entries)}
    for name, doc in (layers or {}).items():
        changes[name] = {"file": f"{name}.json"}
        files[f"{name}.json"] = doc
    write_zip(path, {**files, "delta-manifest.json": {
        "alf_version": "1.0.0", "created_at": "2026-01-01T00:00:00Z", "agent": {"id": AGENT},
        "sync": {"base_sequence": base, "new_sequence": new}, "changes": changes}})


@pytest.fixture()
def base_dir(tmp_path):
    d = tmp_path / "base"
    d.mkdir()
    snapshot_zip(
        d / "a.alf", {"memory/2026-Q2.jsonl": [rec(3, month=4)], "memory/2026-Q1.jsonl": [rec(1), rec(2, "two")]},
        {"identity.json": identity(1), "raw/r/SOUL.md": "# S", "raw/loose": "x", "artifacts/f.bin": b"\x00\x01",
         "attachments.json": {"attachments": [
             {"id": "1", "filename": "f", "media_type": "m", "size_bytes": 4711, "archive_path": "artifacts/f.bin",
              "hash": {"algorithm": "sha256", "value": "ab"}, "source_path": "f"},
             {"id": "2", "filename": "g", "media_type": "m", "size_bytes": 73000019,
              "hash": {"algorithm": "sha256", "value": "ab"}, "source_path": "g"}]}},
        {"identity": {"version": 1, "file": "identity.json"}, "attachments": {"count": 2, "file": "attachments.json"}},
    )
    return d


def test_scan_keeps_manifest_order_and_fields(spark, base_dir):
    entries = archives.scan_archives(spark, str(base_dir))
    recs = archives.scan_records(entries).orderBy("ord").collect()
    assert [(r.ord.pos, r.id[-1]) for r in recs] == [(0, "3"), (1, "1"), (2, "2")]
    (m,) = archives.manifests(entries).collect()
    assert m.agent.name == "A" and m.extra == '{"new_field":{"b":1}}' and m.sync.last_sequence == 3
    roles = {(r.entry, r.role) for r in entries.select("entry", "role").collect()}
    assert ("raw/r/SOUL.md", "file") in roles and ("identity.json", "identity") in roles
    only = archives.scan_archives(spark, str(base_dir), roles=["manifest"]).collect()
    assert [r.entry for r in only] == ["manifest.json"]
    atts = archives.scan_layer(entries, "attachments")
    (a,) = snap.attachment_rollup(atts).collect()
    assert (a["count"], a.included_count, a.included_size_bytes, a.referenced_count, a.referenced_size_bytes) == (
        2, 1, 4711, 1, 73000019)


def test_bad_archives_and_lines_are_findings(spark, tmp_path):
    bad = [json.dumps(rec(1)), "", "not json", json.dumps({**rec(2), "id": "x", "supersedes": "y"}),
           json.dumps({k: v for k, v in rec(3).items() if k != "content"}),
           json.dumps(rec(4, temporal={"created_at": "2026-01-01", "access_count": -1})), "  "]
    snapshot_zip(tmp_path / "a.alf", {"memory/2026-Q1.jsonl": bad}, count=9)
    z = tmp_path / "a.alf"
    with zipfile.ZipFile(z) as f:
        parts = {n: f.read(n) for n in f.namelist()}
    parts["memory/2026-Q1.jsonl"] = "\n".join(bad).encode()
    m = json.loads(parts["manifest.json"])
    m["layers"]["identity"] = {"version": 1, "file": "identity.json"}
    parts["manifest.json"] = json.dumps(m)
    write_zip(z, parts)
    (tmp_path / "b.alf").write_bytes(b"no zip")
    entries = archives.scan_archives(spark, str(tmp_path))
    gone = archives.missing(entries).collect()
    assert {(r.path, r.rule) for r in gone} == {("identity.json", "P6"), ("manifest.json", "P6")}
    lines = archives.memory_lines(entries)
    got = V.validate_lines(lines).collect()
    assert {(r.rule, r.line_number, r.path.split(":", 1)[1].split(".", 1)[-1]) for r in got} == {
        ("P1", 3, "3"), ("P3", 4, "id"), ("P3", 4, "supersedes"), ("P2", 5, "content"),
        ("P4", 6, "temporal.created_at"), ("P5", 6, "temporal.access_count")}
    with pytest.raises(ValueError, match="P1|P2|P3|P4|P5"):
        archives.scan_records(entries, mode="failfast")
    with pytest.raises(ValueError):
        archives.scan_records(entries, mode="x")


def test_rebuild(spark, base_dir, tmp_path):
    d = tmp_path / "deltas"
    d.mkdir()
    delta_zip(d / "1.alf-delta", 3, 0, [("create", rec(4, month=7)), ("update", rec(2, "2b")), ("merge", rec(1, "no"))],
              {"identity": identity(2, "Two"), "principals": {"principals": [
                  {"id": "p", "principal_type": "human", "profile": {
                      "id": "q", "agent_id": AGENT, "principal_id": "p", "version": 1, "updated_at": "x",
                      "structured": {"name": "U", "timezone": "A/B"}}}]}})
    delta_zip(d / "2.alf-delta", 4, 7, [("delete", {"id": rec(1)["id"], "agent_id": AGENT})])
    staged = archives.stage_archives(spark, str(base_dir), str(tmp_path / "staged"))
    base = rebuild.read_snapshot(spark, str(base_dir), staged)
    deltas, marks, docs = rebuild.read_deltas(spark, str(d))
    new = rebuild.rebuild_snapshot(base, deltas, marks, now(), docs)
    recs = new.records.orderBy("ord").collect()
    assert [(r.id[-1], r.content) for r in recs] == [("3", "c"), ("2", "2b"), ("4", "c")]
    (m,) = new.manifests.collect()
    assert m.sync.last_sequence == 7 and m.checksum is None and m.raw_sources == ["r"]
    assert m.extra == '{"new_field":{"b":1}}'
    assert [(p.file, p.record_count, p.sealed) for p in m.layers.memory.partitions] == [
        ("memory/2026-Q1.jsonl", 1, True), ("memory/2026-Q2.jsonl", 1, False), ("memory/2026-Q3.jsonl", 1, False)]
    assert m.layers.identity.version == 2 and m.layers.principals["count"] == 1
    assert m.layers.memory.has_raw_source is True and m.layers.memory.has_embeddings is False
    assert m.layers.attachments.included_size_bytes == 4711
    assert {r.entry for r in new.files.collect()} == {"raw/r/SOUL.md", "artifacts/f.bin"}
    assert V.validate_manifests(new.manifests).where("severity = 'error'").count() == 0
    same = rebuild.rebuild_snapshot(base, None, None, now())
    assert same.records.count() == 3 and same.manifests.first().sync.last_sequence == 3

    files = migrate.profile_files(
        new.identities.drop("agent_id").withColumnRenamed("owner", "agent_id"), new.principals, "openclaw")
    got = {r.path: r.content for r in files.collect()}
    assert got == {"SOUL.md": "# Two\n\nAI Assistant\n", "USER.md": "# U\n\n## Timezone\n\nA/B\n"}

    out = str(tmp_path / "out")
    sinks.write_snapshot(new, out, buckets=4)
    assert sinks.read_records(spark, f"{out}/records").count() == 3
    sinks.write_records(new.records, f"{out}/lines", layout="jsonl")
    back = archives.records_of_lines(archives.text_lines(spark.read.text(f"{out}/lines").select("value")))
    assert sorted(r.content for r in back.collect()) == ["2b", "c", "c"]
    assert sorted(json.loads(r.value)["id"][-1] for r in spark.read.text(f"{out}/lines").collect()) == ["2", "3", "4"]


def test_delta_lines(spark, tmp_path, base_dir):
    d = tmp_path / "deltas"
    d.mkdir()
    entries = [("create", rec(4, 'q"é')), ("odd\"op", rec(5))]
    delta_zip(d / "1.alf-delta", 0, 1, entries)
    deltas, marks, _ = rebuild.read_deltas(spark, str(d))
    got = [json.loads(r.value) for r in sinks.delta_lines(deltas).orderBy("pos").collect()]
    assert [(g["operation"], g["content"]) for g in got] == [("create", 'q"é'), ('odd"op', "c")]
    out = str(tmp_path / "pushed")
    for _ in range(2):
        sinks.write_deltas(deltas, marks, out, "p1")
    sinks.write_deltas(deltas, marks, out, "p2")
    assert spark.read.parquet(f"{out}/push=p1/entries").count() == 2


def make_workspace(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text) if isinstance(text, str) else p.write_bytes(text)


def test_export_import_markdown(spark, tmp_path):
    root = tmp_path / "ws"
    files = {
        "w1/SOUL.md": "# Ada\n\nkind", "w1/USER.md": "# Bo\n## Timezone\nA/B\n", "w1/TOOLS.md": "t",
        "w1/MEMORY.md": "# M\n\n## P\nx\n", "w1/memory/2026-01-15.md": "## A\n1\n\n## B\n2\n",
        "w1/memory/facts.db": b"\xff\x00", "w1/notes.txt": "n", "w1/other.md": "o",
        "w2/SOUL.md": "no heading", "w2/.alf-agent-id": AGENT + "\n",
    }
    make_workspace(root, files)
    table = workspaces.scan_workspaces(spark, str(root))
    s = export.export_workspaces(table, "openclaw", now())
    by = {r.agent.name: r for r in s.manifests.collect()}
    assert sorted(by) == ["Ada", "w2"]
    assert by["w2"].agent_id == AGENT and by["w2"].layers.memory is None
    ada = by["Ada"]
    want = str(uuid.uuid5(uuid.UUID(bytes=b"alf-agent-id-ns1"), f"{root}/w1"))
    assert ada.agent_id == want and ada.layers.memory.record_count == 4
    assert ada.layers.memory.has_raw_source and ada.layers.principals["count"] == 1
    recs = s.records.orderBy("ord").collect()
    assert [r.namespace for r in recs] == ["daily", "daily", "curated", "curated"]
    assert [r.ord.pos for r in recs] == [0, 1, 2, 3]
    assert V.validate(s.manifests, s.records, s.identities, s.principals).count() == 0
    (rep,) = report.export_report(s.manifests, s.files).where("agent_name = 'Ada'").collect()
    assert (rep.memory_records, rep.raw_source_count) == (4, 6)

    back = {r.path: bytes(r.data).decode("latin1") for r in export.import_files(s, "openclaw").where(
        F.col("agent_id") == want).collect()}
    raw = {k[3:]: v if isinstance(v, str) else v.decode("latin1") for k, v in files.items()
           if k.startswith("w1/") and k not in ("w1/notes.txt", "w1/other.md")}
    assert back == {**raw, ".alf-agent-id": want}

    cross = {r.path: bytes(r.data).decode() for r in export.import_files(s, "zeroclaw").where(
        F.col("agent_id") == want).collect()}
    assert cross["memory/2026-01-15.md"] == "## A\n1\n\n\n## B\n2"
    assert cross["MEMORY.md"] == "# M\n\n\n## P\nx" and cross["SOUL.md"] == "# Ada\n\nkind"

    inv = report.workspace_inventory(table)
    got = {r.workspace.rsplit("/", 1)[1]: r for r in inv.collect()}
    w1, w2 = got["w1"], got["w2"]
    assert (w1.soul_md, w1.memory_md, w1.memory_dir, w1.daily_logs, w1.latest_daily) == (
        True, True, True, 1, "2026-01-15.md")
    assert w2.agent_id == AGENT and not w2.memory_dir
    issues = {(r.workspace.rsplit("/", 1)[1], r.code) for r in report.workspace_issues(inv).collect()}
    assert issues == {("w2", "no_memory_content")}


def test_export_table_runtime(spark, tmp_path):
    root = tmp_path / "homes"
    make_workspace(root, {
        "h1/config.toml": 'version="9"\napi_key="s3cret"\n[memory]\nbackend="sqlite"\nembedding_provider="openai"\n',
        "h1/memory.db": b"x", "h1/workspace/SOUL.md": "# Zed\n", "h1/workspace/memory/2026-01-01.md": "not used",
        "h2/config.toml": '[memory]\nbackend="sqlite"\n', "h2/workspace/memory/session_1.md": "used",
        "h3/workspace/memory/archive/2026-01-02.md": "old", "h4/config.toml": '[memory]\nbackend="none"\n',
        "h4/workspace/memory/a.md": "not used",
    })
    table = workspaces.stage_workspaces(spark, str(root), "zeroclaw", str(tmp_path / "staged"))
    ids = {r.workspace.split("/")[-2]: r.agent_id for r in workspaces.workspaces(table).collect()}
    rows = spark.createDataFrame(
        [(ids["h1"], "n1", "k", "c1", "core", "2026-01-01T00:00:00Z"),
         (ids["h2"], "n2", "k", "no", "core", "2026-01-01T00:00:00Z")],
        "agent_id string, id string, key string, content string, category string, timestamp string")
    s = export.export_workspaces(table, "zeroclaw", now(), rows)
    got = {(r.agent_id, r.content, r.source.runtime_version, r.status) for r in s.records.collect()}
    assert got == {(ids["h1"], "c1", "9", "active"), (ids["h2"], "used", None, "active"),
                   (ids["h3"], "old", None, "archived")}
    conf = [bytes(r.data).decode() for r in s.files.where(
        (F.col("entry") == "raw/zeroclaw/config.toml") & (F.col("agent_id") == ids["h1"])).collect()]
    assert len(conf) == 1 and "s3cret" not in conf[0]
    assert "s3cret" not in str(s.credentials.collect()) and s.credentials.count() == 1
    m = {r.agent_id: r for r in s.manifests.collect()}
    assert m[ids["h1"]].agent.name == "Zed" and m[ids["h1"]].layers.credentials["count"] == 1
    restored = {r.path for r in export.import_files(s, "zeroclaw").where(F.col("agent_id") == ids["h1"]).collect()}
    assert "../config.toml" in restored


def test_files_of_records(spark, monkeypatch):
    monkeypatch.setattr(migrate, "PART_RECORDS", 2)
    def row(i, ns, content, origin=None, at=dt.datetime(2026, 1, 5), obs=None, agent="a"):
        return (agent, f"{i:08d}-x", (0, i), ns, content, (origin,), (at, obs))
    rows = [
        row(0, "curated", "c0"), row(1, "daily", "d1", "memory/2026-01-01.md"),
        row(2, "daily", "d2", None, obs=dt.datetime(2026, 2, 3)), row(3, "daily", "d3", ""),
        row(4, "core", "k4"), row(5, "session", "s5"), row(6, "conversation", "v6", "memory/x.md"),
        row(7, "curated", "c7"), row(8, "custom:z", "z8"), row(9, "workspace", "w9", "memory/2026-01-01.md"),
        row(10, "curated", "c10"),
    ]
    df = spark.createDataFrame(rows, """agent_id string, id string, ord struct<delta:int,pos:bigint>, namespace string,
        content string, source struct<origin_file:string>, temporal struct<created_at:timestamp,observed_at:timestamp>""")
    got = {r.path: r.content for r in migrate.rebuilt_files(df, "openclaw").collect()}
    assert got == {
        "MEMORY.md": "c0\n\nc7\n\nc10", "memory/2026-01-01.md": "w9", "memory/2026-02-03.md": "d2",
        "memory/2026-01-05.md": "d3", "memory/core.md": "k4", "memory/session.md": "s5", "memory/x.md": "v6",
        "memory/custom:z.md": "z8"}
    got = {r.path: r.content for r in migrate.rebuilt_files(df, "zeroclaw").collect()}
    assert got == {
        "memory/curated.md": "c0\n\nc7\n\nc10", "memory/2026-01-01.md": "w9", "memory/2026-02-03.md": "d2",
        "memory/2026-01-05.md": "d3\n\nv6", "memory/core.md": "k4", "memory/session_00000005.md": "s5",
        "memory/custom:z.md": "z8"}


def test_large_files_stay_in_parts(spark, monkeypatch):
    monkeypatch.setattr(migrate, "PART_BYTES", 1000)
    monkeypatch.setattr(migrate, "WHOLE_BYTES", 5000)
    at = dt.datetime(2026, 1, 5)
    # one path takes a third of all rows and nearly all bytes
    rows = [("hot" if i % 3 == 0 else f"a{i % 50}", str(i), (0, i), "curated", f"{i} " * (60 if i % 3 == 0 else 1), (None,), (at, None))
            for i in range(3000)]
    df = spark.createDataFrame(rows, """agent_id string, id string, ord struct<delta:int,pos:bigint>, namespace string,
        content string, source struct<origin_file:string>, temporal struct<created_at:timestamp,observed_at:timestamp>""")
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r[5 - 1])
    got = {}
    for r in migrate.rebuilt_files(df, "openclaw").orderBy("agent_id", "part").collect():
        got.setdefault(r.agent_id, []).append(r)
    assert {a: "\n\n".join(r.content for r in parts) for a, parts in got.items()} == {a: "\n\n".join(c) for a, c in want.items()}
    assert all(len(p) == 1 and p[0].part is None for a, p in got.items() if a != "hot")
    assert len(got["hot"]) > 100 and max(len(r.content) for r in got["hot"]) < 2000


def test_registry():
    assert registry.names() == ["openclaw", "zeroclaw"]
    with pytest.raises(ValueError, match="openclaw, zeroclaw"):
        registry.adapter("x")
    registry.register("mine", lambda f: f, lambda r: r)
    assert registry.adapter("mine").name == "mine"
    del registry._ADAPTERS["mine"]


def test_names_with_a_dot_or_underscore_are_read(spark, tmp_path):
    names = ["memory/2026-01-01.md", "memory/_draft.md", "memory/.hidden.md", "memory/_old/x.md", "memory/.arch/y.md"]
    for name in names:
        f = tmp_path / "_home" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("## " + name)
    (tmp_path / "_home" / ".alf-agent-id").write_text(AGENT)
    (tmp_path / "loose.md").write_text("in no workspace")
    files = workspaces.scan_workspaces(spark, str(tmp_path))
    found = {r.path: r for r in files.collect()}
    assert set(names) <= set(found) and "loose.md" not in found
    assert all(found[n].content == "## " + n and bytes(found[n].data) == f"## {n}".encode() for n in names)
    assert {r.agent_id for r in found.values()} == {AGENT}
    assert {r.workspace for r in found.values()} == {f"{tmp_path}/_home"}
    snapshot_zip(tmp_path / "_home" / "_a.alf", {"memory/2026-Q1.jsonl": [rec(1)]})
    snapshot_zip(tmp_path / ".b.alf", {"memory/2026-Q1.jsonl": [rec(2)]})
    ids = [r.id[-1] for r in archives.scan_records(archives.scan_archives(spark, str(tmp_path))).collect()]
    assert sorted(ids) == ["1", "2"]


def test_sequences_beyond_32_bits(spark, tmp_path):
    big = 3_000_000_000
    delta_zip(tmp_path / "a.alf-delta", big, big + 1, [("create", rec(7)), ("update", rec(1, "new"))])
    snapshot_zip(tmp_path / "b.alf", {"memory/2026-Q1.jsonl": [rec(1)]})
    entries, marks, _ = rebuild.read_deltas(spark, str(tmp_path))
    assert [r.delta_seq for r in marks.collect()] == [big + 1]
    base = rebuild.read_snapshot(spark, str(tmp_path))
    out = delta.apply_deltas(base.records, entries).orderBy("ord").collect()
    assert [(r.id[-1], r.content, r.ord.delta) for r in out] == [("1", "new", 0), ("7", "c", big + 1)]


def test_broken_documents_are_findings(spark, tmp_path):
    snapshot_zip(tmp_path / "a.alf", {"memory/2026-Q1.jsonl": [rec(1)]},
                 {"identity.json": "no json", "principals.json": {"principals": 5}, "credentials.json": {"credentials": []}},
                 {n: {"version": 1, "count": 1, "file": f"{n}.json"} for n in ("identity", "principals", "credentials")})
    found = archives.broken_documents(archives.scan_archives(spark, str(tmp_path))).collect()
    assert {(r.path, r.rule) for r in found} == {("identity.json", "P1"), ("principals.json", "P1")}
    delta_zip(tmp_path / "d.alf-delta", 1, 2, [("create", rec(2)), (None, rec(3))])
    found = archives.broken_documents(archives.scan_archives(spark, str(tmp_path), "delta")).collect()
    assert [(r.path, r.message) for r in found] == [("memory/delta.jsonl:2", "no operation")]


def test_import_takes_the_persona_of_a_read_snapshot(spark, tmp_path):
    doc = {**identity(1), "prose": {"soul": "I am."}}
    snapshot_zip(tmp_path / "a.alf", {"memory/2026-Q1.jsonl": [rec(1)]}, {"identity.json": doc},
                 {"identity": {"version": 1, "file": "identity.json"}})
    base = rebuild.read_snapshot(spark, str(tmp_path))
    files = {r.path: bytes(r.data).decode() for r in export.import_files(base, "openclaw").collect()}
    assert files["SOUL.md"] == "I am."


def test_wrong_types_are_findings(spark):
    whole = rec(1, confidence=0.5, tags=["a"], entities=[{"name": "n", "type": "t"}], related_records=[{"id": str(uuid.UUID(int=3)), "relation": "r"}],
                embeddings=[{"model": "m", "dimensions": 1, "vector": [1], "source": "s", "computed_at": "2026-01-05T00:00:00Z"}])
    cases = [
        (whole, set()), ({**whole, "confidence": None, "tags": [], "entities": []}, set()),
        ({**whole, "confidence": "high"}, {"p:3.confidence"}), ({**whole, "tags": "x"}, {"p:4.tags"}),
        ({**whole, "entities": {"name": "n"}}, {"p:5.entities"}), ({**whole, "content": 5}, {"p:6.content"}),
        ({**whole, "entities": [{"name": "n"}, {"name": 1, "type": "t"}]}, {"p:7.entities[0].type", "p:7.entities[1].name"}),
        ({**whole, "embeddings": [{**whole["embeddings"][0], "vector": ["x"], "model": None}]},
         {"p:8.embeddings[0].vector", "p:8.embeddings[0].model"}),
        ({**whole, "embeddings": [{**whole["embeddings"][0], "dimensions": 2**32}]}, {"p:9.embeddings[0].dimensions"}),
        ({**whole, "related_records": [{"id": str(uuid.UUID(int=3))}]}, {"p:10.related_records[0].relation"}),
        ({**whole, "temporal": {**whole["temporal"], "access_count": 2**63}}, set()),
        ({**whole, "source": "r"}, {"p:12.source", "p:12.source.runtime"}),
    ]
    lines = spark.createDataFrame([("p", i + 1, json.dumps(c)) for i, (c, _) in enumerate(cases)],
                                  "partition string, line_number long, line string")
    found = {r.path for r in V.validate_lines(lines).collect()}
    assert found == set().union(*(e for _, e in cases))


def test_a_stored_id_that_is_no_uuid_is_a_finding(spark, tmp_path):
    for name, text in (("a", AGENT + "\n"), ("b", "agent seven"), ("c", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / ".alf-agent-id").write_text(text)
    found = workspaces.broken_agent_ids(workspaces.scan_workspaces(spark, str(tmp_path))).collect()
    assert {(r.workspace.rsplit("/", 1)[1], r.message) for r in found} == {("b", "no UUID: agent seven"), ("c", "no UUID: ")}


def test_typed_lines_have_the_findings_of_values_one_by_one(spark, monkeypatch):
    uid = "123e4567-e89b-12d3-a456-426614174000"
    good = {
        "id": uid, "agent_id": uid, "content": "a", "memory_type": "semantic", "status": "active", "namespace": "n", "confidence": 0.5,
        "source": {"runtime": "r", "identity_version": 3}, "temporal": {"created_at": "2026-01-01T00:00:00Z", "access_count": 4},
        "tags": ["a"], "entities": [{"name": "n", "type": "t"}], "related_records": [{"id": uid, "relation": "r"}],
        "embeddings": [{"model": "m", "dimensions": 2, "vector": [1.0, 2], "computed_at": "2026-01-01T00:00:00Z", "source": "s"}],
    }

    def places(value, at=()):
        for k in value if isinstance(value, dict) else range(len(value)):
            yield (*at, k)
            if isinstance(value[k], (dict, list)):
                yield from places(value[k], (*at, k))

    lines = [json.dumps(good)]
    for at in places(good):
        for value in (None, 5, -1, 1.5, "x", "NaN", [], {}, [None], 2**64, "2026-01-01", "gone"):
            changed = json.loads(lines[0])
            of = changed
            for k in at[:-1]:
                of = of[k]
            if value == "gone":
                del of[at[-1]]
            else:
                of[at[-1]] = value
            lines.append(json.dumps(changed, separators=(",", ":") if len(lines) % 2 else None))
    first = lines[0]
    lines += [
        "", "null", f"[{first}]", first + " x", first.replace('"id": "', '"\\u0069d": "', 1), first.replace('"content": "a"', "'content': 5"),
        first.replace('"content": "a"', '"c\\u006fntent": 5'), first.replace('{"id"', '{"id": "zz", "id"', 1), first.replace("0.5", "NaN"),
        first.replace('"content": "a"', '"content": "a", "more": {"a": 1, "a": 2}'),
    ]
    df = spark.createDataFrame([("p", i, line) for i, line in enumerate(lines)], "partition string, line_number long, line string")
    typed = sorted(map(str, V.validate_lines(df).collect()))
    monkeypatch.setattr(V, "_trusted", lambda m, t, line: F.lit(False))
    assert typed == sorted(map(str, V.validate_lines(df).collect())) and len(typed) > 100
