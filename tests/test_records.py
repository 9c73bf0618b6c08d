import datetime as dt
import json
import random
import struct
import uuid

from pyspark.sql import functions as F

import models
from memloom.functions import ids, notes, quarters, settings, text
from memloom.functions.checks import (
    effective_status, effective_type, is_checksum, is_rfc3339, is_semver, rfc3339,
)
from memloom.functions.json_records import parse_records, record_json
from memloom.operators import memories, profiles, workspace_settings
from memloom.operators.sections import split_sections

AT = dt.datetime(2026, 1, 20, 8, 30)


def col(spark, fn, values, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def files_df(spark, rows):
    return spark.createDataFrame(
        [(a, p, c, AT) for a, p, c in rows], "agent_id string, path string, content string, mtime timestamp"
    )


def test_sections_equal_line_model(spark):
    rng = random.Random(11)
    bits = ["## A", "##x", "### h", " ## i", "text", "", "  ", "## ## B", "# one", "```", "## ", "é#"]
    texts = [
        rng.choice(["\n", "\r\n"]).join(rng.choice(bits) for _ in range(rng.randrange(9)))
        + rng.choice(["", "\n", "\n\n", "\r\n", "\r"])
        for _ in range(500)
    ]
    df = files_df(spark, [("a", str(i), t) for i, t in enumerate(texts)])
    got = {}
    for r in split_sections(df).orderBy("path", "section_index").collect():
        got.setdefault(int(r.path), []).append((r.heading, r.content, r.line_start, r.line_end))
        assert r.section_index == len(got[int(r.path)]) - 1
    for i, t in enumerate(texts):
        assert got.get(i, []) == models.sections(t), repr(t)


def test_sections_need_no_shuffle(spark):
    plan = split_sections(files_df(spark, [("a", "b", "c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_whole_file(spark):
    df = files_df(spark, [("a", "memory/Active-Context.md", "## A\r\nx\n## B\n"), ("a", "active-context", " \n")])
    (r,) = split_sections(df).collect()
    assert (r.heading, r.content, r.line_start, r.line_end) == (None, "## A\r\nx\n## B\n", 1, 3)


def test_path_classes(spark):
    paths = [
        "memory/2026-01-15.md", "MEMORY.md", "memory/active-context.md", "memory/project-x.md",
        "memory/gating-policies.md", "memory/gating_policies.md", "memory/project-gating-policies.md",
        "memory/2026-02-30.md", "memory/sub/2026-01-15.md", "notes.md", "memory/2026-1-5.md",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    p = F.col("p")
    rows = df.select(
        "i", notes.memory_type(p).alias("t"), notes.namespace(p).alias("n"),
        notes.extraction_method(p).alias("m"), notes.daily_date(p).alias("d"),
    ).orderBy("i").collect()
    assert [(r.t, r.n) for r in rows] == [
        ("episodic", "daily"), ("semantic", "curated"), ("summary", "active-context"),
        ("semantic", "project"), ("procedural", "procedural"), ("procedural", "procedural"),
        ("procedural", "project"), ("semantic", "workspace"), ("semantic", "workspace"),
        ("semantic", "workspace"), ("episodic", "daily"),
    ]
    assert [i for i, r in enumerate(rows) if r.m == "user_authored"] == [1, 4, 6]
    assert rows[0].d == dt.date(2026, 1, 15) and rows[10].d == dt.date(2026, 1, 5)


def test_tags(spark):
    assert col(spark, notes.importance_tag, ["x [a|i=0.5] [b|i=1]", "[é|i=.7]", "[a|i=1.2.3]", "[a b|i=1]"]) == [
        ("a", 0.5), ("é", 0.7), None, None]
    assert col(spark, notes.hashtags, ["#a b #c! ##d ## # #é-ü. x#y", " #z"]) == [
        ["a", "c", "d", "é-ü"], ["z"]]
    (got,) = col(spark, lambda c: notes.section_tags(c, F.lit("daily")),
                 ["[fact|i=0.4] #x #daily\n#x [goal|i=1.5]\n[fact|i=0.9]"])
    assert got.tags == ["daily", "fact", "x", "goal"]
    assert (got.confidence, got.category) == (1.5, "fact")


def test_standard_workspace(spark):
    df = files_df(spark, [
        ("a", "MEMORY.md", "# Mem\n\n## P\nlikes\n## Q\nx\n"),
        ("a", "memory/2026-01-15.md", "## A\n1\n## B\n2\n## C\n3\n"),
        ("a", "memory/2026-01-16.md", "## D\n[decision|i=0.9] #ship\n"),
        ("a", "memory/active-context.md", "now\n"),
        ("a", "memory/project-z.md", "## Z\nz"),
        ("a", "memory/gating-policies.md", "## G\ng"),
    ])
    rows = memories.openclaw_records(df).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r.namespace, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {
        "curated": 3, "daily": 4, "active-context": 1, "project": 1, "procedural": 1}
    (d,) = [r for r in by["daily"] if r.category]
    assert (d.category, d.confidence, d.tags) == ("decision", 0.9, ["daily", "decision", "ship"])
    assert d.temporal.created_at == d.temporal.observed_at == dt.datetime(2026, 1, 16)
    assert d.temporal.updated_at == AT
    assert d.id == str(uuid.uuid5(uuid.UUID(bytes=b"openclaw-alf-ns1"), "memory/2026-01-16.md:0"))
    assert json.loads(d.raw_source_format) == {"line_start": 1, "line_end": 2, "heading": "D"}
    assert json.loads(by["active-context"][0].raw_source_format)["heading"] is None
    assert by["curated"][0].temporal.created_at == AT


def test_archive_notes(spark):
    df = files_df(spark, [
        ("a", "memory/2026-01-15.md", "x"), ("a", "memory/archive/2025-12-01.md", "y"),
        ("a", "memory/2026-02-30.md", "z"), ("a", "memory/session_1.md", "## s"),
        ("a", "memory/other.md", "o"), ("a", "memory/2026-1-5.md", "p"), ("a", "memory/b.md", " "),
    ])
    got = {r.source.origin_file: r for r in memories.zeroclaw_note_records(df).collect()}
    assert len(got) == 6
    r = got["memory/archive/2025-12-01.md"]
    assert (r.status, r.namespace, r.tags) == ("archived", "daily", ["daily", "zeroclaw", "archived"])
    assert r.temporal.observed_at == dt.datetime(2025, 12, 1) and r.temporal.updated_at is None
    bad = got["memory/2026-02-30.md"]
    assert (bad.memory_type, bad.temporal.observed_at, bad.temporal.created_at) == ("episodic", None, AT)
    assert got["memory/session_1.md"].namespace == "session"
    assert got["memory/2026-1-5.md"].namespace == "memory"


def f32(n):
    return struct.pack(f"<{n}f", *([0.5] * n))


def test_table_rows(spark):
    good = "6F9619FF-8B86-D011-B42D-00CF4FC964FF"
    rows = [
        ("a", good, "k", "c", "Core", "2026-01-10T01:00:00+01:00", f32(64)),
        ("a", "n1", "assistant_autosave_1", "c", "conversation", "2026-01-11", f32(63)),
        ("a", "n2", "k", "c", "custom:x", "2026-01-12T00:00:00Z", struct.pack("<2049d", *([0.25] * 2049))),
        ("a", "n3", "k", "c", "Work", "2026-01-12T00:00:00Z", None),
        ("a", "n4", "k", "c", "daily", "2026-01-12T00:00:00.5Z", f32(1536)),
        ("a", "n5", "k", "c", "daily", "x", b""),
    ]
    df = spark.createDataFrame(
        rows, "agent_id string, id string, key string, content string, category string, timestamp string, embedding binary")
    now = F.lit("2026-02-01 00:00:00").cast("timestamp")
    got = memories.zeroclaw_table_records(df, now, F.lit("openai")).collect()
    by = {json.loads(r.raw_source_format)["category"] + str(len(r.embeddings)): r for r in got}
    core = by["Core1"]
    assert core.id == good.lower() and core.namespace == "core" and core.tags == ["Core", "zeroclaw"]
    assert core.temporal.created_at == dt.datetime(2026, 1, 10)
    assert core.embeddings[0].model == "openai/text-embedding-3-small"
    assert core.embeddings[0].dimensions == 64 and core.embeddings[0].vector == [0.5] * 64
    conv = by["conversation0"]
    assert conv.tags == ["conversation", "zeroclaw", "auto_save"]
    assert conv.temporal.created_at == dt.datetime(2026, 2, 1)
    assert uuid.UUID(conv.id).version == 5
    big = by["custom:x1"]
    assert big.embeddings[0].model == "unknown/openai" and big.embeddings[0].dimensions == 2049
    assert (big.memory_type, big.namespace) == ("semantic", "custom:x")
    assert by["Work0"].namespace == "custom:work"
    assert by["daily1"].embeddings[0].dimensions == 1536
    assert by["daily0"].embeddings == []
    none = memories.zeroclaw_table_records(df, now, F.lit("none")).collect()
    assert [len(r.embeddings) for r in none] == [0, 0, 1, 0, 0, 0]
    other = memories.zeroclaw_table_records(df, now, F.lit("cohere")).collect()
    assert other[0].embeddings[0].model == "cohere"


CONFIG = '''# settings
version = "0.3.1"
api_key = "root-secret" # keep
max_tokens = 5

[memory]
backend = "SQLite"
auto_save = false
embedding_provider = "openai"
vector_weight = 0.6

[identity]
format = "aieos"
aieos_path = "persona.json"

[channels_config.telegram]
bot_token = "123:abc"
user_password = 'p'
'''


def test_settings(spark):
    df = files_df(spark, [("a", "config.toml", CONFIG), ("b", "config.toml", ""), ("b", "x.toml", CONFIG)])
    got = {r.agent_id: r for r in workspace_settings.config_fields(df).collect()}
    a, b = got["a"], got["b"]
    assert (a.backend, a.auto_save, a.embedding_provider, a.vector_weight, a.keyword_weight) == (
        "sqlite", False, "openai", 0.6, 0.3)
    assert (a.identity_format, a.aieos_path, a.secrets_encrypt, a.runtime_version) == (
        "aieos", "persona.json", True, "0.3.1")
    assert (b.backend, b.auto_save, b.embedding_provider, b.identity_format) == (
        "sqlite", True, "none", "openclaw")
    hints = workspace_settings.credential_hints(df)
    assert sorted(tuple(r)[1:] for r in hints.collect()) == [
        ("channels_config.telegram", "bot_token", "channel:telegram", "oauth_token"),
        ("channels_config.telegram", "user_password", "channel:telegram", "secret"),
        ("root", "api_key", "api_key", "api_key"),
    ]
    creds = workspace_settings.credential_rows(hints, F.lit("2026-01-01").cast("timestamp")).collect()
    assert {c.encrypted_payload for c in creds} == {"<not-exported>"}
    assert "root-secret" not in str(creds)


def test_redaction(spark):
    (got,) = col(spark, settings.redact, [CONFIG])
    for secret in ("root-secret", "123:abc", "'p'"):
        assert secret not in got
    assert 'api_key = "<redacted>"\n' in got and 'max_tokens = "<redacted>"\n' in got
    assert '[memory]\nbackend = "SQLite"\n' in got and got.endswith("\n")
    assert col(spark, settings.redact, ["", "a", '"my_token"=1=2\r\nb\n\n', "  secret x = 1"]) == [
        "", "a\n", '"my_token"= "<redacted>"\nb\n\n', '  secret x = "<redacted>"\n']


def test_timezones(spark):
    t = ["# U\n## Timezone\n\n- Europe/x\nAmerica/New_York\n", "## time zone\nin Asia/Tokyo now\n",
         "## TIMEZONE \nA/B\n## Other\nC/D", "Timezone: UTC/x", "## Timezone\nnone\n## N\nA/B"]
    assert col(spark, lambda c: notes.timezone(c, "openclaw"), t) == [
        "America/New_York", None, "A/B", None, None]
    assert col(spark, lambda c: notes.timezone(c, "zeroclaw"), t) == [
        "Europe/x", "Asia/Tokyo", "A/B", None, None]


def test_h1(spark):
    assert col(spark, text.h1, ["x\n  # # Name \n# B", "## no\n#no", "# \n"]) == ["Name", None, None]


def test_identity_and_names(spark):
    doc = {"identity": {
        "names": {"first": "Nova", "full": "Nova K", "nickname": 3},
        "psychology": {"neural_matrix": {"a": 0.5, "b": "x", "c": 2}, "traits": {"mbti": "INTJ"},
                       "moral_compass": {"alignment": "good"}},
        "linguistics": {"text_style": {"formality_level": 0.2, "slang_usage": True}},
        "motivations": {"core_drive": "learn"}, "history": {"b": 1, "a": 2}}}
    conf = '[identity]\nformat="aieos"\naieos_path="p.json"\n'
    df = files_df(spark, [
        ("j", "config.toml", conf), ("j", "p.json", json.dumps(doc)), ("j", "SOUL.md", "# Soul\n"),
        ("k", "config.toml", conf), ("k", "IDENTITY.md", "# Kay\n"), ("k", "SOUL.md", " \n"),
        ("l", "AGENTS.md", "rules"), ("m", "USER.md", "# Mia\n## Timezone\nA/B\n"),
    ])
    cfg = workspace_settings.config_fields(df)
    now = F.lit("2026-01-01").cast("timestamp")
    got = {r.agent_id: r for r in profiles.identities(df, now, cfg).collect()}
    assert sorted(got) == ["j", "k", "l"]
    j = got["j"].structured
    assert (j.names.primary, j.names.full, j.names.nickname) == ("Nova", "Nova K", None)
    assert j.psychology.neural_matrix == {"a": 0.5, "c": 2.0}
    assert (j.psychology.mbti, j.psychology.moral_alignment) == ("INTJ", "good")
    assert (j.linguistics.formality_level, j.linguistics.slang_usage) == (0.2, True)
    assert j.goals == ["learn"] and j.aieos_extensions == '{"history":{"a":2,"b":1}}'
    assert got["j"].source_format == "aieos" and got["j"].prose.soul == "# Soul\n"
    assert got["k"].structured.names.primary == "Kay" and got["k"].prose.soul is None
    assert got["k"].source_format == "openclaw" and got["k"].structured.psychology is None
    assert got["l"].structured.names.primary == "Unknown"
    ws = spark.createDataFrame([(a, f"/w/{a}-dir/") for a in "jklm"], "agent_id string, workspace string")
    names = {r.agent_id: r.name for r in profiles.agent_names(df, ws, cfg).collect()}
    assert names == {"j": "Nova", "k": "Kay", "l": "l-dir", "m": "m-dir"}
    (p,) = profiles.principals(df, now, "openclaw").collect()
    assert p.owner == "m" and p.profile.structured.name == "Mia"
    assert p.profile.structured.timezone == "A/B" and p.profile.principal_id == p.id
    assert p.profile.prose.user_profile.startswith("# Mia")


def test_quarters(spark):
    ts = [dt.datetime(2026, m, 1) for m in range(1, 13)] + [dt.datetime(2025, 12, 31, 23, 59, 59)]
    assert col(spark, quarters.quarter_label, ts, "timestamp") == [
        f"2026-Q{(m - 1) // 3 + 1}" for m in range(1, 13)] + ["2025-Q4"]
    got = col(spark, quarters.partition_range,
              ["memory/2026-Q1.jsonl", "2025-Q4", "memory/2026-Q0.jsonl", "memory/2026-Q5.jsonl",
               "not-a-partition", "memory/bad.jsonl", "memory/2024-Q2.jsonl"])
    assert got[0] == (dt.date(2026, 1, 1), dt.date(2026, 3, 31))
    assert got[1] == (dt.date(2025, 10, 1), dt.date(2025, 12, 31))
    assert got[2:6] == [None] * 4 and got[6] == (dt.date(2024, 4, 1), dt.date(2024, 6, 30))
    df = spark.createDataFrame([(dt.datetime(2026, 2, 1), dt.datetime(2026, 5, 1)), (None, dt.datetime(2026, 5, 1))],
                               "o timestamp, c timestamp")
    assert sorted(r[0] for r in df.select(quarters.partition_path(F.col("o"), F.col("c"))).collect()) == [
        "memory/2026-Q1.jsonl", "memory/2026-Q2.jsonl"]


def test_ids(spark):
    ns = uuid.UUID(bytes=b"zeroclaw-alf-ns1")
    names = ["a:0", "é/ü:12", "", "x" * 300]
    assert col(spark, lambda c: ids.uuid5(ns.hex, c), names) == [str(uuid.uuid5(ns, n)) for n in names]
    u = "6f9619ff-8b86-d011-b42d-00cf4fc964ff"
    raw = [u.upper(), u.replace("-", ""), "{" + u + "}", "urn:uuid:" + u, u[:-1], u + "\n", "x"]
    assert col(spark, ids.normal_uuid, raw) == [u] * 4 + [None] * 3
    want = str(uuid.uuid5(uuid.UUID(bytes=b"alf-agent-id-ns1"), "/w"))
    df = spark.createDataFrame([(f" {u}\n", "/w"), (None, "/w"), ("bad", "/w")], "s string, w string")
    assert [r[0] for r in df.select(ids.agent_id(F.col("s"), F.col("w"), "openclaw")).collect()] == [u, want, want]


def test_checks(spark):
    assert col(spark, is_semver, ["1.0.0", "1.0", "1.0.0-a", "a.b.c", "1..0", "1.0.0\n", "1.0.0.0"]) == [
        True, False, False, False, False, False, False]
    assert col(spark, is_checksum, ["sha256:ab09", "sha256", ":ab", "sha256:", "a:b:c", "x:zz"]) == [
        True, False, False, False, False, False]
    assert col(spark, effective_type, ["summary", "new"]) == ["summary", "semantic"]
    assert col(spark, effective_status, ["deleted", "new"]) == ["deleted", "active"]
    texts = ["2026-01-01T00:00:00Z", "2026-01-01T02:00:00.123456789+02:00", "2026-01-01", "2026-13-01T00:00:00Z", "x"]
    assert col(spark, is_rfc3339, texts) == [True, True, False, False, False]
    assert col(spark, rfc3339, texts)[1] == dt.datetime(2026, 1, 1, 0, 0, 0, 123456)


def test_json_round_trip(spark):
    rec = {
        "id": str(uuid.uuid4()), "agent_id": str(uuid.uuid4()), "content": "é \"q\"\n", "memory_type": "dream",
        "source": {"runtime": "r", "identity_version": 2, "extra_key": [1, {"b": 2}]},
        "temporal": {"created_at": "2026-01-01T00:00:00.000000Z", "access_count": 4, "tz": "x"},
        "status": "frozen", "namespace": "n", "confidence": 0.5, "tags": ["b", "a"],
        "entities": [{"name": "x", "type": "person", "role": "r", "k": None}],
        "embeddings": [{"model": "m", "dimensions": 2, "vector": [0.5, 1.25],
                        "computed_at": "2026-01-01T00:00:00.000000Z", "source": "alien", "q": 1}],
        "related_records": [{"id": "z", "relation": "caused"}],
        "raw_source_format": {"line": 1, "h": None}, "future": {"z": [True, None], "a": 1.5},
    }
    minimal = {k: rec[k] for k in ("id", "agent_id", "content", "memory_type", "source", "temporal", "status", "namespace")}
    lines = [json.dumps(rec), json.dumps(minimal)]

    def again(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string")
        out = parse_records(df, "line", ["i"]).orderBy("i").select(record_json().alias("o"))
        return [r.o for r in out.collect()]

    out = again(lines)
    assert [json.loads(o) for o in out] == [rec, minimal]
    assert again(out) == out


def test_bad_lines_are_left_out(spark):
    df = spark.createDataFrame([(t,) for t in ("", "[]", "5", "{", "null", '{"id":"x","embeddings":5}')], "line string")
    (r,) = parse_records(df, "line").collect()
    assert r.id == "x" and r.content is None and r.tags == [] and r.embeddings == [] and r.source is None
