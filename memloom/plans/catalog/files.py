"""R1-R8, W1-W3, S11, S12."""

from pyspark.sql import functions as F

from memloom.operators import migrate, report
from memloom.operators import workspace_settings as S
from memloom.plans import views as v
from memloom.plans.catalog import query, sql_uuid5
from memloom.sources import workspaces as ws

_ENTRY = "CASE c_custkey % 4 WHEN 0 THEN 'raw/openclaw/' || c_name || '.md' WHEN 1 THEN 'raw/zeroclaw/config.toml' WHEN 2 THEN 'raw/zeroclaw/memory/' || c_name ELSE 'raw/openclaw/' END"


@query(f"""SELECT 'openclaw' AS runtime, 'z' || c_nationkey AS archive, substr({_ENTRY}, 14) AS path FROM customer WHERE {_ENTRY} LIKE 'raw/openclaw/_%'
UNION ALL SELECT 'zeroclaw', 'z' || c_nationkey, CASE WHEN c_custkey % 4 = 1 THEN '../config.toml' ELSE substr({_ENTRY}, 14) END
FROM customer WHERE {_ENTRY} LIKE 'raw/zeroclaw/_%'""")
def raw_restore(spark, sf_dir):
    """Files of archives that carry the runtime's own files."""
    k = F.col("c_custkey") % 4
    entry = (F.when(k == 0, F.concat(F.lit("raw/openclaw/"), "c_name", F.lit(".md"))).when(k == 1, "raw/zeroclaw/config.toml")
             .when(k == 2, F.concat(F.lit("raw/zeroclaw/memory/"), "c_name")).otherwise("raw/openclaw/"))
    entries = v.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("z"), F.col("c_nationkey").cast("string")).alias("archive"), entry.alias("entry"))
    one = lambda r: migrate.restore_files(entries, r).select(F.lit(r).alias("runtime"), "archive", "path")
    return one("openclaw").unionByName(one("zeroclaw"))


_SPACES = """r AS (SELECT CAST(o_custkey AS VARCHAR) AS agent_id, o_orderkey AS pos, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS content,
  CASE o_orderkey % 7 WHEN 0 THEN 'curated' WHEN 1 THEN 'daily' WHEN 2 THEN 'core' WHEN 3 THEN 'conversation' WHEN 4 THEN 'session' ELSE 'workspace' END AS ns,
  CASE WHEN o_orderkey % 5 = 0 THEN 'memory/shared.md' WHEN o_orderkey % 5 = 1 THEN '' END AS origin,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS observed, o_orderdate + INTERVAL 40 DAY AS created FROM orders)"""
_DAYFILE = "'memory/' || strftime({}, '%Y-%m-%d') || '.md'"
_O = "nullif(origin, '')"
_PATHS = {
    "openclaw": f"CASE ns WHEN 'curated' THEN 'MEMORY.md' WHEN 'daily' THEN coalesce({_O}, {_DAYFILE.format('coalesce(observed, created)')}) ELSE coalesce({_O}, 'memory/' || ns || '.md') END",
    "zeroclaw": f"""CASE ns WHEN 'core' THEN 'memory/core.md' WHEN 'daily' THEN coalesce({_O}, {_DAYFILE.format('coalesce(observed, created)')})
 WHEN 'conversation' THEN {_DAYFILE.format('created')} WHEN 'session' THEN coalesce({_O}, 'memory/session_' || substr('o' || pos, 1, 8) || '.md') ELSE coalesce({_O}, 'memory/' || ns || '.md') END""",
}
_GROUPS = {
    "openclaw": "CASE ns WHEN 'curated' THEN 0 WHEN 'daily' THEN 1 ELSE 2 END",
    "zeroclaw": "CASE WHEN ns = 'core' THEN 0 WHEN ns IN ('daily', 'conversation') THEN 1 ELSE 2 END",
}


def _records(spark, sf_dir):
    k = F.col("ord.pos") % 7
    space = (F.when(k == 0, "curated").when(k == 1, "daily").when(k == 2, "core").when(k == 3, "conversation")
             .when(k == 4, "session").otherwise("workspace"))
    five = F.col("ord.pos") % 5
    origin = F.when(five == 0, "memory/shared.md").when(five == 1, "")
    return v.order_records(spark, sf_dir).withColumn("namespace", space).withColumn(
        "source", F.col("source").withField("origin_file", origin))


def _target_sql(runtime):
    return f"WITH {_SPACES} SELECT agent_id, pos, {_PATHS[runtime]} AS path FROM r"


@query(_target_sql("openclaw"))
def target_paths_openclaw(spark, sf_dir):
    """File of each record in one runtime (R2)."""
    return _records(spark, sf_dir).select(
        "agent_id", F.col("ord.pos").alias("pos"), migrate.target_path("openclaw").alias("path"))


@query(_target_sql("zeroclaw"))
def target_paths_zeroclaw(spark, sf_dir):
    """File of each record in the other runtime."""
    return _records(spark, sf_dir).select(
        "agent_id", F.col("ord.pos").alias("pos"), migrate.target_path("zeroclaw").alias("path"))


def _assembled_sql(runtime, extra, group):
    return f"""WITH {_SPACES}, p AS (SELECT *, {_PATHS[runtime]} AS path, {_GROUPS[runtime]} AS grp FROM r),
w AS (SELECT agent_id, path, max(grp) AS grp FROM p GROUP BY 1, 2)
SELECT agent_id, path, {extra} count(*) AS n_records, md5(string_agg(content, chr(10) || chr(10) ORDER BY pos)) AS content_md5
FROM p JOIN w USING (agent_id, path, grp) GROUP BY {group}"""


@query(_assembled_sql("openclaw", "", "agent_id, path"))
def files_openclaw(spark, sf_dir):
    """Whole files rebuilt from records."""
    whole = migrate.rebuilt_files(_records(spark, sf_dir), "openclaw")
    return whole.select("agent_id", "path", "n_records", F.md5("content").alias("content_md5"))


@query(_assembled_sql("zeroclaw", "pos // 4096 AS slice,", "agent_id, path, pos // 4096"))
def file_parts_zeroclaw(spark, sf_dir):
    """Files rebuilt from records, in parts of bounded size."""
    parts = migrate.file_parts(_records(spark, sf_dir), "zeroclaw")
    return parts.select("agent_id", "path", F.col("part.slice").alias("slice"), "n_records", F.md5("content").alias("content_md5"))


@query(f"""WITH {_SPACES}, p AS (SELECT *, {_PATHS['openclaw']} AS path, {_GROUPS['openclaw']} AS grp FROM r),
w AS (SELECT agent_id, path, max(grp) AS grp FROM p GROUP BY 1, 2)
SELECT 'a' || agent_id AS agent_id, path, true AS whole, md5(string_agg(content, chr(10) || chr(10) ORDER BY pos)) AS content_md5
FROM p JOIN w USING (agent_id, path, grp) GROUP BY agent_id, path
UNION ALL SELECT DISTINCT 'a' || agent_id, '.alf-agent-id', true, md5('a' || agent_id) FROM r""")
def imported_files(spark, sf_dir):
    """Files of a snapshot without raw ones, rebuilt for a runtime."""
    from memloom.plans.export import import_files
    from memloom.sources.sinks import Snapshot

    records = _records(spark, sf_dir).withColumn("agent_id", F.concat(F.lit("a"), "agent_id"))
    manifests = records.select("agent_id").distinct()
    files = import_files(Snapshot(records, manifests), "openclaw")
    return files.select("agent_id", "path", F.col("part").isNull().alias("whole"), F.md5("data").alias("content_md5"))


@query(_assembled_sql("zeroclaw", "", "agent_id, path"))
def adapter_files(spark, sf_dir):
    """Files through the adapter registered for a runtime."""
    from memloom.plans import export  # noqa: F401 - registers the runtimes
    from memloom.plans.registry import adapter

    files = adapter("zeroclaw").to_files(_records(spark, sf_dir))
    return files.select("agent_id", "path", "n_records", F.md5("content").alias("content_md5"))


_TEXT = """CASE WHEN c_custkey % 3 = 0 THEN 'soul ' || c_custkey WHEN c_custkey % 3 = 1 THEN '# ' || c_name || chr(10) || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'Cook' ELSE 'AI Assistant' END || chr(10) END"""


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS agent_id, 'SOUL.md' AS path, {_TEXT} AS content FROM customer WHERE c_custkey % 3 < 2
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'identity.json', '{{' || chr(10) || '  "a": 1' || chr(10) || '}}' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'USER.md', '# ' || CASE WHEN c_custkey % 4 = 0 THEN 'User' ELSE c_name END || chr(10) ||
  CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '## Timezone' || chr(10) || chr(10) || 'A/B' || chr(10) ELSE '' END FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'USER.md', 'profile' FROM customer WHERE c_custkey % 7 = 0""")
def profile_files(spark, sf_dir):
    """Persona and profile files."""
    k, t = F.col("c_custkey"), F.col("c_custkey").cast("string")
    none = F.lit(None).cast("string")
    c = v.table(spark, sf_dir, "customer")
    identities = c.select(
        t.alias("agent_id"),
        F.when(k % 3 == 0, F.struct(F.concat(F.lit("soul "), t).alias("soul"), none.alias("identity_profile"),
                                    none.alias("operating_instructions"))).alias("prose"),
        F.when(k % 3 == 1, F.struct(F.struct(F.col("c_name").alias("primary")).alias("names"),
                                    F.when(k % 2 == 0, "Cook").alias("role"))).alias("structured"),
        F.when(k % 5 == 0, "aieos").otherwise("x").alias("source_format"), F.lit('{"a":1}').alias("raw_source"))
    principals = c.select(t.alias("owner"), F.struct(
        F.when(k % 7 == 0, F.struct(F.lit("profile").alias("user_profile"))).alias("prose"),
        F.struct(F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.when(k % 2 == 0, "A/B").alias("timezone")).alias("structured"),
    ).alias("profile"))
    return migrate.profile_files(identities, principals, "zeroclaw")


_COUNTS = "WITH m AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)"


def _manifests(spark, sf_dir):
    from memloom.operators import snapshot as snap

    c = v.table(spark, sf_dir, "customer")
    k, t = F.col("c_custkey"), F.col("c_custkey").cast("string")
    agents = c.select(t.alias("agent_id"), F.struct(t.alias("id"), F.col("c_name").alias("name"), F.lit("r").alias("source_runtime"),
                                                    F.lit(None).cast("string").alias("source_runtime_version")).alias("agent"))
    layers = snap.layer_inventory(
        agents, c.where(k % 2 == 0).select(t.alias("agent_id"), F.lit(1).alias("version")), None,
        c.where(k % 3 == 0).select(t.alias("agent_id")), snap.memory_inventory(v.order_records(spark, sf_dir), v.ts(v.AS_OF)))
    return snap.build_manifest(agents, layers, v.ts(v.AS_OF))


@query(_COUNTS + """ SELECT CAST(c_custkey AS VARCHAR) AS agent_id, c_name AS agent_name, coalesce(n, 0) AS memory_records, c_custkey % 2 = 0 AS identity_imported,
  0 AS principals_count, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS credentials_count,
  CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 + CASE WHEN n > 0 THEN 1 ELSE 0 END END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS n_warnings
FROM customer LEFT JOIN m ON k = c_custkey""")
def import_report(spark, sf_dir):
    """What an import brings back."""
    raw = v.table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("agent_id"))
    r = migrate.import_report(_manifests(spark, sf_dir), raw, "openclaw")
    return r.select("agent_id", "agent_name", "memory_records", "identity_imported", F.col("principals_count").cast("int").alias("principals_count"),
                    F.col("credentials_count").cast("int").alias("credentials_count"), F.size("warnings").alias("n_warnings"))


@query(f"SELECT {sql_uuid5(b'alf-agent-id-ns1', 'c_name')} AS agent_id, '.alf-agent-id' AS path, {sql_uuid5(b'alf-agent-id-ns1', 'c_name')} AS content FROM customer")
def agent_id_files(spark, sf_dir):
    """The agent-id file of each workspace."""
    from memloom.functions.ids import agent_id

    named = v.table(spark, sf_dir, "customer").select(agent_id(F.lit(None).cast("string"), F.col("c_name"), "openclaw").alias("agent_id"))
    return migrate.agent_id_files(named)


@query("""SELECT '/fleet/w' || k AS workspace, k % 2 = 0 AS soul_md, k % 3 = 0 AS identity_md, k % 7 = 0 AS agents_md, k % 4 <> 0 AS user_md, k % 5 = 0 AS memory_md,
  k % 10 = 2 AS active_context, k % 3 = 1 OR k % 6 = 1 OR k % 9 = 1 OR k % 10 = 2 AS memory_dir, (k % 3 = 1)::INT + (k % 6 = 1)::INT AS daily_logs,
  CASE WHEN k % 6 = 1 THEN '2026-02-xx.md' WHEN k % 3 = 1 THEN '2026-01-15.md' ELSE '' END AS latest_daily, (k % 9 = 1)::INT AS project_files,
  CASE WHEN k % 11 = 0 THEN 'id' || k ELSE '' END AS agent_id FROM (SELECT c_custkey AS k FROM customer)""")
def workspace_inventory(spark, sf_dir):
    """What each workspace holds."""
    inv = report.workspace_inventory(v.customer_files(spark, sf_dir))
    return inv.withColumn("latest_daily", F.coalesce("latest_daily", F.lit(""))).withColumn(
        "agent_id", F.coalesce("agent_id", F.lit(""))).withColumn("daily_logs", F.col("daily_logs").cast("int")).withColumn(
        "project_files", F.col("project_files").cast("int"))


@query("""WITH i AS (SELECT '/fleet/w' || c_custkey AS workspace, c_custkey AS k FROM customer),
r AS (SELECT workspace, 'workspace_empty' AS code FROM i WHERE NOT (k % 2 = 0 OR k % 3 = 0 OR k % 7 = 0 OR k % 4 <> 0 OR k % 5 = 0)
UNION ALL SELECT workspace, 'no_soul_md' FROM i WHERE k % 2 <> 0
UNION ALL SELECT workspace, 'no_memory_content' FROM i WHERE NOT (k % 5 = 0 OR k % 3 = 1)
UNION ALL SELECT workspace, 'memory_dir_empty' FROM i WHERE (k % 9 = 1 OR k % 10 = 2) AND k % 3 <> 1)
SELECT workspace, 'warning' AS severity, code FROM r""")
def workspace_issues(spark, sf_dir):
    """Warnings about workspaces."""
    return report.workspace_issues(report.workspace_inventory(v.customer_files(spark, sf_dir))).drop("message")


_RAW = """x AS (SELECT c_custkey AS k, unnest(['SOUL.md', 'IDENTITY.md', 'AGENTS.md', 'USER.md', 'MEMORY.md', 'TOOLS.md', 'memory/2026-01-15.md',
  'memory/2026-02-xx.md', 'memory/project-a.md', 'memory/active-context.md', 'config.toml', 'identity.json']) AS path,
  unnest([c_custkey % 2 = 0, c_custkey % 3 = 0, c_custkey % 7 = 0, c_custkey % 4 <> 0, {memory}, c_custkey % 8 = 0, c_custkey % 3 = 1,
  c_custkey % 6 = 1, c_custkey % 9 = 1, c_custkey % 10 = 2, {config}, {persona}]) AS present FROM customer),
raw AS (SELECT CAST(k AS VARCHAR) AS agent_id, path FROM x WHERE present)"""
_RAW_Z = _RAW.format(memory="false", config="c_custkey % 5 <> 0", persona="c_custkey % 5 <> 0 AND c_custkey % 6 = 0")
_RAW_O = _RAW.format(memory="c_custkey % 5 = 0", config="false", persona="false")


@query(f"""WITH {_RAW_Z} SELECT agent_id, path, false AS leaks FROM raw""")
def raw_sources(spark, sf_dir):
    """Files kept verbatim, settings redacted."""
    files = v.customer_files(spark, sf_dir)
    kept = ws.raw_sources(files, "zeroclaw", S.config_fields(files))
    text = F.col("data").cast("string")
    return kept.select("agent_id", "path", (text.contains('"k') | text.contains('"t')).alias("leaks")).withColumn(
        "leaks", F.col("leaks") & (F.col("path") == "config.toml"))


@query(_COUNTS + f""", {_RAW_O}, rc AS (SELECT agent_id, count(*) AS r FROM raw GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS agent_id, c_name AS agent_name, '1.0.0' AS alf_version, coalesce(n, 0) AS memory_records,
  CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS identity_version, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS credentials_count,
  coalesce(r, 0) AS raw_source_count FROM customer LEFT JOIN m ON k = c_custkey LEFT JOIN rc ON rc.agent_id = CAST(c_custkey AS VARCHAR)""")
def export_report(spark, sf_dir):
    """Counts of what each agent exported."""
    raw = ws.raw_sources(v.customer_files(spark, sf_dir), "openclaw")
    r = report.export_report(_manifests(spark, sf_dir), raw)
    return r.select("agent_id", "agent_name", "alf_version", "memory_records",
                    F.coalesce("identity_version", F.lit(0)).cast("int").alias("identity_version"),
                    F.col("credentials_count").cast("int").alias("credentials_count"), "raw_source_count")


@query("""SELECT CAST(k AS VARCHAR) AS agent_id, CASE WHEN k % 5 <> 0 AND k % 4 = 0 THEN CASE WHEN k % 8 = 4 THEN 'table' ELSE 'markdown' END
  WHEN k % 5 <> 0 AND k % 4 = 1 THEN 'markdown' WHEN k % 5 <> 0 THEN 'none' WHEN k % 8 = 4 THEN 'table'
  WHEN k % 3 = 1 OR k % 9 = 1 OR k % 10 = 2 THEN 'markdown' ELSE 'none' END AS backend FROM (SELECT c_custkey AS k FROM customer)""")
def backends(spark, sf_dir):
    """Where each workspace keeps its memories."""
    files = v.customer_files(spark, sf_dir)
    return ws.route_backends(files, S.config_fields(files))
