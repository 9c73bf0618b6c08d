"""X6-X21, X23."""

from pyspark.sql import functions as F

from memloom.operators import snapshot as snap
from memloom.operators import sync
from memloom.plans import views as v
from memloom.plans.catalog import query
from memloom.plans.catalog.deltas import _STATES
from memloom.schemas import MANIFEST_DDL, struct_of, struct_type

_AT = "2024-02-01 00:00:00"


@query("""SELECT CAST(user_id AS VARCHAR) AS agent_id, event_type AS layer, max(event_id) AS seq,
  CAST(max(event_id) AS VARCHAR) AS doc FROM events WHERE value >= 20 GROUP BY 1, 2""")
def layer_last_wins(spark, sf_dir):
    """Each layer is the last one given."""
    layers = v.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("agent_id"), F.col("event_type").alias("layer"),
        F.col("event_id").alias("seq"),
        F.when(F.col("value") >= 20, F.col("event_id").cast("string")).alias("doc"))
    return snap.latest_layers(layers)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS agent_id, 'o' || o_orderkey AS id, 'memory/' || year(t) || '-Q' || quarter(t) || '.jsonl' AS file FROM
  (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 40 DAY END AS t FROM orders)""")
def records_by_quarter(spark, sf_dir):
    """Records brought together by agent and quarter, hot quarters split."""
    placed = snap.repartition_records(v.order_records(spark, sf_dir))
    return placed.select("agent_id", "id", F.col("partition").alias("file"))


_CUSTOMER_STATE = """state AS (SELECT CAST(c_custkey AS VARCHAR) AS agent_id, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 9 END AS seq,
  c_custkey % 5 <> 0 AS synced FROM customer WHERE c_custkey % 6 <> 0)"""


def _state(spark, sf_dir):
    k = F.col("c_custkey")
    return v.table(spark, sf_dir, "customer").where(k % 6 != 0).select(
        k.cast("string").alias("agent_id"),
        F.when(k % 4 == 0, 0).otherwise(k % 9).cast("bigint").alias("last_synced_sequence"),
        F.when(k % 5 != 0, v.ts(_AT)).alias("last_synced_at"),
        F.concat(F.lit("s"), k.cast("string")).alias("snapshot_path"))


@query("""SELECT agent_id, max(s) AS last_sequence FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS agent_id, c_custkey % 9 AS s FROM customer
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), greatest(o_orderkey % 20 + 1, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 31 ELSE 0 END)
  FROM orders) GROUP BY 1""")
def highest_sequence(spark, sf_dir):
    """Highest sequence of snapshot and deltas."""
    n = F.col("o_orderkey")
    base = v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("agent_id"), (F.col("c_custkey") % 9).alias("last_sequence"))
    deltas = v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("agent_id"), (n % 20).alias("base_sequence"),
        F.when(n % 3 == 0, n % 31).otherwise(0).alias("new_sequence"))
    return snap.highest_sequence(base, deltas)


@query("""
WITH q AS (SELECT user_id, count(*) AS n, bool_or(value > 100) AS e FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS agent_id, n AS record_count, 1 AS n_partitions, 'memory/2024-Q1.jsonl' AS first_file,
  e AS has_embeddings, user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS has_raw_source FROM q""")
def memory_inventory(spark, sf_dir):
    """Memory section of the manifest."""
    raw = v.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").cast("string").alias("agent_id"))
    m = F.col("memory")
    return snap.memory_inventory(v.event_records(spark, sf_dir), v.ts(_AT), raw_agents=raw).select(
        "agent_id", m["record_count"].alias("record_count"), F.size(m["partitions"]).alias("n_partitions"),
        m["partitions"][0]["file"].alias("first_file"), m["has_embeddings"].alias("has_embeddings"),
        m["has_raw_source"].alias("has_raw_source"))


def _attachments(spark, sf_dir):
    n = F.col("n_chars")
    return v.table(spark, sf_dir, "documents").select(
        F.col("source").alias("agent_id"), n.alias("size_bytes"),
        F.when(n < 2000, F.concat(F.lit("artifacts/"), F.col("doc_id").cast("string"))).alias("archive_path"))


@query("""SELECT source AS agent_id, count(*) AS count, count(*) FILTER (n_chars < 2000) AS included_count,
  CAST(coalesce(sum(n_chars) FILTER (n_chars < 2000), 0) AS BIGINT) AS included_size_bytes,
  count(*) FILTER (n_chars >= 2000) AS referenced_count,
  CAST(coalesce(sum(n_chars) FILTER (n_chars >= 2000), 0) AS BIGINT) AS referenced_size_bytes FROM documents GROUP BY 1""")
def attachment_rollup(spark, sf_dir):
    """Included and referenced attachments."""
    return snap.attachment_rollup(_attachments(spark, sf_dir))


_LAYERS = """
WITH a AS (SELECT c_custkey AS k FROM customer),
m AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT date_trunc('quarter', CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate
  ELSE o_orderdate + INTERVAL 40 DAY END)) AS q FROM orders GROUP BY 1)
"""


def _layer_tables(spark, sf_dir):
    c = v.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    t = k.cast("string")
    identities = c.where(k % 2 == 0).select(t.alias("agent_id"), (k % 3 + 1).alias("version"))
    principals = c.where(k % 3 == 0).select(t.alias("owner"), F.explode(F.sequence(F.lit(0), k % 4)).alias("pos"))
    credentials = c.where(k % 5 == 0).select(t.alias("agent_id"))
    agent_t = struct_type(MANIFEST_DDL)["agent"].dataType.simpleString()
    agents = c.select(
        t.alias("agent_id"), F.lit("2.0.0").alias("alf_version"),
        struct_of(agent_t, id=t, name=F.col("c_name"), source_runtime=F.lit("openclaw")).alias("agent"),
        F.array(F.lit("openclaw")).alias("raw_sources"))
    return agents, identities, principals, credentials


def _layers(spark, sf_dir):
    agents, identities, principals, credentials = _layer_tables(spark, sf_dir)
    memory = snap.memory_inventory(v.order_records(spark, sf_dir), v.ts(v.AS_OF))
    return agents, snap.layer_inventory(agents, identities, principals, credentials, memory)


@query(_LAYERS + """SELECT CAST(a.k AS VARCHAR) AS agent_id, CASE WHEN a.k % 2 = 0 THEN a.k % 3 + 1 ELSE -1 END AS identity_version,
  CASE WHEN a.k % 3 = 0 THEN a.k % 4 + 1 ELSE -1 END AS principals, CASE WHEN a.k % 5 = 0 THEN 1 ELSE -1 END AS credentials,
  coalesce(m.n, -1) AS records, coalesce(m.q, -1) AS partitions FROM a LEFT JOIN m USING (k)""")
def layer_inventory(spark, sf_dir):
    """What each agent's snapshot holds (X11)."""
    _, layers = _layers(spark, sf_dir)
    n = lambda c: F.coalesce(c, F.lit(-1)).cast("bigint")
    x = F.col("layers")
    return layers.select(
        "agent_id", n(x["identity"]["version"]).alias("identity_version"), n(x["principals"]["count"]).alias("principals"),
        n(x["credentials"]["count"]).alias("credentials"), n(x["memory"]["record_count"]).alias("records"),
        n(F.size(x["memory"]["partitions"])).alias("partitions"))


@query(_LAYERS + """SELECT CAST(a.k AS VARCHAR) AS agent_id, '2.0.0' AS alf_version, '2000-01-01T00:00:00.000000Z' AS created_at,
  c_name AS name, 'openclaw' AS raw_sources, true AS no_checksum, coalesce(m.n, 0) AS records, coalesce(s.s, 0) AS last_sequence
FROM a JOIN customer ON c_custkey = k LEFT JOIN m USING (k)
LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey % 20 + 1) AS s FROM orders GROUP BY 1) s USING (k)""")
def manifest_build(spark, sf_dir):
    """A manifest per agent."""
    agents, layers = _layers(spark, sf_dir)
    none = agents.select("agent_id", F.lit(0).alias("last_sequence"))
    deltas = v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("agent_id"), (F.col("o_orderkey") % 20).alias("base_sequence"),
        F.lit(0).alias("new_sequence"))
    m = snap.build_manifest(agents, layers, v.ts(v.AS_OF), snap.highest_sequence(none, deltas))
    return m.select(
        "agent_id", "alf_version", "created_at", F.col("agent.name").alias("name"),
        F.array_join("raw_sources", ",").alias("raw_sources"), F.col("checksum").isNull().alias("no_checksum"),
        F.coalesce(F.col("layers.memory.record_count"), F.lit(0)).alias("records"),
        F.col("sync.last_sequence").alias("last_sequence"))


_ENTRY = """CASE page_id % 4 WHEN 0 THEN 'raw/' || regexp_replace(url, '^https?://', '') WHEN 1 THEN 'raw/' || page_id
  WHEN 2 THEN 'artifacts/' || page_id ELSE 'memory/' || page_id END"""


@query(f"""SELECT page_id, {_ENTRY} AS entry, length(html) AS size FROM pages
WHERE ({_ENTRY} LIKE 'artifacts/%' OR regexp_matches({_ENTRY}, '^raw/[^/]*/')) AND NOT {_ENTRY} LIKE '%/'""")
def carried_files(spark, sf_dir):
    """Raw and artifact files a rebuilt snapshot keeps."""
    k = F.col("page_id")
    bare = F.regexp_replace("url", "^https?://", "")
    entry = F.when(k % 4 == 0, F.concat(F.lit("raw/"), bare)).when(
        k % 4 == 1, F.concat(F.lit("raw/"), k.cast("string"))).when(
        k % 4 == 2, F.concat(F.lit("artifacts/"), k.cast("string"))).otherwise(F.concat(F.lit("memory/"), k.cast("string")))
    pages = v.table(spark, sf_dir, "pages").select("page_id", entry.alias("entry"), F.length("html").cast("bigint").alias("size"))
    return snap.carry_files(pages)


@query(_STATES + f""", {_CUSTOMER_STATE}
SELECT agent_id, count(*) AS record_count, coalesce(max(seq), 0) AS base_sequence, 0 AS new_sequence,
  'memory/delta.jsonl' AS file, coalesce(bool_or(synced), false) AS has_base_time FROM d LEFT JOIN state USING (agent_id) GROUP BY agent_id""")
def delta_manifest(spark, sf_dir):
    """Manifest of the delta each agent is about to push."""
    from memloom.operators.delta import compute_delta

    found = compute_delta(*v.old_and_new(spark, sf_dir))
    m = snap.delta_manifest(found, _state(spark, sf_dir), v.ts(_AT), F.lit("openclaw"))
    return m.select(
        "agent_id", F.col("changes.memory.record_count").alias("record_count"),
        F.col("sync.base_sequence").alias("base_sequence"), F.col("sync.new_sequence").cast("int").alias("new_sequence"),
        F.col("changes.memory.file").alias("file"), F.col("sync.base_timestamp").isNotNull().alias("has_base_time"))


@query(_STATES + f""", {_CUSTOMER_STATE},
n AS (SELECT agent_id, count(*) AS n FROM d GROUP BY 1), a AS (SELECT CAST(c_custkey AS VARCHAR) AS agent_id FROM customer)
SELECT agent_id, CASE WHEN NOT coalesce(synced, false) THEN 'snapshot' WHEN n > 0 THEN 'delta' ELSE 'no_changes' END AS action,
  coalesce(seq, 0) AS base_sequence, CASE WHEN synced AND n > 0 THEN n ELSE 0 END AS changes
FROM a LEFT JOIN state USING (agent_id) LEFT JOIN n USING (agent_id)""")
def sync_plan(spark, sf_dir):
    """What each agent has to push."""
    from memloom.operators.delta import change_counts, compute_delta

    agents = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("agent_id"))
    counts = change_counts(compute_delta(*v.old_and_new(spark, sf_dir)))
    return sync.sync_plan(agents, _state(spark, sf_dir), counts)


@query(f"""WITH {_CUSTOMER_STATE}, r AS (SELECT CAST(o_custkey AS VARCHAR) AS agent_id, max(o_orderkey % 20) AS s FROM orders
  WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT agent_id, CAST(coalesce(r.s, state.seq) AS BIGINT) AS last_synced_sequence, r.s IS NOT NULL OR synced AS synced,
  CASE WHEN r.s IS NOT NULL THEN 'new' ELSE 's' || agent_id END AS snapshot_path FROM state FULL JOIN r USING (agent_id)""")
def state_advance(spark, sf_dir):
    """Sync state after a round of pushes."""
    results = v.table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").groupBy(
        F.col("o_custkey").cast("string").alias("agent_id")).agg(F.max(F.col("o_orderkey") % 20).alias("sequence"))
    results = results.withColumn("at", v.ts(v.AS_OF)).withColumn("snapshot_path", F.lit("new"))
    return sync.advance_state(_state(spark, sf_dir), results).select(
        "agent_id", "last_synced_sequence", F.col("last_synced_at").isNotNull().alias("synced"), "snapshot_path")


def _feed(spark, sf_dir):
    """Snapshots and deltas of agents, out of orders."""
    o = v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("agent_id"), F.col("o_orderkey").alias("sequence"),
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"))
    return o.where("sequence % 5 = 0"), o.where("sequence % 5 <> 0")


_FEED = """
f AS (SELECT CAST(o_custkey AS VARCHAR) AS agent_id, o_orderkey AS sequence, 'u' || o_orderkey AS url FROM orders),
a AS (SELECT CAST(c_custkey AS VARCHAR) AS agent_id, c_custkey FROM customer),
snaps AS (SELECT agent_id, max(sequence) AS s FROM f WHERE sequence % 5 = 0 GROUP BY 1),
dl AS (SELECT * FROM f WHERE sequence % 5 <> 0)"""


@query(f"""WITH {_FEED} SELECT agent_id, sequence, url FROM dl JOIN a USING (agent_id) WHERE sequence > c_custkey * 8""")
def deltas_after(spark, sf_dir):
    """Deltas since a sequence per agent."""
    since = v.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("agent_id"), (F.col("c_custkey") * 8).alias("since"))
    return sync.deltas_since(_feed(spark, sf_dir)[1], since).select("agent_id", "sequence", "url")


@query(f"""WITH {_FEED} SELECT agent_id, CASE WHEN s IS NULL THEN 'error' ELSE 'snapshot' END AS kind, coalesce(s, -1) AS sequence,
  coalesce('u' || s, '') AS url FROM a LEFT JOIN snaps USING (agent_id)
UNION ALL SELECT agent_id, 'delta', sequence, url FROM dl JOIN snaps USING (agent_id) JOIN a USING (agent_id) WHERE sequence > s""")
def restore_plan(spark, sf_dir):
    """Latest snapshot and later deltas per agent."""
    agents = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("agent_id"))
    plan = sync.restore_plan(agents, *_feed(spark, sf_dir))
    return plan.select(
        "agent_id", "kind", F.coalesce("sequence", F.lit(-1)).alias("sequence"), F.coalesce("url", F.lit("")).alias("url"))


@query(f"""WITH {_FEED}, l AS (SELECT agent_id, max(sequence) AS s FROM f GROUP BY 1)
SELECT agent_id, base_sequence, coalesce(s, 0) AS latest_sequence FROM
  (SELECT agent_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS base_sequence FROM a) LEFT JOIN l USING (agent_id)
WHERE base_sequence <> coalesce(s, 0)""")
def sequence_conflicts(spark, sf_dir):
    """Pushes whose base is not the latest sequence."""
    k = F.col("c_custkey")
    pushed = v.table(spark, sf_dir, "customer").select(
        k.cast("string").alias("agent_id"), F.when(k % 2 == 0, k).otherwise(0).alias("base_sequence"))
    snaps, deltas = _feed(spark, sf_dir)
    return sync.sequence_conflicts(pushed, snaps.unionByName(deltas))


@query(f"""WITH {_CUSTOMER_STATE}, {_FEED} SELECT agent_id, CAST(seq AS BIGINT) AS last_synced_sequence, synced, snaps.s IS NOT NULL AS snapshot_exists
FROM state LEFT JOIN snaps USING (agent_id)""")
def fleet_status(spark, sf_dir):
    """Sync status of the fleet."""
    return sync.fleet_status(_state(spark, sf_dir), _feed(spark, sf_dir)[0]).select(
        "agent_id", "last_synced_sequence", F.col("last_synced_at").isNotNull().alias("synced"), "snapshot_exists")


@query(_LAYERS.replace("WITH a AS", "WITH cust AS") + """,
b AS (SELECT CAST(o_custkey AS VARCHAR) AS agent_id, o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate
  ELSE o_orderdate + INTERVAL 40 DAY END AS t FROM orders),
s AS (SELECT * FROM b WHERE k % 7 <> 0),
p AS (SELECT agent_id, date_trunc('quarter', t) AS q, count(*) AS n FROM s GROUP BY 1, 2)
SELECT agent_id, 'memory/' || year(q) || '-Q' || quarter(q) || '.jsonl' AS file, n AS record_count,
  q + INTERVAL 3 MONTH <= TIMESTAMP '2000-01-01' AS sealed, 1 AS last_sequence FROM p
WHERE agent_id IN (SELECT CAST(k AS VARCHAR) FROM cust)""")
def snapshot_rebuild(spark, sf_dir):
    """A computed delta folded into its base, with inventory and manifest."""
    from memloom.operators.delta import compute_delta
    from memloom.plans.rebuild import rebuild_snapshot
    from memloom.session import cut_lineage
    from memloom.sources.sinks import Snapshot

    old, new = v.old_and_new(spark, sf_dir)
    # a delta is written before it is applied; the cut stands in for that table
    found = cut_lineage(compute_delta(old, new), eager=True)
    # one id occurs once here, so its key can serve as position
    deltas = found.withColumn("delta_seq", F.lit(1)).withColumn("pos", F.col("ord.pos"))
    agents, identities, principals, credentials = _layer_tables(spark, sf_dir)
    layers = snap.layer_inventory(agents)
    marks = agents.select("agent_id", F.struct(F.lit(0).cast("bigint").alias("base_sequence"),
                                               F.lit(0).cast("bigint").alias("new_sequence")).alias("sync"))
    base = Snapshot(records=old, manifests=snap.build_manifest(agents, layers, v.ts(v.AS_OF)),
                    identities=identities, principals=principals, credentials=credentials)
    out = rebuild_snapshot(base, deltas, marks, v.ts(v.AS_OF))
    return out.manifests.select(
        "agent_id", F.col("sync.last_sequence").cast("int").alias("last_sequence"),
        F.explode("layers.memory.partitions").alias("p"),
    ).select("agent_id", "p.file", "p.record_count", "p.sealed", "last_sequence")


_YEAR = "year(t) = 1995"


@query(f"""WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS agent_id, o_orderkey AS k, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS c,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 40 DAY END AS t FROM orders),
s AS (SELECT agent_id, k, CASE WHEN {_YEAR} AND k % 25 IN (2, 3) THEN c || '+' ELSE c END AS c,
  CASE WHEN {_YEAR} AND k % 25 = 3 THEN t + INTERVAL 400 DAY ELSE t END AS t FROM b
  WHERE NOT ({_YEAR} AND k % 25 = 1) AND (k % 10 <> 0 OR ({_YEAR} AND k % 25 = 5))),
q AS (SELECT *, 'memory/' || year(t) || '-Q' || quarter(t) || '.jsonl' AS file, date_trunc('quarter', t) + INTERVAL 3 MONTH <= TIMESTAMP '1996-03-31' AS sealed FROM s)
SELECT agent_id, 'o' || k AS id, c AS content, file, count(*) OVER (PARTITION BY agent_id, file) AS record_count, sealed,
  count(*) OVER (PARTITION BY agent_id) AS agent_records, 1 AS last_sequence, CAST(agent_id AS BIGINT) % 3 + 1 AS identity_version FROM q""")
def snapshot_update(spark, sf_dir):
    """A delta of one year folded into a written snapshot, whose other quarters stay as they are."""
    import uuid

    from memloom.plans.rebuild import update_snapshot
    from memloom.session import by_key, shared_dir
    from memloom.sources import sinks

    path = f"{shared_dir(spark)}/memloom-run-{uuid.uuid4()}/snapshot"
    recs = v.whole_records(v.order_records(spark, sf_dir))
    n = F.col("ord.pos")
    agents = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("agent_id"))
    identities = agents.withColumn("version", (F.col("agent_id").cast("int") % 3 + 1))
    old = recs.where(n % 10 != 0)
    layers = snap.layer_inventory(agents, identities, memory=snap.memory_inventory(old, v.ts(v.AS_OF), seal="never"))
    agent_t = struct_type(MANIFEST_DDL)["agent"].dataType.simpleString()
    named = agents.withColumn("agent", struct_of(agent_t, id=F.col("agent_id")))
    base = sinks.Snapshot(old, snap.build_manifest(named, layers, v.ts(v.AS_OF)), identities=identities)
    sinks.write_snapshot(base, path, buckets=2)

    k = n % 25
    seen = F.coalesce("temporal.observed_at", "temporal.created_at")
    moved = F.col("temporal").withField("observed_at", seen + F.expr("interval 400 days"))
    step = F.when(k == 1, "delete").when(k.isin(2, 3), "update").when((k == 5) & (n % 10 == 0), "create")
    deltas = recs.where((F.year(seen) == 1995) & step.isNotNull()).select(
        "*", step.alias("operation"), F.lit(1).cast("bigint").alias("delta_seq"), n.alias("pos"))
    deltas = deltas.withColumn("content", F.when(k.isin(2, 3), F.concat("content", F.lit("+"))).otherwise(F.col("content")))
    deltas = deltas.withColumn("temporal", F.when(k == 3, moved).otherwise(F.col("temporal")))
    marks = agents.select("agent_id", F.struct(F.lit(0).cast("bigint").alias("base_sequence"),
                                               F.lit(1).cast("bigint").alias("new_sequence")).alias("sync"))
    new = update_snapshot(spark, path, deltas, marks, v.ts("1996-03-31 00:00:00"), buckets=2)
    m = F.col("layers.memory")
    parts = new.manifests.select(
        "agent_id", F.col("sync.last_sequence").cast("int").alias("last_sequence"), m["record_count"].alias("agent_records"),
        F.col("layers.identity.version").alias("identity_version"), F.explode(m["partitions"]).alias("p"))
    parts = parts.select("*", F.col("p.file").alias("file"))
    return snap.with_partition(new.records).withColumnRenamed("partition", "file").join(by_key(parts), ["agent_id", "file"]).select(
        "agent_id", "id", "content", "file", F.col("p.record_count").alias("record_count"), F.col("p.sealed").alias("sealed"),
        "agent_records", "last_sequence", "identity_version")


@query(f"""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS agent_id, o_orderkey AS k, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS c,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 40 DAY END AS t FROM orders),
p AS (SELECT *, year(t) = 1994 AND k % 40 IN (1, 2, 3) AS gone FROM o),
n AS (SELECT agent_id, count(*) FILTER (NOT gone) AS n FROM p GROUP BY 1)
SELECT 'record' AS kind, agent_id, 'o' || k AS id, c AS detail, n FROM p JOIN n USING (agent_id) WHERE NOT gone
UNION ALL SELECT 'audit', agent_id, 'o' || k, CASE k % 2 WHEN 0 THEN 'even' ELSE 'odd' END || ' ' || year(t) || '-Q' || quarter(t), 1 FROM p WHERE gone
UNION ALL SELECT 'audit', agent_id, 'x' || k, 'unknown ', 0 FROM p WHERE k % 1000 = 1""")
def purge_records(spark, sf_dir):
    """Single records taken out of a written snapshot, what is left and the audit rows."""
    import uuid

    from memloom.plans import purge
    from memloom.session import by_key, shared_dir
    from memloom.sources import sinks

    path = f"{shared_dir(spark)}/memloom-run-{uuid.uuid4()}/snapshot"
    recs = v.whole_records(v.order_records(spark, sf_dir))
    n = F.col("ord.pos")
    agents = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("agent_id"))
    layers = snap.layer_inventory(agents, memory=snap.memory_inventory(recs, v.ts(v.AS_OF)))
    agent_t = struct_type(MANIFEST_DDL)["agent"].dataType.simpleString()
    named = agents.withColumn("agent", struct_of(agent_t, id=F.col("agent_id")))
    sinks.write_snapshot(sinks.Snapshot(recs, snap.build_manifest(named, layers, v.ts(v.AS_OF))), path, buckets=2)
    seen = F.coalesce("temporal.observed_at", "temporal.created_at")
    requests = recs.where((F.year(seen) == 1994) & (n % 40).isin(1, 2, 3)).select(
        "agent_id", "id", F.when(n % 2 == 0, "even").otherwise("odd").alias("reason"))
    unknown = recs.where(n % 1000 == 1).select(
        "agent_id", F.concat(F.lit("x"), n.cast("string")).alias("id"), F.lit("unknown").alias("reason"))
    purge.purge_records(spark, path, requests.union(unknown), v.ts(v.AS_OF), "r1", buckets=2)
    new = sinks.read_snapshot_tables(spark, path)
    counts = new.manifests.select("agent_id", F.col("layers.memory.record_count").cast("bigint").alias("n"))
    left = new.records.join(by_key(counts), "agent_id").select(F.lit("record").alias("kind"), "agent_id", "id", F.col("content").alias("detail"), "n")
    quarter = F.substring_index(F.coalesce("part", F.lit("")), "/", 1)
    return left.union(purge.purge_log(spark, path).select(
        F.lit("audit"), "agent_id", "id", F.concat_ws(" ", "reason", quarter), F.col("copies").cast("bigint")))
