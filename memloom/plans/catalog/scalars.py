"""D1-D13."""

from pyspark.sql import functions as F

from memloom.functions import checks, ids, quarters
from memloom.functions.json_records import parse_records, record_json
from memloom.operators import snapshot as snap
from memloom.operators.ordering import with_order
from memloom.plans import views as v
from memloom.plans.catalog import query, sql_uuid5

NS = b"openclaw-alf-ns1"


@query("""
WITH r AS (SELECT o_custkey AS a, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate
                  ELSE o_orderdate + INTERVAL 40 DAY END AS t FROM orders),
q AS (SELECT CAST(a AS VARCHAR) AS agent_id, date_trunc('quarter', t) AS s, count(*) AS n FROM r GROUP BY 1, 2)
SELECT agent_id, 'memory/' || year(s) || '-Q' || quarter(s) || '.jsonl' AS file,
  strftime(s, '%Y-%m-%d') AS date_from, strftime(s + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS date_to,
  n AS record_count, (s + INTERVAL 3 MONTH - INTERVAL 1 DAY) < TIMESTAMP '2000-01-01' AS sealed FROM q""")
def quarter_inventory(spark, sf_dir):
    """Records per agent and quarter with date range and seal."""
    found = snap.partition_inventory(v.order_records(spark, sf_dir), v.ts(v.AS_OF))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return found.select(
        "agent_id", "file", day("from").alias("date_from"), day("to").alias("date_to"),
        "record_count", "sealed",
    )


@query("""
WITH l AS (SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label, count(*) AS n,
  min(date_trunc('quarter', o_orderdate)) AS s FROM orders GROUP BY 1
  UNION ALL SELECT year(ts) || '-Q' || quarter(ts), count(*), min(date_trunc('quarter', ts)) FROM events GROUP BY 1)
SELECT label, n, strftime(s, '%Y-%m-%d') AS date_from,
  strftime(s + INTERVAL 3 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS date_to FROM l
UNION ALL SELECT 'bad', count(*), NULL, NULL FROM orders""")
def partition_bounds(spark, sf_dir):
    """Quarter labels and their date ranges; a path that is none has no range."""
    orders = v.table(spark, sf_dir, "orders")
    times = orders.select(F.col("o_orderdate").alias("t"), F.lit("o").alias("src")).unionByName(
        v.table(spark, sf_dir, "events").select(F.col("ts").alias("t"), F.lit("e").alias("src")))
    labels = times.groupBy("src", quarters.quarter_label(F.col("t")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    bad = orders.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("src"), F.lit("bad").alias("label"), "n")
    span = quarters.partition_range(F.concat(F.lit("memory/"), "label", F.lit(".jsonl")))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return labels.unionByName(bad).select(
        "label", "n", day(span["from"]).alias("date_from"), day(span["to"]).alias("date_to"))


@query(f"""SELECT o_orderkey, {sql_uuid5(NS, "'memory/' || o_orderpriority || '.md:' || o_orderkey")} AS id FROM orders""")
def record_uuid5(spark, sf_dir):
    """Deterministic record ids."""
    path = F.concat(F.lit("memory/"), "o_orderpriority", F.lit(".md"))
    return v.table(spark, sf_dir, "orders").select(
        "o_orderkey", ids.record_id("openclaw", path, F.col("o_orderkey")).alias("id"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN {sql_uuid5(NS, 'c_name')}
  ELSE {sql_uuid5(b"alf-agent-id-ns1", "'/fleet/' || c_name")} END AS openclaw_id,
  CASE WHEN c_custkey % 3 = 0 THEN {sql_uuid5(NS, 'c_name')}
  ELSE {sql_uuid5(b"alf-zclw-agent-1", "'/fleet/' || c_name")} END AS zeroclaw_id FROM customer""")
def agent_ids(spark, sf_dir):
    """Stored agent ids, else derived from the workspace path."""
    stored = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.upper(ids.uuid5(v.NS, F.col("c_name"))), F.lit("\n"))).when(
        F.col("c_custkey") % 3 == 1, "not an id")
    path = F.concat(F.lit("/fleet/"), "c_name")
    return v.table(spark, sf_dir, "customer").select(
        "c_custkey", ids.agent_id(stored, path, "openclaw").alias("openclaw_id"),
        ids.agent_id(stored, path, "zeroclaw").alias("zeroclaw_id"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN {sql_uuid5(NS, 'p_name')}
  ELSE {sql_uuid5(b"zeroclaw-alf-ns1", "'a:' || p_name")} END AS id FROM part""")
def native_ids(spark, sf_dir):
    """Native ids in any spelling, else derived ids."""
    u = ids.uuid5(v.NS, F.col("p_name"))
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.upper(u)).when(k == 1, F.replace(u, F.lit("-"), F.lit(""))).when(
        k == 2, F.concat(F.lit("{"), u, F.lit("}"))).otherwise(F.col("p_name"))
    return v.table(spark, sf_dir, "part").select(
        "p_partkey", ids.native_id(raw, F.lit("a"), "zeroclaw").alias("id"))


_TYPE = "CASE event_type WHEN 'click' THEN 'episodic' WHEN 'purchase' THEN 'preference' ELSE 'semantic' END"


@query(f"""SELECT {_TYPE} AS memory_type, CASE WHEN value > 300 THEN 'archived' ELSE 'active' END AS status,
  count(*) AS n FROM events GROUP BY 1, 2""")
def effective_enums(spark, sf_dir):
    """Unknown types count as semantic, unknown statuses as active (D3)."""
    recs = v.event_records(spark, sf_dir)
    return recs.groupBy(
        checks.effective_type(F.col("memory_type")).alias("memory_type"),
        checks.effective_status(F.col("status")).alias("status"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) - 7200000000
  WHEN 2 THEN epoch_us(date_trunc('second', ts)) ELSE 946684800000000 END AS micros, event_id % 5 < 3 AS valid FROM events""")
def rfc3339_times(spark, sf_dir):
    """Instants with offsets parse, everything else falls back."""
    k, t = F.col("event_id") % 5, F.col("ts")
    text = (
        F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'"))
        .when(k == 2, F.date_format(t, "yyyy-MM-dd't'HH:mm:ss'z'"))
        .when(k == 3, F.date_format(t, "yyyy-MM-dd"))
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return v.table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(checks.rfc3339(text, v.ts(v.AS_OF))).alias("micros"),
        checks.is_rfc3339(text).alias("valid"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1.' || o_orderkey || '.0' WHEN 1 THEN '1.' || o_orderkey
  WHEN 2 THEN '1.0.x' || o_orderkey ELSE '1.0.0.' || o_orderkey END AS version,
  CASE o_orderkey % 4 WHEN 0 THEN 'sha256:' || md5(o_orderpriority) WHEN 1 THEN md5(o_orderpriority)
  WHEN 2 THEN ':' || md5(o_orderpriority) ELSE 'a:b:' || o_orderkey END AS checksum FROM orders)
SELECT o_orderkey, regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+') AS semver,
  regexp_full_match(checksum, '[^:]+:[0-9a-fA-F]+') AS checksum_ok FROM t""")
def version_and_checksum(spark, sf_dir):
    """Format tests of versions and checksums."""
    n = F.col("o_orderkey")
    k, t, h = n % 4, n.cast("string"), F.md5("o_orderpriority")
    version = F.when(k == 0, F.concat(F.lit("1."), t, F.lit(".0"))).when(k == 1, F.concat(F.lit("1."), t)).when(
        k == 2, F.concat(F.lit("1.0.x"), t)).otherwise(F.concat(F.lit("1.0.0."), t))
    checksum = F.when(k == 0, F.concat(F.lit("sha256:"), h)).when(k == 1, h).when(
        k == 2, F.concat(F.lit(":"), h)).otherwise(F.concat(F.lit("a:b:"), t))
    return v.table(spark, sf_dir, "orders").select(
        "o_orderkey", checks.is_semver(version).alias("semver"), checks.is_checksum(checksum).alias("checksum_ok"))


@query(f"""
WITH r AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 4 = 0 THEN 'memory/' || event_type || '.md' ELSE '' END AS f,
  {sql_uuid5(NS, "'event:' || event_id")} AS id FROM events)
SELECT CAST(user_id AS VARCHAR) AS agent_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, f, id) - 1 AS pos FROM r""")
def record_order(spark, sf_dir):
    """List positions by creation time, dense, without a task per agent."""
    recs = v.event_records(spark, sf_dir).withColumn("event_id", F.col("ord.pos")).drop("ord")
    placed = with_order(recs.select("agent_id", "event_id", "id", "source", "temporal", "raw_source_format"))
    return placed.select("agent_id", "event_id", F.col("ord.pos").alias("pos"))


@query(f"""
SELECT CAST(user_id AS VARCHAR) AS agent_id, {sql_uuid5(NS, "'event:' || event_id")} AS id,
  CASE WHEN event_id % 50 = 0 THEN '' ELSE event_type END AS content,
  round(value / 400, 6) AS confidence, epoch_us(ts) AS created_us,
  CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) ELSE -1 END AS observed_us,
  CASE WHEN value > 100 THEN 1 ELSE 0 END AS n_embeddings, event_type AS tag,
  CAST(json_extract(props, '$.k') AS BIGINT) AS extra_k FROM events""")
def json_round_trip(spark, sf_dir):
    """Records written as JSON lines and parsed back, open fields kept."""
    lines = v.event_records(spark, sf_dir).select(record_json().alias("line"))
    at = lambda c: F.unix_micros(F.col(f"temporal.{c}"))
    return parse_records(lines, "line").select(
        "agent_id", "id", "content", F.round("confidence", 6).alias("confidence"),
        at("created_at").alias("created_us"), F.coalesce(at("observed_at"), F.lit(-1)).alias("observed_us"),
        F.size("embeddings").alias("n_embeddings"), F.element_at("tags", 1).alias("tag"),
        F.get_json_object("extra", "$.k").cast("bigint").alias("extra_k"))
