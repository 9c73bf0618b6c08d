"""X1-X5, X22."""

from pyspark.sql import functions as F

from memloom.operators import delta as D
from memloom.plans import views as v
from memloom.plans.catalog import query

CENTS = "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)"
_STATES = f"""
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS agent_id, o_orderkey AS k, {CENTS} AS c FROM orders),
old AS (SELECT * FROM o WHERE k % 10 <> 0),
new AS (SELECT agent_id, k, CASE WHEN k % 5 = 0 THEN c || '+' ELSE c END AS c FROM o WHERE k % 7 <> 0),
d AS (SELECT CASE WHEN old.k IS NULL THEN 'create' ELSE 'update' END AS operation, new.* FROM new
  LEFT JOIN old USING (agent_id, k) WHERE old.k IS NULL OR old.c <> new.c
  UNION ALL SELECT 'delete', old.* FROM old ANTI JOIN new USING (agent_id, k))
"""


@query(_STATES + """SELECT operation, agent_id, 'o' || k AS id, k AS pos, c AS content,
  CASE operation WHEN 'create' THEN 0 WHEN 'update' THEN 1 ELSE 2 END AS op_rank FROM d""")
def delta_compute(spark, sf_dir):
    """Changes between two states."""
    found = D.compute_delta(*v.old_and_new(spark, sf_dir))
    return found.select("operation", "agent_id", "id", F.col("ord.pos").alias("pos"), "content", "op_rank")


@query(f"""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS agent_id, o_orderkey AS k, {CENTS} AS c FROM orders)
SELECT agent_id, 'o' || k AS id, CASE k % 80 WHEN 0 THEN 'update' WHEN 40 THEN 'update' WHEN 1 THEN 'delete' ELSE 'create' END AS operation,
  CASE WHEN k % 40 = 0 THEN c || '+' ELSE c END AS content FROM o WHERE k % 80 IN (0, 40, 1, 2)""")
def delta_of_few_changes(spark, sf_dir):
    """Two states that differ in one record of twenty."""
    recs = v.order_records(spark, sf_dir)
    n = F.col("ord.pos") % 80
    new = recs.where(n != 1).withColumn("content", F.when(n % 40 == 0, F.concat("content", F.lit("+"))).otherwise(F.col("content")))
    return D.compute_delta(recs.where(n != 2), new).select("agent_id", "id", "operation", "content")


@query(_STATES + """SELECT agent_id, count(*) FILTER (operation = 'create') AS creates,
  count(*) FILTER (operation = 'update') AS updates, count(*) FILTER (operation = 'delete') AS deletes
FROM d GROUP BY agent_id""")
def delta_counts(spark, sf_dir):
    """Creates, updates and deletes per agent."""
    return D.change_counts(D.compute_delta(*v.old_and_new(spark, sf_dir)))


@query("""
WITH e AS (SELECT event_id, user_id, event_type FROM events),
old AS (SELECT user_id, event_type, max_by(event_id, event_id) AS last, count(*) AS n FROM e WHERE event_id % 3 <> 0 GROUP BY 1, 2),
new AS (SELECT user_id, event_type, event_id FROM e WHERE event_id % 5 = 0)
SELECT CAST(user_id AS VARCHAR) AS agent_id, event_type AS id, operation, count(*) AS n, max(event_id) AS last FROM (
  SELECT new.*, CASE WHEN old.last IS NULL THEN 'create' ELSE 'update' END AS operation FROM new LEFT JOIN old USING (user_id, event_type)
  WHERE old.last IS NULL OR old.last <> new.event_id
  UNION ALL SELECT user_id, event_type, event_id, 'delete' FROM e ANTI JOIN new USING (user_id, event_type) WHERE event_id % 3 <> 0)
GROUP BY ALL""")
def delta_of_repeated_ids(spark, sf_dir):
    """Changes where ids repeat: last old row compared, every row emitted."""
    e = v.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("agent_id"), F.col("event_type").alias("id"),
        v.place(F.col("event_id")), F.col("event_id").alias("content"))
    n = F.col("content")
    found = D.compute_delta(e.where(n % 3 != 0), e.where(n % 5 == 0))
    return found.groupBy("agent_id", "id", "operation").agg(
        F.count(F.lit(1)).alias("n"), F.max("content").alias("last"))


def _chain_sql(deltas: int) -> str:
    out = [f"""WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS agent_id, o_orderkey AS k, {CENTS} AS c FROM orders),
s0 AS (SELECT agent_id, k, 0 AS d, k AS pos, c FROM b WHERE k % 4 <> 0)"""]
    for i in range(1, deltas + 1):
        out.append(f"""e{i} AS (SELECT *, k % 5 = {i} AS u, k % 11 = {i} AS x, (k % 11 = {i} AND k % 2 = 0) AS c1,
  (k % 13 = {i} AND k % 11 <> {i}) AS c2 FROM b),
s{i} AS (SELECT s.agent_id, s.k, s.d, s.pos, CASE WHEN e.u THEN e.c || '.update.{i}' ELSE s.c END AS c
  FROM s{i - 1} s JOIN e{i} e USING (agent_id, k) WHERE NOT e.x
  UNION ALL SELECT e.agent_id, e.k, {i}, e.k * 4 + CASE WHEN e.c1 THEN 2 ELSE 3 END, e.c || '.create.{i}'
  FROM e{i} e LEFT JOIN s{i - 1} s USING (agent_id, k)
  WHERE (s.k IS NOT NULL AND e.x AND e.c1) OR (s.k IS NULL AND (e.c1 OR e.c2)))""")
    return ",\n".join(out) + f"\nSELECT agent_id, 'o' || k AS id, d AS ord_delta, pos AS ord_pos, c AS content FROM s{deltas}"


def _flat(df):
    return df.select("agent_id", "id", F.col("ord.delta").alias("ord_delta"), F.col("ord.pos").alias("ord_pos"), "content")


@query(_chain_sql(1))
def delta_apply(spark, sf_dir):
    """Records after one delta."""
    base, deltas = v.chain(spark, sf_dir)
    return _flat(D.apply_delta(base, deltas.where("delta_seq = 1")))


@query(_chain_sql(3))
def delta_chain(spark, sf_dir):
    """Records after a chain of three deltas."""
    return _flat(D.apply_deltas(*v.chain(spark, sf_dir)))


@query("""
WITH lim AS (SELECT max(event_id) FILTER (event_type IN ('click', 'error')) AS top,
  min(event_id) FILTER (event_type = 'signup') AS cut, max(event_id) FILTER (event_type = 'view') AS upd,
  max(event_id) FILTER (event_type = 'purchase') AS last_buy FROM events)
SELECT CAST(event_id AS VARCHAR) AS content, 0 AS ord_delta, event_id AS ord_pos FROM events, lim
  WHERE event_type IN ('click', 'error') AND event_id <> top
UNION ALL SELECT CASE WHEN event_id = last_buy THEN 'u' || upd ELSE CAST(event_id AS VARCHAR) END, 1, event_id FROM events, lim
  WHERE event_type = 'purchase' AND event_id > cut""")
def delta_one_hot_id(spark, sf_dir):
    """Every row belongs to one id: copies in the base, deletes, creates and updates."""
    e = v.table(spark, sf_dir, "events").select(
        F.lit("a").alias("agent_id"), F.lit("hot").alias("id"), "event_id", "event_type",
        F.col("event_id").cast("string").alias("content"))
    kind, pos = F.col("event_type"), F.col("event_id")
    base = e.where(kind.isin("click", "error")).select("agent_id", "id", v.place(pos), "content")
    first = e.where(kind.isin("signup", "purchase")).select(
        "agent_id", "id", F.lit(1).alias("delta_seq"), pos.alias("pos"),
        F.when(kind == "signup", "delete").otherwise("create").alias("operation"), "content")
    second = e.where(kind == "view").select(
        "agent_id", "id", F.lit(2).alias("delta_seq"), pos.alias("pos"), F.lit("update").alias("operation"),
        F.concat(F.lit("u"), "content").alias("content"))
    return _flat(D.apply_deltas(base, first.unionByName(second))).drop("agent_id", "id")


@query(_STATES + """SELECT agent_id, 'o' || k AS id,
  CASE WHEN new.k IS NULL THEN 'missing' WHEN old.k IS NULL THEN 'unexpected' ELSE 'content mismatch' END AS difference
FROM old FULL JOIN new USING (agent_id, k) WHERE old.c IS DISTINCT FROM new.c""")
def record_set_diff(spark, sf_dir):
    """Ids that differ between two record sets."""
    return D.diff_records(*v.old_and_new(spark, sf_dir)).select("agent_id", "id", "difference")


@query(_STATES + """SELECT agent_id, 'o' || k AS id, c AS content, CASE WHEN d.operation = 'create' THEN 1 ELSE 0 END AS delta
FROM new LEFT JOIN (SELECT agent_id, k, operation FROM d WHERE operation <> 'delete') AS d USING (agent_id, k)""")
def sync_round_trip(spark, sf_dir):
    """Compute a delta, number it, write and read it, apply it, write and read the snapshot
    (X1, X4, X5, S6, S7)."""
    import uuid

    from memloom.session import shared_dir, stored
    from memloom.sources import sinks

    work = f"{shared_dir(spark)}/memloom-run-{uuid.uuid4()}"
    old, new = v.old_and_new(spark, sf_dir)
    marks = lambda df: df.select("agent_id").distinct().withColumn("last_sequence", F.lit(0))
    sinks.write_snapshot(sinks.Snapshot(v.whole_records(old), marks(old)), f"{work}/base", buckets=2)
    base = sinks.read_snapshot_tables(spark, f"{work}/base")
    changes = stored(D.compute_delta(base.records, v.whole_records(new)), f"{work}/changes")
    entries = stored(D.number_deltas(changes, marks(old)), f"{work}/entries")
    sinks.write_deltas(entries, entries.select("agent_id", "delta_seq", "base_sequence").distinct(), f"{work}/deltas", "p1", buckets=2)
    pushed, _ = sinks.read_delta_tables(spark, f"{work}/deltas")
    sinks.write_snapshot(sinks.Snapshot(D.apply_deltas(base.records, pushed), base.manifests), f"{work}/next", buckets=2)
    out = sinks.read_snapshot_tables(spark, f"{work}/next").records
    return out.select("agent_id", "id", "content", F.col("ord.delta").cast("int").alias("delta"))
