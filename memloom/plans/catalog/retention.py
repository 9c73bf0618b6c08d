"""Retention tiers, upkeep of note files."""

from pyspark.sql import functions as F

from memloom.operators import retention as R
from memloom.plans import views as v
from memloom.plans.catalog import query

_AS_OF = "2024-03-01 00:00:00"


def _observations(spark, sf_dir):
    """Events of a user and day as observations of one memory; a value is its importance in percent."""
    e = v.table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("agent_id"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("id"),
        F.when(F.col("event_id") % 5 != 0, F.col("value") / 100).alias("importance"), F.col("ts").alias("seen"))


@query(f"""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS agent_id, event_type || (event_id % 7) AS id,
  CASE WHEN event_id % 5 <> 0 THEN value / 100 END AS importance, ts AS seen FROM events),
l AS (SELECT agent_id, id, importance, seen FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, id ORDER BY seen DESC, importance DESC NULLS LAST) AS n FROM o) WHERE n = 1),
t AS (SELECT *, CASE WHEN importance IS NULL THEN NULL WHEN importance >= 0.8 THEN 'structural' WHEN importance >= 0.4 THEN 'potential' ELSE 'contextual' END AS tier FROM l),
e AS (SELECT *, CASE tier WHEN 'potential' THEN seen + INTERVAL 30 DAY WHEN 'contextual' THEN seen + INTERVAL 7 DAY END AS expires_at FROM t)
SELECT agent_id, id, tier, expires_at, coalesce(expires_at <= TIMESTAMP '{_AS_OF}', false) AS expired FROM e""")
def retention_tiers(spark, sf_dir):
    """Tier and end of each memory, by its last observation."""
    return R.retention(_observations(spark, sf_dir), v.ts(_AS_OF))


@query("""WITH f AS (SELECT doc_id, 'd' || doc_id AS agent_id, doc_id % 9 AS c, make_timestamp((doc_id + 1767225600) * 1000000) AS mtime,
  '2026-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') AS d FROM documents),
p AS (SELECT *, CASE c WHEN 0 THEN 'MEMORY.md' WHEN 1 THEN 'memory/Active-Context.md' WHEN 2 THEN 'memory/project-gating-policies.md'
  WHEN 3 THEN 'memory/gating_policies.md' WHEN 4 THEN 'memory/archive/' || d || '.md' WHEN 5 THEN 'memory/session_' || doc_id || '.md'
  ELSE 'memory/' || d || '.md' END AS path FROM f),
a AS (SELECT *, date_diff('day', CASE WHEN c IN (4, 6, 7, 8) THEN try_cast(d AS DATE) WHEN c = 5 THEN CAST(mtime AS DATE) END, DATE '2026-07-20') AS age FROM p),
t AS (SELECT *, CASE WHEN c = 4 AND age >= 30 THEN 'purge' WHEN c <> 4 AND age >= 7 THEN 'archive' ELSE 'keep' END AS action FROM a)
SELECT agent_id, path, action, CASE action WHEN 'archive' THEN 'memory/archive/' || substr(path, 8) WHEN 'keep' THEN path END AS target FROM t""")
def note_upkeep(spark, sf_dir):
    """Note files to archive and to purge by their age."""
    return R.upkeep(v.note_files(spark, sf_dir), v.ts("2026-07-20 00:00:00"))


@query(f"""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS agent_id, event_type || (event_id % 7) AS id,
  CASE WHEN event_id % 5 <> 0 THEN value / 100 END AS importance, ts AS seen FROM events),
l AS (SELECT agent_id, id, importance, seen FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, id ORDER BY seen DESC, importance DESC NULLS LAST) AS n FROM o) WHERE n = 1),
e AS (SELECT agent_id, id, CASE WHEN importance >= 0.8 THEN NULL WHEN importance >= 0.4 THEN seen + INTERVAL 30 DAY WHEN importance < 0.4 THEN seen + INTERVAL 7 DAY END AS expires_at FROM l)
SELECT o.agent_id, o.id, count(*) AS n, max(seen) AS last FROM o LEFT JOIN e ON e.agent_id = o.agent_id AND e.id = o.id
WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-25 00:00:00' GROUP BY ALL""")
def retained_observations(spark, sf_dir):
    """What is left of the observations once expired memory is purged."""
    left = R.retained(_observations(spark, sf_dir), v.ts("2024-01-25 00:00:00"))
    return left.groupBy("agent_id", "id").agg(F.count("*").alias("n"), F.max("seen").alias("last"))
