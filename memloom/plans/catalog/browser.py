"""Memory browser and artifact tiers."""

import uuid

from pyspark.sql import functions as F

from memloom.operators import artifacts, browse
from memloom.operators.snapshot import attachment_rollup
from memloom.plans import views as v
from memloom.plans.catalog import query
from memloom.session import shared_dir

_BUDGET = 150_000_000
_FILES = f"""WITH f AS (SELECT CASE WHEN doc_id % 3 <> 0 THEN 'big' ELSE source END AS agent_id, n_chars * 1000 AS size_bytes,
  'f' || doc_id || CASE doc_id % 10 WHEN 0 THEN '.md' WHEN 1 THEN '.json' ELSE '.bin' END AS path, doc_id % 10 AS kind FROM documents),
t AS (SELECT *, CASE WHEN kind = 0 OR (kind = 1 AND size_bytes <= 65536) THEN 1 WHEN size_bytes <= 10485760 THEN 2 ELSE 3 END AS first FROM f),
s AS (SELECT *, sum(CASE WHEN first = 2 THEN size_bytes ELSE 0 END) OVER (PARTITION BY agent_id, first ORDER BY size_bytes, path) AS total FROM t),
u AS (SELECT agent_id, path, size_bytes, CASE WHEN first = 2 AND total > {_BUDGET} THEN 3 ELSE first END AS tier FROM s)
"""


def _tiers(spark, sf_dir):
    n = F.col("doc_id")
    files = v.table(spark, sf_dir, "documents").select(
        F.when(n % 3 != 0, "big").otherwise(F.col("source")).alias("agent_id"), (F.col("n_chars") * 1000).alias("size_bytes"),
        F.concat(F.lit("f"), n.cast("string"), F.when(n % 10 == 0, ".md").when(n % 10 == 1, ".json").otherwise(".bin")).alias("path"))
    return artifacts.tier_artifacts(files, budget=_BUDGET)


@query(_FILES + """SELECT *, CASE tier WHEN 1 THEN 'raw/openclaw/' || path WHEN 2 THEN 'artifacts/' || path END AS archive_path FROM u""")
def artifact_tiers(spark, sf_dir):
    """Artifacts by tier, with one agent that has most of them."""
    return _tiers(spark, sf_dir)


@query(_FILES + """SELECT agent_id, count(*) AS count, count(*) FILTER (tier < 3) AS included_count,
  CAST(coalesce(sum(size_bytes) FILTER (tier < 3), 0) AS BIGINT) AS included_size_bytes, count(*) FILTER (tier = 3) AS referenced_count,
  CAST(coalesce(sum(size_bytes) FILTER (tier = 3), 0) AS BIGINT) AS referenced_size_bytes FROM u GROUP BY 1""")
def artifact_rollup(spark, sf_dir):
    """What each agent's archive holds of its artifacts, and what it refers to."""
    return attachment_rollup(_tiers(spark, sf_dir))


def _browsed(spark, sf_dir):
    """An index of events brought forward by a delta: some gone, some changed, some new."""
    path = f"{shared_dir(spark)}/memloom-run-{uuid.uuid4()}/facets"
    recs = v.whole_records(v.event_records(spark, sf_dir))
    n = F.col("ord.pos")
    browse.write_index(recs.where(n % 6 != 0), path, buckets=4)
    operation = F.when(n % 6 == 0, "create").when(n % 15 == 1, "delete").when(n % 15 == 2, "update")
    deltas = recs.select("*", operation.alias("operation"), F.lit(1).alias("delta_seq"), n.alias("pos")).where("operation IS NOT NULL")
    deltas = deltas.withColumn("status", F.when(n % 15 == 2, "superseded").otherwise(F.col("status")))
    browse.upsert_index(spark, path, deltas, buckets=4)
    return path


_STATE = """WITH r AS (SELECT event_id AS n, CAST(user_id AS VARCHAR) AS agent_id, event_type AS tag,
  CASE event_type WHEN 'click' THEN 'episodic' WHEN 'purchase' THEN 'preference' ELSE event_type END AS type,
  CASE WHEN event_id % 6 <> 0 AND event_id % 15 = 2 THEN 'superseded' WHEN value > 300 THEN 'archived' WHEN value < 1 THEN 'stale' ELSE 'active' END AS status,
  ts AS seen FROM events WHERE NOT (event_id % 6 <> 0 AND event_id % 15 = 1))
"""


@query(_STATE + """SELECT facet, value, count(*) AS n FROM (
  SELECT 'type' AS facet, type AS value FROM r UNION ALL SELECT 'status', status FROM r UNION ALL SELECT 'tag', tag FROM r
  UNION ALL SELECT 'day', CAST(CAST(seen AS DATE) AS VARCHAR) FROM r) GROUP BY 1, 2""")
def browser_facets(spark, sf_dir):
    """Records per facet value, after a delta."""
    return browse.facet_counts(browse.read_index(spark, _browsed(spark, sf_dir)), "type", "status", "tag", "day")


@query(_STATE + """SELECT agent_id, seen, n FROM r WHERE status IN ('active', 'superseded') AND tag = 'purchase'
  AND CAST(seen AS DATE) >= DATE '2024-01-05' AND CAST(seen AS DATE) < DATE '2024-01-20'""")
def browser_search(spark, sf_dir):
    """Records that have all of some facets, read off the postings alone."""
    found = browse.browse(spark, _browsed(spark, sf_dir), days=("2024-01-05", "2024-01-20"), status=["active", "superseded"], tag="purchase")
    ids = v.event_records(spark, sf_dir).select("agent_id", "id", F.col("ord.pos").alias("n"))
    return found.join(ids, ["agent_id", "id"]).select("agent_id", "seen", "n")
