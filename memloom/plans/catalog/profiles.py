"""T16-T28."""

from pyspark.sql import functions as F

from memloom.functions import notes as N
from memloom.functions.settings import redact
from memloom.functions.text import h1
from memloom.operators import profiles as P
from memloom.operators import workspace_settings as S
from memloom.plans import views as v
from memloom.plans.catalog import query


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS line,
  generate_subscripts(string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)), 1) AS n
  FROM documents),
k AS (SELECT *, regexp_replace(trim(split_part(line, '=', 1)), '^"+|"+$', '', 'g') AS name FROM l),
r AS (SELECT doc_id, n, CASE WHEN contains(line, '=') AND regexp_matches(lower(name), 'api_key|token|secret|password')
  THEN split_part(line, '=', 1) || '= "<redacted>"' ELSE line END AS line FROM k)
SELECT doc_id, md5(string_agg(line || chr(10), '' ORDER BY n)) AS text_md5,
  count(*) FILTER (ends_with(line, '= "<redacted>"')) AS redacted FROM r GROUP BY doc_id""")
def redact_documents(spark, sf_dir):
    """Secret values taken out of whole texts."""
    d = v.table(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("t"))
    hits = F.filter(F.split("t", "\n"), lambda line: line.endswith('= "<redacted>"'))
    return d.select("doc_id", F.md5("t").alias("text_md5"), F.size(hits).cast("bigint").alias("redacted"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'bot_token' WHEN 1 THEN 'Api_Key' WHEN 2 THEN 'SSH_key'
  WHEN 3 THEN 'password' ELSE 'name' END || '_' || p_size AS name FROM part)
SELECT p_partkey, regexp_matches(lower(name), 'api_key|token|secret|password') AS secret,
  CASE WHEN contains(lower(name), 'token') THEN 'oauth_token' WHEN contains(lower(name), 'key') THEN 'api_key' ELSE 'secret' END AS kind FROM n""")
def secret_names(spark, sf_dir):
    """Which names mark secrets, and of what kind."""
    from memloom.functions.settings import credential_type, is_secret_name

    k = F.col("p_partkey") % 5
    name = F.concat(F.when(k == 0, "bot_token").when(k == 1, "Api_Key").when(k == 2, "SSH_key").when(
        k == 3, "password").otherwise("name"), F.lit("_"), F.col("p_size").cast("string"))
    return v.table(spark, sf_dir, "part").select(
        "p_partkey", is_secret_name(name).alias("secret"), credential_type(name).alias("kind"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS agent_id, c_name AS name, 'Europe/City' || c_nationkey AS zone_a, 'skip/this' AS zone_b
FROM customer WHERE c_custkey % 4 <> 0""")
def headings_and_timezones(spark, sf_dir):
    """First heading and time zone of profile files."""
    users = v.customer_files(spark, sf_dir).where("path = 'USER.md'")
    text = F.col("content")
    zone_b = N.timezone(text, "zeroclaw")
    # the second reading takes any first word with a slash
    return users.select(
        "agent_id", h1(text).alias("name"), N.timezone(text, "openclaw").alias("zone_a"), zone_b.alias("zone_b"))


_NAMED = """WITH c AS (SELECT c_custkey AS k, * FROM customer),
cfg AS (SELECT k, c_name FROM c WHERE k % 5 <> 0 AND k % 3 = 0 AND k % 6 = 0)"""


@query(_NAMED + """ SELECT CAST(c.k AS VARCHAR) AS agent_id, coalesce(cfg.c_name, CASE WHEN c.k % 2 = 0 THEN 'Soul ' || c.k END,
  CASE WHEN c.k % 3 = 0 THEN 'Id ' || c.k END, 'w' || c.k) AS name FROM c LEFT JOIN cfg USING (k)""")
def agent_names(spark, sf_dir):
    """Display names of agents."""
    files = v.customer_files(spark, sf_dir)
    places = files.select("agent_id", "workspace").distinct()
    return P.agent_names(files, places, S.config_fields(files))


@query(_NAMED + """ SELECT CAST(c.k AS VARCHAR) AS agent_id, cfg.k IS NOT NULL AS from_json,
  CASE WHEN cfg.k IS NOT NULL THEN cfg.c_name WHEN c.k % 2 = 0 THEN 'Soul ' || c.k ELSE 'Id ' || c.k END AS name,
  CASE WHEN cfg.k IS NOT NULL THEN 'n' || c.k ELSE '' END AS nickname, CASE WHEN cfg.k IS NOT NULL THEN 'INTJ' ELSE '' END AS mbti,
  CASE WHEN cfg.k IS NOT NULL THEN lower(c_mktsegment) ELSE '' END AS goals,
  CASE WHEN cfg.k IS NOT NULL THEN (c.k % 10) / 10.0 ELSE -1 END AS calm,
  CASE WHEN cfg.k IS NOT NULL THEN '{"history":{"born":' || c.k || '}}' ELSE '' END AS extensions,
  c.k % 2 = 0 AS has_soul, c.k % 3 = 0 AS has_profile
FROM (SELECT c_custkey AS k, c_mktsegment FROM customer) c LEFT JOIN cfg USING (k) WHERE c.k % 2 = 0 OR c.k % 3 = 0""")
def identities(spark, sf_dir):
    """Identity documents out of persona files and persona JSON."""
    files = v.customer_files(spark, sf_dir)
    s = F.col("structured")
    text = lambda c: F.coalesce(c, F.lit(""))
    return P.identities(files, v.ts(v.AS_OF), S.config_fields(files)).select(
        "agent_id", (F.col("source_format") == "aieos").alias("from_json"), s["names"]["primary"].alias("name"),
        text(s["names"]["nickname"]).alias("nickname"), text(s["psychology"]["mbti"]).alias("mbti"),
        F.array_join(s["goals"], ",").alias("goals"),
        F.coalesce(F.try_element_at(s["psychology"]["neural_matrix"], F.lit("calm")), F.lit(-1.0)).alias("calm"),
        text(s["aieos_extensions"]).alias("extensions"), F.col("prose.soul").isNotNull().alias("has_soul"),
        F.col("prose.identity_profile").isNotNull().alias("has_profile"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS owner, c_name AS name, 'Europe/City' || c_nationkey AS timezone, 'human' AS kind, true AS linked
FROM customer WHERE c_custkey % 4 <> 0""")
def principals(spark, sf_dir):
    """Principals out of profile files."""
    p = P.principals(v.customer_files(spark, sf_dir), v.ts(v.AS_OF), "openclaw")
    s = F.col("profile.structured")
    return p.select("owner", s["name"].alias("name"), s["timezone"].alias("timezone"), F.col("principal_type").alias("kind"),
                    (F.col("profile.principal_id") == F.col("id")).alias("linked"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS agent_id,
  CASE c_custkey % 4 WHEN 0 THEN 'sqlite' WHEN 1 THEN 'markdown' WHEN 2 THEN 'none' ELSE 'unsupported' END AS backend,
  c_custkey % 2 = 0 AS auto_save, 'none' AS embedding_provider, (c_custkey % 10) / 10.0 AS vector_weight, 0.3 :: DOUBLE AS keyword_weight,
  CASE WHEN c_custkey % 3 = 0 THEN 'aieos' ELSE 'openclaw' END AS identity_format, 'persona.json' AS aieos_path,
  true AS secrets_encrypt, '1.' || c_custkey AS runtime_version FROM customer WHERE c_custkey % 5 <> 0""")
def config_fields(spark, sf_dir):
    """Settings with their defaults."""
    return S.config_fields(v.customer_files(spark, sf_dir)).drop("aieos_inline")


_HINTS = """h AS (SELECT CAST(c_custkey AS VARCHAR) AS agent_id, 'root' AS section, 'openai_api_key' AS field, 'openai_api_key' AS service,
  'api_key' AS credential_type FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'channels_config.' || lower(c_mktsegment), 'bot_token', 'channel:' || lower(c_mktsegment), 'oauth_token'
  FROM customer WHERE c_custkey % 5 <> 0)"""


@query(f"WITH {_HINTS} SELECT * FROM h")
def credential_hints(spark, sf_dir):
    """Where settings hold secrets."""
    return S.credential_hints(v.customer_files(spark, sf_dir))


@query(f"WITH {_HINTS} SELECT agent_id, service, credential_type, '<not-exported>' AS encrypted_payload, section || '.' || field AS label FROM h")
def credential_rows(spark, sf_dir):
    """Credential metadata, payload left out."""
    rows = S.credential_rows(S.credential_hints(v.customer_files(spark, sf_dir)), v.ts(v.AS_OF))
    return rows.select("agent_id", "service", "credential_type", "encrypted_payload", "label")
