"""V0-V31, P1-P6."""

from pyspark.sql import functions as F

from memloom.functions.json_records import record_json
from memloom.operators import validate as V
from memloom.plans import views as v
from memloom.plans.catalog import query
from memloom.schemas import MANIFEST_DDL, struct_of, struct_type

_R = "CAST(user_id AS VARCHAR) AS agent_id"


def _rule(rule, severity, path, cond):
    return f"SELECT {_R}, '{severity}' AS severity, '{rule}' AS rule, 'records[' || event_id || ']{path}' AS path FROM events WHERE {cond}"


RECORD_RULES = " UNION ALL ".join([
    _rule("V9", "error", ".content", "event_id % 50 = 0"),
    _rule("V10", "error", ".namespace", "event_id % 60 = 0"),
    _rule("V11", "error", ".confidence", "value / 400 > 1"),
    _rule("V12", "error", ".embeddings[0]", "value > 100 AND event_id % 40 = 0"),
    _rule("V13", "error", ".source.runtime", "event_id % 70 = 0"),
    _rule("V14", "warning", ".memory_type", "event_type NOT IN ('click', 'purchase')"),
    _rule("V15", "warning", ".status", "value < 1"),
    _rule("V16", "warning", ".k", "true"),
])


@query(RECORD_RULES)
def validate_records(spark, sf_dir):
    """Rules over records."""
    return V.validate_records(v.event_records(spark, sf_dir)).drop("message")


@query(f"""WITH f AS ({RECORD_RULES}), c AS (SELECT agent_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM f GROUP BY 1)
SELECT DISTINCT CAST(user_id AS VARCHAR) AS agent_id, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, coalesce(e, 0) = 0 AS is_valid
FROM events LEFT JOIN c ON c.agent_id = CAST(user_id AS VARCHAR)""")
def validity_by_agent(spark, sf_dir):
    """Counts of findings and validity per agent (V0)."""
    recs = v.event_records(spark, sf_dir)
    return V.validity(recs.select("agent_id"), V.validate_records(recs))


def _manifests(spark, sf_dir):
    k = F.col("o_orderkey")
    t = k.cast("string")
    typ = struct_type(MANIFEST_DDL)
    agent_t, layers_t = typ["agent"].dataType.simpleString(), typ["layers"].dataType.simpleString()
    memory_t = typ["layers"].dataType["memory"].dataType.simpleString()
    start = F.col("o_orderdate").cast("date")
    part = lambda file, frm, to, n, sealed: F.struct(
        F.lit(file).alias("file"), frm.alias("from"), to.alias("to"), n.cast("bigint").alias("record_count"), sealed.alias("sealed"))
    parts = F.array(
        part("p1", start, F.when(k % 7 != 0, F.date_add(start, 80)), F.lit(6), F.lit(True)),
        part("p2", F.when(k % 8 == 0, F.date_add(start, -90)).otherwise(F.date_add(start, 90)), F.lit(None).cast("date"),
             k % 10, F.lit(False)))
    memory = struct_of(memory_t, record_count=F.when(k % 9 == 0, 99).otherwise(k % 10 + 6), partitions=parts)
    return v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("agent_id"), F.concat(F.lit("z"), t).alias("archive"),
        F.when(k % 5 == 0, "1.0").otherwise("1.0.0").alias("alf_version"),
        struct_of(agent_t, id=F.concat(F.lit("a"), t), name=F.when(k % 6 == 0, "").otherwise("n"),
                  source_runtime=F.when(k % 11 == 0, "").otherwise("r")).alias("agent"),
        struct_of(layers_t, memory=F.when(k % 13 != 0, memory)).alias("layers"),
        F.when(k % 4 == 0, F.concat(F.lit("sha256:"), F.md5("o_orderpriority"))).when(k % 4 == 1, "bad").alias("checksum"),
        F.when(k % 10 == 0, '{"later":1}').alias("extra"))


def _m(rule, path, cond, severity="error"):
    return (f"SELECT CAST(o_custkey AS VARCHAR) AS agent_id, 'z' || k AS archive, '{severity}' AS severity, '{rule}' AS rule, "
            f"'manifest.{path}' AS path FROM o WHERE {cond}")


_MANIFEST_RULES = "WITH o AS (SELECT *, o_orderkey AS k, o_orderkey % 13 <> 0 AS m FROM orders) " + " UNION ALL ".join([
    _m("V1", "alf_version", "k % 5 = 0"), _m("V2", "agent.name", "k % 6 = 0"),
    _m("V3", "agent.source_runtime", "k % 11 = 0"), _m("V4", "checksum", "k % 4 = 1"),
    _m("V5", "layers.memory", "m AND k % 9 = 0"), _m("V6", "layers.memory.partitions", "m AND k % 8 = 0"),
    _m("V7", "layers.memory.partitions[0]", "m AND k % 7 = 0"), _m("V8", "later", "k % 10 = 0", "warning")])


@query(_MANIFEST_RULES)
def validate_manifests(spark, sf_dir):
    """Rules over manifests (V1-V8)."""
    return V.validate_manifests(_manifests(spark, sf_dir)).drop("message")


@query("""WITH o AS (SELECT *, o_orderkey AS k FROM orders), l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(o_custkey AS VARCHAR) AS agent_id, 'z' || k AS archive, 'V30' AS rule FROM o WHERE k % 3 = 0
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'z' || k, 'V31' FROM o JOIN l USING (k)
WHERE k % 13 <> 0 AND n <> CASE WHEN k % 9 = 0 THEN 99 ELSE k % 10 + 6 END""")
def validate_links(spark, sf_dir):
    """Identity and record counts against the manifest."""
    k = F.col("o_orderkey")
    identities = v.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("z"), k.cast("string")).alias("archive"),
        F.concat(F.when(k % 3 == 0, "b").otherwise("a"), k.cast("string")).alias("agent_id"))
    records = v.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("z"), F.col("l_orderkey").cast("string")).alias("archive"))
    return V.validate_links(_manifests(spark, sf_dir), identities, records).select("agent_id", "archive", "rule")


def _l(rule, path, cond, severity="error", t="supplier", k="s_suppkey"):
    return f"SELECT CAST({k} AS VARCHAR) AS agent_id, '{severity}' AS severity, '{rule}' AS rule, '{path}' AS path FROM {t} WHERE {cond}"


@query(" UNION ALL ".join([
    _l("V17", "identity.version", "c_custkey % 4 = 0", t="customer", k="c_custkey"),
    _l("V18", "identity.structured.names.primary", "c_custkey % 5 = 0", t="customer", k="c_custkey"),
    _l("V19", "identity.structured.capabilities[1].name", "c_custkey % 6 = 0", t="customer", k="c_custkey"),
    _l("V20", "identity.structured.sub_agents[0].name", "c_custkey % 7 = 0", t="customer", k="c_custkey"),
    _l("V21", "identity.mood", "c_custkey % 8 = 0", "warning", "customer", "c_custkey"),
    _l("V22", "principals[0].profile.version", "c_custkey % 4 = 0", t="customer", k="c_custkey"),
    _l("V23", "principals[0].profile.principal_id", "c_custkey % 5 = 0", t="customer", k="c_custkey"),
    _l("V24", "principals[0].principal_type", "c_mktsegment = 'MACHINERY'", "warning", "customer", "c_custkey"),
    _l("V25", "credentials[0].service", "c_custkey % 4 = 0", t="customer", k="c_custkey"),
    _l("V26", "credentials[0].encrypted_payload", "c_custkey % 5 = 0", t="customer", k="c_custkey"),
    _l("V27", "credentials[0].encryption.algorithm", "c_custkey % 6 = 0", t="customer", k="c_custkey"),
    _l("V28", "credentials[0].encryption.nonce", "c_custkey % 7 = 0", t="customer", k="c_custkey"),
    _l("V29", "credentials[0].credential_type", "c_mktsegment = 'BUILDING'", "warning", "customer", "c_custkey"),
]))
def validate_layers(spark, sf_dir):
    """Rules over identities, principals and credentials."""
    c = v.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    t = k.cast("string")
    empty = lambda n, text: F.when(k % n == 0, "").otherwise(text)
    item = lambda name: F.struct(name.alias("name"))
    identities = c.select(
        t.alias("agent_id"), F.when(k % 4 == 0, 0).otherwise(1).alias("version"),
        F.struct(F.struct(empty(5, "n").alias("primary")).alias("names"),
                 F.array(item(F.lit("a")), item(empty(6, "b"))).alias("capabilities"),
                 F.array(item(empty(7, "s"))).alias("sub_agents")).alias("structured"),
        F.when(k % 8 == 0, '{"mood":1}').alias("extra"))
    principals = c.select(
        t.alias("owner"), t.alias("id"), F.when(F.col("c_mktsegment") == "MACHINERY", "machine").otherwise("human").alias("principal_type"),
        F.struct(F.when(k % 4 == 0, 0).otherwise(1).alias("version"),
                 F.when(k % 5 == 0, F.concat(t, F.lit("x"))).otherwise(t).alias("principal_id")).alias("profile"))
    credentials = c.select(
        t.alias("agent_id"), empty(4, "s").alias("service"), empty(5, "p").alias("encrypted_payload"),
        F.struct(empty(6, "x").alias("algorithm"), empty(7, "n").alias("nonce")).alias("encryption"),
        F.when(F.col("c_mktsegment") == "BUILDING", "brick").otherwise("api_key").alias("credential_type"))
    return V.merge(V.validate_identities(identities), V.validate_principals(principals),
                   V.validate_credentials(credentials)).select("agent_id", "severity", "rule", "path")


def _p(rule, path, cond):
    return f"SELECT CAST(event_id AS BIGINT) AS line_number, '{rule}' AS rule, 'p:' || event_id || '{path}' AS path FROM events WHERE {cond}"


@query(" UNION ALL ".join([
    _p("P1", "", "event_id % 9 = 0"), _p("P2", ".content", "event_id % 9 = 1"), _p("P2", ".source.runtime", "event_id % 9 = 2"),
    _p("P3", ".agent_id", "event_id % 9 <> 0"), _p("P3", ".supersedes", "event_id % 9 = 3"),
    _p("P4", ".temporal.created_at", "event_id % 9 = 4"), _p("P5", ".temporal.access_count", "event_id % 9 = 5")]))
def validate_lines(spark, sf_dir):
    """Rules over raw record lines."""
    k = F.col("ord.pos") % 9
    line = record_json()
    bad = (
        F.when(k == 0, F.concat(F.lit("#"), line))
        .when(k == 1, F.regexp_replace(line, '"content":"[a-z]*",', ""))
        .when(k == 2, F.regexp_replace(line, '"runtime":"[a-z]*"', '"other":1'))
        .when(k == 3, F.regexp_replace(line, r"\A\{", '{"supersedes":"none",'))
        .when(k == 4, F.regexp_replace(line, r'"created_at":"(\d{4}-\d\d-\d\d)T[^"]*"', '"created_at":"$1"'))
        .when(k == 5, F.regexp_replace(line, '"temporal":\\{', '"temporal":{"access_count":-1,'))
        .otherwise(line)
    )
    lines = v.event_records(spark, sf_dir).select(F.lit("p").alias("partition"), F.col("ord.pos").alias("line_number"), bad.alias("line"))
    return V.validate_lines(lines).select("line_number", "rule", "path")


@query("""SELECT 'z' || o_orderkey AS archive, 'memory/' || o_orderstatus || '.jsonl' AS path, 'P6' AS rule FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)""")
def missing_entries(spark, sf_dir):
    """Entries a manifest names but the archive lacks."""
    entry = F.concat(F.lit("memory/"), "o_orderstatus", F.lit(".jsonl"))
    named = v.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("z"), F.col("o_orderkey").cast("string")).alias("archive"), entry.alias("entry"))
    full = v.table(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    present = named.join(full, "o_orderkey", "left_semi")
    return V.missing_entries(named.select("archive", "entry"), present).select("archive", "path", "rule")


@query(" UNION ALL ".join([
    _p("P2", ".confidence", "event_id % 7 = 0"), _p("P2", ".tags", "event_id % 7 = 1"), _p("P2", ".content", "event_id % 7 = 2"),
    _p("P2", ".entities[1].type", "event_id % 7 = 3"), _p("P2", ".related_records", "event_id % 7 = 4"),
    _p("P3", ".agent_id", "true")]))
def record_type_findings(spark, sf_dir):
    """Fields of the wrong type, also inside lists."""
    k = F.col("ord.pos") % 7
    e = v.event_records(spark, sf_dir).withColumn("confidence", F.lit(0.5)).withColumn("tags", F.lit(None).cast("array<string>"))
    line = F.regexp_replace(record_json(F.struct(*[c for c in e.columns if c != "ord"])), r'"confidence":0\.5,?', "")
    put = lambda text: F.regexp_replace(line, r"\A\{", F.lit("{" + text + ","))
    bad = (
        F.when(k == 0, put('"confidence":"high"')).when(k == 1, put('"tags":"x"'))
        .when(k == 2, F.regexp_replace(line, '"content":"[a-z]*"', '"content":5'))
        .when(k == 3, put('"entities":[{"name":"a","type":"t"},{"name":"b"}]'))
        .when(k == 4, put('"related_records":{"id":"x"}')).otherwise(line)
    )
    lines = e.select(F.lit("p").alias("partition"), F.col("ord.pos").alias("line_number"), bad.alias("line"))
    return V.validate_lines(lines).select("line_number", "rule", "path")
