"""S1-S9, ST1-ST3, U1, and the export plan."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.functions.json_records import record_json
from memloom.operators import memories
from memloom.plans import views as v
from memloom.plans.catalog import query, sql_uuid5
from memloom.plans.catalog.deltas import _chain_sql, _flat
from memloom.plans.catalog.notes import _TYPE, SECTIONS
from memloom.session import by_key, shared_dir
from memloom.sources import archives, sinks
from memloom.sources.workspaces import note_files

_NOTE_ID = sql_uuid5(b"openclaw-alf-ns1", "path || ':' || section_index")


def _blobs(spark, sf_dir, kind):
    """One small archive per order, packed in the tasks that read the orders."""
    recs = v.order_records(spark, sf_dir)
    n = F.col("ord.pos")
    line = record_json()
    if kind == "delta":
        op = F.when(n % 3 == 0, "create").when(n % 3 == 1, "update").otherwise("delete")
        line = F.concat(F.lit('{"operation":"'), op, F.lit('",'), F.substr(line, F.lit(2)))
        memory = F.lit('"memory":{"file":"memory/delta.jsonl","record_count":1}')
        manifest = F.concat(F.lit('{"agent":{"id":"'), "agent_id", F.lit('"},"sync":{"base_sequence":'), (n % 7).cast("string"),
                            F.lit(',"new_sequence":0},"changes":{'), memory, F.lit("}}"))
        entry = F.lit("memory/delta.jsonl")
    else:
        entry = F.concat(F.lit("memory/q"), (n % 3).cast("string"), F.lit(".jsonl"))
        manifest = F.concat(
            F.lit('{"alf_version":"1.0.0","agent":{"id":"'), "agent_id", F.lit('","name":"n","source_runtime":"r"},"layers":{"memory":{"record_count":1,'
            '"partitions":[{"file":"memory/none.jsonl"},{"file":"'), entry, F.lit('"}]}},"later":'), n.cast("string"), F.lit("}"))
    rows = recs.select(F.concat(F.lit("z"), n.cast("string")).alias("path"), manifest.alias("manifest"), entry.alias("entry"),
                       F.concat(F.lit("\n"), line, F.lit("\n \n")).alias("lines"))
    name = "manifest.json" if kind == "snapshot" else "delta-manifest.json"

    def pack(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            out = []
            for path, manifest, entry, text in zip(b["path"], b["manifest"], b["entry"], b["lines"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr(name, manifest)
                    z.writestr(entry, text)
                    z.writestr("raw/r/" + path, path)
                out.append((path, buffer.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return rows.mapInPandas(pack, "path string, content binary")


@query("""SELECT 'z' || o_orderkey AS archive, CAST(o_custkey AS VARCHAR) AS agent_id, e.entry, e.role, e.size FROM orders,
LATERAL (SELECT unnest(['memory/none.jsonl', 'memory/q' || o_orderkey % 3 || '.jsonl', 'raw/r/z' || o_orderkey]) AS entry,
  unnest(['missing', 'memory', 'file']) AS role, unnest([-1, 0, length('z' || o_orderkey)]) AS size) e""")
def archive_scan(spark, sf_dir):
    """Entries of a fleet of archives."""
    e = archives.unpack(_blobs(spark, sf_dir, "snapshot"), roles=["memory", "file"])
    size = F.when(F.col("role") == "file", F.length("data")).when(F.col("role") == "missing", -1).otherwise(0)
    return e.select("archive", "agent_id", "entry", "role", size.alias("size"))


@query("""SELECT 'z' || o_orderkey AS archive, '1.0.0' AS alf_version, 'n' AS name, 1 AS record_count, 2 AS n_partitions,
  '{"later":' || o_orderkey || '}' AS extra FROM orders""")
def manifest_scan(spark, sf_dir):
    """Manifests of a fleet of archives."""
    m = archives.manifests(archives.unpack(_blobs(spark, sf_dir, "snapshot"), roles=["manifest"]))
    memory = F.col("layers.memory")
    return m.select("archive", "alf_version", F.col("agent.name").alias("name"), memory["record_count"].cast("int").alias("record_count"),
                    F.size(memory["partitions"]).alias("n_partitions"), "extra")


@query("""SELECT 'z' || o_orderkey AS archive, 'o' || o_orderkey AS id, 0 AS pos, 2 AS line_number,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS content, epoch_us(o_orderdate + INTERVAL 40 DAY) AS created_us FROM orders""")
def record_scan(spark, sf_dir):
    """Records of a fleet of archives with line numbers and positions (S3)."""
    lines = archives.memory_lines(archives.unpack(_blobs(spark, sf_dir, "snapshot"), roles=["memory"]))
    numbers = lines.select("archive", F.col("line_number").cast("int").alias("line_number"))
    recs = archives.records_of_lines(lines)
    return recs.select(
        "archive", "id", F.col("ord.pos").cast("int").alias("pos"), "content",
        F.unix_micros(F.col("temporal.created_at")).alias("created_us")).join(by_key(numbers), "archive")


@query("""SELECT 'z' || o_orderkey AS archive, CAST(o_orderkey % 7 + 1 AS INT) AS delta_seq, 0 AS pos,
  CASE o_orderkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS operation, 'o' || o_orderkey AS id FROM orders""")
def delta_scan(spark, sf_dir):
    """Entries of a fleet of delta archives."""
    e = archives.unpack(_blobs(spark, sf_dir, "delta"), "delta", ["manifest", "memory"])
    return archives.scan_deltas(e).select("archive", "delta_seq", F.col("pos").cast("int").alias("pos"), "operation", "id")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS owner, 'identity' AS layer, c_name AS name, 0 AS pos FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'principals', 'p' || i, i FROM customer, LATERAL (SELECT unnest(generate_series(0, c_custkey % 3)) AS i)""")
def layer_scan(spark, sf_dir):
    """Identity and principals out of layer documents."""
    c = v.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    one = F.concat(F.lit('{"id":"i","version":1,"structured":{"names":{"primary":"'), "c_name", F.lit('"}}}'))
    item = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.concat(F.lit('{"id":"p'), i.cast("string"), F.lit('"}')))
    many = F.concat(F.lit('{"principals":['), F.array_join(item, ","), F.lit("]}"))
    docs = F.array(F.struct(F.lit("identity").alias("role"), one.alias("d")), F.struct(F.lit("principals").alias("role"), many.alias("d")))
    entries = c.select(k.cast("string").alias("agent_id"), F.lit("z").alias("archive"), F.explode(docs).alias("x")).select(
        "agent_id", "archive", "x.role", F.col("x.d").cast("binary").alias("data"))
    identity = archives.scan_layer(entries, "identity").select(
        "owner", F.lit("identity").alias("layer"), F.col("structured.names.primary").alias("name"), F.lit(0).alias("pos"))
    principals = archives.scan_layer(entries, "principals").select(
        "owner", F.lit("principals").alias("layer"), F.col("id").alias("name"), F.col("pos").cast("int").alias("pos"))
    return identity.unionByName(principals)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS agent_id, year(t) || '-Q' || quarter(t) AS quarter, 'o' || o_orderkey AS id FROM
  (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 40 DAY END AS t FROM orders)""")
def snapshot_lines(spark, sf_dir):
    """JSON lines of a snapshot by agent and quarter, as the sink writes them."""
    recs = sinks.with_quarter(v.order_records(spark, sf_dir)).hint("rebalance", "agent_id", "quarter")
    return recs.select("agent_id", "quarter", F.get_json_object(record_json(), "$.id").alias("id"))


@query(_chain_sql(0).split(",\ns0 AS")[0] + """, e AS (SELECT agent_id, k, i, k * 4 + p AS pos, op FROM b, (SELECT unnest([1, 2, 3]) AS i),
  LATERAL (SELECT unnest(['update', 'delete', 'create', 'create', 'merge']) AS op, unnest([0, 1, 2, 3, 3]) AS p,
    unnest([k % 5 = i, k % 11 = i, k % 11 = i AND k % 2 = 0, k % 13 = i AND k % 11 <> i, k % 17 = i]) AS given) x WHERE given)
SELECT agent_id, i AS delta_seq, pos, op AS operation, 'o' || k AS id FROM e""")
def delta_lines(spark, sf_dir):
    """JSON lines of operation and record, as the delta sink writes them."""
    from memloom.schemas import RECORD_FIELDS

    _, deltas = v.chain(spark, sf_dir)
    for name, typ in RECORD_FIELDS.items():
        if name not in deltas.columns:
            deltas = deltas.withColumn(name, F.lit(None).cast(typ))
    lines = sinks.delta_lines(deltas)
    get = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
    return lines.select("agent_id", "delta_seq", "pos", get("operation"), get("id"))


_NOTE_PATH = SECTIONS.split("SELECT doc_id, ")[1].split(" AS path")[0]


@query(f"""SELECT doc_id, path, runtime FROM (SELECT doc_id, {_NOTE_PATH} AS path FROM documents), (SELECT unnest(['openclaw', 'zeroclaw']) AS runtime)
WHERE starts_with(path, 'memory/') OR (runtime = 'openclaw' AND path = 'MEMORY.md')""")
def note_file_scan(spark, sf_dir):
    """Which files are notes, per runtime."""
    files = v.table(spark, sf_dir, "documents").select("doc_id", v.note_path(F.col("doc_id")).alias("path"))
    one = lambda r: note_files(files, r).withColumn("runtime", F.lit(r))
    return one("openclaw").unionByName(one("zeroclaw"))


@query(f"WITH {SECTIONS} SELECT 'd' || doc_id AS agent_id, {_NOTE_ID} AS id FROM sec WHERE path = 'MEMORY.md' OR starts_with(path, 'memory/')")
def adapter_records(spark, sf_dir):
    """Records through the adapter registered for a runtime."""
    from memloom.plans import export  # noqa: F401 - registers the runtimes
    from memloom.plans.registry import adapter

    return adapter("openclaw").to_records(v.note_files(spark, sf_dir)).select("agent_id", "id")


def _work_dir(spark):
    """A new place for the state of one run."""
    return f"{shared_dir(spark)}/memloom-run-{uuid.uuid4()}"


def _fed(spark, sf_dir):
    """A feed of the delta chain that arrives out of order, in three runs of one stream.

    The second deltas come first and wait.  Then the first ones come, each with another
    delta of the same base; at last the third, with some whose base nobody has.
    """
    from memloom.streaming import ingest

    work = _work_dir(spark)
    base, deltas = v.chain(spark, sf_dir)
    sequences = base.select("agent_id", F.lit(0).cast("bigint").alias("last_sequence")).distinct()
    feed = ingest.start_feed(base, sequences, f"{work}/feed")
    # an agent's delta starts from the one it had before
    heads = deltas.groupBy("agent_id", "delta_seq").agg(F.count(F.lit(1)).alias("record_count")).withColumn(
        "base_sequence",
        F.coalesce(F.lag("delta_seq").over(Window.partitionBy("agent_id").orderBy("delta_seq")), F.lit(0)).cast("bigint"),
    )
    rows = deltas.join(heads, ["agent_id", "delta_seq"])
    first, third = (rows.where(F.col("delta_seq") == n) for n in (1, 3))
    runs = [
        rows.where("delta_seq = 2"),
        first.unionByName(first.withColumn("delta_seq", F.lit(99))),
        third.unionByName(third.withColumns({"base_sequence": F.lit(50).cast("bigint"), "delta_seq": F.lit(51)})),
    ]
    for run in runs:
        run.write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{work}/in")
        ingest.stream_apply_deltas(stream, feed, f"{work}/checkpoint", "hold").awaitTermination()
    return feed


@query(_chain_sql(3))
def stream_deltas(spark, sf_dir):
    """The delta chain arriving as a stream, out of order (ST1, ST2)."""
    return _flat(_fed(spark, sf_dir).records())


_GIVEN = "k % 5 = {0} OR k % 11 = {0} OR (k % 13 = {0} AND k % 11 <> {0}) OR k % 17 = {0}"


@query(f"""WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS agent_id, o_orderkey AS k FROM orders)
SELECT DISTINCT agent_id, CAST(0 AS BIGINT) AS base_sequence, 99 AS delta_seq, 'conflict' AS verdict, false AS waits FROM b WHERE {_GIVEN.format(1)}
UNION ALL SELECT DISTINCT agent_id, 50, 51, 'gap', true FROM b WHERE {_GIVEN.format(3)}""")
def stream_refusals(spark, sf_dir):
    """Deltas that the same stream refused, and those that still wait for an earlier one (ST2)."""
    feed = _fed(spark, sf_dir)
    refused = feed.rejects().drop("batch").withColumn("waits", F.lit(False))
    head = ["agent_id", "base_sequence", "delta_seq"]
    waiting = feed.held().select(*head).distinct().withColumns({"verdict": F.lit("gap"), "waits": F.lit(True)})
    return refused.unionByName(waiting)


@query("SELECT 'o' || o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS agent_id FROM orders")
def stream_records(spark, sf_dir):
    """Records of a growing folder of JSON lines, read as a stream (ST3)."""
    from memloom.streaming.ingest import stream_records as scan

    work = _work_dir(spark)
    v.order_records(spark, sf_dir).select(record_json().alias("value")).write.text(f"{work}/lines")
    out = scan(spark, f"{work}/lines").select("id", "agent_id").writeStream.format("parquet").option(
        "checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start(f"{work}/out")
    out.awaitTermination()
    return spark.read.schema("id string, agent_id string").parquet(f"{work}/out")


@query(f"""WITH {SECTIONS}, t AS (SELECT {_TYPE} AS memory_type, coalesce(CAST(day AS TIMESTAMP), make_timestamp((doc_id + 1767225600) * 1000000)) AS moment FROM sec)
SELECT memory_type, 'memory/' || year(moment) || '-Q' || quarter(moment) || '.jsonl' AS file, count(*) AS n FROM t GROUP BY 1, 2""")
def note_memory_types(spark, sf_dir):
    """Records per memory type and quarter, from note texts to partitions."""
    from memloom.operators.snapshot import with_partition

    recs = with_partition(memories.openclaw_records(v.note_files(spark, sf_dir)))
    return recs.groupBy("memory_type", F.col("partition").alias("file")).agg(F.count(F.lit(1)).alias("n"))
