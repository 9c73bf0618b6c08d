"""The given tables seen as memory data.  Row-wise mappings; only files of customers are dealt out first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.ids import uuid5
from memloom.schemas import ORD, RECORD_FIELDS, UUID_NAMESPACES, record_columns, struct_of

NS = UUID_NAMESPACES["record", "openclaw"]
_SOURCE, _TEMPORAL = RECORD_FIELDS["source"], RECORD_FIELDS["temporal"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


AS_OF = "2000-01-01 00:00:00"


def place(pos: Column, delta: int = 0) -> Column:
    return F.struct(F.lit(delta).alias("delta"), pos.cast("bigint").alias("pos")).cast(ORD).alias("ord")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records, some of them broken on purpose."""
    e = table(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    vector = F.array(F.col("value"), F.lit(0.5))
    embedding = struct_of(
        RECORD_FIELDS["embeddings"][len("array<"):-1],
        model=F.lit("m"), dimensions=F.when(n % 40 == 0, 3).otherwise(2), vector=vector,
        computed_at=F.col("ts"), source=F.lit("runtime"),
    )
    return e.select(
        place(n),
        *record_columns(
            agent_id=F.col("user_id").cast("string"),
            id=uuid5(NS, F.concat(F.lit("event:"), n.cast("string"))),
            content=F.when(n % 50 == 0, "").otherwise(kind),
            memory_type=F.when(kind == "click", "episodic").when(kind == "purchase", "preference")
            .otherwise(kind),
            status=F.when(F.col("value") > 300, "archived").when(F.col("value") < 1, "stale")
            .otherwise("active"),
            namespace=F.when(n % 60 == 0, "").otherwise(kind),
            confidence=F.col("value") / 400,
            source=struct_of(
                _SOURCE, runtime=F.when(n % 70 == 0, "").otherwise("openclaw"),
                origin_file=F.when(n % 4 == 0, F.concat(F.lit("memory/"), kind, F.lit(".md"))),
            ),
            temporal=struct_of(
                _TEMPORAL, created_at=F.col("ts"),
                observed_at=F.when(n % 3 != 0, F.col("ts")),
            ),
            tags=F.array(kind),
            embeddings=F.when(F.col("value") > 100, F.array(embedding)).otherwise(F.array()),
            extra=F.col("props"),
        ),
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records over many quarters; a third is only known by creation time."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    seen = F.when(n % 3 != 0, F.col("o_orderdate"))
    return o.select(
        place(n),
        *record_columns(
            agent_id=F.col("o_custkey").cast("string"),
            id=F.concat(F.lit("o"), n.cast("string")),
            content=cents(),
            memory_type=F.lit("semantic"), status=F.lit("active"),
            namespace=F.col("o_orderpriority"),
            source=struct_of(_SOURCE, runtime=F.lit("openclaw")),
            temporal=struct_of(
                _TEMPORAL, created_at=F.col("o_orderdate") + F.expr("interval 40 days"),
                observed_at=seen,
            ),
            tags=F.array("o_orderstatus"),
        ),
    )


def cents() -> Column:
    return F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the order records: some gone, some new, some changed."""
    recs = order_records(spark, sf_dir)
    n = F.col("ord.pos")
    changed = F.when(n % 5 == 0, F.concat(F.col("content"), F.lit("+"))).otherwise(F.col("content"))
    return recs.where(n % 10 != 0), recs.where(n % 7 != 0).withColumn("content", changed)


def whole_records(df: DataFrame) -> DataFrame:
    """Records with every column of the format, null where ``df`` has none."""
    return df.select("ord", *[
        (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in RECORD_FIELDS.items()])


def chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A base of order records and three deltas over them.

    In delta k a record is changed, deleted, created again after its delete, created
    although it is there, or hit by an unknown operation, by its key.
    """
    recs = order_records(spark, sf_dir).select("ord", "agent_id", "id", "content")
    n = F.col("ord.pos")
    base = recs.where(n % 4 != 0)
    step = lambda k, op, cond, at: F.when(
        cond, F.struct(F.lit(k).alias("delta_seq"), (n * 4 + at).alias("pos"), F.lit(op).alias("operation"))
    )
    ops = []
    for k in (1, 2, 3):
        ops += [
            step(k, "update", n % 5 == k, 0),
            step(k, "delete", n % 11 == k, 1),
            step(k, "create", (n % 11 == k) & (n % 2 == 0), 2),
            step(k, "create", (n % 13 == k) & (n % 11 != k), 3),
            step(k, "merge", n % 17 == k, 3),
        ]
    deltas = recs.select("agent_id", "id", "content", F.explode(F.array_compact(F.array(*ops))).alias("e"))
    deltas = deltas.select(
        "agent_id", "id", "e.*",
        F.concat_ws(".", F.col("content"), F.col("e.operation"), F.col("e.delta_seq").cast("string")).alias("content"),
    )
    return base, deltas


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as note files: some lines become headings, some words tags."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    headed = F.regexp_replace("text", r"(?md)^([A-E])", "## $1")
    tagged = F.replace(F.replace(headed, F.lit(" on "), F.lit(" #On! ")), F.lit(" la "), F.lit(" ##La-x, "))
    scored = F.replace(
        tagged, F.lit(".\n"),
        F.concat(F.lit(". [n"), (n % 3).cast("string"), F.lit("|i=0."), (n % 10).cast("string"), F.lit("]\n")),
    )
    return d.select(
        F.concat(F.lit("d"), n.cast("string")).alias("agent_id"),
        note_path(n).alias("path"),
        scored.alias("content"),
        F.timestamp_seconds(n + 1767225600).alias("mtime"),
    )


def note_path(n: Column) -> Column:
    day = F.concat(F.lit("2026-"), F.lpad((n % 14).cast("string"), 2, "0"), F.lit("-"),
                   F.lpad((n % 33).cast("string"), 2, "0"), F.lit(".md"))
    return (
        F.when(n % 9 == 0, "MEMORY.md")
        .when(n % 9 == 1, "memory/Active-Context.md")
        .when(n % 9 == 2, "memory/project-gating-policies.md")
        .when(n % 9 == 3, "memory/gating_policies.md")
        .when(n % 9 == 4, F.concat(F.lit("memory/archive/"), day))
        .when(n % 9 == 5, F.concat(F.lit("memory/session_"), n.cast("string"), F.lit(".md")))
        .otherwise(F.concat(F.lit("memory/"), day))
    )


def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as rows of a memory table."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 1000 + F.col("turn")
    at = F.timestamp_seconds(n + 1767225600)
    native = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return c.select(
        F.col("conv_id").cast("string").alias("agent_id"),
        F.when(F.col("turn") % 2 == 0, F.upper(uuid5(NS, native))).otherwise(native).alias("id"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("assistant_autosave_"), F.col("turn").cast("string")))
        .otherwise("note").alias("key"),
        F.col("text").alias("content"),
        F.when(F.col("role") == "user", "Conversation").when(F.col("role") == "assistant", "core")
        .when(F.col("turn") == 0, "custom:Rules").otherwise("Work").alias("category"),
        F.when(n % 5 == 0, F.date_format(at, "yyyy-MM-dd"))
        .otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("timestamp"),
        F.lit(None).cast("binary").alias("embedding"),
    )


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspace files of customers: settings, persona, profile, notes.

    One small file of customers makes many files of each row, so rows are dealt to all tasks first.
    """
    c = table(spark, sf_dir, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    k = F.col("c_custkey")
    t = k.cast("string")
    seg = F.lower("c_mktsegment")
    config = F.concat(
        F.lit('version = "1.'), t, F.lit('"\nopenai_api_key = "k'), t, F.lit('" # key\n\n[memory]\nbackend = "'),
        F.when(k % 4 == 0, "SQLite").when(k % 4 == 1, "markdown").when(k % 4 == 2, "none").otherwise("lucid"),
        F.lit('"\nvector_weight = 0.'), (k % 10).cast("string"), F.lit("\nauto_save = "),
        F.when(k % 2 == 0, "true").otherwise("false"),
        F.lit('\n[identity]\nformat = "'), F.when(k % 3 == 0, "AIEOS").otherwise("openclaw"),
        F.lit('"\naieos_path = "persona.json"\n[channels_config.'), seg,
        F.lit(']\nbot_token = "t'), t, F.lit('"\nmax_tokens = 5\n'),
    )
    persona = F.concat(
        F.lit('{"identity":{"names":{"first":"'), F.col("c_name"), F.lit('","nickname":"n'), t,
        F.lit('"},"psychology":{"neural_matrix":{"calm":0.'), (k % 10).cast("string"),
        F.lit(',"odd":"x"},"traits":{"mbti":"INTJ"}},"motivations":{"core_drive":"'), seg,
        F.lit('"},"history":{"born":'), t, F.lit("}}}"),
    )
    user = F.concat(
        F.lit("intro\n  # "), F.col("c_name"), F.lit(" \n\n## Notes\nx/y\n## Timezone\n- skip/this\nEurope/City"),
        F.col("c_nationkey").cast("string"), F.lit("\n"),
    )
    one = lambda path, text, cond=F.lit(True): F.when(
        cond, F.struct(F.lit(path).alias("path"), text.alias("content"))
    )
    files = [
        one("config.toml", config, k % 5 != 0),
        one("persona.json", persona, k % 6 == 0),
        one("SOUL.md", F.concat(F.lit("# Soul "), t, F.lit("\n\nbody")), k % 2 == 0),
        one("IDENTITY.md", F.concat(F.lit("text\n# Id "), t), k % 3 == 0),
        one("AGENTS.md", F.lit(" \n"), k % 7 == 0),
        one("USER.md", user, k % 4 != 0),
        one("MEMORY.md", F.lit("m"), k % 5 == 0),
        one("TOOLS.md", F.lit("t"), k % 8 == 0),
        one("memory.db", F.lit("x"), k % 8 == 4),
        one("memory/2026-01-15.md", F.lit("d"), k % 3 == 1),
        one("memory/2026-02-xx.md", F.lit("d"), k % 6 == 1),
        one("memory/project-a.md", F.lit("p"), k % 9 == 1),
        one("memory/active-context.md", F.lit("a"), k % 10 == 2),
        one(".alf-agent-id", F.concat(F.lit(" id"), t, F.lit("\n")), k % 11 == 0),
        one("notes.txt", F.lit("n")),
    ]
    return c.select(
        t.alias("agent_id"), F.concat(F.lit("/fleet/w"), t).alias("workspace"),
        F.explode(F.array_compact(F.array(*files))).alias("f"),
    ).select("agent_id", "workspace", "f.*").withColumn("data", F.col("content").cast("binary"))
