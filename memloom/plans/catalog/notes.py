"""T1-T15."""

from pyspark.sql import functions as F

from memloom.functions import notes as N
from memloom.operators import memories
from memloom.operators.sections import split_sections
from memloom.plans import views as v
from memloom.plans.catalog import query, sql_uuid5

# SQL twins of the file view
PATH = """CASE doc_id % 9 WHEN 0 THEN 'MEMORY.md' WHEN 1 THEN 'memory/Active-Context.md' WHEN 2 THEN 'memory/project-gating-policies.md'
 WHEN 3 THEN 'memory/gating_policies.md' WHEN 4 THEN 'memory/archive/2026-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') || '.md'
 WHEN 5 THEN 'memory/session_' || doc_id || '.md'
 ELSE 'memory/2026-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 33 AS VARCHAR), 2, '0') || '.md' END"""
DAY = f"try_cast(regexp_extract({PATH}, '^memory/([0-9-]+)\\.md$', 1) AS DATE)"
BODY = r"""replace(replace(replace(regexp_replace(text, '(?m)^([A-E])', '## \1', 'g'), ' on ', ' #On! '), ' la ', ' ##La-x, '),
 '.' || chr(10), '. [n' || doc_id % 3 || '|i=0.' || doc_id % 10 || ']' || chr(10))"""
WHITE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _blank(c):
    return f"(NOT regexp_matches({c}, '[^{WHITE[1:-1]}]'))"



FILES = f"""f AS (SELECT doc_id, {PATH} AS path, {BODY} AS body, {DAY} AS day FROM documents)"""
SECTIONS = FILES + rf""",
l AS (SELECT doc_id, path, day, unnest(string_split(regexp_replace(body, '\n\z', ''), chr(10))) AS line,
  generate_subscripts(string_split(regexp_replace(body, '\n\z', ''), chr(10)), 1) AS n FROM f WHERE NOT contains(lower(path), 'active-context')),
g AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM l),
b AS (SELECT doc_id, path, day, s, string_agg(line, chr(10) ORDER BY n) AS content, min(n) AS line_start, max(n) AS line_end,
  arg_min(line, n) AS head FROM g GROUP BY ALL),
sec AS (SELECT doc_id, path, day, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS section_index,
  CASE WHEN starts_with(head, '## ') THEN regexp_replace(regexp_replace(head, '^(## )+', ''), '^{WHITE}+|{WHITE}+$', '', 'g') ELSE '' END AS heading,
  content, line_start, line_end FROM b WHERE NOT {_blank('content')}
  UNION ALL SELECT doc_id, path, day, 0, '', body, 1, greatest(1, len(string_split(regexp_replace(body, '\n\z', ''), chr(10)))) FROM f
  WHERE contains(lower(path), 'active-context') AND NOT {_blank('body')})"""


@query(f"WITH {SECTIONS} SELECT 'd' || doc_id AS agent_id, section_index, heading, md5(content) AS content_md5, line_start, line_end FROM sec")
def md_sections(spark, sf_dir):
    """Sections of note files with their lines."""
    found = split_sections(v.note_files(spark, sf_dir))
    return found.select(
        "agent_id", "section_index", F.coalesce("heading", F.lit("")).alias("heading"),
        F.md5("content").alias("content_md5"), "line_start", "line_end")


_TYPE = """CASE WHEN day IS NOT NULL THEN 'episodic' WHEN lower(path) = 'memory.md' THEN 'semantic' WHEN contains(lower(path), 'active-context') THEN 'summary'
 WHEN contains(lower(path), 'gating-policies') OR contains(lower(path), 'gating_policies') THEN 'procedural' ELSE 'semantic' END"""
_SPACE = """CASE WHEN day IS NOT NULL THEN 'daily' WHEN lower(path) = 'memory.md' THEN 'curated' WHEN contains(lower(path), 'active-context') THEN 'active-context'
 WHEN starts_with(lower(path), 'memory/project-') THEN 'project' WHEN contains(lower(path), 'gating-policies') OR contains(lower(path), 'gating_policies') THEN 'procedural'
 ELSE 'workspace' END"""
_METHOD = "CASE WHEN lower(path) = 'memory.md' OR contains(lower(path), 'gating-policies') THEN 'user_authored' ELSE 'agent_written' END"


@query(f"""WITH {FILES}, z AS (SELECT *, regexp_replace(regexp_replace(path, '^(memory/)+', ''), '^(archive/)+', '') AS name FROM f)
SELECT doc_id, {_TYPE} AS memory_type, {_SPACE} AS namespace, {_METHOD} AS method, coalesce(strftime(day, '%Y-%m-%d'), '') AS day,
  CASE WHEN regexp_full_match(name, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\.md') OR starts_with(name, 'session_') THEN 'episodic' ELSE 'semantic' END AS z_type,
  CASE WHEN regexp_full_match(name, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\.md') THEN 'daily' WHEN starts_with(name, 'session_') THEN 'session' ELSE 'memory' END AS z_namespace,
  CASE WHEN contains(path, 'archive/') THEN 'archived' ELSE 'active' END AS z_status,
  coalesce(strftime(try_cast(regexp_extract(name, '^([0-9-]{{10}})\\.md$', 1) AS DATE), '%Y-%m-%d'), '') AS z_day FROM z""")
def path_classes(spark, sf_dir):
    """Classes of note files by path."""
    p = v.note_path(F.col("doc_id"))
    z = F.col("z")
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    return v.table(spark, sf_dir, "documents").select(
        "doc_id", N.memory_type(p).alias("memory_type"), N.namespace(p).alias("namespace"),
        N.extraction_method(p).alias("method"), day(N.daily_date(p)).alias("day"), N.archive_file_class(p).alias("z"),
    ).select("doc_id", "memory_type", "namespace", "method", "day", z["memory_type"].alias("z_type"),
             z["namespace"].alias("z_namespace"), z["status"].alias("z_status"), day(z["observed_on"]).alias("z_day"))


_LINE = "'[' || event_type || event_id % 3 || '|i=' || CASE WHEN event_id % 7 = 0 THEN '1.2.3' ELSE '0.' || event_id % 10 END || '] at #' || event_type || '! and [x|i=9] ##tag-' || event_id % 5 || ', # end'"


@query(f"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE regexp_extract({_LINE}, '\\[(\\w+)\\|i=([0-9.]+)\\]', 1) END AS tag,
  CASE WHEN event_id % 7 = 0 THEN -1 ELSE CAST(regexp_extract({_LINE}, '\\[(\\w+)\\|i=([0-9.]+)\\]', 2) AS DOUBLE) END AS score FROM events""")
def importance_tags(spark, sf_dir):
    """First importance tag of a line."""
    tag = N.importance_tag(_line())
    return v.table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(tag["tag"], F.lit("")).alias("tag"), F.coalesce(tag["score"], F.lit(-1.0)).alias("score"))


def _line():
    n, kind = F.col("event_id"), F.col("event_type")
    t = lambda c: c.cast("string")
    return F.concat(
        F.lit("["), kind, t(n % 3), F.lit("|i="), F.when(n % 7 == 0, "1.2.3").otherwise(F.concat(F.lit("0."), t(n % 10))),
        F.lit("] at #"), kind, F.lit("! and [x|i=9] ##tag-"), t(n % 5), F.lit(", # end"))


def _words(key, n, line, src):
    """CTEs w, h, t: the hashtags ``t(key, n, i, tag)`` of the lines of ``src``."""
    split = f"regexp_split_to_array({line}, '{WHITE}+')"
    return rf"""w AS (SELECT {key}, {n} AS n, unnest({split}) AS word, generate_subscripts({split}, 1) AS i FROM {src}),
h AS (SELECT {key}, n, i, regexp_replace(regexp_replace(word, '^#+', ''), '[^\p{{L}}\p{{N}}\p{{M}}]+$', '') AS tag
  FROM w WHERE starts_with(word, '#')),
t AS (SELECT * FROM h WHERE tag <> '')"""


@query(f"""WITH e AS (SELECT event_id, {_LINE} AS line FROM events), {_words(key='event_id', n='0', line='line', src='e')}
SELECT event_id, string_agg(tag, ',' ORDER BY i) AS tags FROM t GROUP BY 1""")
def hashtags(spark, sf_dir):
    """Hashtags of a line in order."""
    return v.table(spark, sf_dir, "events").select("event_id", F.array_join(N.hashtags(_line()), ",").alias("tags"))


TAGS = SECTIONS + rf""",
sl AS (SELECT doc_id, section_index, {_SPACE} AS space, unnest(string_split(content, chr(10))) AS line,
  generate_subscripts(string_split(content, chr(10)), 1) AS n FROM sec),
imp AS (SELECT doc_id, section_index, n, regexp_extract(line, '\[(\w+)\|i=([0-9.]+)\]', 1) AS tag,
  try_cast(regexp_extract(line, '\[(\w+)\|i=([0-9.]+)\]', 2) AS DOUBLE) AS score FROM sl WHERE regexp_matches(line, '\[(\w+)\|i=([0-9.]+)\]')),
{_words(key='doc_id, section_index', n='n', line='line', src='sl')},
u AS (SELECT doc_id, section_index, tag, n, 0 AS i FROM imp UNION ALL SELECT doc_id, section_index, tag, n, i FROM t
  UNION ALL SELECT DISTINCT doc_id, section_index, space, 0, 0 FROM sl),
d AS (SELECT doc_id, section_index, tag, min(n * 1000000 + i) AS o FROM u GROUP BY ALL),
tg AS (SELECT doc_id, section_index, string_agg(tag, '|' ORDER BY o) AS tags FROM d GROUP BY ALL),
sc AS (SELECT doc_id, section_index, max(score) AS confidence, arg_min(tag, n) AS category FROM imp WHERE score IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {TAGS} SELECT 'd' || doc_id AS agent_id, section_index, tags, coalesce(confidence, -1) AS confidence, coalesce(category, '') AS category
FROM tg LEFT JOIN sc USING (doc_id, section_index)""")
def section_tags(spark, sf_dir):
    """Tags, confidence and category of every section."""
    parts = split_sections(v.note_files(spark, sf_dir)).withColumn(
        "t", N.section_tags(F.col("content"), N.namespace(F.col("path"))))
    return parts.select(
        "agent_id", "section_index", F.array_join("t.tags", "|").alias("tags"),
        F.coalesce("t.confidence", F.lit(-1.0)).alias("confidence"), F.coalesce("t.category", F.lit("")).alias("category"))


@query(f"""WITH {SECTIONS}
SELECT 'd' || doc_id AS agent_id, {sql_uuid5(b'openclaw-alf-ns1', "path || ':' || section_index")} AS id, md5(content) AS content_md5,
  {_TYPE} AS memory_type, {_SPACE} AS namespace, {_METHOD} AS method, path AS origin_file,
  CAST(coalesce(epoch(CAST(day AS TIMESTAMP)), doc_id + 1767225600) AS BIGINT) AS created_s, doc_id + 1767225600 AS updated_s,
  CAST(coalesce(epoch(CAST(day AS TIMESTAMP)), -1) AS BIGINT) AS observed_s, line_start, line_end, heading FROM sec""")
def note_records(spark, sf_dir):
    """Records of note files."""
    recs = memories.openclaw_records(v.note_files(spark, sf_dir))
    raw = lambda key, typ: F.get_json_object("raw_source_format", f"$.{key}").cast(typ)
    sec = lambda c: F.unix_seconds(F.col(f"temporal.{c}"))
    return recs.select(
        "agent_id", "id", F.md5("content").alias("content_md5"), "memory_type", "namespace",
        F.col("source.extraction_method").alias("method"), F.col("source.origin_file").alias("origin_file"),
        sec("created_at").alias("created_s"), sec("updated_at").alias("updated_s"),
        F.coalesce(sec("observed_at"), F.lit(-1)).alias("observed_s"), raw("line_start", "bigint").alias("line_start"),
        raw("line_end", "bigint").alias("line_end"), F.coalesce(raw("heading", "string"), F.lit("")).alias("heading"))


_ALL = SECTIONS.replace("WHERE NOT contains(lower(path), 'active-context'))", "WHERE true)").split("\n  UNION ALL SELECT doc_id, path, day, 0")[0] + ")"


@query(f"""WITH {_ALL}, z AS (SELECT *, regexp_replace(regexp_replace(path, '^(memory/)+', ''), '^(archive/)+', '') AS name FROM sec),
y AS (SELECT *, CASE WHEN regexp_full_match(name, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\.md') THEN 'daily' WHEN starts_with(name, 'session_') THEN 'session' ELSE 'memory' END AS space,
  try_cast(regexp_extract(name, '^([0-9-]{{10}})\\.md$', 1) AS DATE) AS zday FROM z)
SELECT 'd' || doc_id AS agent_id, {sql_uuid5(b'zeroclaw-alf-ns1', "path || ':' || section_index")} AS id, md5(content) AS content_md5, space AS namespace, space AS category,
  CASE WHEN contains(path, 'archive/') THEN space || ',zeroclaw,archived' ELSE space || ',zeroclaw' END AS tags,
  CAST(coalesce(epoch(CAST(zday AS TIMESTAMP)), doc_id + 1767225600) AS BIGINT) AS created_s FROM y""")
def archive_note_records(spark, sf_dir):
    """Records of dated, session, archived and other notes."""
    recs = memories.zeroclaw_note_records(v.note_files(spark, sf_dir))
    return recs.select(
        "agent_id", "id", F.md5("content").alias("content_md5"), "namespace", "category",
        F.array_join("tags", ",").alias("tags"), F.unix_seconds(F.col("temporal.created_at")).alias("created_s"))


_KEY = "conv_id * 1000 + turn"
_CATEGORY = "CASE WHEN role = 'user' THEN 'Conversation' WHEN role = 'assistant' THEN 'core' WHEN turn = 0 THEN 'custom:Rules' ELSE 'Work' END"


@query(f"""WITH m AS (SELECT *, {_KEY} AS n, {_CATEGORY} AS category, 'c' || conv_id || '-' || turn AS native FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS agent_id, CASE WHEN turn % 2 = 0 THEN {sql_uuid5(b'openclaw-alf-ns1', 'native')}
   ELSE {sql_uuid5(b'zeroclaw-alf-ns1', "conv_id || ':' || native")} END AS id,
  CASE WHEN role = 'user' THEN 'episodic' ELSE 'semantic' END AS memory_type,
  CASE WHEN role = 'user' THEN 'conversation' WHEN role = 'assistant' THEN 'core' WHEN turn = 0 THEN 'custom:rules' ELSE 'custom:work' END AS namespace,
  category || ',zeroclaw' || CASE WHEN role = 'assistant' THEN ',auto_save' ELSE '' END AS tags,
  CASE WHEN n % 5 = 0 THEN 946684800 ELSE n + 1767225600 END AS created_s,
  CASE WHEN role = 'assistant' THEN 'assistant_autosave_' || turn ELSE 'note' END AS raw_key, md5(text) AS content_md5 FROM m""")
def table_records(spark, sf_dir):
    """Records of memory table rows."""
    from memloom.sources.workspaces import memory_table

    recs = memories.zeroclaw_table_records(memory_table(spark, v.memory_rows(spark, sf_dir)), v.ts(v.AS_OF))
    return recs.select(
        "agent_id", "id", "memory_type", "namespace", F.array_join("tags", ",").alias("tags"),
        F.unix_seconds(F.col("temporal.created_at")).alias("created_s"),
        F.get_json_object("raw_source_format", "$.key").alias("raw_key"), F.md5("content").alias("content_md5"))


@query("""WITH p AS (SELECT vec_id, embedding, CASE vec_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'none' WHEN 2 THEN 'cohere' ELSE 'openai' END AS provider
  FROM embeddings WHERE vec_id % 4 <> 1 AND vec_id % 4 <> 3)
SELECT vec_id, CASE provider WHEN 'openai' THEN 'openai/text-embedding-3-small' ELSE provider END AS model, len(embedding) AS dimensions,
  unnest(generate_series(0, len(embedding) - 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS value FROM p""")
def embedding_decode(spark, sf_dir):
    """Packed vectors decoded; providers without vectors and odd sizes give none."""
    n = F.col("vec_id")
    packed = _pack()(F.col("embedding"))
    rows = v.table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(n % 4 == 1, "none").when(n % 4 == 2, "cohere").otherwise("openai").alias("provider"),
        F.when(n % 4 == 3, F.substring(packed, 1, 9)).otherwise(packed).alias("blob"))
    found = memories.decode_embeddings(rows, "blob", F.col("provider"), v.ts(v.AS_OF), "e")
    one = found.select("vec_id", F.explode("e").alias("e"))
    return one.select("vec_id", F.col("e.model").alias("model"), F.col("e.dimensions").alias("dimensions"),
                      F.posexplode("e.vector").alias("i", "value"))


def _pack():
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.asarray(x, dtype="<f4").tobytes())

    return F.pandas_udf(pack, T.BinaryType())
