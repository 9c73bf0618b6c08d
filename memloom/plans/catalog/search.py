"""Hybrid and diverse search of memory chunks."""

from pyspark.sql import functions as F

from memloom.operators import search
from memloom.plans import views as v
from memloom.plans.catalog import query

_FROM, _TO = (t.replace("'", "''") for t in search.FOLD)
_WORDS = f"[w FOR w IN string_split(translate(coalesce(text, ''), '{_FROM}', '{_TO}'), ' ') IF w <> '']"
_COSINE = ("list_inner_product(CAST(c.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) / "
           "(sqrt(list_inner_product(CAST(c.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[]))) * "
           "sqrt(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))))")
_HYBRID = f"""
WITH RECURSIVE chunks AS (SELECT doc_id AS chunk_id, {_WORDS} AS w, embedding AS vector FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
questions AS (SELECT item_id AS question_id, {_WORDS} AS w, embedding AS vector FROM benchmark LEFT JOIN embeddings ON item_id = vec_id),
asked AS (SELECT DISTINCT question_id, unnest(w) AS term FROM questions),
sizes AS (SELECT count(*) AS total, sum(len(w)) / count(*) AS mean FROM chunks),
held AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM chunks) GROUP BY ALL),
weights AS (SELECT term, greatest(ln((total :: DOUBLE - df + 0.5) / (df + 0.5)), 1e-6) AS idf
  FROM (SELECT term, count(*) AS df FROM held GROUP BY 1), sizes),
words AS (SELECT question_id, chunk_id, sum(CAST(round(idf * tf * 2.2 :: DOUBLE / (tf + 1.2 :: DOUBLE * (0.25 :: DOUBLE + 0.75 :: DOUBLE * length / mean)) * 1e6 :: DOUBLE) AS BIGINT)) AS millionths
  FROM held JOIN weights USING (term) JOIN asked USING (term), sizes GROUP BY 1, 2),
by_word AS (SELECT question_id, chunk_id, text_rank FROM
  (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY millionths DESC, chunk_id) - 1 AS text_rank FROM words) WHERE text_rank < 24),
near AS (SELECT question_id, chunk_id, round({_COSINE}, 8) AS vector_score FROM chunks c, questions q
  WHERE c.vector IS NOT NULL AND q.vector IS NOT NULL),
by_vector AS (SELECT question_id, chunk_id, vector_score FROM
  (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY vector_score DESC, chunk_id) AS n FROM near) WHERE n <= 24),
fused AS (SELECT question_id, chunk_id, vector_score, text_rank,
  round(0.7 :: DOUBLE * coalesce(vector_score, 0) + 0.3 :: DOUBLE * CASE WHEN text_rank IS NULL THEN 0 ELSE 1 :: DOUBLE / (1 + greatest(0, text_rank)) END, 10) AS score
  FROM by_word FULL JOIN by_vector USING (question_id, chunk_id))
"""


def _chunks(spark, sf_dir):
    """Documents as chunks in files, with the vector of the same number."""
    vectors = v.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("vector"))
    docs = v.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", v.note_path(F.col("doc_id")).alias("path"))
    asked = v.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return (docs.join(vectors, docs["chunk_id"] == vectors["n"], "left").drop("n"),
            asked.join(vectors, asked["question_id"] == vectors["n"], "left").drop("n"))


@query(_HYBRID + """SELECT question_id, CAST(rank AS INTEGER) AS rank, chunk_id, score, vector_score, CAST(text_rank AS INTEGER) AS text_rank FROM
  (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= 6""")
def hybrid_search(spark, sf_dir):
    """Keyword and vector candidates of every question, fused."""
    return search.hybrid_search(*_chunks(spark, sf_dir)).select(
        "question_id", "rank", "chunk_id", "score", "vector_score", "text_rank")


_AS_OF = "2026-12-01 00:00:00"


@query(_HYBRID + f""",
days AS (SELECT *, CASE WHEN chunk_id % 9 > 5 THEN try_cast('2026-' || lpad(CAST(chunk_id % 14 AS VARCHAR), 2, '0') || '-' ||
  lpad(CAST(chunk_id % 33 AS VARCHAR), 2, '0') AS DATE) END AS day FROM fused),
aged AS (SELECT question_id, chunk_id, round(CASE WHEN day IS NULL THEN score
  ELSE score * exp(-ln(2 :: DOUBLE) / 30 * greatest(0, date_diff('day', day, DATE '2026-12-01'))) END, 10) AS score FROM days),
sets AS (SELECT question_id, chunk_id, list_distinct(w) AS w FROM aged JOIN chunks USING (chunk_id)),
alike AS (SELECT a.question_id, a.chunk_id AS a, b.chunk_id AS b, coalesce(len(list_intersect(a.w, b.w)) /
  nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0), 0) AS jaccard FROM sets a JOIN sets b USING (question_id)),
picked AS (
  SELECT question_id, 0 AS rank, [] :: BIGINT[] AS taken, NULL :: BIGINT AS chunk_id, NULL :: DOUBLE AS score, NULL :: DOUBLE AS mmr
  FROM (SELECT DISTINCT question_id FROM aged)
  UNION ALL
  SELECT question_id, rank + 1, list_append(taken, chunk_id), chunk_id, score, mmr FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY mmr DESC, chunk_id) AS n FROM (
      SELECT p.question_id, p.rank, p.taken, c.chunk_id, c.score,
        round(0.7 :: DOUBLE * c.score - 0.3 :: DOUBLE * coalesce(max(s.jaccard), 0), 12) AS mmr
      FROM picked p JOIN aged c ON c.question_id = p.question_id AND NOT list_contains(p.taken, c.chunk_id)
      LEFT JOIN alike s ON s.question_id = p.question_id AND s.a = c.chunk_id AND list_contains(p.taken, s.b)
      WHERE p.rank < 6 GROUP BY p.question_id, p.rank, p.taken, c.chunk_id, c.score)) WHERE n = 1)
SELECT question_id, rank, chunk_id, score, mmr FROM picked WHERE rank > 0""")
def diverse_search(spark, sf_dir):
    """The same candidates, older daily notes faded, chosen one by one for novelty."""
    return search.diverse_search(*_chunks(spark, sf_dir), v.ts(_AS_OF))
