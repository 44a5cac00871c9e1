"""Retrieval queries: all benchmark texts as questions, all documents as chunks; vector i belongs to chunk i."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import retrieval as R
from ..registry import query, table

TERMS = "regexp_extract_all(lower(text), '[0-9a-z가-힣]+')"
BM25 = f"""p AS (SELECT t AS term, doc_id AS chunk_id, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS t FROM documents) GROUP BY ALL),
l AS (SELECT doc_id AS chunk_id, len({TERMS}) AS dl FROM documents), n AS (SELECT count(*) AS n, sum(dl) AS total FROM l),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), raw AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw, total / n::DOUBLE AS avgdl FROM df, n),
idf AS (SELECT term, df, avgdl, CASE WHEN raw < 0 THEN (SELECT sum(raw) / count(*) * 0.25::DOUBLE FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, t AS term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN p USING (term) JOIN l USING (chunk_id) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 10)"""
DISTANCE = "round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"
VEC = f"""vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {DISTANCE} AS distance FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 10)"""

chunks = lambda s, d: table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang")
questions = lambda s, d: table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
vectors = lambda s, d: table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
index = lambda s, d: R.Bm25(chunks(s, d), tokens(F.col("text")))
lexical = lambda s, d, k=10: index(s, d).top(questions(s, d), tokens(F.col("text")), k)


def nearest(s, d, k=10):
    v = vectors(s, d)
    asked = v.join(questions(s, d).select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), "embedding")
    return R.vector_top(v, asked, k)


def as_long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query("bm25_index_stats", f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM idf")
def _(s, d):
    return index(s, d).terms.select("term", "df", F.round("idf", 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


@query("bm25_topk", f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM lex WHERE rank <= 5")
def bm25_topk(s, d):
    return as_long(lexical(s, d, 5), "rank")


@query(
    "bm25_filtered",
    f"""WITH {BM25}, b AS (SELECT bm.query_id, chunk_id, source AS name, round(score + 1.5::DOUBLE * len(list_filter(t, lambda x: contains(source, x))) + len(list_filter(t, lambda x: contains(lang, x))), 4) AS score
 FROM bm JOIN documents ON doc_id = chunk_id JOIN (SELECT item_id AS query_id, {TERMS} AS t FROM benchmark) USING (query_id) WHERE lang = 'en')
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, chunk_id) AS rank FROM b WHERE score > 0) WHERE rank <= 15""",
)
def _(s, d):
    held = R.Bm25(chunks(s, d), tokens(F.col("text")), keep=["source", "lang"])
    found = held.filtered(questions(s, d), tokens(F.col("text")), 5, name="source", bonuses=[("source", 1.5), ("lang", 1.0)], keep=F.col("lang") == "en")
    return as_long(found.select("query_id", "chunk_id", "score", "rank"), "rank")


def _far(where=""):
    return f"SELECT query_id, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {DISTANCE} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 {where})) WHERE rank <= 10"


asked20 = lambda s, d: vectors(s, d).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


@query("vector_topk", _far())
def _(s, d):
    return as_long(R.vector_top(vectors(s, d), asked20(s, d), 10), "rank")


@query("vector_topk_filtered", _far("AND v.label = 3"))
def _(s, d):
    return as_long(R.vector_top(vectors(s, d), asked20(s, d), 10, keep=F.col("label") == 3), "rank")


@query("mmr")
def _(s, d):
    pool = R.vector_top(vectors(s, d), asked20(s, d), 20).drop("rank").join(vectors(s, d).select("chunk_id", "embedding"), "chunk_id")
    return R.mmr(pool, 5)


@query(
    "hybrid_alpha",
    f"""WITH {BM25}, {VEC}, nn AS (SELECT query_id, chunk_id, score / (max(score) OVER (PARTITION BY query_id) + 1e-10) AS norm FROM lex),
f AS (SELECT query_id, chunk_id, round(coalesce((1 - distance) * 0.5::DOUBLE, 0) + coalesce(norm * 0.5::DOUBLE, 0), 6) AS score FROM vec FULL JOIN nn USING (query_id, chunk_id))
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 5""",
)
def _(s, d):
    return as_long(R.hybrid(nearest(s, d), lexical(s, d), 5), "rank")


FUSED = "SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 9) AS fusion_score FROM (SELECT query_id, chunk_id, rank, 0.7::DOUBLE AS w FROM vec UNION ALL SELECT query_id, chunk_id, rank, 0.3::DOUBLE FROM lex) GROUP BY ALL"


@query("rrf_fusion", f"WITH {BM25}, {VEC} {FUSED}")
def _(s, d):
    return R.rrf([(nearest(s, d), 0.7), (lexical(s, d), 0.3)])


@query(
    "weight_sweep",
    f"""WITH {BM25}, {VEC}, g(vector_weight, lexical_weight) AS (VALUES (0.7::DOUBLE, 0.3::DOUBLE), (0.5::DOUBLE, 0.5::DOUBLE), (0.3::DOUBLE, 0.7::DOUBLE)),
f AS (SELECT vector_weight, lexical_weight, query_id, chunk_id, round(sum(w / (60 + rank)), 9) AS fusion_score FROM (SELECT *, vector_weight AS w FROM (SELECT query_id, chunk_id, rank FROM vec), g UNION ALL SELECT *, lexical_weight FROM (SELECT query_id, chunk_id, rank FROM lex), g) GROUP BY ALL)
SELECT *  FROM (SELECT *, row_number() OVER (PARTITION BY vector_weight, lexical_weight, query_id ORDER BY fusion_score DESC, chunk_id) AS rank FROM f) WHERE rank <= 5""",
)
def _(s, d):
    return as_long(R.weight_sweep(nearest(s, d), lexical(s, d), [(0.7, 0.3), (0.5, 0.5), (0.3, 0.7)], 5), "rank")


@query(
    "variant_merge",
    f"""WITH {BM25}, v AS (SELECT query_id, chunk_id, rank, 1.0::DOUBLE AS w FROM lex UNION ALL SELECT query_id + 1, chunk_id, rank, 0.35::DOUBLE FROM lex)
SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 9) AS fusion_score FROM v GROUP BY ALL""",
)
def _(s, d):
    found = lexical(s, d)
    return R.rrf([(found, 1.0), (found.withColumn("query_id", F.col("query_id") + 1), 0.35)])


@query(
    "filtered_rank",
    f"""WITH {BM25}, a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank, 'limit first' AS mode FROM lex JOIN documents ON doc_id = chunk_id WHERE rank <= 5 AND lang = 'en'),
b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank, 'filter first' AS mode FROM lex JOIN documents ON doc_id = chunk_id WHERE lang = 'en')
SELECT * FROM a UNION ALL SELECT * FROM b WHERE new_rank <= 5""",
)
def _(s, d):
    rows = lexical(s, d).join(chunks(s, d).select("chunk_id", "lang"), "chunk_id")
    keep = F.col("lang") == "en"
    parts = [R.filtered_rank(rows, keep, 5, first).select("query_id", "chunk_id", F.col("new_rank").cast("long"), F.lit(m).alias("mode")) for first, m in ((False, "limit first"), (True, "filter first"))]
    return parts[0].unionByName(parts[1])


@query(
    "context_text",
    f"WITH {BM25} SELECT query_id, md5(string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM lex JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY query_id",
)
def context(s, d):
    rows = lexical(s, d, 5).join(chunks(s, d).select("chunk_id", "text"), "chunk_id")
    return R.context_text(rows, F.col("text")).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("citations", f"WITH {VEC} SELECT query_id, rank, chunk_id, round(greatest(0, 1 - distance), 4) AS score, left(text, 500) AS quote FROM vec JOIN documents ON doc_id = chunk_id WHERE rank <= 5")
def _(s, d):
    rows = nearest(s, d, 5).join(chunks(s, d).select("chunk_id", "text"), "chunk_id")
    return as_long(R.citations(rows, F.col("text")), "rank")


@query(
    "chat_history",
    "SELECT conv_id, md5(string_agg(role || ': ' || left(text, 300), chr(10) ORDER BY turn)) AS digest, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6 GROUP BY conv_id",
)
def _(s, d):
    last = R.top(table(s, d, "conversations"), 6, F.desc("turn"), by=("conv_id",), name="rn")
    line = F.concat_ws(": ", "role", F.substring("text", 1, 300))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")
    return last.groupBy("conv_id").agg(F.md5(joined.cast("binary")).alias("digest"), F.count(F.lit(1)).alias("n"))


@query(
    "context_budget",
    """SELECT conv_id, turn, left(text, CAST(4000 - used AS INT)) AS part FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations) WHERE used < 4000""",
)
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    return table(s, d, "conversations").withColumn("used", used).where("used < 4000").select("conv_id", "turn", F.substring("text", F.lit(1), (4000 - F.col("used")).cast("int")).alias("part"))
