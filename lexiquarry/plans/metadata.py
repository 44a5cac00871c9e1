"""Metadata queries: agency is the source of a document, format its language."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sources as S
from ..operators import evaluation as E
from ..operators import metadata as M
from ..registry import query, table

docs = lambda s, d: table(s, d, "documents")


@query("dataset_summary", "SELECT count(*) AS n_documents, count(DISTINCT source) AS n_agencies FROM documents")
def _(s, d):
    return M.dataset_summary(docs(s, d), "source")


@query("format_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(s, d):
    return M.format_counts(docs(s, d), "lang")


@query("list_sources", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def _(s, d):
    return M.distinct_values(docs(s, d), "source")


@query(
    "query_documents",
    "SELECT doc_id, source, lang, n_chars FROM documents WHERE lang = 'en' AND (text ILIKE '%tion%' OR source ILIKE '%tion%') ORDER BY n_chars DESC, doc_id LIMIT 25",
)
def _(s, d):
    found = M.query_documents(docs(s, d), [F.desc("n_chars"), F.asc("doc_id")], equal={"lang": "en"}, keyword="tion", fields=("text", "source"), limit=25)
    return found.select("doc_id", "source", "lang", "n_chars")


@query("document_lookup", "SELECT url, page_id, length(html) AS n_html FROM pages WHERE url = (SELECT min(url) FROM pages)")
def _(s, d):
    pages = table(s, d, "pages")
    return pages.join(pages.agg(F.min("url").alias("url")), "url").select("url", "page_id", F.length("html").alias("n_html"))


@query("linked_documents", "SELECT doc_id, source FROM documents WHERE source IS NOT NULL AND source <> ''")
def _(s, d):
    return M.linked(docs(s, d), "source").select("doc_id", "source")


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / greatest(count(*), 1), 2)::DOUBLE AS missing_pct, count(DISTINCT {c}) AS n_unique FROM documents"
        for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
    ),
)
def _(s, d):
    return M.column_profile(docs(s, d).select("doc_id", "text", "lang", "source", "n_chars"))


@query("metadata_join", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    rows = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return M.metadata_join(rows, table(s, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"]).withColumnRenamed("c_custkey", "o_custkey")


@query("upsert_latest", "SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 0 AS quality, toxic FROM labels WHERE toxic = 0")
def _(s, d):
    labels = table(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return M.upsert(labels, labels.where("toxic = 0").withColumn("quality", F.lit(0)), "doc_id")


@query("augment_collection", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    base = table(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return M.augment(base, docs(s, d).select("doc_id", F.lit(-1).alias("quality")), "doc_id")


@query("id_list_filter", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(s, d):
    return M.keep_ids(docs(s, d).select("doc_id", "n_chars"), table(s, d, "labels").where("quality = 0"), "doc_id")


@query("indexed_count", "SELECT count(DISTINCT vec_id) AS n_indexed FROM embeddings")
def _(s, d):
    return table(s, d, "embeddings").agg(F.count_distinct("vec_id").alias("n_indexed"))


@query(
    "index_lifecycle",
    """WITH e AS (SELECT vec_id, label, embedding FROM embeddings), u AS (SELECT vec_id, 'second' AS text, CAST(label AS VARCHAR) AS label, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS total FROM e WHERE vec_id % 3 > 0
 UNION ALL SELECT vec_id, 'first', CAST(label AS VARCHAR), 0.0::DOUBLE FROM e WHERE vec_id % 3 = 0 UNION ALL SELECT doc_id + 1000000, 'added', lang, 0.0::DOUBLE FROM documents WHERE lang <> 'en')
SELECT CAST(vec_id AS VARCHAR) AS chunk_id, text, label, round(total, 4) AS total, (SELECT count(*) FROM u WHERE vec_id % 7 > 0) AS n FROM u WHERE vec_id % 7 > 0""",
)
def _(s, d):
    """An index that is filled without vectors, updated with them, added to, cut and counted. It stays in the shared folder for
    the reader of the result."""
    E.ensure_checkpoint_dir(s)
    e = table(s, d, "embeddings")
    index = S.VectorIndex(s, f"{s.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}", dim=64)
    label = lambda c: F.create_map(F.lit("label"), c.cast("string")).alias("metadata")
    index.upsert(e.select(F.col("vec_id").alias("chunk_id"), F.lit("first").alias("text"), label(F.col("label"))))
    index.upsert(e.where("vec_id % 3 > 0").select(F.col("vec_id").alias("chunk_id"), F.lit("second").alias("text"), label(F.col("label")), "embedding"))
    index.upsert(table(s, d, "documents").where("lang <> 'en'").select((F.col("doc_id") + 1000000).alias("chunk_id"), F.lit("added").alias("text"), label(F.col("lang"))))
    index.delete(index.ids().where("chunk_id % 7 = 0"))
    index.vacuum()
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4)
    return index.read().select("chunk_id", "text", F.col("metadata")["label"].alias("label"), total.alias("total"), F.lit(index.count()).cast("long").alias("n"))


@query("preprocess_counts", "SELECT CASE WHEN doc_id % 4 = 3 THEN 'failed' WHEN regexp_matches(coalesce(text, ''), '[^ \t\n\r\f\v]') AND NOT contains(text, '|') THEN 'ok' ELSE 'failed' END AS status, ['hwp', 'pdf', 'docx', 'none'][doc_id % 4 + 1] AS format, count(*) AS n FROM documents GROUP BY ALL")
def _(s, d):
    """Documents as files of four kinds, one without a parser; a parser that fails at a bar. What was written is read again."""
    E.ensure_checkpoint_dir(s)

    def parse(name: str, data: bytes) -> str:
        if b"|" in data:
            raise ValueError("a bar")
        return data.decode()

    suffix = F.element_at(F.array(*[F.lit(x) for x in ("hwp", "pdf", "docx", "txt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    files = table(s, d, "documents").select(F.concat_ws(".", F.col("doc_id").cast("string"), suffix).alias("path"), F.col("text").cast("binary").alias("content"))
    at = f"{s.sparkContext.getCheckpointDir()}/parsed-{uuid.uuid4().hex}"
    counts = S.write_preprocessed(S.parse_each(files, parse).drop("content"), at)
    read = s.read.json(at)
    if sum(counts.values()) != read.count():
        raise ValueError(f"counted {counts}, but other rows were written")
    return read.groupBy("status", "format").agg(F.count(F.lit(1)).alias("n"))
