"""Grading queries; answers are made from orders, pages and documents, some right, some wrong, some only near."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grading as G
from ..registry import query, table


def items(df, kind, answer, canonical, choices=None, index=None):
    none = F.array().cast("array<string>")
    return df.withColumns({"eval_type": F.lit(kind), "answer": answer, "question": F.lit(""), "canonical": canonical, "aliases": none, "choices": none if choices is None else choices, "choice_index": F.lit(None).cast("int") if index is None else index})


def graded(df, key):
    return G.grade(df).select(key, "strict", "tolerant", "partial", "error_reason")


@query(
    "grade_date",
    "SELECT o_orderkey, o_orderkey % 3 <> 0 AS strict, o_orderkey % 3 <> 0 AS tolerant, CASE WHEN o_orderkey % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS partial, CASE WHEN o_orderkey % 3 <> 0 THEN 'ok' ELSE 'wrong_value' END AS error_reason FROM orders",
)
def _(s, d):
    o = table(s, d, "orders")
    said = F.concat(F.lit("It was on "), F.date_format("o_orderdate", "yyyy.M.d"), F.lit("!"))
    real = F.date_format(F.when(F.col("o_orderkey") % 3 == 0, F.date_add("o_orderdate", 40)).otherwise(F.col("o_orderdate").cast("date")), "yyyy-MM-dd")
    return graded(items(o, "date", said, real), "o_orderkey")


@query(
    "grade_number",
    "SELECT o_orderkey, o_orderkey % 4 <> 0 AS strict, o_orderkey % 4 <> 0 AS tolerant, CASE WHEN o_orderkey % 4 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS partial, CASE WHEN o_orderkey % 4 <> 0 THEN 'ok' WHEN o_orderkey % 8 = 0 THEN 'extraction_fail' ELSE 'wrong_value' END AS error_reason FROM orders",
)
def _(s, d):
    n = (F.col("o_custkey") + 1000).cast("string")
    k = F.col("o_orderkey")
    said = F.when(k % 8 == 0, "unknown").when(k % 4 == 0, "about -9").otherwise(F.concat(F.lit("There are "), n, F.lit(" of them")))
    return graded(items(table(s, d, "orders"), "number", said, n), "o_orderkey")


@query(
    "grade_url",
    "SELECT page_id, page_id % 2 = 0 AS strict, page_id % 2 = 0 AS tolerant, CASE WHEN page_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS partial, CASE WHEN page_id % 2 = 0 THEN 'ok' ELSE 'wrong_value' END AS error_reason FROM pages",
)
def _(s, d):
    p = table(s, d, "pages")
    plain = F.regexp_replace("url", r"[?#].*$", "")
    said = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("See "), F.upper(plain), F.lit("/ for more"))).otherwise("See http://elsewhere.test/x for more")
    return graded(items(p, "url", said, plain), "page_id")


@query(
    "grade_list_set",
    "WITH i AS (SELECT conv_id, list_distinct(list('topic' || CAST(turn % 4 AS VARCHAR))) AS want, list_distinct(list('topic' || CAST(turn % 3 AS VARCHAR))) AS got FROM conversations GROUP BY conv_id), h AS (SELECT *, len(list_intersect(want, got)) AS h FROM i) SELECT conv_id, h = len(want) AND len(got) = len(want) AS strict, h = len(want) AS tolerant, CASE WHEN h = len(want) AND len(got) = len(want) THEN 1.0::DOUBLE ELSE round(h / len(want)::DOUBLE, 4) END AS partial, CASE WHEN h = len(want) AND len(got) = len(want) THEN 'ok' WHEN h = len(want) THEN 'extra_explanation' WHEN h > 0 THEN 'partial_list' ELSE 'wrong_value' END AS error_reason FROM h",
)
def _(s, d):
    name = lambda n: F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("Topic "), (F.col("turn") % n).cast("string")))), ", ")
    c = table(s, d, "conversations").groupBy("conv_id").agg(name(4).alias("want"), name(3).alias("got"))
    return graded(items(c, "list_set", F.col("got"), F.col("want")), "conv_id")


@query(
    "grade_choice",
    "SELECT c_custkey, c_custkey % 5 < 3 AS strict, c_custkey % 5 < 3 AS tolerant FROM customer",
)
def _(s, d):
    k = F.col("c_custkey")
    choices = F.array(*[F.lit(f"{i}) {w}") for i, w in enumerate(("alpha", "beta", "gamma"), 1)])
    said = F.when(k % 5 == 0, "2").when(k % 5 == 1, "It is beta.").when(k % 5 == 2, "답: 2번").when(k % 5 == 3, "gamma").otherwise("alpha or beta")
    return graded(items(table(s, d, "customer"), "choice", said, F.lit("beta"), choices=choices, index=F.lit(2)), "c_custkey").select("c_custkey", "strict", "tolerant")


@query(
    "grade_basic",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' WHEN 2 THEN 'date' ELSE 'wrong' END AS verdict FROM orders",
)
def _(s, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(k % 4 == 0, F.concat(F.lit(" "), day)).when(k % 4 == 1, F.concat(F.lit("on "), day, F.lit(" then"))).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy.MM.dd.")).otherwise("never")
    return table(s, d, "orders").select("o_orderkey", G.grade_basic(said, day).alias("verdict"))


@query(
    "answer_mining",
    r"""WITH p AS (SELECT doc_id, lang, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\n+', '. ', 'g'), '[.!?。]\s*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents),
e AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS pos FROM p),
c AS (SELECT doc_id, CAST(pos AS INT) AS pos, round(len(list_intersect(['the', 'and', 'der', 'que', 'les'], list_distinct(list_transform(regexp_extract_all(s, '[0-9A-Za-z가-힣]{2,}'), lambda x: lower(x)))))::DOUBLE - length(s) * 0.002::DOUBLE + CASE WHEN regexp_matches(s, '[0-9]') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM e)
SELECT doc_id, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM c) WHERE rank <= 2""",
)
def _(s, d):
    rows = table(s, d, "documents").select("doc_id", F.col("text").alias("answer"), F.lit("the and der que les").alias("question"))
    return G.mine(G.sentence_scores(rows, "doc_id", "answer", "question", [("[0-9]", 0.5)]), "doc_id", 2).select("doc_id", "pos", "score")


@query(
    "best_candidate_grade",
    "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity > 25 DESC, l_discount DESC, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1",
)
def _(s, d):
    order = [(F.col("l_quantity") > 25).desc(), F.desc("l_discount"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return G.best_candidate(table(s, d, "lineitem"), "l_orderkey", order, "l_extendedprice").select("l_orderkey", "l_partkey", "l_linenumber")
