"""Table-evidence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import cell_values, char_ngrams, tokens
from ..operators import evidence as V
from ..registry import query, table

GRAMS = "(SELECT {k} AS k, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, CAST(i AS INT), 3))) AS g FROM (SELECT {k}, regexp_replace(lower(text), '[^0-9a-z가-힣._-]', '', 'g') AS s FROM {t}) WHERE s <> '')"


@query(
    "ngram_best_match",
    f"""WITH b AS {GRAMS.format(k='item_id', t='benchmark')}, x AS (SELECT a.k AS a, c.k AS b, len(list_intersect(a.g, c.g)) / (len(a.g) + len(c.g) - len(list_intersect(a.g, c.g)))::DOUBLE AS j FROM b a JOIN b c ON a.k <> c.k)
SELECT a, b, round(j, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS rn FROM x WHERE j > 0) WHERE rn = 1""",
)
def _(s, d):
    g = table(s, d, "benchmark").select(F.col("item_id").alias("k"), char_ngrams(F.col("text")).alias("g"))
    return V.best_match(g, g, skip_same=True)


@query(
    "neighbor_pages",
    "WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rn FROM conversations), n AS (SELECT DISTINCT conv_id, unnest(range(turn - 1, turn + 2)) AS page FROM p WHERE rn <= 2) SELECT conv_id, page FROM n WHERE page >= 0",
)
def _(s, d):
    return V.neighbors(table(s, d, "conversations"), "conv_id", "turn", [F.length("text").desc(), F.asc("turn")], 2, 1).withColumnRenamed("turn", "page")


@query(
    "cells_explode",
    r"""WITH r AS (SELECT page_id, unnest(x) AS r, generate_subscripts(x, 1) - 1 AS row_id FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS x FROM pages)), c AS (SELECT page_id, row_id, unnest(c) AS cell, generate_subscripts(c, 1) - 1 AS col_id FROM (SELECT page_id, row_id, string_split(regexp_replace(r, '<[^>]+>', '|', 'g'), '|') AS c FROM r))
SELECT page_id, CAST(row_id AS INT) AS row_id, CAST(col_id AS INT) AS col_id, trim(cell) AS value_text, try_cast(nullif(regexp_extract(cell, '[-+]?\d+(?:\.\d+)?', 0), '') AS DOUBLE) AS value_num FROM c WHERE trim(cell) <> ''""",
)
def _(s, d):
    rows = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1)), lambda r: F.split(F.regexp_replace(r, r"<[^>]+>", "|"), r"\|"))
    cells = V.cells(table(s, d, "pages").select("page_id", rows.alias("rows")), "page_id", "rows")
    return cells.select("page_id", "row_id", "col_id", F.trim("value_text").alias("value_text"), cell_values(F.col("value_text"))["number"].alias("value_num"))


@query("row_summaries", "SELECT l_orderkey, string_agg(l_linenumber || ':' || CAST(l_quantity AS INT), ' | ' ORDER BY l_linenumber, l_partkey, l_quantity) AS summary FROM lineitem GROUP BY l_orderkey")
def _(s, d):
    cell = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    return V.row_summary(table(s, d, "lineitem"), "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")], cell)


WORDS = "regexp_extract_all(lower({t}), '[0-9a-z가-힣]+')"
PAIRS = f"""t AS (SELECT conv_id, turn AS t, text, {WORDS.format(t='text')} AS raw, list_distinct({WORDS.format(t='text')}) AS q FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn AS b, text AS body, list_distinct({WORDS.format(t='text')}) AS w FROM conversations WHERE role = 'assistant'),
j AS (SELECT conv_id, t, b, raw, body, q, w, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, w)) / len(q)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS base FROM t JOIN b USING (conv_id))"""


def pairs(s, d):
    c = table(s, d, "conversations")
    words = lambda x: F.array_distinct(tokens(x))
    t = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), tokens(F.col("text")).alias("raw"), words(F.col("text")).alias("q"))
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("b"), F.col("text").alias("body"), words(F.col("text")).alias("w"))
    base = F.when(F.size("q") > 0, F.round(F.size(F.array_intersect("q", "w")) / F.size("q"), 6)).otherwise(0.0)
    return t.join(b, "conv_id").withColumn("base", base)


@query(
    "body_pairing",
    f"""WITH {PAIRS}, m AS (SELECT conv_id, t, b, unnest(['caption_window', 'same_section_window', 'semantic_nearest_paragraph']) AS method, unnest([0, 1, 2]) AS place,
 unnest([round(base + CASE WHEN contains(body, raw[1]) THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END, 6), round(base + CASE WHEN b = t + 1 THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END, 6), round(base + least(0.35::DOUBLE, len(list_intersect(list_distinct(raw[1:4]), w)) * 0.06::DOUBLE), 6)]) AS score FROM j)
SELECT conv_id, t, b, method, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY score DESC, place, b) AS rn FROM m WHERE score > 0) WHERE rn = 1""",
)
def _(s, d):
    first = F.try_element_at("raw", F.lit(1))
    methods = [
        ("caption_window", F.round(F.col("base") + F.when(F.col("body").contains(first), 0.45).otherwise(0.0), 6)),
        ("same_section_window", F.round(F.col("base") + F.when(F.col("b") == F.col("t") + 1, 0.55).otherwise(0.0), 6)),
        ("semantic_nearest_paragraph", F.round(F.col("base") + F.least(F.lit(0.35), F.size(F.array_intersect(F.slice("raw", 1, 4), "w")) * 0.06), 6)),
    ]
    return V.pair_bodies(pairs(s, d), ["conv_id", "t"], "b", methods)


@query(
    "nearby_body",
    f"""WITH t AS (SELECT conv_id, turn AS t, text, split_part(text, ' ', 1) AS parent FROM conversations WHERE role = 'user'), q AS (SELECT conv_id, t, parent, CASE WHEN len(list_distinct({WORDS.format(t='parent')})) >= 3 THEN list_distinct({WORDS.format(t='parent')}) ELSE list_distinct(list_concat({WORDS.format(t='parent')}, {WORDS.format(t='text')}[1:18])) END AS q FROM t),
b AS (SELECT conv_id, turn AS b, text AS body, list_distinct({WORDS.format(t='text')}) AS w FROM conversations WHERE role = 'assistant'),
j AS (SELECT conv_id, t, b, body, len(list_intersect(q, w)) AS i, round(len(list_intersect(q, w)) / len(q)::DOUBLE + CASE WHEN parent <> '' AND contains(body, parent) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM q JOIN b USING (conv_id))
SELECT conv_id, t, b, score, left(body, 1500) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY score DESC, b) AS rn FROM j WHERE i > 0) WHERE rn = 1""",
)
def _(s, d):
    c = table(s, d, "conversations")
    t = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.split_part(F.col("text"), F.lit(" "), F.lit(1)).alias("parent"), F.col("text").alias("structural"))
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("b"), "text")
    return V.nearby_body(t, b, ["conv_id"], "t", "b", tokens)


@query(
    "region_match",
    f"""WITH c AS (SELECT conv_id, role, turn, g, {WORDS.format(t='text')} AS w FROM conversations JOIN (SELECT k, g, r FROM (SELECT conv_id AS k, turn AS r, list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, CAST(i AS INT), 3))) AS g FROM (SELECT conv_id, turn, regexp_replace(lower(text), '[^0-9a-z가-힣._-]', '', 'g') AS s FROM conversations) WHERE s <> '')) ON k = conv_id AND r = turn),
j AS (SELECT a.conv_id, a.turn AS t, b.turn AS region, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE + CASE WHEN b.turn = a.turn + 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END * 0.35::DOUBLE + least(0.25::DOUBLE, len(list_intersect(list_distinct(a.w[1:5]), b.w)) * 0.03::DOUBLE) + (b.turn % 10) / 10.0::DOUBLE * 0.1::DOUBLE, 4) AS score FROM c a JOIN c b USING (conv_id) WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, t, region, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY score DESC, region) AS rn FROM j WHERE score > 0) WHERE rn = 1""",
)
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", "role", "turn", "text", char_ngrams(F.col("text")).alias("grams"), tokens(F.col("text")).alias("w"))
    some = F.regexp_like(F.lower("text"), F.lit("[0-9a-z가-힣._-]"))  # has grams
    t = c.where((F.col("role") == "user") & some).select("conv_id", F.col("turn").alias("t"), "grams", F.array_distinct(F.slice("w", 1, 5)).alias("parent_tokens"), F.create_map(F.col("turn") + 1, F.lit(0.5)).alias("page_scores"))
    r = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("region"), F.col("turn").alias("page"), "grams", F.col("w").alias("tokens"), ((F.col("turn") % 10) / 10.0).alias("region_score"))
    return V.match_regions(t, r, ["conv_id"], "t", "region")


@query(
    "evidence_cascade",
    "SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'region' WHEN n_chars > 1000 THEN 'html' ELSE 'structural' END AS source, round(CASE WHEN n_chars > 3000 THEN least(0.95::DOUBLE, greatest(0.5::DOUBLE, n_chars / 10000.0::DOUBLE)) WHEN n_chars > 1000 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END, 4) AS confidence FROM documents",
)
def _(s, d):
    n = F.col("n_chars")
    return table(s, d, "documents").select("doc_id", V.evidence_source(n / 10000.0, n > 3000, n > 1000).alias("e")).select("doc_id", "e.*")


PAGES = f"""t AS (SELECT conv_id, turn AS t, text, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS parent FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id, t, parent, CASE WHEN len(list_distinct({WORDS.format(t='parent')})) >= 3 THEN list_distinct({WORDS.format(t='parent')}) ELSE list_distinct(list_concat({WORDS.format(t='parent')}, {WORDS.format(t='text')}[1:16])) END AS q FROM t),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS page, text FROM conversations WHERE role <> 'user'),
s AS (SELECT conv_id, t, page, round(i / len(q)::DOUBLE + CASE WHEN parent <> '' AND contains(text, parent) THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM (SELECT *, len(list_intersect(q, list_distinct({WORDS.format(t='text')}))) AS i FROM q JOIN p USING (conv_id)) WHERE i > 0)"""


@query(
    "target_pages",
    f"WITH {PAGES}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY score DESC, page) AS rn FROM s WHERE score >= 0.12) WHERE rn <= 2), l AS (SELECT conv_id, max(page) AS last FROM p GROUP BY conv_id) SELECT DISTINCT conv_id, unnest(range(greatest(1, page - 1), least(last, page + 1) + 1)) AS page FROM c JOIN l USING (conv_id) UNION ALL SELECT conv_id, unnest(range(1, least(last, 8) + 1)) FROM l WHERE conv_id NOT IN (SELECT conv_id FROM s WHERE score >= 0.12)",
)
def _(s, d):
    """Pages to look at for each table: a conversation is a document, its answers the pages and its questions the tables."""
    c = table(s, d, "conversations")
    word = lambda n: F.split_part(F.col("text"), F.lit(" "), F.lit(n))
    t = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.concat_ws(" ", word(1), word(2)).alias("parent"), F.col("text").alias("structural"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    p = c.where("role <> 'user'").select("conv_id", place.alias("page"), "text")
    return V.target_pages(V.score_pages(t, p, "conv_id", "t", "page", tokens, least=0.12), p, "conv_id", "t", "page")
