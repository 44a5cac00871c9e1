"""Text functions over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as X
from ..registry import query, table

docs = lambda s, d: table(s, d, "documents").select("doc_id", "text", "source", "lang")
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NORMAL = TRIM.format(r"regexp_replace(text, '\r\n|\r', chr(10), 'g')")


@query("text_normalize", f"SELECT doc_id, md5({NORMAL}) AS digest, length({NORMAL}) AS n FROM documents")
def _(s, d):
    t = X.normalize_text(F.col("text"))
    return docs(s, d).select("doc_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("n"))


CLEAN = TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00　]', ' ', 'g'), '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query("text_clean", f"SELECT doc_id, md5({CLEAN}) AS digest FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.md5(X.clean_text(F.col("text")).cast("binary")).alias("digest"))


STRIP = "CASE " + " ".join(f"WHEN t LIKE '%{x}' AND length(t) >= {len(x) + 2} THEN left(t, length(t) - {len(x)})" for x in lexicon.LATIN_SUFFIXES) + " ELSE t END"


@query("tokenize_strip", f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣]+')) AS t FROM documents) SELECT {STRIP} AS stem, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM w GROUP BY ALL")
def _(s, d):
    t = docs(s, d).select("doc_id", F.explode(X.stripped_tokens(F.col("text"), lexicon.LATIN_SUFFIXES, lexicon.BM25_TOKEN)).alias("stem"))
    per_doc = t.groupBy("stem", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("stem").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("tokens_explode", "SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣]+')) AS t FROM documents) GROUP BY t")
def _(s, d):
    return docs(s, d).select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("token_sets", "SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[0-9A-Za-z가-힣]{2,}'), lambda x: lower(x)))) AS n_tokens FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.size(X.token_set(F.col("text"))).cast("long").alias("n_tokens"))


@query(
    "char_ngrams",
    """WITH r AS (SELECT item_id, regexp_replace(lower(text), '[^0-9a-z가-힣._-]', '', 'g') AS s FROM benchmark)
SELECT item_id, CASE WHEN s = '' THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, CAST(i AS INT), 3)))) END AS n_grams FROM r""",
)
def _(s, d):
    return table(s, d, "benchmark").select("item_id", F.size(X.char_ngrams(F.col("text"))).cast("long").alias("n_grams"))


@query(
    "name_keys",
    r"SELECT page_id, regexp_replace(lower(url), '\s+', '', 'g') AS document_name, regexp_replace(trim(regexp_replace(url, '\s+', ' ', 'g')), '\s+\.(hwp|pdf|xlsx?)', '.\1', 'gi') AS file_name FROM pages",
)
def _(s, d):
    return table(s, d, "pages").select("page_id", X.document_name(F.col("url")).alias("document_name"), X.file_name(F.col("url")).alias("file_name"))


QKEY = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '[^\p{L}\p{M}\p{N}_\s]', '', 'g')"
CKEY = "regexp_replace(regexp_replace(regexp_replace(lower(text), '\\s+', '', 'g'), '[\"''`“”‘’()\\[\\]{}<>]', '', 'g'), '[.,:;!?/\\\\|·•\\-_=+~]', '', 'g')"


@query("question_keys", f"SELECT item_id, {QKEY} AS question_key, {CKEY} AS compare_key FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", X.question_key(F.col("text")).alias("question_key"), X.compare_key(F.col("text")).alias("compare_key"))


@query(
    "safe_casts",
    "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, coalesce(CAST(try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS BIGINT), 0) AS k_int, try_cast(event_type AS DOUBLE) AS bad FROM events",
)
def _(s, d):
    k = F.get_json_object("props", "$.k")
    return table(s, d, "events").select("event_id", X.safe_double(k).alias("k"), X.safe_int(k).alias("k_int"), X.safe_double(F.col("event_type")).alias("bad"))


@query("parse_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_key FROM orders")
def _(s, d):
    written = F.concat_ws(".", F.date_format("o_orderdate", "yyyy"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string"))
    return table(s, d, "orders").select("o_orderkey", X.date_key(written).alias("date_key"))


@query(
    "contact_keys",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[?#].*$', ''), '/+$', '') AS url_key,
 CASE WHEN d LIKE '82%' AND length(d) >= 11 THEN '0' || substr(d, 3) ELSE d END AS phone_key, replace(lower(trim(url)), ' ', '') AS email_key FROM (SELECT *, regexp_replace(url, '[^0-9]', '', 'g') AS d FROM pages)""",
)
def _(s, d):
    return table(s, d, "pages").select("page_id", X.url_key(F.col("url")).alias("url_key"), X.phone_key(F.col("url")).alias("phone_key"), X.email_key(F.col("url")).alias("email_key"))


@query(
    "cell_coerce",
    r"""SELECT doc_id, try_cast(nullif(regexp_extract(replace(text, ',', ''), '[-+]?\d+(?:\.\d+)?', 0), '') AS DOUBLE) AS number,
 nullif(regexp_extract(text, '\d{4}[-./년]\s*\d{1,2}[-./월]\s*\d{1,2}', 0), '') AS date FROM documents""",
)
def _(s, d):
    return docs(s, d).select("doc_id", X.cell_values(F.col("text")).alias("v")).select("doc_id", "v.number", "v.date")


@query(
    "sentence_split",
    r"""SELECT doc_id, len(p) AS n_sentences, list_max(list_transform(p, lambda x: length(x))) AS longest FROM (SELECT doc_id,
 list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\n+', '. ', 'g'), '[.!?。]\s*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)""",
)
def _(s, d):
    return docs(s, d).select("doc_id", X.sentences(F.col("text")).alias("p")).select("doc_id", F.size("p").cast("long").alias("n_sentences"), F.array_max(F.transform("p", F.length)).cast("long").alias("longest"))


@query(
    "keyword_extract",
    """SELECT item_id, array_to_string((list_filter(list_distinct_in_order, lambda x: x NOT IN ('the', 'of', 'and', 'de', 'der')))[1:8], ',') AS keywords FROM (
 SELECT item_id, list_reduce(list_transform(regexp_extract_all(text, '[0-9A-Za-z가-힣]{2,}'), lambda x: [lower(x)]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_in_order FROM benchmark)""",
)
def _(s, d):
    return table(s, d, "benchmark").select("item_id", F.array_join(X.keywords(F.col("text"), ("the", "of", "and", "de", "der")), ",").alias("keywords"))


@query(
    "signal_flags",
    "SELECT doc_id, "
    + ", ".join(f"CAST(regexp_matches(text, '{p}') AS INT) AS has_{k}" for k, p in lexicon.LATIN_PROFILE.items())
    + " FROM documents",
)
def _(s, d):
    return docs(s, d).select("doc_id", *[X.flag(F.col("text"), p).alias(f"has_{k}") for k, p in lexicon.LATIN_PROFILE.items()])


@query("marker_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\|')) + len(regexp_extract_all(text, '\d+')) AS BIGINT) AS n_markers FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", X.count_of(F.col("text"), [r"\|", r"\d+"]).alias("n_markers"))


HTML = r"regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
HTML = rf"regexp_replace(regexp_replace({HTML}, '(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _e, _c in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    HTML = f"replace({HTML}, '{_e}', {_c})"
HTML = TRIM.format(rf"regexp_replace(regexp_replace({HTML}, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g')")


@query("html_to_text", f"SELECT page_id, md5({HTML}) AS digest, length({HTML}) AS n FROM pages")
def _(s, d):
    t = X.html_text(F.col("html"))
    return table(s, d, "pages").select("page_id", F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("n"))


@query("recovery_percent", rf"SELECT page_id, CASE WHEN length(regexp_replace(html, '\s+', '', 'g')) > 0 THEN round(least(length(regexp_replace({HTML}, '\s+', '', 'g')) * 100.0::DOUBLE / length(regexp_replace(html, '\s+', '', 'g')), 100.0), 2) ELSE 0.0 END AS percent FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", X.recovery_percent(X.html_text(F.col("html")), F.col("html")).alias("percent"))


WEIGHTS = {"tion": 2.0, "the": 0.5, "ung": 1.5, "que": 1.0}


@query(
    "weighted_keywords",
    "SELECT doc_id, " + " + ".join(f"least((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}, 8) * {x}::DOUBLE" for w, x in WEIGHTS.items()) + " AS score FROM documents",
)
def _(s, d):
    return docs(s, d).select("doc_id", X.weighted_keywords(F.col("text"), WEIGHTS).alias("score"))


GROUPS = {"articles": ("the", "der", "les"), "links": ("and", "und", "que")}


@query(
    "keyword_groups",
    "SELECT doc_id, " + ", ".join(f"CAST({' + '.join(f'''greatest((length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}, (length(z) - length(replace(z, '{w}', ''))) // {len(w)})''' for w in ws)} AS BIGINT) AS {g}" for g, ws in GROUPS.items()) + r" FROM (SELECT doc_id, text, regexp_replace(lower(text), '\s+', '', 'g') AS z FROM documents)",
)
def _(s, d):
    low, tight = F.lower("text"), F.regexp_replace(F.lower("text"), r"\s+", "")
    return docs(s, d).select("doc_id", *[sum((F.greatest(X.occurrences(low, w), X.occurrences(tight, w)) for w in ws), F.lit(0)).cast("long").alias(g) for g, ws in GROUPS.items()])


@query(
    "top_tokens",
    """WITH w AS (SELECT source, doc_id, t, pos FROM (SELECT source, doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT source, doc_id, regexp_extract_all(lower(text), '[0-9a-z가-힣]+') AS ts FROM documents))),
c AS (SELECT source, t, count(*) AS n, min((doc_id, pos)) AS f FROM w GROUP BY source, t)
SELECT source, t AS token, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f, t) AS rn FROM c) WHERE rn <= 12""",
)
def _(s, d):
    words = docs(s, d).select("source", "doc_id", F.posexplode(X.tokens(F.col("text"))).alias("pos", "token"))
    counts = words.groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "first", "token"))
    return counts.withColumn("rn", rn).where("rn <= 12").select("source", "token", "n", F.col("rn").cast("long").alias("rn"))


@query("json_block", r"SELECT event_id, json_extract_string(regexp_extract('note ' || props || ' end', '(?s)\{.*\}', 0), '$.k') AS k FROM events")
def _(s, d):
    block = X.json_block(F.concat(F.lit("note "), F.col("props"), F.lit(" end")))
    return table(s, d, "events").select("event_id", F.from_json(block, "k string").getField("k").alias("k"))


@query("score_clamp", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, least(5, CAST(trunc(l_quantity / 8) AS INT))) AS score FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.score_1_to_5(F.col("l_quantity") / 8).alias("score"))


REFUSAL = r"(not |nicht|pas |no )"


@query("refusal_detect", f"SELECT conv_id, turn, regexp_matches(lower(text), '{REFUSAL}') AS refused FROM conversations WHERE role = 'assistant'")
def _(s, d):
    return table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.lower("text").rlike(REFUSAL).alias("refused"))


@query("depends_on_list", "SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' ELSE array_to_string(list_transform(range(0, turn), lambda x: CAST(x AS VARCHAR)), '|') END AS parents FROM conversations")
def _(s, d):
    written = F.when(F.col("turn") == 0, "-").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.col("turn").cast("int") - 1, F.lit(0))), lambda x: x.cast("string")), ", "))
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(X.depends_on(written), "|").alias("parents"))


@query("query_normalize", r"SELECT item_id, trim(regexp_replace(replace(replace(replace(text, 'the', 'a'), 'of', 'from'), 'and', 'plus'), '\s+', ' ', 'g')) AS normalized FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", X.normalized_query(F.col("text"), lexicon.LATIN_SYNONYMS).alias("normalized"))
