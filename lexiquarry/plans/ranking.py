"""Ranking queries. An order is a question and its lines are the candidates, so every rule meets ties, repeated documents
and missing pairs over the whole lineitem table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicon
from ..operators import ranking as R
from ..registry import query, table
from ..session import tasks_for

CAND = """c0 AS (SELECT l_orderkey AS query_id, l_partkey * 10 + l_linenumber AS chunk_id, max(l_discount) / 10 AS fusion_score, 'Doc ' || CAST(min(l_suppkey) % 4 AS VARCHAR) AS file_name,
 min(l_returnflag) AS section, min(l_linestatus) AS parent, CAST(l_linenumber % 2 AS INT) AS has_table, max(l_tax) * 4 AS pairing_score,
 CASE l_linenumber % 5 WHEN 0 THEN 'paired_body_chunk' WHEN 1 THEN 'table_true_ocr_v2' WHEN 2 THEN 'row_summary_chunk' WHEN 3 THEN 'header_value_pair' ELSE '' END AS chunk_type,
 CASE l_linenumber % 3 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'INCORRECT' ELSE 'AMBIGUOUS' END AS crag_label,
 CASE l_orderkey % 5 WHEN 0 THEN 'factual' WHEN 1 THEN 'comparison' WHEN 2 THEN 'follow_up' WHEN 3 THEN 'table_plus_text' ELSE 'table_factual' END AS answer_type,
 min(l_returnflag) || ' part ' || CAST(l_partkey % 7 AS VARCHAR) || ' line' || CAST(l_linenumber AS VARCHAR) || ' ' || min(l_linestatus) AS text,
 'which part ' || CAST(l_orderkey % 7 AS VARCHAR) || ' of line3 and line' || CAST(l_orderkey % 4 AS VARCHAR) AS question FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, chunk_id) AS ord FROM c0)"""


def candidates(s, d):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    case = lambda c, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (c + 1).cast("int"))
    # an order's lines meet once, and all its rules find them together
    lines = table(s, d, "lineitem")
    g = (
        lines.repartition(tasks_for(lines), "l_orderkey")
        .groupBy("l_orderkey", "l_partkey", "l_linenumber")
        .agg(F.max("l_discount").alias("disc"), F.min("l_suppkey").alias("supp"), F.min("l_returnflag").alias("section"), F.min("l_linestatus").alias("parent"), F.max("l_tax").alias("tax"))
    )
    text = F.concat("section", F.lit(" part "), (F.col("l_partkey") % 7).cast("string"), F.lit(" line"), n.cast("string"), F.lit(" "), "parent")
    question = F.concat(F.lit("which part "), (o % 7).cast("string"), F.lit(" of line3 and line"), (o % 4).cast("string"))
    rows = g.select(
        o.alias("query_id"),
        (F.col("l_partkey") * 10 + n).alias("chunk_id"),
        (F.col("disc") / 10).alias("fusion_score"),
        F.lit(None).cast("double").alias("adjusted_score"),
        F.concat(F.lit("Doc "), (F.col("supp") % 4).cast("string")).alias("file_name"),
        "section",
        "parent",
        (n % 2).cast("int").alias("has_table"),
        (F.col("tax") * 4).alias("pairing_score"),
        case(n % 5, "paired_body_chunk", "table_true_ocr_v2", "row_summary_chunk", "header_value_pair", "").alias("chunk_type"),
        case(n % 3, "CORRECT", "INCORRECT", "AMBIGUOUS").alias("crag_label"),
        case(o % 5, "factual", "comparison", "follow_up", "table_plus_text", "table_factual").alias("answer_type"),
        text.alias("text"),
        question.alias("question"),
    )
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), "chunk_id")))


def out(df, *names):
    return df.select(*[F.col(n).cast("long").alias(n) if n in ("ord", "rank", "k") else F.col(n) for n in names])


def resort(body: str, cols: str = "") -> str:
    """SQL: rows of ``body`` with ``score`` set, sorted again as adjusted() does."""
    return f"SELECT query_id, chunk_id, round(score, 9) AS adjusted_score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(nullif(round(score, 9), 0), fusion_score) DESC, ord) AS ord{cols} FROM ({body})"


@query(
    "diversity_rerank",
    f"""WITH {CAND}, p AS (SELECT *, round(fusion_score - (row_number() OVER (PARTITION BY query_id, file_name ORDER BY fusion_score DESC, ord) - 1) * 0.75::DOUBLE, 9) AS score FROM c)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_name, ord) AS rank FROM p) WHERE rank <= 5""",
)
def _(s, d):
    return out(R.diversity_rerank(candidates(s, d), 5), "query_id", "chunk_id", "score", "rank")


PROFILE = ", ".join(f"regexp_matches(text, '{p}') AS {k}" for k, p in lexicon.LATIN_PROFILE.items() if k != "comparison")


@query(
    "question_profile",
    f"SELECT doc_id AS query_id, {PROFILE}, lang = 'de' OR regexp_matches(text, '{lexicon.LATIN_PROFILE['comparison']}') AS comparison, lang = 'fr' AS follow_up, lang = 'es' AS rejection FROM documents",
)
def _(s, d):
    kind = F.when(F.col("lang") == "de", "comparison").when(F.col("lang") == "fr", "follow_up").when(F.col("lang") == "es", "rejection").otherwise("factual")
    rows = table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"), kind.alias("answer_type"), F.array().cast("array<string>").alias("depends_on"))
    return R.question_profile(rows, lexicon.LATIN_PROFILE).select("query_id", *lexicon.LATIN_PROFILE, "follow_up", "rejection")


@query(
    "route_decision",
    f"""WITH {CAND} SELECT DISTINCT query_id, answer_type, CASE WHEN query_id % 9 = 0 OR answer_type = 'follow_up' THEN 'b02' WHEN answer_type IN ('factual', 'comparison') THEN 'b03a' ELSE 'b02' END AS route,
 CAST(CASE WHEN NOT (query_id % 9 = 0 OR answer_type = 'follow_up') AND answer_type IN ('factual', 'comparison') THEN CASE WHEN answer_type = 'comparison' THEN 4 ELSE 3 END ELSE 5 END AS BIGINT) AS k FROM c""",
)
def _(s, d):
    rows = candidates(s, d).select("query_id", "answer_type").distinct()
    rows = rows.withColumn("route", R.route(F.col("answer_type"), F.col("query_id") % 9 == 0))
    return out(rows.withColumn("k", R.route_top_k(F.col("route"), F.col("answer_type"))), "query_id", "answer_type", "route", "k")


SHARED = "len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[0-9a-z가-힣]+')), list_distinct(regexp_extract_all(lower(text), '[0-9a-z가-힣]+'))))"


@query(
    "field_bonus_rerank",
    f"WITH {CAND} "
    + resort(
        f"SELECT *, fusion_score + ((CASE WHEN query_id % 2 = 0 AND section = 'A' THEN 0.0045::DOUBLE ELSE 0 END) + (CASE WHEN query_id % 3 = 0 AND section = 'N' THEN 0.0045::DOUBLE ELSE 0 END) + (CASE WHEN section = 'R' THEN 0.0045::DOUBLE ELSE 0 END) + (CASE WHEN contains(text, 'F') THEN 0.0035::DOUBLE ELSE 0 END) + (CASE WHEN has_table = 1 AND (query_id % 2 = 0 OR query_id % 3 = 0) THEN 0.0015::DOUBLE ELSE 0 END) + least(0.003::DOUBLE, {SHARED} * 0.0005::DOUBLE)) AS score FROM c"
    ),
)
def _(s, d):
    q = F.col("query_id")
    flags = {"budget": q % 2 == 0, "schedule": q % 3 == 0, "contract": F.lit(True), "purpose": F.lit(True)}
    flags |= {f"has_{k}": (F.col("section") == v).cast("int") for k, v in (("budget", "A"), ("schedule", "N"), ("contract", "R"))}
    return out(R.field_bonus(candidates(s, d).withColumns(flags), F.col("text"), "F"), "query_id", "chunk_id", "adjusted_score", "ord")


ANY = "max(CASE WHEN {0} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id)"


def or_all(cond: str, k: int) -> str:
    return f"WITH {CAND}, f AS (SELECT *, {cond} AS ok, {ANY.format(cond)} AS n_ok FROM c) SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rank FROM f WHERE ok OR n_ok = 0) WHERE rank <= {k}"


@query("crag_filter", or_all("crag_label IN ('CORRECT', 'AMBIGUOUS')", 3))
def _(s, d):
    return out(R.crag_filter(candidates(s, d), 3), "query_id", "chunk_id", "rank")


@query("filter_or_all", or_all("chunk_type = 'paired_body_chunk'", 4))
def _(s, d):
    return out(R.filter_or_all(candidates(s, d), F.col("chunk_type") == "paired_body_chunk", 4), "query_id", "chunk_id", "rank")


@query("post_filter_by_name", or_all("contains(replace(lower(file_name), ' ', ''), 'doc' || CAST(query_id % 4 AS VARCHAR)) OR contains('doc' || CAST(query_id % 4 AS VARCHAR), replace(lower(file_name), ' ', ''))", 5))
def _(s, d):
    return out(R.filter_or_all(candidates(s, d), R.names_match(F.col("file_name"), F.concat(F.lit("doc"), (F.col("query_id") % 4).cast("string"))), 5), "query_id", "chunk_id", "rank")


RULES = ((("the", "der"), "article words"), (("tion",), "action words"), (("que", "ou"), "link words"))


@query(
    "query_expansion",
    r"""WITH t AS (SELECT item_id, text, [CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'der') THEN text || ' article words' END, CASE WHEN contains(lower(text), 'tion') THEN text || ' action words' END, CASE WHEN contains(lower(text), 'que') OR contains(lower(text), 'ou') THEN text || ' link words' END] AS p FROM benchmark)
SELECT item_id, md5(array_to_string(list_concat([text], list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x IS NOT NULL)[1:2]), '|')) AS digest FROM t""",
)
def _(s, d):
    return table(s, d, "benchmark").select("item_id", F.md5(F.array_join(R.query_variants(F.col("text"), RULES, 2), "|").cast("binary")).alias("digest"))


LONG = "len(list_intersect(list_distinct(list_transform(regexp_extract_all(question, '[0-9A-Za-z가-힣]{2,}'), lambda x: lower(x))), list_distinct(list_transform(regexp_extract_all(text, '[0-9A-Za-z가-힣]{2,}'), lambda x: lower(x)))))"


@query(
    "metadata_boost",
    f"WITH {CAND}, b AS (SELECT *, round(round(least(0.02::DOUBLE, least(0.0045::DOUBLE, {LONG} * 0.00055::DOUBLE) + (CASE WHEN query_id % 2 = 0 AND section = 'A' THEN 0.0038::DOUBLE ELSE 0 END) + (CASE WHEN query_id % 3 = 0 AND contains(text, 'line3') THEN 0.0032::DOUBLE ELSE 0 END)), 6) + (CASE WHEN has_table = 1 THEN 0.002::DOUBLE ELSE 0 END), 9) AS boost FROM c) "
    + resort("SELECT *, fusion_score + boost AS score FROM b", ", boost"),
)
def _(s, d):
    q = F.col("query_id")
    rules = [(q % 2 == 0, "^A ", 0.0038), (q % 3 == 0, "line3", 0.0032)]
    return out(R.metadata_boost(candidates(s, d), F.col("text"), rules), "query_id", "chunk_id", "boost", "adjusted_score", "ord")


@query("boost_scope", f"WITH {CAND} SELECT DISTINCT query_id, (answer_type = 'comparison' OR (answer_type = 'factual' AND regexp_matches(question, 'line3'))) AND answer_type <> 'follow_up' AS applies FROM c")
def _(s, d):
    kind = F.col("answer_type")
    applies = R.boost_applies("comparison_and_explicit_factual", kind == "comparison", kind == "follow_up", (kind == "factual") & F.col("question").rlike("line3"))
    return candidates(s, d).select("query_id", applies.alias("applies")).distinct()


@query(
    "dual_doc_protect",
    f"""WITH {CAND}, a AS (SELECT *, min(CASE WHEN file_name = 'Doc 1' THEN ord END) OVER (PARTITION BY query_id) AS a, min(CASE WHEN file_name = 'Doc 2' THEN ord END) OVER (PARTITION BY query_id) AS b FROM c)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN a IS NOT NULL AND b IS NOT NULL AND answer_type = 'comparison' AND ord = a THEN 0 WHEN a IS NOT NULL AND b IS NOT NULL AND answer_type = 'comparison' AND ord = b THEN 1 ELSE 2 END, ord) AS ord FROM a""",
)
def _(s, d):
    rows = candidates(s, d).withColumn("targets", F.array(F.lit("doc 1"), F.lit("DOC2")))
    return out(R.dual_doc_protect(rows, F.col("answer_type") == "comparison"), "query_id", "chunk_id", "ord")


@query(
    "round_robin_docs",
    f"WITH {CAND}, x AS (SELECT *, (CASE WHEN section = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.004::DOUBLE AS axis FROM c), y AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_name ORDER BY fusion_score + axis DESC, ord) AS rn FROM x) "
    + resort("SELECT *, fusion_score + axis + CASE WHEN rn = 1 THEN 0.003::DOUBLE ELSE 0.0::DOUBLE END AS score FROM y"),
)
def _(s, d):
    return out(R.comparison_helper(candidates(s, d), F.when(F.col("section") == "A", 1.0).otherwise(0.0)), "query_id", "chunk_id", "adjusted_score", "ord")


@query(
    "table_body_pair",
    f"WITH {CAND}, x AS (SELECT *, max(has_table) OVER w AS hi, min(has_table) OVER w AS lo, row_number() OVER (PARTITION BY query_id, file_name, has_table ORDER BY ord) AS rn FROM c WINDOW w AS (PARTITION BY query_id, file_name)) "
    + resort("SELECT *, fusion_score + CASE WHEN hi = 1 AND lo = 0 AND rn = 1 THEN CASE WHEN has_table = 1 THEN 0.004::DOUBLE ELSE 0.003::DOUBLE END ELSE 0.0::DOUBLE END AS score FROM x"),
)
def _(s, d):
    return out(R.table_body_pair(candidates(s, d)), "query_id", "chunk_id", "adjusted_score", "ord")


@query(
    "pair_guard",
    f"""WITH {CAND}, p AS (SELECT t.query_id, t.chunk_id AS t, b.chunk_id AS b, b.ord AS bo, coalesce((CASE WHEN t.section = b.section THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN t.parent = b.parent THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN contains(lower(b.text), lower(t.parent)) THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END), 0) AS score,
 coalesce(t.parent = b.parent OR contains(lower(b.text), lower(t.parent)), false) AS hit FROM (SELECT * FROM c WHERE has_table = 1) t LEFT JOIN (SELECT * FROM c WHERE has_table = 0) b ON t.query_id = b.query_id AND t.file_name = b.file_name),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY score DESC, bo NULLS LAST) AS rn FROM p) WHERE rn = 1),
e AS (SELECT query_id, t AS chunk_id, CASE WHEN score > 0 THEN 0.006::DOUBLE + CASE WHEN hit THEN 0.003::DOUBLE ELSE 0 END ELSE -0.004::DOUBLE END AS g FROM b UNION ALL SELECT query_id, b, 0.006::DOUBLE + CASE WHEN hit THEN 0.003::DOUBLE ELSE 0 END FROM b WHERE score > 0),
g AS (SELECT query_id, chunk_id, sum(g) AS gain FROM e GROUP BY ALL) """
    + resort("SELECT c.*, fusion_score + coalesce(gain, 0) AS score FROM c LEFT JOIN g USING (query_id, chunk_id)"),
)
def _(s, d):
    return out(R.pair_guard(candidates(s, d)), "query_id", "chunk_id", "adjusted_score", "ord")


def case_of(values: dict[str, float]) -> str:
    return "CASE chunk_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + " ELSE 0.0::DOUBLE END"


PAIR = "chunk_type IN ('paired_body_chunk', 'table_body_pack', 'row_body_pack')"
STRUCT = "chunk_type IN ('header_value_pair', 'cell_row_block', 'row_summary_chunk', 'table_body_pack', 'row_body_pack')"


@query(
    "type_gated_rerank",
    f"""WITH {CAND}, x AS (SELECT *, {PAIR} AS is_pair, {STRUCT} AS is_struct, bool_or({PAIR} OR pairing_score >= 0.25) OVER (PARTITION BY query_id, file_name) AS support, answer_type = 'table_plus_text' AND bool_or({STRUCT}) OVER (PARTITION BY query_id) AS plus FROM c),
s AS (SELECT *, fusion_score + CASE WHEN answer_type = 'table_factual' THEN {case_of(R.FACTUAL_PRIORITY)} + (CASE WHEN is_struct THEN 0.0015::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN chunk_type = '' THEN 0.0015::DOUBLE ELSE 0.0::DOUBLE END)
 WHEN plus THEN {case_of(R.PLUS_TEXT_PRIORITY)} + (CASE WHEN is_struct THEN 0.0012::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN chunk_type = 'table_true_ocr_v2' AND NOT support THEN 0.003::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN is_pair THEN 0.001::DOUBLE ELSE 0.0::DOUBLE END) ELSE 0.0::DOUBLE END AS score FROM x),
o AS ({resort("SELECT * FROM s", ", is_pair, is_struct, plus")}),
h AS (SELECT *, bool_or(is_pair AND ord <= 3) OVER w AS hp, bool_or(is_struct AND ord <= 3) OVER w AS hs, min(CASE WHEN is_pair AND ord > 3 THEN ord END) OVER w AS fp, min(CASE WHEN is_struct AND ord > 3 THEN ord END) OVER w AS fs FROM o WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, adjusted_score, row_number() OVER (PARTITION BY query_id ORDER BY least(CASE WHEN plus AND NOT hp AND ord = fp THEN 3.3 ELSE ord END, CASE WHEN plus AND NOT hs AND ord = fs THEN 3.6 ELSE ord END), ord) AS ord FROM h""",
)
def _(s, d):
    return out(R.type_gated(candidates(s, d), 3, F.col("answer_type")), "query_id", "chunk_id", "adjusted_score", "ord")


def set_of(c: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({c}, '[0-9A-Za-z가-힣]{{2,}}'), lambda x: lower(x)))"


def share_of(c: str) -> str:
    return f"round(CASE WHEN len({set_of('question')}) > 0 THEN len(list_intersect({set_of('question')}, {set_of(c)})) / len({set_of('question')})::DOUBLE ELSE 0.0 END, 4)"


@query(
    "alignment_scores",
    f"""WITH {CAND}, a AS (SELECT query_id, chunk_id, {share_of('chunk_type')} AS header_match, {share_of("section || ' ' || text")} AS row_match, {share_of('file_name')} AS entity_overlap FROM c)
SELECT *, CASE WHEN header_match >= 0.6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_header, CASE WHEN row_match >= 0.6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_row FROM a""",
)
def _(s, d):
    rows = candidates(s, d)
    return rows.select("query_id", "chunk_id", R.alignment(F.col("question"), F.col("chunk_type"), F.col("section"), F.col("text"), F.col("file_name")).alias("a")).select("query_id", "chunk_id", "a.*")


@query(
    "soft_gate",
    f"""WITH {CAND}, n AS (SELECT *, least(count(*) OVER (PARTITION BY query_id), 6) AS n FROM c), i AS (SELECT *, ord <= n AS inside, file_name || '|' || chunk_type || '|' || lower(text) AS sig FROM n),
d AS (SELECT query_id, count(DISTINCT sig) AS sigs FROM i WHERE inside GROUP BY query_id),
f AS (SELECT i.*, {share_of('text')} AS q, {share_of('file_name')} AS m, round(sum(CASE WHEN inside THEN 1 ELSE 0 END) OVER (PARTITION BY i.query_id, section) / n::DOUBLE, 4) AS consistency, round((n - sigs) / n::DOUBLE, 4) AS duplicates,
 bool_or(inside AND (has_table = 1 OR chunk_type IN ('table_true_ocr_v2', 'raw_table_ocr', 'header_value_pair', 'cell_row_block', 'row_summary_chunk'))) OVER w AS t, bool_or(inside AND (has_table = 0 OR {PAIR})) OVER w AS b, bool_or(inside AND ({PAIR} OR pairing_score >= 0.25)) OVER w AS p
 FROM i JOIN d USING (query_id) WINDOW w AS (PARTITION BY i.query_id)),
g AS (SELECT *, CASE WHEN answer_type <> 'table_plus_text' THEN 0.5::DOUBLE WHEN NOT t OR NOT b THEN 0.0::DOUBLE WHEN p THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS pair FROM f),
k AS (SELECT *, CASE WHEN answer_type = 'table_plus_text' THEN CASE WHEN pair < 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN answer_type = 'follow_up' THEN CASE WHEN q < 0.1 AND m < 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE CASE WHEN q < 0.06 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS weak FROM g),
v AS (SELECT *, round(greatest(0, least(1, (0.36::DOUBLE * q + 0.22::DOUBLE * m + 0.17::DOUBLE * consistency + 0.15::DOUBLE * pair) - (duplicates * 0.2::DOUBLE + weak * 0.2::DOUBLE))), 4) AS quality FROM k),
u AS (SELECT *, CASE WHEN quality < 0.22 THEN 'flag_low_confidence' WHEN quality < 0.36 THEN 'down-rank' ELSE 'keep' END AS decision FROM v),
r AS ({resort("SELECT *, fusion_score + (quality * 0.045::DOUBLE - CASE decision WHEN 'down-rank' THEN 0.008::DOUBLE WHEN 'flag_low_confidence' THEN 0.015::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM u", ", quality, decision")})
SELECT * FROM r WHERE ord <= 5""",
)
def _(s, d):
    return out(R.soft_gate(candidates(s, d), F.col("answer_type"), F.col("file_name")), "query_id", "chunk_id", "adjusted_score", "ord", "quality", "decision")


@query("soft_gate_scope", f"WITH {CAND} SELECT DISTINCT query_id, answer_type IN ('comparison', 'table_plus_text', 'follow_up') AS targeted, answer_type NOT IN ('factual', 'table_factual') AS everywhere FROM c")
def _(s, d):
    kind = F.col("answer_type")
    scope = lambda name: R.soft_gate_applies(kind, kind == "comparison", kind == "follow_up", name)
    return candidates(s, d).select("query_id", scope("targeted").alias("targeted"), scope("all").alias("everywhere")).distinct()


@query(
    "second_pass_merge",
    f"""WITH {CAND}, u AS (SELECT query_id, chunk_id, ord, 0 AS part FROM c WHERE crag_label = 'CORRECT' UNION ALL SELECT query_id, chunk_id, ord, 1 FROM c WHERE has_table = 1 UNION ALL SELECT query_id, chunk_id, ord, 2 FROM c),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY part, ord) AS rn FROM u) WHERE rn = 1)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY part, ord, chunk_id) AS ord FROM f""",
)
def _(s, d):
    c = candidates(s, d)
    return out(R.precedence_union(c.where("crag_label = 'CORRECT'"), c.where("has_table = 1"), c), "query_id", "chunk_id", "ord")


@query(
    "diverse_select",
    f"WITH {CAND}, x AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, file_name ORDER BY ord) > 1 THEN 1 ELSE 0 END AS again FROM c) SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY again, ord) AS rank FROM x) WHERE rank <= 4",
)
def _(s, d):
    return out(R.diverse_select(candidates(s, d), 4), "query_id", "chunk_id", "rank")


@query(
    "coverage_metrics",
    f"""WITH {CAND}, g AS (SELECT query_id, count(*) AS n, list_distinct(list(replace(lower(file_name), ' ', ''))) AS names, bool_or(has_table = 1 OR {STRUCT} OR chunk_type = 'table_true_ocr_v2') AS t, bool_or(has_table = 0 OR {PAIR}) AS b, bool_or({PAIR}) AS p, bool_or({STRUCT}) AS s, max(pairing_score) AS pairing FROM c GROUP BY query_id)
SELECT query_id, CASE WHEN list_contains(names, 'doc1') AND list_contains(names, 'doc2') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dual_doc_coverage, round((CASE WHEN list_contains(names, 'doc1') THEN 1 ELSE 0 END + CASE WHEN list_contains(names, 'doc2') THEN 1 ELSE 0 END) / 2.0::DOUBLE, 4) AS evidence_coverage,
 round(len(names) / n::DOUBLE, 4) AS source_diversity, CAST(t AS INT)::DOUBLE AS table_hit, CAST(b AS INT)::DOUBLE AS body_hit, CAST(p OR pairing >= 0.2 AS INT)::DOUBLE AS pair_hit, CAST(t AND b AS INT)::DOUBLE AS table_plus_body, CAST(s AS INT)::DOUBLE AS structured_hit, round(pairing, 4) AS pairing_score_max FROM g""",
)
def _(s, d):
    return R.coverage(candidates(s, d).withColumn("targets", F.array(F.lit("Doc 1"), F.lit("Doc 2"))))


@query(
    "resolve_name",
    """WITH names AS (SELECT c_name AS name FROM customer UNION ALL SELECT replace(s_name, 'Supplier', 'supplier ') FROM supplier UNION ALL SELECT DISTINCT substr(s_name, 10) FROM supplier), pool AS (SELECT c_name AS file_name, c_custkey AS place FROM customer UNION ALL SELECT s_name, 1000000000 + s_suppkey FROM supplier),
k AS (SELECT *, regexp_replace(lower(file_name), '\\s+', '', 'g') AS key FROM pool), n AS (SELECT DISTINCT name, regexp_replace(lower(name), '\\s+', '', 'g') AS key FROM names),
a AS (SELECT n.name, n.key, (SELECT arg_min(file_name, place) FROM k WHERE k.file_name = n.name) AS e, (SELECT arg_min(file_name, place) FROM k WHERE k.key = n.key) AS q FROM n),
r AS (SELECT a.name, arg_min(file_name, place) AS x FROM a JOIN k ON contains(k.key, a.key) WHERE e IS NULL AND q IS NULL AND a.key <> '' GROUP BY a.name)
SELECT a.name, coalesce(e, q, x) AS file_name, CASE WHEN e IS NOT NULL THEN 1 WHEN q IS NOT NULL THEN 2 WHEN x IS NOT NULL THEN 3 END AS tier FROM a LEFT JOIN r ON a.name = r.name""",
)
def _(s, d):
    c, p = table(s, d, "customer"), table(s, d, "supplier")
    names = c.select(F.col("c_name").alias("name")).union(p.select(F.replace("s_name", F.lit("Supplier"), F.lit("supplier ")))).union(p.select(F.expr("substr(s_name, 10)"))).distinct()
    pool = c.select(F.col("c_name").alias("file_name"), F.col("c_custkey").alias("place")).union(p.select("s_name", F.col("s_suppkey") + 1_000_000_000))
    return R.resolve_names(names, pool)


@query(
    "run_scores",
    f"""WITH {CAND}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, ord) AS r FROM c), g AS (SELECT query_id, round(avg(CASE WHEN r <= 3 THEN fusion_score END), 12) AS top, avg(CASE WHEN crag_label IN ('CORRECT', 'SOFT', 'AMBIGUOUS') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio, count(*) AS n FROM x GROUP BY query_id),
v AS (SELECT *, CAST(floor(greatest(0, least(100, (1 - exp(-top * 220.0::DOUBLE)) * 100))) AS BIGINT) AS relevance FROM g)
SELECT query_id, relevance, CAST(floor(round(greatest(0, least(100, (0.58::DOUBLE * (relevance / 100.0::DOUBLE) + 0.26::DOUBLE * ratio + 0.16::DOUBLE * least(1.0::DOUBLE, n / 5.0::DOUBLE)) * 100)), 9)) AS BIGINT) AS confidence FROM v""",
)
def _(s, d):
    return R.run_scores(candidates(s, d), 5)


@query(
    "source_relevance",
    f"""WITH {CAND}, g AS (SELECT query_id, file_name, min(ord) AS f, round(max(fusion_score), 12) AS best FROM c GROUP BY ALL)
SELECT query_id, file_name, CAST(floor(greatest(0, least(100, (1 - exp(-best * 220.0::DOUBLE)) * 100))) AS BIGINT) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f) AS rn FROM g) WHERE rn <= 4""",
)
def _(s, d):
    return R.source_relevance(candidates(s, d))


@query(
    "select_targets",
    """WITH f AS (SELECT p_partkey, p_brand || ' ' || p_name AS name FROM part), t AS (SELECT DISTINCT 'The ' || p_name || ' of ' || p_brand || ', ' || lower(p_type) AS name FROM part WHERE p_size > 45 UNION SELECT upper(p_name) FROM part WHERE p_size < 3),
k AS (SELECT DISTINCT regexp_replace(lower(name), '\\s+', '', 'g') AS l FROM f), q AS (SELECT DISTINCT regexp_replace(lower(name), '\\s+', '', 'g') AS s FROM t), m AS (SELECT DISTINCT l FROM k, q WHERE least(length(l), length(s)) >= 8 AND (contains(l, s) OR contains(s, l)))
SELECT p_partkey, name, 'contains' AS matched_by FROM f JOIN m ON m.l = regexp_replace(lower(name), '\\s+', '', 'g')""",
)
def _(s, d):
    """Parts whose brand and name hold a target's name or stand in one; similarity has a test of its own."""
    p = table(s, d, "part")
    files = p.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("name"))
    long = p.where("p_size > 45").select(F.concat(F.lit("The "), "p_name", F.lit(" of "), "p_brand", F.lit(", "), F.lower("p_type")).alias("target"))
    return R.select_targets(files, "name", long.union(p.where("p_size < 3").select(F.upper("p_name"))), "target", None)
