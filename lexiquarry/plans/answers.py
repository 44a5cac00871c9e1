"""Queries on answers, search modes and coverage. Golden cases are worked out by hand: an order line's number of its order picks the
case, its quantity or its part's number stands in the text, and VALUES with the same number stand in the SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..registry import ORACLES, query, table
from .evaluation import mean_sql
from .search import as_long, asked20, lexical, questions, vectors


def golden(rows, columns: str, source: str = "lineitem") -> str:
    """SQL of (the line's key, columns...) from values, {n} in a text being the line's part."""
    one = lambda v: "NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    names = columns.split(", ")
    kinds = [next((type(r[i]) for r in rows if r[i] is not None), str) for i in range(len(names))]
    values = ", ".join("(" + ", ".join([str(i), *map(one, r)]) + ")" for i, r in enumerate(rows))
    made = ", ".join(f"replace({c}, '{{n}}', CAST(l_partkey + 100 AS VARCHAR)) AS {c}" if k is str else f"CASE WHEN {c} = -1 THEN CAST(l_partkey + 100 AS DOUBLE) ELSE {c} END AS {c}" for c, k in zip(names, kinds, strict=True))
    return f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {made} FROM lineitem JOIN (VALUES {values}) t(id, {columns}) ON (l_orderkey + l_linenumber) % {len(rows)} = id"


def cases(s, d, rows, columns: str):
    """Each order line with its case: columns are strings or arrays of them, {n} being the line's part."""
    n = (F.col("l_partkey") + 100).cast("string")
    fill = lambda v: F.lit(None).cast("string") if v is None else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    made = F.array(*[F.struct(*[fill(v).alias(c) for c, v in zip(columns.split(", "), r, strict=True)]) for r in rows])
    at = ((F.col("l_orderkey") + F.col("l_linenumber")) % len(rows) + 1).cast("int")
    df = table(s, d, "lineitem").select(*LINE_KEY, F.element_at(made, at).alias("case"))
    first = rows[0]
    return df.select(*LINE_KEY, *[F.col(f"case.{c}").alias(c) if isinstance(v, list) else F.replace(F.col(f"case.{c}"), F.lit("{n}"), n).alias(c) for c, v in zip(columns.split(", "), first, strict=True)])


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# (answer, type) -> constrained form
CONSTRAINED = [
    ("- 2) 제한경쟁입찰\n설명", "choice", "제한경쟁입찰"),
    ("답: 일반경쟁", "choice", "일반경쟁"),
    ("총 {n}만원 입니다", "currency", "{n}만원"),
    ("기간은 2025-03-01 부터", "date", "2025-03-01"),
    ("정량 {n}점, 정성 20점", "slot_pair", "{n}, 20"),
    ("서버;저장소 {n} ,망", "list_set", "서버, 저장소 {n}, 망"),
    ("* 그냥 글 {n} *", "free_string", "그냥 글 {n}"),
    ("", "number", ""),
    ("없음", "number", "없음"),
]


@query("constrained_answer", golden([(c,) for _, _, c in CONSTRAINED], "form"))
def _(s, d):
    rows = cases(s, d, [c[:2] for c in CONSTRAINED], "answer, kind")
    return rows.select(*LINE_KEY, A.constrained(F.col("answer"), F.col("kind")).alias("form"))


CHOICES = ["일반경쟁입찰", "제한경쟁입찰", "M+5", "90%, 10%"]
MAPPED = [
    ("2번", "제한경쟁입찰"),
    ("정답은 ③", "M+5"),
    ("보기 첫번째", "일반경쟁입찰"),
    ("제한 경쟁 입찰", "제한경쟁입찰"),
    ("2. 제한경쟁입찰", "제한경쟁입찰"),
    ("답은 일반경쟁입찰이 아닌 제한경쟁입찰입니다.", "제한경쟁입찰"),
    ("제한경쟁입찰 또는 일반경쟁입찰", "제한경쟁입찰"),
    ("비율은 90%/10% 이다", "90%, 10%"),
    ("모름 {n}", "모름 {n}"),
    ("", ""),
]


@query("choice_map", golden([(c,) for _, c in MAPPED], "choice"))
def _(s, d):
    rows = cases(s, d, [(a, CHOICES) for a, _ in MAPPED], "answer, choices")
    return rows.select(*LINE_KEY, A.map_choice(F.col("answer"), F.col("choices")).alias("choice"))


PAIRS = [
    ("정량과 정성 비율은?", "정량 {n}점, 정성 80점", -1.0, 80.0, "label_aware_pair"),
    ("정량과 정성 비율은?", "정성은 80이고 정량은 20", 20.0, 80.0, "label_aware_pair"),
    ("기술과 가격 배점은?", "1. 기술평가 90%\n2. 가격평가 10%", 90.0, 10.0, "label_aware_pair"),
    ("각각 얼마인가?", "전 3.5 후 4", 3.5, 4.0, "label_aware_pair"),
    ("비율은?", "80/{n} 입니다", 80.0, -1.0, "explicit_pair_pattern"),
    ("비율은?", "80점, 20점", 80.0, 20.0, "explicit_pair_pattern"),
    ("비율은?", "80 그리고 20", None, None, "slot_pair_extract_fail"),
]


@query("slot_pairs", golden([p[2:] for p in PAIRS], "a, b, how"))
def _(s, d):
    rows = cases(s, d, [p[:2] for p in PAIRS], "question, answer")
    return rows.select(*LINE_KEY, A.slot_pair(F.col("question"), F.col("answer")).alias("p")).select(*LINE_KEY, "p.*")


GUESSES = [
    ("두 사업의 차이는?", "", "", "comparison", "comparison", "factual"),
    ("자격 제한이 없나요", "", "Rejection", "rejection", "factual", "rejection"),
    ("그럼 예산은?", "", "follow_up", "factual", "follow_up", "follow_up"),
    ("실제 낙찰 업체는?", "list_set", "comparison", "factual", "rejection", "comparison"),
    ("항목 목록은?", "list_set", "single_doc", "factual", "table_factual", "factual"),
    ("목적과 항목은?", "slot_pair", None, "factual", "table_plus_text", "factual"),
    ("예산은?", "", "other", "factual", "factual", "factual"),
]


@query("type_guesses", golden([g[3:] for g in GUESSES], "chat, eval, judge"))
def _(s, d):
    rows = cases(s, d, [(f"{{n}} {q}", e, j) for q, e, j, *_ in GUESSES], "question, eval_type, judge_type")
    return rows.select(*LINE_KEY, A.guess_type(F.col("question")).alias("chat"), A.guess_eval_type(F.col("question"), F.col("eval_type")).alias("eval"), A.judge_answer_type(F.col("judge_type")).alias("judge"))


OVERRIDE = "CASE WHEN doc_id % 3 = 0 THEN 'Comparison ' WHEN doc_id % 3 = 1 THEN '' END"


@query(
    "route_override",
    f"WITH r AS (SELECT doc_id, lang AS kind, CASE WHEN trim(lower({OVERRIDE})) <> '' THEN trim(lower({OVERRIDE})) END AS o FROM documents) SELECT doc_id, coalesce(o, kind) AS answer_type, coalesce('route_' || o, 'auto') AS route, CASE WHEN o IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence, coalesce('manual_override:' || o || '; predicted=' || coalesce(kind, ''), '') AS reason, o IS NOT NULL AS override_applied, kind AS predicted FROM r",
)
def _(s, d):
    by = F.when(F.col("doc_id") % 3 == 0, "Comparison ").when(F.col("doc_id") % 3 == 1, "")
    got = A.overridden(F.col("lang"), F.lit("auto"), F.lit(0.5), by, lambda t: F.concat(F.lit("route_"), t))
    return table(s, d, "documents").select("doc_id", got.alias("r")).select("doc_id", "r.*")


@query("virtual_rows", "SELECT doc_id, coalesce(nullif(lang, ''), '') = '' OR doc_id % 4 = 0 AS routed, CASE WHEN doc_id % 4 = 0 THEN 'follow_up' ELSE lower(lang) END AS answer_type, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 THEN '__history__' ELSE '' END AS depends_on FROM documents WHERE lang <> ''")
def _(s, d):
    rows = table(s, d, "documents").where("lang <> ''").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("own"), (F.col("doc_id") % 8 == 0).alias("has_history"), F.array().cast("array<string>").alias("depends_on"))
    return A.virtual_row(rows, "own", F.lit("follow_up")).select("doc_id", "routed", "answer_type", F.array_join("depends_on", "|").alias("depends_on"))


AXES = {"budget": ("cost", "tion"), "scope": ("und", "the ")}


@query("axis_in_answer", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_matches(text, 'cost|tion') ELSE regexp_matches(text, 'und|the ') END AS found FROM conversations WHERE text IS NOT NULL")
def _(s, d):
    slots = F.when(F.col("turn") % 2 == 0, F.array(F.lit("budget"))).otherwise(F.array(F.lit("scope"), F.lit("other")))
    return table(s, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", A.has_axis(F.col("text"), slots, AXES).alias("found"))


@query(
    "reference_snippets",
    r"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]{3,}') AS w, string_split_regex(text, '[0-9]{3,}') AS g FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, i, w[i] AS match, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m)),
c AS (SELECT doc_id, i, match, a, a + length(match) AS b, regexp_replace(regexp_replace(substr(text, CAST(greatest(a - 30, 0) + 1 AS BIGINT), CAST(least(length(text), a + length(match) + 30) - greatest(a - 30, 0) AS BIGINT)), '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g') AS s FROM p),
t AS (SELECT doc_id, i, match, a, b, regexp_replace(regexp_replace(s, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS s FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, match, s ORDER BY i) AS k FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM o WHERE k = 1)
SELECT doc_id, string_agg(CAST(a AS INT) || ':' || CAST(b AS INT) || ':' || md5(match || '|' || s), ',' ORDER BY i) AS found FROM n WHERE rn <= 3 GROUP BY doc_id""",
)
def _(s, d):
    found = A.snippets(F.col("text"), "[0-9]{3,}", 30, 3)
    text = F.transform(found, lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"), F.md5(F.concat_ws("|", m["match"], m["snippet"]).cast("binary"))))
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(text, ",").alias("found")).where("found <> ''")


@query("search_dispatch", f"SELECT 'basic' AS mode, query_id, chunk_id, rank FROM ({ORACLES['vector_topk']}) UNION ALL SELECT 'empty' AS mode, query_id, chunk_id, rank FROM ({ORACLES['bm25_topk']}) UNION ALL SELECT 'hybrid' AS mode, query_id, chunk_id, rank FROM ({ORACLES['hybrid_alpha']})")
def _(s, d):
    """The nearest vectors; vectors and words together; and, with no vectors to search, the lexical list whatever the mode."""
    v, by_words = vectors(s, d), lambda n: lexical(s, d, n)
    asked = v.join(questions(s, d).select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), "embedding")
    found = {"basic": R.search("basic", v, asked20(s, d), by_words, 10), "empty": R.search("mmr", v.where("false"), asked20(s, d), by_words, 5), "hybrid": R.search("hybrid", v, asked, by_words, 5)}
    out = None
    for mode, df in found.items():
        one = df.select(F.lit(mode).alias("mode"), "query_id", "chunk_id", "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "planned_search",
    f"WITH r AS (SELECT query_id, chunk_id, rank, CASE WHEN query_id % 40 = 0 THEN '1' ELSE '' END AS wanted FROM ({ORACLES['vector_topk']})), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS new_rank FROM r WHERE wanted = '' OR contains(CAST(chunk_id AS VARCHAR), wanted)) SELECT query_id, chunk_id, new_rank FROM k WHERE new_rank <= CASE WHEN wanted <> '' THEN 5 ELSE 3 END",
)
def _(s, d):
    plan = asked20(s, d).select("query_id", F.when(F.col("query_id") % 40 == 0, "1").otherwise("").alias("wanted_id"))
    found = R.planned_search(R.vector_top(vectors(s, d), asked20(s, d), 10), plan, "chunk_id")
    return as_long(found.select("query_id", "chunk_id", "new_rank"), "new_rank")


SLOT = "CASE WHEN l_linenumber % 3 = 0 THEN 'budget' WHEN l_linenumber % 3 = 1 THEN 'scope' ELSE 'none' END"


@query("slot_match", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE {SLOT} WHEN 'budget' THEN l_returnflag = 'R' OR contains(l_comment, 'RAIL') OR contains(l_comment, 'AIR') WHEN 'scope' THEN contains(l_comment, 'MAIL') ELSE false END AS hit, CASE WHEN l_shipmode = l_comment THEN 1.0::DOUBLE WHEN l_linestatus = l_returnflag THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, CASE l_suppkey % 4 WHEN 0 THEN 'RAIL' WHEN 1 THEN 'AIR' WHEN 2 THEN 'MAIL' ELSE '' END AS l_comment, CASE l_partkey % 3 WHEN 0 THEN 'RAIL' WHEN 1 THEN '-' ELSE 'MAIL' END AS l_shipmode FROM lineitem)")
def _(s, d):
    text = F.when(F.col("l_suppkey") % 4 == 0, "RAIL").when(F.col("l_suppkey") % 4 == 1, "AIR").when(F.col("l_suppkey") % 4 == 2, "MAIL").otherwise("")
    mode = F.when(F.col("l_partkey") % 3 == 0, "RAIL").when(F.col("l_partkey") % 3 == 1, "-").otherwise("MAIL")
    slot = F.when(F.col("l_linenumber") % 3 == 0, "budget").when(F.col("l_linenumber") % 3 == 1, "scope").otherwise("none")
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", text.alias("t"), mode.alias("m"), slot.alias("slot"))
    hit = R.slot_match(F.col("t"), F.col("slot"), {"budget": ("RAIL", "AIR"), "scope": ("MAIL",)}, {"budget": (F.col("l_returnflag") == "R").cast("int")})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", hit.alias("hit"), R.same_section(F.col("m"), F.col("t"), F.col("l_linestatus"), F.col("l_returnflag")).alias("bonus"))


@query("slot_coverage")
def _(s, d):
    """Six lines for each order: lines are its candidates, by price; shipping flags and parts say which of two slots a line has,
    every third order asks for a table and a body."""
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_extendedprice").alias("price"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    slots = F.array_compact(F.array(F.when(F.col("flag") == "R", 0), F.when(F.col("l_partkey") % 3 == 0, 1)))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("price"), "l_linenumber", "l_partkey"))
    rows = li.select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), place.alias("rank"), slots.alias("slots_hit"), F.lit(2).alias("asked"),
        F.when(F.col("l_orderkey") % 3 == 0, (F.col("l_linenumber") % 2).cast("int")).alias("is_table"), F.col("flag").alias("section_path"), F.col("status").alias("section_title"),
    )
    return R.cover_slots(rows)


MEASURES = "CASE WHEN l_linenumber % 4 > 0 THEN l_discount * 20 END"
FLAG = "CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_suppkey % 2 AS DOUBLE) END"


@query(
    "coverage_summary",
    f"WITH r AS (SELECT l_returnflag AS type_group, CASE WHEN l_linestatus = 'O' THEN 'comparison' ELSE 'factual' END AS answer_type, {MEASURES} AS dual_doc_coverage, {FLAG} AS pair_hit FROM lineitem), "
    f"a AS (SELECT 'overall' AS group_name, * FROM r UNION ALL SELECT type_group, * FROM r UNION ALL SELECT 'answer_type:' || answer_type, * FROM r) "
    f"SELECT group_name, count(*) AS question_count, {mean_sql('dual_doc_coverage')} AS dual_doc_coverage, {mean_sql('pair_hit')} AS pair_hit, count_if(answer_type = 'comparison' AND coalesce(dual_doc_coverage, 0) < 1) AS weak_comparison_count, count_if(pair_hit < 1) AS weak_pair_count FROM a GROUP BY 1",
)
def _(s, d):
    rows = table(s, d, "lineitem").select(
        F.col("l_returnflag").alias("type_group"), F.when(F.col("l_linestatus") == "O", "comparison").otherwise("factual").alias("answer_type"),
        F.when(F.col("l_linenumber") % 4 > 0, F.col("l_discount") * 20).alias("dual_doc_coverage"), F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_suppkey") % 2).cast("double")).alias("pair_hit"),
    )
    return E.coverage_summary(rows, ["dual_doc_coverage", "pair_hit"], [E.COVERAGE_WEAK[0], E.COVERAGE_WEAK[2]])


REFUSES = "cannot|kann ich nicht|no information"


@query(
    "result_rows",
    f"WITH q AS (SELECT conv_id, min_by(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, min_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT conv_id AS question_id, length(answer) AS answer_chars, 'Doc 1 | doc3' AS source_docs, 1.0::DOUBLE AS top1, 0.5::DOUBLE AS rate, CAST(CAST(conv_id AS BIGINT) % 2 = 0 AS INT) AS rejection_expected, CASE WHEN CAST(conv_id AS BIGINT) % 2 = 0 THEN CAST(regexp_matches(lower(answer), '{REFUSES}') AS INT) END AS rejection_success FROM q JOIN a USING (conv_id)",
)
def _(s, d):
    c = table(s, d, "conversations")
    q = c.where("role = 'user'").groupBy(F.col("conv_id").alias("question_id")).agg(F.min_by("text", "turn").alias("question"))
    q = q.withColumns({"answer_type": F.when(F.col("question_id").cast("long") % 2 == 0, " Rejection").otherwise("factual"), "targets": F.array(F.lit("Doc 1"), F.lit("doc 2"))})
    a = c.where("role = 'assistant'").groupBy(F.col("conv_id").alias("question_id")).agg(F.min_by("text", "turn").alias("answer_text"))
    a = a.withColumns({"elapsed_sec": F.lit(1.234), "sources": F.array(F.lit("Doc 1"), F.lit("doc3")), "route": F.lit("r"), "model_key": F.lit("m")})
    rows = E.result_rows(a, q, REFUSES)
    return rows.select("question_id", "answer_chars", "source_docs", F.col("hits")["top1"].alias("top1"), F.col("hits")["rate"].alias("rate"), "rejection_expected", "rejection_success")


@query(
    "representative_cases",
    "WITH c AS (SELECT user_id, event_id, unnest(list_filter([CASE WHEN event_type = 'error' THEN 'failed' END, CASE WHEN value > 50 THEN 'large' END], lambda x: x IS NOT NULL)) AS category FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY category, user_id ORDER BY event_id) AS k FROM c) SELECT category, event_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY event_id) AS rn FROM o WHERE k = 1) WHERE rn <= 3",
)
def _(s, d):
    rules = {"failed": F.col("event_type") == "error", "large": F.col("value") > 50}
    return E.representative_cases(table(s, d, "events"), rules, ["user_id"], [F.asc("event_id")]).select("category", "event_id")


@query("group_hits", "SELECT CASE WHEN event_type = 'click' THEN 'final_review' ELSE 'discarded' END AS side, unnest(['a', 'b']) AS group_name, unnest([sum(user_id % 3), sum(user_id % 5)])::BIGINT AS hits FROM events GROUP BY 1")
def _(s, d):
    hits = F.create_map(F.lit("a"), F.col("user_id") % 3, F.lit("b"), F.col("user_id") % 5)
    rows = table(s, d, "events").select(F.when(F.col("event_type") == "click", "final_review_table").otherwise("discarded_table").alias("kind"), hits.alias("hits"))
    return E.group_hits(rows, "kind", "hits")


@query(
    "variant_deltas",
    f"WITH m AS (SELECT event_type AS variant, {mean_sql('value')} AS score FROM events GROUP BY 1) SELECT variant, score, round(score - (SELECT score FROM m WHERE variant = 'click'), 4) AS delta_score_vs_click, round(score - (SELECT score FROM m WHERE variant = 'error'), 4) AS delta_score_vs_error FROM m",
)
def _(s, d):
    m = table(s, d, "events").groupBy(F.col("event_type").alias("variant")).agg(E.exact_mean(F.col("value")).alias("score"))
    return E.variant_deltas(m, "variant", ["score"], {"click": "vs_click", "error": "vs_error"})


@query("ids_by_group", "SELECT lower(lang) AS group_label, doc_id FROM documents WHERE lower(lang) IN ('en', 'fr')")
def _(s, d):
    return E.ids_by_group(table(s, d, "documents"), "doc_id", "lang", ["en", "fr"])


@query(
    "question_rows",
    "SELECT CASE WHEN event_id % 3 = 0 THEN 'CSVQ' || printf('%03d', event_id) ELSE 'q' || event_id END AS question_id, CAST(CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id + 7 END AS INT) AS question_index, CASE WHEN event_id % 5 > 0 THEN CAST(event_id % 5 AS DOUBLE) END AS turn_index, CASE WHEN event_id % 4 = 0 THEN 'a|b' ELSE '' END AS parents FROM events WHERE event_id > 0",
)
def _(s, d):
    from .. import sources as S

    k = F.col("event_id")
    rows = table(s, d, "events").where("event_id > 0").select(
        k.alias("line_no"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("q"), k.cast("string"))).alias("question_id"), F.when(k % 2 == 1, k + 7).alias("question_index"),
        F.when(k % 5 == 0, "x").otherwise((k % 5).cast("string")).alias("turn_index"), F.when(k % 4 == 0, "a, -,b").otherwise("-").alias("depends_on"),
    )
    return S.question_rows(rows).select("question_id", "question_index", "turn_index", F.array_join("depends_on_list", "|").alias("parents"))


FILES = [("/a/{n}.HWP", "hwp", None), ("c{n}.pdf", "pdf", None), ("/x.y/name{n}", None, "Unsupported file format: unknown"), ("z.tar.g{n}", None, "Unsupported file format: .g{n}"), (".hwp", None, "Unsupported file format: unknown")]


@query("format_dispatch", golden([f[1:] for f in FILES], "format, error"))
def _(s, d):
    from .. import sources as S

    return S.dispatch(cases(s, d, [f[:1] for f in FILES], "path")).select(*LINE_KEY, "format", "error")
