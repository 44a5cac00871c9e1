"""Queries on tables and images of documents. A document's text stands behind one of a dozen Korean blocks, under every
combination of row hints and paragraphs, as the given texts hold none; sizes and scores come from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artifacts as A
from ..registry import query, table

BLOCKS = (
    "목차\n1. 추진개요\n2. 추진방안\n3. 추진내용\n별지서식",
    "제안요청서\n용역사업\n사업명: 포털 구축\n2025. 3.\n한국재단",
    "구분 항목 내용 비고\n1 서버 2 100\n2 저장소 3 200\n합계 금액 300",
    "요구 사항 ID 요구사항 명칭\n배점 10\n평가 기준 20\n평가항목 5",
    "□ 본 사업은 공공 업무의 효율을 높이기 위하여 추진하는 것으로 여러 기관이 함께 참여하여 수행한다\n○ 두 번째 설명 문장은 충분히 길어서 마흔 자를 넘기도록 쓰여 있으며 별다른 항목을 담고 있지 않다\n끝",
    "추진목표\n추진과제\n추진일정\n→ 신청 → 보고 → 결과 → 조회",
    "업체명\n대표자\n주소\n전화번호\n제출서류 목록 제출",
    "일정 기간 비고\n예산 금액 합계\n수량 단가 금액 12",
    "대상업체 참가자격 매출액 사업금액\nPM 부문 담당 부서\n상용SW 버전 서버 DB",
    "사업개요 사업명 사업기간 소요예산\n계약방식",
    "plain words without a table",
    "",
    "\u00a0목차\u3000\r1. 구분\x0b ①\u3000항목\u2028\t□\u00a0내용\r\n②\n③ 비고 수\u3000량\u00a0단가",
    "\u3000○ 일정 ⑴\x1e\t○ 기간 ❷\u2029예\u00a0산 금\u3000액 ₃\x85합계 ⒋ ⑩",
)
ROWS, PARAGRAPHS = (0, 3, 5, 6, 8, 9), (2, 3, 4, 6)


def _words(ws) -> str:
    return "[" + ", ".join(f"'{''.join(w.split())}'" for w in ws) + "]"


def _raw(ws) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


def _hits(ws) -> str:
    return f"list_sum(list_transform({_raw(ws)}, lambda k: greatest((length(text) - length(replace(text, k, ''))) // length(k), (length(c) - length(replace(c, replace(k, ' ', ''), ''))) // length(replace(k, ' ', '')))))"


def _held(ws) -> str:
    return f"len(list_filter({_words(ws)}, lambda k: contains(c, k)))"


WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TIDY = f"regexp_replace(x, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"
BEHIND = f"""SELECT doc_id AS id, [{', '.join("'" + b + "'" for b in BLOCKS)}][doc_id % {len(BLOCKS)} + 1] || chr(10) || replace(coalesce(text, ''), chr(10), ' ') AS text, {list(ROWS)}[doc_id // {len(BLOCKS)} % {len(ROWS)} + 1] AS r, {list(PARAGRAPHS)}[doc_id // {len(BLOCKS) * len(ROWS)} % {len(PARAGRAPHS)} + 1] AS p FROM documents"""
GROUPS = "{" + ", ".join(f"'{k}': {_held(w)}" for k, w in A.FIELD_GROUPS.items()) + "}"
ACTIVE = " + ".join(f"CAST(g.{k} > 0 AS INT)" for k in A.FIELD_GROUPS)
TOTAL = " + ".join(f"g.{k}" for k in A.FIELD_GROUPS)
STRONGEST = "greatest(" + ", ".join(f"g.{k}" for k in A.FIELD_GROUPS) + ")"
FEATURES = f"""b AS (SELECT id, text, r, p, regexp_replace(text, '[{WHITE}]', '', 'g') AS c, list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n-\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {TIDY}), lambda x: x <> '') AS l FROM ({BEHIND})),
f AS (SELECT *, {GROUPS} AS g, {_hits(A.TOC_WORDS)} AS toc0, {_hits(A.COVER_WORDS)} AS cover0, {_hits(A.DATA_WORDS)} AS data0, {_held(A.HEADER_WORDS)} AS headers, greatest({', '.join(_held(g) for g in A.HEADER_GROUPS)}) AS hg,
 {_held(A.LABEL_WORDS)} AS labels, {_held(A.OVERVIEW_WORDS)} AS overview, len(list_filter({_raw(A.STACKED_LABELS)}, lambda k: contains(regexp_replace(array_to_string(l[1:3], ''), '[{WHITE}]', '', 'g'), k))) > 0 AS stacked,
 len(list_filter(l, lambda x: regexp_matches(x, '^([ⅠⅡⅢⅣⅤ]|[1-9])\\.'))) AS outline, len(list_filter(l, lambda x: regexp_matches(x, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]'))) AS numeric_lines, len(list_filter(l, lambda x: x[1] IN ('□', '○', '-', '◈', '※', 'ㆍ'))) AS bullets,
 len(list_filter(l, lambda x: length(x) >= 40)) AS long_lines, len(list_filter(l, lambda x: length(x) <= 12)) AS short_lines, len(list_filter(l, lambda x: contains(x, '→') OR contains(x, '->'))) AS arrows FROM b),
s AS (SELECT *, toc0 + CASE WHEN outline >= 3 THEN 2 ELSE 0 END + CASE WHEN list_has_any(l, ['목차', '차례']) THEN 3 ELSE 0 END AS toc,
 cover0 + CASE WHEN p <= 4 AND r <= 5 AND contains(c, '제안요청서') THEN 2 ELSE 0 END + CASE WHEN p <= 4 AND len(list_filter(l, lambda x: regexp_matches(x, '202[456]\\.'))) > 0 THEN 1 ELSE 0 END AS cover,
 data0 + CASE WHEN r >= 3 THEN 1 ELSE 0 END + CASE WHEN numeric_lines >= greatest(3, len(l) // 2) THEN 1 ELSE 0 END + CASE WHEN {_held(('구분', '항목', '내용', '비고'))} > 0 THEN 2 ELSE 0 END AS data,
 {ACTIVE} AS active, {TOTAL} AS total, {STRONGEST} AS strongest, bullets >= 2 AND long_lines >= 2 AND headers < 2 AS prose FROM f),
k AS (SELECT *, CASE WHEN toc >= 4 THEN 'toc' WHEN cover >= 4 AND data <= 3 THEN 'cover' WHEN r >= 5 AND p >= 4 AND hg >= 3 AND data >= 4 AND NOT prose THEN 'sure_table' WHEN r >= 3 AND p >= 3 AND hg >= 2 AND data >= 4 THEN 'review_needed'
 WHEN r >= 5 AND p >= 4 AND hg >= 1 AND data >= 3 AND (active >= 2 OR strongest >= 3) AND NOT prose THEN 'review_needed' WHEN r >= 8 AND p >= 6 AND active >= 2 AND data >= 3 AND NOT prose THEN 'review_needed' ELSE 'uncertain' END AS kind FROM s),
m AS (SELECT *, list_filter([
 CASE WHEN r >= 5 AND data >= 4 AND hg < 2 THEN 'weak_header_match' END, CASE WHEN short_lines >= 3 AND labels >= 1 OR stacked THEN 'left_label_column_pattern' END, CASE WHEN r >= 6 AND (arrows >= 1 OR labels >= 2 OR stacked) THEN 'box_layout_like' END,
 CASE WHEN total >= 6 AND active >= 2 THEN 'important_field_block' END, CASE WHEN g.system_map >= 4 THEN 'system_map_like' END,
 CASE WHEN (contains(c, '제도안내') OR contains(c, '신청방법') OR contains(c, '결과') AND contains(c, '보고')) AND g.system_map >= 2 THEN 'menu_flow_like' END, CASE WHEN g.form_fields >= 3 THEN 'form_field_like' END,
 CASE WHEN r >= 5 AND (g.form_fields >= 2 OR g.schedule_amount >= 2 OR g.requirements_eval >= 2 OR g.roles_org >= 2) THEN 'field_value_table_like' END, CASE WHEN contains(c, '제출서류') AND (contains(c, '목록') OR contains(c, '제출')) AND short_lines >= 4 THEN 'submission_list_like' END,
 CASE WHEN overview >= 3 THEN 'project_overview_like' END, CASE WHEN g.schedule_amount >= 3 AND r >= 3 THEN 'schedule_amount_like' END,
 CASE WHEN (contains(c, '대상업체') OR contains(c, '참가자격')) AND (contains(c, '사업금액') OR contains(c, '매출액')) THEN 'eligibility_threshold_like' END, CASE WHEN g.software_stack >= 3 AND r >= 3 THEN 'software_stack_like' END,
 CASE WHEN (contains(c, 'PM') OR contains(c, '사업관리자')) AND contains(c, '부문') THEN 'staffing_plan_like' END, CASE WHEN bullets >= 2 AND long_lines >= 2 AND hg < 2 AND labels = 0 AND total < 6 AND overview < 3 THEN 'explanatory_block' END,
 CASE WHEN kind = 'review_needed' AND hg >= 2 AND r >= 5 THEN 'promotable_review_table' END], lambda x: x IS NOT NULL) AS signals FROM k),
n AS (SELECT *, coalesce(list_sum(list_transform(signals, lambda x: CASE x WHEN 'explanatory_block' THEN -2 WHEN 'promotable_review_table' THEN 1 ELSE 2 END)), 0) AS bonus, list_contains(signals, 'explanatory_block') AS explains FROM m),
z AS (SELECT *, CASE WHEN kind IN ('cover', 'toc') THEN kind WHEN kind = 'sure_table' THEN 'final_sure_table' WHEN explains THEN 'explanatory_block' WHEN kind = 'review_needed' THEN CASE WHEN bonus >= 1 THEN 'final_sure_table' ELSE 'final_review_table' END
 WHEN bonus >= 2 AND len(list_filter(signals, lambda x: x <> 'promotable_review_table')) > 0 THEN 'final_review_table' ELSE 'discarded_table' END AS final FROM n),
o AS (SELECT *, CASE WHEN final IN ('final_sure_table', 'final_review_table') THEN 'structural_table' WHEN final = 'explanatory_block' THEN final WHEN final IN ('cover', 'toc') THEN 'excluded' ELSE 'discarded' END AS bucket FROM z)"""


def blocks(s, d):
    k = F.col("doc_id")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (F.floor(i) % len(values) + 1).cast("int"))
    text = F.concat(pick(BLOCKS, k), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = table(s, d, "documents").select(k.alias("id"), text.alias("text"), pick(ROWS, k / len(BLOCKS)).alias("row_hints"), pick(PARAGRAPHS, k / (len(BLOCKS) * len(ROWS))).alias("paragraphs"))
    return A.first_pass(A.block_features(rows))


def passed(s, d):
    rows = A.missing_signals(blocks(s, d))
    rows = rows.withColumn("final", A.second_pass(F.col("first.kind"), F.col("signals"), F.col("bonus")))
    return rows.withColumn("bucket", A.storage_bucket(F.col("final")))


@query("table_first_pass", f"WITH {FEATURES} SELECT id, r AS row_hints, p AS paragraphs, kind, CAST(toc AS INT) AS toc, CAST(cover AS INT) AS cover, CAST(data AS INT) AS data, CAST(hg AS INT) AS header_group FROM k")
def _(s, d):
    return blocks(s, d).select("id", "row_hints", "paragraphs", "first.*")


@query("missing_signals", f"WITH {FEATURES} SELECT id, r AS row_hints, p AS paragraphs, array_to_string(signals, '|') AS signals, CAST(bonus AS INT) AS bonus FROM n")
def _(s, d):
    return A.missing_signals(blocks(s, d)).select("id", "row_hints", "paragraphs", F.array_join("signals", "|").alias("signals"), F.col("bonus").cast("int").alias("bonus"))


@query("table_second_pass", f"WITH {FEATURES} SELECT id, r AS row_hints, p AS paragraphs, final, bucket FROM o")
def _(s, d):
    return passed(s, d).select("id", "row_hints", "paragraphs", "final", "bucket")


SCORE = """CASE WHEN bucket <> 'structural_table' THEN 0 ELSE CASE WHEN final = 'final_review_table' THEN 4 ELSE 1 END + CASE WHEN hg <= 1 AND r >= 5 THEN 3 WHEN hg = 2 AND r >= 5 THEN 1 ELSE 0 END
 + coalesce(list_sum(list_transform(signals, lambda x: CASE WHEN x IN ('box_layout_like', 'menu_flow_like') THEN 3 WHEN x IN ('weak_header_match', 'left_label_column_pattern', 'field_value_table_like', 'schedule_amount_like', 'submission_list_like', 'project_overview_like', 'software_stack_like', 'staffing_plan_like', 'eligibility_threshold_like') THEN 2 ELSE 0 END)), 0)
 + CASE WHEN p >= 4 THEN 1 ELSE 0 END + CASE WHEN length(text) >= 300 THEN 1 ELSE 0 END END"""


@query("table_ocr_scores", f"WITH {FEATURES}, q AS (SELECT *, {SCORE} AS score FROM o) SELECT id, r AS row_hints, p AS paragraphs, CAST(score AS INT) AS score, CASE WHEN score >= 8 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS priority FROM q")
def _(s, d):
    parent = F.when(F.col("paragraphs") >= 4, "section")
    score = A.table_ocr_score(F.col("bucket"), F.col("final"), F.col("first.header_group"), F.col("row_hints"), F.col("signals"), parent, F.length("text"))
    return passed(s, d).withColumn("score", score.cast("int")).select("id", "row_hints", "paragraphs", "score", A.priority(F.col("score")).alias("priority"))


KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
IMAGES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice * 10 AS BIGINT) AS size, CASE l_returnflag WHEN 'R' THEN 'png' WHEN 'A' THEN 'gif' ELSE 'jpg' END AS ext, CASE WHEN l_linenumber % 2 = 0 THEN 'BIN001' ELSE 'logo' END AS name FROM lineitem"
ISCORE = "CASE WHEN size >= 300000 THEN 5 WHEN size >= 100000 THEN 3 WHEN size >= 30000 THEN 1 ELSE 0 END + CASE WHEN ext IN ('png', 'jpg') THEN 1 ELSE 0 END + CASE WHEN name = 'BIN001' THEN 1 ELSE 0 END"


def images(s, d):
    size = (F.col("l_extendedprice") * 10).cast("decimal(20,0)").cast("long")
    ext = F.when(F.col("l_returnflag") == "R", "png").when(F.col("l_returnflag") == "A", "gif").otherwise("jpg")
    name = F.when(F.col("l_linenumber") % 2 == 0, "BIN001").otherwise("logo")
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", size.alias("size"), ext.alias("ext"), name.alias("name"))
    return rows.withColumn("score", A.image_ocr_score(F.col("name"), F.col("ext"), F.col("size")))


@query("image_ocr_scores", f"SELECT score, CASE WHEN score >= 8 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS priority, CAST(CASE WHEN score >= 8 THEN 0.85 WHEN score >= 4 THEN 0.65 ELSE 0.45 END AS DOUBLE) AS confidence, count(*) AS n FROM (SELECT CAST({ISCORE} AS INT) AS score FROM ({IMAGES})) GROUP BY ALL")
def _(s, d):
    level = A.priority(F.col("score"))
    return images(s, d).groupBy(F.col("score").cast("int").alias("score"), level.alias("priority"), A.image_confidence(level).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("top_images", f"SELECT l_orderkey, k AS image, CAST(score AS INT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, k) AS rank FROM (SELECT l_orderkey, l_linenumber || ':' || l_partkey || ':' || l_suppkey AS k, {ISCORE} AS score FROM ({IMAGES}))) WHERE rank <= 2")
def _(s, d):
    rows = images(s, d).withColumn("image", F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey"))
    return A.top_images(rows, "l_orderkey", "score", "image", 2).select("l_orderkey", "image", F.col("score").cast("int").alias("score"), F.col("rank").cast("long").alias("rank"))


LINE = "SELECT l_orderkey AS doc, CAST(l_partkey % 5 AS INT) AS table_index, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS place, CASE l_returnflag WHEN 'R' THEN 'section_header_block' WHEN 'A' THEN 'structural_table' ELSE 'discarded' END AS bucket, CASE WHEN l_linestatus = 'O' THEN 'final_review_table' ELSE 'final_sure_table' END AS final, CAST(l_suppkey % 9 AS INT) AS score FROM lineitem"


def staged(s, d):
    bucket = F.when(F.col("l_returnflag") == "R", "section_header_block").when(F.col("l_returnflag") == "A", "structural_table").otherwise("discarded")
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 5).cast("int").alias("table_index"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("place"), bucket.alias("bucket"),
        F.when(F.col("l_linestatus") == "O", "final_review_table").otherwise("final_sure_table").alias("final"), (F.col("l_suppkey") % 9).cast("int").alias("score"),
    )


@query("structural_selection", f"SELECT doc, table_index, place FROM (SELECT *, row_number() OVER (PARTITION BY doc, table_index ORDER BY place) AS rn FROM ({LINE}) WHERE bucket = 'section_header_block' OR bucket = 'structural_table' AND (final = 'final_review_table' OR score >= 4)) WHERE rn = 1")
def _(s, d):
    return A.structural_tables(staged(s, d), "doc", "table_index", "place").select("doc", "table_index", "place")


@query("artifact_buckets", f"SELECT table_index, count(*) AS table_count, count_if(final = 'final_sure_table') AS sure, count_if(final = 'final_review_table') AS review, count_if(bucket = 'structural_table') AS structural, count_if(bucket = 'structural_table' AND score >= 4) AS candidates FROM ({LINE}) GROUP BY 1")
def _(s, d):
    c = A.bucket_counts(staged(s, d).withColumn("first", F.lit("uncertain")), ["table_index"], "first", "final", "bucket", "score")
    return c.select("table_index", "table_count", F.col("final_sure_table_count").alias("sure"), F.col("final_review_table_count").alias("review"), F.col("structural_table_count").alias("structural"), F.col("ocr_candidate_count").alias("candidates"))


@query("table_visual_filter", "SELECT page, row_count, col_count, place FROM (SELECT *, row_number() OVER (PARTITION BY page, row_count, col_count, box ORDER BY place) AS rn FROM (SELECT l_suppkey AS page, CAST(l_quantity % 6 AS INT) AS row_count, CAST(l_linenumber % 4 AS INT) AS col_count, l_discount AS area, CAST(l_partkey % 60 AS INT) AS len, round(l_tax * 100 / 3.0::DOUBLE, 0) AS box, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS place FROM lineitem) WHERE row_count >= 2 AND col_count >= 2 AND area >= 0.01 AND len >= 20) WHERE rn = 1")
def _(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_quantity") % 6).cast("int").alias("row_count"), (F.col("l_linenumber") % 4).cast("int").alias("col_count"), F.col("l_discount").alias("area"), (F.col("l_partkey") % 60).cast("int").alias("len"), (F.col("l_tax") * 100 / 3.0).alias("x"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("place"))
    keep = A.table_keep(F.col("row_count"), F.col("col_count"), F.col("area"), F.col("len"))
    return A.visual_filter(rows, keep, [F.col("page"), F.col("row_count"), F.col("col_count"), F.round("x", 0)], "place").select("page", "row_count", "col_count", "place")


VISUAL = "greatest(0, CASE WHEN regexp_matches(text, '(?i)table') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)the') THEN 2 ELSE 0 END + CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END + CASE WHEN lang = 'de' THEN 1 ELSE 0 END + least(2, CAST(doc_id % 4 AS INT)) + least(2, CAST(doc_id % 3 AS INT)) - CASE WHEN regexp_matches(text, '(?i)und') THEN 2 ELSE 0 END)"


@query("visual_scores", f"SELECT doc_id, CAST(score AS INT) AS score, CASE WHEN score >= 5 THEN 'ocr_priority_then_manual_check' WHEN score >= 3 THEN 'ocr_if_user_asks_visual_detail' ELSE 'keep_marker_only' END AS action, score >= 4 AS queued FROM (SELECT doc_id, {VISUAL} AS score FROM documents)")
def _(s, d):
    score = A.visual_score(F.col("text"), ["table", "the"], ["und"], (F.col("n_chars") > 2000).cast("int"), (F.col("lang") == "de").cast("int"), (F.col("doc_id") % 4).cast("int"), (F.col("doc_id") % 3).cast("int"))
    rows = table(s, d, "documents").select("doc_id", score.cast("int").alias("score"))
    return rows.select("doc_id", "score", A.visual_action(F.col("score")).alias("action"), (F.col("score") >= 4).alias("queued"))


@query(
    "rag_ready_text",
    "WITH t AS (SELECT conv_id, list('[TABLE BLOCK][source=' || role || '][page=' || turn || ']' || chr(10) || text ORDER BY turn) AS b FROM conversations WHERE role = 'assistant' GROUP BY conv_id), u AS (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, md5(text || chr(10) || chr(10) || array_to_string(b[1:3], chr(10) || chr(10))) AS digest FROM u JOIN t USING (conv_id)",
)
def _(s, d):
    c = table(s, d, "conversations")
    t = c.where("role = 'assistant'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("source"), x["turn"].alias("page"), x["text"].alias("markdown"))).alias("tables"))
    u = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return u.join(t, "conv_id").select("conv_id", F.md5(A.rag_text(F.col("text"), F.col("tables")).cast("binary")).alias("digest"))


@query(
    "ocr_chunks",
    "SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[SOURCE] ' || conv_id || chr(10) || '[TABLE_INDEX] ' || turn || chr(10) || CASE WHEN turn > 0 THEN '[SECTION_HEADER] part' || chr(10) ELSE '' END || '[STRUCTURAL_TABLE]' || chr(10) || text ELSE '[SOURCE] ' || conv_id || chr(10) || '[IMAGE_NAME] ' || turn || chr(10) || '[IMAGE_OCR]' || chr(10) || text END AS content FROM (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, role, trim(text) AS text FROM conversations) WHERE text <> ''",
)
def _(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", F.trim("text").alias("text")).where("text <> ''")
    source, at = F.col("conv_id"), F.col("turn").cast("string")
    chunk = F.when(F.col("role") == "user", A.table_chunk(source, F.col("turn"), F.when(F.col("turn") > 0, "part"), F.lit(None).cast("string"), F.col("text"))).otherwise(A.image_chunk(source, at, F.col("text")))
    return c.select("conv_id", "turn", chunk.alias("content"))


@query("corpus_records", "SELECT doc_id, CASE WHEN source <> 'web' AND doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang WHEN doc_id % 2 = 1 THEN 'mixed' ELSE 'body' END AS extracted_from, CASE WHEN doc_id % 5 = 0 THEN 'typed' WHEN source <> 'web' AND doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN lang WHEN doc_id % 2 = 1 THEN 'mixed' ELSE 'body' END AS chunk_type FROM documents WHERE source <> '' AND lang <> ''")
def _(s, d):
    k, n = F.col("doc_id"), F.lit(None).cast("string")
    own = F.when((F.col("source") != "web") & (k % 3 == 0), F.col("source")).otherwise("")
    record = A.corpus_record(own, F.when(k % 3 == 1, F.col("lang")), F.when(k % 5 == 0, "typed"), n, k % 2)
    return table(s, d, "documents").where("source <> '' AND lang <> ''").select("doc_id", record.alias("r")).select("doc_id", "r.*")


SHORTLISTS = (
    "# list\n- 구조표로 다시 볼 우선 후보: `12`, `3`, `12`\n- 설명문/제목 블록: `99`\n",
    "table_index `7` and table_index 5\n구조표로 다시 볼 우선 후보: none\n## next `4`",
    "nothing",
)


@query("discarded_indexes", "SELECT doc_id, replace(['3|12', '5|7', ''][doc_id % 3 + 1], '7', CAST(1000 + n_chars AS VARCHAR)) AS indexes FROM documents")
def _(s, d):
    """Shortlists that name a document's length as an index, before its text."""
    listed = F.element_at(F.array(*map(F.lit, SHORTLISTS)), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat(F.replace(listed, F.lit("`7`"), F.concat(F.lit("`"), (F.col("n_chars") + 1000).cast("string"), F.lit("`"))), F.lit("\n## text\n"), F.coalesce("text", F.lit("")))
    found = F.array_join(F.transform(A.discarded_indexes(text), lambda x: x.cast("string")), "|")
    return table(s, d, "documents").select("doc_id", found.alias("indexes"))


TABLE20 = "SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS table_id, l_discount AS recovery, CAST(l_quantity AS INT) AS row_count, l_linenumber AS col_count, l_tax AS area FROM lineitem"


@query("recovery_report", " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sorted_by, table_id, recovery, row_count FROM ({TABLE20}) ORDER BY {by}, table_id LIMIT 20)" for name, by in (("recovery", "recovery DESC"), ("rows", "row_count DESC, col_count DESC"), ("area", "area DESC"))))
def _(s, d):
    """The first twenty tables in each of the three orders."""
    t = F.struct((F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("table_id"), F.col("l_discount").alias("recovery"), F.col("l_quantity").cast("int").alias("row_count"), F.col("l_linenumber").alias("col_count"), F.col("l_tax").alias("area"))
    pages = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(t).alias("tables"))
    out = None
    for order in ("recovery", "rows", "area"):
        one = A.recovery_report(pages, "tables", order, 20).select(F.lit(order).alias("sorted_by"), "table_id", "recovery", "row_count")
        out = one if out is None else out.unionByName(one)
    return out


@query("image_visual_filter", "SELECT page, width, height, place FROM (SELECT *, row_number() OVER (PARTITION BY page, width, height, box ORDER BY place) AS rn FROM (SELECT l_suppkey AS page, CAST(l_quantity * 4 AS INT) AS width, CAST(l_linenumber * 30 AS INT) AS height, l_discount AS area, round(l_tax * 100 / 3.0::DOUBLE, 0) AS box, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS place FROM lineitem) WHERE width >= 80 AND height >= 80 AND area >= 0.01) WHERE rn = 1")
def _(s, d):
    """Images of 80 pixels and a hundredth of the page, each size and place of a page once."""
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_quantity") * 4).cast("int").alias("width"), (F.col("l_linenumber") * 30).cast("int").alias("height"), F.col("l_discount").alias("area"), (F.col("l_tax") * 100 / 3.0).alias("x"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("place"))
    keep = A.image_keep(F.col("width"), F.col("height"), F.col("area"))
    return A.visual_filter(rows, keep, [F.col("page"), F.col("width"), F.col("height"), F.round("x", 0)], "place").select("page", "width", "height", "place")


@query("ocr_payload", f"WITH t AS (SELECT doc, list(place ORDER BY table_index, place) AS p FROM ({LINE}) WHERE bucket = 'structural_table' AND score >= 4 GROUP BY doc), i AS (SELECT l_orderkey AS doc, count(*) AS n FROM ({IMAGES}) WHERE {ISCORE} >= 4 GROUP BY 1) SELECT doc, coalesce(len(p), 0)::INT AS table_count, coalesce(n, 0)::INT AS image_count, coalesce(p[1], 0) AS first_table FROM t FULL JOIN i USING (doc)")
def _(s, d):
    tables = staged(s, d).where("bucket = 'structural_table' AND score >= 4").select("doc", "table_index", "place", "score")
    found = images(s, d).where("score >= 4").select(F.col("l_orderkey").alias("doc"), "name", "ext", "size", "score")
    p = A.ocr_payload(tables, found, "doc")
    return p.select("doc", "table_count", "image_count", F.coalesce(F.try_element_at("table_candidates", F.lit(1))["place"], F.lit(0)).alias("first_table"))


FIRST = f"(list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n-\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {TIDY}), lambda x: x <> ''))[1]"
LINKED = "CASE WHEN doc_id % 3 = 0 THEN lang || ' part' END"


@query(
    "artifact_rows",
    f"""WITH d AS (SELECT doc_id, text, source, doc_id % 50 AS table_index, CASE WHEN contains(text, '|') THEN 'table' ELSE 'box' END AS kind, coalesce({FIRST}, '') AS first, coalesce({LINKED}, coalesce({FIRST}, '')) AS label, CAST((length(text) + 2999) // 3000 AS BIGINT) AS n FROM documents WHERE length(text) > 0),
p AS (SELECT *, unnest(range(1, n + 1)) AS i FROM d), t AS (SELECT *, regexp_replace(substr(text, (i - 1) * 3000 + 1, 3000), '^[{WHITE}]+|[{WHITE}]+$', '', 'g') AS body FROM p),
w AS (SELECT *, '[HEAD]' || chr(10) || '- source: ' || coalesce(source, '') || chr(10) || '- section: ' || label || chr(10) || '- type: ' || kind || chr(10) || '[/HEAD]' || chr(10) || '[BODY]' || chr(10) || body || chr(10) || '[/BODY]' AS whole FROM t)
SELECT doc_id, 'aug_' || doc_id || '_' || kind || '_' || lpad(CAST(table_index AS VARCHAR), 4, '0') || CASE WHEN n > 1 THEN '_p' || lpad(CAST(i AS VARCHAR), 2, '0') ELSE '' END AS chunk_id, CAST(i AS INT) AS part_index, CAST(n AS INT) AS part_count, md5(label) AS label, md5(first) AS title, CAST(kind = 'table' AS INT) AS is_high_priority, CAST(length(whole) AS INT) AS chars, md5(whole) AS digest, CAST(regexp_matches(whole, '[0-9]{{3}}') AS INT) AS has_number_signal FROM w""",
)
def _(s, d):
    """Every document as a table of parts of 3000 characters."""
    k, text = F.col("doc_id"), F.col("text")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.length(text) / 3000).cast("int") - 1), lambda i: F.substring(text, i * 3000 + 1, F.lit(3000)))
    docs = table(s, d, "documents").where("length(text) > 0").withColumn("table_index", k % 50).withColumn("parent", F.when(k % 3 == 0, F.concat("lang", F.lit(" part"))))
    kind = F.when(text.contains("|"), "table").otherwise("box")
    rows = A.artifact_rows(docs, "doc_id", "table_index", parts, stage="AUG", kind=kind, text="text", parent="parent", high_priority=kind == "table", facts={"source": F.col("source")}, signals={"number": "[0-9]{3}"})
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return rows.select("doc_id", "chunk_id", "part_index", "part_count", md5("section_label").alias("label"), md5("item_title").alias("title"), "is_high_priority", "chars", md5("text").alias("digest"), "has_number_signal")
