"""Tables and images taken from documents: first classification, signals, second pass, OCR candidates and their texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DIGITS, WHITE, stripped, text_lines

# Words of contents pages, covers, data tables and table headers, groups of headers and of fields.
TOC_WORDS = ("목차", "차례", "추진개요", "추진방안", "추진내용", "입찰관련사항", "제안요청내용", "제안서작성요령", "별지서식", "붙임")
COVER_WORDS = ("제안요청서", "제안서", "용역사업", "사업명", "사업개요", "재단", "협회", "공사", "대학교", "주식회사")
DATA_WORDS = ("구분", "항목", "내용", "비고", "금액", "예산", "평가", "배점", "일정", "기간", "제출", "자격", "요구사항", "기능", "수량", "단가", "합계")
HEADER_WORDS = ("구분", "항목", "내용", "비고", "금액", "배점", "평가기준", "요구사항", "요구사항 ID", "요구사항 명칭", "수량", "단가", "합계")
HEADER_GROUPS = (
    ("구분", "항목", "내용"),
    ("구분", "내용", "비고"),
    ("요구사항", "ID", "명칭"),
    ("요구사항", "분류", "명칭"),
    ("평가", "배점", "기준"),
    ("평가항목", "배점", "평가기준"),
    ("일정", "기간", "비고"),
    ("예산", "금액", "합계"),
    ("수량", "단가", "금액"),
    ("구분", "역할", "비고"),
    ("번호", "보안약점", "설명"),
    ("구분", "항목", "적용계획"),
    ("적용계획", "미적용", "사유"),
)
FIELD_GROUPS = {
    "basic_headers": ("구분", "항목", "내용", "비고"),
    "requirements_eval": ("요구사항", "평가", "배점", "기준", "평가기준"),
    "schedule_amount": ("일정", "기간", "예산", "금액", "합계", "수량", "단가"),
    "form_fields": ("업체명", "대표자", "주소", "전화번호", "접수번호", "처리일", "제출서류"),
    "roles_org": ("역할", "담당", "부서", "책임자", "PM"),
    "system_map": ("신청", "보고", "결과", "조회", "자료실", "통계", "출력", "완료", "보류"),
    "software_stack": ("상용SW", "버전", "서버", "DB", "검색엔진", "프레임워크", "WAS"),
    "security_plan": ("보안약점", "적용계획", "미적용", "사유", "인증", "암호화"),
}
LABEL_WORDS = ("대민사이트", "BackOffice", "추가사항", "추진목표", "추진과제", "추진일정", "추진체계", "역할", "구분")
STACKED_LABELS = ("추진목표", "추진과제", "추진일정", "추진체계및역할", "추진체계")
OVERVIEW_WORDS = ("사업개요", "사업명", "사업기간", "소요예산", "계약방식", "선정절차")
HANGUL = "[가-힣]+"
BULLETS = r"^[□○\-◈※ㆍ]"
OUTLINE = r"^(?:[ⅠⅡⅢⅣⅤ]|[1-9])\."
# Signals that let an uncertain table back in, and what a signal adds to an OCR score.
RECOVERY = (
    "left_label_column_pattern", "box_layout_like", "weak_header_match", "important_field_block", "system_map_like", "menu_flow_like", "form_field_like",
    "submission_list_like", "project_overview_like", "schedule_amount_like", "eligibility_threshold_like", "software_stack_like", "staffing_plan_like", "field_value_table_like",
)
OCR_BONUS = {
    "weak_header_match": 2,
    "left_label_column_pattern": 2,
    "box_layout_like": 3,
    "menu_flow_like": 3,
    "field_value_table_like": 2,
    "schedule_amount_like": 2,
    "submission_list_like": 2,
    "project_overview_like": 2,
    "software_stack_like": 2,
    "staffing_plan_like": 2,
    "eligibility_threshold_like": 2,
}


def compact(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WHITE}]", "")


def _squeeze(word: str) -> str:
    return "".join(word.split())


def occurrences(c: Column, word: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def held(c: Column, words: Sequence[str]) -> Column:
    """How many of the words are in a compact text."""
    return sum((c.contains(_squeeze(w)).cast("int") for w in words), F.lit(0))


def _any(c: Column, words: Sequence[str]) -> Column:
    return held(c, words) > 0


def block_features(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``f``, a struct of what later rules ask about a table's text: word hits and kinds of lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = text_lines(t)
    rows = blocks.withColumn("__t", F.struct(t.alias("t"), compact(t).alias("c"), lines.alias("l")))
    t, c, lines = F.col("__t.t"), F.col("__t.c"), F.col("__t.l")
    rows = rows.withColumn("__h", F.struct(*[F.regexp_replace(x, "[^가-힣]+", " ").alias(k) for k, x in (("t", t), ("c", c))]))
    # a word of Hangul alone is asked of the text's Hangul alone, which keeps its runs apart and is short where other scripts prevail
    ht, hc = F.col("__h.t"), F.col("__h.c")
    own = lambda whole, hangul, w: hangul if re.fullmatch(HANGUL, w) else whole
    hits = lambda words: sum((F.greatest(occurrences(own(t, ht, w), w), occurrences(own(c, hc, _squeeze(w)), _squeeze(w))) for w in words), F.lit(0))
    held = lambda c, words: sum((own(c, hc, _squeeze(w)).contains(_squeeze(w)).cast("int") for w in words), F.lit(0))
    count = lambda p: F.size(F.filter(lines, p))
    f = F.struct(
        hits(TOC_WORDS).alias("toc"),
        hits(COVER_WORDS).alias("cover"),
        hits(DATA_WORDS).alias("data"),
        held(c, HEADER_WORDS).alias("headers"),
        F.greatest(*[held(c, g) for g in HEADER_GROUPS]).alias("header_group"),
        F.struct(*[held(c, w).alias(k) for k, w in FIELD_GROUPS.items()]).alias("groups"),
        held(c, LABEL_WORDS).alias("labels"),
        held(c, OVERVIEW_WORDS).alias("overview"),
        _any(compact(F.array_join(F.slice(lines, 1, 3), "")), STACKED_LABELS).alias("stacked"),
        F.size(lines).alias("lines"),
        count(lambda x: x.rlike(OUTLINE)).alias("outline"),
        count(lambda x: x.rlike(f"[{DIGITS}]")).alias("numeric"),
        count(lambda x: x.rlike(BULLETS)).alias("bullets"),
        count(lambda x: F.length(x) >= 40).alias("long"),
        count(lambda x: F.length(x) <= 12).alias("short"),
        count(lambda x: x.contains("→") | x.contains("->")).alias("arrows"),
        F.exists(lines, lambda x: x.isin("목차", "차례")).alias("contents"),
        F.exists(lines, lambda x: x.rlike(r"202[456]\.")).alias("dated"),
        c.alias("c"),
    )
    return rows.withColumn("f", f).drop("__t", "__h")


def first_pass(blocks: DataFrame, rows: str = "row_hints", paragraphs: str = "paragraphs") -> DataFrame:
    """blocks with block_features: adds ``first``, struct(kind, toc, cover, data, header_group). Contents pages and covers go first,
    then tables by gates on structure, header groups and fields."""
    f, r, p = (lambda k: F.col(f"f.{k}")), F.col(rows), F.col(paragraphs)
    one = lambda c, n: F.when(c, n).otherwise(0)
    toc = f("toc") + one(f("outline") >= 3, 2) + one(f("contents"), 3)
    cover = f("cover") + one((p <= 4) & (r <= 5) & f("c").contains("제안요청서"), 2) + one((p <= 4) & f("dated"), 1)
    half = F.greatest(F.lit(3), F.floor(f("lines") / 2).cast("int"))
    data = f("data") + one(r >= 3, 1) + one(f("numeric") >= half, 1) + one(_any(f("c"), ("구분", "항목", "내용", "비고")), 2)
    groups = [f(f"groups.{k}") for k in FIELD_GROUPS]
    active, strongest = sum(((g > 0).cast("int") for g in groups), F.lit(0)), F.greatest(*groups)
    prose = (f("bullets") >= 2) & (f("long") >= 2) & (f("headers") < 2)
    fields = (data >= 3) & ((active >= 2) | (strongest >= 3))
    group = f("header_group")
    kind = (
        F.when(toc >= 4, "toc")
        .when((cover >= 4) & (data <= 3), "cover")
        .when((r >= 5) & (p >= 4) & (group >= 3) & (data >= 4) & ~prose, "sure_table")
        .when((r >= 3) & (p >= 3) & (group >= 2) & (data >= 4), "review_needed")
        .when((r >= 5) & (p >= 4) & (group >= 1) & fields & ~prose, "review_needed")
        .when((r >= 8) & (p >= 6) & (active >= 2) & (data >= 3) & ~prose, "review_needed")
        .otherwise("uncertain")
    )
    return blocks.withColumn("first", F.struct(kind.alias("kind"), toc.alias("toc"), cover.alias("cover"), data.alias("data"), group.alias("header_group")))


def missing_signals(blocks: DataFrame, rows: str = "row_hints") -> DataFrame:
    """blocks with first_pass: adds ``signals``, in the order of the rules, and ``bonus``, the sum of what they count."""
    f, g, r, c = (lambda k: F.col(f"f.{k}")), (lambda k: F.col(f"f.groups.{k}")), F.col(rows), F.col("f.c")
    groups = [g(k) for k in FIELD_GROUPS]
    total, active = sum(groups, F.lit(0)), sum(((x > 0).cast("int") for x in groups), F.lit(0))
    has, header = c.contains, F.col("first.header_group")
    rules = [
        ("weak_header_match", (r >= 5) & (F.col("first.data") >= 4) & (header < 2), 2),
        ("left_label_column_pattern", ((f("short") >= 3) & (f("labels") >= 1)) | f("stacked"), 2),
        ("box_layout_like", (r >= 6) & ((f("arrows") >= 1) | (f("labels") >= 2) | f("stacked")), 2),
        ("important_field_block", (total >= 6) & (active >= 2), 2),
        ("system_map_like", g("system_map") >= 4, 2),
        ("menu_flow_like", (has("제도안내") | has("신청방법") | (has("결과") & has("보고"))) & (g("system_map") >= 2), 2),
        ("form_field_like", g("form_fields") >= 3, 2),
        ("field_value_table_like", (r >= 5) & ((g("form_fields") >= 2) | (g("schedule_amount") >= 2) | (g("requirements_eval") >= 2) | (g("roles_org") >= 2)), 2),
        ("submission_list_like", has("제출서류") & (has("목록") | has("제출")) & (f("short") >= 4), 2),
        ("project_overview_like", f("overview") >= 3, 2),
        ("schedule_amount_like", (g("schedule_amount") >= 3) & (r >= 3), 2),
        ("eligibility_threshold_like", (has("대상업체") | has("참가자격")) & (has("사업금액") | has("매출액")), 2),
        ("software_stack_like", (g("software_stack") >= 3) & (r >= 3), 2),
        ("staffing_plan_like", (has("PM") | has("사업관리자")) & has("부문"), 2),
        ("explanatory_block", (f("bullets") >= 2) & (f("long") >= 2) & (header < 2) & (f("labels") == 0) & (total < 6) & (f("overview") < 3), -2),
        ("promotable_review_table", (F.col("first.kind") == "review_needed") & (header >= 2) & (r >= 5), 1),
    ]
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond, _ in rules]))
    return blocks.withColumns({"signals": names, "bonus": sum((F.when(cond, b).otherwise(0) for _, cond, b in rules), F.lit(0))})


def second_pass(kind: Column, signals: Column, bonus: Column) -> Column:
    prose = F.array_contains(signals, "explanatory_block")
    back = F.arrays_overlap(signals, F.array(*[F.lit(x) for x in RECOVERY]))
    return (
        F.when(kind.isin("cover", "toc"), kind)
        .when(kind == "sure_table", "final_sure_table")
        .when(kind == "review_needed", F.when(prose, "explanatory_block").when(bonus >= 1, "final_sure_table").otherwise("final_review_table"))
        .when(kind == "uncertain", F.when(prose, "explanatory_block").when((bonus >= 2) & back, "final_review_table").otherwise("discarded_table"))
        .otherwise("discarded_table")
    )


def storage_bucket(final: Column) -> Column:
    return F.when(final.isin("final_sure_table", "final_review_table"), "structural_table").when(final == "explanatory_block", final).when(final.isin("cover", "toc"), "excluded").otherwise("discarded")


def priority(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 4, "medium").otherwise("low")


def table_ocr_score(bucket: Column, final: Column, header_group: Column, rows: Column, signals: Column, parent: Column, length: Column) -> Column:
    one = lambda c, n: F.when(c, n).otherwise(0)
    s = F.when(final == "final_review_table", 4).when(final == "final_sure_table", 1).otherwise(0)
    s = s + F.when((header_group <= 1) & (rows >= 5), 3).when((header_group == 2) & (rows >= 5), 1).otherwise(0)
    s = s + sum((one(F.array_contains(signals, k), n) for k, n in OCR_BONUS.items()), F.lit(0))
    s = s + one(F.coalesce(parent, F.lit("")) != "", 1) + one(length >= 300, 1)
    return F.when(bucket == "structural_table", s).otherwise(0)


def image_ocr_score(name: Column, ext: Column, size: Column) -> Column:
    s = F.when(size >= 300_000, 5).when(size >= 100_000, 3).when(size >= 30_000, 1).otherwise(0)
    return s + ext.isin("png", "jpg", "jpeg", "bmp").cast("int") + F.lower(name).rlike("^(bin|image|img)").cast("int")


def structural_tables(tables: DataFrame, by: str, index: str, order: str, bucket: str = "bucket", final: str = "final", score: str = "score", least: int = 4) -> DataFrame:
    """The first table of each index that is a section header, or a structural one to be reviewed or with a score of ``least``."""
    ok = (F.col(bucket) == "section_header_block") | ((F.col(bucket) == "structural_table") & ((F.col(final) == "final_review_table") | (F.coalesce(score, F.lit(0)) >= least)))
    rn = F.row_number().over(Window.partitionBy(by, index).orderBy(order))
    return tables.where(ok).withColumn("__n", rn).where("__n = 1").drop("__n")


def visual_filter(rows: DataFrame, keep: Column, key: Sequence[Column], order: str) -> DataFrame:
    """Rows that pass, the first of each key (sizes and rounded corners)."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.where(keep).withColumn("__n", rn).where("__n = 1").drop("__n")


def table_keep(rows: Column, cols: Column, area: Column, length: Column) -> Column:
    return (rows >= 2) & (cols >= 2) & (area >= 0.01) & (length >= 20)


def image_keep(width: Column, height: Column, area: Column) -> Column:
    return (width >= 80) & (height >= 80) & (area >= 0.01)


def visual_score(text: Column, high: Sequence[str], low: Sequence[str], figures: Column, charts: Column, assets: Column, images: Column) -> Column:
    """2 for each pattern of high value, 1 for markers of each kind, up to 2 for assets and for images; less 2 for each of low
    value; never negative."""
    hit = lambda p: text.rlike(f"(?i){p}").cast("int")
    some = lambda c: F.least(F.lit(2), F.greatest(F.lit(0), c))
    s = sum((2 * hit(p) for p in high), F.lit(0)) + (figures > 0).cast("int") + (charts > 0).cast("int") + some(assets) + some(images) - sum((2 * hit(p) for p in low), F.lit(0))
    return F.greatest(s, F.lit(0))


def visual_action(score: Column) -> Column:
    return F.when(score >= 5, "ocr_priority_then_manual_check").when(score >= 3, "ocr_if_user_asks_visual_detail").otherwise("keep_marker_only")


def rag_text(text: Column, tables: Column, hints: Column | None = None, max_tables: int = 3, max_hints: int = 2) -> Column:
    """The text, then the first blocks of tables (array of struct<source, page, markdown>) and hints (array of struct<score, action,
    text, snippet>), parted by blank lines; blank parts are left out."""
    page = lambda b: F.when(b["page"].isNotNull(), F.concat(F.lit("[page="), b["page"].cast("string"), F.lit("]"))).otherwise("")
    block = lambda b: F.concat(F.lit("[TABLE BLOCK][source="), b["source"], F.lit("]"), page(b), F.lit("\n"), b["markdown"])
    hint = lambda h: F.concat(F.lit("[VISUAL OCR CANDIDATE][score="), h["score"].cast("string"), F.lit("][action="), h["action"], F.lit("]\n"), F.coalesce(h["text"], F.lit("")), F.lit("\n"), F.coalesce(h["snippet"], F.lit("")))
    parts = F.concat(F.array(F.coalesce(text, F.lit(""))), F.transform(F.slice(tables, 1, max_tables), block))
    if hints is not None:
        parts = F.concat(parts, F.transform(F.slice(hints, 1, max_hints), hint))
    return F.trim(F.array_join(F.filter(parts, lambda x: x != ""), "\n\n"))


def table_chunk(source: Column, index: Column, parent: Column, ocr: Column, text: Column) -> Column:
    head = F.when(F.coalesce(parent, F.lit("")) != "", F.concat(F.lit("[SECTION_HEADER] "), parent, F.lit("\n"))).otherwise("")
    body = F.coalesce(F.nullif(ocr, F.lit("")), text, F.lit(""))
    return F.rtrim(F.concat(F.lit("[SOURCE] "), source, F.lit("\n[TABLE_INDEX] "), index.cast("string"), F.lit("\n"), head, F.lit("[STRUCTURAL_TABLE]\n"), body))


def image_chunk(source: Column, name: Column, ocr: Column) -> Column:
    """Null without recognised text."""
    return F.when(F.trim(F.coalesce(ocr, F.lit(""))) != "", F.concat(F.lit("[SOURCE] "), source, F.lit("\n[IMAGE_NAME] "), name, F.lit("\n[IMAGE_OCR]\n"), F.trim(ocr)))


def first_filled(*options: Column) -> Column:
    """The first that is neither null nor empty, or ''."""
    return F.coalesce(*[F.nullif(o.cast("string"), F.lit("")) for o in options], F.lit(""))


def corpus_record(extracted: Column, meta_extracted: Column, chunk_type: Column, meta_type: Column, has_table: Column) -> Column:
    """struct(extracted_from, chunk_type): a row's own value, else its metadata's, else what the table flag says."""
    origin = first_filled(extracted, meta_extracted, F.when(F.coalesce(has_table, F.lit(0)) == 1, "mixed").otherwise("body"))
    return F.struct(origin.alias("extracted_from"), first_filled(chunk_type, meta_type, origin, F.lit("body")).alias("chunk_type"))


def discarded_indexes(markdown: Column, heading: str = "구조표로 다시 볼 우선 후보:") -> Column:
    """Distinct table indexes of a shortlist: those quoted under the heading, else all that follow table_index; ascending."""
    block = F.regexp_extract(markdown, rf"(?is){heading}\s*(.+?)(?:\n\s*-\s*설명문/제목 블록|\n## |\z)", 1)
    quoted = F.regexp_extract_all(block, F.lit(r"`(\d+)`"), F.lit(1))
    loose = F.regexp_extract_all(markdown, F.lit(r"table_index\s*`?\s*(\d+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.when(F.size(quoted) > 0, quoted).otherwise(loose), lambda x: x.cast("int"))))


def image_confidence(level: Column) -> Column:
    return F.when(level == "high", 0.85).when(level == "medium", 0.65).otherwise(0.45)


def recovery_report(pages: DataFrame, tables: str, order: str, k: int) -> DataFrame:
    """pages with an array of tables, flattened; the best k by recovery, rows (then columns) or area."""
    rows = pages.select(F.explode(tables).alias("t")).select("t.*")
    by = {"recovery": ["recovery"], "rows": ["row_count", "col_count"], "area": ["area"]}[order]
    return rows.orderBy(*[F.desc(c) for c in by], "table_id").limit(k)


def bucket_counts(tables: DataFrame, by: Sequence[str], first: str, final: str, bucket: str, score: str, least: int = 4) -> DataFrame:
    """How many tables of each first kind, final kind and bucket there are, and how many are OCR candidates."""
    n = lambda c, values: [F.count_if(F.col(c) == v).alias(f"{v}_count") for v in values]
    return tables.groupBy(*by).agg(
        F.count(F.lit(1)).alias("table_count"),
        *n(first, ("toc", "cover", "sure_table", "review_needed", "uncertain")),
        *n(final, ("final_sure_table", "final_review_table", "discarded_table")),
        *n(bucket, ("structural_table", "explanatory_block", "excluded")),
        F.count_if((F.col(bucket) == "structural_table") & (F.col(score) >= least)).alias("ocr_candidate_count"),
    )


def top_images(images: DataFrame, by: str, score: str, key: str, n: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(score), key))
    return images.withColumn("rank", rn).where(F.col("rank") <= n)


def ocr_payload(tables: DataFrame, images: DataFrame, by: str) -> DataFrame:
    """A row per document: its table and image candidates as arrays in order of their index or name, and their numbers."""
    pack = lambda df, name: df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != by]))).alias(name))
    both = pack(tables, "table_candidates").join(pack(images, "image_candidates"), by, "full")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    return both.withColumns({"table_count": F.greatest(count("table_candidates"), F.lit(0)), "image_count": F.greatest(count("image_candidates"), F.lit(0))})


def artifact_rows(tables: DataFrame, key: str, index: str, parts: Column, *, stage: str, kind: Column, text: str, parent: str, high_priority: Column, facts: dict[str, Column], signals: dict[str, str]) -> DataFrame:
    """Chunk rows of tables: one for each part of a table's body, with ids, labels, sizes and signals.

    tables: (key of the document, index, text, parent: the text linked above the table, or null); parts: array of body texts;
    facts: lines of the head, by name, null ones empty. (key, index, chunk_id, chunk_type, part_index from 1, part_count,
    section_label, parent_section_label, item_title, is_high_priority, text, chars, a flag for each pattern of signals). The id has the part
    only where there are several; a table without parts has no row. A label is the linked text, else the first line.
    """
    tidy = lambda c: stripped(F.coalesce(c, F.lit("")))
    first = F.coalesce(F.try_element_at(text_lines(F.coalesce(text, F.lit(""))), F.lit(1)), F.lit(""))
    linked = tidy(F.col(parent))
    label = F.when(linked != "", linked).otherwise(first)
    rows = tables.select(key, index, kind.alias("chunk_type"), label.alias("section_label"), label.alias("parent_section_label"), first.alias("item_title"), high_priority.cast("int").alias("is_high_priority"), F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in facts.items()]).alias("__f"), parts.alias("__p"))
    rows = rows.select("*", F.size("__p").alias("part_count"), F.posexplode("__p").alias("__i", "__t"))
    several = F.when(F.col("part_count") > 1, F.concat(F.lit("_p"), F.lpad((F.col("__i") + 1).cast("string"), 2, "0"))).otherwise("")
    name = F.concat(F.lit(f"{stage.lower()}_"), F.col(key).cast("string"), F.lit("_"), F.col("chunk_type"), F.lit("_"), F.lpad(F.col(index).cast("string"), 4, "0"), several)
    head = [F.concat(F.lit(f"- {n}: "), F.col(f"__f.{n}")) for n in facts] + [F.concat(F.lit("- section: "), F.col("section_label")), F.concat(F.lit("- type: "), F.col("chunk_type"))]
    body = F.concat_ws("\n", F.lit("[HEAD]"), *head, F.lit("[/HEAD]"), F.lit("[BODY]"), tidy(F.col("__t")), F.lit("[/BODY]"))
    out = rows.withColumn("chunk_id", name).withColumn("text", body).withColumn("part_index", F.col("__i") + 1)
    out = out.select(key, index, "chunk_id", "chunk_type", "part_index", "part_count", "section_label", "parent_section_label", "item_title", "is_high_priority", "text", F.length("text").alias("chars"))
    return out.withColumns({f"has_{n}_signal": F.col("text").rlike(p).cast("int") for n, p in signals.items()})
