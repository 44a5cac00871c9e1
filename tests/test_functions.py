"""Golden values of the text functions, chunkers, sources and graders, with Korean texts."""

import re

import pytest
from pyspark.sql import functions as F

from lexiquarry import lexicon
from lexiquarry.functions import text as X
from lexiquarry.operators import artifacts as AR
from lexiquarry.operators import chunking as K
from lexiquarry.operators import curation as C
from lexiquarry.operators import evaluation as E
from lexiquarry.operators import grading as G
from lexiquarry.operators import retrieval as R


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("v")).first().v


@pytest.mark.parametrize(
    "f, text, want",
    [
        (X.won, "1억 2천만원", 120_000_000),
        (X.won, "5천2백만원", 2_000_000),
        (X.won_by_place, "5천2백만원", 52_000_000),
        (X.won_by_place, "1억 5천만원", 150_000_000),
        (X.won, "약 3억원", None),
        (X.won, "계약 3억원", None),
        (X.won, "300,000원", 300_000),
        (X.date_key, "2024년 3월 5일".replace(" ", ""), "2024-03-05"),
        (X.date_key, "2024.02.31", "2024-02-31"),
        (X.date_key, "2024-13-01", ""),
        (X.duration_key, "계약일로부터 6달", "계약일로부터6개월"),
        (X.duration_key, "120 일", "120일"),
        (X.phone_key, "+82-2-1234-5678", "0212345678"),
        (X.url_key, "https://A.test/Path/?q=1", "a.test/path"),
        (X.first_number, "1,234.5 units", 1234.5),
        (X.compare_key, "가격 (정가): 1,000원", "가격정가1000원"),
        (X.clean_text, "a\x00b　c\n\n\n\nd", "a b c\n\nd"),
        (X.json_block, 'x {"a": {"b": 1}} y', '{"a": {"b": 1}}'),
        (X.list_items, "서울시 및 부산시, 대구시", ["서울시", "부산시", "대구시"]),
        (X.depends_on, "Q01, -, Q02", ["Q01", "Q02"]),
        (X.stripped_tokens, "사업에서는 예산을 확인", ["사업", "예산", "확인"]),
        (X.char_ngrams, "ab", ["ab"]),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, lambda c: f(c), text) == want


def test_html_tables(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table>"
    assert one(spark, lambda c: X.html_tables(c), html) == [[["A", "B"], ["1"]]]
    assert one(spark, lambda c: X.markdown_table(X.html_tables(c)[0]), html) == "| A | B |\n| --- | --- |\n| 1 |  |"


def test_sections_leave_the_preamble_out(spark):
    assert one(spark, lambda c: K.sections(c), "intro\n1. first\nx\n제 2 조 second") == ["1. first\nx", "제 2 조 second"]
    assert one(spark, lambda c: K.sections(c), "no headings") == ["no headings"]


def test_packing_and_recursion(spark):
    text = "aa\n\nbb\n\n" + "c" * 25
    assert one(spark, lambda c: K.packed_paragraphs(c, 10), text) == ["aa\n\nbb", "c" * 10, "c" * 10, "c" * 5]
    got = one(spark, lambda c: K.recursive_chunks(c, 12), "one two three. four five\nsix")
    assert all(len(x) <= 12 for x in got) and "".join(got).replace(" ", "").replace(".", "") == "onetwothreefourfivesix"


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert K.fixed_windows(df).count() == 0
    assert df.select(F.size(X.tokens(F.coalesce("text", F.lit(""))))).collect()[1][0] == 0


def graded(spark, kind, answer, canonical, aliases=(), choices=(), index=None, question=""):
    df = spark.createDataFrame([(kind, answer, question, canonical, list(aliases), list(choices), index)], "eval_type string, answer string, question string, canonical string, aliases array<string>, choices array<string>, choice_index int")
    r = G.grade(df).first()
    return r.strict, r.tolerant, r.partial, r.error_reason


GRADES = [
    (("choice", "정답: 2번", "나"), (True, True, 1.0, "ok")),
    (("currency", "사업비는 1억원입니다", "100,000,000원"), (True, True, 1.0, "ok")),
    (("number", "모두 12 개", "12"), (True, True, 1.0, "ok")),
    (("date", "2024년3월5일까지", "2024-03-05"), (True, True, 1.0, "ok")),
    (("duration", "6개월", "계약일로부터 6개월"), (False, True, 1.0, "formatting_only")),
    (("email", "메일은 A@b.co.kr 입니다", "a@b.co.kr"), (True, True, 1.0, "ok")),
    (("phone", "02-1234-5678", "+82 2 1234 5678"), (True, True, 1.0, "ok")),
    (("slot_pair", "정량 20, 정성 80", "80/20"), (False, False, 0.0, "extraction_fail")),
    (("slot_pair", "20점/80점", "80/20"), (False, True, 1.0, "formatting_only")),
    (("list_set", "서울, 부산", "서울, 부산, 대구"), (False, False, 0.6667, "partial_list")),
    (("free_string", "", "무엇"), (False, False, 0.0, "extraction_fail")),
    (("number", "없음", "12"), (False, False, 0.0, "extraction_fail")),
]


def test_grades(spark):
    """All cases in one projection, as the operator grades them."""
    rows = [(i, kind, answer, "", canonical, [], ["1) 가", "2) 나"] if kind == "choice" else [], 2 if kind == "choice" else None) for i, ((kind, answer, canonical), _) in enumerate(GRADES)]
    df = spark.createDataFrame(rows, "i int, eval_type string, answer string, question string, canonical string, aliases array<string>, choices array<string>, choice_index int")
    got = {r.i: (r.strict, r.tolerant, r.partial, r.error_reason) for r in G.grade(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(GRADES)}


def test_pairs_go_by_their_labels(spark):
    assert graded(spark, "slot_pair", "정성은 20점이고 정량은 80점", "80/20", question="정량과 정성 비율은?") == (True, True, 1.0, "ok")
    assert graded(spark, "slot_pair", "1. 기술평가 90%\n2. 가격평가 10%", "90/10", question="기술과 가격 배점은?") == (True, True, 1.0, "ok")


def test_mentions_of_a_choice_overlap(spark):
    """A mention within ten characters of a negated one is a mention of its own."""
    hits = lambda answer: spark.createDataFrame([(answer, ["alpha", "beta"])], "a string, c array<string>").select(G.choice_signal(F.col("a"), F.col("c")).alias("s")).first().s
    assert hits("alpha아님      alpha").hits == 1 and hits("alpha아님 alpha").hits == 0
    assert hits("제외 alpha").hits == 0 and hits("제외하고       alpha").hits == 1
    assert hits("beta alpha").hits == 2 and hits(None).hits == 0


def test_lines_and_digits_of_any_script(spark):
    assert one(spark, X.stripped, "\u3000\u00a0 a b\x1f\u2028") == "a b"
    assert one(spark, X.text_lines, "\t목차\r\u3000\r\nx\x0by\x85 z\u2029") == ["목차", "x", "y", "z"]
    text = "①\n⑩\n²\n٣\n십\nⅤ"
    assert [bool(re.search(f"[{X.DIGITS}]".replace(r"\p{Nd}", r"\d"), x)) for x in text.split("\n")] == [x.isdigit() for x in text.split("\n")]
    df = spark.createDataFrame([(text,)], "text string")
    assert AR.block_features(df).first().f.numeric == sum(x.isdigit() for x in text.split("\n"))


def test_support_needs_a_name(spark):
    """Rows without a document name lend each other no support."""
    from lexiquarry.operators import ranking as RK

    rows = [(1, 1, 1, 0.5, None, "", "table_true_ocr_v2", 0.0), (1, 2, 2, 0.4, None, "", "paired_body_chunk", 0.9), (2, 1, 1, 0.5, None, "d", "table_true_ocr_v2", 0.0), (2, 2, 2, 0.4, None, "d", "paired_body_chunk", 0.9), (3, 1, 1, 0.5, None, None, "table_true_ocr_v2", 0.0), (3, 2, 2, 0.4, None, None, "row_summary_chunk", 0.3)]
    rows = [(*r, 1 if r[6] != "paired_body_chunk" else 0) for r in rows] + [(q, 3, 3, 0.1, None, "other", "row_summary_chunk", 0.0, 1) for q in (1, 2, 3)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, ord int, fusion_score double, adjusted_score double, file_name string, chunk_type string, pairing_score double, has_table int")
    got = {(r.query_id, r.chunk_id): r.adjusted_score for r in RK.type_gated(df, 3, F.lit("table_plus_text")).collect()}
    assert got[1, 1] == got[3, 1] == pytest.approx(0.4975) and got[2, 1] == pytest.approx(0.5005)


def test_deltas_without_a_base(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 2.5)], "variant string, score double")
    rows = {r.variant: tuple(r[1:]) for r in E.variant_deltas(m, "variant", ["score"], {"a": "vs_a", "none": "vs_none"}).collect()}
    assert rows == {"a": (1.0, 0.0, None), "b": (2.5, 1.5, None)}


def test_exact_means(spark):
    values = [1.25, -3.5, 0.0, 1e11, 7.123456, -1e11 + 0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.select(E.exact_mean(F.col("v")).alias("m")).first().m == round(sum(values) / len(values), 4)
    assert df.where("v > 1e12").select(E.exact_mean(F.col("v")).alias("m")).first().m is None


def test_ratios_on_even_texts(spark):
    df = spark.createDataFrame([("  What IS\tthis ", "what is this")], "a string, b string")
    assert df.select(C.sequence_ratio(F.col("a"), F.col("b")).alias("r")).first().r == 1.0


def test_negated_choice(spark):
    assert graded(spark, "choice", "alpha 입니다. 그리고 beta는 제외합니다", "alpha", choices=["alpha", "beta"], index=1)[0] is True


def test_mmr_prefers_diversity(spark):
    rows = [(1, 10, 0.0, [1.0, 0.0]), (1, 11, 0.01, [1.0, 0.01]), (1, 12, 0.3, [0.7, 0.7])]
    got = R.mmr(spark.createDataFrame(rows, "query_id long, chunk_id long, distance double, embedding array<double>"), 2)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [10, 12]


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "child long, parent long")
    assert {r.node for r in E.closure(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {1, 2, 3}


def test_lightest_buckets(spark):
    got = {r.component: r.bucket for r in E.lightest_buckets(spark.createDataFrame([(1, 5), (2, 4), (3, 3), (4, 3)], "component long, size long"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_sequence_ratio_is_difflibs(spark):
    assert one(spark, lambda a, b: C.sequence_ratio(a, b), "abcd", "bcde") == 0.75


def test_shard_is_zlibs(spark):
    import zlib

    assert one(spark, lambda c: C.shard(c, 7), "Q01") == zlib.crc32(b"Q01") % 7


def test_particles_are_ordered():
    assert lexicon.PARTICLES.index("으로부터") < lexicon.PARTICLES.index("부터")


def test_closure_of_a_long_chain(spark):
    n = 104
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "child long, parent long").coalesce(1)
    assert E.closure(edges, spark.createDataFrame([(0,)], "node long")).count() == n + 1


def test_overlap_with_short_items(spark):
    long = "one two three four five six seven eight nine"
    rows = spark.createDataFrame([(1, "Please say: What is RAG? Thanks"), (2, "what is a rag"), (3, f"zero {long} ten"), (4, None), (5, "one two three four five six seven")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "what is RAG"), (2, long), (3, "..."), (4, None), (5, "rag")], "item_id long, item_text string")
    assert sorted(map(tuple, C.overlap_with(rows, "doc_id", "text", items, "item_id", "item_text").collect())) == [(1, 1), (1, 5), (2, 5), (3, 2)]
