"""Cases that larger tables brought up: ties, rounding, and pairs that must not be made one by one."""

import hashlib
import math
import random
import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lexiquarry import plans
from lexiquarry.functions.text import char_ngrams
from lexiquarry.operators import artifacts as A
from lexiquarry.operators import curation as C
from lexiquarry.operators import evaluation as E
from lexiquarry.operators import evidence as V
from lexiquarry.operators import grids as G
from lexiquarry.operators import ranking as K
from lexiquarry.operators import retrieval as R
from lexiquarry.registry import ORACLES, QUERIES
from lexiquarry.session import tasks_for

plans.load()


def test_doc_hits_of_equal_lines(spark, tmp_path):
    """Lines with one number and part stand in the order of the table, whatever their documents are."""
    rows = [(k, 1, 7, s) for k in range(40) for s in ((3, 1) if k % 2 else (2, 5))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["doc_hits"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(ORACLES["doc_hits"]).fetchall()) and {r[1] for r in got if r[0] % 2} == {0.0}


def test_doc_hits_of_lines_without_values(spark, tmp_path):
    """Lines without number or part come last, one without a supplier is first where it stands first."""
    rows = [(1, 1, 1, None), (1, 2, 1, 1), (2, None, 1, 1), (2, 1, 1, 3), (3, 1, None, 2), (3, 1, 5, 4), (None, 1, 1, 1), (4, 1, 1, None), (5, 1, 1, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["doc_hits"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(ORACLES["doc_hits"]).fetchall()) and {r[0] for r in got if r[1] == 0.0} == {1, 2, 3, 4}


def test_leakage_prints_as_c(spark):
    """All similarities of six digits from 0.84 on print as %.4f does in C."""
    rows = spark.range(840000, 1000001, 5).select("id", C.leakage(F.lit(False), F.col("id") / 1e6, F.lit(True)).alias("reason")).collect()
    assert [r.reason for r in rows if r.reason != "semantic_match:%.4f" % (r.id / 1e6)] == []


def pairs_by_row(rows, limit, theme=lambda k: False):
    """Every pair of rows, one by one, that share a tag: (a, b, overlap, shared tags, themed)."""
    out = []
    for a, s in rows.items():
        for b, t in rows.items():
            both = sorted(s & t)
            if a < b and both:
                out.append((a, b, len(both), "|".join(both[:4]), theme(a) or theme(b)))
    return out


def falling(s):
    return [-ord(c) for c in s] + [1]


def test_pairs_of_classes(spark):
    """Few tag sets with many rows, with keys of classes in turn and one behind another: the best pairs are those of all pairs,
    and no pairs of rows are made on a tag that all have."""
    for seed in range(4):
        rng = random.Random(seed)
        rows = {k: frozenset(rng.choice(["all x", "all y", "all", "x y", "z"] if seed % 2 else [["all x"], ["all", "y"], ["all x y"]][k // 30 % 3]).split()) for k in range(90)}
        df = spark.createDataFrame([(k, sorted(v), "news" if k % 7 == 3 else "") for k, v in rows.items()], "k long, tags array<string>, name string")
        for limit in (5, 60):
            want = sorted((-n, a, b) for a, b, n, _, _ in pairs_by_row(rows, limit))[:limit]
            assert [(-r.overlap, r.a, r.b) for r in C.tag_pairs(df, "k", "tags", limit).collect()] == want
            full = pairs_by_row(rows, limit, lambda k: k % 7 == 3)
            want = sorted((-(n + t), falling(s), a, b) for a, b, n, s, t in full)[:limit]
            assert [(-r.points, falling(r.first_tags), r.a, r.b) for r in C.themed_pairs(df, "k", "tags", F.col("name"), ["news"], limit).orderBy(F.desc("points"), F.desc("first_tags"), "a", "b").collect()] == want
    many = spark.range(60000).select("id", F.array(F.lit("all"), (F.col("id") % 3).cast("string")).alias("tags"))  # 1.8 billion pairs share a tag
    assert [(r.a, r.b, r.overlap) for r in C.tag_pairs(many, "id", "tags", 3).collect()] == [(0, 3, 2), (0, 6, 2), (0, 9, 2)]


def test_slots_without_python(spark):
    """Slots of many short lists are chosen by columns: a Python call for each list does not end on a million of them."""
    rows = spark.range(12).select((F.col("id") % 2).alias("query_id"), "id", F.col("id").alias("rank"))
    rows = rows.select("query_id", F.col("id").alias("chunk_id"), "rank", F.when(F.col("id") > 8, F.array(F.lit(1))).alias("slots_hit"), F.lit(2).alias("asked"), F.when(F.col("query_id") == 1, (F.col("id") % 3 == 0).cast("int")).alias("is_table"), F.lit(None).cast("string").alias("section_path"), F.when(F.col("id") > 6, "t").alias("section_title"))
    got = R.cover_slots(rows, 4)
    assert "InPandas" not in got._jdf.queryExecution().toString()
    lists = {q: [r.chunk_id for r in got.where(F.col("query_id") == q).orderBy("place").collect()] for q in (0, 1)}
    assert lists == {0: [10, 0, 2, 4], 1: [3, 1, 9, 5]}


def test_packs_come_in_small_batches(spark):
    """Pairs of packs are a megabyte each and go to Python in batches bounded by bytes, not 10,000 rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    v = spark.range(6000).select(F.col("id").alias("chunk_id"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(64)]).alias("embedding"))
    found = R.vector_top(v, v.where("chunk_id < 3000").withColumnRenamed("chunk_id", "query_id"), 1).where("rank = 1")
    assert int(spark.conf.get(name)) <= 8 << 20
    assert found.where("distance = 0").count() == 2999  # the vector of id 0 is all zeros


def test_quotas_store_little(spark):
    """What a choice by quotas stores is some bytes a row, not every use of every row in each round."""
    import pathlib

    from lexiquarry.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    held = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    rows = spark.range(50000).select(F.concat_ws("-", F.col("id").cast("string"), F.lit("key")).alias("key"), "id")
    use = lambda quota, n: F.struct(F.lit(quota).alias("quota"), (F.col("id") % n).cast("string").alias("of"))
    start = held()
    assert C.greedy_quotas(rows, "key", -F.col("id"), F.array(use("a", 100), use("b", 300)), {"a": 3, "b": 1}).count() == 300
    assert held() - start < 100 * 50000


def test_names_keep_off_the_driver(spark):
    """No table of names is broadcast, however small its files look."""
    files = spark.range(300).select(F.format_string("File %05d", "id").alias("file_name"), F.col("id").alias("place"))
    names = spark.createDataFrame([("File 00007",), ("FILE00008",), ("0009",), ("none",)], "name string")
    got = K.resolve_names(names, files)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.name, r.file_name, r.tier) for r in got.collect()} == {("File 00007", "File 00007", 1), ("FILE00008", "File 00008", 2), ("0009", "File 00009", 3), ("none", None, None)}


def test_tfidf_of_blocks(spark):
    """Blocks of a group meet once, copies across blocks included; grams are not broadcast."""
    df = spark.range(700).select(F.lit("g").alias("grp"), "id", F.concat_ws(" ", F.sha2((F.col("id") % 650).cast("string"), 256), F.sha2((F.col("id") % 650 + 9000).cast("string"), 256)).alias("t"))
    got = C.tfidf_duplicates(df, ["grp"], "id", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastHashJoin" not in plan
    assert {(r.id, r.matched, r.similarity) for r in got.collect()} == {(i + 650, i, 1.0) for i in range(50)}


def test_tfidf_as_sql(spark, tmp_path):
    """Letters whose lower case depends on their neighbours or is two, a tab that the SQL does not part words at, wide letters, missing keys and
    texts, one key twice and equal texts."""
    some = ["ΟΔΟΣ ΟΔΟΣ x", "οδοσ οδοσ x", "Iİ iİ kapı", "ii ii kapı", "one\x0btwo three", "one two three", "one\u00a0two three", "가나다라 마바", "가나다라 마바사", "😀😀a b", None, " \n", "", "a", "A a"]
    rows = [(c, t if t % 11 else None, some[((c or 0) * 7 + t * t) % len(some)]) for c in (1, 2, 3, None) for t in range(40)] + [(1, 5, "one two"), (4, 1, "lone words")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLES["dup_tfidf"]).fetchall()
    assert {tuple(r) for r in QUERIES["dup_tfidf"](spark, str(tmp_path)).collect()} == set(want) and len(want) > 60


def test_tfidf_bounds_lose_no_pair(spark, monkeypatch):
    """Small blocks, few columns and no dense way give the pairs of one dense block; only near pairs are compared gram by gram."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(150)]
    texts = [[rng.choice(words[: 150 - g * 60]) for _ in range(rng.randint(1, 60))] for g in (0, 1) for _ in range(60)]
    texts += [[rng.choice(words) if rng.random() < 0.04 * (k % 4) else w for w in rng.choice(texts)] for k in range(120)]
    df = spark.createDataFrame([(k % 3, k, " ".join(t)) for k, t in enumerate(texts)], "g long, k long, t string").coalesce(2)
    way = lambda least: sorted(map(tuple, C.tfidf_duplicates(df, ["g"], "k", "t", least).collect()))
    want = [way(0.92), way(0.6)]
    monkeypatch.setattr(C, "CHARS", 1500)
    assert [way(0.92), way(0.6)] == want and 10 < len(want[0]) < len(want[1])
    vocabulary = C._vocabulary(None)
    assert [len(c) for c in vocabulary] == [0, 0, 0, 0]


def test_ranks_over_tasks(spark, monkeypatch):
    """A group is numbered in many tasks, null groups and no groups included, and its ranks are those of one sort."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]) if k > 900 else "a", float(rng.randrange(-4, 5)), float(rng.randrange(-2, 3)), k) for k in range(1200)]
    df = spark.createDataFrame(rows, "g string, x double, y double, k long")
    monkeypatch.setattr(E, "tasks_for", lambda _: 7)
    assert E.numbered(df, ["g"], ["x", "k"], "n").select(F.spark_partition_id()).distinct().count() > 1
    plan = E.spearman(df, "x", "y", "k", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    for by, of in ((["g"], lambda r: r[0]), ([], lambda r: 0)):
        got = {(r["g"] if by else 0): (r.n, r.rho, r.sign_agreement) for r in E.spearman(df, "x", "y", "k", by).collect()}
        for g in set(map(of, rows)):
            own = [r for r in rows if of(r) == g]
            rank = lambda c, own=own: {r[3]: i for i, r in enumerate(sorted(own, key=lambda r: (r[c], r[3])))}
            x, y, n = rank(1), rank(2), len(own)
            agree = sum((r[1] > 0) - (r[1] < 0) == (r[2] > 0) - (r[2] < 0) for r in own) / n
            assert got[g] == (n, round(1 - 6 * sum((x[k] - y[k]) ** 2 for k in x) / (n * (n * n - 1)), 4), round(agree, 4))


def test_candidates_are_dealt_once(spark, sf):
    """An order's lines meet in one shuffle, and in tasks whose number follows the rows; more rows do not make a task larger."""
    for name in ("table_body_pair", "round_robin_docs", "diversity_rerank", "diverse_select", "type_gated_rerank"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    cores = spark.sparkContext.defaultParallelism
    assert [tasks_for(spark.range(n), 50) for n in (0, 10, 50 * cores + 1)] == [cores, cores, cores + 1]


def test_chunks_stay_in_their_row(spark, sf):
    """Digests of a table's chunks are made in its row: nothing is shuffled after its texts are, and they are those of the chunks."""
    plan = QUERIES["structured_chunks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("ArrowEvalPython")] and "ObjectHashAggregate" not in plan[: plan.index("ArrowEvalPython")]
    df = spark.createDataFrame([(1, "<table><tr><td>a</td><td>7</td></tr></table>", None, "s", " b "), (2, None, "x | 2024-1-2\ny", "", ""), (3, None, None, None, None)], "k int, html string, lines string, section_label string, body string")
    df = df.select("*", F.lit("m").alias("pairing_method"), F.lit(0.5).alias("pairing_score"))
    made, want = G.structured_chunks(df, "k", prefix=F.lit("t"), chars=40).collect(), {}
    for r in sorted(made, key=lambda r: r.chunk_id):
        want.setdefault((r.k, r.chunk_type), []).append(r)
    got = {(r.k, r.chunk_type): (r.n, r.chars, r.texts, r.has_table) for r in G.chunk_digests(G.chunk_lists(df, "k", prefix=F.lit("t")), "k", chars=40).collect()}
    assert got == {g: (len(v), sum(r.raw_chars for r in v), hashlib.md5("\n".join(f"{r.chunk_id}\n{r.text}" for r in v).encode()).hexdigest(), max(r.has_table for r in v)) for g, v in want.items()}


def test_chunk_lines_are_made_once(spark, sf):
    """Lines of a chunk are trimmed without a pattern, and a row for a kind does not hold the chunks of all kinds."""
    plan = QUERIES["structured_chunks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 10 and "explode(array_distinct" not in plan
    block = spark.range(1).select(G._block("A", F.lit(" \t\n\x0b\f\r"), F.lit(" b \n c\x0b"), F.lit(None).cast("string"), F.lit("d"))).first()[0]
    assert block == "[A]\nb \n c\nd\n[/A]"
    assert G.html_cells("<tr><!-- <td>x --><TD ROWSPAN=2 colspan='3'>a<b>b</b> &amp;</TD><td>c</tr>") == [(1, False, 2, 3, "a b &"), (1, False, 1, 1, "c")]


def test_lists_by_column():
    """Grids go to Arrow by column, empty ones included."""
    cell = pa.struct([("r", pa.int32()), ("t", pa.string())])
    assert G._lists([[(1, "a"), (2, "b")], [], [(3, None)]], cell).to_pylist() == [[{"r": 1, "t": "a"}, {"r": 2, "t": "b"}], [], [{"r": 3, "t": None}]]
    assert G._lists([[], []], cell).to_pylist() == [[], []] and G._lists([["x"], []], pa.string()).to_pylist() == [["x"], []]


def test_words_are_found_once(spark, sf):
    """Expressions that are read several times are in the plan once: the four texts of an alignment, both lists of an answer."""
    plan = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("alignment_scores").count("regexp_extract_all(") == 4
    assert plan("grade_list_set").count("국가|지역") == 2


def test_hangul_is_asked_of_hangul(spark):
    """Words of Hangul alone are counted in a text without its other characters, which keep apart what they part."""
    rows = [("목 차목x차 목차 구분1항목",), ("목a차 사업\n명 ID 요구 사항 ID",), ("x" * 50,), (None,), ("",)]
    got = A.block_features(spark.createDataFrame(rows, "text string"))
    assert "[^가-힣]+" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.f.toc, r.f.cover, r.f.data, r.f.headers) for r in got.collect()] == [(2, 0, 2, 2), (0, 1, 1, 2), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_few_questions_meet_chunks_as_a_matrix(spark, monkeypatch):
    """No pair of question and chunk is shuffled or joined for a score; lists, bonuses, ties and null fields are those of the join."""
    rng = random.Random(3)
    rows = [(k, None if k % 40 == 7 else " ".join(rng.choice(["a", "b", "c", "dd", "src1", "en"]) for _ in range(rng.randrange(9))), rng.choice(["src1", "src2", None]), rng.choice(["en", "de", None])) for k in range(300)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, source string, lang string")
    asked = spark.createDataFrame([(1, "a a en"), (2, "src1 b"), (3, "none"), (4, ""), (5, "dd")], "query_id long, text string")
    expected = spark.createDataFrame([(1, "src1"), (2, "src2"), (3, "src1")], "query_id long, source string")
    terms = R.tokens(F.col("text"))
    index = R.Bm25(df, terms, keep=["source", "lang"])
    bonuses = [("source", 1.5), ("lang", 1.0)]
    ways = lambda: [index.scores(asked, terms), index.top(asked, terms, 4), index.filtered(asked, terms, 5, name="source", bonuses=bonuses), index.filtered(asked, terms, 2, name="source", bonuses=bonuses, keep=F.col("lang") == "en"), index.within(asked, terms, expected, "source", 5)]
    few = ways()
    for found in few[:4]:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan
    got = [sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str) for df in few]
    monkeypatch.setattr(R, "CELLS", 0)
    assert got == [sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str) for df in ways()] and all(got)


def test_rounds_as_spark_does(spark):
    x = [0.0000005, 1.0000005, 2.6750005, -0.0000015, 12.3456785, 0.1234565, 1e-9, 7.25, 123.45678949999999]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert R.rounded(R.np.array(x), 6).tolist() == want


def regions_by_row(tables, regions):
    """The best region of each table from every pair, one by one: {table: (region, score)}."""
    out = {}
    for d, k, grams, parents, pages in tables:
        for e, r, page, other, words, own in regions:
            if d == e and other:
                both = len(set(grams) & set(other))
                x = both / (len(grams) + len(other) - both) + pages.get(page, 0.0) * 0.35 + min(0.25, len(set(parents) & set(words)) * 0.03) + own * 0.1
                x = math.floor(x * 10000 + 0.5) / 10000
                if x > 0 and (d, k) not in out or x > out.get((d, k), (0, x))[1] or x == out.get((d, k), (0, 0))[1] and r < out[d, k][0]:
                    out[d, k] = (r, x)
    return out


TABLES = "d long, t long, grams array<string>, parent_tokens array<string>, page_scores map<long, double>"
REGIONS = "d long, r long, page long, grams array<string>, tokens array<string>, region_score double"


def test_regions_of_long_documents(spark, monkeypatch):
    """Documents of one block and of many, with equal rows, empty lists and items on one side only; no row for a gram or a pair."""
    monkeypatch.setattr(V, "BLOCK", 7)
    monkeypatch.setattr(V, "WIDE", 5)
    rng = random.Random(5)
    some = lambda most: rng.sample("abcdefghijklmnop", rng.randint(0, most))
    tables = [(d, k, some(9), some(5), {k + 1: 0.5} if k % 3 else {}) for d, n in ((1, 40), (2, 3), (3, 1), (5, 2)) for k in range(n)]
    regions = [(d, k, k, some(12), some(9), k % 10 / 10) for d, n in ((1, 60), (2, 2), (3, 3), (4, 5)) for k in range(n)]
    regions += [(1, 100 + k, 100 + k, *regions[k % 10][3:5], 0.9) for k in range(40)]
    rng.shuffle(regions)
    found = V.match_regions(spark.createDataFrame(tables, TABLES), spark.createDataFrame(regions, REGIONS), ["d"], "t", "r")
    assert {(x.d, x.t): (x.r, x.score) for x in found.collect()} == regions_by_row(tables, regions)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_region_scores_round_as_sql(spark):
    """Halves of the fifth digit go the way of the binary value, as in DuckDB."""
    names = [f"g{k}" for k in range(160)]
    tables = spark.createDataFrame([(1, k, names[:k], [], {1: 0.5}) for k in range(1, 161)], TABLES)
    regions = spark.createDataFrame([(1, 1, 1, names, [], 0.1)], REGIONS)
    got = {x.t: x.score for x in V.match_regions(tables, regions, ["d"], "t", "r").collect()}
    want = duckdb.sql("select k, round(k / 160::double + 0.5::double * 0.35::double + 0.1::double * 0.1::double, 4) from range(1, 161) t(k)").fetchall()
    assert got == dict(want)


def test_char_ngrams_of_long_texts(spark):
    for text in ("", "a", "ab", "abc", "x!y z", "가나다 라-9", "é\n\u2028", "😀a😀b c", "abcab" * 500, None):
        kept = None if text is None else re.sub("[^0-9a-z가-힣._-]", "", text.lower())
        for n in (1, 2, 3):
            want = None if text is None else list(dict.fromkeys(kept[i : i + n] for i in range(max(len(kept) - n + 1, bool(kept)))))
            assert spark.createDataFrame([(text,)], "t string").select(char_ngrams(F.col("t"), n)).first()[0] == want
