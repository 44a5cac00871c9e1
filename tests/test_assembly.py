"""Contexts in rounds, anchors and probes, and the searches they rest on."""

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.functions.text import tokens
from lexiquarry.operators import assembly as A
from lexiquarry.operators import evaluation as E
from lexiquarry.operators import retrieval as R

CHUNKS = [
    (1, "alpha beta beta gamma", "x", 0),
    (2, "alpha | table of gamma", "x", 1),
    (3, "delta", "y", 0),
    (4, "delta epsilon", "y", 0),
    (5, "", "z", 0),
    (6, None, "z", 1),
    *[(10 + i, "alpha beta gamma common words", "big", i % 2) for i in range(40)],
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, text string, name string, has_table int")


def test_term_counts(spark):
    texts = ["b a b c a b", "one", "", None, "z z z z", " ".join(f"w{i % 37}" for i in range(5000))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string").select("k", R.term_counts(tokens(F.col("text"))).alias("c")).collect()
    for r in rows:
        assert {x.term: x.tf for x in r.c or ()} == Counter((texts[r.k] or "").split())


def bm25(question, k1=1.5, b=0.75):
    docs = {c: (t or "").split() for c, t, _, _ in CHUNKS}
    docs = {c: [w for w in ws if w.isalnum()] for c, ws in docs.items()}
    n = len(docs)
    avg = sum(map(len, docs.values())) / n
    df = Counter(w for ws in docs.values() for w in set(ws))
    raw = {w: math.log((n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    floor = sum(raw.values()) / len(raw) * 0.25
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    out = {}
    for c, ws in docs.items():
        tf = Counter(ws)
        hits = [idf[w] * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / avg)) for w in question.split() if tf[w]]
        if hits:
            out[c] = round(sum(hits), 6)
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_search_inside_expected_documents(spark, chunks, monkeypatch, broadcast):
    """A document far from the head of the overall list, and one without a query term, still have candidates."""
    monkeypatch.setattr(R, "ASKED_TERMS", 500_000 if broadcast else 0)
    whole = chunks.na.fill("", ["text"])
    index = R.Bm25(whole, tokens(F.col("text")), keep=["name"])
    asked = spark.createDataFrame([(1, "alpha gamma"), (2, "delta")], "query_id long, text string")
    wanted = spark.createDataFrame([(1, "x"), (1, "z"), (2, "y"), (2, "nowhere"), (2, "y")], "query_id long, name string")
    got = {(r.query_id, r.name, r.chunk_id): (r.score, r["rank"]) for r in index.within(asked, tokens(F.col("text")), wanted, "name", 3).collect()}
    scores = {1: bm25("alpha gamma"), 2: bm25("delta")}
    assert set(got) == {(1, "x", 1), (1, "x", 2), (1, "z", 5), (1, "z", 6), (2, "y", 3), (2, "y", 4)}
    for (q, _, c), (score, _) in got.items():
        assert score == pytest.approx(scores[q].get(c, 0.0), abs=1e-6)
    assert got[1, "z", 5][1] == 1 and got[1, "z", 6][1] == 2
    top = [r.chunk_id for r in index.top(asked.where("query_id = 1"), tokens(F.col("text")), 5).collect()]
    assert not {5, 6} & set(top)
    every = {(r.query_id, r.chunk_id): r.score for r in index.scores(asked, tokens(F.col("text"))).collect()}
    assert every == pytest.approx({(q, c): v for q in (1, 2) for c, v in scores[q].items()}, abs=1e-6)


def test_an_anchor_for_each_expected_document(spark, chunks):
    names = chunks.select("chunk_id", "name")
    wanted = spark.createDataFrame([(1, "x"), (1, "y")], "query_id long, name string")
    dense = spark.createDataFrame([(1, 20, 1), (1, 2, 2), (1, 1, 3)], "query_id long, chunk_id long, rank int")
    lexical = spark.createDataFrame([(1, "x", 1, 1), (1, "x", 2, 2), (1, "y", 4, 1), (1, "y", 3, 2)], "query_id long, name string, chunk_id long, rank int")
    found = A.within_documents(dense, lexical, names, wanted)
    scores = {r.chunk_id: r.fusion_score for r in found.collect()}
    assert scores == pytest.approx({2: 0.7 / 61 + 0.3 / 62, 1: 0.7 / 62 + 0.3 / 61, 4: 0.3 / 61, 3: 0.3 / 62}, abs=1e-9)
    bonus = lambda rows: rows.withColumn("adjusted_score", F.col("fusion_score") + F.when(F.col("chunk_id") == 3, 1.0).otherwise(0.0))
    assert [(r.name, r.chunk_id, r.ord) for r in A.anchors(found, bonus).orderBy("ord").collect()] == [("y", 3, 1), ("x", 2, 2)]


def test_support_verdicts(spark):
    lexicon = {"fee": (("charge",), (r"\d+ usd",)), "term": (("period",), (r"\d+ days",))}
    asked = spark.createDataFrame([(1, ["fee"]), (2, ["fee"]), (3, ["term", "fee"]), (4, ["term"]), (5, []), (6, ["fee"])], "query_id long, slots array<string>")
    rows = [(1, "dense", "costs 20 USD"), (1, "normalized", "a charge"), *[(2, p, "the  CHARGE applies") for p in ("dense", "metadata", "table_body")], (3, "lexical", "30 DAYS"), (3, "dense", "for 5 usd"), (4, "normalized", "Period"), (4, "dense", None), (5, "dense", "20 usd"), (1, "dense", "9 usd"), (1, "table_body", "8 usd"), (1, "metadata", "7 usd"), (1, "lexical", "6 usd")]
    got = {r.query_id: r for r in A.support_verdict(asked, spark.createDataFrame(rows, "query_id long, probe string, text string"), lexicon).collect()}
    assert {q: (r.direct_total, r.indirect_total, r.judge, r.confidence, r.status, r.ambiguity) for q, r in got.items()} == {
        1: (5, 1, "supported", 0.98, "type4_rejected_supported", False),
        2: (0, 3, "ambiguous", 0.55, "type4_ambiguous", True),
        3: (2, 0, "supported", 0.81, "type4_rejected_supported", False),
        4: (0, 1, "not_supported", 0.72, "type4_accepted", False),
        5: (0, 0, "not_supported", 0.85, "type4_accepted", False),
        6: (0, 0, "not_supported", 0.85, "type4_accepted", False),
    }
    assert got[2].words == ["charge"] and got[4].words == []  # the third probe reports no words
    assert (got[1].dense, got[1].lexical, got[1].metadata, got[1].table_body) == (2, 1, 1, 1)


QUESTIONS = [(1, "comparison", ["x", "y"], None, None), (2, "table_plus_body", ["x"], None, None), (3, "follow_up", ["y"], True, None), (4, "rejection", ["z"], None, "ambiguous"), (5, "single", ["x"], None, None), (6, "follow_up", None, None, None), (7, None, [], None, None)]


def test_rounds_ask_only_weak_questions(spark, chunks):
    asked = spark.createDataFrame(QUESTIONS, "query_id long, task_type string, targets array<string>, resolvable boolean, support string")
    seen = []

    def answering(rows):
        def ask(todo):
            seen.append({r.query_id for r in todo.collect()})
            return spark.createDataFrame([(q, c, i + 1) for q, cs in rows.items() for i, c in enumerate(cs)], "query_id long, chunk_id long, rank int").join(todo.select("query_id"), "query_id", "left_semi")

        return ask

    first = answering({1: [1, 2], 2: [1, 10], 3: [3, 4], 4: [5], 5: [1, 2], 7: [1]})
    second = answering({1: [1, 3], 2: [1, 1], 5: [3], 4: [6], 7: []})
    third = answering({2: [2, 1], 7: [10, 11]})
    built = {r.query_id: (r.contexts, r.reasons, r.made_by, r.rounds) for r in A.build_contexts(asked, chunks, [("one", first), ("two", second), ("three", third)]).collect()}
    assert seen[0] == {1, 2, 3, 4, 5, 6, 7} and seen[1] == {1, 2, 4, 6, 7} and seen[2] == {2, 4, 6, 7}
    assert seen[3] == {4, 6} and len(seen) == 4  # the last round again, as it had improved something; then nothing improves
    assert built[1] == ([1, 3], [], "two", 2) and built[5] == ([1, 2], [], "one", 1)
    assert built[2] == ([2, 1], [], "three", 3) and built[3][1] == [] and built[7] == ([10, 11], [], "three", 3)
    assert built[4] == ([5], ["rejection_support_ambiguous"], "one", 4)
    assert built[6][:3] == ([], ["too_few_contexts", "followup_anchor_resolution_low"], "one")


def test_table_and_body_come_first(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 0), (1, 2, 0.8, 0), (1, 3, 0.7, 1), (1, 4, 0.6, 1), (2, 5, 0.5, 0)], "query_id long, chunk_id long, fusion_score double, has_table int")
    assert [(r.query_id, r.chunk_id) for r in A.table_and_body(rows, 3).orderBy("query_id", "rank").collect()] == [(1, 3), (1, 1), (1, 2), (2, 5)]


@pytest.mark.parametrize("pack, packs", [(1024, 64), (3, 64), (2, 1)])
def test_vectors_meet_in_packs(spark, monkeypatch, pack, packs):
    monkeypatch.setattr(R, "PACK", pack)
    monkeypatch.setattr(R, "QUERY_PACKS", packs)
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(23, 5)), rng.normal(size=(7, 5))
    v[4], v[9] = v[2], 0
    rows = spark.createDataFrame([*[(i, x.tolist()) for i, x in enumerate(v)], (99, None)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.distance) for r in R.vector_top(rows, asked, 4).collect()}
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    far = np.round(1 - unit(v) @ unit(q).T, 6)
    for k in range(7):
        want = sorted((far[i, k], i) for i in range(23))[:4]
        assert [got[k, r] for r in range(1, 5)] == [(i, d) for d, i in want]
    near = {r.chunk_id: (r.item_id, r.similarity) for r in R.best_official(rows, asked.withColumnRenamed("query_id", "item_id"), "chunk_id").collect()}
    cos = np.round(unit(v) @ unit(q).T, 6)
    assert near == {i: (int(np.flatnonzero(cos[i] == cos[i].max())[0]), cos[i].max()) for i in range(23)}


def test_a_cluster_needs_a_shared_folder():
    made = []
    context = lambda master: SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=made.append, master=master)
    session = lambda master, at: SimpleNamespace(sparkContext=context(master), conf=SimpleNamespace(get=lambda k, d: at))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        E.ensure_checkpoint_dir(session("spark://host:7077", None))
    E.ensure_checkpoint_dir(session("spark://host:7077", "hdfs:///shared"))
    E.ensure_checkpoint_dir(session("local[4]", None))
    assert made[0] == "hdfs:///shared" and len(made) == 2
