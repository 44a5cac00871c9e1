"""The pipeline against a plain version of its stages, with the classifier's own decisions taken as given."""

import corpus_pipeline as P
from lexiquarry.llm import mil, mixing, tokens

from . import brute as B


def test_pipeline(spark, sf, tables):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    scores = {r.row.doc_id: r.score for r in mil.score(docs, mil.train(docs, spark.read.parquet(f"{sf}/labels.parquet")), keep=["doc_id"]).collect()}
    rows = [(d, t) for d, t in tables["documents"] if scores[d] >= 0.3]
    out = docs
    out = P.materialize(P.quality(spark, out, sf), "t")
    assert out.columns == columns and {r.doc_id for r in out.collect()} == {d for d, _ in rows}
    near = B.near(rows, 5, 80)
    rows = [(d, t) for d, t in rows if near[d][2]]
    out = P.materialize(P.near_duplicates(spark, out, sf), "t")
    assert out.columns == columns and {r.doc_id for r in out.collect()} == {d for d, _ in rows}
    bad = B.contaminated(rows, tables["benchmark"])
    rows = [(d, t) for d, t in rows if not bad[d][4]]
    out = P.materialize(P.benchmark_passages(spark, out, sf), "t")
    assert out.columns == columns and {r.doc_id for r in out.collect()} == {d for d, _ in rows}
    copies = {r.row.doc_id: r.mix.copies for r in mixing.plan_mix(out).collect()}
    out = P.materialize(P.source_mix(spark, out, sf), "t")
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(d for d, _ in rows for _ in range(copies[d]))
    want = []
    start = 0
    one = B.token_ids(rows, tokens.default_tokenizer())
    for d, _ in sorted(rows):
        for _ in range(copies[d]):
            want.append((d, start, *one[d][1:]))
            start += one[d][1]
    assert sorted(tuple(r) for r in P.run(spark, sf).collect()) == want
