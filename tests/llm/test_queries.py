"""Each query against the contract written out plainly, on whole small tables."""

import duckdb
import pytest

from lexiquarry.llm import queries as Q
from lexiquarry.llm import tokens

from . import brute as B

SPEC = {
    "op2_skip_chain_crf": ("doc_id", ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"], lambda t: {d: B.private(x) for d, x in t["documents"]}),
    "op3_blob_ledger": ("doc_id", ["n_assign", "n_access", "n_hex", "base_sha256"], lambda t: {d: B.secrets(x) for d, x in t["documents"]}),
    "op5_minhash_bottom_k": ("doc_id", ["n_shingles", "component_id", "kept"], lambda t: B.near(t["documents"])),
    "op6_run_length_index": ("doc_id", ["n_bytes", "n_removed", "n_spans", "kept_sha256"], lambda t: B.repeats(t["documents"])),
    "op7_wu_manber": ("doc_id", ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"], lambda t: B.contaminated(t["documents"], t["benchmark"])),
    "op8_token_output": ("doc_id", ["start", "n_tokens", "ids_crc32"], lambda t: B.token_ids(t["documents"], tokens.default_tokenizer())),
    "op10_cross_polytope": ("vec_id", ["n_links", "component_id", "kept"], lambda t: B.vector_links(t["embeddings"])),
}


@pytest.mark.parametrize("name", sorted(SPEC))
def test_against_brute_force(name, spark, sf, tables):
    key, cols, want = SPEC[name]
    got = {r[0]: tuple(r[1:]) for r in Q.QUERIES[name](spark, sf).select(key, *cols).collect()}
    assert got == want(tables)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.execute(Q.ORACLES[name]).df()
    got = Q.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    names = list(want.columns)
    want, got = want.sort_values(names).reset_index(drop=True), got[names].sort_values(names).reset_index(drop=True)
    assert got.equals(want.astype(got.dtypes.to_dict()))


def test_katz(spark, sf, tables):
    want = B.base_score(tables["documents"])
    rows = Q.QUERIES["op1_katz"](spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_is_normalised_and_recursive(spark, sf, tables, order):
    """A dictionary model with the same discounts sums to one after every context and scores every text alike; small
    blocks and shards, so that contexts are spread."""
    from lexiquarry.llm import katz

    model = B.Katz(tables["documents"], katz.discounts, order)
    for h in sorted(model.follow, key=lambda h: (-len(model.follow[h]), str(h)))[:40]:
        assert sum(model.p(h, w) for w in [*model.uni, "an unseen word"]) == pytest.approx(1, abs=1e-9)
    rows = katz.score(spark.read.parquet(f"{sf}/documents.parquet"), order=order, block_tokens=9000, shard_tokens=1000).collect()
    texts = dict(tables["documents"])
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-9, abs=1e-6)


def test_classifier_on_held_out_rows(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.QUERIES["op9_gated_attention"](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    seen = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in seen) >= 0.8 * len(seen)


def test_katz_tables_are_stored_on_request(spark, tmp_path):
    """Whole count tables stand by order beside the answers, and the scores are the same."""
    from pyspark.sql import functions as F

    from lexiquarry.llm import common, katz

    docs = spark.createDataFrame([(i, "a b c a b " * (i % 5) + f"w{i}") for i in range(60)], "doc_id long, text string")
    plain = {r.doc_id: r.score for r in katz.score(docs, shard_tokens=50).collect()}
    known = len(common._written)
    kept = {r.doc_id: r.score for r in katz.score(docs, shard_tokens=50, keep_tables=True).collect()}
    assert kept == plain
    tables = [p for p in common._written[known:] if "/lm-" in p and "tokens" not in p]
    for k, path in enumerate(sorted(tables), 1):
        rows = spark.read.parquet(path).where(F.col("kind") == katz.TABLE + 10 * k).collect()
        counts = [c for r in rows for c in katz.unpacked(katz.split(r.body)[1]).tolist()]
        assert len(counts) == sum(r.other for r in rows) > 0 and min(counts) >= 1
    assert len(tables) == 3


def test_katz_sorting():
    import numpy as np

    from lexiquarry.llm import katz

    rng = np.random.default_rng(1)
    for x in (np.zeros(0, dtype=np.int64), rng.integers(-1, 9, 1000), rng.integers(0, 1 << 40, 500), rng.integers(0, 1 << 62, 500)):
        assert (katz.sorting(x) == np.argsort(x, kind="stable")).all()
        for got, want in zip(katz.distinct(x), np.unique(x, return_index=True, return_inverse=True), strict=True):
            assert (got == want).all()
