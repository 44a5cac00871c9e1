"""Models against plain versions: marginals by enumeration, attention and gradients by hand, recall, folders and long chains."""

import itertools
import math

import numpy as np
import pytest

from lexiquarry.llm import common, components, crf, mil, minhash

from . import brute as B


def exact_marginals(unary, edges, pots):
    n, labels = unary.shape
    total = np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n):
        w = math.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pots[k][y[i], y[j]] for i, j, k in edges))
        for i in range(n):
            total[i, y[i]] += w
    return total / total.sum(1, keepdims=True)


def test_marginals_are_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(2)
    field = crf.Field()
    field.unary, field.chain, field.skip = rng.normal(size=field.unary.shape), rng.normal(size=field.chain.shape) * 0.5, np.array([0.8, 0.4])
    x = rng.normal(size=(5, crf.WIDTH)) * 0.2
    allowed = np.ones((5, field.LABELS), dtype=bool)
    allowed[2, 3] = False
    unary = x @ field.unary + np.where(allowed, 0.0, -1e9)
    for edges, near in (([(0, 1, 0), (1, 2, 0), (1, 4, 1), (2, 3, 2)], 1e-3), ([(0, 1, 0), (1, 2, 0), (0, 2, 1), (2, 3, 2), (3, 4, 0)], 0.08)):
        got = field.marginals(x, allowed, np.array(edges))
        assert np.abs(got - exact_marginals(unary, edges, field._pots())).max() < near


def test_marginals_do_not_depend_on_other_documents():
    field = crf.Field()
    rng = np.random.default_rng(3)
    field.unary, field.skip = rng.normal(size=field.unary.shape), np.array([1.0, 0.5])
    x = rng.normal(size=(40, crf.WIDTH)) * 0.3
    allowed = np.ones((40, field.LABELS), dtype=bool)
    chain = np.array([(i, i + 1, 1) for i in range(39)])
    first = np.array([(0, 1, 1)])
    alone = field.marginals(x[:2], allowed[:2], first)
    both = field.marginals(x, allowed, np.concatenate((first, chain[2:])), np.array([0, 0] + [1] * 38))
    assert (alone == both[:2]).all()


def test_neighbouring_words_are_seen():
    a, b = (crf.nodes(t, []) for t in ("call 555-1234 now", "item 555-1234 now"))
    assert len(a) == len(b) == 1 and a[0][3] != b[0][3] and a[0][3][len(crf.FEATURES) + crf.CONTEXT :] == b[0][3][len(crf.FEATURES) + crf.CONTEXT :]
    assert all(sum(n[3][len(crf.FEATURES) :]) == 2 for n in crf.nodes("1 2 x 3", []))


def test_added_spans_against_all_pairs():
    rng = np.random.default_rng(6)
    for _ in range(50):
        words = [str(rng.choice(["jane[at]mail[dot]org", "4111", "x@y.zz", "12", "bob[at]b.org"])) for _ in range(12)]
        text = " ".join(words)
        base = crf.base_spans(text)
        graph = crf.nodes(text, base)
        p = np.zeros((len(graph), 5))
        p[:, 1] = 1
        got = crf.added(text, base, graph, p, 0.9)
        want = [(0, n[1], n[2]) for n in graph if crf.check(0, text[n[1] : n[2]]) and not any(a < n[2] and n[1] < b for _, a, b in base)]
        assert got == want


def plain_logit(model, x):
    p = model.p
    z = np.clip((x - model.mean) / model.std, -6, 6)
    h = [np.tanh(row @ p["W"] + p["b"]) for row in z]
    e = [math.fsum(math.tanh(a) / (1 + math.exp(-b)) * w for a, b, w in zip(row @ p["V"], row @ p["U"], p["w"], strict=True)) for row in h]
    a = [math.exp(v - max(e)) for v in e]
    bag = sum(v / sum(a) * row for v, row in zip(a, h, strict=True))
    return float(bag @ p["c"] + p["d"])


def test_attention_and_gradients():
    rng = np.random.default_rng(1)
    model, counts = mil.Model(), np.array([3, 1, 4])
    x = rng.normal(size=(8, mil.FEATURES))
    y = np.array([1.0, 0.0, 1.0])
    logits = model.forward(x, counts)["logit"]
    assert logits == pytest.approx([plain_logit(model, x[a:b]) for a, b in ((0, 3), (3, 4), (4, 8))])
    loss = lambda: float(np.mean([math.log1p(math.exp(-v if t else v)) for v, t in zip(model.forward(x, counts)["logit"], y, strict=True)]))
    grads = model.gradients(x, counts, y)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in np.shape(model.p[name]))
            kept = model.p[name]
            up, down = (np.array(kept, dtype=np.float64) for _ in range(2))
            up[at] += 1e-6
            down[at] -= 1e-6
            model.p[name] = up
            high = loss()
            model.p[name] = down
            low = loss()
            model.p[name] = kept
            assert (high - low) / 2e-6 == pytest.approx(float(np.asarray(g)[at]), abs=1e-6)


def test_held_out_ranking(spark, sf):
    """A held-out document of label 1 scores above one of label 0 in nine of ten pairs."""
    from lexiquarry.llm import queries as Q

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in Q.QUERIES["op9_gated_attention"](spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, q in rows if q == 1], [s for s, q in rows if q == 0]
    if good and bad:
        assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.9 * len(good) * len(bad)


def test_minhash_recall_near_the_threshold(spark):
    """Every pair at 0.85 to 0.90 among 40 families is linked, as all pairs of shingle sets say."""
    import random

    rng = random.Random(12)
    rows = []
    for f in range(40):
        base = [f"f{f}w{i}" for i in range(rng.randrange(120, 400))]
        for v in range(4):
            w = list(base)
            for _ in range(max(1, round(len(w) * 0.022))):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((4 * f + v, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == B.near(rows)


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            self.at = value

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session()).startswith("file:")


def test_long_chain_is_one_component(spark):
    links = spark.range(0, 5000).selectExpr("id AS a", "id + 1 AS b")
    got = {r.node: r.component for r in components.connected(links).collect()}
    assert got == {i: 0 for i in range(1, 5001)}


def test_pipeline_stages_with_odd_rows(spark, sf):
    """Nulls, repeated rows and clashing names pass every stage; empty tables give none."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(None, None), (None, "kept without an id " * 20), (10**9, ""), (10**9 + 1, None), (10**9 + 2, "twice the same words " * 30), (10**9 + 2, "twice the same words " * 30)], "doc_id long, text string")
    odd = docs.limit(30).unionByName(odd, allowMissingColumns=True).withColumns({c: F.lit("clash") for c in ("row", "score", "kept", "size", "__size", "mix")})
    for name, stage in P.STAGES[1:4]:
        out = stage(spark, odd, sf)
        assert out.columns == [*columns, "row", "score", "kept", "size", "__size", "mix"]
        ids = [r.doc_id for r in out.collect()]
        if name == "near_duplicates":
            assert ids.count(10**9 + 2) == 1 and ids.count(None) == 2 and {10**9, 10**9 + 1} <= set(ids)
        if name == "benchmark_passages":
            assert ids.count(10**9 + 2) == 2 and ids.count(None) == 2
    assert P.quality(spark, odd, sf).columns == odd.columns
    assert {(r["__size"], r.row) for r in P.source_mix(spark, odd, sf).collect()} <= {("clash", "clash")}
    assert P.token_ids(spark, odd, sf).count() == odd.count()
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_a_long_chain_settles():
    """Evidence at one end reaches the other, more rounds away than the usual limit: the exact marginals of a chain."""
    from lexiquarry.llm import crf

    rng = np.random.default_rng(3)
    n, field = 900, crf.Field()
    field.skip = np.array([9.0, 0.0])
    field.unary = np.zeros((crf.WIDTH, field.LABELS))
    field.unary[1] = rng.normal(size=field.LABELS) * 4
    x = np.zeros((n, crf.WIDTH))
    x[0, 1] = 1
    edges = np.array([(k, k + 1, 1) for k in range(n - 1)])
    p = field.marginals(x, np.ones((n, field.LABELS), dtype=bool), edges)
    pot = np.exp(np.eye(field.LABELS) * 9.0)
    forward, back = [np.exp(x[0] @ field.unary)], [np.ones(field.LABELS)]
    for _ in range(n - 1):
        for side in (forward, back):
            side.append(side[-1] @ pot)
            side[-1] /= side[-1].sum()
    exact = np.array(forward) * np.array(back[::-1])
    assert np.abs(p - exact / exact.sum(1, keepdims=True)).max() < 0.02
    assert p[-1].argmax() == field.unary[1].argmax()


def test_a_field_that_does_not_settle_ends():
    """After the rounds allowed, a graph's marginals are a fixed point of the mean field; other graphs do not notice."""
    from lexiquarry.llm import crf

    rng = np.random.default_rng(8)
    field = crf.Field()
    field.unary = rng.normal(size=(crf.WIDTH, field.LABELS))
    field.chain = rng.normal(size=(field.LABELS, field.LABELS)) * 6
    x = rng.random((9, crf.WIDTH)) < 0.1
    x, graph = x.astype(float), np.array([0] * 6 + [1] * 3)
    edges = np.array([(a, b, 0) for a in range(6) for b in range(a + 1, 6)] + [(6, 7, 0), (7, 8, 0)])
    allowed = np.ones((9, field.LABELS), dtype=bool)
    p = field.marginals(x, allowed, edges, graph, rounds=1, per_node=0)
    assert p.sum(1) == pytest.approx(np.ones(9)) and np.isfinite(p).all()
    alone = field.marginals(x[6:], allowed[6:], np.array([(0, 1, 0), (1, 2, 0)]), rounds=1, per_node=0)
    assert p[6:] == pytest.approx(alone)
    for i in range(6):
        z = x[i] @ field.unary
        for a, b, _ in edges[:15]:
            z = z + (field.chain @ p[b] if a == i else field.chain.T @ p[a] if b == i else 0.0)
        z = np.exp(z - z.max())
        assert p[i] == pytest.approx(z / z.sum(), abs=1e-4)
