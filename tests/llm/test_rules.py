"""Line labels, the filter audit and the source audit against plain versions, and their edge cases."""

import re
from collections import Counter, defaultdict
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import divergence, interactions, lines
from lexiquarry.llm import queries as Q

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string"
LONG = "\n".join(f"Line {i} of a very long text says that {i % 977} is a number." for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta\n" * 30, "en", "s"),
    (2, "alpha beta gamma delta\n" * 30, None, None),
    (3, None, "en", "s"),
    (4, "", "", "t"),
    (5, LONG, "en", "t"),
    (6, "ein Wörṫ ### und $$$\n\n \n", "de", "t"),
    (6, "ein Wörṫ ### und $$$\n\n \n", "de", "t"),
    (None, "alpha beta gamma delta\n" * 30, "en", "s"),
]
CLASH = ("row", "labels", "n_words", "kept", "part", "digest", "id", "first", "good", "A", "E", "term", "n", "total", "v", "own", "chunk", "a.b")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


# ---- line labels


def plain_base(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def test_base_counts_of_all_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.QUERIES["op11_line_labels"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and 2 * r.content_words >= r.n_words)


def test_clean_documents_stay_and_junk_goes(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [r for r in Q.QUERIES["op11_line_labels"](spark, sf).collect() if not r.base_failed and r.doc_id in labels]
    good, bad = ([r.kept for r in judged if labels[r.doc_id] == k] for k in (1, 0))
    assert good and bad
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def a_chain(seed=1):
    rng = np.random.default_rng(seed)
    chain = lines.Chain()
    chain.weights, chain.table = rng.normal(size=lines.WIDTH), rng.normal(size=(2, 2))
    return chain, rng


def score(chain, unary, labels):
    return sum(u for u, y in zip(unary, labels, strict=True) if y) + sum(chain.table[a, b] for a, b in zip(labels, labels[1:], strict=False))


def test_viterbi_against_all_labellings():
    chain, rng = a_chain()
    for n in [1, 2, 3, 7, 10]:
        unary = rng.normal(size=n)
        best = max(product((0, 1), repeat=n), key=lambda y: score(chain, unary, y))
        assert tuple(chain.viterbi(unary)) == best
    assert len(chain.viterbi(np.zeros(0))) == 0
    assert tuple(lines.Chain().viterbi(np.zeros(4))) == (1, 1, 1, 1)  # ties are content


def test_expectations_against_all_labellings():
    chain, rng = a_chain(2)
    unary, lengths = rng.normal(size=(3, 5)), np.array([5, 3, 1])
    allowed = np.ones((3, 5, 2), dtype=bool)
    allowed[0, 2, 1] = allowed[1, 0, 0] = False
    total, content, pair = chain.expectations(unary, allowed, lengths)
    want_total, want_content, want_pair = 0.0, np.zeros((3, 5)), np.zeros((2, 2))
    for k, n in enumerate(lengths):
        ways = [y for y in product((0, 1), repeat=int(n)) if all(allowed[k, i, v] for i, v in enumerate(y))]
        w = np.exp([score(chain, unary[k, :n], y) for y in ways])
        want_total += np.log(w.sum())
        for y, p in zip(ways, w / w.sum(), strict=True):
            want_content[k, :n] += p * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                want_pair[a, b] += p
    assert total == pytest.approx(want_total)
    assert content == pytest.approx(want_content) and pair == pytest.approx(want_pair)


def test_gradients():
    chain, rng = a_chain(3)
    bins = np.stack([rng.integers(0, n, size=(4, 6)) for n in lines._SIZES], 2)
    y, lengths = rng.integers(0, 3, size=(4, 6)), np.array([6, 4, 2, 1])
    shown = rng.random(bins.shape) < 0.8
    _, by_weight, by_table = chain.gradients(bins, y, lengths, shown)
    for values, grad in ((chain.weights, by_weight), (chain.table, by_table)):
        for at in list(np.ndindex(values.shape))[:: max(1, values.size // 12)]:
            kept, losses = values[at], []
            for d in (1e-5, -1e-5):
                values[at] = kept + d
                losses.append(chain.gradients(bins, y, lengths, shown)[0])
            values[at] = kept
            assert grad[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6)


def test_neighbours_decide_an_open_line():
    """A line without evidence of its own goes with the lines around it."""
    chain = lines.Chain()
    chain.table = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert tuple(chain.viterbi(np.array([-3.0, 0.1, -3.0]))) == (0, 0, 0)
    assert tuple(chain.viterbi(np.array([3.0, -0.1, 3.0]))) == (1, 1, 1)


def test_line_edges(docs, empty):
    chain = lines.train(docs)
    rows = lines.judge(docs, chain).collect()
    assert sorted((r.row.doc_id or 0, r.n_words) for r in rows) == sorted((d or 0, plain_base(t)[0]) for d, t, _, _ in ROWS)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(r.row.text)
        assert r.n_lines == len(r.labels) == sum(bool(re.search(WORD, x)) for x in (r.row.text or "").split("\n"))
        assert r.content_lines == r.labels.count("c") and r.row.n_words == "clash"
        assert r.n_words or not r.kept
    assert lines.judge(empty, lines.train(empty)).count() == 0
    untrained = lines.train(empty)
    assert all(r.content_words == r.n_words for r in lines.judge(docs, untrained).collect())


def test_blocks_of_lines_do_not_show(docs, monkeypatch):
    chain = lines.train(docs)
    texts = [t.encode() for _, t, _, _ in ROWS if t]
    whole = [np.concatenate([b for b, _, _ in lines.Lines(t).blocks()]) for t in texts]
    monkeypatch.setattr(lines, "BLOCK", 7)
    for t, want in zip(texts[:1] + texts[-1:], whole[:1] + whole[-1:], strict=True):
        got = np.concatenate([b for b, _, _ in lines.Lines(t).blocks()])
        assert (got == want).all() and (chain.unary(got) == chain.unary(want)).all()


# ---- the filter audit


def plain_audit(rows, labels):
    first = {}
    for d, t, _, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    found = defaultdict(list)
    for d, t, lang, _ in rows:
        t = t or ""
        w = re.findall(WORD, t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and d > first[t],
        }
        marks = [any(i == d and d is not None and x[k] == 1 for i, *x in labels) for k in (0, 1)]
        found[lang or ""].append(({f for f, v in fails.items() if v}, *marks))
    out = {}
    for part, members in found.items():
        removed_over_all = Counter()
        for order in permutations("ABCDE"):
            left = members
            for k, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                removed_over_all[f] += len(gone)
                fails = sum(f in m[0] for m in members)
                out[part, "".join(order), k] = [len(left), len(gone), fails - len(gone), sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(removed_over_all[order[k - 1]])
    return out


LABELS = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (5, 0, 0), (6, 1, 1), (None, 1, 1), (77, 1, 1)]


def test_filter_edges(spark, docs, empty):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in interactions.audit(docs, labels).collect()}
    assert got == plain_audit(ROWS, LABELS)
    assert interactions.audit(empty, labels).count() == 0
    bare = {(r.part, r.filter_order, r.step): list(r[3:]) for r in interactions.audit(docs, labels.where("doc_id = -1")).collect()}
    assert bare == plain_audit(ROWS, [])


def test_shares_sum_to_what_all_filters_remove(spark, sf):
    rows = Q.QUERIES["op12_filter_interactions"](spark, sf).collect()
    n = Counter(r.lang or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang").collect())
    for part, total in n.items():
        one = [r for r in rows if r.part == part and r.filter_order == "ABCDE"]
        assert sum(r.shapley for r in one) == 120 * sum(r.removed for r in one)
        assert total == one[-1].kept + sum(r.removed for r in one)


def test_inversion_of_any_joint_counts(spark):
    """Random flags of three filters: survivors, unique failures and Shapley values against enumeration."""
    rng = np.random.default_rng(5)
    rows = [(str(rng.integers(3)), *map(int, rng.integers(0, 2, size=5))) for _ in range(300)]
    df = spark.createDataFrame(rows, "part string, A int, B int, C int, good int, toxic int")
    joint = interactions.joint_failures(df, "ABC")
    for r in joint.select("part", *[f("n", "ABC").alias(n) for n, f in (("left", lambda c, x: interactions.survivors(F.col(c), x)), ("only", lambda c, x: interactions.unique_failures(F.col(c), x)), ("shares", lambda c, x: interactions.shapley(F.col(c), x)))]).collect():
        own = [x[1:4] for x in rows if x[0] == r.part]
        assert list(r.left) == [sum(not any(x[i] and mask >> i & 1 for i in range(3)) for x in own) for mask in range(8)]
        assert list(r.only) == [sum(x[i] == 1 and sum(x) == 1 for x in own) for i in range(3)]
        shares = [0, 0, 0]
        for order in permutations(range(3)):
            for x in own:
                hit = next((i for i in order if x[i]), None)
                if hit is not None:
                    shares[hit] += 1
        assert list(r.shares) == shares


# ---- the source audit


def plain_divergence(rows, min_docs, top):
    terms = lambda t: re.findall(r"[a-z\u0080-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in rows:
        w = terms(t)
        in_docs[lang or ""].update(set(w))
        counts[lang or "", source or ""].update(w)
        groups[lang or ""].add(source or "")
    out = set()
    for lang, sources in groups.items():
        kept = sorted((w for w, k in in_docs[lang].items() if k >= min_docs), key=str.encode)
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        of = {s: p(counts[lang, s]) for s in sources}
        q = p(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            far = sorted(((-sum(abs(of[s][w] - of[o][w]) for w in kept), o.encode(), o) for o in sources if o != s))
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(far, 1)}
            more = sorted((q[w] - of[s][w], w.encode(), w) for w in kept if counts[lang, s][w] and of[s][w] > q[w])
            out |= {(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(more[:top], 1)}
    return out


@pytest.mark.parametrize("cells, block", [(1 << 20, 128), (40, 2), (1, 1)])
def test_divergence_in_chunks_and_blocks(spark, cells, block):
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("ab", "éa", "zz", "ßx", "日本", "Q") for b in ("", "k", "ü", "qq")]
    rows = [(k, " ".join(rng.choice(words, size=30, p=None)) + (" only here" * (k % 4)), ["en", "de", None][k % 3], f"s{k % 5}" if k % 7 else None) for k in range(90)]
    rows += [(90, "1234 ++", "en", "no terms"), (91, None, "xx", "a"), (92, "lonely", "xx", "b"), (93, "lonely", "yy", None)]
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs=4, top=5, cells=cells, block=block).collect()}
    assert got == plain_divergence(rows, 4, 5)


def test_divergence_edges(spark, docs, empty, monkeypatch):
    rows = divergence.audit(docs, min_docs=2).collect()
    assert {tuple(r) for r in rows} == plain_divergence(ROWS, 2, 50) and len(rows) == len(set(rows))
    assert divergence.audit(empty).count() == 0
    renamed = docs.select(F.col("text").alias("t.x"), F.col("lang").alias("l.x"), F.col("source").alias("s.x"))
    assert {tuple(r) for r in divergence.audit(renamed, min_docs=2, text="t.x", lang="l.x", source="s.x").collect()} == {tuple(r) for r in rows}


def test_probabilities_are_exact():
    counts = np.array([0, 1, 7, 10**6, 3 * 10**12, 4 * 10**15], dtype=np.int64)
    total, kept = 5 * 10**15, 10**9
    assert divergence.probability(counts, total, kept).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * kept) for c in counts]
