"""Quality classifier: multiple-instance learning with gated attention.

A document is a bag of passages of ``passage`` words. A passage's features (shares of upper case, digits, punctuation,
repetition and so on, and hashed words) are encoded by one hidden layer; attention weights softmax(w . (tanh(V h) *
sigmoid(U h))) over the passages of a document give its representation, and a logistic unit scores it. Only documents
have labels; which passages matter is learned.

Training takes at most ``max_docs`` labelled documents and ``max_passages`` passages (a hash of doc_id picks them), in
NumPy on the driver; scoring is one map over all whole texts, without a shuffle.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_texts, table, task_cache

PASSAGE = 64
BUCKETS = 128
CACHE_WORDS = 250_000
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_LOW = bytes(range(97, 123))
_HIGH = bytes(range(128, 256))
#: Statistics of a word: bytes, capitals, digits, marks, high bytes, two marks or more at its end, only capitals, only marks.
STATS = 8
#: Statistics of a passage besides: distinct words, the most frequent word, words, adjacent repeats.
FEATURES = STATS + 4 + BUCKETS


class Words:
    """Statistics of words, remembered between tasks of a Python process up to CACHE_WORDS words."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.place: dict[bytes, int] = {}
        self.stats = np.zeros((1 << 14, STATS), dtype=np.float32)
        self.bucket = np.zeros(1 << 14, dtype=np.int32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > CACHE_WORDS:
            self.clear()
        place = self.place
        for w in {*words} - place.keys():
            k = len(place)
            if k >= len(self.bucket):
                self.stats = np.concatenate((self.stats, np.zeros_like(self.stats)))
                self.bucket = np.concatenate((self.bucket, np.zeros_like(self.bucket)))
            n = len(w)
            upper, digit, high, low = (n - len(w.translate(None, x)) for x in (_UPPER, _DIGIT, _HIGH, _LOW))
            marks = n - upper - digit - high - low
            tail = n - len(w.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) if marks > 1 else 0
            self.stats[k] = (min(n, 40), upper / n, digit / n, marks / n, high / n, tail > 1, upper > 1 and not low, marks == n)
            self.bucket[k] = zlib.crc32(w.lower()) % BUCKETS
            place[w] = k
        return np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))


@lru_cache(maxsize=1)
def words_seen() -> Words:
    return Words()


def forget() -> None:
    words_seen().clear()


task_cache(forget)


def features(texts: list[bytes | None], passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES, the number of passages of each text); a text without words is one passage of zeros."""
    split = [t.split() if t else [] for t in texts]
    seen = words_seen()
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    counts = np.maximum(1, -(-sizes // passage))
    ids = seen.ids([w for s in split for w in s])
    total = int(counts.sum())
    x = np.zeros((total, FEATURES), dtype=np.float32)
    if len(ids):
        doc = np.repeat(np.arange(len(split)), sizes)
        within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        owner = (np.cumsum(counts) - counts)[doc] + within // passage
        n = np.bincount(owner, minlength=total).astype(np.float32)
        full = np.maximum(n, 1)
        for k in range(STATS):
            x[:, k] = np.bincount(owner, seen.stats[ids, k], total) / full
        key, many = np.unique(owner * (1 << 32) + ids, return_counts=True)
        at = key >> 32
        x[:, STATS] = np.bincount(at, minlength=total) / full
        top = np.zeros(total)
        np.maximum.at(top, at, many)
        x[:, STATS + 1] = top / full
        x[:, STATS + 2] = np.log1p(n)
        same = np.flatnonzero((ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])) + 1
        x[:, STATS + 3] = np.bincount(owner[same], minlength=total) / full
        bag = np.bincount(owner * BUCKETS + seen.bucket[ids], minlength=total * BUCKETS).reshape(total, BUCKETS)
        x[:, STATS + 4 :] = np.sqrt(bag / full[:, None])
    return x, counts


class Model:
    """Gated attention over encoded passages; plain NumPy, trained with Adam."""

    SHAPES = {"W": (FEATURES, 24), "b": (24,), "V": (24, 12), "U": (24, 12), "w": (12,), "c": (24,), "d": ()}

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {k: np.asarray(rng.normal(size=s) / np.sqrt(s[0] if s else 1), dtype=np.float64) * (k not in "bd") for k, s in self.SHAPES.items()}
        self.mean, self.std, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(counts)), counts)
        z = np.clip((x - self.mean) / self.std, -6, 6)
        h = np.tanh(z @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (tv * su) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        a /= np.add.reduceat(a, starts)[owner]
        bag = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"z": z, "h": h, "tv": tv, "su": su, "a": a, "bag": bag, "owner": owner, "logit": bag @ p["c"] + p["d"], "starts": starts}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.forward(x, counts)["logit"], -40, 40)))

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by parameter."""
        f = self.forward(x, counts)
        g_logit = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
        g_bag = g_logit[:, None] * self.p["c"]
        own = f["owner"]
        g_a = (g_bag[own] * f["h"]).sum(1)
        mean = np.add.reduceat(f["a"] * g_a, f["starts"])
        g_e = f["a"] * (g_a - mean[own])
        g_tv = g_e[:, None] * self.p["w"] * f["su"] * (1 - f["tv"] ** 2)
        g_su = g_e[:, None] * self.p["w"] * f["tv"] * f["su"] * (1 - f["su"])
        g_h = (f["a"][:, None] * g_bag[own] + g_tv @ self.p["V"].T + g_su @ self.p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["z"].T @ g_h, "b": g_h.sum(0), "V": f["h"].T @ g_tv, "U": f["h"].T @ g_su, "w": (f["tv"] * f["su"]).T @ g_e, "c": f["bag"].T @ g_logit, "d": g_logit.sum()}

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, batch: int = 256, seed: int = 5) -> Model:
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        self.mean, self.std = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-3
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        step = 0
        starts = np.cumsum(counts) - counts
        for epoch in range(epochs):
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = rng.permutation(len(y))
            for s in range(0, len(order), batch):
                docs = order[s : s + batch]
                rows = np.concatenate([np.arange(starts[d], starts[d] + counts[d]) for d in docs])
                grads = self.gradients(x[rows], counts[docs], y[docs])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, fold: int = 0, max_docs: int = 4000, max_passages: int = 150_000) -> Model:
    """Fits on labelled rows outside the held-out fold: at most max_docs documents, chosen by a hash of doc_id, and of
    those, in that order, as many as have max_passages passages together. Null labels and ids are left out; a doc_id
    with several labels takes the largest. Without labels every score is 0.5, with one class that class."""
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id), folds, fold))
    usable = usable.groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("double").alias("__y"))
    usable = usable.orderBy(F.xxhash64("__id", F.lit(17)), "__id").limit(max_docs)
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(usable), "__id")

    def make():
        def run(texts):
            x, counts = features(texts)
            cuts = np.cumsum(counts)[:-1]
            return [[p.astype(np.float16).tobytes() for p in np.split(x, cuts)]]

        return run

    got = map_texts(rows, make, [T.StructField("x", T.BinaryType(), False)], ["__id", "__y"]).select("row.*", "x").distinct()
    got = got.orderBy(F.xxhash64("__id", F.lit(17)), "__id", "x").toArrow() if not rows.isEmpty() else None
    bags, y, total = [], [], 0
    for raw, value in zip(got["x"].to_pylist(), got["__y"].to_pylist(), strict=True) if got is not None else ():
        bag = np.frombuffer(raw, dtype=np.float16).reshape(-1, FEATURES).astype(np.float32)
        if total + len(bag) > max_passages:
            continue
        total += len(bag)
        bags.append(bag)
        y.append(value)
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), dtype=np.float32)
    return Model().fit(x, np.array([len(b) for b in bags], dtype=np.int64), np.array(y))


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (columns in keep), score and n_passages, a row per document; null and empty texts are scored as a bag of
    one empty passage. Repeated rows get the same score."""

    def make():
        def run(texts):
            out, passages = [], []
            for s in range(0, len(texts), 256):  # bounds the feature matrix
                x, counts = features(texts[s : s + 256])
                out.append(model.scores(x, counts))
                passages.append(counts)
            return [np.concatenate(out), np.concatenate(passages)]

        return run

    return map_texts(docs, make, [T.StructField("score", T.DoubleType(), False), T.StructField("n_passages", T.LongType(), False)], keep, text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=["doc_id"]).select("row.doc_id", held_out(F.col("row.doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
