"""Near-duplicate documents by bottom-k sketches from one hash function.

1. One map makes each document's shingle set, its size, a fingerprint of the set and the k smallest hashes (the sketch).
   Documents with equal sets become one class by partial aggregation, however many they are.
2. The retained values are counted (inverted lists). Two sets at the threshold share at least a share t of their
   sketches, so they share one of the rarest values that a prefix of (1-t)k+1 leaves: only these lists are looked at, and
   values that half the corpus has are no keys. Values of one class alone use up the prefix: most documents drop out.
3. Each list yields overlaps by a matrix product over the values its members share; the union sketch of a pair estimates
   its Jaccard similarity and filters; a list returns a spanning forest of its members, never its pairs.
4. Components of these forests are candidate clusters. Members' full sets are built anew from the whole texts, dealt once by
   cluster, and all pairs of a cluster are verified exactly, again by matrix products; links form the final components.

Lists of more than ``list_block`` and clusters of more than ``block`` members are compared block against block in separate
tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_texts, materialize, table
from .components import connected
from .crosspoly import forest
from .hashing import shingles

K = 64
#: Standard errors by which an estimate may fall short of the threshold.
ERRORS = 5
#: Members compared with each other in one task: of an inverted list (sketches), of a candidate cluster (full sets).
LIST_BLOCK = 512
BLOCK = 2048
EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def slack(percent: int, k: int) -> float:
    """ERRORS standard errors of a share of k at the threshold: 0.22 at 85%, 0.25 at 80% with k = 64."""
    t = percent / 100
    return ERRORS * math.sqrt(t * (1 - t) / k)


def sketches(docs: DataFrame, *, doc_id: str, text: str, words: int, k: int) -> DataFrame:
    """(doc_id, n, fp, sketch): set size, fingerprint (null for an empty set) and the k smallest hashes, ascending."""

    def make():
        def run(texts):
            out = [[], [], []]
            for t in texts:
                s = shingles(t, words)
                out[0].append(len(s))
                out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out[2].append(s[:k].tobytes())
            return out

        return run

    fields = [T.StructField("n", T.LongType(), False), T.StructField("fp", T.BinaryType()), T.StructField("sketch", T.BinaryType(), False)]
    return map_texts(docs, make, fields, [doc_id], text).select(F.col(f"row.{doc_id}").cast("long").alias("doc_id"), "n", "fp", "sketch")


def in_blocks(rows: DataFrame, at: str, node: str, block: int) -> DataFrame:
    """Groups by ``at`` with two rows or more, each dealt as pairs of blocks (lo, hi) of about ``block`` rows; side says
    which block a row is of. A group up to that size is one pair."""
    sizes = rows.groupBy(at).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return (
        rows.join(sizes, at)
        .withColumn("side", F.pmod(F.xxhash64(node), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("side", "other"))
        .withColumn("hi", F.greatest("side", "other"))
        .drop("other", "parts")
    )


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, sizes: np.ndarray | None = None, columns: int = 4096) -> np.ndarray:
    """len(left) x len(right) sizes of intersections, by products over the values that at least two of the sets have."""
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, dtype=bool)
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1 if len(col) else np.zeros(0, dtype=bool)
    owner, col = owner[shared], col[shared]
    if len(col):
        col = np.cumsum(np.concatenate(([True], col[1:] != col[:-1]))) - 1
    where_l, where_r = np.full(len(sets), -1), np.full(len(sets), -1)
    where_l[left], where_r[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    width = min(columns, int(col[-1]) + 1) if len(col) else 0
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width or 1):
        a, b = np.searchsorted(col, (c, c + width))
        own, at = owner[a:b], col[a:b] - c
        ml, mr = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
        for m, where in ((ml, where_l), (mr, where_r)):
            mine = where[own] >= 0
            m[where[own[mine]], at[mine]] = 1
        out += ml @ mr.T
    return out


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Share of the k smallest of each union of two sketches (rows, padded with the largest number) that both hold."""
    pad = np.iinfo(np.uint64).max
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    double = np.concatenate((both[:, 1:] == both[:, :-1], np.zeros((len(both), 1), dtype=bool)), axis=1) & (both != pad)
    first = np.concatenate((np.ones((len(both), 1), dtype=bool), both[:, 1:] != both[:, :-1]), axis=1) & (both != pad)
    low = np.cumsum(first, axis=1) <= k
    return (double & first & low).sum(1) / np.maximum(1, (first & low).sum(1))


def pair_up(matrix: Callable[[np.ndarray, np.ndarray], np.ndarray], passes, left, right, same: bool, n: int, strip: int = 512) -> np.ndarray:
    """The least member reachable, for each of n members, through pairs that pass. Pairs are seen by falling overlap;
    those that are already connected need no further test."""
    lab = np.arange(n)
    for s in range(0, len(left), strip):
        rows = left[s : s + strip]
        o = matrix(rows, right)
        i, j = np.nonzero(o)
        w, i, j = o[i, j], rows[i], right[j]
        if same:
            up = i < j
            w, i, j = w[up], i[up], j[up]
        order = np.argsort(-w, kind="stable")
        for q in range(0, len(order), 50_000):
            part = order[q : q + 50_000]
            a, b, x = i[part], j[part], w[part]
            apart = lab[a] != lab[b]
            a, b, x = a[apart], b[apart], x[apart]
            if len(a):
                ok = passes(a, b, x)
                if ok.any():
                    f = forest(n, lab[a[ok]], lab[b[ok]])
                    lab = f[lab]
    return lab


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85, k: int = K, list_block: int = LIST_BLOCK, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per input row.

    Documents are linked when 100 * intersection >= percent * union. Null, empty and wordless texts have no shingles and
    link with nothing. Equal texts are linked; rows with one id count as one document. A null id is never linked; its
    component is null and it is kept; one that is no integer is an error. No documents give no rows.
    """
    low = max(0.0, percent / 100 - slack(percent, k))
    rows = materialize(sketches(docs, doc_id=doc_id, text=text, words=words, k=k), "sketches")
    classes = rows.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "sketch-classes")

    value = T.StructType([T.StructField("v", T.LongType()), T.StructField("node", T.LongType()), T.StructField("m", T.IntegerType())])
    value_arrow = to_arrow_schema(value)

    def invert(batches):
        for b in batches:
            s = [np.frombuffer(x, dtype=np.int64) for x in b.column(1).to_pylist()]
            n = np.array([len(x) for x in s], dtype=np.int32)
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s)), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(n, n))], schema=value_arrow)

    values = classes.select("node", "sketch").mapInArrow(invert, value)
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = values.join(shared, "v").groupBy("node").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))  # at most k values
    prefix = F.col("m") - F.ceil(F.lit(low) * F.col("m")).cast("int") + 1 - (F.col("m") - F.size("vs"))
    keys = lists.where(prefix > 0).select("node", F.explode(F.slice("vs", F.lit(1), F.greatest(prefix, F.lit(0)))).alias("e")).select("node", F.col("e.v").alias("v"))
    keys = materialize(keys, "sketch-keys")
    # only lists of two or more send their members' sketches
    few = keys.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v")
    entries = keys.join(few, "v").join(classes.select("node", "n", "sketch"), "node")

    def compare(t: pa.Table) -> pa.Table:
        ids, n, side = (t.column(c).to_numpy() for c in ("node", "n", "side"))
        order = np.argsort(ids, kind="stable")
        ids, n, side = ids[order], n[order], side[order]
        raw = t.column("sketch").to_pylist()
        sk = [np.frombuffer(raw[x], dtype=np.uint64) for x in order]
        left, right = np.flatnonzero(side == t.column("lo")[0].as_py()), np.flatnonzero(side == t.column("hi")[0].as_py())
        same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
        padded = np.full((len(sk), k), np.iinfo(np.uint64).max, dtype=np.uint64)
        for x, s in enumerate(sk):
            padded[x, : len(s)] = s

        def passes(a, b, o):
            big, small = np.maximum(n[a], n[b]), np.minimum(n[a], n[b])
            ok = (100 * small >= percent * big) & (o >= np.floor(low * np.minimum(big, k)))
            whole = big <= k  # the sketch is the set
            ok &= ~whole | (100 * o >= percent * (n[a] + n[b] - o))
            ask = np.flatnonzero(ok & ~whole)
            ok[ask] = union_estimate(padded[a[ask]], padded[b[ask]], k) >= low
            return ok

        lab = pair_up(lambda l, r: overlaps(sk, l, r), passes, left, right, same, len(ids))
        far = lab != np.arange(len(ids))
        return pa.table({"a": ids[far], "b": ids[lab[far]]}, schema=to_arrow_schema(EDGE))

    candidates = in_blocks(entries, "v", "node", list_block).groupBy("v", "lo", "hi").applyInArrow(compare, EDGE)
    found = connected(candidates)
    members = materialize(found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct(), "candidate-clusters")

    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("node"), F.col(f"`{text}`").alias("text")).join(members, "node")

    def sets_of():
        return lambda texts: [[shingles(t, words).tobytes() for t in texts]]

    full = map_texts(texts, sets_of, [T.StructField("set", T.BinaryType(), False)], ["node", "component"]).select("row.node", "row.component", "set")

    def verify(t: pa.Table) -> pa.Table:
        ids, side = (t.column(c).to_numpy() for c in ("node", "side"))
        order = np.argsort(ids, kind="stable")
        ids, side = ids[order], side[order]
        raw = t.column("set").to_pylist()
        sets = [np.frombuffer(raw[x], dtype=np.uint64) for x in order]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        left, right = np.flatnonzero(side == t.column("lo")[0].as_py()), np.flatnonzero(side == t.column("hi")[0].as_py())
        same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
        passes = lambda a, b, o: 100 * o.astype(np.int64) >= percent * (n[a] + n[b] - o.astype(np.int64))
        lab = pair_up(lambda l, r: overlaps(sets, l, r), passes, left, right, same, len(ids))
        far = (lab != np.arange(len(ids))) & (ids != ids[lab])
        return pa.table({"a": ids[far], "b": ids[lab[far]]}, schema=to_arrow_schema(EDGE))

    sides = materialize(full, "candidate-sets")
    links = in_blocks(sides, "component", "node", block).groupBy("component", "lo", "hi").applyInArrow(verify, EDGE)
    comp = connected(links)
    of_class = classes.select("fp", "node").join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n", "fp").join(of_class, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
