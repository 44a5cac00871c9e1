"""Embedding near-duplicates by cross-polytope hashing.

Vectors are turned by fast pseudo-random rotations (three rounds of random signs and a Walsh-Hadamard transform); the
hash is the coordinate with the largest magnitude, with its sign. A vector enters its own bucket and, as multiprobe, the
buckets of its next-largest coordinates, in each table. Pairs that meet are verified by exact cosine in double precision
and counted once, in the first bucket they share.

Scale: equal vectors are one row with a multiplicity. The number of concatenated hashes grows with the logarithm of the
number of vectors, and the number of tables follows from a simulated chance of meeting at the threshold and the recall
asked for. A bucket of more than ``block`` rows is compared block against block in separate tasks, so a bucket of any
size is done whole and no task holds more than two blocks; pairs stay inside the task, which returns a count per vector and a
spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, table
from .components import connected

SEED = 20_240_601


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes(unit: np.ndarray, table_no: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, 1 + probes) bucket numbers: the vector's own, then those in which one hash takes its next-best value."""
    n, dim = unit.shape
    size = 1 << max(1, (dim - 1).bit_length())
    rows = np.arange(n)
    own, gaps, others = [], [], []
    for k in range(hashes):
        rng = np.random.default_rng((SEED, table_no, k, size))
        x = np.zeros((n, size))
        x[:, :dim] = unit
        for _ in range(3):
            x = hadamard(x * rng.choice((-1.0, 1.0), size))
        mag = np.abs(x)
        top = np.argsort(-mag, axis=1, kind="stable")[:, : probes + 1]
        val = 2 * top + (x[rows[:, None], top] < 0)
        own.append(val[:, 0])
        others.append(val[:, 1:])
        gaps.append(mag[rows, top[:, 0]][:, None] - mag[rows[:, None], top[:, 1:]])
    base = np.array([(2 * size) ** k for k in range(hashes)], dtype=np.int64)
    home = sum(o * b for o, b in zip(own, base, strict=True))
    gap = np.concatenate(gaps, axis=1)
    moved = np.concatenate([home[:, None] + (o - w[:, None]) * b for o, w, b in zip(others, own, base, strict=True)], axis=1)
    pick = np.argsort(gap, axis=1, kind="stable")[:, :probes]
    return np.concatenate((home[:, None], moved[rows[:, None], pick]), axis=1)


def tables_for(dim: int, hashes: int, probes: int, least: float, recall: float) -> int:
    """Tables needed, from the simulated chance that two vectors at the threshold share a bucket of one table."""
    rng = np.random.default_rng(SEED)
    a = rng.normal(size=(4000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = least * a + math.sqrt(max(0.0, 1 - least * least)) * b
    met = float((codes(a, 0, hashes, probes)[:, :, None] == codes(b, 0, hashes, probes)[:, None, :]).any((1, 2)).mean())
    met = min(max(met, 1e-3), 1 - 1e-6)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def narrow(dim: int, hashes: int) -> np.dtype:
    """The smallest type that holds the bucket numbers of vectors of this length."""
    return np.min_scalar_type((2 << max(1, (dim - 1).bit_length())) ** hashes - 1)


def _units(lists) -> np.ndarray:
    x = np.array(lists, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reachable, for each of n nodes and links (i, j)."""
    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        new = np.minimum(new, new[lab])
        while (new != new[new]).any():
            new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


FOUND = T.StructType([T.StructField("class_id", T.LongType()), T.StructField("links", T.LongType()), T.StructField("root", T.LongType())])


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93, recall: float = 0.9995, probes: int = 2, bucket_goal: int = 4096, block: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per input row; rows are compared when labels and dimensions agree.

    A null or zero vector, one with a null or non-finite component, a null label or a null id links with nothing:
    n_links 0, its own component, kept. Equal vectors are linked with each other and count one each; repeated rows are
    separate vectors. An id that is no integer is an error. No vectors give no rows.
    """
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), F.col(f"`{label}`").cast("string").alias("label"))
    rows = rows.withColumn("key", F.when(ok, F.md5(F.concat_ws("|", "label", F.array_join(F.transform(e, lambda x: x.cast("string")), ",")).cast("binary"))))
    classes = materialize(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("m"), F.first("embedding").alias("embedding"), F.first("label").alias("label")), "vector-classes")
    shapes = classes.groupBy(F.size("embedding").alias("dim")).count().collect()
    n = sum(r["count"] for r in shapes)
    dims = sorted(r["dim"] for r in shapes)  # of vector lengths there are few
    plan = {}
    for d in dims:
        hashes = max(1, math.ceil(math.log(max(1, n / bucket_goal)) / math.log(2 << max(1, (d - 1).bit_length()))))
        p = min(probes * hashes, hashes * (d - 1)) if d > 1 else 0
        plan[d] = (hashes, p, tables_for(d, hashes, p, least, recall))
    entry = T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("dim", T.IntegerType()),
            T.StructField("tab", T.IntegerType()),
            T.StructField("bucket", T.LongType()),
            T.StructField("class_id", T.LongType()),
            T.StructField("m", T.LongType()),
            T.StructField("embedding", classes.schema["embedding"].dataType),
            T.StructField("codes", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(entry)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding").to_pylist()
            size = np.array([len(x) for x in lists])
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                hashes, p, tabs = plan[int(d)]
                c = np.stack([codes(_units([lists[k] for k in own]), t, hashes, p) for t in range(tabs)], axis=1)
                part = b.take(pa.array(own))
                flat = pa.array([x.tobytes() for x in c.reshape(len(own), -1).astype(narrow(int(d), hashes))], type=pa.binary())
                for t in range(tabs):
                    for q in range(c.shape[2]):
                        cols = [part.column("label"), pa.array(np.full(len(own), d, np.int32)), pa.array(np.full(len(own), t, np.int32)), pa.array(c[:, t, q]), part.column("class_id"), part.column("m"), part.column("embedding"), flat]
                        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

    dealt = classes.select("label", "class_id", "m", "embedding").mapInArrow(deal, entry)
    at = ["label", "dim", "tab", "bucket"]
    hashed = materialize(dealt, "vector-buckets")
    sizes = hashed.groupBy(*at).count().where("count > 1")  # alone in its bucket: nothing to compare
    sizes = sizes.withColumn("parts", F.ceil(F.col("count") / block).cast("int")).drop("count")
    own = F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    pairs = (
        hashed.join(sizes, at)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("other", "parts")
    )

    def compare(t: pa.Table) -> pa.Table:
        d, tab, bucket = t.column("dim")[0].as_py(), t.column("tab")[0].as_py(), t.column("bucket")[0].as_py()
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        ids, m, side = (t.column(c).to_numpy() for c in ("class_id", "m", "own"))
        lists = t.column("embedding").combine_chunks()
        unit = _units(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d))
        code = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=narrow(d, plan[d][0])).astype(np.int64).reshape(len(ids), plan[d][2], -1)
        left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        found_i, found_j = [], []
        for s in range(0, len(left), 512):
            i, j = np.nonzero(unit[left[s : s + 512]] @ unit[right].T >= least)
            i, j = left[s : s + 512][i], right[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            for q in range(0, len(i), 100_000):
                a, b = i[q : q + 100_000], j[q : q + 100_000]
                first = np.ones(len(a), dtype=bool)  # met in no earlier table, nor in a lower bucket of this one
                for k in range(tab + 1):
                    same = code[a, k][:, :, None] == code[b, k][:, None, :]
                    first &= ~(same.any((1, 2)) if k < tab else (same & (code[a, k][:, :, None] < bucket)).any((1, 2)))
                found_i.append(a[first])
                found_j.append(b[first])
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (found_i, found_j))
        links = np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(ids))
        root = ids[order[forest(len(ids), place[i], place[j])[place]]]
        some = links > 0
        return pa.table({"class_id": ids[some], "links": links[some].astype(np.int64), "root": root[some]}, schema=to_arrow_schema(FOUND))

    found = materialize(pairs.groupBy(*at, "lo", "hi").applyInArrow(compare, FOUND), "vector-links")
    comp = connected(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    result = classes.select("key", "class_id", "m").join(counts, "class_id", "left").join(comp.withColumnRenamed("node", "class_id"), "class_id", "left")
    result = result.select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "class_id").alias("component"))
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", "key").join(result, "key", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
