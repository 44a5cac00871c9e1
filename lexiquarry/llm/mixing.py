"""Mixing sources to target weights, in DataFrame functions only.

Words are counted per source with map-side partial sums; targets come from one pass over the per-source table (a row per
source, never per document); each document is then emitted floor(rate) times plus one Bernoulli copy whose coin is a
hash of its id and a seed, so reruns agree and no state is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Sources up to this number are joined by broadcast (about 60 bytes each); beyond it the join shuffles, salted.
BROADCAST_SOURCES = 100_000
SALTS = 64
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """totals: (source, source_size). Adds weight and target.

    Weights repeat over the sources in code-point order, null last, and share all words. A target stops at cap times
    its source's size and the excess goes to the others by weight. With sources in ascending order of cap*size/weight,
    the water level of those not yet capped is (all words - caps before) / (weights from here on); it is greatest where
    the capped prefix ends, so the level is the maximum, and the target is the lesser of cap*size and level*weight.
    """
    n = len(weights)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % n + 1).cast("int"))
    most = (F.col("source_size") * cap).cast("double")
    by = Window.orderBy(F.col("__ratio"), F.col("source").asc_nulls_last())
    level = (F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum("__most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    return (
        totals.withColumn("weight", pick)
        .withColumn("__most", most)
        .withColumn("__ratio", F.col("__most") / F.col("weight"))
        .withColumn("__level", level)
        .withColumn("target", F.least(F.col("__most"), F.max("__level").over(Window.partitionBy()) * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def coin(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: int = 3, seed: int = 7) -> DataFrame:
    """``row`` (the columns of docs) and ``mix`` (size, source_size, target, copies); a row per input row.

    A null text has size 0, and so has an empty one; a null source is a source of its own, last in order. Documents of
    size 0 are copied like the others of their source; a source of size 0 has target 0 and no copies. Repeated rows are
    each copied, by one coin per id. No documents give no rows.
    """
    # the caller's columns travel in one struct, so that no name can clash
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    targets = source_targets(totals, weights, cap).select(F.col("source").alias("of"), "source_size", "target")
    on = F.col("source").eqNullSafe(F.col("of"))
    if totals.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), on)
    else:  # a source may hold a third of all rows: its rows go to SALTS tasks
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("own") == F.col("salt")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    copies = (F.floor("rate") + (coin(F.col("id"), seed) < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return joined.withColumn("rate", rate).select("row", F.struct("size", "source_size", "target", copies.alias("copies")).alias("mix"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of docs, a row per copy."""
    planned = plan_mix(docs, **options)
    return planned.where("mix.copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies").cast("int")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan_mix(docs).select("row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, CAST(source_size * 3 AS DOUBLE) AS most,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM totals
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, least(most, (SELECT max(level) FROM levels) * weight) AS target FROM levels
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS coin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
