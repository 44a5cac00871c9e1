"""Operators over a table of document metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dataset_summary(docs: DataFrame, agency: str) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count_distinct(agency).alias("n_agencies"))


def format_counts(docs: DataFrame, file_format: str) -> DataFrame:
    return docs.groupBy(file_format).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), file_format)


def distinct_values(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)


def query_documents(docs: DataFrame, order: list[Column], *, equal: dict[str, object] | None = None, keyword: str | None = None, fields: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Rows with equal values and the keyword, in either case, in one of the fields; ordered; the first ``limit``."""
    for c, v in (equal or {}).items():
        docs = docs.where(F.col(c) == v)
    if keyword:
        pattern = "%" + keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        docs = docs.where(reduce(lambda a, b: a | b, [F.col(f).ilike(pattern) for f in fields]))
    docs = docs.orderBy(*order)
    return docs if limit is None else docs.limit(limit)


def linked(docs: DataFrame, path: str) -> DataFrame:
    return docs.where(F.col(path).isNotNull() & (F.col(path) != ""))


def column_profile(df: DataFrame) -> DataFrame:
    """A row per column: type, values present, missing, their percentage, distinct values; one pass over the table."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(f"{c}__v") for c in kinds], *[F.count_distinct(c).alias(f"{c}__d") for c in kinds])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(f"{c}__v").alias("non_null"), (F.col("__n") - F.col(f"{c}__v")).alias("missing"), F.round((F.col("__n") - F.col(f"{c}__v")) * 100.0 / F.greatest(F.col("__n"), F.lit(1)), 2).alias("missing_pct"), F.col(f"{c}__d").alias("n_unique")) for c, t in kinds.items()]))
    return one.select(rows.alias("r")).select("r.*").orderBy(F.desc("missing"), "n_unique", "column_name")


def metadata_join(rows: DataFrame, metadata: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left join on a key; Spark broadcasts the metadata if its measured size allows."""
    return rows.join(metadata.select(key, *fields).dropDuplicates([key]), key, "left")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def augment(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """The base stays as it is; extra rows are added where their key is new."""
    return base.unionByName(extra.join(base.select(key).distinct(), key, "left_anti"))


def keep_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")
