"""A corpus pipeline of five stages: quality, near-duplicates, benchmark passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm import mil, minhash, mixing, tokens, wumanber
from lexiquarry.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier scores below 0.3 go. Null and empty texts are scored like others; without
    labels all are kept (score 0.5); repeated rows share their score; no documents give none."""
    model = mil.train(docs, table(spark, sf_dir, "labels"))
    return mil.score(docs, model).where("score >= 0.3").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more. Null, empty and wordless texts
    are in no group and stay, as do rows without an id. Rows with one id are one document; those with one id and one
    text stay once."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go. Texts without words stay, and so do
    all documents if the benchmark is empty."""
    return wumanber.scan(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped so that each source comes near its target. A null source is one of its own; a
    source without words has no copies; a null id shares one coin."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the encoded files, a row per copy. A null or empty text is
    its end id; null ids come first."""
    return tokens.token_output(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training and tokenizing have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None
