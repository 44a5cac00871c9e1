"""Contexts for training questions: candidates anchored in expected documents, support probes, and rounds of retrieval that
ask again only where a context is weak.

Lists are (query_id, chunk_id, rank); chunks have chunk_id, name (their document), text and has_table; expected documents are
(query_id, name). All questions go through one plan; nothing loops over them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .retrieval import top

# Thresholds and confidences of the support verdict.
AMBIGUOUS_AT = 3
SUPPORTED_BASE, SUPPORTED_STEP, SUPPORTED_MOST = 0.65, 0.08, 0.98
AMBIGUOUS_CONFIDENCE, CLEAR_CONFIDENCE, UNCLEAR_CONFIDENCE = 0.55, 0.85, 0.72
#: Probes, in the order of the report; the words found by the third are left out of it.
PROBES = ("dense", "lexical", "normalized", "metadata", "table_body")


def fuse(lists: Sequence[tuple[DataFrame, float]], by: Sequence[str] = ("query_id",), constant: int = 60) -> DataFrame:
    """(by, chunk_id, fusion_score) of lists (by, chunk_id, rank): the sum of weight / (constant + rank)."""
    rows = None
    for df, w in lists:
        one = df.select(*by, "chunk_id", (F.lit(float(w)) / (F.lit(constant) + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*by, "chunk_id").agg(F.round(F.sum("part"), 9).alias("fusion_score"))


def within_documents(dense: DataFrame, lexical: DataFrame, names: DataFrame, expected: DataFrame, *, dense_weight: float = 0.7, lexical_weight: float = 0.3) -> DataFrame:
    """(query_id, name, chunk_id, fusion_score): both lists inside each expected document. dense: the nearest over all
    documents, of which those in an expected one are ranked anew; lexical: (query_id, name, chunk_id, rank) of a search
    inside the documents, so that a document far from the head of the overall list still has candidates."""
    inside = dense.join(names, "chunk_id").join(expected, ["query_id", "name"], "left_semi")
    near = Window.partitionBy("query_id", "name").orderBy("rank", "chunk_id")
    inside = inside.select("query_id", "name", "chunk_id", F.row_number().over(near).alias("rank"))
    return fuse([(inside, dense_weight), (lexical, lexical_weight)], ("query_id", "name"))


def anchors(found: DataFrame, rerank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best row of each expected document, and then their order. found: rows of ``within_documents``; rerank sets
    adjusted_score, as the profile does. A chunk stands once in a query's list. Anchors are scored by the profile like any
    other row, so that being expected brings a row into the list and no further."""
    start = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), "chunk_id")
    scored = rerank(found.withColumn("ord", F.row_number().over(start)))
    best = top(scored, 1, F.desc("adjusted_score"), F.asc("chunk_id"), by=("query_id", "name")).drop("rank")
    return best.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("adjusted_score"), "chunk_id")))


# ---- support of questions that should have no answer


def _evidence(probe: str, rows: DataFrame, text: str) -> DataFrame:
    return rows.select("query_id", F.lit(probe).alias("probe"), F.col(text).alias("text"))


def support_evidence(expected: DataFrame, lists: dict[str, DataFrame], chunks: DataFrame, papers: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, probe, text): what the probes look at, only from expected documents. lists: by probe, of which the first k
    count, before documents are looked at; papers: (name, metadata, tables, body), where empty tables and bodies are none."""
    inside = lambda df: df.join(expected.select("query_id", "name").distinct(), ["query_id", "name"], "left_semi")
    found = [_evidence(p, inside(df.where(F.col("rank") <= k).join(chunks.select("chunk_id", "name", "text"), "chunk_id")), "text") for p, df in lists.items()]
    of = expected.select("query_id", "name").distinct().join(papers, "name")
    found.append(_evidence("metadata", of, "metadata"))
    found += [_evidence("table_body", of.where(F.coalesce(c, F.lit("")) != ""), c) for c in ("tables", "body")]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def support_verdict(questions: DataFrame, evidence: DataFrame, lexicon: dict[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """One row per question (query_id, slots: array of slot names): hits of each probe, totals, verdict, confidence, status and
    the words found.

    lexicon: slot -> (other words for it, patterns that show support), a parameter of a few dozen entries. A text is direct
    support if a pattern of the question's slots is in it, whatever the case, and indirect if not, but the slot's name or
    another word for it is. Questions without evidence are not supported. Null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    low = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    asks = lambda slot: F.array_contains("slots", slot)
    direct, words = F.lit(False), []
    for slot, (aliases, patterns) in lexicon.items():
        for p in patterns:
            direct = direct | (asks(slot) & text.rlike(f"(?i){p}"))
        words += [F.when(asks(slot) & low.contains(w.lower()), F.lit(w)) for w in (slot, *aliases) if w]
    rows = evidence.join(questions.select("query_id", "slots"), "query_id")
    rows = rows.withColumn("direct", F.coalesce(direct, F.lit(False)).cast("int")).withColumn("found", F.array_compact(F.array(*words)) if words else F.array().cast("array<string>"))
    rows = rows.withColumn("indirect", ((F.col("direct") == 0) & (F.size("found") > 0)).cast("int"))
    hits = rows.groupBy("query_id").agg(
        *[F.sum(F.when(F.col("probe") == p, F.col("direct")).otherwise(0)).alias(p) for p in PROBES],
        F.sum("direct").alias("direct_total"),
        F.sum("indirect").alias("indirect_total"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("probe") != "normalized", F.slice("found", 1, 8)))))).alias("words"),
    )
    numbers = [*PROBES, "direct_total", "indirect_total"]
    out = questions.select("query_id").join(hits, "query_id", "left").na.fill(0, numbers).withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    d, i = F.col("direct_total"), F.col("indirect_total")
    judge = F.when(d >= 1, "supported").when(i >= AMBIGUOUS_AT, "ambiguous").otherwise("not_supported")
    sure = F.when(d >= 1, F.least(F.lit(SUPPORTED_MOST), SUPPORTED_BASE + d * SUPPORTED_STEP)).when(i >= AMBIGUOUS_AT, AMBIGUOUS_CONFIDENCE).otherwise(F.when(i == 0, CLEAR_CONFIDENCE).otherwise(UNCLEAR_CONFIDENCE))
    status = F.when(d >= 1, "type4_rejected_supported").when(i >= AMBIGUOUS_AT, "type4_ambiguous").otherwise("type4_accepted")
    return out.select("query_id", *[F.col(n).cast("long").alias(n) for n in numbers], ((i >= AMBIGUOUS_AT) & (d == 0)).alias("ambiguity"), judge.alias("judge"), F.round(sure, 4).alias("confidence"), status.alias("status"), "words")


# ---- candidate building in rounds


def weak_reasons(task: Column, targets: Column, names: Column, tables: Column, bodies: Column, n: Column, *, resolvable: Column | None = None, support: Column | None = None) -> Column:
    """Reasons why a question's contexts are weak, in a fixed order. names: documents of the contexts; tables, bodies, n: how
    many contexts have a table, have none, and there are; resolvable: whether a follow-up's parent is known."""
    covered, wanted = F.size(F.array_intersect(targets, names)), F.size(F.array_distinct(targets))
    wanted = F.least(F.lit(2), F.when(wanted == 0, 2).otherwise(wanted))
    lost = (covered < F.size(F.array_distinct(targets))) if resolvable is None else ~resolvable | (covered < F.size(F.array_distinct(targets)))
    reasons = [
        F.when((n < 2) & (task != "rejection"), "too_few_contexts"),
        F.when((task == "comparison") & (covered < wanted), "dual_doc_coverage_low"),
        F.when((task == "table_plus_body") & ((tables == 0) | (bodies == 0)), "table_body_coverage_low"),
        F.when((task == "follow_up") & lost, "followup_anchor_resolution_low"),
    ]
    if support is not None:
        reasons.append(F.when((task == "rejection") & support.isin("supported", "ambiguous"), "rejection_support_ambiguous"))
    return F.array_compact(F.array(*reasons))


def assess(questions: DataFrame, contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per question (query_id, task_type, targets, resolvable, support): chunk ids of its contexts in order, and the
    reasons against them. contexts: (query_id, chunk_id, rank), a bounded list for each question."""
    of = contexts.join(chunks.select("chunk_id", "name", "has_table"), "chunk_id")
    got = of.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda c: c["chunk_id"]).alias("contexts"),
        F.collect_set("name").alias("names"),
        F.sum((F.col("has_table") == 1).cast("long")).alias("tables"),
        F.sum((F.col("has_table") != 1).cast("long")).alias("bodies"),
    )
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    rows = questions.join(got, "query_id", "left").withColumn("contexts", none(F.col("contexts"), got.schema["contexts"].dataType)).withColumn("names", none(F.col("names"), got.schema["names"].dataType))
    rows = rows.na.fill(0, ["tables", "bodies"]).withColumn("targets", none(F.col("targets"), "array<string>"))
    reasons = weak_reasons(F.coalesce("task_type", F.lit("")), F.col("targets"), F.col("names"), F.col("tables"), F.col("bodies"), F.size("contexts"), resolvable=F.coalesce("resolvable", F.lit(False)), support=F.coalesce("support", F.lit("")))
    return rows.select("query_id", "contexts", reasons.alias("reasons"))


def build_contexts(questions: DataFrame, chunks: DataFrame, rounds: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(query_id, contexts, reasons, made_by, rounds): one row per question. Each round has a name and a function from questions
    to contexts (query_id, chunk_id, rank); it gets only the questions whose contexts are still weak. A round's contexts
    replace the earlier ones where they have fewer reasons against them. Rounds end when none is weak; the last round is
    asked again while it improves something, so a function that widens its search may be last. A round is written before
    the next, so what is weak is decided once."""
    ensure_checkpoint_dir(questions.sparkSession)
    questions = questions.checkpoint()
    done, todo, k = None, questions, 0
    while True:
        name, ask = rounds[min(k, len(rounds) - 1)]
        new = assess(todo, ask(todo), chunks).withColumn("made_by", F.lit(name))
        if done is None:
            done = new.withColumn("rounds", F.lit(1)).checkpoint()
            improved = True
        else:
            of = new.select("query_id", F.struct("contexts", "reasons", "made_by").alias("new"))
            met = done.join(of, "query_id", "left")
            better = F.coalesce(F.size("new.reasons") < F.size("reasons"), F.lit(False))
            old = F.struct("contexts", "reasons", "made_by")
            chosen = met.select("query_id", F.when(better, F.col("new")).otherwise(old).alias("own"), (F.col("rounds") + F.col("new").isNotNull().cast("int")).alias("rounds"), better.alias("better"))
            done = chosen.select("query_id", "own.*", "rounds", "better").checkpoint()
            improved = not done.where("better").isEmpty()
            done = done.drop("better")
        weak = done.where(F.size("reasons") > 0).select("query_id")
        k += 1
        if weak.isEmpty() or (k >= len(rounds) and not improved):
            return done
        todo = questions.join(weak, "query_id", "left_semi")


def table_and_body(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, rank): the best table and the best body of each question's list first, then the others in order,
    k in all. rows: (query_id, chunk_id, fusion_score, has_table)."""
    order = [F.desc("fusion_score"), F.asc("chunk_id")]
    first = F.row_number().over(Window.partitionBy("query_id", "has_table").orderBy(*order)) == 1
    place = F.when(first, F.when(F.col("has_table") == 1, 0).otherwise(1)).otherwise(2)
    return top(rows.withColumn("place", place), k, F.asc("place"), *order).select("query_id", "chunk_id", "rank")
