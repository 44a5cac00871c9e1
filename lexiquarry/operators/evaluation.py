"""Roll-ups, comparisons and structure of evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, stored, tasks_for
from .ranking import names_match

#: Parts of groups up to this number are broadcast (about 60 bytes each).
RUNS = 500_000


def exact_mean(c: Column, digits: int = 4) -> Column:
    """The mean of values, each taken to six digits, rounded half up to ``digits`` from whole numbers: one result on every
    engine and in any order of the rows. High and low parts are summed as longs, so no sum of rows overflows; only the
    result of a group is a decimal."""
    scaled = c * 1_000_000
    v = (F.signum(scaled) * F.floor(F.abs(scaled) + 0.5)).cast("long")
    high, low = F.sum(F.shiftright(v, 20)), F.sum(v.bitwiseAND(F.lit((1 << 20) - 1).cast("long")))
    total = (high.cast("decimal(38,0)") * (1 << 20) + low.cast("decimal(38,0)")).cast("decimal(38,0)")
    n = F.count(c)
    step = 10 ** (6 - digits)
    twice, unit = (total * 2 + n * step).cast("decimal(38,0)"), (n * (2 * step)).cast("decimal(38,0)")
    whole = (twice - F.pmod(twice, unit)) / unit  # without a remainder, so exact
    return whole.cast("double") / float(10**digits)


def grouped_summary(rows: DataFrame, groups: dict[str, str], aggregates: Sequence[Column], overall: str = "overall") -> DataFrame:
    """One row for all, and one per value of each group column, labelled prefix + value; empty keys have no row. Each row
    meets all its groups at once, so the table is read and aggregated in one pass."""
    labels = [F.lit(overall), *[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(p), F.col(c).cast("string"))) for c, p in groups.items()]]
    return rows.withColumn("group_name", F.explode(F.array_compact(F.array(*labels)))).groupBy("group_name").agg(*aggregates)


def verdict(judge_type: Column, faithful: Column, complete: Column, grounded: Column, relevant: Column) -> Column:
    """struct(avg_score, verdict) of four scores from 1 to 5."""
    avg = F.round((faithful + complete + grounded + relevant) / 4.0, 4)
    good = (avg >= 4.0) & (faithful >= 4)
    rejected = F.when(F.least(faithful, grounded, relevant) <= 3, "fail").when(good, "pass").otherwise("review")
    other = F.when(good, "pass").when((avg < 3.0) | (faithful <= 2) | (relevant <= 2), "fail").otherwise("review")
    return F.struct(avg.alias("avg_score"), F.when(judge_type == "rejection", rejected).otherwise(other).alias("verdict"))


def doc_hits(targets: Column, sources: Column) -> Column:
    """struct(top1, topk, rate): targets found in the sources, by containment either way; null without targets."""
    sources = F.filter(sources, lambda s: s != "")
    hits = F.transform(targets, lambda t: F.exists(sources, lambda s: names_match(s, t)).cast("double"))
    total = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x)
    some = F.size(targets) > 0
    first = F.exists(targets, lambda t: F.coalesce(names_match(F.try_element_at(sources, F.lit(1)), t), F.lit(False)))
    return F.struct(F.when(some, first.cast("double")).alias("top1"), F.when(some, (total > 0).cast("double")).alias("topk"), F.when(some, F.round(total / F.size(targets), 4)).alias("rate"))


def degradation(before: DataFrame, after: DataFrame, key: str, metric: str) -> DataFrame:
    """Rows in both runs: how many got worse or better, and the mean change."""
    both = before.select(key, F.col(metric).alias("a")).join(after.select(key, F.col(metric).alias("b")), key)
    delta = F.round(F.col("b") - F.col("a"), 4)
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(delta < 0).alias("degraded"), F.count_if(delta > 0).alias("improved"), exact_mean(delta).alias("avg_delta"))


def group_deltas(before: DataFrame, after: DataFrame, key: str, group: str, metric: str) -> DataFrame:
    both = before.select(key, group, F.col(metric).alias("a")).join(after.select(key, F.col(metric).alias("b")), key)
    delta = F.round(F.col("b") - F.col("a"), 4)
    return both.groupBy(group).agg(F.count(F.lit(1)).alias("n"), exact_mean(delta).alias("avg_delta"), F.count_if(delta > 0).alias("improved"), F.count_if(delta < 0).alias("degraded"))


def version_deltas(rows: DataFrame, version: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Change against the first and the previous version."""
    w = Window.partitionBy(*by).orderBy(version)
    first = F.first(metric).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"delta_first": F.round(F.col(metric) - first, 4), "delta_prev": F.round(F.col(metric) - F.lag(metric).over(w), 4)})


def compare_pivot(rows: DataFrame, name: str, metric: str, value: str, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """A row per run; each column is the first metric of its alternative names that has a value."""
    first = lambda names: F.coalesce(*[F.max(F.when(F.col(metric) == n, F.col(value))) for n in names])
    return rows.groupBy(name).agg(*[first(ns).alias(c) for c, ns in wanted.items()])


def mode_grid(rows: DataFrame, modes: Sequence[str], versions: Sequence[str], metric: str) -> DataFrame:
    """Every mode with every version, 0 where there are no rows."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(m, v) for m in modes for v in versions], "mode string, version string")
    g = rows.groupBy("mode", "version").agg(F.count(F.lit(1)).alias("n"), exact_mean(F.col(metric) if isinstance(metric, str) else metric).alias("mean"))
    return F.broadcast(grid).join(g, ["mode", "version"], "left").select("mode", "version", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with ``name``, a row's place from 1 within its group, in the given order. Rows are sorted over all tasks and numbered
    where they lie, and a group's parts are put behind one another by their counts: a group may have any number of rows."""
    ensure_checkpoint_dir(rows.sparkSession)
    laid = rows.repartitionByRange(tasks_for(rows), *by, *order).sortWithinPartitions(*by, *order)
    laid = stored(laid.withColumn("__i", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__i", 33))
    runs = laid.groupBy(*by, "__part").agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shift = (F.coalesce(earlier, F.lit(0)) - F.col("__first") + 1).alias("__shift")
    runs = runs.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__run"), shift).checkpoint()
    few = runs.count() <= RUNS
    same = F.col("__part") == F.col("__run")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return laid.join(F.broadcast(runs) if few else runs, same).select(*rows.columns, (F.col("__i") + F.col("__shift")).alias(name))


def spearman(rows: DataFrame, x: str, y: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with ordinal ranks (ties in the given order), and the share of rows on which the signs agree."""
    r = numbered(numbered(rows, by, [x, order], "__x"), by, [y, order], "__y")
    r = r.withColumn("d", (F.col("__x") - F.col("__y")).cast("double"))
    n = F.count(F.lit(1))
    rho = F.when(n > 1, F.round(1 - 6 * F.sum(F.col("d") * F.col("d")) / (n.cast("double") * (n * n - 1)), 4)).otherwise(0.0)
    return r.groupBy(*by).agg(n.alias("n"), rho.alias("rho"), F.round(F.avg((F.signum(x) == F.signum(y)).cast("double")), 4).alias("sign_agreement"))


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    return rows.groupBy(expected, predicted).agg(F.count(F.lit(1)).alias("n"))


def stratified_pick(rows: DataFrame, stratum: str, order: Sequence[str], quota: dict[str, int], total: int) -> DataFrame:
    """The first rows of each stratum up to its quota, then others in order until there are ``total``. No two rows are equal in
    order. Strata are cut before the shuffle, and of the others no more are sorted than can be needed."""
    limit = F.lit(0)
    for k, n in quota.items():
        limit = F.when(F.col(stratum) == k, n).otherwise(limit)
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    inside = rows.withColumn("__n", rn).where(F.col("__n") <= max(quota.values(), default=0)).where(F.col("__n") <= limit).drop("__n")
    others = rows.orderBy(*order).limit(total + sum(quota.values())).join(inside.select(*order), list(order), "left_anti")
    both = inside.withColumn("backfill", F.lit(0)).unionByName(others.select(*rows.columns).withColumn("backfill", F.lit(1)))
    return both.orderBy("backfill", *order).limit(total)


def best_worst(rows: DataFrame, metric: str, key: str, n: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """The n best and the n worst rows of each group, with side and place. Each side has a window of its own, so that groups are cut
    to n rows before the shuffle."""

    def side(name: str, order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(order, key))
        return rows.withColumn("side", F.lit(name)).withColumn("place", place).where(F.col("place") <= n)

    return side("best", F.desc(metric)).unionByName(side("worst", F.asc(metric)))


def screening(rows: DataFrame, text: str, by: Sequence[str], verbose: int = 2000) -> DataFrame:
    """Counts of empty, malformed and verbose answers, and whether a run passes."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    empty, long, bad = t == "", F.length(t) > verbose, t.rlike(r"^[^\p{L}\p{N}]*$") & (t != "")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(empty).alias("n_empty"), F.count_if(long).alias("n_verbose"), F.count_if(bad).alias("n_malformed")).withColumn("passed", (F.col("n_empty") == 0) & (F.col("n_malformed") == 0) & (F.col("n_verbose") * 10 <= F.col("n")))


def gates(rows: DataFrame, by: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.bool_and(c).alias(k) for k, c in checks.items()]).withColumn("promoted", F.array_min(F.array(*[F.col(k) for k in checks])))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """edges: (child, parent); start: (node). All ancestors of the start nodes, themselves included; each round adds what is
    new until nothing is, so cycles end. Lineage is cut each round in the shared checkpoint folder."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    reached, fresh = start.select("node").distinct(), start.select("node").distinct()
    while True:
        fresh = fresh.join(edges, fresh["node"] == edges["child"]).select(F.col("parent").alias("node")).distinct().join(reached, "node", "left_anti").checkpoint()
        if fresh.isEmpty():
            break
        reached = reached.unionByName(fresh).checkpoint()
    return reached


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by propagating labels and jumping to the label of the label."""
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("component")).checkpoint()
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = new.select(F.col("node").alias("j"), F.col("component").alias("further"))
        new = new.join(jump, new["component"] == jump["j"], "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")).checkpoint()
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            break
    return labels


def lightest_buckets(groups: DataFrame, n: int) -> DataFrame:
    """groups: (component, size). Largest first, each to the first lightest of n buckets. The greedy order is sequential; there
    is a row per component of a question set, which is small by nature."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        load = [0] * n
        out = []
        for r in pdf.rename(columns={"size": "weight"}).sort_values(["weight", "component"], ascending=[False, True]).itertuples():
            k = load.index(min(load))
            load[k] += int(r.weight)
            out.append((r.component, int(r.weight), k))
        return pd.DataFrame(out, columns=["component", "size", "bucket"])

    return groups.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: pack(pdf), "component long, size long, bucket long")


def result_rows(answered: DataFrame, questions: DataFrame, refusal: str) -> DataFrame:
    """One evaluation row per answered question. answered: (question_id, answer_text, elapsed_sec, sources array<string>, route,
    model_key); questions: (question_id, answer_type, question, targets array<string>). Document hits, the length of the
    answer, and, for questions that expect it, whether the answer declines (matches ``refusal`` in lower case)."""
    rows = questions.join(answered, "question_id")
    expected = (F.lower(F.trim(F.coalesce("answer_type", F.lit("")))) == "rejection").cast("int")
    declined = F.lower(F.coalesce("answer_text", F.lit(""))).rlike(refusal).cast("int")
    return rows.select(
        "question_id", "answer_type", "question", "route", "model_key", "answer_text",
        F.length(F.coalesce("answer_text", F.lit(""))).alias("answer_chars"),
        F.round("elapsed_sec", 2).alias("elapsed_sec"),
        F.array_join("sources", " | ").alias("source_docs"),
        doc_hits(F.col("targets"), F.col("sources")).alias("hits"),
        expected.alias("rejection_expected"),
        declined.alias("rejection_detected"),
        F.when(expected == 1, declined).alias("rejection_success"),
    )


#: Measures whose means a coverage summary lists, and (measure, name of its count, answer type it is counted for).
COVERAGE_MEANS = ("elapsed_sec", "source_diversity", "dual_doc_coverage", "comparison_evidence_coverage", "table_plus_body_coverage", "table_hit", "body_hit", "pair_hit", "answer_hit")
COVERAGE_WEAK = (("dual_doc_coverage", "weak_comparison_count", "comparison"), ("table_plus_body_coverage", "weak_table_body_count", None), ("pair_hit", "weak_pair_count", None), ("body_hit", "weak_body_count", None))


def coverage_summary(rows: DataFrame, means: Sequence[str] = COVERAGE_MEANS, weak: Sequence[tuple[str, str, str | None]] = COVERAGE_WEAK) -> DataFrame:
    """Means of the measures over all rows, over each type group and over each answer type, and the counts of rows whose
    measure falls short of 1: of one answer type, where a missing measure counts as 0, or of all rows that have it."""
    short = lambda m, kind: (F.col(m) < 1) if kind is None else (F.col("answer_type") == kind) & (F.coalesce(m, F.lit(0.0)) < 1)
    agg = [F.count(F.lit(1)).alias("question_count"), *[exact_mean(F.col(m)).alias(m) for m in means], *[F.count_if(short(m, kind)).alias(name) for m, name, kind in weak]]
    return grouped_summary(rows, {"type_group": "", "answer_type": "answer_type:"}, agg)


def representative_cases(rows: DataFrame, rules: dict[str, Column], key: Sequence[str], order: Sequence[Column], n: int = 3) -> DataFrame:
    """The first n rows of each category by order, each key once; a row may be in several categories."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    each = rows.withColumn("category", F.explode(found))
    once = each.withColumn("__n", F.row_number().over(Window.partitionBy("category", *key).orderBy(*order))).where("__n = 1")
    return once.withColumn("__n", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def group_hits(candidates: DataFrame, kind: str, hits: str, review: str = "final_review_table") -> DataFrame:
    """candidates: (kind, hits map<group, count>). Hits of each keyword group, among rows of the review kind and all others."""
    each = candidates.select(F.when(F.col(kind) == review, "final_review").otherwise("discarded").alias("side"), F.explode(hits).alias("group_name", "n"))
    return each.groupBy("side", "group_name").agg(F.sum("n").alias("hits"))


def variant_deltas(metrics: DataFrame, variant: str, names: Sequence[str], bases: dict[str, str]) -> DataFrame:
    """A row per variant with its metrics and, for each base variant (name to suffix), the rounded difference from it; null
    where the base is absent."""
    of = [F.max(F.when(F.col(variant) == base, F.col(m))).alias(f"__{m}_{suffix}") for base, suffix in bases.items() for m in names]
    out = metrics.crossJoin(F.broadcast(metrics.agg(*of)))  # one row, whatever is there
    return out.select(*metrics.columns, *[F.round(F.col(m) - F.col(f"__{m}_{suffix}"), 4).alias(f"delta_{m}_{suffix}") for suffix in bases.values() for m in names])


def ids_by_group(rows: DataFrame, key: str, label: str, groups: Sequence[str]) -> DataFrame:
    """(label, ids): the ids of each of the groups, labels compared in lower case, blank ids left out."""
    name = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return rows.where((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & name.isin(*groups)).select(name.alias("group_label"), F.col(key))


def top_settings(rows: DataFrame, baseline: Column, order: Sequence[Column], n: int = 2) -> DataFrame:
    """The best n settings that are no baseline."""
    return rows.where(~baseline).orderBy(*order).limit(n)


def smoke_order(size: str = "chunk_size", mode: str = "mode", goal: int = 1200, preferred: str = "struct") -> list[Column]:
    """Falling document hits (first, any, rate), sizes nearest to the goal, the preferred mode, then size and mode themselves."""
    return [F.desc("top1"), F.desc("topk"), F.desc("rate"), F.abs(F.col(size) - goal).asc(), (F.col(mode) == preferred).desc(), F.asc(size), F.asc(mode)]
