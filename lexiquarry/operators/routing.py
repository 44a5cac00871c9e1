"""Rules that classify questions, documents, lines and table artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed


def weighted_rules(text: Column, rules: dict[str, Sequence[tuple[str, float]]]) -> dict[str, Column]:
    """Per label, the sum of the weights of the patterns found, in either case."""
    return {k: sum((F.when(text.rlike(f"(?i){p}"), F.lit(w)).otherwise(0.0) for p, w in ps), F.lit(0.0)) for k, ps in rules.items()}


def answer_type(rows: DataFrame, rules: dict[str, Sequence[tuple[str, float]]], *, anchor: str, table_cue: str, interrogative: str, threshold: float = 0.0) -> DataFrame:
    """rows: question, has_history. The label with the highest score (the earlier one of equals) and its confidence.

    factual starts at 0.33; without a history follow_up keeps 0.35 of its score, with one it gains 0.18, and 0.42 where an
    anchor is found; table_plus_text without a table cue is halved; a direct question adds 0.08 to table_factual; of
    comparison and follow_up, both above 0.45, one gains by the history. Below the threshold a label falls back to comparison
    or factual. An empty question is factual.
    """
    q = F.coalesce(F.col("question"), F.lit(""))
    s = {"factual": F.lit(0.33)} | weighted_rules(q, rules)
    has = F.col("has_history")
    s["follow_up"] = F.when(has, s["follow_up"] + 0.18 + F.when(q.rlike(anchor), 0.42).otherwise(0.0)).otherwise(s["follow_up"] * 0.35)
    s["table_plus_text"] = F.when(q.rlike(f"(?i){table_cue}"), s["table_plus_text"]).otherwise(s["table_plus_text"] * 0.5)
    s["table_factual"] = s["table_factual"] + F.when(q.rlike(interrogative), 0.08).otherwise(0.0)
    tie = (s["comparison"] > 0.45) & (s["follow_up"] > 0.45)
    s["comparison"], s["follow_up"] = s["comparison"] + F.when(tie & ~has, 0.08).otherwise(0.0), s["follow_up"] + F.when(tie & has, 0.06).otherwise(0.0)
    rows = rows.withColumn("scores", F.array(*[F.struct(F.round(v, 9).alias("score"), F.lit(-i).alias("place"), F.lit(k).alias("label")) for i, (k, v) in enumerate(s.items())]))
    rows = rows.withColumn("ranked", F.sort_array("scores", asc=False))
    top, second = F.col("ranked")[0], F.col("ranked")[1]["score"]
    margin = F.greatest(F.lit(0.0), top["score"] - second)
    sure = F.least(F.lit(0.99), F.greatest(F.lit(0.5), 0.5 + 0.35 * margin + 0.2 * F.least(F.lit(1.0), top["score"])))
    sure = F.when((top["label"] == "factual") & (top["score"] <= 0.40), F.least(sure, F.lit(0.72))).otherwise(sure)
    comparison = F.filter("scores", lambda x: x["label"] == "comparison")[0]["score"]
    low = F.lit(threshold > 0) & (sure < threshold)
    label = F.when(q == "", "factual").when(low, F.when(comparison >= 0.42, "comparison").otherwise("factual")).otherwise(top["label"])
    confidence = F.when(q == "", 0.55).when(low, F.greatest(sure, F.lit(threshold))).otherwise(sure)
    return rows.withColumns({"answer_type": label, "confidence": F.round(confidence, 4)}).drop("scores", "ranked")


def parser_route(rows: DataFrame) -> DataFrame:
    """rows: table_markers, figure_markers, ocr_candidates, visual_candidates, text_length, table_blocks, enriched_tables,
    html_tables, extension. Adds score, reasons, route and priority."""
    c = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("table_markers", "figure_markers", "ocr_candidates", "visual_candidates", "text_length", "table_blocks", "enriched_tables", "html_tables")}
    ext = F.lower("extension")
    seen = (c["ocr_candidates"] > 0) | (c["visual_candidates"] > 0)
    named = lambda n, v: F.concat(F.lit(f"{n}="), v.cast("string"))
    rules = [
        (c["table_markers"] > 0, 2, named("table_markers", c["table_markers"])),
        (c["figure_markers"] > 0, 1, named("figure_markers", c["figure_markers"])),
        (seen, 2, named("ocr_candidates", F.greatest(c["ocr_candidates"], c["visual_candidates"]))),
        (c["text_length"] < 1500, 1, named("short_text", c["text_length"])),
        (ext.isin(".hwp", ".hwpx"), 1, F.concat(F.lit("format="), ext)),
        ((c["table_blocks"] > 0) & (c["enriched_tables"] == 0), 2, F.lit("table_blocks_without_enrichment")),
        (c["html_tables"] > 0, 1, F.lit("html_probe_table_detected")),
    ]
    score = sum((F.when(k, n).otherwise(0) for k, n, _ in rules), F.lit(0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(k, r) for k, _, r in rules])), ", ")
    table, ocr = (c["table_markers"] > 0) | (c["table_blocks"] > 0), seen & (score >= 3)
    route = F.when(ocr & table, "ocr_plus_table").when(ocr, "ocr_first").when(table, "table_first").otherwise("text_only")
    return rows.withColumns({"score": score, "high_priority": score >= 4, "reasons": F.when(reasons == "", "default_text_only").otherwise(reasons), "route": route})


def route_summary(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.count_if("high_priority").alias("n_high"))
    return g.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def pilot_select(rows: DataFrame, required: Sequence[str], name: str, priority: str, n: int, low: int = 10, high: int = 15) -> DataFrame:
    """Documents whose name holds a required word, and then those of the highest priority; between ``low`` and ``high`` in all."""
    first = F.coalesce(*[F.when(F.lower(name).contains(r.lower()), F.lit(0)) for r in required], F.lit(1))
    return rows.withColumn("tier", first).orderBy("tier", F.desc(priority), name).limit(max(low, min(high, n)))


# What makes a line look like a row of a table.
COLUMNS_LIKE = r"\S(?:\s{2,}|\t)\S"
NUMBERS_LIKE = r"(\d[\d,./-]*\s+){2,}\d[\d,./-]*"
LISTING_LIKE = r"^(\S+\s{2,}){2,}\S+$"


def line_flags(line: Column) -> dict[str, Column]:
    s = trimmed(line)
    long = F.length(s) >= 6
    parts = F.filter(F.split(s, r"[ \t]{2,}"), lambda x: x != "")
    short = F.filter(parts, lambda x: F.length(x) <= 12)
    return {"columns": long & s.rlike(COLUMNS_LIKE), "numbers": long & s.rlike(NUMBERS_LIKE), "listing": long & s.rlike(LISTING_LIKE), "short_columns": long & (F.size(parts) >= 3) & (F.size(short) >= 3)}


def table_structure(lines: DataFrame, by: str = "doc_id", line: str = "line") -> DataFrame:
    f = line_flags(F.col(line))
    g = lines.groupBy(by).agg(*[F.count_if(c).alias(k) for k, c in f.items()])
    return g.withColumn("structure_score", F.round(F.col("columns") * 1.0 + F.col("listing") * 1.5 + F.col("numbers") * 1.7 + F.col("short_columns") * 1.3, 6))


def islands(lines: DataFrame, flag: Column, gap: int = 2, by: str = "doc_id", place: str = "line_no") -> DataFrame:
    """Blocks of flagged lines that are at most ``gap`` apart."""
    w = Window.partitionBy(by).orderBy(place)
    hit = lines.where(flag)
    start = F.when(F.col(place) - F.lag(place).over(w) <= gap, 0).otherwise(1)
    return hit.withColumn("__s", start).withColumn("block", F.sum("__s").over(w)).groupBy(by, "block").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("rows"))


def looks_structured(line: Column) -> Column:
    """Whether a line looks like a row of a table, by any of the signs."""
    f = list(line_flags(line).values())
    return f[0] | f[1] | f[2] | f[3]


# What a block of lines scores for its rows, columns, regularity and numbers.
BLOCK_WEIGHTS = {"multi": 1.5, "modal": 1.0, "consistent": 4.0, "multi_ratio": 3.0, "numeric_ratio": 1.5, "structured": 0.3}


def table_blocks(lines: DataFrame, flag: Column, *, by: str = "doc_id", place: str = "line_no", line: str = "line", gap: int = 2, margin: int = 1, splitter: str = r"[ \t]{2,}", least: float = 10.0) -> DataFrame:
    """Blocks of a document's lines that look like a table: islands of flagged lines at most ``gap`` apart, widened by ``margin``
    lines to both sides within the document. lines: (by, place from 0, line).

    (by, block, start_line from 1, end_line, row_count, structured_row_count, modal_column_count, consistent_row_ratio,
    multi_column_row_ratio, numeric_row_ratio, block_score, text_recovery_percent, table_rows: array of rows with two columns or
    more). Blocks of fewer than three lines, with fewer than two such rows or with a score below ``least`` are left out. Of
    column counts that are equally frequent the one met first is the modal one. Neighbouring blocks may share a line."""
    found = islands(lines, flag, gap, by, place)
    last = lines.groupBy(by).agg(F.max(place).alias("__last"))
    ranges = found.join(last, by).select(by, "block", F.col("rows").alias("structured"), F.greatest(F.lit(0), F.col("first") - margin).alias("start"), F.least("__last", F.col("last") + margin).alias("end"))
    inside = ranges.select("*", F.explode(F.sequence("start", "end")).alias(place)).join(lines.select(by, place, F.coalesce(line, F.lit("")).alias("line")), [by, place])
    cells = F.filter(F.transform(F.split(trimmed(F.col("line")), splitter), trimmed), lambda c: c != "")
    compact = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    rows = inside.withColumn("cells", cells).withColumn("n", F.size("cells")).withColumn("multi", F.col("n") >= 2)
    key = [by, "block"]
    sizes = rows.where("multi").groupBy(*key, "n").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"))
    modal = sizes.groupBy(*key).agg(F.max(F.struct("times", (-F.col("first")).alias("f"), "n")).alias("m"))
    g = rows.groupBy(*key, "start", "end", "structured").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("multi").alias("multi"),
        F.count_if(F.col("line").rlike(r"\d")).alias("numeric"),
        F.sum(compact(F.col("line"))).alias("all"),
        F.sum(F.when(F.col("multi"), compact(F.array_join("cells", ""))).otherwise(0)).alias("kept"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("multi"), F.struct(place, "cells")))), lambda r: r["cells"]).alias("table_rows"),
    )
    g = g.where("row_count >= 3 AND multi >= 2").join(modal, key)
    ratio = {"consistent": F.col("m.times") / F.col("multi"), "multi_ratio": F.col("multi") / F.col("row_count"), "numeric_ratio": F.col("numeric") / F.col("row_count")}
    terms = {"multi": F.col("multi"), "modal": F.col("m.n"), **ratio, "structured": F.col("structured")}
    score = F.round(sum((terms[k] * w for k, w in BLOCK_WEIGHTS.items()), F.lit(0.0)), 2)
    recovered = F.when(F.col("all") > 0, F.round(F.col("kept") * 100.0 / F.col("all"), 2)).otherwise(0.0)
    return g.withColumn("block_score", score).where(F.col("block_score") >= least).select(
        by, "block", (F.col("start") + 1).alias("start_line"), (F.col("end") + 1).alias("end_line"), "row_count", F.col("structured").alias("structured_row_count"), F.col("m.n").alias("modal_column_count"),
        *[F.round(ratio[k], 2).alias(n) for k, n in (("consistent", "consistent_row_ratio"), ("multi_ratio", "multi_column_row_ratio"), ("numeric_ratio", "numeric_row_ratio"))],
        "block_score", recovered.alias("text_recovery_percent"), "table_rows",
    )


def document_priority(structure: Column, keywords: Column, complexity: Column, forms: Column) -> Column:
    return F.round(0.5 * structure + 0.4 * keywords + 0.1 * complexity - 0.2 * forms, 4)


def complexity(lines: Column, chars: Column) -> Column:
    return F.round(F.least(lines / 40.0, F.lit(8.0)) + F.least(chars / 5000.0, F.lit(4.0)), 2)


def forward_link(rows: DataFrame, is_header: Column, by: str = "doc_id", place: str = "line_no", reach: int = 5) -> DataFrame:
    """Each row with the nearest header within ``reach`` rows before it: the first header wins, and a header ends the reach of the
    one before."""
    w = Window.partitionBy(by).orderBy(place).rowsBetween(-reach, -1)
    parent = F.last(F.when(is_header, F.col(place)), ignorenulls=True).over(w)
    return rows.withColumn("parent", F.when(~is_header, parent))


def top_per_bucket(rows: DataFrame, bucket: str, order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("rn") <= n)
