"""Rule-based reranking of candidate lists.

Candidates have query_id, chunk_id, ord (place in the list), fusion_score, adjusted_score (or null) and what a rule reads:
file_name, section, parent, chunk_type, has_table, pairing_score, text. Stages keep ord and score apart, as some move rows
without changing their score. All windows are per query; no stage joins a list with itself row by row except the pair
guard, which joins tables with bodies of one document of one query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..lexicon import LONG_TOKEN
from ..functions.text import document_name, token_set, tokens, trimmed
from ..session import ensure_checkpoint_dir

# Chunk types and their bonuses.
PAIR_TYPES = ("paired_body_chunk", "table_body_pack", "row_body_pack")
STRUCTURED_TYPES = ("header_value_pair", "cell_row_block", "row_summary_chunk", "table_body_pack", "row_body_pack")
TABLE_TYPES = ("table_true_ocr_v2", "raw_table_ocr", "header_value_pair", "cell_row_block", "row_summary_chunk")
FACTUAL_PRIORITY = {"header_value_pair": 0.0100, "cell_row_block": 0.0090, "row_summary_chunk": 0.0070, "table_body_pack": 0.0060, "row_body_pack": 0.0050, "table_true_ocr_v2": 0.0020}
PLUS_TEXT_PRIORITY = {"paired_body_chunk": 0.0120, "table_body_pack": 0.0110, "row_body_pack": 0.0100, "header_value_pair": 0.0070, "row_summary_chunk": 0.0060, "cell_row_block": 0.0050, "table_true_ocr_v2": 0.0005}


def per_query() -> WindowSpec:
    return Window.partitionBy("query_id")



def effective() -> Column:
    """The adjusted score where it is neither null nor 0, else the fused one."""
    return F.coalesce(F.nullif(F.col("adjusted_score"), F.lit(0.0)), F.col("fusion_score"))


def base() -> Column:
    return F.coalesce("adjusted_score", "fusion_score")


def adjusted(rows: DataFrame, score: Column) -> DataFrame:
    """Sets the score and sorts the list by it; equal scores keep their order."""
    rows = rows.withColumn("adjusted_score", F.round(score, 9))
    return rows.withColumn("ord", F.row_number().over(per_query().orderBy(effective().desc(), "ord")))


def pick(c: Column, values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def diversity_rerank(rows: DataFrame, k: int, penalty: float = 0.75) -> DataFrame:
    """A file's second row loses ``penalty``, its third twice that; then the best k by score and name."""
    nth = F.row_number().over(Window.partitionBy("query_id", "file_name").orderBy(base().desc(), "file_name", "ord")) - 1
    rows = rows.withColumn("score", F.round(base() - nth * penalty, 9))
    rn = F.row_number().over(per_query().orderBy(F.desc("score"), "file_name", "ord"))
    return rows.withColumn("rank", rn).where(F.col("rank") <= k)


def question_profile(questions: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Flags by pattern, or by the answer type for comparison, follow_up and rejection."""
    q, kind = F.coalesce(F.col("question"), F.lit("")), F.col("answer_type")
    flags = {k: q.rlike(p) for k, p in patterns.items()}
    flags["comparison"] = (kind == "comparison") | flags.get("comparison", F.lit(False))
    flags["follow_up"] = (kind == "follow_up") | (F.size("depends_on") > 0)
    flags["rejection"] = kind == "rejection"
    return questions.withColumns(flags)


def route(answer_type: Column, has_dependency: Column, *, follow_up: str = "b02", rejection: str = "b02", direct: str = "b03a", other: str = "b02") -> Column:
    return F.when(has_dependency | (answer_type == "follow_up"), follow_up).when(answer_type == "rejection", rejection).when(answer_type.isin("factual", "comparison"), direct).otherwise(other)


def route_top_k(route_name: Column, answer_type: Column, default: int = 5) -> Column:
    return F.when(route_name == "b03a", F.when(answer_type == "comparison", 4).otherwise(3)).otherwise(default)


def field_bonus(rows: DataFrame, metadata_text: Column, purpose: str = r"(목적|배경|필요)") -> DataFrame:
    """Profile flags that meet chunk flags, a table for budget or schedule questions, and shared words; rows hold the
    question and its profile."""
    has = lambda name: F.col(name) & (F.col(f"has_{name}") == 1)
    bonus = sum((F.when(has(n), 0.0045).otherwise(0.0) for n in ("budget", "schedule", "contract")), F.lit(0.0))
    bonus += F.when(F.col("purpose") & metadata_text.rlike(purpose), 0.0035).otherwise(0.0)
    bonus += F.when((F.col("has_table") == 1) & (F.col("budget") | F.col("schedule")), 0.0015).otherwise(0.0)
    shared = F.size(F.array_intersect(F.array_distinct(tokens(F.col("question"))), F.array_distinct(tokens(metadata_text))))
    return adjusted(rows, F.col("fusion_score") + (bonus + F.least(F.lit(0.003), shared * F.lit(0.0005))))


def crag_filter(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows labelled CORRECT or AMBIGUOUS; without any, the first k of all."""
    ok = F.coalesce(F.col("crag_label").isin("CORRECT", "AMBIGUOUS"), F.lit(False))
    return filter_or_all(rows, ok, k)


def filter_or_all(rows: DataFrame, keep: Column, k: int | None = None) -> DataFrame:
    """Rows that pass, or all of a query's rows if none passes; then the first k."""
    rows = rows.withColumn("__ok", F.coalesce(keep, F.lit(False)))
    rows = rows.withColumn("__any", F.max("__ok").over(per_query())).where(F.col("__ok") | ~F.col("__any")).drop("__ok", "__any")
    rows = rows.withColumn("rank", F.row_number().over(per_query().orderBy("ord")))
    return rows if k is None else rows.where(F.col("rank") <= k)


def query_variants(question: Column, rules: Sequence[tuple[Sequence[str], str]], limit: int, comparison: Column | None = None, comparison_phrase: str = "", plain: Column | None = None) -> Column:
    """The question and its expansions: a phrase for each rule with a word in the question, without repeats, ``limit`` at most;
    the question alone where ``plain`` holds."""
    tidy = lambda c: trimmed(F.regexp_replace(c, r"\s+", " "))
    low = F.lower(question)
    has = lambda words: F.coalesce(*[F.when(low.contains(w.lower()), True) for w in words], F.lit(False))
    parts = [F.when(has(words), tidy(F.concat_ws(" ", question, F.lit(phrase)))) for words, phrase in rules]
    if comparison is not None:
        parts.append(F.when(comparison, tidy(F.concat_ws(" ", question, F.lit(comparison_phrase)))))
    more = F.slice(F.filter(F.array_distinct(F.array_compact(F.array(*parts))), lambda x: x != question), 1, limit)
    out = F.concat(F.array(question), more)
    return out if plain is None else F.when(plain, F.array(question)).otherwise(out)


def metadata_boost(rows: DataFrame, metadata_text: Column, rules: Sequence[tuple[Column, str, float]], scale: float = 1.0, most: float = 0.02) -> DataFrame:
    """Shared words and rules (condition on the question, pattern on the metadata, bonus), capped; a table adds 0.002."""
    shared = F.size(F.array_intersect(token_set(F.col("question")), token_set(metadata_text)))
    boost = F.least(F.lit(0.0045), shared * F.lit(0.00055))
    for condition, pattern, bonus in rules:
        boost += F.when(condition & metadata_text.rlike(f"(?i){pattern}"), bonus).otherwise(0.0)
    boost = F.round(F.least(F.lit(most), boost), 6) + F.when(F.col("has_table") == 1, 0.002).otherwise(0.0)
    return adjusted(rows.withColumn("boost", F.round(boost * scale, 9)), base() + F.col("boost"))


def boost_applies(scope: str, comparison: Column, rejection: Column, explicit_factual: Column, off_for_rejection: bool = True) -> Column:
    wanted = F.lit(True) if scope == "all" else comparison | explicit_factual
    return wanted & ~rejection if off_for_rejection else wanted


def names_match(a: Column, b: Column) -> Column:
    x, y = document_name(a), document_name(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def dual_doc_protect(rows: DataFrame, applies: Column | None = None) -> DataFrame:
    """Moves the first row of each of the first two target documents (array ``targets``) to the head if both are there.
    Targets are evaluation data: without them nothing moves."""
    applies = F.lit(True) if applies is None else applies
    first = lambda i: F.min(F.when(names_match(F.col("file_name"), F.try_element_at("targets", F.lit(i))), F.col("ord"))).over(per_query())
    rows = rows.withColumn("__a", first(1)).withColumn("__b", F.min(F.when(names_match(F.col("file_name"), F.try_element_at("targets", F.lit(2))) & (F.col("ord") != F.coalesce("__a", F.lit(-1))), F.col("ord"))).over(per_query()))
    both = applies & F.col("__a").isNotNull() & F.col("__b").isNotNull()
    place = F.when(both & (F.col("ord") == F.col("__a")), 0).when(both & (F.col("ord") == F.col("__b")), 1).otherwise(2)
    return rows.withColumn("ord", F.row_number().over(per_query().orderBy(place, "ord"))).drop("__a", "__b")


def comparison_helper(rows: DataFrame, axis: Column, axis_bonus: float = 0.004, doc_bonus: float = 0.003) -> DataFrame:
    """Evidence from several documents: an axis bonus for each row and a document bonus for each document's best. Round-robin
    picking between documents ends in a sort by score, so only the bonuses and the order of ties remain of it."""
    key = F.when(document_name(F.col("file_name")) == "", F.concat(F.lit("__unknown__:"), F.col("chunk_id").cast("string"))).otherwise(document_name(F.col("file_name")))
    rows = rows.withColumn("__axis", axis * axis_bonus).withColumn("__key", key)
    best = F.row_number().over(Window.partitionBy("query_id", "__key").orderBy((base() + F.col("__axis")).desc(), "ord")) == 1
    return adjusted(rows, base() + F.col("__axis") + F.when(best, doc_bonus).otherwise(0.0)).drop("__axis", "__key")


def table_body_pair(rows: DataFrame, table_bonus: float = 0.004, body_bonus: float = 0.003) -> DataFrame:
    """Where a document has a table and a body, the first of each gains."""
    named = F.col("file_name") != ""
    doc = Window.partitionBy("query_id", "file_name")
    both = named & (F.max(F.when(F.col("has_table") == 1, 1).otherwise(0)).over(doc) == 1) & (F.min(F.when(F.col("has_table") == 1, 1).otherwise(0)).over(doc) == 0)
    first = F.row_number().over(Window.partitionBy("query_id", "file_name", "has_table").orderBy("ord")) == 1
    return adjusted(rows, base() + F.when(both & first, F.when(F.col("has_table") == 1, table_bonus).otherwise(body_bonus)).otherwise(0.0))


def pair_guard(rows: DataFrame, pair_bonus: float = 0.006, parent_bonus: float = 0.003, penalty: float = 0.004) -> DataFrame:
    """Each table and its best body of the same document (section 1, parent 0.8, parent named in the body 0.4; first of the
    best) gain together, the parent bonus on top; bonuses add up; a table without a body loses."""
    t = rows.where("has_table = 1 AND file_name <> ''").select("query_id", "file_name", F.col("chunk_id").alias("t"), F.lower("section").alias("ts"), F.lower("parent").alias("tp"))
    b = rows.where("has_table = 0 AND file_name <> ''").select("query_id", "file_name", F.col("chunk_id").alias("b"), F.col("ord").alias("bo"), F.lower("section").alias("bs"), F.lower("parent").alias("bp"), F.lower("text").alias("bt"))
    named, same = (F.col("tp") != "") & F.col("bt").contains(F.col("tp")), (F.col("tp") != "") & (F.col("tp") == F.col("bp"))
    score = F.when((F.col("ts") != "") & (F.col("ts") == F.col("bs")), 1.0).otherwise(0.0) + F.when(same, 0.8).otherwise(0.0) + F.when(named, 0.4).otherwise(0.0)
    pairs = t.join(b, ["query_id", "file_name"], "left").withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn("parent_hit", F.coalesce(same | named, F.lit(False)))
    best = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "t").orderBy(F.desc("score"), F.asc_nulls_last("bo")))).where("rn = 1")
    gain = F.lit(pair_bonus) + F.when(F.col("parent_hit"), parent_bonus).otherwise(0.0)
    ends = F.when(F.col("score") > 0, F.array(F.struct(F.col("t").alias("chunk_id"), gain.alias("g")), F.struct(F.col("b").alias("chunk_id"), gain.alias("g")))).otherwise(F.array(F.struct(F.col("t").alias("chunk_id"), F.lit(-penalty).alias("g"))))
    gains = best.select("query_id", F.explode(ends).alias("e")).groupBy("query_id", "e.chunk_id").agg(F.sum("e.g").alias("gain"))
    return adjusted(rows.join(gains, ["query_id", "chunk_id"], "left"), base() + F.coalesce("gain", F.lit(0.0))).drop("gain")


def type_gated(rows: DataFrame, k: int, answer_type: Column, generic: Column | None = None, generic_penalty: float = 0.004) -> DataFrame:
    """Bonuses by chunk type for table questions. For table_plus_text, a pair row and a structured row follow the first k if
    those have none; queries without structured rows stay as they are."""
    generic = F.lit(False) if generic is None else generic
    kind = F.lower("chunk_type")
    pair, structured = kind.isin(*PAIR_TYPES), kind.isin(*STRUCTURED_TYPES)
    doc = Window.partitionBy("query_id", document_name(F.col("file_name")))
    # rows without a document name lend each other no support
    support = (document_name(F.coalesce("file_name", F.lit(""))) != "") & F.max(pair | (F.coalesce("pairing_score", F.lit(0.0)) >= 0.25)).over(doc)
    factual = pick(kind, FACTUAL_PRIORITY) + F.when(structured, 0.0015).otherwise(0.0) - F.when(kind == "", 0.0015).otherwise(0.0) - F.when(generic, generic_penalty).otherwise(0.0)
    plus = pick(kind, PLUS_TEXT_PRIORITY) + F.when(structured, 0.0012).otherwise(0.0) - F.when((kind == "table_true_ocr_v2") & ~support, 0.003).otherwise(0.0) + F.when(pair, 0.001).otherwise(0.0)
    is_plus = (answer_type == "table_plus_text") & F.max(structured).over(per_query())
    rows = rows.withColumn("__plus", is_plus).withColumn("__bonus", F.when(answer_type == "table_factual", factual).when(is_plus, plus).otherwise(0.0))
    rows = adjusted(rows, base() + F.col("__bonus")).drop("__bonus")

    def lifted(flag: Column, after: float) -> Column:
        head = F.max(flag & (F.col("ord") <= k)).over(per_query())
        first = F.min(F.when(flag & (F.col("ord") > k), F.col("ord"))).over(per_query())
        return F.when(F.col("__plus") & ~head & (F.col("ord") == first), F.lit(k + after)).otherwise(F.col("ord").cast("double"))

    rows = rows.withColumn("__place", F.least(lifted(pair, 0.3), lifted(structured, 0.6)))
    return rows.withColumn("ord", F.row_number().over(per_query().orderBy("__place", "ord"))).drop("__place", "__plus")


def alignment(question: Column, header: Column, value: Column, text: Column, entity: Column) -> Column:
    """Shares of the question's words in the header, the row and the entity, with hits from 0.6 on."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(LONG_TOKEN), F.lit(0)))
    share = lambda q, c: F.round(F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(c))) / F.size(q)).otherwise(0.0), 4)
    hit = lambda x: F.when(x >= 0.6, 1.0).otherwise(0.0)
    # transform over one element binds the question's words, and then the shares, once
    shares = F.transform(F.array(words(question)), lambda q: F.struct(share(q, header).alias("h"), share(q, F.concat_ws(" ", value, text)).alias("r"), share(q, entity).alias("e")))
    return F.transform(shares, lambda s: F.struct(s["h"].alias("header_match"), s["r"].alias("row_match"), s["e"].alias("entity_overlap"), hit(s["h"]).alias("exact_header"), hit(s["r"]).alias("exact_row")))[0]


def soft_gate_applies(answer_type: Column, comparison: Column, follow_up: Column, scope: str = "targeted", factual: str = "off") -> Column:
    is_factual = answer_type.isin("factual", "table_factual")
    if scope == "all":
        return F.when(is_factual, F.lit(factual != "off")).otherwise(True)
    return comparison | (answer_type == "comparison") | (answer_type == "table_plus_text") | follow_up | (is_factual & F.lit(factual != "off"))


def soft_gate(rows: DataFrame, answer_type: Column, metadata_text: Column, *, top_n: int = 6, keep: int = 5, weight: float = 0.045, low: float = 0.22, down: float = 0.36, duplicate_weight: float = 0.2, weak_weight: float = 0.2, down_penalty: float = 0.008, low_penalty: float = 0.015, strength: float = 1.0) -> DataFrame:
    """Quality of evidence without a model: word overlaps, agreement of sections, repeated texts and table-body pairs of the
    first top_n rows make a quality; it moves the score, and decides keep, down-rank or flag_low_confidence."""
    n = F.least(F.count(F.lit(1)).over(per_query()), F.lit(top_n))
    inside = F.col("ord") <= n
    q = token_set(F.lower("question"))
    share = lambda c: F.round(F.when(F.size(q) > 0, F.size(F.array_intersect(q, token_set(F.lower(c)))) / F.size(q)).otherwise(0.0), 4)
    section = F.lower(trimmed(F.coalesce("section", F.lit(""))))
    same = F.sum(inside.cast("int")).over(Window.partitionBy("query_id", section))
    consistency = F.when(section == "", 0.0).otherwise(F.round(same / n, 4))
    signature = F.concat_ws("|", F.lower("file_name"), F.lower("chunk_type"), F.substring(F.regexp_replace(F.lower(trimmed(F.col("text"))), r"\s+", " "), 1, 220))
    distinct = F.size(F.collect_set(F.when(inside, signature)).over(per_query()))
    duplicates = F.round((n - distinct) / n, 4)
    kind = F.lower("chunk_type")
    table = F.max(inside & ((F.col("has_table") == 1) | kind.isin(*TABLE_TYPES))).over(per_query())
    body = F.max(inside & ((F.col("has_table") == 0) | kind.isin(*PAIR_TYPES))).over(per_query())
    hit = F.max(inside & (kind.isin(*PAIR_TYPES) | (F.coalesce("pairing_score", F.lit(0.0)) >= 0.25))).over(per_query())
    pair = F.when(answer_type != "table_plus_text", 0.5).when(~table | ~body, 0.0).when(hit, 1.0).otherwise(0.4)
    rows = rows.withColumns({"q_overlap": share(F.col("text")), "m_overlap": share(metadata_text), "consistency": consistency, "duplicates": duplicates, "pair": pair})
    weak = F.when(answer_type == "table_plus_text", (F.col("pair") < 0.5).cast("double")).when(answer_type == "follow_up", ((F.col("q_overlap") < 0.10) & (F.col("m_overlap") < 0.10)).cast("double")).when(answer_type.isin("comparison", "factual", "table_factual"), (F.col("q_overlap") < 0.06).cast("double")).otherwise(0.0)
    rows = rows.withColumn("weak", weak)
    value = (0.36 * F.col("q_overlap") + 0.22 * F.col("m_overlap") + 0.17 * F.col("consistency") + 0.15 * F.col("pair")) - (F.col("duplicates") * duplicate_weight + F.col("weak") * weak_weight)
    rows = rows.withColumn("quality", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value * strength)), 4))
    rows = rows.withColumn("decision", F.when(F.col("quality") < low, "flag_low_confidence").when(F.col("quality") < down, "down-rank").otherwise("keep"))
    delta = F.col("quality") * weight * strength - F.when(F.col("decision") == "down-rank", down_penalty).when(F.col("decision") == "flag_low_confidence", low_penalty).otherwise(0.0)
    return adjusted(rows, base() + delta).where(F.col("ord") <= keep)


def precedence_union(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; of rows with one (query_id, chunk_id), that of the first part and place."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    rn = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("__part", "ord"))
    out = out.withColumn("__rn", rn).where("__rn = 1").drop("__rn")
    return out.withColumn("ord", F.row_number().over(per_query().orderBy("__part", "ord", "chunk_id"))).drop("__part")


def diverse_select(rows: DataFrame, k: int) -> DataFrame:
    """The first row of each file, in order, and then the others, k in all."""
    again = (F.row_number().over(Window.partitionBy("query_id", "file_name").orderBy("ord")) > 1).cast("int")
    rows = rows.withColumn("rank", F.row_number().over(per_query().orderBy(again, "ord")))
    return rows.where(F.col("rank") <= k)


def coverage(rows: DataFrame) -> DataFrame:
    """Per query: coverage of targets (array ``targets``), diversity of sources and what kinds of evidence are there."""
    kind, name = F.lower("chunk_type"), document_name(F.col("file_name"))
    is_table, is_body = (F.col("has_table") == 1) | kind.isin(*STRUCTURED_TYPES) | (kind == "table_true_ocr_v2"), (F.col("has_table") == 0) | kind.isin(*PAIR_TYPES)
    g = rows.groupBy("query_id").agg(
        F.first("targets").alias("targets"),
        F.collect_set(F.nullif(name, F.lit(""))).alias("names"),
        F.count(F.lit(1)).alias("n"),
        F.max(is_table).alias("t"),
        F.max(is_body).alias("b"),
        F.max(kind.isin(*PAIR_TYPES)).alias("p"),
        F.max(kind.isin(*STRUCTURED_TYPES)).alias("s"),
        F.max(F.coalesce("pairing_score", F.lit(0.0))).alias("pairing"),
    )
    wanted = F.filter(F.transform(F.coalesce("targets", F.array().cast("array<string>")), document_name), lambda x: x != "")
    g = g.withColumn("hits", F.transform(wanted, lambda t: F.exists("names", lambda x: x.contains(t) | t.contains(x)).cast("int")))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return g.select(
        "query_id",
        F.when(F.size("hits") >= 2, one((F.try_element_at("hits", F.lit(1)) == 1) & (F.try_element_at("hits", F.lit(2)) == 1))).alias("dual_doc_coverage"),
        F.when(F.size("hits") > 0, F.round(F.aggregate("hits", F.lit(0), lambda a, x: a + x) / F.size("hits"), 4)).alias("evidence_coverage"),
        F.round(F.size("names") / F.greatest(F.col("n"), F.lit(1)), 4).alias("source_diversity"),
        one(F.col("t")).alias("table_hit"),
        one(F.col("b")).alias("body_hit"),
        one(F.col("p") | (F.col("pairing") >= 0.20)).alias("pair_hit"),
        one(F.col("t") & F.col("b")).alias("table_plus_body"),
        one(F.col("s")).alias("structured_hit"),
        F.round("pairing", 4).alias("pairing_score_max"),
    )


def holding(short: DataFrame, long: DataFrame, n: int = 8) -> DataFrame:
    """(short, long): pairs of distinct texts, columns ``s`` and ``l``, where the long one holds the short one of n characters or
    more. The grams of the long texts are the index; a short text asks for its rarest gram alone, and what it finds is
    verified. A gram that no long text has settles the matter."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))
    index = long.where(F.length("l") >= n).select("l", F.explode(grams(F.col("l"))).alias("g"))
    often = index.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    asked = short.where(F.length("s") >= n).select("s", F.explode(grams(F.col("s"))).alias("g")).join(often.hint("merge"), "g", "left")
    rare = asked.groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).where("m.n > 0").select("s", "m.g")
    return rare.join(index.hint("merge"), "g").where(F.col("l").contains(F.col("s"))).select("s", "l")


def similar(a: DataFrame, b: DataFrame, least: float, ratio) -> DataFrame:
    """(s, l, ratio): pairs of distinct texts of a (column s) and b (column l) whose ``ratio``, twice the matched characters over all,
    reaches least, 0.7 or more. A pair at that ratio shares 1.5 times least less 1, of all its characters, and one less,
    of two-character grams (those of a common subsequence that no gap parts), so pairs are counted on grams, each with its
    number within the text, and only those that share enough are compared."""
    if least < 0.7:
        raise ValueError("least must be 0.7 or more")

    def numbered(df: DataFrame, c: str) -> DataFrame:
        # a text of one to four characters also meets others on its single characters, as it may share no gram
        at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
        grams = F.concat(at(2), F.when(F.length(c) <= 4, at(1)).otherwise(F.array().cast("array<string>")))
        each = df.select(c, F.explode(grams).alias("g")).groupBy(c, "g").agg(F.count(F.lit(1)).alias("n"))
        return each.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct("g", i.alias("i")))).alias("g"))

    total, low = F.length("s") + F.length("l"), F.least(F.length("s"), F.length("l"))
    shared = numbered(a, "s").join(numbered(b, "l"), "g").groupBy("s", "l").agg(F.count(F.lit(1)).alias("n"))
    enough = (F.col("n") >= total * (1.5 * least - 1) - 1) & (2 * low >= total * least)
    return shared.where(enough).withColumn("ratio", F.round(ratio(F.col("s"), F.col("l")), 6)).where(F.col("ratio") >= least).select("s", "l", "ratio")


def select_targets(files: DataFrame, file_name: str, targets: DataFrame, target: str, ratio, *, shortest: int = 8, least: float = 0.78) -> DataFrame:
    """files, with matched_by, whose name is that of a target: one holds the other, where both have ``shortest`` characters
    without spaces and case or more ('contains'), or they are alike ('similar'). ratio: two columns to their similarity, None
    to leave it out. Blank names match nothing. No name is compared with all others."""
    names = lambda df, c, to: df.select(document_name(F.col(c)).alias(to)).where(F.col(to) != "").distinct()
    f, t = names(files, file_name, "l"), names(targets, target, "s")
    inside = holding(t, f, shortest).select(F.col("l").alias("key"))
    around = holding(f.select(F.col("l").alias("s")), t.select(F.col("s").alias("l")), shortest).select(F.col("s").alias("key"))
    found = inside.unionByName(around).distinct().withColumn("matched_by", F.lit("contains"))
    if ratio is not None:
        rest = f.join(found.select(F.col("key").alias("l")), "l", "left_anti")
        found = found.unionByName(similar(t, rest, least, ratio).select(F.col("l").alias("key")).distinct().withColumn("matched_by", F.lit("similar")))
    return files.withColumn("key", document_name(F.col(file_name))).join(found, "key").drop("key")


def resolve_names(names: DataFrame, pool: DataFrame) -> DataFrame:
    """names: (name); pool: (file_name, place). Each name's file: an equal one, else one equal without case and spaces, else
    one that contains it; the first in the pool. The first two steps are equi-joins; names left over are asked for by grams of
    their own length, up to eight characters, so no name is compared with the whole pool. Names are merged in shuffles: files hold them so tightly that Spark
    would take a pool for small and send it through the driver."""
    pool = pool.withColumn("key", document_name(F.col("file_name")))
    first = lambda key: pool.groupBy(key).agg(F.min(F.struct("place", "file_name")).alias("f"))
    exact = names.join(first("file_name").select(F.col("file_name").alias("name"), F.col("f.file_name").alias("exact")).hint("merge"), "name", "left")
    keyed = exact.withColumn("key", document_name(F.col("name"))).join(first("key").select("key", F.col("f.file_name").alias("equal")).hint("merge"), "key", "left")
    rest = keyed.where("exact IS NULL AND equal IS NULL AND key <> ''").select("name", "key").distinct()
    ensure_checkpoint_dir(names.sparkSession)
    asked = rest.select(F.col("key").alias("s")).distinct().checkpoint()
    index = first("key").select(F.col("key").alias("l"), "f").checkpoint()
    found = None
    for r in asked.select(F.least(F.length("s"), F.lit(8)).alias("n")).distinct().collect():  # at most eight lengths
        met = holding(asked.where(F.length("s") == r.n) if r.n < 8 else asked.where(F.length("s") >= 8), index.select("l"), r.n)
        found = met if found is None else found.unionByName(met)
    met = rest.limit(0).select(F.col("key").alias("s"), F.col("key").alias("l")) if found is None else found
    near = rest.join(met.withColumnRenamed("s", "key").hint("merge"), "key").join(index.hint("merge"), "l").groupBy("name").agg(F.min("f").getField("file_name").alias("near"))
    return keyed.join(near.hint("merge"), "name", "left").select("name", F.coalesce("exact", "equal", "near").alias("file_name"), F.when(F.col("exact").isNotNull(), 1).when(F.col("equal").isNotNull(), 2).when(F.col("near").isNotNull(), 3).alias("tier"))


def relevance(score: Column, slope: float = 220.0) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.exp(-score * slope)) * 100))).cast("long")


def run_scores(rows: DataFrame, top_k: int) -> DataFrame:
    """Relevance from the mean of the three best scores, and confidence from relevance, labels and list length."""
    third = F.row_number().over(per_query().orderBy(base().desc(), "ord")) <= 3
    g = rows.withColumn("__third", third).groupBy("query_id").agg(F.avg(F.when(F.col("__third"), base())).alias("top"), F.avg(F.col("crag_label").isin("CORRECT", "SOFT", "AMBIGUOUS").cast("double")).alias("ratio"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("relevance", relevance(F.round("top", 12)))
    value = 0.58 * (F.col("relevance") / 100.0) + 0.26 * F.col("ratio") + 0.16 * F.least(F.lit(1.0), F.col("n") / F.lit(float(top_k)))
    return g.select("query_id", "relevance", F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value * 100)), 9)).cast("long").alias("confidence"))


def source_relevance(rows: DataFrame, most: int = 4) -> DataFrame:
    """The first files of each list with the relevance of their best row."""
    g = rows.where("file_name <> ''").groupBy("query_id", "file_name").agg(F.min("ord").alias("first"), F.max(base()).alias("best"))
    return g.withColumn("rn", F.row_number().over(per_query().orderBy("first"))).where(F.col("rn") <= most).select("query_id", "file_name", relevance(F.round("best", 12)).alias("relevance"))
