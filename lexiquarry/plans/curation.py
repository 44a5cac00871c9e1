"""Curation queries over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as C
from ..operators import evaluation as E
from ..registry import query, table

docs = lambda s, d: table(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
SLOTS = {"budget": "tion", "schedule": "ung", "contract": "que", "scope": "the", "purpose": "[0-9]"}
DETECT = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in SLOTS.items()) + "], lambda x: x IS NOT NULL)"


@query("slot_detect", f"SELECT doc_id, array_to_string({DETECT}, '|') AS slots FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.array_join(C.slots(F.col("text"), SLOTS), "|").alias("slots"))


@query(
    "tag_pairs",
    "WITH t AS (SELECT DISTINCT page_id AS k, unnest([regexp_extract(url, '//([^/]+)', 1), regexp_extract(url, '//[^/]+/(\\w+)', 1)]) AS tag FROM pages) SELECT a.k AS a, b.k AS b, count(*) AS overlap FROM t a JOIN t b USING (tag) WHERE a.k < b.k GROUP BY ALL ORDER BY overlap DESC, a, b LIMIT 800",
)
def _(s, d):
    rows = table(s, d, "pages").select("page_id", F.array(F.regexp_extract("url", "//([^/]+)", 1), F.regexp_extract("url", r"//[^/]+/(\w+)", 1)).alias("tags"))
    return C.tag_pairs(rows, "page_id", "tags", 800)


FORMS = {"budget": "What does {key} cost?", "scope": "What is {key} about?", "contract": "How is {key} agreed?"}


@query(
    "template_candidates",
    f"WITH s AS (SELECT doc_id, {DETECT} AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS slot, generate_subscripts(l, 1) AS place FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS rn FROM e WHERE slot IN ('budget', 'scope', 'contract')) SELECT doc_id, slot, replace(CASE slot WHEN 'budget' THEN 'What does {{key}} cost?' WHEN 'scope' THEN 'What is {{key}} about?' ELSE 'How is {{key}} agreed?' END, '{{key}}', CAST(doc_id AS VARCHAR)) AS question FROM q WHERE rn <= 2",
)
def _(s, d):
    rows = docs(s, d).select("doc_id", C.slots(F.col("text"), SLOTS).alias("slots"))
    return C.templates(rows, "doc_id", "slots", FORMS, 2).select("doc_id", "slot", "question")


@query("trim_to_targets", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s1|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 20 WHEN 'fr' THEN 10 ELSE 0 END")
def _(s, d):
    return C.trim_to_targets(docs(s, d), "lang", "doc_id", {"en": 40, "de": 20, "fr": 10}, "s1").select("doc_id", "lang")


@query("vet_malformed", "SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(text) < 12 THEN 'too_short' END, CASE WHEN length(text) > 180 THEN 'too_long' END, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'digits' END], lambda x: x IS NOT NULL), '|') AS reasons FROM conversations WHERE role = 'user'")
def _(s, d):
    rows = table(s, d, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.array_join(C.malformed(F.col("text"), patterns={"digits": "[0-9]{3}"}), "|").alias("reasons"))


WINDOWS = """SELECT {k} AS k, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 7, 1) + 1), lambda i: array_to_string(w[i:i+7], ' ')))) AS x FROM (SELECT {k}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '') AS w FROM {t}) WHERE len(w) >= 8"""


@query("benchmark_overlap", f"SELECT DISTINCT a.k AS doc_id, b.k AS item_id FROM ({WINDOWS.format(k='doc_id', t='documents')}) a JOIN ({WINDOWS.format(k='item_id', t='benchmark')}) b USING (x)")
def _(s, d):
    return C.overlap_with(docs(s, d), "doc_id", "text", table(s, d, "benchmark").withColumnRenamed("text", "item_text"), "item_id", "item_text")


@query("dup_exact", "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(lower(text))) AS first, doc_id <> min(doc_id) OVER (PARTITION BY md5(lower(text))) AS duplicate FROM documents")
def _(s, d):
    return C.first_of_key(docs(s, d), F.md5(F.lower("text").cast("binary")), "doc_id").select("doc_id", "first", "duplicate")


def asked_turns(s, d):
    c = table(s, d, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", "text", F.struct("conv_id", "turn").alias("qid"), F.array_join(C.slots(F.col("text"), SLOTS), "|").alias("slots"))


@query("dup_ratio")
def _(s, d):
    """User turns against the first turn with the same slots in the same conversation."""
    found = C.signature_duplicates(asked_turns(s, d), F.concat_ws("::", F.col("conv_id").cast("string"), "slots"), "qid", "text")
    return found.select("qid.conv_id", "qid.turn", F.col("first.turn").alias("first_turn"), "ratio", "duplicate")


@query("prior_union")
def _(s, d):
    """First turns are prior rows; later ones come after them unless they repeat a first turn of their conversation."""
    rows = asked_turns(s, d).select("conv_id", "turn", "text", "qid")
    merged = C.without_prior(rows.where("turn > 0"), rows.where("turn = 0"), ["conv_id"], "qid", "text")
    return merged.select("conv_id", "turn", "origin")


GRAMS5 = "list_transform(range(1, greatest(length(p) - {n} + 1, 1) + 1), lambda i: substr(p, CAST(i AS BIGINT), {n}))"


def tfidf_sql(by: str, key: str, text: str, source: str, least: float) -> str:
    """Rows of ``source`` with an earlier row of their group (one column) at a cosine of ``least`` or more."""
    return f"""WITH t AS (SELECT {by} AS g, {key} AS k, ' ' || unnest(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> '')) || ' ' AS p FROM {source}),
g AS (SELECT g, k, unnest(list_concat({GRAMS5.format(n=3)}, list_concat(CASE WHEN length(p) >= 4 THEN {GRAMS5.format(n=4)} ELSE [] END, CASE WHEN length(p) >= 5 THEN {GRAMS5.format(n=5)} ELSE [] END))) AS x FROM t),
f AS (SELECT g, k, x, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT {by} AS g, count(*) AS n FROM {source} GROUP BY 1), d AS (SELECT g, x, count(*) AS df FROM f GROUP BY ALL),
w AS (SELECT g, k, x, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM f JOIN d USING (g, x) JOIN n USING (g)), m AS (SELECT g, k, sqrt(sum(w * w)) AS m FROM w GROUP BY ALL),
j AS (SELECT a.g, a.k AS a, b.k AS b, round(sum(a.w * b.w) / (any_value(x.m) * any_value(y.m)), 6) AS c FROM w a JOIN w b ON a.g = b.g AND a.x = b.x AND a.k < b.k JOIN m x ON x.g = a.g AND x.k = a.k JOIN m y ON y.g = b.g AND y.k = b.k GROUP BY ALL)
SELECT g AS {by.split()[-1] if " AS " in by else by}, b AS {key}, min(a) AS matched, min_by(c, a) AS similarity FROM j WHERE c >= {least} GROUP BY ALL"""


@query("dup_tfidf", tfidf_sql("conv_id", "turn", "text", "conversations", 0.3))
def _(s, d):
    return C.tfidf_duplicates(table(s, d, "conversations"), ["conv_id"], "turn", "text", 0.3)


@query("dup_tfidf_sources", "SELECT split_part(grp, '/', 1) AS lang, split_part(grp, '/', 2) AS source, doc_id, matched, similarity FROM (" + tfidf_sql("grp", "doc_id", "text", "(SELECT lang || '/' || source AS grp, doc_id, text FROM documents)", 0.92) + ")")
def _(s, d):
    """Documents that an earlier one of their language and source resembles, at the operator's own threshold."""
    return C.tfidf_duplicates(docs(s, d), ["lang", "source"], "doc_id", "text")


@query(
    "eval_leakage",
    r"""WITH o AS (SELECT item_id, lower(regexp_replace(text, '\s+', '', 'g')) AS t, embedding AS e, label FROM benchmark JOIN embeddings ON vec_id = item_id), r AS (SELECT vec_id, lower(regexp_replace(text, '\s+', '', 'g')) AS t, embedding AS e, label FROM embeddings JOIN documents ON doc_id = vec_id),
p AS (SELECT vec_id, item_id, r.t = o.t AS same, r.label = o.label AS shared, round(list_cosine_similarity(CAST(r.e AS DOUBLE[]), CAST(o.e AS DOUBLE[])), 6) AS c FROM r, o), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, item_id) AS rn, bool_or(same) OVER (PARTITION BY vec_id) AS any_same FROM p)
SELECT vec_id, item_id, CASE WHEN any_same THEN 'exact_or_normalized_match' WHEN c >= 0.88 OR c >= 0.84 AND shared THEN 'semantic_match:' || printf('%.4f', c) ELSE '' END AS reason FROM b WHERE rn = 1""",
)
def _(s, d):
    from ..operators.retrieval import best_official

    key = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    v = table(s, d, "embeddings").select("vec_id", "embedding", "label")
    official = table(s, d, "benchmark").join(v, F.col("vec_id") == F.col("item_id")).select("item_id", key(F.col("text")).alias("t"), "embedding", F.col("label").alias("item_label"))
    rows = v.join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), key(F.col("text")).alias("t")), "vec_id")
    best = best_official(rows.select("vec_id", "embedding"), official.select("item_id", "embedding"))
    texts = official.select("t").distinct().withColumn("same", F.lit(True))
    j = rows.join(best, "vec_id").join(official.select("item_id", "item_label"), "item_id").join(texts, "t", "left")
    reason = C.leakage(F.coalesce("same", F.lit(False)), F.col("similarity"), F.coalesce(F.col("label") == F.col("item_label"), F.lit(False)))
    return j.select("vec_id", "item_id", reason.alias("reason"))


PAGE_TAGS = "[regexp_extract(url, '//([^/]+)', 1), regexp_extract(url, '//[^/]+/(\\w+)', 1)]"


@query(
    "comparison_pairs",
    f"WITH r AS (SELECT page_id AS k, list_distinct({PAGE_TAGS}) AS t, regexp_matches(lower(url), 'a|news') AS themed FROM pages), e AS (SELECT k, unnest(t) AS x FROM r), p AS (SELECT a.k AS a, b.k AS b, list(DISTINCT a.x ORDER BY a.x) AS s FROM e a JOIN e b USING (x) WHERE a.k < b.k GROUP BY ALL), z AS (SELECT a, b, CAST(len(s) + CAST(x.themed OR y.themed AS INT) AS INT) AS points, array_to_string(s[1:4], '|') AS first_tags FROM p JOIN r x ON x.k = a JOIN r y ON y.k = b UNION ALL SELECT x.k, y.k, 1, '' FROM r x JOIN r y ON x.k < y.k AND (x.themed OR y.themed) ANTI JOIN p ON p.a = x.k AND p.b = y.k) SELECT * FROM z ORDER BY points DESC, first_tags DESC, a, b LIMIT 800",
)
def _(s, d):
    rows = table(s, d, "pages").select("page_id", "url", F.array(F.regexp_extract("url", "//([^/]+)", 1), F.regexp_extract("url", r"//[^/]+/(\w+)", 1)).alias("tags"))
    return C.themed_pairs(rows, "page_id", "tags", "url", ["a", "news"], 800)


@query("review_merge", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 AND doc_id % 2 = 0 THEN 'accepted' WHEN n_chars > 1000 THEN 'accepted' ELSE 'pending' END AS final FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    rows = docs(s, d).withColumn("status", F.when(F.col("n_chars") > 1000, "ok").otherwise("open"))
    decided = table(s, d, "labels").withColumn("decision", F.when(F.col("toxic") == 1, "reject").when((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0), "approve"))
    return C.review_merge(rows, decided, "doc_id").select("doc_id", "final")


@query("revive_followups", "SELECT conv_id, turn FROM conversations c WHERE turn % 2 = 1 AND EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)")
def _(s, d):
    turns = table(s, d, "conversations").select("conv_id", "turn")
    return C.revive_followups(turns, turns.where("turn % 2 = 0"), "conv_id", "turn")


REASONS = "array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(text, '|') THEN 'listing' END, CASE WHEN upper(text) = text THEN 'capitals' END], lambda x: x IS NOT NULL), '|')"


def filtered(s, d):
    t = F.col("text")
    return C.post_filter(docs(s, d), {"short": F.col("n_chars") < 200, "listing": t.contains("|"), "capitals": F.upper(t) == t})


@query("post_filter", f"SELECT doc_id, {REASONS} AS reasons, {REASONS} = '' AS accepted FROM documents")
def _(s, d):
    return filtered(s, d).select("doc_id", "reasons", "accepted")


@query("reason_histogram", f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({REASONS}, '|')) AS reason FROM documents) WHERE reason <> '' GROUP BY reason")
def _(s, d):
    return C.reason_histogram(filtered(s, d), "reasons")


@query(
    "group_split",
    """WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY md5('v|' || source), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, floor(sum(n) OVER (PARTITION BY lang) * 0.1::DOUBLE) AS target FROM g)
SELECT lang, source, n, CASE WHEN before < target THEN 'validation' ELSE 'train' END AS split FROM o""",
)
def _(s, d):
    return C.group_split(docs(s, d), "source", "lang", 0.1, "v")


@query("hash_shards")
def _(s, d):
    return docs(s, d).groupBy(C.shard(F.col("doc_id"), 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("truncation_stats", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, max(n_chars) AS longest, round(avg(CASE WHEN n_chars > 4608 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS truncated FROM documents GROUP BY lang")
def _(s, d):
    return C.truncation(docs(s, d), F.col("n_chars"), 4608, ["lang"])


@query("chat_format", "SELECT conv_id, md5(string_agg(role || chr(10) || text, chr(11) ORDER BY turn)) AS digest, count(*) AS n FROM conversations GROUP BY conv_id")
def _(s, d):
    m = C.chat_rows(table(s, d, "conversations"), "conv_id", "turn", "role", "text")
    return m.select("conv_id", F.md5(F.array_join(F.transform("messages", lambda x: F.concat_ws("\n", x["role"], x["content"])), "\x0b").cast("binary")).alias("digest"), F.size("messages").cast("long").alias("n"))


@query("overlay_latest", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE -1 END AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(s, d):
    new = table(s, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return C.overlay(docs(s, d).select("doc_id", F.lit(-1).cast("long").alias("quality")), new, "doc_id", ["quality"])


@query("slot_rarity", f"WITH g AS (SELECT slot, count(*) AS n FROM (SELECT unnest({DETECT}) AS slot FROM documents) GROUP BY slot) SELECT slot, n, row_number() OVER (ORDER BY n, CASE slot WHEN 'purpose' THEN 0 WHEN 'scope' THEN 1 ELSE 2 END, slot) AS priority FROM g")
def _(s, d):
    rows = docs(s, d).select(F.explode(C.slots(F.col("text"), SLOTS)).alias("slot"))
    return C.rarity_priority(rows, "slot", ("purpose", "scope")).withColumn("priority", F.col("priority").cast("long"))


@query(
    "readiness",
    "WITH t AS (SELECT coalesce(lang, '') AS task, count(*) AS n, count_if(quality = 1) AS a, count_if(n_chars < 300) AS w FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY 1) SELECT sum(n)::BIGINT AS n, sum(a)::BIGINT AS accepted, sum(w)::BIGINT AS weak, string_agg(CASE WHEN a > 0 THEN task || '=' || a END, ',' ORDER BY task) AS accepted_by_task, string_agg(CASE WHEN w > 0 THEN task || '=' || w END, ',' ORDER BY task) AS weak_by_task, sum(a) >= 50 AND coalesce(max(CASE WHEN task = 'en' THEN a END), 0) >= 30 AND coalesce(max(CASE WHEN task = 'es' THEN a END), 0) >= 5 AS ready FROM t",
)
def _(s, d):
    """Whether enough documents of each language are marked good."""
    good = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs(s, d).join(good, "doc_id", "left")
    found = C.readiness(rows, "lang", F.col("quality") == 1, F.col("n_chars") < 300, 50, {"en": 30, "es": 5})
    line = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("n", "accepted", "weak", line("accepted_by_task").alias("accepted_by_task"), line("weak_by_task").alias("weak_by_task"), "ready")


META = "CASE WHEN doc_id % 5 = 0 THEN source WHEN doc_id % 5 = 1 THEN '  ' END"


@query(
    "supported_slots",
    f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(text, {chr(39)}(?i){p}{chr(39)})' + (f' OR trim(coalesce({META}, {chr(39)}{chr(39)})) <> {chr(39)}{chr(39)}' if n == 'contract' else '') + f' THEN {chr(39)}{n}{chr(39)} END' for n, p in SLOTS.items())}, CASE WHEN doc_id % 3 = 0 THEN 'dated' END], lambda x: x IS NOT NULL), '|') AS supported, array_to_string(list_distinct_in_order, '|') AS tabular FROM (SELECT *, list_concat(CASE WHEN contains(text, '|') THEN ['budget', 'schedule'] ELSE [] END, list_filter([CASE WHEN regexp_matches(text, 'tion') AND NOT contains(text, '|') THEN 'budget' END, CASE WHEN regexp_matches(text, '[0-9]{{2}}') THEN 'modules' END], lambda x: x IS NOT NULL)) AS list_distinct_in_order FROM documents)",
)
def _(s, d):
    k = F.col("doc_id")
    meta = F.when(k % 5 == 0, F.col("source")).when(k % 5 == 1, "  ")
    supported = C.supported_slots(F.col("text"), SLOTS, {"contract": meta, "dated": F.when(k % 3 == 0, k)})
    tabular = C.table_like_slots(F.col("text"), F.col("text").contains("|"), ("budget", "schedule"), {"budget": "tion", "modules": "[0-9]{2}"})
    return docs(s, d).select("doc_id", F.array_join(supported, "|").alias("supported"), F.array_join(tabular, "|").alias("tabular"))


@query(
    "pool_merge",
    r"""WITH p AS (SELECT 0 AS pool, 'approved' AS provenance, conv_id * 1000 + turn AS qid, conv_id, text FROM conversations WHERE role = 'user' AND turn = 0 UNION ALL SELECT 1, 'revived', conv_id * 1000 + turn, conv_id, text FROM conversations WHERE role = 'user' AND turn > 0 UNION ALL SELECT 2, 'generated', 1000000000 + conv_id * 1000 + turn, conv_id, CASE WHEN turn % 3 = 0 THEN '  ' || replace(text, ' ', '   ') ELSE text || ' again' END FROM conversations WHERE role = 'user' UNION ALL SELECT 2, 'generated', 2000000000 + conv_id, conv_id, ' ' FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY pool, qid) AS n FROM p WHERE trim(text) <> '') SELECT qid, conv_id, provenance FROM s WHERE n = 1""",
)
def _(s, d):
    """Approved questions, follow-ups and generated ones; an earlier pool wins where a question is the same."""
    c = table(s, d, "conversations")
    u = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "conv_id", "turn", "text")
    keep = ("qid", "conv_id", "text")
    made = u.select((F.col("qid") + 1_000_000_000).alias("qid"), "conv_id", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("   ")))).otherwise(F.concat("text", F.lit(" again"))).alias("text"))
    blank = c.select((F.col("conv_id") + 2_000_000_000).alias("qid"), "conv_id", F.lit(" ").alias("text"))
    signature = F.concat_ws("::", F.col("conv_id").cast("string"), C.even_text(F.col("text")))
    return C.merge_pools([("approved", u.where("turn = 0").select(*keep)), ("revived", u.where("turn > 0").select(*keep)), ("generated", made.unionByName(blank))], signature, "text", "qid").select("qid", "conv_id", "provenance")


@query("dependency_history", "SELECT c.conv_id, c.turn, md5(string_agg(p.text, chr(10) ORDER BY p.turn)) AS history FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn < c.turn AND p.turn >= c.turn - 2 GROUP BY ALL")
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    wanted = c.where("turn > 0").select("conv_id", "turn", F.explode(F.sequence(F.greatest(F.col("turn") - 2, F.lit(0)), F.col("turn") - 1)).alias("parent"))
    found = wanted.join(c.select("conv_id", F.col("turn").alias("parent"), "text"), ["conv_id", "parent"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("parent", "text"))), lambda x: x["text"]), "\n")
    return found.groupBy("conv_id", "turn").agg(F.md5(joined.cast("binary")).alias("history"))


@query("last_prompt", "SELECT conv_id, max_by(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(s, d):
    return table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("prompt"))


@query("session_title", "SELECT conv_id, left(min_by(text, turn), 38) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(s, d):
    return table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 38).alias("title"))


@query("artifacts", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND (length(text) >= 1000 OR contains(text, '```') OR contains(text, '|'))")
def _(s, d):
    t = F.col("text")
    return table(s, d, "conversations").where((F.col("role") == "assistant") & ((F.length(t) >= 1000) | t.contains("```") | t.contains("|"))).select("conv_id", "turn")


@query("dedupe_last", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(s, d):
    last = table(s, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return last.select("user_id", "m.event_id", "m.event_type")


@query("dup_near", "WITH g AS (SELECT item_id AS k, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, CAST(i AS INT), 3))) AS g FROM (SELECT item_id, regexp_replace(lower(text), '[^0-9a-z가-힣._-]', '', 'g') AS s FROM benchmark)), p AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) AS u FROM g a JOIN g b ON a.k < b.k) SELECT a, b, round(i / (u - i)::DOUBLE, 6) AS jaccard FROM p WHERE i / (u - i)::DOUBLE >= 0.3")
def _(s, d):
    from ..functions.text import char_ngrams

    return C.ngram_pairs(table(s, d, "benchmark"), "item_id", char_ngrams(F.col("text")), 0.3)


SLOT_PAIRS = (("budget", "schedule"), ("scope", "contract"), ("purpose", "scope"), ("budget", "contract"), ("schedule", "purpose"), ("scope", "budget"))
SINGLE = ("What are {a} and {b} of {key}?", "Sum up {a} and {b} in {key}.", "How does {key} put {a}, and how {b}?", "List {b} of {key} by {a}.", "Does {key} name {a} or {b}?")
COMPARE = ("Compare {key} by {a} and {b}.", "How do {a} and {b} of {key} differ?")
TABLE_FORM = "Give {a} and {b} of {key} from its tables and its text."


def _families_sql():
    fill = lambda fs: ", ".join(f"({i}, '{a}', '{b}', '{f.replace('{a}', a).replace('{b}', b)}')" for i, (a, b, f) in enumerate((a, b, f) for a, b in SLOT_PAIRS for f in fs))
    cut = lambda family, key, rows, cap: f"SELECT '{family}' AS family, {key} AS key, rn - 1 AS place, a || '|' || b AS slots, q AS question FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) AS rn FROM ({rows})) WHERE rn <= {cap}"
    single = f"SELECT CAST(doc_id AS VARCHAR) AS k, i, a, b, replace(q, '{{key}}', CAST(doc_id AS VARCHAR)) AS q FROM s JOIN (VALUES {fill(SINGLE)}) f(i, a, b, q) ON list_contains(l, a) OR list_contains(l, b)"
    pair = f"SELECT p AS k, i, a, b, replace(q, '{{key}}', p) AS q FROM (SELECT x.doc_id || ' and ' || y.doc_id AS p, list_concat(x.l, y.l) AS l FROM s x JOIN s y ON y.doc_id = x.doc_id + 1) JOIN (VALUES {fill(COMPARE)}) f(i, a, b, q) ON list_contains(l, a) OR list_contains(l, b)"
    body = "CASE WHEN len(list_filter(l, lambda x: x IN ('scope', 'purpose'))) > 0 THEN list_filter(l, lambda x: x IN ('scope', 'purpose')) ELSE ['purpose', 'scope'] END"
    tab = f"SELECT CAST(doc_id AS VARCHAR) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS i, a, b, replace(replace(replace('{TABLE_FORM}', '{{key}}', CAST(doc_id AS VARCHAR)), '{{a}}', a), '{{b}}', b) AS q FROM (SELECT doc_id, a, unnest({body}) AS b FROM (SELECT doc_id, l, unnest(list_filter(l, lambda x: x IN ('budget', 'contract', 'schedule'))) AS a FROM s))"
    return f"WITH s AS (SELECT doc_id, {DETECT} AS l FROM documents) {cut('single_doc', 'k', single, 24)} UNION ALL {cut('comparison', 'k', pair, 4)} UNION ALL {cut('table_plus_body', 'k', tab, 4)}"


@query("template_families", _families_sql())
def _(s, d):
    """Questions of three families: 24 a document, 4 a pair of neighbouring documents, 4 a document with tables."""
    rows = docs(s, d).select("doc_id", C.slots(F.col("text"), SLOTS).alias("l"))
    one = rows.select(F.col("doc_id").cast("string").alias("key"), "l")
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other"), F.col("l").alias("m"))
    two = rows.join(after, "doc_id").select(F.concat_ws(" and ", F.col("doc_id").cast("string"), F.col("other").cast("string")).alias("key"), F.concat("l", "m").alias("l"))
    among = lambda *names: F.filter("l", lambda x: x.isin(*names))
    made = {
        "single_doc": C.slot_questions(one, "key", "l", SLOT_PAIRS, SINGLE, 24),
        "comparison": C.slot_questions(two, "key", "l", SLOT_PAIRS, COMPARE, 4),
        "table_plus_body": C.table_questions(one, "key", among("budget", "contract", "schedule"), among("scope", "purpose"), TABLE_FORM, 4),
    }
    out = None
    for family, q in made.items():
        q = q.select(F.lit(family).alias("family"), "key", F.col("place").cast("long").alias("place"), F.array_join("slots", "|").alias("slots"), "question")
        out = q if out is None else out.unionByName(q)
    return out


@query("greedy_quotas")
def _(s, d):
    """Order lines by price, 4 an order, 24 a supplier and 8 a part at most, all at once."""
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("price"))
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    use = lambda quota, c: F.struct(F.lit(quota).alias("quota"), F.col(c).cast("string").alias("of"))
    rows = li.select(key.alias("key"), "price", "l_orderkey", "l_suppkey", "l_partkey")
    taken = C.greedy_quotas(rows, "key", -F.col("price"), F.array(use("order", "l_orderkey"), use("supplier", "l_suppkey"), use("part", "l_partkey")), {"order": 4, "supplier": 24, "part": 8})
    return taken.select("key", "price", "l_orderkey", "l_suppkey", "l_partkey")
