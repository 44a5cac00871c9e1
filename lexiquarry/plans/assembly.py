"""Context queries: benchmark texts are the questions, documents the chunks, and a document's source the paper it is in."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.text import tokens
from ..operators import assembly as A
from ..operators import ranking as K
from ..operators import retrieval as R
from ..registry import query, table
from .search import BM25, DISTANCE, TERMS, as_long, questions, vectors

P = lexicon.LATIN_PROFILE
FLAGS = ("budget", "schedule", "contract", "purpose")


def chunks(s, d):
    has = {f"has_{f}": F.col("text").rlike(P[f]).cast("int") for f in FLAGS[:3]}
    rows = table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("name"), "lang")
    return rows.withColumns({**has, "has_table": F.col("text").contains("|").cast("int")})


def expected(s, d):
    """Two sources a question: that of the document of its number, and the one that its number names."""
    q = questions(s, d).select("query_id")
    own = q.join(table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("name")), "query_id")
    return own.unionByName(q.select("query_id", F.concat(F.lit("src"), (F.col("query_id") * 3 % 25).cast("string")).alias("name"))).distinct()


def index(s, d):
    return R.Bm25(chunks(s, d), tokens(F.col("text")), keep=["name"])


def nearest(s, d, asked, k):
    v = vectors(s, d)
    return R.vector_top(v, v.join(asked.select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), "embedding"), k)


def profile(s, d):
    """Sets adjusted_score: fused score and field bonus."""
    asked = questions(s, d).select("query_id", F.col("text").alias("question"), F.lit("factual").alias("answer_type"), F.array().cast("array<string>").alias("depends_on"))
    asked = K.question_profile(asked, {f: P[f] for f in FLAGS}).select("query_id", "question", *FLAGS)
    fields = chunks(s, d).select("chunk_id", *[f"has_{f}" for f in FLAGS[:3]], "has_table", "lang", F.col("name").alias("source"))

    def rerank(rows):
        rows = rows.join(fields, "chunk_id").join(asked, "query_id").withColumn("adjusted_score", F.lit(None).cast("double"))
        return K.field_bonus(rows, F.concat_ws(" ", "source", "lang"), "src[0-4]")

    return rerank


def inside(s, d, asked, wanted, bm25):
    """Candidates of asked questions inside the documents wanted."""
    lex = bm25.within(asked, tokens(F.col("text")), wanted, "name", 24)
    return A.within_documents(nearest(s, d, asked, 24), lex, bm25.docs.select("chunk_id", "name"), wanted)


EXPECTED = "e AS (SELECT item_id AS query_id, source AS name FROM benchmark JOIN documents ON doc_id = item_id UNION SELECT item_id, 'src' || CAST(item_id * 3 % 25 AS VARCHAR) FROM benchmark)"
NEAREST = f"near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {DISTANCE} AS distance FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 24)"
LEXICAL24 = "lex24 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 24)"
INSIDE = """lexin AS (SELECT query_id, name, chunk_id, row_number() OVER (PARTITION BY query_id, name ORDER BY coalesce(score, 0) DESC, chunk_id) AS rank FROM (SELECT e.query_id, e.name, doc_id AS chunk_id FROM e JOIN documents ON source = e.name) LEFT JOIN bm USING (query_id, chunk_id)),
nearin AS (SELECT query_id, name, chunk_id, row_number() OVER (PARTITION BY query_id, name ORDER BY near.rank, chunk_id) AS rank FROM near JOIN documents ON doc_id = chunk_id JOIN e USING (query_id) WHERE e.name = source),
inside AS (SELECT query_id, name, chunk_id, round(sum(p), 9) AS fusion_score FROM (SELECT query_id, name, chunk_id, 0.7::DOUBLE / (60 + rank) AS p FROM nearin UNION ALL SELECT query_id, name, chunk_id, 0.3::DOUBLE / (60 + rank) FROM lexin WHERE rank <= 24) GROUP BY ALL)"""
M = "regexp_matches({}, '{}')"
BOTH = lambda f: f"{M.format('q.text', P[f])} AND {M.format('c.text', P[f])}"
BONUS = (
    " + ".join(f"(CASE WHEN {BOTH(f)} THEN 0.0045::DOUBLE ELSE 0 END)" for f in FLAGS[:3])
    + f" + (CASE WHEN {M.format('q.text', P['purpose'])} AND regexp_matches(c.source, 'src[0-4]') THEN 0.0035::DOUBLE ELSE 0 END)"
    + f" + (CASE WHEN contains(c.text, '|') AND ({M.format('q.text', P['budget'])} OR {M.format('q.text', P['schedule'])}) THEN 0.0015::DOUBLE ELSE 0 END)"
    + f" + least(0.003::DOUBLE, len(list_intersect(list_distinct({TERMS.replace('text', 'q.text')}), list_distinct({TERMS.replace('text', chr(39) + chr(39) + ' || c.source || ' + chr(39) + ' ' + chr(39) + ' || c.lang')}))) * 0.0005::DOUBLE)"
)
ANCHORED = f"""scored AS (SELECT i.*, round(fusion_score + ({BONUS}), 9) AS adjusted_score FROM inside i JOIN benchmark q ON item_id = query_id JOIN documents c ON doc_id = chunk_id),
anchored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY adjusted_score DESC, chunk_id) AS rn FROM scored) WHERE rn = 1)"""


@query("doc_anchored", f"WITH {BM25}, {EXPECTED}, {NEAREST}, {INSIDE}, {ANCHORED} SELECT query_id, name, chunk_id, fusion_score, adjusted_score, row_number() OVER (PARTITION BY query_id ORDER BY adjusted_score DESC, chunk_id) AS ord FROM anchored")
def doc_anchored(s, d):
    """The best chunk of each document that a question expects, found inside that document."""
    found = inside(s, d, questions(s, d), expected(s, d), index(s, d))
    return as_long(A.anchors(found, profile(s, d)).select("query_id", "name", "chunk_id", "fusion_score", "adjusted_score", "ord"), "ord")


#: Slots of the probe: other words for a slot, and what shows support for it.
LEXICON = {"license": (("copyright", "terms"), (r"all rights reserved", r"\blicen[cs]e\b")), "contact": (("mail", "tion"), (r"@[a-z0-9-]+\.", r"\+[0-9]{6,}")), "price": (("cost", "que"), (r"[0-9] ?(eur|usd|\$)",))}
SLOTS = tuple(LEXICON)


def papers(s, d):
    """One row per source: its languages and length as metadata, the first ten documents with a bar, and the start of the first."""
    docs = table(s, d, "documents").select("doc_id", "text", "lang", F.col("source").alias("name"))
    facts = docs.groupBy("name").agg(F.concat_ws(" ", F.col("name"), F.array_join(F.array_sort(F.collect_set("lang")), " ")).alias("metadata"), F.substring(F.min_by("text", "doc_id"), 1, 2000).alias("body"))
    first = R.top(docs.where(F.col("text").contains("|")), 10, F.asc("doc_id"), by=("name",))
    tables = first.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("tables"))
    return facts.join(tables, "name", "left")


def _support_sql():
    asked = " WHEN ".join(f"{i} THEN '{x}'" for i, x in enumerate(SLOTS))
    direct = " OR ".join(f"(slot = '{n}' AND regexp_matches(text, '(?i){p}'))" for n, (_, ps) in LEXICON.items() for p in ps)
    low = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
    words = "list_filter([" + ", ".join(f"CASE WHEN slot = '{n}' AND contains({low}, '{w}') THEN '{w}' END" for n, (ws, _) in LEXICON.items() for w in (n, *ws)) + "], lambda x: x IS NOT NULL)"
    norm = BM25.replace("FROM benchmark", r"FROM (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS text FROM benchmark)")
    return f"""WITH {BM25}, {EXPECTED}, {NEAREST}, z AS (WITH {norm} SELECT * FROM lex),
a AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN {asked} END AS slot FROM benchmark),
paper AS (SELECT source AS name, source || ' ' || string_agg(DISTINCT lang, ' ' ORDER BY lang) AS metadata, substr(min_by(text, doc_id), 1, 2000) AS body FROM documents GROUP BY source),
tabs AS (SELECT source AS name, string_agg(text, ' ' ORDER BY doc_id) AS tables FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE contains(text, '|')) WHERE rn <= 10 GROUP BY source),
lists AS (SELECT 'dense' AS probe, query_id, chunk_id FROM near WHERE rank <= 10 UNION ALL SELECT 'lexical', query_id, chunk_id FROM lex UNION ALL SELECT 'normalized', query_id, chunk_id FROM z),
ev AS (SELECT query_id, probe, text FROM lists JOIN documents ON doc_id = chunk_id SEMI JOIN e ON e.query_id = lists.query_id AND e.name = source
 UNION ALL SELECT query_id, 'metadata', metadata FROM e JOIN paper USING (name) UNION ALL SELECT query_id, 'table_body', tables FROM e JOIN tabs USING (name) UNION ALL SELECT query_id, 'table_body', body FROM e JOIN paper USING (name) WHERE body <> ''),
s AS (SELECT query_id, probe, CASE WHEN {direct} THEN 1 ELSE 0 END AS direct, {words} AS found FROM ev JOIN a USING (query_id)),
t AS (SELECT query_id, {", ".join(f"CAST(coalesce(sum(direct) FILTER (probe = '{p}'), 0) AS BIGINT) AS {p}" for p in A.PROBES)}, CAST(coalesce(sum(direct), 0) AS BIGINT) AS direct_total, CAST(coalesce(sum(CASE WHEN direct = 0 AND len(found) > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS indirect_total,
 array_to_string(list_sort(list_distinct(flatten(list(found) FILTER (probe <> 'normalized')))), '|') AS words FROM benchmark LEFT JOIN s ON query_id = item_id GROUP BY query_id)
SELECT item_id AS query_id, {", ".join(f"coalesce({p}, 0) AS {p}" for p in (*A.PROBES, "direct_total", "indirect_total"))}, coalesce(indirect_total >= 3 AND direct_total = 0, false) AS ambiguity,
 CASE WHEN direct_total >= 1 THEN 'supported' WHEN indirect_total >= 3 THEN 'ambiguous' ELSE 'not_supported' END AS judge,
 round(CASE WHEN direct_total >= 1 THEN least(0.98::DOUBLE, 0.65::DOUBLE + direct_total * 0.08::DOUBLE) WHEN indirect_total >= 3 THEN 0.55::DOUBLE WHEN coalesce(indirect_total, 0) = 0 THEN 0.85::DOUBLE ELSE 0.72::DOUBLE END, 4) AS confidence,
 CASE WHEN direct_total >= 1 THEN 'type4_rejected_supported' WHEN indirect_total >= 3 THEN 'type4_ambiguous' ELSE 'type4_accepted' END AS status, coalesce(words, '') AS words
FROM benchmark LEFT JOIN t ON query_id = item_id"""


def support(s, d, bm25):
    asked = questions(s, d).withColumn("slots", F.array(F.element_at(F.array(*map(F.lit, SLOTS)), (F.col("query_id") % 3 + 1).cast("int"))))
    plain = asked.withColumn("text", F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    lists = {"dense": nearest(s, d, asked, 10), "lexical": bm25.top(asked, tokens(F.col("text")), 10), "normalized": bm25.top(plain, tokens(F.col("text")), 10)}
    return A.support_verdict(asked, A.support_evidence(expected(s, d), lists, chunks(s, d), papers(s, d)), LEXICON)


@query("support_probes", _support_sql())
def _(s, d):
    """Five probes for each question over its expected documents, and whether it has an answer after all."""
    return support(s, d, index(s, d)).withColumn("words", F.array_join("words", "|"))


TASKS = ("single_doc_factual", "comparison", "table_plus_body", "follow_up", "rejection")


def _rounds_sql():
    task = "CASE item_id % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TASKS)) + " END"
    ranked = lambda rows: f"SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, chunk_id) AS rank FROM ({rows})) WHERE rank <= 6"

    def judged(k, rows):
        return f"""c{k} AS ({rows}), g{k} AS (SELECT query_id, array_to_string(list(chunk_id ORDER BY rank), ',') AS contexts, count(*) AS n, list_distinct(list(source)) AS names, count(*) FILTER (contains(text, '|')) AS tables, count(*) FILTER (NOT contains(text, '|')) AS bodies FROM c{k} JOIN documents ON doc_id = chunk_id GROUP BY query_id),
r{k} AS (SELECT w.query_id, coalesce(contexts, '') AS contexts, list_filter([CASE WHEN coalesce(n, 0) < 2 AND task <> 'rejection' THEN 'too_few_contexts' END, CASE WHEN task = 'comparison' AND len(list_intersect(targets, coalesce(names, []))) < least(2, len(targets)) THEN 'dual_doc_coverage_low' END,
 CASE WHEN task = 'table_plus_body' AND (coalesce(tables, 0) = 0 OR coalesce(bodies, 0) = 0) THEN 'table_body_coverage_low' END, CASE WHEN task = 'follow_up' AND (w.query_id % 2 = 1 OR len(list_intersect(targets, coalesce(names, []))) < len(targets)) THEN 'followup_anchor_resolution_low' END,
 CASE WHEN task = 'rejection' AND judge <> 'not_supported' THEN 'rejection_support_ambiguous' END], lambda x: x IS NOT NULL) AS reasons FROM w LEFT JOIN g{k} USING (query_id))"""

    base = ranked("SELECT query_id, chunk_id, round(sum(p), 9) AS fusion_score FROM (SELECT query_id, chunk_id, 0.7::DOUBLE / (60 + rank) AS p FROM near UNION ALL SELECT query_id, chunk_id, 0.3::DOUBLE / (60 + rank) FROM lex24) GROUP BY ALL")
    both = "SELECT query_id, chunk_id, round(sum(f), 9) AS fusion_score FROM (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS f FROM c1 UNION ALL SELECT query_id, chunk_id, fusion_score FROM anchored) GROUP BY ALL"
    only = """SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place, fusion_score DESC, chunk_id) AS rank FROM (
 SELECT i.*, CASE WHEN row_number() OVER (PARTITION BY query_id, contains(text, '|') ORDER BY fusion_score DESC, chunk_id) > 1 THEN 2 WHEN contains(text, '|') THEN 0 ELSE 1 END AS place
 FROM (SELECT query_id, chunk_id, max(fusion_score) AS fusion_score FROM inside GROUP BY ALL) i JOIN documents ON doc_id = chunk_id)) WHERE rank <= 6"""
    return f"""WITH {BM25}, {EXPECTED}, {NEAREST}, {LEXICAL24}, {INSIDE}, {ANCHORED}, sup AS ({_support_sql()}),
w AS (SELECT item_id AS query_id, {task} AS task, targets, judge FROM benchmark JOIN (SELECT query_id, list(name) AS targets FROM e GROUP BY query_id) t ON t.query_id = item_id JOIN sup ON sup.query_id = item_id),
{judged(1, base)}, {judged(2, ranked(both))}, {judged(3, only)},
k AS (SELECT query_id, r1.contexts AS x1, r1.reasons AS y1, r2.contexts AS x2, r2.reasons AS y2, r3.contexts AS x3, r3.reasons AS y3, len(r2.reasons) < len(r1.reasons) AS b2, len(r3.reasons) < least(len(r1.reasons), len(r2.reasons)) AS b3 FROM r1 JOIN r2 USING (query_id) JOIN r3 USING (query_id))
SELECT query_id, CASE WHEN b3 THEN x3 WHEN b2 THEN x2 ELSE x1 END AS contexts, array_to_string(CASE WHEN b3 THEN y3 WHEN b2 THEN y2 ELSE y1 END, '|') AS reasons, CASE WHEN b3 THEN 'refined' WHEN b2 THEN 'anchored' ELSE 'base' END AS made_by FROM k"""


def context_questions(s, d, bm25):
    task = F.element_at(F.array(*map(F.lit, TASKS)), (F.col("query_id") % 5 + 1).cast("int"))
    targets = expected(s, d).groupBy("query_id").agg(F.collect_set("name").alias("targets"))
    judged = support(s, d, bm25).select("query_id", F.col("judge").alias("support"))
    return questions(s, d).select("query_id", "text", task.alias("task_type"), (F.col("query_id") % 2 == 0).alias("resolvable")).join(targets, "query_id").join(judged, "query_id")


def context_rounds(s, d):
    """The three ways of asking: all documents; those, and an anchor in each expected one; expected ones only, a table and a
    body first."""
    bm25, rerank = index(s, d), profile(s, d)
    tables = chunks(s, d).select("chunk_id", "has_table")

    def base(asked):
        lists = [(nearest(s, d, asked, 24), 0.7), (bm25.top(asked, tokens(F.col("text")), 24), 0.3)]
        return R.top(A.fuse(lists), 6, F.desc("fusion_score"), F.asc("chunk_id"))

    def anchored(asked):
        wanted = expected(s, d).join(asked.select("query_id"), "query_id", "left_semi")
        held = A.anchors(inside(s, d, asked, wanted, bm25), rerank).select("query_id", "chunk_id", "fusion_score")
        both = A.fuse([(base(asked), 1.0)]).unionByName(held).groupBy("query_id", "chunk_id").agg(F.round(F.sum("fusion_score"), 9).alias("fusion_score"))
        return R.top(both, 6, F.desc("fusion_score"), F.asc("chunk_id"))

    def refined(asked):
        wanted = expected(s, d).join(asked.select("query_id"), "query_id", "left_semi")
        found = inside(s, d, asked, wanted, bm25).groupBy("query_id", "chunk_id").agg(F.max("fusion_score").alias("fusion_score"))
        return A.table_and_body(found.join(tables, "chunk_id"), 6)

    return bm25, [("base", base), ("anchored", anchored), ("refined", refined)]


@query("context_rounds", _rounds_sql())
def _(s, d):
    bm25, rounds = context_rounds(s, d)
    built = A.build_contexts(context_questions(s, d, bm25), chunks(s, d).select("chunk_id", "name", "has_table"), rounds)
    return built.select("query_id", F.array_join(F.transform("contexts", lambda c: c.cast("string")), ",").alias("contexts"), F.array_join("reasons", "|").alias("reasons"), "made_by")
