"""Classification and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators import routing as R
from ..registry import query, table
from .chunks import LINES

docs = lambda s, d: table(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
RULES = {
    "comparison": [("(the|der)", 0.42), ("(or|oder|ou) ", 0.3)],
    "follow_up": [("(that|que)", 0.5), ("(ing|keit)", 0.3)],
    "rejection": [("(not|nicht|pas) ", 0.66)],
    "table_factual": [(r"\|", 0.44), ("[0-9]{3}", 0.24)],
    "table_plus_text": [("(tion|ung)", 0.45), (r"!!", 0.35)],
}


def rule_sql(k: str) -> str:
    return "(0.0::DOUBLE + " + " + ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in RULES[k]) + ")"


TYPES = f"""r AS (SELECT doc_id, text, lang = 'en' AS has, {', '.join(f'{rule_sql(k)} AS {k}' for k in RULES)} FROM documents),
m AS (SELECT *, CASE WHEN has THEN follow_up + 0.18::DOUBLE + CASE WHEN regexp_matches(text, 'with') THEN 0.42::DOUBLE ELSE 0.0::DOUBLE END ELSE follow_up * 0.35::DOUBLE END AS fu, CASE WHEN regexp_matches(text, '(?i)table|list') THEN table_plus_text ELSE table_plus_text * 0.5::DOUBLE END AS tp, table_factual + CASE WHEN regexp_matches(text, 'wh') THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS tf FROM r),
t AS (SELECT doc_id, text, comparison + CASE WHEN comparison > 0.45 AND fu > 0.45 AND NOT has THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS co, fu + CASE WHEN comparison > 0.45 AND fu > 0.45 AND has THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END AS fu, rejection, tf, tp FROM m),
u AS (SELECT doc_id, text, unnest(['factual', 'comparison', 'follow_up', 'rejection', 'table_factual', 'table_plus_text']) AS label, unnest([0.33::DOUBLE, round(co, 9), round(fu, 9), round(rejection, 9), round(tf, 9), round(tp, 9)]) AS score, unnest(range(0, 6)) AS place, round(co, 9) AS comp FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) AS rn, nth_value(score, 2) OVER (PARTITION BY doc_id ORDER BY score DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM u),
c AS (SELECT doc_id, label, score, comp, least(0.99::DOUBLE, greatest(0.5::DOUBLE, 0.5::DOUBLE + 0.35::DOUBLE * greatest(0, score - second) + 0.2::DOUBLE * least(1, score))) AS sure FROM k WHERE rn = 1),
s AS (SELECT *, CASE WHEN label = 'factual' AND score <= 0.4 THEN least(sure, 0.72::DOUBLE) ELSE sure END AS s FROM c)"""


@query("answer_type_router", f"WITH {TYPES} SELECT doc_id, CASE WHEN s < 0.56 THEN CASE WHEN comp >= 0.42 THEN 'comparison' ELSE 'factual' END ELSE label END AS answer_type, round(greatest(s, 0.56::DOUBLE), 4) AS confidence FROM s")
def _(s, d):
    rows = docs(s, d).select("doc_id", F.col("text").alias("question"), (F.col("lang") == "en").alias("has_history"))
    return R.answer_type(rows, RULES, anchor="with", table_cue="table|list", interrogative="wh", threshold=0.56).select("doc_id", "answer_type", "confidence")


FIELDS = "SELECT doc_id, len(regexp_extract_all(text, '\\|')) AS tm, doc_id % 3 AS fm, doc_id % 2 AS oc, doc_id % 5 AS vc, n_chars AS tl, doc_id % 4 AS tb, doc_id % 3 AS et, doc_id % 7 AS ht, CASE WHEN lang = 'en' THEN '.hwp' ELSE '.pdf' END AS ext FROM documents"
ROUTED = f"""f AS ({FIELDS}), p AS (SELECT *, oc > 0 OR vc > 0 AS seen, (CASE WHEN tm > 0 THEN 2 ELSE 0 END) + (CASE WHEN fm > 0 THEN 1 ELSE 0 END) + (CASE WHEN oc > 0 OR vc > 0 THEN 2 ELSE 0 END) + (CASE WHEN tl < 1500 THEN 1 ELSE 0 END) + (CASE WHEN ext = '.hwp' THEN 1 ELSE 0 END) + (CASE WHEN tb > 0 AND et = 0 THEN 2 ELSE 0 END) + (CASE WHEN ht > 0 THEN 1 ELSE 0 END) AS score FROM f),
r AS (SELECT *, CASE WHEN seen AND score >= 3 AND (tm > 0 OR tb > 0) THEN 'ocr_plus_table' WHEN seen AND score >= 3 THEN 'ocr_first' WHEN tm > 0 OR tb > 0 THEN 'table_first' ELSE 'text_only' END AS route, score >= 4 AS high FROM p)"""


def routed(s, d):
    i = F.col("doc_id")
    fields = {"table_markers": F.regexp_count("text", F.lit(r"\|")), "figure_markers": i % 3, "ocr_candidates": i % 2, "visual_candidates": i % 5, "text_length": F.col("n_chars"), "table_blocks": i % 4, "enriched_tables": i % 3, "html_tables": i % 7, "extension": F.when(F.col("lang") == "en", ".hwp").otherwise(".pdf")}
    return R.parser_route(docs(s, d).withColumns(fields))


@query(
    "parser_route",
    f"""WITH {ROUTED} SELECT doc_id, route, score, high AS high_priority, array_to_string(list_filter([CASE WHEN tm > 0 THEN 'table_markers=' || tm END, CASE WHEN fm > 0 THEN 'figure_markers=' || fm END, CASE WHEN seen THEN 'ocr_candidates=' || greatest(oc, vc) END, CASE WHEN tl < 1500 THEN 'short_text=' || tl END, CASE WHEN ext = '.hwp' THEN 'format=.hwp' END, CASE WHEN tb > 0 AND et = 0 THEN 'table_blocks_without_enrichment' END, CASE WHEN ht > 0 THEN 'html_probe_table_detected' END, CASE WHEN score = 0 THEN 'default_text_only' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM r""",
)
def _(s, d):
    return routed(s, d).select("doc_id", "route", "score", "high_priority", "reasons")


@query("route_summary", f"WITH {ROUTED} SELECT route, count(*) AS n, count_if(high) AS n_high, round(count(*) / (SELECT count(*) FROM r)::DOUBLE, 4) AS ratio FROM r GROUP BY route")
def _(s, d):
    return R.route_summary(routed(s, d))


@query("pilot_select", f"WITH {ROUTED} SELECT doc_id, score FROM (SELECT r.doc_id, score, source, CASE WHEN contains(source, 'src1') OR contains(source, 'src7') THEN 0 ELSE 1 END AS tier FROM r JOIN documents USING (doc_id)) ORDER BY tier, score DESC, doc_id LIMIT 15")
def _(s, d):
    rows = routed(s, d).withColumn("name", F.concat_ws("-", F.lower("source"), F.lpad(F.col("doc_id").cast("string"), 12, "0")))
    tier = rows.withColumn("n0", F.col("name"))
    first = F.coalesce(*[F.when(F.col("source").contains(r), F.lit(0)) for r in ("src1", "src7")], F.lit(1))
    return R.top_per_bucket(tier.withColumn("all", F.lit(0)).withColumn("tier", first), "all", [F.asc("tier"), F.desc("score"), F.asc("doc_id")], 15).select("doc_id", "score")


FLAGS = r"""length(t) >= 6 AND regexp_matches(t, '\S(?:\s{2,}|\t)\S') AS columns, length(t) >= 6 AND regexp_matches(t, '(\d[\d,./-]*\s+){2,}\d[\d,./-]*') AS numbers, length(t) >= 6 AND regexp_matches(t, '^(\S+\s{2,}){2,}\S+$') AS listing"""


@query(
    "table_line_score",
    f"SELECT doc_id, count_if(columns) AS columns, count_if(numbers) AS numbers, count_if(listing) AS listing FROM (SELECT doc_id, {FLAGS} FROM (SELECT doc_id, trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS t FROM {LINES})) GROUP BY doc_id",
)
def _(s, d):
    return R.table_structure(K.lines(docs(s, d))).select("doc_id", "columns", "numbers", "listing")


@query(
    "line_islands",
    f"WITH h AS (SELECT doc_id, line_no, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) <= 2 THEN 0 ELSE 1 END AS s FROM {LINES} WHERE contains(line, ',')), b AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM h) SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(min(line_no) AS INT) AS first, CAST(max(line_no) AS INT) AS last, count(*) AS rows FROM b GROUP BY doc_id, block",
)
def _(s, d):
    return R.islands(K.lines(docs(s, d)), F.col("line").contains(","))


@query(
    "document_priority",
    f"WITH l AS (SELECT doc_id, count_if(trim(line) <> '') AS n FROM {LINES} GROUP BY doc_id) SELECT doc_id, round(0.5::DOUBLE * (doc_id % 7) + 0.4::DOUBLE * (doc_id % 3) + 0.1::DOUBLE * round(least(n / 40.0::DOUBLE, 8.0) + least(n_chars / 5000.0::DOUBLE, 4.0), 2) - 0.2::DOUBLE * (doc_id % 2), 4) AS priority FROM documents JOIN l USING (doc_id)",
)
def _(s, d):
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    i = F.col("doc_id")
    return docs(s, d).select("doc_id", R.document_priority(i % 7, i % 3, R.complexity(n, F.col("n_chars")), i % 2).alias("priority"))


@query(
    "forward_link",
    f"SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(CASE WHEN NOT h THEN last_value(CASE WHEN h THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS INT) AS parent FROM (SELECT *, regexp_matches(line, '^(The|La|De|Der|In)') AS h FROM {LINES})",
)
def _(s, d):
    return R.forward_link(K.lines(docs(s, d)), F.col("line").rlike("^(The|La|De|Der|In)")).select("doc_id", "line_no", "parent")


@query("review_buckets", "SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 8")
def _(s, d):
    return R.top_per_bucket(docs(s, d), "source", [F.desc("n_chars"), F.asc("doc_id")], 8).select("source", "doc_id", F.col("rn").cast("long").alias("rn"))


BLOCKS = r"""l AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line, contains(line, ' | ') AS flag FROM {lines}), h AS (SELECT doc_id, line_no, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) <= 2 THEN 0 ELSE 1 END AS s FROM l WHERE flag),
b AS (SELECT doc_id, block, min(line_no) AS f, max(line_no) AS t, count(*) AS structured FROM (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM h) GROUP BY ALL),
r AS (SELECT b.*, greatest(0, f - 1) AS a, least((SELECT max(line_no) FROM l WHERE l.doc_id = b.doc_id), t + 1) AS z FROM b),
x AS (SELECT r.*, l.line_no, line, list_filter(list_transform(string_split(regexp_replace(line, '^\s+|\s+$', '', 'g'), ' | '), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')), lambda c: c <> '') AS cells FROM r JOIN l ON l.doc_id = r.doc_id AND l.line_no BETWEEN a AND z),
m AS (SELECT doc_id, block, len(cells) AS n, count(*) AS times, min(line_no) AS first FROM x WHERE len(cells) >= 2 GROUP BY ALL), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY times DESC, first) AS rn FROM m) WHERE rn = 1),
g AS (SELECT doc_id, block, a, z, structured, count(*) AS row_count, count_if(len(cells) >= 2) AS multi, count_if(regexp_matches(line, '\d')) AS numeric, sum(length(regexp_replace(line, '\s+', '', 'g'))) AS whole, sum(CASE WHEN len(cells) >= 2 THEN length(regexp_replace(array_to_string(cells, ''), '\s+', '', 'g')) ELSE 0 END) AS kept, md5(string_agg(CASE WHEN len(cells) >= 2 THEN array_to_string(cells, '|') END, chr(10) ORDER BY line_no)) AS body FROM x GROUP BY ALL),
s AS (SELECT *, round(multi * 1.5::DOUBLE + n + times / multi::DOUBLE * 4 + multi / row_count::DOUBLE * 3 + numeric / row_count::DOUBLE * 1.5::DOUBLE + structured * 0.3::DOUBLE, 2) AS block_score FROM g JOIN k USING (doc_id, block) WHERE row_count >= 3 AND multi >= 2)
SELECT doc_id, CAST(block AS BIGINT) AS block, a + 1 AS start_line, z + 1 AS end_line, row_count, structured AS structured_row_count, n AS modal_column_count, round(times / multi::DOUBLE, 2) AS consistent_row_ratio, round(multi / row_count::DOUBLE, 2) AS multi_column_row_ratio, round(numeric / row_count::DOUBLE, 2) AS numeric_row_ratio, block_score, CASE WHEN whole > 0 THEN round(kept * 100.0::DOUBLE / whole, 2) ELSE 0.0::DOUBLE END AS text_recovery_percent, body FROM s WHERE block_score >= 10"""


@query("table_blocks", "WITH " + BLOCKS.replace("{lines}", LINES))
def _(s, d):
    """Blocks of lines of all documents with a bar as the sign of a row."""
    found = R.table_blocks(K.lines(docs(s, d)), F.col("line").contains(" | "), splitter=r" \| ")
    body = F.md5(F.array_join(F.transform("table_rows", lambda r: F.array_join(r, "|")), "\n").cast("binary"))
    return found.withColumn("body", body).drop("table_rows")


@query("structured_lines", r"""SELECT doc_id, count_if(hit) AS n, coalesce(string_agg(CASE WHEN hit THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no), '') AS line_numbers FROM (SELECT doc_id, line_no, columns OR numbers OR listing OR (length(t) >= 6 AND len(list_filter(string_split_regex(t, '[ \t]{2,}'), lambda x: x <> '')) >= 3 AND len(list_filter(string_split_regex(t, '[ \t]{2,}'), lambda x: x <> '' AND length(x) <= 12)) >= 3) AS hit FROM (SELECT doc_id, line_no, t, {flags} FROM (SELECT doc_id, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM {lines}))) GROUP BY doc_id""".replace("{flags}", FLAGS).replace("{lines}", LINES))
def _(s, d):
    """The numbers of the lines of each document that look like rows of a table."""
    rows = K.lines(docs(s, d)).withColumn("hit", F.coalesce(R.looks_structured(F.col("line")), F.lit(False)))
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("line_no")))), lambda x: x.cast("string")), ",")
    return rows.groupBy("doc_id").agg(F.count_if("hit").alias("n"), numbers.alias("line_numbers"))
