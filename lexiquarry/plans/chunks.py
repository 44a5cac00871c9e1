"""Chunking queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import trimmed
from ..operators import chunking as K
from ..registry import query, table
from .texts import NORMAL, TRIM

docs = lambda s, d: table(s, d, "documents").select("doc_id", "text", "source")
HEADING = r"(?m)^(?:The|La|De|Der|In)[ ,.]"
MARKED = rf"regexp_replace(replace({NORMAL}, chr(1), ''), '(?m)(^(?:The|La|De|Der|In)[ ,.])', chr(1) || '\1', 'g')"


@query(
    "section_split",
    f"""WITH p AS (SELECT doc_id, string_split({MARKED}, chr(1)) AS p FROM documents),
k AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN p[2:] ELSE p END AS p FROM p),
c AS (SELECT doc_id, list_filter(list_transform(p, lambda x: {TRIM.format('x')}), lambda x: x <> '') AS p FROM k)
SELECT doc_id, CAST(unnest(range(0, len(p))) AS INT) AS section_no, md5(unnest(p)) AS digest FROM c""",
)
def _(s, d):
    return docs(s, d).select("doc_id", F.posexplode(K.sections(F.col("text"), HEADING)).alias("section_no", "t")).select("doc_id", "section_no", F.md5(F.col("t").cast("binary")).alias("digest"))


@query("paragraph_pack")
def _(s, d):
    packed = docs(s, d).select("doc_id", F.posexplode(K.packed_paragraphs(F.col("text"), 1000, "\n")).alias("chunk_index", "t"))
    return packed.select("doc_id", "chunk_index", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("recursive_chunks")
def _(s, d):
    rows = K.chunk_rows(docs(s, d), K.recursive_chunks(F.col("text"), 1000), F.col("source"))
    return rows.select("doc_id", "chunk_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


WINDOWS = "(SELECT doc_id, source, text, unnest(range(0, CAST(greatest(ceil((length(text) - 120) / 1280.0), 1) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)"
CUT = TRIM.format("substr(text, i * 1280 + 1, 1400)")


@query("fixed_window_chunks", f"SELECT doc_id, CAST(i AS INT) AS chunk_index, i * 1280 AS start, md5({CUT}) AS digest FROM {WINDOWS} WHERE {CUT} <> ''")
def _(s, d):
    return K.fixed_windows(docs(s, d)).select("doc_id", "chunk_index", "start", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "chunk_overlap",
    f"""WITH c AS (SELECT doc_id, i, substr(text, i * 500 + 1, 500) AS t FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents)),
t AS (SELECT doc_id, i, {TRIM.format('t')} AS t FROM c), l AS (SELECT *, {TRIM.format("right(lag(t) OVER (PARTITION BY doc_id ORDER BY i), 100)")} AS p FROM t)
SELECT doc_id, CAST(i AS INT) AS chunk_index, md5(CASE WHEN coalesce(p, '') = '' THEN t ELSE {TRIM.format("p || chr(10) || t")} END) AS digest FROM l WHERE t <> ''""",
)
def _(s, d):
    rows = docs(s, d).select("doc_id", F.posexplode(K.slices(F.col("text"), 500)).alias("chunk_index", "text"))
    return K.with_overlap(rows, 100).where(F.col("text") != "").select("doc_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "chunk_assembly",
    f"SELECT doc_id, source || '::' || CAST(i AS VARCHAR) AS chunk_id, length({TRIM.format('substr(text, i * 800 + 1, 800)')}) AS n FROM (SELECT doc_id, source, text, unnest(range(0, CAST(ceil(length(text) / 800.0) AS BIGINT))) AS i FROM documents) WHERE {TRIM.format('substr(text, i * 800 + 1, 800)')} <> ''",
)
def _(s, d):
    return K.chunk_rows(docs(s, d), K.slices(F.col("text"), 800), F.col("source")).select("doc_id", "chunk_id", F.length("text").cast("long").alias("n"))


@query(
    "chunk_grid_stats",
    """WITH g AS (SELECT length(text) AS n, size, overlap, size - overlap AS step FROM documents, (VALUES (500, 100), (1000, 200), (1500, 300)) AS g(size, overlap) WHERE length(text) > 0),
c AS (SELECT *, CAST(greatest(ceil((n - overlap) / step::DOUBLE), 1) AS BIGINT) AS c FROM g)
SELECT size, overlap, CAST(sum(c) AS BIGINT) AS chunks, round(sum((c - 1) * size + n - (c - 1) * step) / sum(c)::DOUBLE, 2) AS mean_length FROM c GROUP BY size, overlap""",
)
def _(s, d):
    return K.grid_stats(docs(s, d))


@query(
    "body_window_sections",
    f"""WITH p AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(The|La|De|Der|In)')) AS labels FROM documents WHERE length(text) > 0),
w AS (SELECT *, unnest(range(0, CAST(greatest(ceil((length(text) - 120) / 730.0), 1) AS BIGINT))) AS i FROM p)
SELECT doc_id, CAST(i AS INT) AS chunk_index, CASE WHEN len(labels) > 0 THEN left(labels[CAST(floor(i * 730 / greatest(length(text), 1)::DOUBLE * (len(labels) - 1)) AS BIGINT) + 1], 40) END AS section_label
FROM w WHERE {TRIM.format('substr(text, i * 730 + 1, 850)')} <> ''""",
)
def _(s, d):
    labels = F.filter(F.split("text", "\n"), lambda x: x.rlike("^(The|La|De|Der|In)"))
    rows = docs(s, d).withColumn("labels", labels).withColumn("n", F.length("text"))
    at = F.floor(F.col("start") / F.greatest(F.col("n"), F.lit(1)) * (F.size("labels") - 1)).cast("int") + 1
    return K.fixed_windows(rows, 850, 120).select("doc_id", "chunk_index", F.when(F.size("labels") > 0, F.substring(F.try_element_at("labels", at), 1, 40)).alias("section_label"))


LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query(
    "section_filldown",
    f"SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(last_value(CASE WHEN regexp_matches(line, '^(The|La|De|Der|In)') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS section FROM {LINES}",
)
def _(s, d):
    rows = K.fill_down(K.lines(docs(s, d)), F.when(F.col("line").rlike("^(The|La|De|Der|In)"), F.col("line")), "section")
    return rows.select("doc_id", "line_no", F.md5(F.col("section").cast("binary")).alias("section"))


@query(
    "window_body",
    f"""SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(array_to_string(list_filter(b, lambda x: x IS NOT NULL), chr(10))) AS body FROM (
 SELECT doc_id, line_no, m, list(CASE WHEN NOT m AND {TRIM.format('line')} <> '' THEN {TRIM.format('line')} END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS b
 FROM (SELECT *, contains(line, '|') AS m FROM {LINES})) WHERE m""",
)
def _(s, d):
    rows = K.around(K.lines(docs(s, d)), F.col("line").contains("|"))
    return rows.select("doc_id", "line_no", F.md5(F.col("body").cast("binary")).alias("body"))


GOOD = "length(regexp_replace(x, '[^0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣÀ-ÿ\\s.,:;!?()/%·\\-]', '', 'g'))"


@query(
    "readable_lines",
    f"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> '' AND NOT (length(x) >= 6 AND {GOOD} < length(x) * 0.45::DOUBLE) AND NOT (length(x) <= 3 AND NOT regexp_matches(x, '[A-Za-z가-힣À-ÿ]'))), chr(10))) AS digest FROM documents",
)
def _(s, d):
    return docs(s, d).select("doc_id", F.md5(K.readable_lines(F.col("text")).cast("binary")).alias("digest"))


MARKED = f"""x AS (SELECT doc_id, line_no, line, contains(line, '|') AS m, last_value(CASE WHEN regexp_matches(line, '^(The|La|De|Der|In)') THEN substr({TRIM.format('line')}, 1, 40) END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN regexp_matches(line, '^[A-Z]{{2}}') THEN substr({TRIM.format('line')}, 1, 20) END IGNORE NULLS) OVER w AS p FROM {LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, list(CASE WHEN NOT m AND {TRIM.format('line')} <> '' THEN {TRIM.format('line')} END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS around FROM x),
c AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n, coalesce(s, '') AS s, coalesce(p, '') AS p, contains(line, '!!') AS figure, array_to_string(list_filter(around, lambda z: z IS NOT NULL), chr(10)) AS body FROM b WHERE m),
t AS (SELECT *, concat_ws(chr(10), CASE WHEN p <> '' THEN '[PARENT] ' || p END, CASE WHEN s <> '' THEN '[SECTION] ' || s END, CASE WHEN figure THEN '[FIGURE_MARKER]' ELSE '[TABLE_MARKER]' END, CASE WHEN {TRIM.format('body')} <> '' THEN '[BODY] ' || body END) AS text FROM c)
SELECT doc_id, CAST(line_no AS INT) AS line_no, 'doc-' || doc_id || '__mixed_' || lpad(CAST(n AS VARCHAR), 4, '0') AS chunk_id, CASE WHEN s <> '' THEN s ELSE p END AS item_title, CASE WHEN figure THEN 'figure' ELSE 'table' END AS kind, CAST(CASE WHEN figure THEN 0 ELSE 1 END AS INT) AS has_table, round(least(1.0::DOUBLE, doc_id % 7 / 5.0::DOUBLE), 4) AS ocr_confidence, md5(text) AS digest, CAST(regexp_matches(text, '[0-9]{{3}}') AS INT) AS has_number_signal FROM t"""


@query("marker_chunks", "WITH " + MARKED)
def _(s, d):
    """A chunk for each line with a bar of every document."""
    line = F.col("line")
    made = K.marker_chunks(
        K.lines(docs(s, d)), line.contains("|"), F.when(line.rlike("^(The|La|De|Der|In)"), F.substring(X.trimmed(line), 1, 40)), F.when(line.rlike("^[A-Z]{2}"), F.substring(X.trimmed(line), 1, 20)),
        figure=line.contains("!!"), prefix=F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), confidence=F.col("doc_id") % 7 / 5.0, signals={"number": "[0-9]{3}"},
    )
    return made.select("doc_id", "line_no", "chunk_id", "item_title", "kind", "has_table", "ocr_confidence", F.md5(F.col("text").cast("binary")).alias("digest"), "has_number_signal")
