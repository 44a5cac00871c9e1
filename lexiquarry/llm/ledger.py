"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a file is content-addressed (SHA-256 of its text). The ledger lists the (blob, rule, rule
version) triples that have been scanned. A scan pairs its blobs with the current rules, anti-joins the ledger, reads only
blobs with an unseen pair, once each however many paths hold them and only by the rules not yet seen, and adds what it
finds to a table of findings with the same triple. All paths are joined to the findings of the current rules.

Scale: versions are reduced to a representative row per blob by partial aggregation on the digest, so a blob that a
third of all paths share is one row; its text is scanned once. Findings exist for few blobs; copies of such a blob are
dealt over SALTS tasks in the join back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

SALTS = 32


@dataclass(frozen=True)
class Rule:
    """kind, its place in the order of kinds, a pattern whose leftmost non-overlapping matches are candidates, the group
    that must have ``least`` code points, and a version that grows when the rule changes."""

    kind: str
    place: int
    pattern: str
    group: int
    least: int
    version: int = 1
    #: A cheap test that every text with a match passes.
    hint: str | None = None


#: The three base kinds, then what the method adds: private-key blocks and credentials in URLs.
RULES = (
    Rule("assign", 0, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, hint=r"[:=]"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, hint="AKIA"),
    Rule("hex", 2, r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
    Rule("pem", 3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, hint="-----BEGIN"),
    Rule("url", 4, r"[a-z][a-z0-9+]{1,15}://[^\x00-\x20/@:]+:[^\x00-\x20/@]+@", 0, 1, hint="://"),
)
SPAN = "struct<start:int,end:int,place:int,kind:string>"


def digest(text: Column) -> Column:
    """The blob id; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def spans(text: Column, rule: Rule) -> Column:
    """Spans of the rule's candidates that are long enough, in code points.

    The text between matches comes from split, the matches from regexp_extract_all; the running sum of their lengths
    gives the places. All matches take part in it, failing ones are dropped afterwards and not retried.
    """
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    p = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    group = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else whole
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    steps = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), F.transform(whole, F.length), lambda g, w: F.struct(g.alias("g"), w.alias("w"))), F.transform(group, F.length), lambda s, n: F.struct(s["g"].alias("g"), s["w"].alias("w"), n.alias("n")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["g"]
        span = F.struct(begin.alias("start"), (begin + s["w"]).alias("end"), F.lit(rule.place).alias("place"), F.lit(rule.kind).alias("kind"))
        return F.struct((begin + s["w"]).alias("at"), F.when(s["n"] >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(steps, start, step, lambda acc: acc["found"])
    seen = text.rlike(rule.pattern)
    if rule.hint:
        seen = text.rlike(rule.hint) & seen
    return F.when(seen, found).otherwise(empty)


def empty_ledger(spark) -> DataFrame:
    return spark.sql("SELECT '' AS blob, '' AS rule, 0 AS version WHERE false")


def empty_findings(spark) -> DataFrame:
    return spark.sql(f"SELECT '' AS blob, '' AS rule, 0 AS version, CAST(array() AS array<{SPAN}>) AS spans WHERE false")


def unseen(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The (blob, rule, version) of the current rules that the ledger does not list."""
    current = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    return blobs.select("blob", F.explode(current).alias("r")).select("blob", "r.*").join(ledger, ["blob", "rule", "version"], "left_anti")


def scan(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, *, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """versions: every historical version, (path, text). ledger (blob, rule, version) and findings (blob, rule, version,
    spans) are those of earlier scans, both empty at first. Returns the versions with their blob and all findings of the
    current rules (columns path, blob, spans array<start, end, place, kind> by start, then end and place), and the new
    findings and ledger. What the ledger lists is not scanned again; a rule whose version has changed is, and spans of
    its earlier versions are no longer reported.

    Null and empty texts are the empty blob, without findings; repeated rows and paths each get a row; no versions give
    no rows. Null paths are kept.
    """
    spark = versions.sparkSession
    ledger, findings = ledger or empty_ledger(spark), findings or empty_findings(spark)
    # `at` narrows a blob's rows to those of one path, so that few copies of a text move; a blob is told by its digest
    named = versions.select(F.col(f"`{path}`").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    named = named.select("path", "text", digest(F.col("text")).alias("blob"), F.xxhash64("path").alias("at"))
    places = materialize(named.select("path", "blob", "at"), "ledger-paths")
    blobs = places.groupBy("blob").agg(F.min("at").alias("at"))
    fresh = materialize(unseen(blobs, ledger, rules), "ledger-unseen")
    todo = fresh.groupBy("blob").agg(F.collect_set("rule").alias("todo")).join(blobs, "blob")  # at most a rule each
    texts = named.select("blob", "at", "text").join(todo, ["blob", "at"]).groupBy("blob", "at").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    each = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.when(F.array_contains("todo", r.kind), spans(F.col("text"), r)).otherwise(empty).alias("spans")) for r in rules])
    found = texts.select("blob", F.filter(each, lambda x: F.size(x["spans"]) > 0).alias("f")).where(F.size("f") > 0).select("blob", F.explode("f").alias("f")).select("blob", "f.*")
    findings = materialize(findings.select("blob", "rule", "version", "spans").unionByName(found), "ledger-findings")
    is_current = F.struct("rule", "version").isin([F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    by_blob = findings.where(is_current).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))  # at most a row a rule
    salted = by_blob.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = places.withColumn("salt", F.pmod(F.xxhash64("path", "blob"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(salted, ["blob", "salt"], "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))
    return joined, findings, ledger.unionByName(fresh)


def query(spark, sf_dir: str) -> DataFrame:
    """Scans documents by a ledger and a table of findings, both empty before the first scan."""
    found, _, _ = scan(table(spark, sf_dir, "documents"), empty_ledger(spark), empty_findings(spark))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["place"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    by_start = lambda a: F.array_sort(a, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["place"] - y["place"]))
    return found.select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(by_start(base)).cast("binary"), 256).alias("base_sha256"),
        joined(by_start(F.col("spans"))).alias("spans"),
    )


def _sql_spans(kind: str, place: int, pattern: str, group: int, least: int, options: str = "") -> str:
    """(doc_id, kind, place, from, to) of one rule, for DuckDB: gaps between matches and lengths of matches add up to places."""
    more = f", '{options}'" if options else ""
    quoted = pattern.replace("'", "''")
    size = f"length(regexp_extract(m[i], '{quoted}', {group}{more}))" if group else "length(m[i])"
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS n
FROM (SELECT doc_id, m, string_split_regex(text, '{quoted}'{more}) AS g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{quoted}', 0{more}) AS m FROM documents))
WHERE {size} >= {least}"""


def oracle() -> str:
    assign, access, hexes, pem, url = RULES
    parts = [
        _sql_spans("assign", 0, assign.pattern.removeprefix("(?i)"), 2, 12, "i"),
        _sql_spans("access", 1, access.pattern, 0, 18),
        _sql_spans("hex", 2, "[0-9a-f]+", 0, 16),
        _sql_spans("pem", 3, pem.pattern, 0, 1),
        _sql_spans("url", 4, url.pattern, 0, 1),
    ]
    one = "kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(a + n AS VARCHAR)"
    return f"""WITH s AS ({' UNION ALL '.join(parts)}), d AS (
  SELECT doc_id, sum(CAST(kind = 'assign' AS BIGINT)) AS n_assign, sum(CAST(kind = 'access' AS BIGINT)) AS n_access, sum(CAST(kind = 'hex' AS BIGINT)) AS n_hex,
         coalesce(string_agg({one}, ',' ORDER BY a, place) FILTER (WHERE place < 3), '') AS base, string_agg({one}, ',' ORDER BY a, place) AS spans
  FROM s GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN d USING (doc_id)"""


ORACLE = oracle()
