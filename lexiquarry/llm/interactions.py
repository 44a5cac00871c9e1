"""Filter interaction audit by inclusion and exclusion.

Each document gets a flag for every filter that it fails. Joint failures J(S), the documents that fail all filters of S,
are sums of flag products for all subsets S of the filters (32 of five), per part and whole corpus at once. What a set of filters T leaves is
their Moebius inversion, sum over S in T of (-1)^|S| J(S); so one small table answers every order of the filters without
looking at a document again. The failures of a set T are a game whose Harsanyi dividends are d(S) = (-1)^(|S|+1) J(S), and
a filter's Shapley value is the sum of d(S) / |S| over the sets that hold it.

Copies of a text are found by a 256-bit digest, texts never travel. Documents are counted per part and combination of
flags before anything is joined up, so a part or a text that holds a third of all rows is a few partial sums.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, table

FILTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """What a text fails by itself: A under 200 words, B fewer distinct words than half, C more than 3% capitals, D a symbol."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, A..E, good, toxic), flags of 0 and 1, a row per document.

    A null text is the empty text and a null part the empty string. E is the copy flag: an equal text has a smaller
    doc_id, anywhere in the table; rows of one id do not fail each other, and a null id neither fails nor makes others
    fail. good and toxic: a row of labels with this doc_id has quality or toxic 1; null ids have no labels.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        digest.alias("digest"),
        *[c.cast("int").alias(f) for f, c in text_flags(F.col(f"`{text}`")).items()],
    )
    rows = materialize(rows, "audit-flags")
    # written, so that both sides of a join are exchanged and a hot digest or id can be split
    copies = materialize(rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"), "audit-copies")
    one = lambda c: F.max((F.col(f"`{c}`") == 1).cast("int"))
    known = labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    known = materialize(known.where("good = 1 or toxic = 1"), "audit-labels")
    copied = rows.where("id is not null").join(copies, "digest", "left").withColumn("E", F.coalesce((F.col("id") > F.col("first")).cast("int"), F.lit(0)))
    labelled = copied.join(known, "id", "left")
    out = labelled.select("part", *FILTERS, *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES[1:]])
    return out.unionByName(rows.where("id is null").select("part", *FILTERS[:-1], F.lit(0).alias("E"), F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def joint_failures(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, n, good, toxic): arrays over the subsets of filters by bit mask, the first filter being bit 1; element S is
    J(S) for all, good and toxic documents, J(0) being their number."""
    counted = flags.groupBy("part", *filters).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def product(mask: int, measure: str) -> Column:
        return F.sum(reduce(lambda a, b: a * b, [F.col(f) for k, f in enumerate(filters) if mask >> k & 1], F.col(measure)))

    return counted.groupBy("part").agg(*[F.array(*[product(mask, m) for mask in range(1 << len(filters))]).alias(m) for m in MEASURES])


def _subsets(mask: int) -> list[int]:
    return [s for s in range(mask + 1) if s & mask == s]


def _sign(mask: int) -> int:
    return -1 if mask.bit_count() % 2 else 1


def survivors(joint: Column, filters: str = FILTERS) -> Column:
    """Element T of the result is the number of documents that fail none of T."""
    return F.array(*[sum((_sign(s) * joint[s] for s in _subsets(mask)), F.lit(0).cast("long")) for mask in range(1 << len(filters))])


def unique_failures(joint: Column, filters: str = FILTERS) -> Column:
    """Element i of the result is the number of documents that fail filter i only."""
    sets = range(1 << len(filters))
    return F.array(*[sum((-_sign(s) * joint[s] for s in sets if s >> i & 1), F.lit(0).cast("long")) for i in range(len(filters))])


def shapley(joint: Column, filters: str = FILTERS) -> Column:
    """Element i of the result is factorial(filters) times the Shapley value of filter i: a whole number, the documents
    that it removes over all orders."""
    orders = factorial(len(filters))
    sets = range(1 << len(filters))
    return F.array(*[sum((-_sign(s) * (orders // s.bit_count()) * joint[s] for s in sets if s >> i & 1), F.lit(0).cast("long")) for i in range(len(filters))])


def steps(filters: str = FILTERS) -> Column:
    """All orders, step by step: (filter_order, step, filter, before, after), masks of the filters before it and with it."""
    out = []
    for order in permutations(range(len(filters))):
        name, before = "".join(filters[i] for i in order), 0
        for k, i in enumerate(order, 1):
            out.append((name, k, i, before, before | 1 << i))
            before |= 1 << i
    names = ("filter_order", "step", "filter", "before", "after")
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row, strict=True)]) for row in out])


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row per part,
    order of the five filters and step. Without documents there are no parts and no rows."""
    joint = materialize(joint_failures(flagged(docs, labels, **columns)), "audit-joint")
    found = joint.select(
        "part",
        *[survivors(F.col(m)).alias(f"left_{m}") for m in MEASURES],
        F.array(*[F.col("n")[1 << i] for i in range(len(FILTERS))]).alias("fails"),
        unique_failures(F.col("n")).alias("only"),
        shapley(F.col("n")).alias("shares"),
    )
    each = found.withColumn("at", F.explode(steps()))
    removed = {m: F.col(f"left_{m}")[F.col("at.before")] - F.col(f"left_{m}")[F.col("at.after")] for m in MEASURES}
    return each.select(
        "part",
        "at.filter_order",
        "at.step",
        F.col("left_n")[F.col("at.after")].alias("kept"),
        removed["n"].alias("removed"),
        (F.col("fails")[F.col("at.filter")] - removed["n"]).alias("redundant"),
        F.col("only")[F.col("at.filter")].alias("unique_fails"),
        removed["good"].alias("good_lost"),
        removed["toxic"].alias("toxic_lost"),
        F.col("shares")[F.col("at.filter")].alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


#: Applies the filters one after another, as the contract says it.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), label AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), least_id AS (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM d JOIN least_id USING (t) LEFT JOIN label USING (doc_id)
), counted AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), place AS (
  SELECT filter_order, k AS step, substr(filter_order, k, 1) AS filter, substr(filter_order, 1, k - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), done AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN fails = translate(fails, filter_order[1 : step], '') THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(fails, filter) AND fails = translate(fails, before, '') THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(fails, filter) AND fails <> translate(fails, before, '') THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(fails, filter) AND fails = translate(fails, before, '') THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(fails, filter) AND fails = translate(fails, before, '') THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, place GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM done"""
