"""Source divergence audit by integer-dictionary encoding.

Terms are counted per (lang, source, term) inside each task before anything is shuffled. A language keeps the terms that
enough of its documents hold. Kept terms are dealt by a hash into chunks, and sources into blocks, so that a chunk of two
blocks has a bounded number of cells. There the kept terms are one array in UTF-8 order, ``searchsorted`` turns terms into
ids, and ``bincount`` makes a dense vector of counts for every source: ids are in the order of terms, so vectors line up and
ties break by id. Probabilities are whole numbers; a pair of sources gets a partial distance per chunk, and their sum is
its distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bound_batches, materialize, table

#: Letters and what is beyond ASCII, capitals in lower case; all other bytes part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct terms that a task counts before it hands them on.
HELD_TERMS = 300_000
#: Cells of a chunk of two blocks: sources times terms.
CELLS = 1 << 16
#: Sources of a block.
BLOCK = 128


def count_terms(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it, in partial sums; null is ''."""
    src = docs.select(*_group(lang, source), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    bound_batches(docs.sparkSession)
    schema = StructType.fromDDL("lang string, source string, term binary, n long, docs long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lg, so), (n, in_docs) in held.items():
                terms = list(n)
                for s in range(0, len(terms), 50_000):
                    some = terms[s : s + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lg] * len(some)), pa.array([so] * len(some)), pa.array(some, pa.binary()), pa.array([n[t] for t in some], pa.int64()), pa.array([in_docs[t] for t in some], pa.int64())],
                        schema=arrow,
                    )
            held.clear()

        size = 0
        for b in batches:
            for lg, so, t in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                terms = t.translate(_FOLD).split() if t else []
                n, in_docs = held.setdefault((lg, so), (Counter(), Counter()))
                size -= len(n)
                n.update(terms)
                in_docs.update({*terms})
                size += len(n)
                if size > HELD_TERMS:
                    yield from rows()
                    size = 0
        yield from rows()

    return src.mapInArrow(run, schema)


def _group(lang: str, source: str) -> list:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]


def kept_terms(docs: DataFrame, min_docs: int, **columns) -> DataFrame:
    """(lang, source, term, n, lang_n, head): counts of the terms in min_docs documents or more of their language, lang_n
    the language's count, head 1 in one row of each (lang, term). One exchange, by language and term, serves the sums and
    the windows; a term has a row per source there, however common it is."""
    counts = count_terms(docs, **columns).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    first = F.row_number().over(whole.orderBy("source")) == 1
    rows = counts.select("lang", "source", "term", "n", F.sum("n").over(whole).alias("lang_n"), F.sum("docs").over(whole).alias("in_docs"), first.cast("int").alias("head"))
    return rows.where(F.col("in_docs") >= min_docs).drop("in_docs")


def probability(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)) by long division, three digits at a time: exact up to totals of
    9 * 10^15."""
    under = total + 5 * kept
    rest, out = count + 5, 0
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, under)
        out = out * 1000 + digit
    return out + 1


def encode(terms: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(kept terms in UTF-8 order, the id of each row's term in it)."""
    coded = terms.combine_chunks().dictionary_encode()
    own = np.empty(len(coded.dictionary), dtype=object)
    own[:] = coded.dictionary.to_pylist()
    kept = np.sort(own)
    return kept, np.searchsorted(kept, own)[coded.indices.to_numpy()]


def _compare(top: int):
    def run(key: tuple, cells: pa.Table, roster: pa.Table) -> pa.Table:
        lang, _, i, j = (k.as_py() for k in key)
        names = roster["source"].to_pylist()
        order = sorted(range(len(names)), key=lambda k: names[k].encode())
        names = [names[k] for k in order]
        totals = roster["total"].to_numpy()[order]
        block = roster["own"].to_numpy()[order]
        v, lang_total, in_chunk = (int(roster[c][0].as_py()) for c in ("v", "lang_total", "in_chunk"))
        kept, ids = encode(cells["term"])
        row = np.fromiter(map({s: k for k, s in enumerate(names)}.__getitem__, cells["source"].to_pylist()), dtype=np.int64, count=len(ids))
        n = cells["n"].to_numpy()
        counts = np.zeros(len(names) * len(kept), dtype=np.int64)
        for half in range(2):  # bincount sums doubles, exact for whole numbers below 2^53
            counts += np.bincount(row * len(kept) + ids, n >> 26 if half else n & ((1 << 26) - 1), len(counts)).astype(np.int64) << (26 * half)
        counts = counts.reshape(len(names), len(kept))
        p = probability(counts, totals[:, None], v)
        none = probability(np.zeros(len(names), dtype=np.int64), totals, v) if v else totals  # of terms that no source here has
        out: dict[str, list] = {c: [] for c in ("source", "part", "item", "value")}

        def add(source: str, part: str, items: list[bytes], values: np.ndarray) -> None:
            out["source"] += [source] * len(items)
            out["part"] += [part] * len(items)
            out["item"] += items
            out["value"] += values.tolist()

        for k in range(len(names)):
            others = np.flatnonzero(block == j) if i != j and block[k] == i else np.arange(k + 1, len(names)) if i == j else []
            if len(others):
                far = np.abs(p[others] - p[k]).sum(1) + (in_chunk - len(kept)) * np.abs(none[others] - none[k])
                add(names[k], "pair", [names[o].encode() for o in others], far)
        if i == j and len(kept):
            lang_n = np.zeros(len(kept), dtype=np.int64)
            lang_n[ids] = cells["lang_n"].to_numpy()
            q = probability(lang_n, lang_total, v)
            for k in range(len(names)):
                more = np.flatnonzero((counts[k] > 0) & (p[k] > q))
                f = p[k][more] - q[more]
                best = np.lexsort((more, -f))[:top]  # by id, and so by UTF-8 order, among equals
                add(names[k], "term", kept[more[best]].tolist(), f[best])
        return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string()), "source": pa.array(out["source"], pa.string()), "part": pa.array(out["part"], pa.string()), "item": pa.array(out["item"], pa.binary()).cast(pa.string()), "value": pa.array(out["value"], pa.int64())})

    return run


def audit(docs: DataFrame, *, min_docs: int = 30, top: int = 50, cells: int = CELLS, block: int = BLOCK, **columns) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other source of the language with the sum of absolute
    differences over all kept terms; part ``term``: the ``top`` terms that a source uses more than its language does.

    Null texts, languages and sources count as ''. A source without terms is compared like the others; a language of one
    source has no pairs, one without kept terms has pairs of value 0 and no terms. Repeated rows are documents each. No
    documents give no rows. Ranks start at 1 in each (lang, source, part), by value descending and then by the UTF-8 order
    of the item. columns: the names of text, lang and source.
    """
    names = {a: columns.get(a, a) for a in ("lang", "source")}
    terms = materialize(kept_terms(docs, min_docs, **columns), "audit-terms")
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*_group(**names)).distinct().join(sums, ["lang", "source"], "left")
    groups = materialize(groups.withColumn("total", F.coalesce("total", F.lit(0)).cast("long")), "audit-groups")
    found = terms.groupBy("lang").agg(F.sum("head").alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("n_sources")).join(found, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    blocks = F.ceil(F.col("n_sources") / block).cast("int")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("v") * F.least("n_sources", F.lit(2 * block)) / cells)).cast("int")
    shape = materialize(langs.select("lang", "lang_total", "v", blocks.alias("blocks"), chunks.alias("chunks")), "audit-langs")

    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("i"), F.greatest(b, F.col("own")).alias("j")))
    key = ["lang", "chunk", "i", "j"]
    dealt = terms.join(shape, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    in_chunk = dealt.groupBy("lang", "chunk").agg(F.sum("head").alias("in_chunk"))
    cells_of = dealt.withColumn("own", own).select("*", F.explode(pairs).alias("at")).select("lang", "chunk", "at.*", "source", "term", "n", "lang_n")
    roster = groups.join(shape, "lang").withColumn("own", own).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    roster = roster.join(in_chunk, ["lang", "chunk"], "left").select("*", F.explode(pairs).alias("at"))
    roster = roster.select("lang", "chunk", "at.*", "source", "total", "own", "v", "lang_total", F.coalesce("in_chunk", F.lit(0)).alias("in_chunk"))
    schema = "lang string, source string, part string, item string, value long"
    parts = materialize(cells_of.groupBy(*key).cogroup(roster.groupBy(*key)).applyInArrow(_compare(top), schema), "audit-parts")

    far = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = far.select("*", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way"))
    both = both.select("lang", "way.source", "part", "way.item", "value")
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return both.withColumn("rank", best).unionByName(parts.where("part = 'term'").withColumn("rank", best).where(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), w AS (SELECT k, lang, source, unnest(w) AS term FROM d
), kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30
), sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), grp AS (SELECT DISTINCT lang, source FROM d
), counted AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), total AS (SELECT lang, source, sum(n) AS n FROM counted GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * v) AS p
  FROM grp g JOIN kept USING (lang) JOIN sizes USING (lang) LEFT JOIN total t USING (lang, source) LEFT JOIN counted c USING (lang, source, term)
), of_lang AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(t) + 5 * any_value(v)) AS q
  FROM counted JOIN (SELECT lang, sum(n) AS t FROM counted GROUP BY lang) USING (lang) JOIN sizes USING (lang) GROUP BY lang, term
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN of_lang USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
