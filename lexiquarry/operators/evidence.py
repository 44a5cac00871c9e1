"""Matching tables, cells and body text."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import bound_batches


def best_match(left: DataFrame, right: DataFrame, skip_same: bool = False) -> DataFrame:
    """left, right: (k, g: array of distinct grams). Each left row with the right row of the largest Jaccard similarity, the lowest
    key of equals; rows meet on grams, so pairs without a common one are never made."""
    a = left.select(F.col("k").alias("a"), F.size("g").alias("na"), F.explode("g").alias("x"))
    b = right.select(F.col("k").alias("b"), F.size("g").alias("nb"), F.explode("g").alias("x"))
    pairs = a.join(b, "x")
    if skip_same:
        pairs = pairs.where("a <> b")
    both = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("i"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    both = both.withColumn("score", F.col("i") / (F.col("na") + F.col("nb") - F.col("i")))
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where("rn = 1").select("a", "b", F.round("score", 4).alias("score"))


def neighbors(rows: DataFrame, by: str, page: str, order: Sequence[Column], n: int, reach: int) -> DataFrame:
    """The n best pages of each document and the pages within reach of them."""
    best = rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= n)
    return best.select(by, F.explode(F.sequence(F.col(page) - reach, F.col(page) + reach)).alias(page)).where(F.col(page) >= 0).distinct()


def cells(tables: DataFrame, key: str, rows: str) -> DataFrame:
    """A row per cell that is not blank, with the numbers of its row and column."""
    r = tables.select(key, F.posexplode(rows).alias("row_id", "r"))
    return r.select(key, "row_id", F.posexplode("r").alias("col_id", "value_text")).where(F.trim("value_text") != "")


def row_summary(rows: DataFrame, by: str, order: Sequence[Column], cell: Column, separator: str = " | ") -> DataFrame:
    names = [f"o{i}" for i in range(len(order))]
    s = F.struct(*[o.alias(n) for o, n in zip(order, names, strict=True)], cell.alias("cell"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["cell"]), separator).alias("summary"))


def pair_bodies(pairs: DataFrame, by: Sequence[str], body: str, methods: Sequence[tuple[str, Column]]) -> DataFrame:
    """The best body of each table under each method, and of these the one with the largest score; the earlier method and then the
    first body of equals. Scores of 0 or none find nothing."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.lit(n).alias("method"), c.cast("double").alias("score")) for i, (n, c) in enumerate(methods)]))
    rows = pairs.select(*by, body, each.alias("e")).select(*by, body, "e.*").where("score > 0")
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "m", body))
    return rows.withColumn("rn", best).where("rn = 1").select(*by, body, "method", "score")


def query_tokens(parent: Column, structural: Column, tokenize, least: int = 3, most: int = 18) -> Column:
    """Distinct tokens of a table's parent text; with fewer than ``least``, the first ``most`` of its own text as well."""
    own = F.array_distinct(tokenize(F.coalesce(parent, F.lit(""))))
    return F.when(F.size(own) >= least, own).otherwise(F.array_union(own, F.slice(tokenize(F.coalesce(structural, F.lit(""))), 1, most)))


def shared(left: DataFrame, right: DataFrame, by: Sequence[str], a: str, b: str, items: str) -> DataFrame:
    """(by, a, b, common): how many items, of an array of distinct ones on both sides, a row of the left shares with one of the
    right in the same document. Rows meet on items, so pairs without a common one are never made."""
    x = left.select(*by, a, F.explode(items).alias("x"))
    return x.join(right.select(*by, b, F.explode(items).alias("x")), [*by, "x"]).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("common"))


def nearby_body(tables: DataFrame, bodies: DataFrame, by: Sequence[str], key: str, body: str, tokenize, bonus: float = 0.2, chars: int = 1500) -> DataFrame:
    """tables: (by, key, parent, structural); bodies: (by, body, text). The body that holds the largest share of a table's query
    tokens, with a bonus if it names the parent; one without a common token is none."""
    t = tables.select(*by, key, "parent", query_tokens(F.col("parent"), F.col("structural"), tokenize).alias("q"))
    b = bodies.select(*by, body, F.array_distinct(tokenize(F.col("text"))).alias("q"))
    met = shared(t, b, by, key, body, "q").join(t.select(*by, key, "parent", F.size("q").alias("n")), [*by, key]).join(bodies.select(*by, body, F.col("text").alias("body_text")), [*by, body])
    named = (F.coalesce("parent", F.lit("")) != "") & F.col("body_text").contains(F.col("parent"))
    rows = met.withColumn("score", F.round(F.col("common") / F.col("n") + F.when(named, bonus).otherwise(0.0), 6))
    rn = F.row_number().over(Window.partitionBy(*by, key).orderBy(F.desc("score"), body))
    return rows.withColumn("rn", rn).where("rn = 1").select(*by, key, body, "score", F.substring("body_text", 1, chars).alias("text"))


#: Rows of a document that meet as one block, and items that a matrix of theirs holds at once.
BLOCK, WIDE = 256, 4096
#: Scores that differ by more are not equal when rounded to four digits.
CLOSE = 2e-4


def blocks(rows: DataFrame, by: Sequence[str], key: str, name: str, keep: Column) -> DataFrame:
    """(by, name_block, name): the rows of each document that are kept, in order of key, at most ``BLOCK`` in a row."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    dealt = rows.withColumn(f"{name}_block", F.floor((place - 1) / BLOCK)).where(keep)  # asked here, grams are made once
    row = F.struct(key, *[c for c in rows.columns if c not in (*by, key)])
    return dealt.groupBy(*by, f"{name}_block").agg(F.array_sort(F.collect_list(row)).alias(name))


def in_common(left: np.ndarray, left_row: np.ndarray, right: np.ndarray, right_row: np.ndarray, shape: tuple[int, int], place: np.ndarray) -> np.ndarray:
    """How many items each row of the left shares with each of the right. place: -1 for each item, and so again afterwards."""
    out = np.zeros(shape, dtype=np.float32)
    every = np.unique(left)
    for s in range(0, len(every), WIDE):
        items = every[s : s + WIDE]
        place[items] = np.arange(len(items))
        sides = []
        for item, row, n in ((left, left_row, shape[0]), (right, right_row, shape[1])):
            at = place[item]
            m = np.zeros((n, len(items)), dtype=np.float32)
            m[row[at >= 0], at[at >= 0]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
        place[items] = -1
    return out.astype(np.int64)


class Items:
    """Lists of both sides as whole numbers, equal ones for equal items; nulls are none."""

    def __init__(self, left: pa.Array, right: pa.Array):
        values = pa.chunked_array([left.flatten(), right.flatten()]).combine_chunks().dictionary_encode()
        self.item = values.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.place = np.full(len(values.dictionary) + 1, -1, dtype=np.int64)
        sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (left, right)]
        self.ends = [np.concatenate(([0], np.cumsum(n))) for n in sizes]
        self.ends[1] += self.ends[0][-1]

    def part(self, side: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items, their rows, their places in all lists of the side) of rows a to b."""
        ends = self.ends[side]
        item, row = self.item[ends[a] : ends[b]], np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        known = item >= 0
        return item[known], row[known], np.flatnonzero(known) + ends[a] - (self.ends[1][0] if side else 0)

    def common(self, a: tuple[int, int], b: tuple[int, int]) -> np.ndarray:
        x, y = self.part(0, *a), self.part(1, *b)
        return in_common(*x[:2], *y[:2], (a[1] - a[0], b[1] - b[0]), self.place)


def candidates(tables: dict[str, pa.Array], regions: dict[str, pa.Array], spans: Sequence[tuple[tuple[int, int], tuple[int, int]]]) -> list[np.ndarray]:
    """(place in spans, table, region, both, words, na, nb, page) of each pair that can be a table's best among the regions of a span:
    those whose score, not yet rounded, is as good as the largest, and of equal scores the first region's."""
    grams, words = Items(tables["grams"], regions["grams"]), Items(tables["parents"], regions["tokens"])
    one = pa.array(np.arange(len(regions["page"]) + 1), type=pa.int32())
    pages = Items(tables["pages"], pa.ListArray.from_arrays(one, regions["page"]))
    scores = tables["scores"].flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    own = regions["region_score"].to_numpy(zero_copy_only=False) * 0.1
    size = [np.diff(e) for e in grams.ends]
    out = []
    for n, (a, b) in enumerate(spans):
        both, named = grams.common(a, b), words.common(a, b)
        page = np.zeros(both.shape)
        item, row, at = pages.part(0, *a)
        on, where, _ = pages.part(1, *b)
        for k, i, v in zip(item.tolist(), row.tolist(), scores[at].tolist(), strict=True):
            page[i, where[on == k]] = v
        score = both / (size[0][a[0] : a[1], None] + size[1][b[0] : b[1]] - both) + page * 0.35 + np.minimum(0.25, named * 0.03) + own[b[0] : b[1]]
        score[np.isnan(score)] = np.inf  # Spark's largest
        i, j = np.nonzero(score >= score.max(1, keepdims=True) - CLOSE)
        order = np.lexsort((j, score[i, j], i))
        i, j = i[order], j[order]
        v = score[i, j]
        new = np.concatenate(([True], (i[1:] != i[:-1]) | (v[1:] != v[:-1])))
        i, j = i[new], j[new]
        out.append((np.full(len(i), n), i + a[0], j + b[0], both[i, j], named[i, j], size[0][i + a[0]], size[1][j + b[0]], page[i, j]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def match_regions(tables: DataFrame, regions: DataFrame, by: Sequence[str], key: str, region: str) -> DataFrame:
    """tables: (by, key, grams, parent_tokens, page_scores map<page, score>); regions: (by, region, page, grams, tokens, region_score).
    The region with the largest sum of Jaccard similarity, 0.35 of the page's score, 0.03 a common token (0.25 at most) and a
    tenth of its own score.

    Tables and regions of a document meet in blocks, as matrices, and only what can be a table's best in its block is kept, so no
    row is made for a pair. A row is moved once; where a document has more than a block, pairs of blocks are dealt out again."""
    by, spark = list(by), tables.sparkSession
    bound_batches(spark)
    page_type = regions.schema["page"].dataType
    t = tables.select(*by, F.col(key).alias("key"), "grams", F.col("parent_tokens").alias("parents"), F.map_keys("page_scores").cast(T.ArrayType(page_type)).alias("pages"), F.map_values("page_scores").cast("array<double>").alias("scores"))
    r = regions.select(*by, F.col(region).alias("region"), "page", "grams", "tokens", F.col("region_score").cast("double").alias("region_score"))
    met = blocks(t, by, "key", "tables", F.col("key").isNotNull() & F.col("grams").isNotNull())
    met = met.join(blocks(r, by, "region", "regions", F.col("region").isNotNull() & F.col("region_score").isNotNull() & (F.size("grams") > 0)), by)
    most = [df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0 for df in (tables, regions)]
    if max(most) > BLOCK:
        met = met.repartition(*by, "tables_block", "regions_block")
    kinds = {"both": "long", "words": "long", "na": "long", "nb": "long", "page": "double"}
    schema = T.StructType([*[tables.schema[c] for c in by], T.StructField("key", t.schema["key"].dataType), T.StructField("region", r.schema["region"].dataType), T.StructField("region_score", T.DoubleType()), *[T.StructField(c, T.LongType() if k == "long" else T.DoubleType()) for c, k in kinds.items()]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            sides, ends = [], []
            for name in ("tables", "regions"):
                rows = batch.column(name)
                flat = rows.flatten()
                sides.append(dict(zip([f.name for f in flat.type], flat.flatten(), strict=True)))
                ends.append(np.concatenate(([0], np.cumsum(pc.list_value_length(rows).to_numpy(zero_copy_only=False)))).tolist())
            if not batch.num_rows:
                continue
            n, i, j, *numbers = candidates(*sides, [((a, b), (c, d)) for a, b, c, d in zip(ends[0], ends[0][1:], ends[1], ends[1][1:])])  # noqa: B905
            cols = [batch.column(c).take(pa.array(n)) for c in by] + [sides[0]["key"].take(pa.array(i)), sides[1]["region"].take(pa.array(j)), sides[1]["region_score"].take(pa.array(j)), *[pa.array(x) for x in numbers]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    found = met.select(*by, "tables", "regions").mapInArrow(run, schema)
    named = F.least(F.lit(0.25), F.col("words") * 0.03)
    score = F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) + F.col("page") * 0.35 + named + F.col("region_score") * 0.1
    # four digits of the binary value, as DuckDB rounds; Spark's round would take its decimal name
    rows = found.withColumn("score", F.round(score * 10000, 0) / 10000).where("score > 0")
    rn = F.row_number().over(Window.partitionBy(*by, "key").orderBy(F.desc("score"), "region"))
    return rows.withColumn("rn", rn).where("rn = 1").select(*by, F.col("key").alias(key), F.col("region").alias(region), "score")


def score_pages(tables: DataFrame, pages: DataFrame, by: str, key: str, page: str, tokenize, *, least: float = 0.35, bonus: float = 0.2, most: int = 16) -> DataFrame:
    """(by, key, page, score) of the pages of a table's document that reach ``least``: the share of its query tokens that the page
    holds, with a bonus if the page names the parent text. tables: (by, key, parent, structural); pages: (by, page, text).
    Tokens of a page are an inverted list; a page without a common token is none."""
    t = tables.select(by, key, "parent", query_tokens(F.col("parent"), F.col("structural"), tokenize, most=most).alias("q"))
    p = pages.select(by, page, F.array_distinct(tokenize(F.coalesce("text", F.lit("")))).alias("q"))
    met = shared(t, p, [by], key, page, "q").join(t.select(by, key, "parent", F.size("q").alias("n")), [by, key])
    # a page's text is asked for only where the bonus can matter
    texts = pages.select(by, page, F.coalesce("text", F.lit("")).alias("page_text"))
    near = met.where(F.col("common") / F.col("n") + bonus >= least).join(texts, [by, page])
    named = (F.coalesce("parent", F.lit("")) != "") & F.col("page_text").contains(F.col("parent"))
    return near.select(by, key, page, F.round(F.col("common") / F.col("n") + F.when(named, bonus).otherwise(0.0), 6).alias("score")).where(F.col("score") >= least)


def target_pages(scored: DataFrame, pages: DataFrame, by: str, key: str, page: str, *, n: int = 2, reach: int = 1, default: int = 8) -> DataFrame:
    """(by, page): the n best pages of each table and those within reach of them, from page 1 to the document's last; of a document
    without any, its first ``default`` pages. pages are numbered from 1."""
    best = F.row_number().over(Window.partitionBy(by, key).orderBy(F.desc("score"), page))
    chosen = scored.withColumn("rn", best).where(F.col("rn") <= n)
    last = pages.groupBy(by).agg(F.max(page).alias("last"))
    around = chosen.join(last, by).select(by, F.explode(F.sequence(F.greatest(F.lit(1), F.col(page) - reach), F.least("last", F.col(page) + reach))).alias(page)).distinct()
    none = last.join(scored.select(by).distinct(), by, "left_anti")
    return around.unionByName(none.select(by, F.explode(F.sequence(F.lit(1).cast("long"), F.least("last", F.lit(default)).cast("long"))).alias(page)))


def evidence_source(score: Column, region: Column, html: Column) -> Column:
    """struct(source, confidence): a region match, else an HTML match, else the structural text."""
    source = F.when(region, "region").when(html, "html").otherwise("structural")
    sure = F.when(region, F.least(F.lit(0.95), F.greatest(F.lit(0.5), score))).when(html, 0.5).otherwise(0.25)
    return F.struct(source.alias("source"), F.round(sure, 4).alias("confidence"))
