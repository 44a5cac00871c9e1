"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ``window`` consecutive item words is a pattern; the alphabet is words, a block is the last few words of
the search window. A shift table says how far the window can move when its last block ends no pattern; where the shift
is 0, a bucket for that block lists the patterns, a prefix selects among them and direct comparison confirms. Items with
fewer words are one pattern each, searched with tables of their own length.

Documents are read in a single map without a shuffle. Items are shipped as text, at most ``block_words`` words of them
(size checked), and each task builds its tables, about a kilobyte a word. A larger benchmark takes a map for each block,
written before the next one begins, so the driver holds one block at a time and a benchmark of any size works.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_texts, materialize

#: Word bytes are 0-9, a-z (after lower-casing A-Z) and everything above 7F; all others separate words.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


class Tables:
    """Shift and bucket tables of patterns that all have m words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]], m: int, block: int):
        self.m, self.block = m, min(block, m)
        self.default = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[tuple[bytes, ...], tuple[int, ...]]]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.default), m - end)
            last = p[m - self.block :]
            self.buckets.setdefault(last, defaultdict(list))[p[0]].append((p, tuple(sorted(items))))

    def scan(self, words: list[bytes], spans: list[tuple[int, int]], items: set[int]) -> None:
        m, block, default, shift, buckets, n = self.m, self.block, self.default, self.shift.get, self.buckets, len(words)
        i = m
        while i <= n:
            key = tuple(words[i - block : i])
            step = shift(key, default)
            if step:
                i += step
                continue
            start = i - m
            for p, own in buckets[key].get(words[start], ()):
                if tuple(words[start:i]) == p:
                    spans.append((start, i))
                    items.update(own)
            i += 1


def build(items: list[tuple[int, bytes | None]], window: int, block: int) -> list[Tables]:
    """items: (index, text)."""
    by_len: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for k, text in items:
        w = tuple(words_of(text))
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            by_len[m][w[s : s + m]].add(k)
    return [Tables(p, m, block) for m, p in sorted(by_len.items())]


def covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int):
    """Yields lists of (item id as text or None, text), each of at most block_words words or one item."""
    rows, size = [], 0
    cols = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("binary").alias("t")).distinct()
    for r in cols.toLocalIterator():
        n = len(words_of(bytes(r.t))) if r.t is not None else 0
        if rows and size + n > block_words:
            yield rows
            rows, size = [], 0
        rows.append((r.i, bytes(r.t) if r.t is not None else None))
        size += n
    yield rows


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    window: int = 13,
    block: int = 3,
    min_share: float = 0.05,
    block_words: int = 150_000,
) -> DataFrame:
    """One row per document: ``row`` (columns in keep), n_words, n_hit, n_items, items (ids as sorted text), spans
    (merged later; pairs of word positions) and contaminated (n_hit > 0 and n_hit >= min_share * n_words).

    Null, empty and wordless texts have no words and are never contaminated; a null or wordless item has no window.
    Repeated documents give a row each; repeated items count once. An item with a null id still hits words but is
    listed nowhere. An empty benchmark hits nothing.
    """
    per_hit = round(1 / min_share)
    names = docs.columns if keep is None else keep
    fields = [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("n_items", T.LongType(), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField("spans", T.BinaryType(), False),
        T.StructField("contaminated", T.BooleanType(), False),
    ]

    def search(rows, rest: bool, before: DataFrame | None) -> DataFrame:
        ids = [i for i, _ in rows]

        def make():
            tables = build([(j, t) for j, (_, t) in enumerate(rows)], window, block)

            def run(texts, before_spans=None, before_items=None):
                cols: list[list] = [[], [], [], [], [], []]
                for n, t in enumerate(texts):
                    words = words_of(t)
                    spans = list(struct.iter_unpack("<qq", before_spans[n] if before_spans else b""))
                    found: set[int] = set()
                    for x in tables:
                        x.scan(words, spans, found)
                    items = {ids[j] for j in found if ids[j] is not None} | set(before_items[n] if before_items else ())
                    n_hit = covered(spans)
                    for c, v in zip(cols, (len(words), n_hit, len(items), sorted(items), b"".join(struct.pack("<qq", *s) for s in spans), n_hit > 0 and per_hit * n_hit >= len(words)), strict=True):
                        c.append(v)
                return cols

            return run

        if before is None:
            return map_texts(docs, make, fields, [*dict.fromkeys([*names, text])] if rest else names, text)
        carried = [c for c in before.schema["row"].dataType.names if rest or c in names]
        again = before.select("row", *[F.col("row")[c].alias(f"c{k}") for k, c in enumerate(carried)], F.col("row")[text].alias("t"), "spans", "items")
        found = map_texts(again, make, fields, [f"c{k}" for k in range(len(carried))], "t", {"spans": F.col("spans"), "items": F.col("items")})
        return found.withColumn("row", F.struct(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(carried)]))

    blocks = _blocks(benchmark, item_id, item_text, block_words)
    rows, last = next(blocks), None
    while (later := next(blocks, None)) is not None:
        before, last = last, materialize(search(rows, True, last), "benchmark-hits")
        if before is not None:
            discard(before)
        rows = later
    return search(rows, False, last)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    r = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return r.select("row.doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
