"""Katz backoff scoring of any order: Good-Turing discounted counts of all n-grams, exactly normalised backoff weights,
tables by hash range.

    p(w | h) = d(c(hw)) c(hw) / c(h)      if c(hw) > 0, else  alpha(h) p(w | h without its first word)
    p(w)     = d(c(w)) c(w) / N           if c(w) > 0, else the mass that the discounts leave (one unknown word)
    alpha(h) = (1 - sum of seen p(w | h)) / (1 - sum of p(w | h without its first word) over the same w)

A text starts after one end token, so the first token has a context of one token at every order. Where no count of a context
is discounted, no mass is left to back off to; such a context counts one more token in c(h). After a context that the
training texts lack, alpha is 1.

Everything grows with the corpus, so nothing of it is broadcast. Texts become blocks of tokens once. Order by order, a block
asks the shards about its distinct n-grams in one packed row for a shard and gets counts and numbers back in the same order;
an n-gram is then the number of its context (of the order below) and the number of its last word, which pack to a few bytes
where hashes take eight each. Words are numbered by falling count within their shard, so frequent ones have small numbers;
longer n-grams by their place in their shard. An n-gram is asked about if context and word occur in training texts; all of them are kept,
those seen once included. A context so frequent that its shard would be uneven is spread over as many shards as its count
asks for, which every block computes alike from the count of the order below. Sums for backoff weights are whole numbers
(how many continuations have count r, and how many have lower count r), so parts of a spread context add up exactly. The
answered counts stand in tables of the shared folder by order and kind, a row per shard and block, and the last stage evaluates
every token from them; ``keep_tables`` stores the whole count tables besides, a row per shard.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, held_out, materialize, release_caches, release_shuffles, table
from .hashing import mix, word_hashes

BLOCK_TOKENS = 1_250_000
SHARD_TOKENS = 2_000_000
DISCOUNTED = 5
#: key: block or shard; other: the shard or block that answered or asked, or a number of tokens or n-grams.
PACKET = T.StructType([T.StructField("key", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("other", T.LongType()), T.StructField("body", T.BinaryType())])
#: words: ascending hashes of the block's words, read by the first order alone.
BLOCKS = T.StructType([*PACKET.fields, T.StructField("words", T.BinaryType())])
BLOCK, ASK, ANSWER, TABLE, TYPES = range(5)
END = int(word_hashes([b""])[0])
_U = np.uint64


# packing


@lru_cache(maxsize=1)
def codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Made once a process: for small pieces a new context costs more than the work."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, byte plane by byte plane, without the planes that are all zero."""
    x = np.ascontiguousarray(x, dtype="<u8")
    k = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([k]) + codec()[0].compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes())


def unpacked(b: bytes) -> np.ndarray:
    k = b[0]
    planes = np.frombuffer(codec()[1].decompress(b[1:]), dtype=np.uint8).reshape(k, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :k] = planes.T
    return out.view("<i8").reshape(-1)


def packed_rising(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=0))


def unpacked_rising(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b))


def joined(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes() + b"".join(parts)


def split(body: bytes) -> list[bytes]:
    n = int(np.frombuffer(body, dtype="<i8", count=1)[0])
    ends = np.cumsum(np.frombuffer(body, dtype="<i8", count=n + 1)) - n + 8 * (n + 1)
    return [body[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def packed_pairs(w: np.ndarray, h: np.ndarray) -> bytes:
    """Pairs that ascend by word, then context: distinct words, group sizes, and steps of the contexts in a group."""
    first = np.flatnonzero(np.diff(w, prepend=-1))
    steps = np.diff(h, prepend=0)
    steps[first] = h[first]
    return joined(packed_rising(w[first]), packed(np.diff(np.append(first, len(w)))), packed(steps))


def unpacked_pairs(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    words, sizes, steps = split(b)
    words, sizes, h = unpacked_rising(words), unpacked(sizes), unpacked_rising(steps)
    first = np.cumsum(sizes) - sizes
    before = np.concatenate(([0], h))[first]  # the running sum of all steps up to each group
    return np.repeat(words, sizes), h - np.repeat(before, sizes)


def sorting(x: np.ndarray) -> np.ndarray:
    """A stable argsort. Numbers from -1 on that leave room for their place are sorted as one number with it, which is several
    times as fast."""
    bits = len(x).bit_length()
    if not len(x) or int(x.max()) + 1 >= 1 << (63 - bits):
        return np.argsort(x, kind="stable")
    return np.sort(((x + 1) << bits) | np.arange(len(x))) & ((1 << bits) - 1)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct numbers in ascending order, the place of the first of each, the number of each among them)."""
    by = sorting(x)
    ordered = x[by]
    new = np.ones(len(x), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(x), dtype=np.int64)
    place[by] = np.cumsum(new) - 1
    return ordered[new], by[new], place


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def pair_shard(h: np.ndarray, part: np.ndarray, bits: int) -> np.ndarray:
    return shard_of(mix(mix(h.astype(np.uint64) + _U(1)) + part.astype(np.uint64)), bits)


def packets(rows: list[tuple]) -> pa.Table:
    schema = to_arrow_schema(PACKET)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(schema)], schema=schema)


# discounts


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing factors for counts 0 to DISCOUNTED, from the numbers n[r] of types with count r. Where the
    numbers give no factor between 0 and 1, absolute discounting does."""
    d = np.ones(DISCOUNTED + 1)
    k = DISCOUNTED
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    step = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    for r in range(1, k + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        d[r] = x if 0 < x < 1 else max(0.05, 1 - step / r)
    return d


def factor(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, DISCOUNTED)] * (c <= DISCOUNTED) + (c > DISCOUNTED)


def left_over(m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Tokens that the discounts take: m[r - 1] are the numbers of n-grams with count r."""
    return ((1 - d[1:]) * np.arange(1, DISCOUNTED + 1)) @ m


def types_by_count(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]


# blocks


def make_blocks(docs: DataFrame, *, doc_id: str, text: str, folds: int, fold: int, block_tokens: int) -> DataFrame:
    """BLOCKS rows: the body holds the tokens' places among the block's words, and (doc_id, is null, tokens, held out)."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), held_out(F.col(f"`{doc_id}`"), folds, fold).alias("h"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    arrow = to_arrow_schema(BLOCKS)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        hashes: list[np.ndarray] = []
        meta: list[tuple] = []
        size = 0

        def flush():
            nonlocal hashes, meta, size, seq
            words, at = np.unique(np.concatenate(hashes), return_inverse=True)
            m = codec()[0].compress(np.array(meta, dtype="<i8").tobytes())
            end = np.searchsorted(words, _U(END))
            row = ((part << 24) + seq, BLOCK, size, joined(packed(at), m, packed(np.array([len(words), end]))), words.tobytes())
            hashes, meta, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for b in batches:
            for d, h, t in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                words = t.lower().split() if t else []
                words.append(b"")
                if size and size + len(words) > block_tokens:
                    yield flush()
                hashes.append(word_hashes(words))
                meta.append((d or 0, d is None, len(words), h))
                size += len(words)
        if size:
            yield flush()
        release_caches()

    return src.mapInArrow(run, BLOCKS)


class Grams:
    """The distinct n-grams of one order in a block: at has each token's place among them, -1 for none. Once answered:
    count and number (-1 if not in training), with a last entry for place -1, and the sums for the backoff weights of the
    contexts in ``summed``."""

    def __init__(self, at: np.ndarray, size: int):
        self.at, self.size, self.summed = at, size, None

    def answered(self, rows: list[dict], bits: int, numbered: bool = True) -> None:
        """rows: ANSWER packets of this order, by shard. numbered: whether they hold numbers, as all orders but the last do."""
        bodies = [split(r["body"]) for r in rows]
        flagged = np.concatenate([np.zeros(0, dtype=np.int64), *[unpacked(b[0]) for b in bodies]])
        back = np.empty(self.size, dtype=np.int64)
        back[self.order] = flagged
        self.count, self.full = np.append(back >> 1, 0), (back & 1).astype(bool)
        number = np.full(len(back) + 1, -1, dtype=np.int64)
        if numbered:
            seen = self.order[(flagged >> 1) > 0]
            of = unpacked if self.summed is None else unpacked_rising  # words are numbered by count
            number[seen] = np.concatenate([np.zeros(0, dtype=np.int64), *[(of(b[1]) << bits) | r["other"] for r, b in zip(rows, bodies, strict=True)]])
        self.number = number
        if self.summed is not None:
            sums = np.concatenate([np.zeros((2 * DISCOUNTED + 1, 0), dtype=np.int64), *[unpacked(b[2]).reshape(2 * DISCOUNTED + 1, -1) for b in bodies]], axis=1)
            self.sums = np.zeros((len(sums), len(self.summed)), dtype=np.int64)
            for total, part in zip(self.sums, sums, strict=True):
                np.add.at(total, self.part_of[self.part_order], part)


class Block:
    """A block with the answers of the orders so far; last is the model's longest order, whose n-grams have no numbers."""

    def __init__(self, rows: list[dict], bits: int, spread: int, orders: int, last: int):
        own = next(r for r in rows if r["kind"] == BLOCK)
        at, docs, sizes = split(own["body"])
        self.key, self.bits, self.spread = own["key"], bits, spread
        self.words, self.end = unpacked(sizes).tolist()
        self.docs = np.frombuffer(codec()[1].decompress(docs), dtype="<i8").reshape(-1, 4)
        self.starts = np.cumsum(self.docs[:, 2]) - self.docs[:, 2]
        self.train = np.repeat(1 - self.docs[:, 3], self.docs[:, 2])
        words = Grams(unpacked(at), self.words)
        words.order = np.arange(self.words)
        self.grams = [words]
        for order in range(1, orders + 1):
            if order > 1:
                self.grams.append(self.longer())
            self.grams[-1].answered(sorted((r for r in rows if r["kind"] == ANSWER + 10 * order), key=lambda r: r["other"]), bits, order < last)

    def contexts(self, below: Grams) -> np.ndarray:
        """Each token's context as a place among the n-grams below, -1 if it has none or none of the training texts'."""
        h = np.empty_like(below.at)
        h[1:] = below.at[:-1]
        h[self.starts] = self.end if below is self.grams[0] else -1
        return np.where(below.number[h] >= 0, h, -1)

    def longer(self) -> Grams:
        """The n-grams one longer than the last, in the order in which the shards are asked."""
        first, below, bits = self.grams[0], self.grams[-1], self.bits
        h = self.contexts(below)
        token = np.flatnonzero((h >= 0) & (first.number[first.at] >= 0))
        by_number, by_context = sorting(first.number[:-1]), sorting(below.number[:-1])
        rank, context_rank = np.empty_like(by_number), np.empty_like(by_context)
        rank[by_number], context_rank[by_context] = np.arange(len(rank)), np.arange(len(context_rank))
        wide = max(1, below.size).bit_length()
        keys, some, place = distinct((rank[first.at[token]] << wide) | context_rank[h[token]])
        at = np.full(len(h), -1, dtype=np.int64)
        at[token] = place
        g = Grams(at, len(keys))
        g.contexts = h
        g.context, g.word = by_context[keys & ((1 << wide) - 1)], by_number[keys >> wide]
        g.low = below.count[below.at[token[some]]]
        g.trained = np.bincount(place, self.train[token], len(keys)).astype(np.int64)
        parts = below.count // self.spread + 1
        part, of_spread = np.zeros(len(keys), dtype=np.int64), np.flatnonzero(parts[g.context] > 1)
        part[of_spread] = (mix(first.number[g.word[of_spread]].astype(np.uint64)) % parts[g.context[of_spread]].astype(np.uint64)).astype(np.int64)
        g.shard = pair_shard(below.number[g.context], part, bits)
        g.order = sorting(g.shard)  # by shard, word, context
        # sums are asked for contexts of held-out tokens, which may back off, and for spread ones, which no shard sees whole
        asked = np.zeros(below.size, dtype=bool)
        asked[h[(h >= 0) & ((self.train == 0) | (parts[h] > 1))]] = True
        g.summed = np.flatnonzero(asked)
        part_of = np.repeat(np.arange(len(g.summed)), parts[g.summed])
        start = np.cumsum(parts[g.summed]) - parts[g.summed]
        part = np.arange(len(part_of)) - np.repeat(start, parts[g.summed])
        shard = pair_shard(below.number[g.summed][part_of], part, bits)
        once = np.unique((part_of << bits) | shard)  # a shard may hold several parts of a context, and adds them up
        g.part_of, g.part_shard = once >> bits, once & ((1 << bits) - 1)
        g.part_number = below.number[g.summed][g.part_of]
        g.part_order = np.lexsort((g.part_number, g.part_shard))
        return g

    def asks(self) -> list[tuple]:
        first, below, g = self.grams[0], self.grams[-1], self.longer()
        edges = np.arange((1 << self.bits) + 1)
        cuts, part_cuts = np.searchsorted(g.shard[g.order], edges), np.searchsorted(g.part_shard[g.part_order], edges)
        out = []
        for k, (a, b, x, y) in enumerate(zip(cuts[:-1], cuts[1:], part_cuts[:-1], part_cuts[1:], strict=True)):
            if b > a or y > x:
                e, f = g.order[a:b], g.part_order[x:y]
                pairs = packed_pairs(first.number[g.word[e]], below.number[g.context[e]])
                out.append((k, ASK, self.key, joined(pairs, packed(g.trained[e]), packed(g.low[e]), packed_rising(g.part_number[f]))))
        return out

    def scored(self, total: int, types: int, unknown: float, d: list[np.ndarray]) -> list:
        """Columns of the result."""
        words = self.grams[0]
        p = np.where(words.count > 0, factor(words.count, d[0]) * words.count / max(1, total), unknown)[words.at]
        lower_total = np.full(len(p), max(1, total), dtype=np.float64)
        for k, g in enumerate(self.grams[1:], start=1):
            below, h = self.grams[k - 1], g.contexts
            full = np.zeros(below.size + 1, dtype=bool)
            full[g.context] = g.full
            full[g.summed] = g.sums[:DISCOUNTED].sum(axis=0) == 0
            c_h = (below.count + full).astype(np.float64)
            low_h = np.ones(below.size + 1)
            low_h[h[h >= 0]] = lower_total[h >= 0]
            alpha = np.ones(below.size + 1)
            s = g.summed
            mass = np.where(full[s], 1.0, left_over(g.sums[:DISCOUNTED], d[k])) / c_h[s]
            lower = (g.sums[-1] - left_over(g.sums[DISCOUNTED:-1], d[k - 1])) / low_h[s]
            alpha[s] = mass / np.maximum(1 - lower, 1e-12)
            n, total_h = g.count[g.at], np.maximum(c_h[h], 1.0)
            p = np.where(n > 0, factor(n, d[k]) * n / total_h, alpha[h] * p)
            lower_total = total_h
        add = lambda x: np.add.reduceat(x, self.starts)
        base = np.log10((words.count + 1) / (total + types + 1))
        return [
            pa.array(self.docs[:, 0], mask=self.docs[:, 1].astype(bool)),
            self.docs[:, 3].astype(bool),
            self.docs[:, 2],
            add((words.count > 0).astype(np.int64)[words.at]),
            np.full(len(self.docs), total, dtype=np.int64),
            add(base[words.at]),
            add(np.log10(p)),
        ]


# shards


def ask_words(row: dict, bits: int) -> list[tuple]:
    """A block's words, and how often training texts have them, to the shards of their hashes."""
    block = split(row["body"])
    words = np.frombuffer(row["words"], dtype=np.uint64)
    docs = np.frombuffer(codec()[1].decompress(block[1]), dtype="<i8").reshape(-1, 4)
    n = np.bincount(unpacked(block[0]), np.repeat(1 - docs[:, 3], docs[:, 2]), len(words)).astype(np.int64)
    cuts = np.searchsorted(shard_of(words, bits), np.arange((1 << bits) + 1))
    return [(k, ASK, row["key"], joined(words[a:b].tobytes(), packed(n[a:b]))) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def answers(rows: list[dict], sizes: list[int], count: np.ndarray, number: np.ndarray, group: np.ndarray, full: np.ndarray, sums: list[bytes], order: int, numbered: bool) -> list[tuple]:
    """To each block that asked, in its order: counts with the flag of a full context, numbers of what was seen, sums."""
    out, start = [], 0
    for r, n, s in zip(rows, sizes, sums, strict=True):
        at = group[start : start + n]
        own = number[at][count[at] > 0] if numbered else np.zeros(0, dtype=np.int64)
        out.append((r["other"], ANSWER + 10 * order, r["key"], joined(packed(count[at] * 2 + full[start : start + n]), packed(own) if order == 1 else packed_rising(own), s)))
        start += n
    return out


def count_words(rows: list[dict], last: int, keep: bool) -> list[tuple]:
    bodies = [split(r["body"]) for r in rows]
    asked = [np.frombuffer(b[0], dtype=np.uint64) for b in bodies]
    keys, group = np.unique(np.concatenate(asked), return_inverse=True)
    count = np.bincount(group, np.concatenate([unpacked(b[1]) for b in bodies]), len(keys)).astype(np.int64)
    seen = count > 0
    number = np.empty(len(keys), dtype=np.int64)
    number[np.argsort(-count, kind="stable")] = np.arange(len(keys))
    out = answers(rows, [len(a) for a in asked], count, number, group, np.zeros(len(group), dtype=np.int64), [b""] * len(rows), 1, last > 1)
    out.append((rows[0]["key"], TABLE + 10, int(seen.sum()), joined(keys[seen].tobytes(), packed(count[seen]), packed(number[seen])) if keep else b""))
    return [*out, (rows[0]["key"], TYPES, int(count.sum()), types_by_count(count[seen]).astype("<i8").tobytes())]


def count_pairs(rows: list[dict], order: int, last: int, keep: bool) -> list[tuple]:
    bodies = [split(r["body"]) for r in rows]
    pairs = [unpacked_pairs(b[0]) for b in bodies]
    w, h = (np.concatenate([p[k] for p in pairs]) for k in range(2))
    wide = int(h.max(initial=0)) + 1
    one_key = (int(w.max(initial=0)) + 1) * wide < 1 << 63
    by = np.argsort(w * wide + h, kind="stable") if one_key else np.lexsort((h, w))  # sorted runs merge fast
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[by][1:] != w[by][:-1]) | (h[by][1:] != h[by][:-1])
    group = np.empty(len(w), dtype=np.int64)
    group[by] = np.cumsum(new) - 1
    some = by[new]
    count = np.bincount(group, np.concatenate([unpacked(b[1]) for b in bodies]), len(some)).astype(np.int64)
    low = np.concatenate([unpacked(b[2]) for b in bodies])[some]
    seen = count > 0
    # a context's continuations by count and by lower count, and the lower counts' sum
    contexts, place = np.unique(h[some][seen], return_inverse=True)
    sums = np.zeros((2 * DISCOUNTED + 1, len(contexts) + 1), dtype=np.int64)  # the last column: contexts without any
    for k, c in enumerate((count[seen], low[seen])):
        for r in range(1, DISCOUNTED + 1):
            sums[k * DISCOUNTED + r - 1, :-1] = np.bincount(place[c == r], minlength=len(contexts))
    sums[-1, :-1] = np.bincount(place, low[seen], len(contexts))

    def of(asked: np.ndarray) -> np.ndarray:
        at = np.searchsorted(contexts, asked)
        return np.where(np.append(contexts, -1)[at] == asked, at, len(contexts))

    full = (sums[:DISCOUNTED].sum(axis=0) == 0)[of(h[some])].astype(np.int64)[group]
    sent = [packed(sums[:, of(unpacked_rising(b[3]))].reshape(-1)) for b in bodies]
    out = answers(rows, [len(p[0]) for p in pairs], count, np.cumsum(seen) - 1, group, full, sent, order, order < last)
    out.append((rows[0]["key"], TABLE + 10 * order, int(seen.sum()), joined(packed_pairs(w[some][seen], h[some][seen]), packed(count[seen])) if keep else b""))
    return [*out, (rows[0]["key"], TYPES, int(count.sum()), types_by_count(count[seen]).astype("<i8").tobytes())]


def totals(tables: DataFrame) -> tuple[int, int, np.ndarray]:
    """Tokens, types and types by count, added up from a row per shard; one row reaches the driver."""
    schema = T.StructType([T.StructField(f"c{k}", T.LongType()) for k in range(DISCOUNTED + 2)] + [T.StructField("n", T.LongType()), T.StructField("types", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                row = np.zeros(len(arrow), dtype=np.int64)
                if r["kind"] == TYPES:
                    row[: DISCOUNTED + 2], row[-2] = np.frombuffer(r["body"], dtype="<i8"), r["other"]
                else:
                    row[-1] = r["other"]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row.tolist()], schema=arrow)

    small = tables.where((F.col("kind") == TYPES) | (F.col("kind") % 10 == TABLE)).select("kind", "other", F.when(F.col("kind") == TYPES, F.col("body")).alias("body"))
    r = [x or 0 for x in small.mapInArrow(run, schema).agg(*[F.sum(c).alias(c) for c in arrow.names]).first()]
    return r[-2], r[-1], np.array(r[: DISCOUNTED + 2], dtype=np.int64)


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, order: int = 3, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, keep_tables: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per input row.

    A null text is as an empty one: the end token alone. A null id counts as the empty text for the fold. Without training
    rows every word is unknown with probability 1. order: words in the longest n-gram, 1 or more. block_tokens, shard_tokens:
    what a task holds; a context with more than a quarter of shard_tokens is spread over several shards. The
    counts that texts ask for are stored by order, shard and block; keep_tables: whether all counts of each order are stored
    besides, in folders kind=13, kind=23 and so on, a row per shard (about 0.8 times the input).
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    stored = materialize(make_blocks(docs, doc_id=doc_id, text=text, folds=folds, fold=fold, block_tokens=block_tokens), "lm-blocks")
    tokens = stored.agg(F.sum("other")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, tokens / shard_tokens)))))
    spread = max(1, shard_tokens // 4)

    def words(batches):
        for b in batches:
            for r in b.to_pylist():
                yield from packets(ask_words(r, bits)).to_batches()

    def asks(orders):
        return lambda t: packets(Block(t.to_pylist(), bits, spread, orders, order).asks())

    def counts(k):
        return lambda t: packets(count_words(t.to_pylist(), order, keep_tables) if k == 1 else count_pairs(t.to_pylist(), k, order, keep_tables))

    blocks, found, d = None, [], []
    for k in range(1, order + 1):
        asked = stored.mapInArrow(words, PACKET) if k == 1 else blocks.groupBy("key").applyInArrow(asks(k - 1), PACKET)
        found.append(materialize(asked.groupBy("key").applyInArrow(counts(k), PACKET), f"lm-{k}", ["kind"]).select(*PACKET.names))
        n, n_types, by_count = totals(found[-1])
        d.append(discounts(by_count))
        if k == 1:
            total, types = n, n_types
            unknown = max(1e-12, float(left_over(by_count[1 : DISCOUNTED + 1], d[0])) / n) if n else 1.0
            blocks = materialize(stored.select(*PACKET.names), "lm-tokens")  # without the words, which only the first order reads
            discard(stored)
        blocks = blocks.unionByName(found[-1].where(F.col("kind") == ANSWER + 10 * k))
        release_shuffles(docs.sparkSession)  # what the written tables came from

    def run(t: pa.Table) -> pa.Table:
        b = Block(t.to_pylist(), bits, spread, order, order)
        arrow = to_arrow_schema(RESULT)
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in b.scored(total, types, unknown, d)], schema=arrow)

    return blocks.groupBy("key").applyInArrow(run, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
