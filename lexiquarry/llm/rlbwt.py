"""Removal of long repeated byte strings with run-length compressed Burrows-Wheeler indexes.

1. Equal texts become one class; a text of ``least`` bytes with a copy is removed whole.
2. Winnowing: of every ``least - gram + 1`` consecutive grams of ``gram`` bytes the one with the smallest hash is an anchor, so
   two equal strings of ``least`` bytes hold the same anchor at the same place. Anchors that occur once in the corpus
   drop out. The reach of an anchor, which holds every string of ``least`` bytes around it, is a piece.
3. Equal pieces of an anchor (128 bits of a cryptographic hash) become one class. A piece with a copy is removed whole;
   what is left to find are matches between different pieces of an anchor, so one piece of each class is kept.
4. A task indexes the pieces of some anchors, neighbouring ones together: suffixes sorted to depth ``DEPTH``, their
   Burrows-Wheeler transform cut into runs. Longest matches are computed at the sampled run ends (and every ``SAMPLE``
   places of the text) only; inside a run the matching statistic falls by one from place to place, so one pass over the
   text streams it to all the others. Places with a match of ``least`` bytes mark what is removed.
5. An anchor whose different pieces exceed ``anchor_bytes`` goes through steps 2 to 4 again with longer grams: its pieces
   get shorter, more of them are equal, and they are dealt to more anchors. The last grams are whole strings of ``least``
   bytes, whose pieces are all equal; so every anchor ends up small enough.

Whole texts move three times: to meet their pieces, the pieces to be indexed, and what is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, map_texts, materialize, table
from .hashing import mix

LEAST, GRAM = 400, 200
SAMPLE, DEPTH = 64, 512
#: An index holds this many bytes, or one anchor; it needs about 100 bytes of memory for each.
TASK_BYTES = 1_500_000
ANCHOR_BYTES = 2_000_000
#: Anchors whose first piece lies in the same stretch of one text are neighbours.
TILE = 4096
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def window_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of ``size`` bytes."""
    n = len(b)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[b] * _power(n, _BASE, "up"), out=total[1:])
    return mix((total[size:] - total[: n - size + 1]) * _power(n - size + 1, _INVERSE, "down"))


def anchors(b: np.ndarray, least: int, gram: int) -> np.ndarray:
    """Rows (hash, first place, last place): each value that is the minimum of consecutive windows of grams."""
    h, w = window_hashes(b, gram), least - gram + 1
    if len(h) < w:
        return np.zeros((0, 3), dtype=np.int64)
    blocks = -(-len(h) // w)
    pad = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[: len(h)] = h
    r = pad.reshape(blocks, w)
    ahead = np.minimum.accumulate(r, axis=1).reshape(-1)
    back = np.minimum.accumulate(r[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = np.minimum(back[: len(h) - w + 1], ahead[w - 1 : len(h)])
    begin = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    end = np.append(begin[1:], len(m)) - 1
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    first, last = np.empty(len(begin), dtype=np.int64), np.empty(len(begin), dtype=np.int64)
    for s in range(0, len(begin), 2000):
        x, y, v = begin[s : s + 2000], end[s : s + 2000], m[begin[s : s + 2000], None]
        first[s : s + 2000] = x + (view[x] == v).argmax(1)
        last[s : s + 2000] = y + w - 1 - (view[y][:, ::-1] == v).argmax(1)
    return np.stack((m[begin].view(np.int64), first, last), axis=1)


def suffix_order(symbols: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` symbols (a power of two, 8 at least); left: symbols to the end of the segment.
    A suffix that ends sooner comes before those it starts."""
    n = len(symbols)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(7):
        key <<= _U(9)
        key[: n - k] |= np.where(left[: n - k] > k, symbols[k:].astype(np.uint64) + _U(1), _U(0))
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([1], key[1:] != key[:-1])))
    del order, key
    seen = 7
    while seen < depth:
        step = min(seen, depth - seen)
        key = rank * (n + 1)
        key[: n - step] += np.where(left[: n - step] > step, rank[step:], 0)
        # only places whose rank is shared can still change
        count = np.bincount(rank)
        tied = np.flatnonzero(count[rank] > 1)
        if not len(tied):
            break
        by = tied[np.argsort(key[tied], kind="stable")]
        k = key[by]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        base = rank[by]
        group = np.concatenate(([True], base[1:] != base[:-1]))
        place = np.arange(len(by))
        start = np.maximum.accumulate(np.where(group, place, 0))
        at_new = np.maximum.accumulate(np.where(new, place, 0))
        # ranks are made sparse: a rank is the number of suffixes before its group, plus one
        if seen == 7:
            first = np.cumsum(count) - count
            rank = first[rank] + 1
            base = rank[by]
        rank[by] = base + at_new - start
        seen += step
    return np.argsort(rank, kind="stable")


def match_lengths(symbols: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common symbols from places a and b on, at most depth and within their segments."""
    out = np.zeros(len(a), dtype=np.int64)
    go = np.arange(len(a))
    most = np.minimum(np.minimum(left[a], left[b]), depth)
    padded = np.concatenate((symbols, np.zeros(depth + 64, dtype=symbols.dtype)))
    view = np.lib.stride_tricks.sliding_window_view(padded, 64)
    for d in range(0, depth, 64):
        differ = view[a[go] + d] != view[b[go] + d]
        some = differ.any(1)
        out[go] = d + np.where(some, differ.argmax(1), 64)
        go = go[~some]
        if not len(go):
            break
    return np.minimum(out, most)


def repeated_places(segments: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """For each segment, where a string of ``least`` bytes starts that starts elsewhere in the segments too."""
    depth = 1 << max(3, (least + SAMPLE).bit_length())
    symbols = np.frombuffer(b"".join(segments), dtype=np.uint8)
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = len(symbols)
    if not n:
        return [np.zeros(0, dtype=np.int64) for _ in segments]
    left = (np.repeat(ends, sizes) - np.arange(n)).astype(np.int32)
    order = suffix_order(symbols, left, depth)
    # the transform: the symbol before each suffix; a segment's start has a symbol of its own
    before = np.empty(n, dtype=np.int32)
    before[1:] = symbols[:-1]
    before[starts[sizes > 0]] = 256 + np.arange((sizes > 0).sum())
    bwt = before[order]
    head = np.concatenate(([True], bwt[1:] != bwt[:-1]))
    tail = np.append(head[1:], True)
    sampled = head | tail | (order % SAMPLE == 0)
    sampled &= left[order] >= least
    del before, bwt, head, tail
    k = np.flatnonzero(sampled)
    best = np.zeros(n, dtype=np.int64)
    for s in range(0, len(k), 20_000):
        own = k[s : s + 20_000]
        for other in (np.maximum(own - 1, 0), np.minimum(own + 1, n - 1)):
            m = np.where(other != own, match_lengths(symbols, left, order[own], order[other], depth), 0)
            np.maximum.at(best, order[own], m)
    reach = np.where(best > 0, best + np.arange(n), 0)
    stat = np.maximum.accumulate(reach) - np.arange(n)
    hit = stat >= least
    return [np.flatnonzero(hit[a:b]) for a, b in zip(starts, ends, strict=True)]


def spans_of(places: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs covered by windows that start at the places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > least) + 1
    return [(int(p[0]), int(p[-1]) + least) for p in np.split(places, cut)]


def merged(spans) -> list[list[int]]:
    """Spans (from, to) in order, those that touch joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


PLACE = T.StructType([T.StructField("hash", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
SPANS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))
#: Equal pieces of a text: the first at bytes from..to around an anchor, ``copies`` in all, which cover spans and hold the anchor
#: ``times`` times. A text whose bytes come round and round has few rows, however long it is.
PIECE = T.StructType([T.StructField("hash", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("node", T.BinaryType()), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("copies", T.IntegerType()), T.StructField("times", T.IntegerType()), T.StructField("spans", SPANS)])
CUT = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("from", T.IntegerType()), T.StructField("bytes", T.BinaryType())])
FOUND = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])
KEPT = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("removed", T.LongType()), T.StructField("spans", T.LongType()), T.StructField("kept", T.StringType())])


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(arrow)], schema=arrow)


def _map(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """fn: the values of a row to a list of rows."""

    def run(batches):
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                yield _batch(fn(*row), schema)

    return df.mapInArrow(run, schema)


def piece(text: bytes, first: int, last: int, least: int, reach: int) -> tuple[bytes, int, int]:
    """(content, from, to) of the piece around the anchor at first..last."""
    a, b = max(0, first - reach), min(len(text), last + least)
    return hashlib.blake2b(text[a:b], digest_size=16).digest(), a, b


def grouped(node: bytes, found) -> list[tuple]:
    """Rows of PIECE from a text's pieces (hash, content, from, to, times)."""
    own: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
    for h, content, a, b, times in found:
        own.setdefault((h, content), []).append((a, b, times))
    return [(h, content, node, *min(p)[:2], len(p), sum(x[2] for x in p), [{"from": a, "to": b} for a, b in merged(x[:2] for x in p)]) for (h, content), p in own.items()]


def first_pieces(texts: DataFrame, least: int, reach: int) -> DataFrame:
    """Pieces around the places (hash, first, last) that each text is wanted for."""

    def rows(node, wanted, text):
        out = []
        for w in wanted:
            content, a, b = piece(text, w["first"], w["last"], least, reach)
            out.append((w["hash"], content, a, b, 1 + (w["first"] != w["last"])))
        return grouped(node, out)

    return _map(texts.select("node", "wanted", F.col("text").cast("binary")), rows, PIECE)


def finer_pieces(hot: DataFrame, texts: DataFrame, least: int, reach: int) -> DataFrame:
    """Pieces of the next level, from the bytes that the hot anchors' pieces cover."""

    def rows(node, regions, text):
        out = []
        for a, b in merged((r["from"], r["to"]) for r in regions):
            part = text[a:b]
            for h, first, last in anchors(np.frombuffer(part, dtype=np.uint8), least, least - reach).tolist():
                content, x, y = piece(part, first, last, least, reach)
                out.append((h, content, a + x, a + y, 1 + (first != last)))
        return grouped(node, out)

    regions = hot.groupBy("node").agg(F.collect_list(F.struct("from", "to")).alias("regions"))  # at most one an anchor of a text
    return _map(texts.join(regions, "node").select("node", "regions", F.col("text").cast("binary")), rows, PIECE).distinct()


def indexed(ask: DataFrame, texts: DataFrame, total: int, least: int, task_bytes: int) -> DataFrame:
    """Spans of repeated strings among the pieces (key, node, from, to) of each key."""

    def cut(node, wanted, text):
        own: dict[int, list[tuple[int, int]]] = {}
        for w in wanted:
            own.setdefault(w["key"], []).append((w["from"], w["to"]))
        return [(key, node, a, text[a:b]) for key, spans in own.items() for a, b in merged(spans)]

    wanted = ask.groupBy("node").agg(F.collect_list(F.struct("key", "from", "to")).alias("wanted"))  # at most one an anchor of a text
    cuts = _map(texts.join(wanted, "node").select("node", wanted["wanted"], F.col("text").cast("binary")), cut, CUT)
    bins = max(1, -(-total // task_bytes))

    def index(t: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        parts: list[tuple[bytes, int, bytes]] = []
        size, last = 0, None

        def flush() -> None:
            owner: list[bytes] = []
            start: list[int] = []
            data: list[bytes] = []
            for i, s, b in sorted(parts):
                if owner and owner[-1] == i and s <= start[-1] + len(data[-1]):  # one text's overlapping parts are one
                    data[-1] += b[max(0, start[-1] + len(data[-1]) - s) :]
                else:
                    owner.append(i)
                    start.append(s)
                    data.append(b)
            rows.extend((o, s + x, s + y) for o, s, p in zip(owner, start, repeated_places(data, least), strict=True) for x, y in spans_of(p, least))
            parts.clear()

        # an index holds all pieces of a key, and no more keys than task_bytes
        for key, i, s, b in sorted(zip(*[t.column(c).to_pylist() for c in ("key", "node", "from", "bytes")], strict=True)):
            if key != last and size + len(b) > task_bytes and parts:
                flush()
                size = 0
            parts.append((i, s, b))
            size, last = size + len(b), key
        if parts:
            flush()
        return pa.Table.from_batches([_batch(rows, FOUND)])

    return cuts.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins))).groupBy("bin").applyInArrow(index, FOUND)


def level(pieces: DataFrame, texts: DataFrame, least: int, reach: int, task_bytes: int, anchor_bytes: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Spans that the pieces of one level show to be repeated, and the pieces of anchors that are too large for an index."""
    classes = pieces.groupBy("hash", "content").agg(F.sum("copies").alias("copies"), F.sum("times").alias("times"), F.min(F.struct("node", "from", "to")).alias("one"))
    classes = materialize(classes, "repeat-classes")
    twice = F.col("copies") > 1 if reach else F.col("times") > 1
    covered = pieces.join(classes.where(twice).select("hash", "content"), ["hash", "content"]).select("node", F.explode("spans").alias("s")).select("node", "s.*")
    covered = materialize(covered, "repeat-covered")
    if not reach:  # a piece is its gram
        return [covered], None
    size = F.col("one.to") - F.col("one.from")
    each = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("copies") == 1).cast("int")).alias("single"), F.max((F.col("times") > F.col("copies")).cast("int")).alias("again"), F.sum(size).cast("long").alias("bytes"), F.min("one").alias("one"))
    each = each.where("single > 0 and (k > 1 or again > 0)")
    tile = each.select("hash", "bytes", F.xxhash64("one.node", F.floor(F.col("one.from") / TILE)).alias("tile"))
    tiles = tile.groupBy("tile").agg(F.sum("bytes").alias("tile_bytes"))
    keyed = tile.join(tiles, "tile").select("hash", (F.col("bytes") > anchor_bytes).alias("hot"), F.when(F.col("tile_bytes") <= anchor_bytes, F.col("tile")).otherwise(F.xxhash64("hash", F.lit(1))).alias("key"))
    # written, so that no aggregate binds the join to hash and a frequent anchor's classes can be dealt to several tasks
    keyed = materialize(keyed, "repeat-keyed")
    ask = materialize(classes.join(keyed, "hash").select("key", "hot", "one.*"), "repeat-ask")
    discard(keyed)
    sums = {r["hot"]: r["n"] for r in ask.groupBy("hot").agg(F.sum(F.col("to") - F.col("from")).alias("n")).collect()}
    found = [covered]
    if sums.get(False):
        found.append(materialize(indexed(ask.where("not hot"), texts, sums[False], least, task_bytes), "repeat-found"))
    discard(classes)
    return found, ask.where("hot") if sums.get(True) else None


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, task_bytes: int = TASK_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row per input row.

    A null text has no bytes. Texts shorter than ``least`` keep all. Equal texts of ``least`` bytes or more are removed whole. Rows
    are told apart by their text, so repeated and null ids are no obstacle. No documents give no rows.
    """
    reach = least - gram

    def make():
        def run(texts):
            cols = [[], [], []]
            for t in texts:
                t = t or b""
                a = anchors(np.frombuffer(t, dtype=np.uint8), least, gram) if len(t) >= least else np.zeros((0, 3), dtype=np.int64)
                for c, v in zip(cols, (len(t), hashlib.sha256(t).hexdigest(), a[:, 0].tobytes() + a[:, 1:].astype(np.int32).tobytes()), strict=True):
                    c.append(v)
            return cols

        return run

    rows = map_texts(docs, make, [T.StructField("n", T.LongType(), False), T.StructField("sha", T.StringType(), False), T.StructField("anchors", T.BinaryType(), False)], [doc_id], text)
    rows = materialize(rows.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "n", "sha", "anchors"), "repeat-anchors")
    classes = rows.where(F.col("n") >= least).groupBy("sha").agg(F.first("anchors").alias("anchors"))
    node = F.unhex(F.substring("sha", 1, 32))  # half of a SHA-256 names a text
    place_arrow = to_arrow_schema(PLACE)

    def explode(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            n = np.array([len(x) // 16 for x in raw], dtype=np.int64)
            hashes = [np.frombuffer(x, dtype=np.int64, count=k) for x, k in zip(raw, n, strict=True)]
            at = [np.frombuffer(x, dtype=np.int32, offset=8 * k).reshape(-1, 2) for x, k in zip(raw, n, strict=True)]
            if n.sum():
                at = np.concatenate(at)
                cols = [pa.array(np.concatenate(hashes)), b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(at[:, 0]), pa.array(at[:, 1])]
                yield pa.RecordBatch.from_arrays(cols, schema=place_arrow)

    places = classes.select(node.alias("node"), "anchors").mapInArrow(explode, PLACE)
    often = places.groupBy("hash").agg(F.sum(F.when(F.col("first") == F.col("last"), 1).otherwise(2)).alias("times")).where("times > 1").select("hash")
    wanted = places.join(often, "hash").groupBy("node").agg(F.collect_list(F.struct("hash", "first", "last")).alias("wanted"))  # at most the anchors of a text
    # one row for each class: the text is found by its digest, among its copies by the least id
    chosen = rows.where(F.col("n") >= least).groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select(node.alias("node"), F.col("doc_id").alias("chosen"))
    wanted = wanted.join(chosen, "node")
    body = F.col(f"`{text}`").cast("string")
    named = docs.where(F.octet_length(body) >= least).select(F.unhex(F.substring(F.sha2(body.cast("binary"), 256), 1, 32)).alias("node"), F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"))
    texts = named.join(wanted, (named["node"] == wanted["node"]) & named["doc_id"].eqNullSafe(wanted["chosen"])).select(named["node"], "wanted", "text")
    texts = materialize(texts, "repeat-texts")
    pieces = materialize(first_pieces(texts, least, reach), "repeat-pieces")
    texts = texts.select("node", "text")
    found: list[DataFrame] = []
    while True:
        spans, hot = level(pieces, texts, least, reach, task_bytes, anchor_bytes)
        found += spans
        discard(pieces)
        if hot is None:
            break
        reach //= 8
        pieces = materialize(finer_pieces(hot, texts, least, reach), "repeat-pieces")

    def apply(batches):
        for b in batches:
            out = []
            for i, spans, t in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                gone = merged((s["from"], s["to"]) for s in spans)
                kept, at = hashlib.sha256(), 0
                for x, y in gone:
                    kept.update(t[at:x])
                    at = y
                kept.update(t[at:])
                out.append((i, sum(y - x for x, y in gone), len(gone), kept.hexdigest()))
            yield _batch(out, KEPT)

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    spans = every.groupBy("node").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    done = texts.join(spans, "node").select("node", "spans", F.col("text").cast("binary").alias("text")).mapInArrow(apply, KEPT)
    state = rows.where(F.col("n") >= least).groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).withColumn("node", node)
    state = state.join(done.dropDuplicates(["node"]), "node", "left").select("sha", "copies", "removed", "spans", "kept")
    twice = F.coalesce(F.col("copies") > 1, F.lit(False))
    return (
        rows.select("doc_id", "n", "sha")
        .join(state, "sha", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_bytes"),
            F.when(twice, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(twice, F.lit(1)).otherwise(F.coalesce(state["spans"], F.lit(0))).cast("long").alias("n_spans"),
            F.when(twice, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
