"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

1. Every text is tokenized once (Arrow map; a bounded per-process cache of words makes the tokenizer see a word once) and
   its ids are kept as a table in the shared folder.
2. Ids are counted over the whole corpus; rank 0 is the most frequent. The rank table has a row per vocabulary entry,
   so its size is bounded by the tokenizer and it may be shipped to every task.
3. Documents are dealt to ranges of doc_id and sorted; each task packs its ranks into blocks: one control byte for four
   values (two bits each: bytes used, less one) and a data part with 1 to 4 bytes a value.
4. The files are read back: a 256-row table turns control bytes into lengths, a gather turns data into ranks and a table
   lookup turns ranks into ids.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_texts, materialize, table

END_ID = 2
#: Bytes that a process remembers of words, and of their letters alone, in each of two generations.
CACHE_BYTES = 48 << 20
#: What a remembered word costs besides its bytes and its ids.
_ENTRY = 180
TOKENS_A_TASK = 8_000_000
TOKENS_A_BLOCK = 1_000_000
PARTS_A_GROUP = 4096
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Bounded(dict):
    """A cache of at most twice CACHE_BYTES: one that is full becomes the old one, and what is asked for again comes back
    from there, so that frequent words stay."""

    size = 0
    old: dict[bytes, bytes] = {}

    def keep(self, key: bytes, value: bytes) -> bytes:
        self.size += len(key) + len(value) + _ENTRY
        if self.size > CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.size = len(key) + len(value) + _ENTRY
        self[key] = value
        return value

    def find(self, key: bytes) -> bytes | None:
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value


class _Words(_Bounded):
    """Ids by word; a word that is not there is encoded and kept."""

    def __init__(self, encoder: WordEncoder):
        self.encoder = encoder

    def __missing__(self, w: bytes) -> bytes:
        ids = self.old.get(w)
        return self.keep(w, self.encoder.word(w) if ids is None else ids)


class WordEncoder:
    """Token ids of whole texts, as bytes.

    With a tokenizer that drops white space, words are encoded apart from each other; a word's trailing ASCII
    punctuation is apart from its letters as well. Where neither holds (independent_words is found to be false), whole
    texts go to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        one = lambda s: self.t.encode(s, add_special_tokens=False).ids
        self.independent = one("ab,\n c d") == one("ab") + one(",") + one("c") + one("d")
        self.size = self.t.get_vocab_size()
        self.words = _Words(self)
        self.heads, self.tails = _Bounded(), _Bounded()

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.t.encode(text, add_special_tokens=False).ids)

    def word(self, w: bytes) -> bytes:
        """Ids of a lower-cased word. Letters are one pre-token, apart from trailing punctuation; ASCII letters need no
        normalization and go to the model at once; what is neither goes to the tokenizer as it is."""
        head = w if w.isalpha() else w.rstrip(_PUNCTUATION)
        ids = self.heads.find(head)
        if ids is None:
            if head.isalpha():
                ids = self._pack([x.id for x in self.t.model.tokenize(head.decode())])
            elif head and (s := head.decode()).isalpha() and s.lower().isalpha():
                ids = self._whole(s)
            else:
                return self._whole(w.decode())
            self.heads.keep(head, ids)
        return ids + self._tail(w[len(head) :]) if len(head) < len(w) else ids

    def _tail(self, marks: bytes) -> bytes:
        ids = self.tails.find(marks)
        if ids is None:
            ids = self.tails.keep(marks, self._whole(marks.decode()) if marks else b"")
        return ids

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.independent:
            return [self._pack(e.ids) for e in self.t.encode_batch_fast([(t or b"").decode() for t in texts], add_special_tokens=False)]
        get = self.words.__getitem__
        # a text that may hold a special token keeps its case and goes to the tokenizer whole
        return [self._whole(t.decode()) if t and b"<|" in t else b"".join(map(get, t.lower().split())) if t else b"" for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python process, so that its cache outlives a task."""
    return WordEncoder(path)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data)."""
    v = values.astype("<u4")
    lengths = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    codes[: len(v)] = lengths - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenize(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, ids binary, n_tokens). A null text is as an empty one: the end id alone."""
    path = tokenizer or default_tokenizer()

    def make():
        enc = encoder(path)
        end = enc._pack([] if end_id is None else [end_id])

        def run(texts):
            ids = [x + end for x in enc.encode(texts)]
            return [ids, [len(x) // enc.dtype.itemsize for x in ids]]

        return run

    out = map_texts(docs, make, [T.StructField("ids", T.BinaryType(), False), T.StructField("n_tokens", T.LongType(), False)], [doc_id], text)
    return out.select(F.col(f"row.{doc_id}").alias("doc_id"), "ids", "n_tokens")


def rank_table(tokens: DataFrame, tokenizer: str | None = None) -> np.ndarray:
    """Ids in order of falling frequency (ties: the lower id first), all of the vocabulary."""
    path = tokenizer or default_tokenizer()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        total = np.zeros(enc.size, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=enc.dtype), minlength=len(total))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], schema=arrow)

    counts = tokens.select("ids").mapInArrow(count, schema).groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(encoder(path).size, dtype=np.int64)
    n[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    return np.lexsort((np.arange(len(n)), -n)).astype(np.uint32)


BLOCK = T.StructType(
    [
        T.StructField("part", T.IntegerType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("doc_ids", T.ArrayType(T.LongType()), False),
        T.StructField("lengths", T.ArrayType(T.LongType()), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("control", T.BinaryType(), False),
        T.StructField("data", T.BinaryType(), False),
    ]
)


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = END_ID) -> tuple[DataFrame, np.ndarray]:
    """Writes the blocks in ascending doc_id order; returns the table of blocks, read back, and the rank table."""
    path = tokenizer or default_tokenizer()
    tokens = materialize(tokenize(docs, doc_id=doc_id, text=text, tokenizer=path, end_id=end_id), "token-ids")
    order = rank_table(tokens, path)
    rank_of = np.empty(len(order), dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // TOKENS_A_TASK))
    arrow = to_arrow_schema(BLOCK)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, part, seq = encoder(path).dtype, TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        size = 0

        def flush():
            nonlocal ids, doc_ids, size, seq
            control, data = pack(rank_of[np.frombuffer(b"".join(ids), dtype=dtype)])
            row = [part, seq, doc_ids, [len(x) // dtype.itemsize for x in ids], size, control, data]
            ids, doc_ids, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(x) // dtype.itemsize
                if ids and size + n > TOKENS_A_BLOCK:
                    yield flush()
                ids.append(x)
                doc_ids.append(d)
                size += n
        if ids:
            yield flush()

    # rows of one id, or without one, are dealt on by their tokens, equal ones by where they are stored
    order_by = ["doc_id", "tie", "row"]
    dealt = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = dealt.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by).select("doc_id", "ids")
    return materialize(dealt.mapInArrow(blocks, BLOCK), "token-blocks"), order


def decode(blocks: DataFrame, order: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<long>, ids_crc32) of each document, from the blocks alone."""
    schema = T.StructType([T.StructField(c, T.LongType(), c == "doc_id") for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = order[unpack(r["control"], r["data"], r["n_tokens"])].astype("<u4")
                cuts = np.cumsum([0, *r["lengths"]])
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (r["doc_ids"], cuts[:-1] + r["before"], r["lengths"], crc)], schema=arrow)

    # prefix sums by block, task and group of tasks: no window holds more than one group, or a row per group
    group = (F.col("part") / PARTS_A_GROUP).cast("int").alias("group")

    def running(df: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)))

    sizes = blocks.select(group, "part", "seq", F.col("n_tokens").alias("n"))
    parts = sizes.groupBy("group", "part").agg(F.sum("n").alias("n"))
    groups = running(parts.groupBy("group").agg(F.sum("n").alias("n")), [], "group", "g").drop("n")
    parts = running(parts, ["group"], "part", "p").drop("n", "group")
    starts = running(sizes, ["part"], "seq", "b").join(parts, "part").join(groups, "group").select("part", "seq", (F.col("b") + F.col("p") + F.col("g")).alias("before"))
    return blocks.join(starts, ["part", "seq"]).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


def token_output(docs: DataFrame, **options) -> DataFrame:
    """Encodes, writes, reads back: (doc_id, start, n_tokens, ids_crc32). Documents with one id follow each other in the
    order of a hash of their tokens; a null doc_id comes first; one that is no integer is an error. No documents give
    no rows."""
    blocks, order = encode(docs, **options)
    return decode(blocks, order)
