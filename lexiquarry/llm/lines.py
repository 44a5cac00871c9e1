"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

A line with a word is a position of its document's chain. Its unary potential is the sum of the weights of its bins (how
many words, how long, how many capitals, digits, symbols, marks and repeats, how it starts and ends, whether it is an
earlier line again, where it stands); a two by two table of potentials couples neighbours. Viterbi decoding gives the
most probable labels of the whole document, and the share of its words that stand in content lines decides whether it is
kept.

No line has a label in the data. Fixed rules name the plain cases (``weak_label``) and leave the others open; weights are
trained on a bounded sample by the likelihood of the named labels with the open ones summed out, while bins that the
rules rest on are hidden at random, so that the other bins and the neighbours learn to carry the label.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

BOILERPLATE, CONTENT, OPEN = 0, 1, 2
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_MARKS = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGIT)
_LINE = re.compile(rb"[^\n]+")
#: Words of notices and navigation, in lower case.
_NOTICE = re.compile(rb"copyright|\(c\)|all rights reserved|licen[cs]e|warrant(?:y|ies)|cookie|privacy policy|terms of (?:use|service)|subscribe|sign (?:in|up)|log ?in|click here|javascript|newsletter")
#: Bins: name and upper bounds (exclusive) of a number; the last bin has no bound.
NUMBERS = (
    ("words", (2, 3, 5, 9, 17, 33, 65)),
    ("bytes a word", (2.5, 3.5, 4.5, 6, 8, 12)),
    ("capitals", (1e-9, 0.05, 0.15, 0.3, 0.6)),
    ("digits", (1e-9, 0.05, 0.15, 0.4)),
    ("symbols", (1e-9, 0.02, 0.05, 0.15)),
    ("other marks", (1e-9, 0.03, 0.06, 0.12, 0.25)),
    ("distinct words", (0.2, 0.4, 0.6, 0.8, 1)),
    ("adjacent repeats", (1e-9, 0.1, 0.3)),
    ("words with two marks at the end", (1e-9, 0.05, 0.2)),
    ("notices", (1, 2)),
)
#: Classes: name and number of values.
CLASSES = (("first byte", 6), ("last byte", 6), ("again", 2), ("place", 4))
_SIZES = [len(bounds) + 1 for _, bounds in NUMBERS] + [n for _, n in CLASSES]
_OFFSETS = np.concatenate(([0], np.cumsum(_SIZES)))
WIDTH = int(_OFFSETS[-1])
BINS = len(_SIZES)
_NAMES = [n for n, _ in NUMBERS] + [n for n, _ in CLASSES]
#: Bins that the weak labels rest on.
_HIDDEN = [_NAMES.index(n) for n in ("capitals", "symbols", "distinct words", "notices", "last byte", "again")]
#: Lines whose statistics are held at once.
BLOCK = 20_000


def _byte_class(c: int) -> int:
    """Capital, small letter, digit, beyond ASCII, sentence mark, other."""
    return 0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 if c >= 128 else 4 if c in b".!?;:," else 5


_CLASS = [_byte_class(c) for c in range(256)]


def weak_label(words: int, capitals: float, symbols: float, distinct: float, repeats: float, marked: float, notices: int, again: bool, sentence: bool) -> int:
    """What the rules say of a line: boilerplate when it is an earlier line again, a notice, mostly symbols or marks, mostly
    capitals, or few words over and over; content when it is none of these, has eight words and ends like a sentence."""
    if again or notices > 1 or symbols >= 0.05 or marked >= 0.2 or (capitals >= 0.6 and words > 2) or (words > 5 and (distinct < 0.4 or repeats >= 0.3)):
        return BOILERPLATE
    return CONTENT if words >= 8 and sentence and not notices and symbols == 0 and capitals < 0.15 and distinct >= 0.5 else OPEN


class Lines:
    """Bins of the lines of one text, in blocks, and counts that they share."""

    def __init__(self, text: bytes):
        self.text = text
        self.again = 0

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bins, words, weak labels) of the next lines that have a word."""
        seen: set[bytes] = set()
        rows, place = [], 0
        for m in _LINE.finditer(self.text):
            words = m[0].split()
            if not words:
                continue
            line = m[0]
            again = line in seen
            if again:
                self.again += 1
            else:
                seen.add(line)
            rows.append(self._row(line, words, again, place))
            place += 1
            if len(rows) == BLOCK:
                yield self._bins(rows)
                rows = []
        if rows:
            rows[-1] = (*rows[-1][:-1], 3)
            yield self._bins(rows)

    @staticmethod
    def _row(line: bytes, words: list[bytes], again: bool, place: int) -> tuple:
        n = len(words)
        whole = b"".join(words)
        size = len(whole)
        low, upper = size - len(whole.translate(None, _LOWER)), size - len(whole.translate(None, _UPPER))
        high, digit = size - len(whole.translate(None, _HIGH)), size - len(whole.translate(None, _DIGIT))
        symbols = size - len(whole.translate(None, _SYMBOLS))
        marks = size - low - upper - high - digit
        repeats = sum(a == b for a, b in zip(words, words[1:])) / n  # noqa: B905
        double = sum(len(w) - len(w.rstrip(_MARKS)) > 1 for w in words) / n if marks > n / 20 else 0.0
        return (n, size / n, upper / size, digit / size, symbols / size, (marks - symbols) / size, len({*words}) / n, repeats, double, len(_NOTICE.findall(line.lower())) if low else 0, _CLASS[whole[0]], _CLASS[whole[-1]], again, min(place, 2))

    @staticmethod
    def _bins(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.array(rows, dtype=np.float64)
        bins = np.empty((len(rows), BINS), dtype=np.uint8)
        for k, (_, bounds) in enumerate(NUMBERS):
            bins[:, k] = np.searchsorted(bounds, raw[:, k], side="right")
        bins[:, len(NUMBERS) :] = raw[:, len(NUMBERS) :]
        return bins, raw[:, 0].astype(np.int64), raw

    @staticmethod
    def weak(raw: np.ndarray) -> np.ndarray:
        return np.array([weak_label(r[0], r[2], r[4], r[6], r[7], r[8], int(r[9]), bool(r[12]), r[11] == 4) for r in raw], dtype=np.uint8)


class Chain:
    """Two labels; weights of the content label by bin (boilerplate's are 0) and a table of neighbouring labels."""

    def __init__(self):
        self.weights = np.zeros(WIDTH)
        self.table = np.zeros((2, 2))

    def unary(self, bins: np.ndarray) -> np.ndarray:
        """The content label's score less the boilerplate label's, by line."""
        return self.weights[bins + _OFFSETS[:-1]].sum(1)

    def viterbi(self, unary: np.ndarray) -> np.ndarray:
        """The most probable labels; of equal ones content, at the last line and before each line."""
        if not len(unary):
            return np.zeros(0, dtype=np.uint8)
        (bb, bc), (cb, cc) = self.table.tolist()
        back = bytearray(2 * len(unary))
        b, c = 0.0, float(unary[0])
        for i, u in enumerate(unary[1:].tolist(), 1):
            from_b, from_c = b + bb, c + cb
            to_b, to_c = b + bc, c + cc
            b = from_c if from_c >= from_b else from_b
            back[2 * i] = from_c >= from_b
            c = (to_c if to_c >= to_b else to_b) + u
            back[2 * i + 1] = to_c >= to_b
        out = np.empty(len(unary), dtype=np.uint8)
        now = int(c >= b)
        for i in range(len(unary) - 1, -1, -1):
            out[i] = now
            now = back[2 * i + now]
        return out

    def expectations(self, unary: np.ndarray, allowed: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log partition sum, probability of content by chain and place, expected table) over padded chains.

        unary: chains x places; allowed: chains x places x 2; a label that is not allowed is left out of the sums."""
        chains, places = unary.shape
        inside = np.arange(places) < lengths[:, None]
        score = np.stack((np.zeros_like(unary), unary), 2) + np.where(allowed, 0.0, -1e9)
        alpha, beta = np.empty((chains, places, 2)), np.zeros((chains, places, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, places):
            step = np.logaddexp(alpha[:, t - 1, 0, None] + self.table[0], alpha[:, t - 1, 1, None] + self.table[1]) + score[:, t]
            alpha[:, t] = np.where(inside[:, t, None], step, alpha[:, t - 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(places - 2, -1, -1):
            later = score[:, t + 1] + beta[:, t + 1]
            step = np.logaddexp(self.table[:, 0] + later[:, 0, None], self.table[:, 1] + later[:, 1, None])
            beta[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
        own = alpha + beta - total[:, None, None]
        content = np.where(inside, np.exp(np.minimum(own[:, :, 1], 0)), 0.0)
        pair = alpha[:, :-1, :, None] + self.table + (score + beta)[:, 1:, None, :] - total[:, None, None, None]
        pair = np.where(inside[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0.0)
        return float(total.sum()), content, pair.sum((0, 1))

    def gradients(self, bins: np.ndarray, y: np.ndarray, lengths: np.ndarray, shown: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """(loss, its gradient by weight, by table) of padded chains, a line: minus the log likelihood of the labels that
        y names, the others (OPEN) summed out. shown: which bins count."""
        shown = np.ones(bins.shape, dtype=bool) if shown is None else shown
        at = bins + _OFFSETS[:-1]
        unary = np.where(shown, self.weights[at], 0.0).sum(2)
        free = np.ones((*y.shape, 2), dtype=bool)
        named = np.stack((y != CONTENT, y != BOILERPLATE), 2)
        z_free, p_free, e_free = self.expectations(unary, free, lengths)
        z_named, p_named, e_named = self.expectations(unary, named, lengths)
        n = max(1, int(lengths.sum()))
        by_line = np.where(shown, (p_free - p_named)[:, :, None], 0.0)
        grad = np.bincount(at.ravel(), by_line.ravel(), minlength=WIDTH)
        return (z_free - z_named) / n, grad / n, (e_free - e_named) / n

    def fit(self, chains: list[tuple[np.ndarray, np.ndarray]], steps: int = 400, rate: float = 0.1, decay: float = 1e-4, hide: float = 0.3, seed: int = 3) -> Chain:
        """Adam over all chains at once; without chains every line is content."""
        if not chains:
            self.weights[: _OFFSETS[1]] = 1.0
            return self
        groups = []  # chains of like length together, so that padding stays small
        ordered = sorted(chains, key=lambda c: len(c[1]))
        for s in range(0, len(ordered), 256):
            some = ordered[s : s + 256]
            longest = len(some[-1][1])
            bins, y = np.zeros((len(some), longest, BINS), dtype=np.int64), np.full((len(some), longest), OPEN, dtype=np.uint8)
            for k, (b, labels) in enumerate(some):
                bins[k, : len(labels)], y[k, : len(labels)] = b, labels
            groups.append((bins, y, np.array([len(c[1]) for c in some])))
        rng = np.random.default_rng(seed)
        p = [self.weights, self.table]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        step = 0
        for _ in range(max(1, steps // len(groups))):
            for g in rng.permutation(len(groups)):
                bins, y, lengths = groups[g]
                shown = np.ones(bins.shape, dtype=bool)
                shown[:, :, _HIDDEN] = rng.random((*y.shape, len(_HIDDEN))) >= hide
                step += 1
                for k, grad in enumerate(self.gradients(bins, y, lengths, shown)[1:]):
                    grad = grad + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that the text holds twice or more, the first included."""
    if len(words) < 4:
        return 0
    place: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
    pairs = np.unique(ids[:-1] * len(place) + ids[1:], return_inverse=True)[1]  # numbered anew, so that no product overflows
    _, at, many = np.unique(pairs[:-1] * len(place) + ids[2:], return_inverse=True, return_counts=True)
    often = many[at] > 1
    hit = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        hit[k : k + len(often)] |= often
    return int(hit.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int]:
    """(words, code points in words, symbols, words in repeated windows)."""
    words = text.split()
    points = len(text) - len(text.translate(None, _SPACE + bytes(range(0x80, 0xC0))))
    return len(words), len(text) - points, len(text) - len(text.translate(None, _SYMBOLS)), repeated_words(words)


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_docs: int = 3000, max_lines: int = 60_000, segment: int = 200) -> Chain:
    """Fits on at most max_docs documents, chosen by a hash of doc_id, and max_lines of their lines: of each document one
    run of at most ``segment`` lines, whose place is picked by a hash of the text."""
    order = [F.xxhash64("id", F.lit(29)), F.col("id")]
    some = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("id")).distinct().orderBy(*order).limit(max_docs)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(some), "id")

    def make():
        def one(t: bytes | None) -> tuple[bytes, bytes]:
            total = sum(bool(m[0].split()) for m in _LINE.finditer(t or b""))
            start = int.from_bytes((t or b"")[:64][-4:], "little") % max(1, total - segment + 1)
            bins, labels, at = [], [], 0
            for b, _, raw in Lines(t or b"").blocks():
                i, j = max(0, start - at), min(len(b), start + segment - at)
                if i < j:
                    bins.append(b[i:j])
                    labels.append(Lines.weak(raw[i:j]))
                at += len(b)
            return (np.concatenate(bins).tobytes(), np.concatenate(labels).tobytes()) if bins else (b"", b"")

        def run(texts):
            found = [one(t) for t in texts]
            return [[b for b, _ in found], [y for _, y in found]]

        return run

    got = map_texts(rows, make, [T.StructField("bins", T.BinaryType(), False), T.StructField("y", T.BinaryType(), False)], ["id"])
    chains, total = [], 0
    for r in got.select("row.id", "bins", "y").distinct().orderBy(*order, "bins").toLocalIterator():
        y = np.frombuffer(r.y, dtype=np.uint8)
        if len(y) and total + len(y) <= max_lines:
            chains.append((np.frombuffer(r.bins, dtype=np.uint8).reshape(-1, BINS), y))
            total += len(y)
    return Chain().fit(chains)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "content_lines", "content_words")


def label_lines(docs: DataFrame, chain: Chain, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (columns in keep), the counts in FIELDS and ``labels``: a string with a letter for each line that has a word,
    c for content and b for boilerplate.

    A null text counts as an empty one; both have no words, no lines and no labels. Repeated rows get a row each, and no
    documents give none. Lines are what stands between \\n; one without a word is no position of the chain.
    """

    def make():
        def one(t: bytes | None) -> tuple:
            t = t or b""
            lines = Lines(t)
            unary, words = [], []
            for bins, n, _ in lines.blocks():
                unary.append(chain.unary(bins))
                words.append(n)
            labels = chain.viterbi(np.concatenate(unary) if unary else np.zeros(0))
            content = int(np.concatenate(words)[labels == CONTENT].sum()) if words else 0
            n, chars, symbols, repeated = base_counts(t)
            return n, chars, symbols, lines.again, repeated, len(labels), int(labels.sum()), content, np.where(labels == CONTENT, b"c", b"b").astype("S1").tobytes().decode()

        def run(texts):
            return [list(c) for c in zip(*map(one, texts), strict=True)]

        return run

    fields = [*[T.StructField(f, T.LongType(), False) for f in FIELDS], T.StructField("labels", T.StringType(), False)]
    return map_texts(docs, make, fields, keep, text)


def judge(docs: DataFrame, chain: Chain, *, min_words: int = 50, max_repeated: int = 50, min_content: int = 50, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``label_lines`` with base_failed (fewer than min_words words, or more than max_repeated percent of them in repeated
    windows) and kept: not base_failed and at least min_content percent of the words in content lines. A text without
    words fails."""
    found = label_lines(docs, chain, text=text, keep=keep)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("content_words") >= min_content * F.col("n_words")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judge(docs, train(docs), keep=["doc_id"])
    return found.select("row.doc_id", *FIELDS[:5], "base_failed", "kept", *FIELDS[5:])
