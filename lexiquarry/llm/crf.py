"""Personal data by a skip-chain conditional random field.

Base spans come from fixed patterns. The field then looks at every marked word (one with a digit, an @, or an at or dot
in brackets; all others are "none" by the model's domain, so that a chain through them comes to a unary term): unary
potentials from the word's shape and from the words on both sides, whatever they are, chain potentials between adjacent
marked words, and skip potentials between words of one document that are equal or have the same shape, however far
apart. Loopy belief propagation over a document's graph gives marginals that agree across repeated and similar words;
runs of words with a confident label that pass the kind's check are added to the base spans.

Occurrences of a word are linked each to the next one, so a document's graph has at most three edges a word and a long
document costs in proportion to its length. Weights are trained here by pseudo-likelihood on the base labels of at most
``max_docs`` documents and ``max_nodes`` words; marks that the base patterns depend on are hidden at random, so that
shape, neighbours and agreement have to carry the label.
"""

from __future__ import annotations

import re
import zlib
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The contract's pattern; starting at the first digit of a run and never giving digits back keeps it linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_MARK = re.compile(r"[0-9@]")
#: Words of the field: marks, and those of an address that is written out.
_NODE = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]", re.I)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "!\"#$%&'*,-./:;<=>?@[\\]^_`{|}~"
#: Possessive, as no part can be read in two ways: linear in the word.
_FAR_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?:@|\[at\]|\(at\))[A-Za-z0-9-]++(?:(?:\.|\[dot\]|\(dot\))[A-Za-z0-9-]++)++", re.I)
_FAR_IP = re.compile(r"([0-9]+)(?:\.|\[\.\])([0-9]+)(?:\.|\[\.\])([0-9]+)(?:\.|\[\.\])([0-9]+)")
_PHONE_CHARS = re.compile(r"[0-9().+/-]+")
_CARD_CHARS = re.compile(r"[0-9./-]+")


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if not _MARK.search(text):
        return out
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


#: Unary features of a word.
FEATURES = ("bias", "at", "dot", "plus", "bracket", "hyphen", "only digits", "phone characters", "1-3 digits", "4-6 digits", "7-8 digits", "9-12 digits", "13-19 digits", "more digits", "3 dots", "letters", "far email", "far ip", "luhn", "marked before", "marked after", "hyphen after 3 digits")
#: Buckets of the words before and after a word, by a hash of their letters and digits in lower case; 0 is none.
CONTEXT = 48
WIDTH = len(FEATURES) + 2 * CONTEXT
_PLAIN = re.compile(r"[^0-9a-z\x80-\U0010FFFF]+")
#: Features that the base patterns rest on; hidden at random while training.
_HIDDEN = [FEATURES.index(f) for f in ("plus", "at", "luhn")]


def context(word: str | None) -> int:
    """The bucket of a neighbouring word; digits count as one another."""
    core = re.sub(r"[0-9]", "9", _PLAIN.sub("", word.lower())) if word else ""
    return 1 + zlib.crc32(core.encode()) % (CONTEXT - 1) if core else 0


def nodes(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(word number, start, end, features, allowed kinds, weak label, word, shape) of each marked word."""
    out = []
    before = -2
    k = 0
    ordered = sorted((a, b, kind) for kind, a, b in spans)
    previous, word, waiting = None, None, None
    for number, m in enumerate(_WORD.finditer(text)):
        previous, word = word, m[0]
        w = word
        if waiting is not None:  # the node just before learns of this word
            out[-1][3][waiting] = 0.0
            out[-1][3][waiting + context(word)] = 1.0
            waiting = None
        if not _NODE.search(w):
            continue
        core = w.lstrip(_EDGE)
        start = m.end() - len(core)
        core = core.rstrip(_EDGE)
        if not core:
            continue
        end = start + len(core)
        digits = _NOT_DIGIT.sub("", core)
        n = len(digits)
        phone, card = bool(_PHONE_CHARS.fullmatch(core)), bool(_CARD_CHARS.fullmatch(core))
        email, ip = _FAR_EMAIL.fullmatch(core), _FAR_IP.fullmatch(core)
        ip = ip and all(map(_byte, ip.groups()))
        x = (1, "@" in core, "." in core, "+" in core, "(" in core, "-" in core, core.isdigit(), phone, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19, core.count(".") == 3, any(c.isalpha() for c in core), bool(email), bool(ip), 13 <= n <= 19 and luhn(digits), before == number - 1, 0, bool(re.match(r"[0-9]{3}-[0-9]{4}", core)))
        if before == number - 1 and out:
            out[-1][3][FEATURES.index("marked after")] = 1
        before = number
        while k < len(ordered) and ordered[k][1] <= start:
            k += 1
        label = ordered[k][2] + 1 if k < len(ordered) and ordered[k][0] < end else 0
        allowed = (True, bool(email) or label == 1, bool(ip) or label == 2, card and n <= 19 or label == 3, phone and n <= 15 or label == 4)
        around = [0.0] * (2 * CONTEXT)
        around[context(previous)] = around[CONTEXT] = 1.0
        waiting = len(FEATURES) + CONTEXT
        out.append((number, start, end, [*map(float, x), *around], allowed, label, core.lower(), re.sub(r"[0-9]", "9", re.sub(r"[a-z]+", "a", core.lower()))))
    return out


def links(graph: list[tuple], offset: int = 0) -> list[tuple[int, int, int]]:
    """(i, j, type): 0 adjacent words, 1 the same word, 2 the same shape; each to the next such word."""
    out = []
    last: dict[tuple[int, str], int] = {}
    for i, g in enumerate(graph):
        if i and graph[i - 1][0] == g[0] - 1:
            out.append((offset + i - 1, offset + i, 0))
        for kind, key in ((1, g[6]), (2, g[7])):
            j = last.get((kind, key))
            if j is not None and (kind == 1 or graph[j][6] != g[6]):
                out.append((offset + j, offset + i, kind))
            last[kind, key] = i
    return out


class Field:
    LABELS = 1 + len(KINDS)

    def __init__(self):
        n = self.LABELS
        self.unary = np.zeros((WIDTH, n))
        self.chain = np.zeros((n, n))
        self.skip = np.zeros(2)

    def _pots(self) -> np.ndarray:
        eye = np.eye(self.LABELS)
        return np.stack((self.chain, eye * self.skip[0], eye * self.skip[1]))

    def fit(self, x: np.ndarray, allowed: np.ndarray, edges: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-3, seed: int = 3) -> Field:
        """Pseudo-likelihood: each label given its neighbours' labels; Adam on the whole sample."""
        if not len(y):
            self.unary[0, 0] = 5.0
            return self
        n, hot, rng = self.LABELS, np.eye(self.LABELS)[y], np.random.default_rng(seed)
        barred = np.where(allowed, 0.0, -1e9)
        i, j, kind = edges.T if len(edges) else np.zeros((3, 0), dtype=np.int64)
        left, right, same = np.zeros((len(y), n)), np.zeros((len(y), n)), np.zeros((2, len(y), n))
        np.add.at(left, j[kind == 0], hot[i[kind == 0]])
        np.add.at(right, i[kind == 0], hot[j[kind == 0]])
        for k in (1, 2):
            np.add.at(same[k - 1], j[kind == k], hot[i[kind == k]])
            np.add.at(same[k - 1], i[kind == k], hot[j[kind == k]])
        p = [self.unary, self.chain, self.skip]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        for t in range(1, steps + 1):
            shown = x.copy()
            for f in _HIDDEN:
                shown[rng.random(len(y)) < 0.3, f] = 0
            z = shown @ p[0] + left @ p[1] + right @ p[1].T + p[2][0] * same[0] + p[2][1] * same[1] + barred
            z -= z.max(1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(1, keepdims=True)
            d = (q - hot) / len(y)
            grads = [shown.T @ d, left.T @ d + (right.T @ d).T, np.array([(d * same[0]).sum(), (d * same[1]).sum()])]
            for k, g in enumerate(grads):
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.unary, self.chain, self.skip = p[0], p[1], np.maximum(p[2], 0.0)
        return self

    def marginals(self, x: np.ndarray, allowed: np.ndarray, edges: np.ndarray, graph: np.ndarray | None = None, rounds: int = 300, per_node: int = 8) -> np.ndarray:
        """Loopy belief propagation, damped, over all graphs of a batch at once; graph: the number of each node's graph. A graph
        stops when none of its own messages changes any more, so its marginals do not depend on the others. One that still
        moves after ``rounds``, or ``per_node`` for each of its nodes if that is more, has loops that do not settle: its
        marginals are those of ``mean_field``, which always does."""
        unary = x @ self.unary + np.where(allowed, 0.0, -1e9)
        moving, beliefs = np.zeros(0, dtype=np.int64), None
        if len(edges):
            pots = self._pots()
            i, j, kind = edges.T
            src, dst = np.concatenate((i, j)), np.concatenate((j, i))
            pot = np.concatenate((pots[kind], pots[kind].transpose(0, 2, 1)))
            back = np.concatenate((np.arange(len(i)) + len(i), np.arange(len(i))))
            of = np.zeros(len(x), dtype=np.int64) if graph is None else graph
            own = of[src]
            most = np.maximum(rounds, per_node * np.bincount(of))
            msg = np.zeros((len(src), self.LABELS))
            go = np.arange(len(src))
            for k in count(1):
                belief = unary.copy()
                np.add.at(belief, dst, msg)
                out = (belief[src[go]] - msg[back[go]])[:, :, None] + pot[go]
                top = out.max(1, keepdims=True)
                new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                change = np.zeros(int(own.max()) + 1)
                np.maximum.at(change, own[go], np.abs(new - msg[go]).max(1))
                msg[go] = 0.5 * msg[go] + 0.5 * new
                go = go[change[own[go]] >= 1e-4]
                late = k >= most[own[go]]
                moving = np.union1d(moving, own[go[late]])
                go = go[~late]
                if not len(go):
                    break
            beliefs = unary.copy()
            np.add.at(beliefs, dst, msg)
        p = _softmax(unary if beliefs is None else beliefs)
        if len(moving):
            for g in moving:
                node = np.flatnonzero(of == g)
                inside = of[i] == g
                place = np.full(len(x), -1)
                place[node] = np.arange(len(node))
                p[node] = self.mean_field(unary[node], np.stack((place[i[inside]], place[j[inside]], kind[inside]), 1), p[node])
        return p

    def mean_field(self, unary: np.ndarray, edges: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Node by node, each label distribution given its neighbours': every step lowers the distance to the field, so this ends
        in any graph. q: where to start."""
        pots, near = self._pots(), [[] for _ in unary]
        for i, j, kind in edges.tolist():
            near[i].append((j, pots[kind]))
            near[j].append((i, pots[kind].T))
        q = q.copy()
        while True:
            change = 0.0
            for i, around in enumerate(near):
                new = _softmax((unary[i] + sum((pot @ q[j] for j, pot in around), np.zeros(self.LABELS)))[None])[0]
                change = max(change, float(np.abs(new - q[i]).max()))
                q[i] = new
            if change < 1e-6:
                return q


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def check(kind: int, piece: str) -> bool:
    """What a span of this kind must hold, apart from how it is written."""
    digits = _NOT_DIGIT.sub("", piece)
    if kind == 0:
        return bool(_FAR_EMAIL.fullmatch(piece))
    if kind == 1:
        m = _FAR_IP.fullmatch(piece)
        return bool(m) and all(map(_byte, m.groups()))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and ("(" in piece or "-" in piece or "+" in piece)


def added(text: str, base: list[tuple[int, int, int]], graph: list[tuple], p: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """Runs of adjacent words with one confident label that pass its check and touch no base span."""
    out, k, t = [], 0, 0
    kinds = np.where(p.max(1) >= least, p.argmax(1), 0)
    taken = [tuple(x) for x in _joined((a, b) for _, a, b in base)]
    while k < len(graph):
        kind, end = int(kinds[k]), k + 1
        if kind > 1 and kind != 2:  # addresses are single words
            while end < len(graph) and kinds[end] == kind and graph[end][0] == graph[end - 1][0] + 1:
                end += 1
        a, b = graph[k][1], graph[end - 1][2]
        while t < len(taken) and taken[t][1] <= a:  # both run through the text once
            t += 1
        if kind and check(kind - 1, text[a:b]) and not (t < len(taken) and taken[t][0] < b):
            out.append((kind - 1, a, b))
        k = end
    return out


def _joined(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_docs: int = 3000, max_nodes: int = 40_000) -> Field:
    """Fits on at most max_docs documents with marked words, chosen by a hash of doc_id, and max_nodes of their words."""
    order = [F.xxhash64("id", F.lit(23)), F.col("id")]
    some = docs.where(F.col(f"`{text}`").rlike(r"[0-9@]")).select(F.col(f"`{doc_id}`").alias("id")).distinct().orderBy(*order).limit(max_docs)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(some), "id")

    def make():
        def run(texts):
            cols = [[], [], [], []]
            for t in texts:
                s = (t or b"").decode()
                g = [n for n in nodes(s, base_spans(s)) if n[5] or not n[4][1]]  # the base says nothing about a written-out address
                x = np.array([n[3] for n in g], dtype=np.float32).reshape(-1, WIDTH)
                for c, v in zip(cols, (x, np.array([n[4] for n in g], dtype=np.uint8), np.array([n[5] for n in g], dtype=np.int32), np.array(links(g), dtype=np.int32)), strict=True):
                    c.append(v.tobytes())
            return cols

        return run

    fields = [T.StructField(c, T.BinaryType(), False) for c in ("x", "allowed", "y", "edges")]
    got = map_texts(rows, make, fields, ["id"]).select("row.id", "x", "allowed", "y", "edges").distinct().orderBy(*order, "x")
    parts, total = [[], [], [], []], 0
    for r in got.toLocalIterator():
        x = np.frombuffer(r.x, dtype=np.float32).reshape(-1, WIDTH)
        if total + len(x) > max_nodes or not len(x):
            continue
        e = np.frombuffer(r.edges, dtype=np.int32).reshape(-1, 3).astype(np.int64)
        for c, v in zip(parts, (x, np.frombuffer(r.allowed, dtype=np.uint8).reshape(-1, Field.LABELS).astype(bool), np.frombuffer(r.y, dtype=np.int32), e + np.array([total, total, 0])), strict=True):
            c.append(v)
        total += len(x)
    if not total:
        return Field().fit(np.zeros((0, WIDTH)), np.zeros((0, Field.LABELS), bool), np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
    return Field().fit(*[np.concatenate(parts[k]) for k in (0, 1, 3, 2)])


def find(docs: DataFrame, field: Field, *, text: str = "text", keep: list[str] | None = None, least: float = 0.9) -> DataFrame:
    """``row`` (columns in keep), base and extra: arrays of struct<kind, start, end> in code points, end exclusive, by
    kind and then start. Null and empty texts have none; repeated rows get a row each."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    def make():
        def run(texts):
            strings = [(t or b"").decode() for t in texts]
            base = [base_spans(s) for s in strings]
            graphs = [nodes(s, b) if _NODE.search(s) else [] for s, b in zip(strings, base, strict=True)]
            extra: list[list] = [[] for _ in texts]
            flat, edges, own = [], [], []
            for d, g in enumerate(graphs):
                edges += links(g, len(flat))
                own.append((d, len(flat), len(flat) + len(g)))
                flat += g
            if flat:
                x = np.array([n[3] for n in flat])
                p = field.marginals(x, np.array([n[4] for n in flat]), np.array(edges, dtype=np.int64).reshape(-1, 3), np.repeat(np.arange(len(own)), [b - a for _, a, b in own]))
                for d, a, b in own:
                    if a < b:
                        extra[d] = sorted(added(strings[d], base[d], graphs[d], p[a:b], least))
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            return [[as_rows(b) for b in base], [as_rows(e) for e in extra]]

        return run

    return map_texts(docs, make, [T.StructField("base", span, False), T.StructField("extra", span, False)], keep, text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs), keep=["doc_id"])
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "row.doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_added"),
    )
