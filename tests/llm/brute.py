"""The contracts, written out plainly; slow, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def base_score(docs):
    train = Counter()
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    out = {}
    for d, t in docs:
        ts = [*words(t), None]
        out[d] = (zlib.crc32(str(d).encode()) % 7 == 2, len(ts), sum(train[x] > 0 for x in ts), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in ts))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def private(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, "email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, "ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, "card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, "phone", m.start(), m.end()))
    out.sort(key=lambda s: (s[0], s[2]))
    count = Counter(s[1] for s in out)
    return (*[count[k] for k in ("email", "ip", "card", "phone")], sha(",".join(f"{k}:{a}:{b}" for _, k, a, b in out)))


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, m.end(), "hex"))
    out.sort()
    count = Counter(s[3] for s in out)
    return (*[count[k] for k in ("assign", "access", "hex")], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in out)))


def shingles(text, n=3):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(docs, n=3, percent=85):
    sets = {d: shingles(t, n) for d, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}


def repeats(docs, least=400):
    texts = {d: (t or "").encode() for d, t in docs}
    seen = Counter(b[i : i + least] for b in texts.values() for i in range(len(b) - least + 1))
    out = {}
    for d, b in texts.items():
        cut = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                cut[i : i + least] = b"\1" * least
        runs = sum(1 for i in range(len(b)) if cut[i] and (i == 0 or not cut[i - 1]))
        out[d] = (len(b), sum(cut), runs, sha(bytes(x for x, c in zip(b, cut, strict=True) if not c)))
    return out


def contaminated(docs, items, window=13):
    patterns = {}
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(ASCII))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[s : s + window]), set()).add(str(i))
    sizes = {len(p) for p in patterns}
    out = {}
    for d, t in docs:
        w = ITEM_WORD.findall((t or "").translate(ASCII))
        hit, found = [False] * len(w), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                if own := patterns.get(tuple(w[s : s + m])):
                    hit[s : s + m] = [True] * m
                    found |= own
        n = sum(hit)
        out[d] = (len(w), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(w))
    return out


def token_ids(docs, path, end_id=2):
    import struct

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out, start = {}, 0
    for d, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out[d] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def vector_links(rows, least=0.93):
    import numpy as np

    ok = {}
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, dtype=np.float64)
            ok[i] = (a / np.linalg.norm(a), label)
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if ok[a][1] == ok[b][1] and float(ok[a][0] @ ok[b][0]) >= least]
    count = Counter(x for p in links for x in p)
    comp = components([i for i, _, _ in rows], links)
    return {i: (count[i], comp[i], comp[i] == i) for i, _, _ in rows}


class Katz:
    """A dictionary model of the given order; contexts are tuples, None is the end token."""

    def __init__(self, docs, discounts, order=3):
        import numpy as np

        counts = [Counter() for _ in range(order)]
        for d, t in docs:
            if zlib.crc32(str(d).encode()) % 7 != 2:
                ws = [None, *words(t), None]
                counts[0].update((w,) for w in ws[1:])
                for k in range(2, order + 1):
                    counts[k - 1].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
        n = sum(counts[0].values())
        use = lambda d, c: c * (d[c] if c < len(d) else 1.0)
        self.order, self.uni, self.follow = order, {w for (w,) in counts[0]}, {}
        for k, grams in enumerate(counts):
            d = discounts(np.array([0, *[sum(c == r for c in grams.values()) for r in range(1, 7)]]))
            here = {}
            for g, c in grams.items():
                here.setdefault(g[:-1], {})[g[-1]] = c
            for h, f in here.items():
                of = n if k == 0 else counts[k - 1][h]
                assert of == sum(f.values())
                whole = k and all(c > 5 for c in f.values())
                self.follow[h] = {w: use(d, c) / (of + whole) for w, c in f.items()}
        self.unknown = 1 - sum(self.follow[()].values())
        self.alpha = {h: (1 - sum(f.values())) / (1 - sum(self.p(h[1:], w) for w in f)) for h, f in self.follow.items() if h}

    def p(self, h, w):
        seen = self.follow.get(h, {})
        if w in seen:
            return seen[w]
        return self.alpha.get(h, 1.0) * self.p(h[1:], w) if h else self.unknown

    def score(self, text):
        ws = [None, *words(text), None]
        return sum(math.log10(self.p(tuple(ws[max(0, i - self.order + 1) : i]), ws[i])) for i in range(1, len(ws)))
