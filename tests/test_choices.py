"""Choices that SQL cannot express, each against a plain version over whole tables or random cases: quotas, names, slots, search
modes, packing, shards and ratios."""

import difflib
import hashlib
import html as entities
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry import plans
from lexiquarry.operators import curation as C
from lexiquarry.operators import evidence as V
from lexiquarry.operators import grids as G
from lexiquarry.operators import ranking as K
from lexiquarry.operators import retrieval as R
from lexiquarry.operators import routing as RT
from lexiquarry.registry import QUERIES

plans.load()


def walk(rows, quotas):
    """One row after the other. rows: (key, order, uses)."""
    used, out = Counter(), set()
    for key, _, uses in sorted(rows, key=lambda r: (r[1], r[0])):
        if all(used[u] < quotas.get(u[0], 10**9) for u in uses):
            used.update(uses)
            out.add(key)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotas_are_one_walk_in_order(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(12), [("doc", f"d{int(rng.paretovariate(1)) % 9}"), *([("pair", f"p{rng.randrange(6)}")] if rng.random() < 0.7 else []), *([("other", "x")] if rng.random() < 0.3 else [])]) for i in range(160)]
    rows.append((999, 0, []))
    df = spark.createDataFrame(rows, "key int, o int, uses array<struct<quota: string, of: string>>")
    quotas = {"doc": 7, "pair": 3}
    got = C.greedy_quotas(df, "key", F.col("o"), F.col("uses"), quotas).collect()
    assert {r.key for r in got} == walk(rows, quotas)
    assert C.greedy_quotas(df.where("key < 0"), "key", F.col("o"), F.col("uses"), quotas).count() == 0


def test_quotas_of_order_lines(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").collect()
    price = defaultdict(float)
    for r in li:
        k = (r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey)
        price[k] = max(price[k], r.l_extendedprice)
    rows = [("-".join(map(str, k)), -p, [("order", k[0]), ("supplier", k[3]), ("part", k[2])]) for k, p in price.items()]
    assert {r.key for r in QUERIES["greedy_quotas"](spark, sf).collect()} == walk(rows, {"order": 4, "supplier": 24, "part": 8})


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_similar_names(spark):
    """Every pair that the ratio accepts is found, short names included, without a nested loop."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcab") for _ in range(rng.randrange(1, 14)))
    a, b = {word() for _ in range(60)}, {word() for _ in range(60)}
    a |= {"hwp report of the year 2024", "x", "ab"}
    b |= {"hwp reports of the year 2025", "x", "ba"}
    for least in (0.7, 0.78, 0.9):
        got = K.similar(spark.createDataFrame([(x,) for x in a], "s string"), spark.createDataFrame([(x,) for x in b], "l string"), least, C.sequence_ratio)
        want = {(x, y): round(r, 6) for x in a for y in b if (r := difflib.SequenceMatcher(None, x, y).ratio()) >= least}
        assert {(r.s, r.l): r.ratio for r in got.collect() if r.ratio >= least} == {k: v for k, v in want.items() if v >= least}
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_targets_by_name(spark):
    files = ["Annual Report 2024 (final).hwp", "annual report", "short", "Anual  Reprt 2024 final.hwp", "unrelated name of a file", "", None]
    targets = ["annual report 2024 (final)", "the short and long of it, with annual report inside", "short", "  "]
    f, t = spark.createDataFrame([(x,) for x in files], "name string"), spark.createDataFrame([(x,) for x in targets], "target string")
    found = K.select_targets(f, "name", t, "target", C.sequence_ratio)
    norm = lambda x: re.sub(r"\s+", "", (x or "").lower())

    def want(x):
        if not norm(x):
            return None
        pairs = [(norm(x), norm(y)) for y in targets if norm(y)]
        if any(min(len(p), len(q)) >= 8 and (p in q or q in p) for p, q in pairs):
            return "contains"
        return "similar" if any(difflib.SequenceMatcher(None, q, p).ratio() >= 0.78 for p, q in pairs) else None

    assert {r.name: r.matched_by for r in found.collect()} == {x: want(x) for x in files if want(x)}
    assert "NestedLoop" not in plan_of(found)


def test_names_are_resolved_without_a_nested_loop(spark):
    pool = spark.createDataFrame([("Report A.hwp", 3), ("report a.hwp", 1), ("The long report of B", 2), ("xy", 4), ("zzxyzz", 5)], "file_name string, place int")
    names = spark.createDataFrame([("Report A.hwp",), ("REPORT A.hwp",), ("long report",), ("xy",), ("zx",), ("x",), ("",), ("no such",)], "name string")
    got = K.resolve_names(names, pool)
    assert {r.name: (r.file_name, r.tier) for r in got.collect()} == {"Report A.hwp": ("Report A.hwp", 1), "REPORT A.hwp": ("report a.hwp", 2), "long report": ("The long report of B", 3), "xy": ("xy", 1), "zx": ("zzxyzz", 3), "x": ("xy", 3), "": (None, None), "no such": (None, None)} | {"zx": ("zzxyzz", 3) if "zx" in "zzxyzz" else (None, None)}
    assert "NestedLoop" not in plan_of(got)


# ---- slots


POOL = [
    *[(1, c, r, h, 2, None, "", "") for c, r, h in ((10, 1, []), (11, 2, [1]), (12, 3, [0]), (13, 4, [0, 1]), (14, 5, []), (15, 6, []), (16, 7, []), (17, 8, []))],
    *[(2, c, r, h, 1, t, p, n) for c, r, h, t, p, n in ((20, 1, [], 0, "a/b", "x"), (21, 2, [], 1, "a/c", "y"), (22, 3, [0], 0, "q", "y"), (23, 4, [], 0, "a/c", "z"), (24, 5, [0], 1, "", ""))],
    (3, 30, 1, [], 0, 0, "", ""),
]
COVERED = [(1, 12, 1), (1, 11, 2), (1, 10, 3), (1, 13, 4), (1, 14, 5), (1, 15, 6), (2, 21, 1), (2, 23, 2), (2, 22, 3), (2, 20, 4), (2, 24, 5), (3, 30, 1)]
POOL_SCHEMA = "query_id long, chunk_id long, rank int, slots_hit array<int>, asked int, is_table int, section_path string, section_title string"


def test_slots_by_hand(spark):
    got = R.cover_slots(spark.createDataFrame(POOL, POOL_SCHEMA)).collect()
    assert sorted((r.query_id, r.chunk_id, r.place) for r in got) == sorted(COVERED)


def test_slots_of_orders(spark, sf):
    """Each order's lines in the order that the rules give, worked out line by line."""
    li = defaultdict(lambda: [0.0, "Z", "Z"])
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        v = li[r.l_orderkey, r.l_linenumber, r.l_partkey]
        v[:] = max(v[0], r.l_extendedprice), min(v[1], r.l_returnflag), min(v[2], r.l_linestatus)
    want = {}
    for order in {k[0] for k in li}:
        lines = sorted((-v[0], k[1], k[2], v[1], v[2]) for k, v in li.items() if k[0] == order)
        rows = [{"id": p * 10 + n, "slots": [0] * (f == "R") + [1] * (p % 3 == 0), "table": n % 2, "path": f, "title": st} for _, n, p, f, st in lines]
        out = []
        if order % 3 == 0:
            tables, bodies = [r for r in rows if r["table"]], [r for r in rows if not r["table"]]
            out += tables[:1]
            bonus = lambda r, t=tables[:1]: (1.0 if r["path"] == t[0]["path"] else 0.5 if r["title"] == t[0]["title"] else 0.0) if t else 0.0
            out += sorted(bodies, key=lambda r: -bonus(r))[:1]
        for slot in (0, 1):
            out += [r for r in rows if slot in r["slots"] and not any(r is x for x in out)][:1]
        out += [r for r in rows if not any(r is x for x in out)][: max(0, 6 - len(out))]
        want |= {(order, k): r["id"] for k, r in enumerate(out, 1)}
    assert {(r.query_id, r.place): r.chunk_id for r in QUERIES["slot_coverage"](spark, sf).collect()} == want


# ---- searches


def greedy_mmr(ids, distance, vectors, k, weight=0.5):
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    order = sorted(range(len(ids)), key=lambda i: (distance[i], ids[i]))
    chosen = order[:1]
    while len(chosen) < min(k, len(ids)):
        value = lambda i: round(weight * (1 - distance[i]) - (1 - weight) * max(float(unit[i] @ unit[j]) for j in chosen), 9)
        chosen.append(max((i for i in order if i not in chosen), key=lambda i: (value(i), -order.index(i))))
    return [ids[i] for i in chosen]


def test_search_modes(spark):
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(40, 6)), rng.normal(size=(3, 6))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<double>")
    words = {k: [(k, (7 * k + 3 * r) % 40, 10.0 / r, r) for r in range(1, 13)] for k in range(3)}
    lexical = lambda n: spark.createDataFrame([r for k in words for r in words[k] if r[3] <= n], "query_id long, chunk_id long, score double, rank int")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    far = np.round(1 - unit(v) @ unit(q).T, 6)
    near = {k: sorted(range(40), key=lambda i: (far[i, k], i)) for k in range(3)}

    def got(mode, df=vectors, n=4):
        rows = R.search(mode, df, asked, lexical, n).orderBy("query_id", "rank").collect()
        return {k: [r.chunk_id for r in rows if r.query_id == k] for k in range(3)}

    assert got("basic") == {k: near[k][:4] for k in range(3)}
    assert got("mmr") == {k: greedy_mmr(near[k][:16], [far[i, k] for i in near[k][:16]], v[near[k][:16]], 4) for k in range(3)}

    def hybrid(k):
        lex = {c: s / (10.0 + 1e-10) for _, c, s, r in words[k] if r <= 8}
        score = {c: round((0.5 * (1 - far[c, k]) if c in near[k][:8] else 0.0) + 0.5 * lex.get(c, 0.0), 6) for c in {*near[k][:8], *lex}}
        return sorted(score, key=lambda c: (-score[c], c))[:4]

    assert got("hybrid") == {k: hybrid(k) for k in range(3)}
    for mode in ("basic", "mmr", "hybrid"):
        assert got(mode, vectors.where("false")) == {k: [c for _, c, _, r in words[k] if r <= 4] for k in range(3)}


def test_mmr_of_all_queries(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    got = defaultdict(list)
    for r in QUERIES["mmr"](spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    want = {}
    for k, i in enumerate(ids):
        if i % 20 == 0:
            far = np.round(1 - unit @ unit[k], 6)
            pool = sorted(range(len(ids)), key=lambda j: (far[j], ids[j]))[:20]
            want[i] = greedy_mmr([ids[j] for j in pool], [far[j] for j in pool], v[pool], 5)
    assert got == want


# ---- chunks, shards and ratios


def test_packed_and_recursive_chunks(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    digest = lambda x: (len(x), hashlib.md5(x.encode()).hexdigest())

    def packed(text, size=1000):
        parts = [p for p in (re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x) for x in text.split("\n")) if p]
        if not parts:
            return [text] if text else []
        out, now = [], []
        for p in parts:
            if len("\n".join([*now, p])) <= size:
                now.append(p)
                continue
            if now:
                out.append("\n".join(now))
            now = [p] if len(p) <= size else []
            if len(p) > size:
                out += [p[i : i + size].strip() for i in range(0, len(p), size)]
        return out + (["\n".join(now)] if now else [])

    got = defaultdict(list)
    for r in QUERIES["paragraph_pack"](spark, sf).orderBy("doc_id", "chunk_index").collect():
        got[r.doc_id].append((r.n, r.digest))
    assert got == {d: [digest(x) for x in packed(t)] for d, t in texts.items() if packed(t)}

    def split(text, size, seps):
        text = text.strip()
        if len(text) <= size:
            return [text] if text else []
        here = next((i for i, s in enumerate(seps) if s in text), None)
        if here is None:
            return [x for x in (text[i : i + size].strip() for i in range(0, len(text), size)) if x]
        groups, sep = [[]], seps[here]
        for part in [x for x in (y.strip() for y in text.split(sep)) if x]:
            if len(part) > size:
                groups += [part, []]
            elif groups[-1] and len(sep.join([*groups[-1], part])) > size:
                groups.append([part])
            else:
                groups[-1].append(part)
        return [x for g in groups if g for x in (split(g, size, seps[here + 1 :]) if isinstance(g, str) else [sep.join(g)])]

    got = defaultdict(list)
    for r in QUERIES["recursive_chunks"](spark, sf).collect():
        got[r.doc_id].append((r.n, r.digest))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(map(digest, split(t, 1000, ("\n\n", "\n", ". ", " ")))) for d, t in texts.items() if t.strip()}


def test_shards_of_ids(spark, sf):
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert {r["shard"]: r.n for r in QUERIES["hash_shards"](spark, sf).collect()} == Counter(zlib.crc32(str(i).encode()) % 8 for i in ids)


# ---- tables


def test_grids_by_hand():
    html = """<p>x</p><TABLE><caption>c</caption>
    <tr><th rowspan=2>A</th><th colspan='2'>B&amp;C</th></tr><tr><th>b</th><th> c <br>d</th></tr>
    <tr><td rowspan="2">1</td><td>2</td><td><!-- no --></td></tr><tr><td colspan=2>3 <table><tr><td>in</td></tr></table> 4</td><td>5</table><table><tr><td>other</td></tr></table>"""
    headers, cells = G.grid(html)
    assert headers == ["A", "B&C > b", "B&C > c d"]
    assert [(c["row_id"], c["col_id"], c["header_path"], c["rowspan"], c["colspan"], c["value_text"]) for c in cells] == [
        (1, 1, "", 2, 1, "A"), (1, 2, "", 1, 2, "B&C"), (2, 2, "", 1, 1, "b"), (2, 3, "", 1, 1, "c d"),
        (3, 1, "A", 2, 1, "1"), (3, 2, "B&C > b", 1, 1, "2"), (4, 2, "B&C > b", 1, 2, "3 in 4"), (4, 4, "", 1, 1, "5"),
    ]
    assert G.grid("<table><tr><td> </td></tr></table>", "a | b,c\n\n \t\nplain") == ([], [{"row_id": r, "col_id": k, "header_path": "", "rowspan": 1, "colspan": 1, "value_text": x} for r, k, x in ((1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "plain"))])
    assert G.grid("", None) == ([], []) and G.grid("<tr><td>loose", None)[1][0]["value_text"] == "loose"


def test_grids_fill_a_rectangle_once():
    """Random tables, drawn cell by cell on a board and written as HTML, come back in the same places."""
    rng = random.Random(3)
    for _ in range(60):
        rows, cols = rng.randrange(1, 6), rng.randrange(1, 6)
        board, written, want = {}, [], []
        for r in range(1, rows + 1):
            line = []
            for c in range(1, cols + 1):
                if (r, c) in board:
                    continue
                wide = next((w for w in range(1, rng.randrange(1, 4) + 1) if (r, c + w) in board or c + w > cols), None) or rng.randrange(1, 3)
                while any((r, c + k) in board or c + k > cols for k in range(wide)):
                    wide -= 1
                high = rng.randrange(1, rows - r + 2)
                board |= {(r + i, c + k): True for i in range(high) for k in range(wide)}
                value = entities.escape(f"v{r}.{c} <&>")
                line.append(f'<td rowspan="{high}" colspan={wide}>{value}</td>')
                want.append((r, c, high, wide, f"v{r}.{c} <&>"))
            written.append(f"<tr>{''.join(line)}</tr>")
        _, cells = G.grid(f"<table>{''.join(written)}</table>")
        assert [(x["row_id"], x["col_id"], x["rowspan"], x["colspan"], x["value_text"]) for x in cells] == want


def test_chunks_of_odd_tables(spark):
    rows = [(1, None, None, None, None, None, None), (2, "<table><tr><th>H</th></tr><tr><td>1,234 2024-1-5</td></tr></table>", None, "s", " body ", "m", 0.25), (3, "", "x", None, "body", None, None), (4, None, "", "s", "only a body", "m", 1.0)]
    t = spark.createDataFrame(rows, "k int, html string, lines string, section_label string, body string, pairing_method string, pairing_score double")
    got = G.structured_chunks(t, "k", prefix=F.concat(F.lit("t"), F.col("k").cast("string")), chars=60, signals={"date": r"\d{4}-"}).collect()
    kinds = Counter((r.k, r.chunk_type) for r in got)
    assert kinds == Counter({(2, "header_value_pair"): 2, (2, "cell_row_block"): 2, (2, "row_summary_chunk"): 2, (2, "paired_body_chunk"): 1, (2, "table_body_pack"): 1, (2, "row_body_pack"): 1, (3, "header_value_pair"): 1, (3, "cell_row_block"): 1, (3, "row_summary_chunk"): 1, (3, "paired_body_chunk"): 1, (3, "table_body_pack"): 1, (3, "row_body_pack"): 1, (4, "paired_body_chunk"): 1})
    pair = next(r for r in got if r.chunk_id == "t2_hv_0002")
    assert (pair.header_path, pair.value_num, pair.value_date, pair.has_date_signal) == ("H", 12342024.0, "2024-1-5", 0) and len(pair.text) == 60 < pair.raw_chars
    assert all(len(r.text) <= 60 for r in got) and len({r.chunk_id for r in got}) == len(got)


def test_blocks_by_hand(spark):
    lines = ["intro", "a  b  c", "1  2  3", "", "4  5", "text", "text", "x  y", "end"]
    df = spark.createDataFrame([(7, i, x) for i, x in enumerate(lines)], "doc_id int, line_no int, line string")
    flag = F.col("line").rlike(r"\S\s{2,}\S")
    got = RT.table_blocks(df, flag, least=0.0).collect()
    assert [(r.start_line, r.end_line, r.row_count, r.structured_row_count, r.modal_column_count, r.consistent_row_ratio, r.multi_column_row_ratio, r.numeric_row_ratio) for r in got] == [(1, 6, 6, 3, 3, 0.67, 0.5, 0.33)]
    want = 3 * 1.5 + 3 + (2 / 3) * 4 + (3 / 6) * 3 + (2 / 6) * 1.5 + 3 * 0.3
    assert got[0].block_score == pytest.approx(round(want, 2)) and got[0].table_rows == [["a", "b", "c"], ["1", "2", "3"], ["4", "5"]]
    assert got[0].text_recovery_percent == round(8 / 17 * 100, 2)
    assert RT.table_blocks(df, flag, least=round(want, 2) + 0.01).count() == 0


def test_page_windows(spark):
    words = lambda c: F.filter(F.split(F.lower(c), r"\W+"), lambda x: x != "")
    tables = spark.createDataFrame([("d", 1, "", "alpha beta gamma"), ("d", 2, "rare plan name", "x"), ("e", 1, "nothing like it", ""), ("f", 1, None, None)], "doc string, t int, parent string, structural string")
    pages = spark.createDataFrame([("d", i, x) for i, x in enumerate(["alpha", "zzz", "alpha beta", "the rare plan name here", "rare", "last"], 1)] + [("e", i, "other words") for i in range(1, 12)] + [("f", 1, None)], "doc string, page int, text string")
    scored = V.score_pages(tables, pages, "doc", "t", "page", words, least=0.3)
    assert {(r.doc, r.t, r.page): r.score for r in scored.collect()} == {("d", 1, 1): 0.333333, ("d", 1, 3): 0.666667, ("d", 2, 4): 1.2, ("d", 2, 5): 0.333333}
    got = V.target_pages(scored, pages, "doc", "t", "page", n=1).collect()
    assert sorted((r.doc, r.page) for r in got) == [*(("d", p) for p in (2, 3, 4, 5)), *(("e", p) for p in range(1, 9)), ("f", 1)]


@pytest.mark.parametrize("limit", [1, 7, 25, 60, 400])
def test_pairs_that_share_a_theme_alone(spark, limit):
    """Pairs by shared tags first, then those of which one is themed, in order of keys."""
    rng = random.Random(11)
    rows = [(k, rng.sample("pqrstuvw", rng.randrange(3)), rng.choice(["a portal", "none", "none", None])) for k in range(24)]
    df = spark.createDataFrame(rows, "k int, tags array<string>, name string")
    got = [(r.a, r.b, r.points, r.first_tags) for r in C.themed_pairs(df, "k", "tags", "name", ["portal"], limit).collect()]
    want = []
    for i, (a, s, x) in enumerate(rows):
        for b, t, y in rows[i + 1 :]:
            both, themed = sorted({*s} & {*t}), "portal" in (x or "") + (y or "")
            if both or themed:
                want.append((a, b, len(both) + themed, "|".join(both[:4])))
    want.sort(key=lambda p: (p[0], p[1]))
    want.sort(key=lambda p: (p[2], p[3]), reverse=True)
    assert sorted(got) == sorted(want[:limit])
