"""Grading of answers by type: strict, tolerant, partial and a reason.

Rows have eval_type, answer, question, canonical, aliases (array), choices (array) and choice_index. All types are graded in
one projection; what a type does not need is never evaluated for its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .answers import slot_pair

# Addresses, words around a choice that negate it, and how an answer gives the number of a choice.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"(?i)(https?://[^\s]+|www\.[^\s]+)"
NEGATION = r"(아닌|아니|말고|제외|아님)"
LEADING_NUMBER = r"^\s*(?:정답\s*[:：]?\s*|답\s*[:：]?\s*)?([1-9])\s*(?:번|\.|\)|$)"
LABELLED_NUMBER = r"(?:정답|답|보기)\s*[:：]?\s*([1-9])\s*(?:번|\.|\)|$)"


def sentence_scores(answers: DataFrame, key: str, answer: str, question: str, cues: Sequence[tuple[str, float]] = (), length_penalty: float = 0.002) -> DataFrame:
    """(key, pos, sentence, score): the question's words in the sentence, plus cues, less a penalty for length."""
    s = answers.select(key, question, F.posexplode(X.sentences(F.col(answer))).alias("pos", "sentence"))
    shared = F.size(F.array_intersect(X.token_set(F.col(question)), X.token_set(F.col("sentence"))))
    score = shared.cast("double") - F.length("sentence") * F.lit(length_penalty)
    for pattern, bonus in cues:
        score += F.when(F.col("sentence").rlike(pattern), bonus).otherwise(0.0)
    return s.select(key, "pos", "sentence", F.round(score, 6).alias("score"))


def mine(scored: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The n best sentences of each answer; earlier ones first among equals."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= n)


def choice_text(c: Column) -> Column:
    return F.regexp_replace(X.trimmed(c), r"^\s*\d+\s*[.)]\s*", "")


def choice_signal(answer: Column, choices: Column) -> Column:
    """struct(index, text, hits): the number an answer gives, and the choices it names without negation nearby."""
    low = F.lower(X.trimmed(F.coalesce(answer, F.lit(""))))
    number = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit("")).try_cast("int")
    index = F.coalesce(number(LEADING_NUMBER), number(LABELLED_NUMBER))
    # a choice is named if some occurrence has no negation within 6 characters before and 10 after
    quoted = lambda x: F.concat(F.lit(r"\Q"), F.replace(choice_text(x), F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    # looked around, not consumed, so that a mention does not swallow the next one
    pattern = lambda x: F.concat(F.lit("(?s)(?<=(^.{0,5}|.{6}))"), quoted(x), F.lit("(?=(.{0,10}))"))
    side = lambda x, k: F.regexp_extract_all(answer, pattern(x), F.lit(k))
    around = lambda x: F.zip_with(side(x, 1), side(x, 2), lambda a, b: F.concat(a, choice_text(x), b))
    named = lambda x: (choice_text(x) != "") & F.exists(around(x), lambda w: ~w.rlike(NEGATION))
    hits = F.filter(F.transform(choices, lambda x, i: F.struct((i + 1).alias("i"), choice_text(x).alias("t"), named(x).alias("ok"))), lambda h: h["ok"])
    one = F.size(hits) == 1
    index = F.coalesce(index, F.when(one, hits[0]["i"]))
    text = F.when(one, hits[0]["t"]).when((F.size(hits) == 0) & index.between(1, F.size(choices)), choice_text(F.try_element_at(choices, index))).otherwise(choice_text(answer))
    return F.struct(index.alias("index"), text.alias("text"), F.size(hits).alias("hits"))


def number_pair(c: Column) -> Column:
    """array(first, second) of the first two numbers of a text; null without two."""
    n = F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""), F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    return F.when(F.size(n) >= 2, F.slice(n, 1, 2))


def grade(rows: DataFrame, mined: Column | None = None) -> DataFrame:
    """Adds strict, tolerant, partial and error_reason."""
    # the pair, the choice and the lists are columns of their own, evaluated once and only for rows that are graded by them; a
    # struct made by transform is not taken apart again where it is read
    t, raw = F.col("eval_type"), F.coalesce(F.col("answer"), F.lit(""))
    own = F.when(t == "slot_pair", slot_pair(F.col("question"), F.col("answer")))
    items = F.array(F.struct(F.array_distinct(X.list_items(F.col("canonical"))).alias("want"), F.array_distinct(X.list_items(raw)).alias("got")))
    sizes = F.transform(items, lambda x: F.struct(F.size(x["want"]).alias("want"), F.size(x["got"]).alias("got"), F.size(F.array_intersect(x["want"], x["got"])).alias("hit")))[0]
    signal = choice_signal(raw, F.coalesce("choices", F.array().cast("array<string>")))
    two = lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), F.array(p["a"], p["b"]))
    rows = rows.withColumn("__own", own).withColumn("__signal", F.when(t == "choice", signal)).withColumn("__lists", F.when(t == "list_set", sizes))
    phrase = raw if mined is None else F.coalesce(mined, raw)
    wanted = F.array_compact(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))
    keys = lambda f: F.filter(F.transform(wanted, lambda w: f(w)), lambda x: x.isNotNull() & (x.cast("string") != ""))
    near = F.exists(keys(X.compare_key), lambda k: X.compare_key(phrase).contains(k))
    among = lambda value, f: F.coalesce(F.array_contains(keys(f), value), F.lit(False))
    holds = lambda value, f: F.coalesce(F.exists(keys(f), lambda k: value.contains(k)), F.lit(False))

    email, url = X.email_key(F.regexp_extract(raw, EMAIL, 0)), X.url_key(F.coalesce(F.nullif(F.regexp_extract(raw, URL, 0), F.lit("")), raw))
    number, amount = X.first_number(phrase), X.won(phrase)
    numbers = F.filter(F.transform(wanted, lambda w: X.first_number(w)), lambda x: x.isNotNull())
    date = F.coalesce(F.nullif(X.date_key(phrase), F.lit("")), X.date_key(raw))
    duration = F.coalesce(F.nullif(X.duration_key(phrase), F.lit("")), X.duration_key(raw))
    bare = lambda c: F.regexp_replace(c, "^계약일로부터", "")
    signal = F.col("__signal")
    expected_choice = F.coalesce(choice_text(F.try_element_at("choices", F.col("choice_index"))), F.col("canonical"))
    right_index = F.coalesce(signal["index"] == F.col("choice_index"), F.lit(False))
    right_text = (X.compare_key(expected_choice) != "") & (X.compare_key(expected_choice) == X.compare_key(signal["text"]))
    hit, want_items, got_items = F.col("__lists.hit"), F.col("__lists.want"), F.col("__lists.got")
    pair, want_pair = two(F.col("__own")), number_pair(F.col("canonical"))
    same_pair = F.coalesce(pair == want_pair, F.lit(False))
    pair_hits = F.coalesce(F.size(F.array_intersect(pair, want_pair)), F.lit(0))

    by_type = {
        "choice": ((right_index | right_text) & (signal["hits"] <= 1), right_index | (right_text & (signal["hits"] <= 1)), F.lit(True)),
        "currency": (F.coalesce(F.array_contains(keys(X.won), amount), F.lit(False)), near, amount.isNotNull()),
        "number": (F.coalesce(F.exists(numbers, lambda x: F.abs(x - number) < 1e-6), F.lit(False)), near, number.isNotNull()),
        "date": ((date != "") & among(date, X.date_key), near, date != ""),
        "duration": ((duration != "") & among(duration, X.duration_key), near | F.exists(keys(X.duration_key), lambda k: bare(k) == bare(duration)), duration != ""),
        "email": ((email != "") & among(email, X.email_key), holds(X.email_key(raw), X.email_key), email != ""),
        "phone": (among(X.phone_key(raw), X.phone_key), holds(X.phone_key(raw), X.phone_key), X.phone_key(raw) != ""),
        "url": ((url != "") & among(url, X.url_key), holds(url, X.url_key), raw.rlike(URL)),
        "slot_pair": (same_pair, same_pair | (pair_hits == F.size(F.array_distinct(want_pair))), pair.isNotNull()),
        "list_set": ((want_items > 0) & (hit == want_items) & (got_items == want_items), (want_items > 0) & (hit == want_items), got_items > 0),
    }
    free = ((X.compare_key(phrase) != "") & among(X.compare_key(phrase), X.compare_key), near, phrase != "")

    def pick(i: int) -> Column:
        out = None
        for k, v in by_type.items():
            out = F.when(t == k, v[i]) if out is None else out.when(t == k, v[i])
        return F.coalesce(out.otherwise(free[i]), F.lit(False))

    rows = rows.withColumns({"strict": pick(0), "found": pick(2)})
    rows = rows.withColumn("tolerant", F.col("strict") | pick(1))
    share = F.when(t == "list_set", F.round(hit / F.greatest(want_items, F.lit(1)), 4)).when(t == "slot_pair", F.round(pair_hits / 2.0, 4)).otherwise(0.0)
    rows = rows.withColumn("partial", F.when(F.col("strict") | (F.col("tolerant") & (share <= 0)), 1.0).otherwise(share))
    reason = F.when(F.col("strict"), "ok").when(F.col("tolerant"), F.when(t.isin("list_set", "free_string"), "extra_explanation").otherwise("formatting_only")).when(F.col("partial") > 0, "partial_list").when(~F.col("found"), "extraction_fail").otherwise("wrong_value")
    return rows.withColumn("error_reason", reason).drop("found", "__own", "__signal", "__lists")


def grade_basic(answer: Column, expected: Column) -> Column:
    """The older cascade: equal without spaces; contained from 4 characters on; equal amounts; equal dates; equal numbers."""
    a, e = X.document_name(answer), X.document_name(expected)
    numbers = lambda c: F.array_sort(F.regexp_extract_all(F.regexp_replace(c, ",", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    amount = F.coalesce(X.won_by_place(answer) == X.won_by_place(expected), F.lit(False)) & expected.rlike("[원억만]")
    date = (X.date_key(expected) != "") & (X.date_key(answer) == X.date_key(expected))
    return F.when(a == e, "exact").when((F.length(e) >= 4) & a.contains(e), "contains").when(amount, "amount").when(date, "date").when((F.size(numbers(expected)) > 0) & (numbers(answer) == numbers(expected)), "numbers").otherwise("wrong")


def best_candidate(rows: DataFrame, by: str, order: Sequence[Column], place: str) -> DataFrame:
    """The best-graded candidate: the keys in order, then the earliest."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order, place))).where("rn = 1").drop("rn")
