"""Answers as they are asked for and given: constrained forms, choices, guesses of types, overrides and reference snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Answer labels, numbers with their units, negations after a choice, names of choice numbers, cues of answer types.
CHOICE_NUMBER = r"^\s*\d+\s*[)\.\-]\s*"
CHOICE_LABEL = r"^\s*(정답|답)\s*[:：]\s*"
NUMBER_SPAN = r"[-+]?\d[\d,./-]*\s*(원|만원|억원|일|개월|월|주|시간|분)?"
NEGATIONS = ("아닌", "아니라", "아니고", "않고", "말고", "제외", "아닙니다")
CHOICE_NAMES = (("1", "1번", "①", "첫번째", "첫 번째"), ("2", "2번", "②", "두번째", "두 번째"), ("3", "3번", "③", "세번째", "세 번째"), ("4", "4번", "④", "네번째", "네 번째"))
CHAT_CUES = (("comparison", r"(비교|차이|공통|각각|대비|comparison)"), ("rejection", r"(불가|없나요|없는가|불가능|해당 없음|없습니까)"))
EVAL_CUES = (
    ("comparison", r"(비교|차이|공통|각각|모두|이상|이하)"),
    ("rejection", r"(실제 낙찰|실제 완료|실제 투입|운영 성과|현재 url|홈페이지)"),
    ("follow_up", r"(그럼|그중|앞에서|이전|이 사업|그 사업)"),
)
REASON_CUES = r"(목적|배경|이유|역할|어떻게|연계|한계|해결)"
PAIR_LABELS = ((("정량", "정량평가"), ("정성", "정성평가")), (("기술", "기술평가"), ("가격", "가격평가")))
NUMBER = r"[-+]?\d+(?:\.\d+)?"
UNIT = r"(?:점|%|원|일|개|명|부|건|곳|종)?"
LEADING_MARK = r"^(보기|정답[은:]?|답[은:]?)\s*"


def constrained(answer: Column, eval_type: Column) -> Column:
    """The first line without list marks, in the form that the answer's type asks for."""
    t = X.trimmed(F.coalesce(answer, F.lit("")))
    bare = lambda x: F.regexp_replace(x, r"^[-* \t]+|[-* \t]+$", "")
    first = F.filter(F.split(t, r"\r\n|\r|\n"), lambda x: X.trimmed(x) != "")
    line = F.coalesce(bare(F.try_element_at(first, F.lit(1))), F.lit(""))
    choice = F.regexp_replace(F.regexp_replace(line, CHOICE_NUMBER, ""), CHOICE_LABEL, "")
    span = F.coalesce(F.nullif(F.trim(F.regexp_extract(line, NUMBER_SPAN, 0)), F.lit("")), line)
    numbers = F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0))
    pair = F.when(F.size(numbers) >= 2, F.concat_ws(", ", numbers[0], numbers[1])).otherwise(line)
    listed = F.regexp_replace(F.replace(line, F.lit(";"), F.lit(",")), r"\s*,\s*", ", ")
    out = F.when(eval_type == "choice", choice).when(eval_type.isin("number", "currency", "date", "duration"), span).when(eval_type == "slot_pair", pair).when(eval_type == "list_set", listed).otherwise(line)
    return X.trimmed(out)


def map_choice(answer: Column, choices: Column, text_of=lambda c: c) -> Column:
    """The choice that an answer names: by number, by its whole text, after a number and a dot, or by the earliest mention that no
    negation follows within ten characters; else the answer itself."""
    said = X.trimmed(F.coalesce(answer, F.lit("")))
    short = F.trim(F.regexp_replace(said, LEADING_MARK, ""))
    place = lambda c: F.coalesce(*[F.when(c.isin(*names), i + 1) for i, names in enumerate(CHOICE_NAMES)])
    by_number = F.coalesce(*[F.try_element_at(choices, place(c)) for c in (short, said)])
    squeeze = lambda c: F.regexp_replace(c, r"\s", "")
    even = lambda c: F.regexp_replace(F.regexp_replace(c, ",%", ","), "[/·]", ",")
    exact = F.try_element_at(F.filter(choices, lambda x: squeeze(text_of(x)) == squeeze(said)), F.lit(1))
    cut = F.trim(F.regexp_replace(said, r"^\d{1,2}\.\s+", ""))
    whole, like = squeeze(said), even(squeeze(said))

    def mention(x: Column) -> Column:
        word = squeeze(text_of(x))
        plain = whole.contains(word)
        body, key = F.when(plain, whole).otherwise(like), F.when(plain, word).otherwise(even(word))
        at = F.position(key, body)
        return F.struct(at.alias("at"), F.substr(body, at + F.length(key), F.lit(10)).alias("after"), text_of(x).alias("text"))

    found = F.filter(F.transform(F.filter(choices, lambda x: text_of(x) != ""), mention), lambda m: (m["at"] > 0) & ~m["after"].rlike("|".join(NEGATIONS)))
    earliest = F.try_element_at(F.array_sort(F.transform(found, lambda m: F.struct(m["at"], m["text"]))), F.lit(1))["text"]
    return F.coalesce(text_of(by_number), text_of(exact), F.when(cut != said, cut), earliest, said)


def guess_type(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.coalesce(*[F.when(q.rlike(p), k) for k, p in CHAT_CUES], F.lit("factual"))


def guess_eval_type(question: Column, eval_type: Column, lists: Sequence[str] = ("list_set", "slot_pair")) -> Column:
    q = F.coalesce(question, F.lit(""))
    table = F.when(eval_type.isin(*lists), F.when(q.rlike(REASON_CUES), "table_plus_text").otherwise("table_factual"))
    return F.coalesce(*[F.when((F.lower(q) if k == "rejection" else q).rlike(p), k) for k, p in EVAL_CUES], table, F.lit("factual"))


def judge_answer_type(judge_type: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(judge_type, F.lit(""))))
    return F.when(k.isin("comparison", "follow_up", "rejection"), k).otherwise("factual")


def overridden(answer_type: Column, route: Column, confidence: Column, override: Column, route_of) -> Column:
    """struct(answer_type, route, confidence, reason, override_applied, predicted): an override wins with confidence 1, and what was
    predicted stays beside it."""
    by = F.nullif(F.lower(F.trim(F.coalesce(override, F.lit("")))), F.lit(""))
    pick = lambda a, b: F.when(by.isNotNull(), a).otherwise(b)
    reason = F.concat(F.lit("manual_override:"), by, F.lit("; predicted="), F.coalesce(answer_type, F.lit("")))
    return F.struct(pick(by, answer_type).alias("answer_type"), pick(route_of(by), route).alias("route"), pick(F.lit(1.0), confidence).alias("confidence"), F.coalesce(reason, F.lit("")).alias("reason"), by.isNotNull().alias("override_applied"), answer_type.alias("predicted"))


def virtual_row(rows: DataFrame, existing: str, predicted: Column, force: bool = False) -> DataFrame:
    """Keeps a question's own answer type unless it is blank or ``force``; follow-ups without dependencies depend on the history."""
    own = F.nullif(F.lower(F.trim(F.coalesce(existing, F.lit("")))), F.lit(""))
    routed = F.lit(force) | own.isNull()
    kind = F.when(routed, predicted).otherwise(own)
    depends = F.when(routed & (kind == "follow_up") & (F.size(F.coalesce("depends_on", F.array().cast("array<string>"))) == 0), F.when(F.col("has_history"), F.array(F.lit("__history__"))).otherwise(F.array().cast("array<string>"))).otherwise(F.col("depends_on"))
    return rows.withColumns({"routed": routed, "answer_type": kind, "depends_on": depends})


def slot_pair(question: Column, answer: Column) -> Column:
    """struct(a, b, how): the numbers after the labels that the question names, else two numbers with / or , between them."""
    t = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?m)^\s*\d+\.\s*", "")
    q = F.coalesce(question, F.lit(""))
    after = lambda names: F.coalesce(*[F.regexp_extract(t, rf"{n}[^\d\n]{{0,10}}({NUMBER})", 1).try_cast("double") for n in names])
    asked = lambda ns: q.rlike("|".join((*ns[0], *ns[1])))
    labels = [(asked(ns), ns) for ns in PAIR_LABELS] + [(q.contains("각각"), (("첫", "전"), ("두", "후")))]
    left, right, before = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False)
    for cond, (a, b) in labels:
        left, right = F.when(cond & ~before, after(a)).otherwise(left), F.when(cond & ~before, after(b)).otherwise(right)
        before = before | cond
    pair = rf"({NUMBER})\s*{UNIT}\s*[/,]\s*({NUMBER})"
    x, y = (F.regexp_extract(t, pair, k).try_cast("double") for k in (1, 2))
    both = left.isNotNull() & right.isNotNull()
    how = F.when(both, "label_aware_pair").when(x.isNotNull(), "explicit_pair_pattern").otherwise("slot_pair_extract_fail")
    return F.struct(F.when(both, left).otherwise(x).alias("a"), F.when(both, right).otherwise(y).alias("b"), how.alias("how"))


def has_axis(answer: Column, slots: Column, aliases: dict[str, Sequence[str]]) -> Column:
    """Whether an answer holds a name of any of the slots."""
    a = F.coalesce(answer, F.lit(""))
    hits = [F.array_contains(slots, k) & a.rlike("|".join(words)) for k, words in aliases.items()]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return F.coalesce(out, F.lit(False))


def snippets(text: Column, pattern: str, window: int = 120, most: int = 8) -> Column:
    """array<struct<start, end, match, snippet>>: the first ``most`` different matches of a pattern with ``window`` characters to both
    sides. Gaps between matches come from split, so that no position is searched twice."""
    t = F.coalesce(text, F.lit(""))
    whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(F.transform(F.split(t, pattern, -1), F.length), F.lit(1), F.size(whole)), whole, lambda g, w: F.struct(g.alias("g"), w.alias("w")))
    empty = F.lit(None).cast("array<struct<start:int,end:int,match:string>>")
    zero = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:int,end:int,match:string>>")).alias("found"))
    step = lambda acc, s: F.struct((acc["at"] + s["g"] + F.length(s["w"])).alias("at"), F.concat(acc["found"], F.array(F.struct((acc["at"] + s["g"]).alias("start"), (acc["at"] + s["g"] + F.length(s["w"])).alias("end"), s["w"].alias("match")))).alias("found"))
    found = F.aggregate(steps, zero, step, lambda acc: acc["found"])
    cut = lambda m: X.clean_text(F.substr(t, F.greatest(m["start"] - window, F.lit(0)) + 1, F.least(F.length(t), m["end"] + window) - F.greatest(m["start"] - window, F.lit(0))))
    rich = F.transform(found, lambda m: F.struct(m["start"], m["end"], X.clean_text(m["match"]).alias("match"), cut(m).alias("snippet")))
    keys = lambda a: F.transform(a, lambda m: F.struct(m["match"], m["snippet"]))
    once = F.filter(rich, lambda m, i: F.array_position(keys(rich), F.struct(m["match"], m["snippet"])) == i + 1)
    return F.slice(once, 1, most)
