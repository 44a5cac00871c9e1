"""Word lists and patterns. Each operator takes them as parameters; these are the defaults for Korean procurement texts
and a small Latin set for corpora without Hangul."""

from __future__ import annotations

# Suffixes that the particle-stripping tokenizer removes, in the order in which they are tried.
PARTICLES = (
    "으로부터", "에서부터", "이라고", "이라면", "이라는", "이라서", "이어서", "에서는", "에게는", "으로는", "에서도", "으로도",
    "처럼", "같이", "부터", "까지", "에게", "보다", "에서", "으로", "이나", "이라", "이야", "이랑", "이고", "이며", "이면", "인가", "인지",
    "는", "은", "를", "을", "의", "로",
)

# Section headings, token classes and separators.
SECTION_HEADING = r"(?m)^(?:\d+\.\s+|[가-하]\.\s+|제\s*\d+\s*조)"
TOKEN = r"[가-힣A-Za-z0-9]+"
BM25_TOKEN = r"[0-9a-z가-힣]+"
LONG_TOKEN = r"[0-9A-Za-z가-힣]{2,}"
SEPARATORS = ("\n\n", "\n", ". ", " ")

# Question profiles.
PROFILE = {
    "budget": r"(예산|금액|사업비|기초금액|추정금액|얼마)",
    "schedule": r"(기간|일정|마감|언제|몇\s*일|개월|사업기간|수행기간|완료일)",
    "contract": r"(계약방식|입찰방식|계약|입찰|협상)",
    "purpose": r"(목적|배경|필요성|목표)",
    "comparison": r"(비교|차이|각각|모두|공통|서로|이상|이하)",
}

# Query words replaced before the lexical search, in this order.
QUERY_SYNONYMS = (
    ("예산", "금액"),
    ("사업비", "금액"),
    ("추정금액", "금액"),
    ("사업기간", "기간"),
    ("수행기간", "기간"),
    ("계약방식", "계약 방식"),
    ("입찰방식", "입찰 방식"),
    ("평가기준", "평가 기준"),
    ("참가자격", "참가 자격"),
)

# Words that make an amount or a number approximate.
AMBIGUOUS = ("약", "대략", "이상", "이하", "초과", "미만", "전후", "내외")
WON_UNITS = ((r"(\d+(?:\.\d+)?)억", 100_000_000), (r"(\d+(?:\.\d+)?)천만", 10_000_000), (r"(\d+(?:\.\d+)?)백만", 1_000_000), (r"(\d+(?:\.\d+)?)만", 10_000), (r"(\d+(?:\.\d+)?)천원", 1_000))
DURATION = r"(\d+(?:\.\d+)?)\s*(일|개월|달|주|년|시간|분)"
LIST_ALIASES = {"키르기즈스탄": "키르기스스탄", "키르기스": "키르기스스탄", "아이오에스": "ios", "안드로이드": "android", "파워포인트": "powerpoint", "ppt": "powerpoint", "한글": "hwp"}

# The Latin set, for texts without Hangul.
LATIN_SUFFIXES = ("tion", "ing", "ent", "ed", "er", "es")
LATIN_PROFILE = {"budget": r"(the|der|les)", "schedule": r"(tion|ung|ment)", "contract": r"(ing|keit)", "purpose": r"(and|und|que)", "comparison": r"(or|oder|ou)"}
LATIN_SYNONYMS = (("the", "a"), ("of", "from"), ("and", "plus"))
