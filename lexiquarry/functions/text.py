"""Text functions: Column in, Column out, all in built-in functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon

SPACE = r"\s+"
#: Inside a character class: all white space of Unicode and the separators that count as such, and the ends of lines.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_ENDS = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
#: Inside a character class: decimal digits, and the superscript, circled, bracketed and dotted ones.
DIGITS = r"\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e\u2780-\u2788\u278a-\u2792"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def stripped(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def text_lines(c: Column) -> Column:
    """Lines that are not blank, stripped; every line end of Unicode counts."""
    return F.filter(F.transform(F.split(c, LINE_ENDS), stripped), lambda x: x != "")


def normalize_text(c: Column) -> Column:
    """Line ends as LF; no white space at either end."""
    return trimmed(F.regexp_replace(c, r"\r\n|\r", "\n"))


def clean_text(c: Column) -> Column:
    """NUL and ideographic space as space, blanks collapsed, two line ends in a row at most."""
    c = F.regexp_replace(c, "[\\x00　]", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n|\r", "\n"), r"[ \t]+", " ")
    return trimmed(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def tokens(c: Column, pattern: str = lexicon.BM25_TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def strip_suffix(token: Column, suffixes: Sequence[str] = lexicon.PARTICLES, stem: int = 2) -> Column:
    """Without the first suffix, in the order given, that leaves ``stem`` characters or more."""
    out = F.coalesce(*[F.when(token.endswith(s) & (F.length(token) >= len(s) + stem), F.substring(token, F.lit(1), F.length(token) - len(s))) for s in suffixes], token)
    return out


def stripped_tokens(c: Column, suffixes: Sequence[str] = lexicon.PARTICLES, pattern: str = lexicon.TOKEN) -> Column:
    return F.transform(tokens(c, pattern), lambda t: strip_suffix(t, suffixes))


def token_set(c: Column, pattern: str = lexicon.LONG_TOKEN) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lower))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the text reduced to letters, digits and ._-; a shorter text is its own."""
    s = F.regexp_replace(F.lower(c), r"[^0-9a-z가-힣._-]", "")
    # a match of no width at each place; cutting a substring out would walk to it from the start of the text
    grams = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))
    # transform over one element binds the reduced text once
    found = F.flatten(F.transform(F.array(s), lambda x: F.when(x == "", F.array().cast("array<string>")).when(F.length(x) < n, F.array(x)).otherwise(grams(x))))
    return F.when(c.isNotNull(), found)


def document_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), SPACE, "")


def file_name(c: Column) -> Column:
    """One space between words, none before the extension."""
    return F.regexp_replace(trimmed(F.regexp_replace(c, SPACE, " ")), r"(?i)\s+\.(hwp|pdf|xlsx?)", ".$1")


def question_key(c: Column) -> Column:
    c = trimmed(F.regexp_replace(F.lower(c), SPACE, " "))
    return F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}_\s]", "")


def compare_key(c: Column) -> Column:
    """Lower case without white space, quotes, brackets and punctuation."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), SPACE, "")
    c = F.regexp_replace(c, "[\"'`“”‘’()\\[\\]{}<>]", "")
    return F.regexp_replace(c, r"[.,:;!?/\\|·•\-_=+~]", "")


def safe_double(c: Column) -> Column:
    s = trimmed(c.cast("string"))
    return F.when(F.lower(s).isin("", "none", "nan"), F.lit(None)).otherwise(s.try_cast("double"))


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(safe_double(c).try_cast("long"), F.lit(default))


def date_key(c: Column) -> Column:
    """yyyy-mm-dd with months 1-12 and days 1-31 of any month; '' otherwise."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[년월./]", "-"), "일", "")
    p = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    part = lambda k: F.regexp_extract(s, p, k)
    ok = part(2).try_cast("int").between(1, 12) & part(3).try_cast("int").between(1, 31)
    return F.when(ok, F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))).otherwise("")


def _number(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def duration_key(c: Column, prefix: str = "계약일로부터") -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), " ", "")
    n, unit = F.regexp_extract(s, lexicon.DURATION, 1), F.regexp_extract(s, lexicon.DURATION, 2)
    out = F.concat(_number(n.try_cast("double")), F.when(unit == "달", "개월").otherwise(unit))
    return F.when(n == "", "").otherwise(F.concat(F.when(s.contains(prefix), prefix).otherwise(""), out))


def _any(c: Column, words: Sequence[str]) -> Column:
    return c.rlike("|".join(map(re.escape, words)))


def won(c: Column, ambiguous: Sequence[str] = lexicon.AMBIGUOUS) -> Column:
    """Amount in won: the sum over all matches of each unit, or a bare number; null for approximate amounts."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "[, ]", "")
    hits = [F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p, _ in lexicon.WON_UNITS]
    add = lambda found, unit: F.aggregate(found, F.lit(0.0), lambda a, x: a + x.cast("double") * unit)
    total = sum((add(h, float(u)) for h, (_, u) in zip(hits, lexicon.WON_UNITS, strict=True)), F.lit(0.0))
    used = sum((F.size(h) for h in hits), F.lit(0)) > 0
    bare = F.regexp_extract(s, r"(\d+(?:\.\d+)?)", 1)
    plain = F.when((s.contains("원") | s.rlike(r"^\d+(?:\.\d+)?$")) & (bare != ""), F.bround(bare.try_cast("double")).cast("long"))
    return F.when((s == "") | _any(s, ambiguous), F.lit(None).cast("long")).when(used, F.bround(total).cast("long")).otherwise(plain)


def won_by_place(c: Column, approximate: str = "약") -> Column:
    """Amount in won with places inside 만: 5천2백만원 is 52,000,000; null for approximate amounts."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[,\s]", "")
    place = lambda part, p, u: F.coalesce(F.regexp_extract(part, p, 1).try_cast("double"), F.lit(0.0)) * u

    def small(part: Column) -> Column:
        units = place(part, r"(\d+(?:\.\d+)?)천", 1000.0) + place(part, r"(\d+(?:\.\d+)?)백", 100.0) + place(part, r"(\d+(?:\.\d+)?)십", 10.0) + place(part, r"(\d+(?:\.\d+)?)$", 1.0)
        return units

    eok = place(s, r"(\d+(?:\.\d+)?)억", 1e8)
    man = small(F.regexp_extract(s, r"((?:\d+(?:\.\d+)?[천백십]?)+)만", 1)) * 10000.0
    rest = small(F.regexp_extract(s, r"(?:^|만|억)((?:\d+(?:\.\d+)?[천백십]?)+)원?$", 1))
    total = eok + man + F.when(s.rlike("[억만천백원]") | s.rlike(r"^\d+(\.\d+)?$"), rest).otherwise(0.0)
    return F.when(s.contains(approximate) | ~s.rlike(r"\d"), F.lit(None).cast("long")).otherwise(F.nullif(F.bround(total).cast("long"), F.lit(0)))


def first_number(c: Column, ambiguous: Sequence[str] = lexicon.AMBIGUOUS) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), ",", "")
    return F.when(~_any(s, ambiguous), F.regexp_extract(s, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double"))


def phone_key(c: Column) -> Column:
    d = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9]", "")
    return F.when(d.startswith("82") & (F.length(d) >= 11), F.concat(F.lit("0"), F.substring(d, F.lit(3), F.length(d)))).otherwise(d)


def email_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(F.coalesce(c, F.lit("")))), " ", "")


def url_key(c: Column) -> Column:
    """Host and path in lower case, without scheme, query, fragment and final slashes."""
    s = F.regexp_replace(F.lower(trimmed(F.coalesce(c, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(s, r"[?#].*$", ""), r"/+$", "")


def cell_values(c: Column) -> Column:
    """struct(number, date): the first number, commas aside, and the first date-like part."""
    n = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""), r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")
    d = F.nullif(F.regexp_extract(c, r"\d{4}[-./년]\s*\d{1,2}[-./월]\s*\d{1,2}", 0), F.lit(""))
    return F.struct(n.alias("number"), d.alias("date"))


def sentences(c: Column) -> Column:
    parts = F.split(F.regexp_replace(c, r"\n+", ". "), r"[.!?。]\s*")
    return F.filter(F.transform(parts, trimmed), lambda x: x != "")


def keywords(c: Column, stop: Sequence[str] = (), most: int = 8) -> Column:
    found = F.filter(token_set(c), lambda t: ~t.isin(*stop)) if stop else token_set(c)
    return F.slice(found, F.lit(1), F.lit(most))


def flag(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False)).cast("int")


def count_of(c: Column, patterns: Sequence[str]) -> Column:
    return sum((F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0)) for p in patterns), F.lit(0)).cast("long")


def occurrences(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal word."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


def weighted_keywords(c: Column, weights: dict[str, float], most: int = 8) -> Column:
    low = F.lower(c)
    return sum((F.least(occurrences(low, w.lower()), F.lit(most)) * F.lit(x) for w, x in weights.items()), F.lit(0.0))


def html_text(c: Column) -> Column:
    """Scripts and styles aside; line ends for breaks and block ends; tags off; the common entities decoded."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])>", "\n"), r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n+", "\n"))


def html_tables(c: Column, tables: int = 5, rows: int = 12, cells: int = 8) -> Column:
    """array<table: array<row: array<cell>>> of an HTML text."""
    each = lambda p: lambda x: F.regexp_extract_all(x, F.lit(p), F.lit(1))
    cell_text = lambda x: trimmed(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), SPACE, " "))
    found = F.slice(each(r"(?is)<table[^>]*>(.*?)</table>")(c), 1, tables)
    return F.transform(found, lambda t: F.transform(F.slice(each(r"(?is)<tr[^>]*>(.*?)</tr>")(t), 1, rows), lambda r: F.transform(F.slice(each(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>")(r), 1, cells), cell_text)))


def markdown_table(rows: Column) -> Column:
    """A table of rows as markdown; rows are padded to the widest and the first is the header."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(F.element_at(rows, 1)), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), line)), "\n"))


def recovery_percent(extracted: Column, original: Column, cap: bool = True) -> Column:
    size = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, ""))
    p = F.when(size(original) > 0, size(extracted) * 100.0 / size(original)).otherwise(0.0)
    return F.round(F.least(p, F.lit(100.0)) if cap else p, 2)


def json_block(c: Column) -> Column:
    """The text from the first { to the last }."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def score_1_to_5(c: Column) -> Column:
    """Whole part of a number, held between 1 and 5; 1 for anything else."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(c.cast("string").try_cast("double").try_cast("int"), F.lit(1))))


def depends_on(c: Column) -> Column:
    """Ids of a comma list, or of a JSON array of strings; - is none."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\[\]"]', ""), ",")
    return F.filter(F.transform(parts, trimmed), lambda x: (x != "") & (x != "-"))


def normalized_query(c: Column, rules: Sequence[tuple[str, str]] = lexicon.QUERY_SYNONYMS) -> Column:
    for a, b in rules:
        c = F.replace(c, F.lit(a), F.lit(b))
    return trimmed(F.regexp_replace(c, SPACE, " "))


def list_items(c: Column, aliases: dict[str, str] = lexicon.LIST_ALIASES) -> Column:
    """Comparable items of an enumeration."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[•·]|\s*/\s*|(?<![\p{L}\p{N}_])(및|그리고)(?![\p{L}\p{N}_])", ",")

    def item(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\s*[-*]\s*", "")
        x = F.regexp_replace(x, r"^\s*\d+[.)]\s*", "")
        x = F.regexp_replace(x, r"^\s*(해당|본)?\s*(사업\s*)?(대상\s*)?(국가|지역|항목|목록|내역|기능)\s*(은|는|이|가|:)\s*", "")
        return compare_key(F.regexp_replace(F.regexp_replace(x, r"\s*(입니다|이다|임)\s*$", ""), r"\(.*?\)", ""))

    def final(name: str) -> str:
        for a, b in aliases.items():
            name = b if name == a else name
        return name

    def named(x: Column) -> Column:
        out = x
        for a in aliases:
            out = F.when(x == a, F.lit(final(a))).otherwise(out)
        return out

    def chunk(x: Column) -> Column:
        places = F.regexp_extract_all(x, F.lit(r"[가-힣]{2,}(?:시|군|구|도|읍|면|리|국|권)"), F.lit(0))
        return F.when((F.length(x) > 18) & (F.size(places) >= 2), places).otherwise(F.array(x))

    # names are looked up in a transform of their own, so that an item is tidied once and not for every alias
    return F.filter(F.transform(F.transform(F.flatten(F.transform(F.split(c, r"[,\n|;]+"), chunk)), item), named), lambda x: x != "")


# Numbers and dates inside a cell.
CELL_NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
CELL_DATE = r"\d{4}[./-]\d{1,2}[./-]\d{1,2}"


def cell_number(c: Column) -> Column:
    """The first number of a cell, spaces aside and without thousands separators; null if there is none."""
    return F.regexp_replace(F.regexp_extract(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")), CELL_NUMBER, 0), ",", "").try_cast("double")


def cell_date(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), CELL_DATE, 0)


def plain_number(c: Column) -> Column:
    """A number as text, whole ones with one decimal; '' for null."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.coalesce(F.when(whole, F.concat(c.cast("long").cast("string"), F.lit(".0"))).otherwise(c.cast("string")), F.lit(""))
