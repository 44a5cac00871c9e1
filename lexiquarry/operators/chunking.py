"""From a row per text to a row per chunk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon
from ..functions.text import normalize_text, trimmed

MARK = "\x01"


def sections(c: Column, heading: str = lexicon.SECTION_HEADING) -> Column:
    """Sections that start at headings; what comes before the first heading is left out; without headings, the text."""
    c = normalize_text(c)
    marked = F.regexp_replace(F.replace(c, F.lit(MARK), F.lit("")), f"({heading.replace('(?m)', '')})" if not heading.startswith("(?m)") else f"(?m)({heading[4:]})", MARK + "$1")
    parts = F.split(marked, MARK)
    kept = F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    return F.filter(F.transform(kept, trimmed), lambda x: x != "")


def slices(c: Column, size: int) -> Column:
    """Pieces of ``size`` characters, trimmed."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(size)), lambda i: trimmed(F.substring(c, i, F.lit(size))))


def packed_paragraphs(c: Column, size: int, separator: str = "\n\n") -> Column:
    """Paragraphs put together while they fit ``size``; a longer one is cut into slices."""
    paragraphs = F.filter(F.transform(F.split(c, separator), trimmed), lambda x: x != "")
    flush = lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"])))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, p: Column) -> Column:
        longer = F.when(a["now"] == "", p).otherwise(F.concat(a["now"], F.lit(separator), p))
        fits, alone = F.length(longer) <= size, F.length(p) <= size
        done = F.when(fits, a["done"]).when(alone, flush(a)).otherwise(F.concat(flush(a), slices(p, size)))
        return F.struct(done.alias("done"), F.when(fits, longer).when(alone, p).otherwise("").alias("now"))

    found = F.aggregate(paragraphs, start, step, flush)
    return F.when(F.size(paragraphs) > 0, found).when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def _recursive(text: str, size: int, separators: Sequence[str]) -> list[str]:
    """Splits at the first separator there is, merges what fits, and splits what does not by the later separators."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    for k, sep in enumerate(separators):
        if sep in text:
            break
    else:
        return [p for i in range(0, len(text), size) if (p := text[i : i + size].strip())]
    out, now = [], ""
    for part in filter(None, (p.strip() for p in text.split(sep))):
        joined = f"{now}{sep}{part}" if now else part
        if len(joined) <= size:
            now = joined
            continue
        if now:
            out.append(now)
        now = ""
        if len(part) <= size:
            now = part
        else:
            out += _recursive(part, size, separators[k + 1 :])
    return out + [now] if now else out


def recursive_chunks(c: Column, size: int, separators: Sequence[str] = lexicon.SEPARATORS) -> Column:
    """The recursion has no column form; Arrow batches go through a pandas function."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda t: _recursive(t, size, separators) if isinstance(t, str) else [])

    return split(c)


def with_overlap(chunks: DataFrame, overlap: int, doc: str = "doc_id", place: str = "chunk_index", text: str = "text") -> DataFrame:
    """Each chunk after the first starts with the end of the one before it, as that was before."""
    w = Window.partitionBy(doc).orderBy(place)
    before = F.lag(text).over(w)
    prefix = trimmed(F.when(F.length(before) > overlap, F.substring(before, F.length(before) - overlap + 1, F.lit(overlap))).otherwise(before))
    return chunks.withColumn(text, F.when(F.coalesce(prefix, F.lit("")) == "", F.col(text)).otherwise(trimmed(F.concat(prefix, F.lit("\n"), F.col(text)))))


def fixed_windows(docs: DataFrame, size: int = 1400, overlap: int = 120, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` characters, each starting ``overlap`` before the end of the last; none starts once the end is reached."""
    step = size - overlap
    n = F.length(text)
    count = F.greatest(F.ceil((n - overlap) / step), F.lit(1)).cast("int")
    at = F.explode(F.sequence(F.lit(0), count - 1))
    rows = docs.where(F.coalesce(F.length(text), F.lit(0)) > 0).select(*docs.columns, at.alias("chunk_index"))
    cut = trimmed(F.substring(F.col(text), F.col("chunk_index") * step + 1, F.lit(size)))
    return rows.withColumn("start", (F.col("chunk_index") * step).cast("long")).withColumn(text, cut).where(F.col(text) != "")


def chunk_rows(docs: DataFrame, chunks: Column, name: Column, doc: str = "doc_id") -> DataFrame:
    """(doc, chunk_index, chunk_id, text): numbered first, then without blank chunks."""
    rows = docs.select(doc, name.alias("__name"), F.posexplode(chunks).alias("chunk_index", "text"))
    return rows.where(trimmed(F.col("text")) != "").select(doc, "chunk_index", F.concat_ws("::", "__name", F.col("chunk_index").cast("string")).alias("chunk_id"), "text")


def grid_stats(docs: DataFrame, grid: Sequence[tuple[int, int]] = ((500, 100), (1000, 200), (1500, 300)), text: str = "text") -> DataFrame:
    """Per (size, overlap): chunks and their mean length. The grid is a constant; the texts are read once."""
    n = F.length(text)
    per = docs.where(n > 0).select(n.alias("n"), F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in grid])).alias("g")).select("n", "g.*")
    step = F.col("size") - F.col("overlap")
    count = F.greatest(F.ceil((F.col("n") - F.col("overlap")) / step), F.lit(1)).cast("long")
    chars = (count - 1) * F.col("size") + (F.col("n") - (count - 1) * step)
    return per.groupBy("size", "overlap").agg(F.sum(count).alias("chunks"), F.round(F.sum(chars) / F.sum(count), 2).alias("mean_length"))


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(doc, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def fill_down(rows: DataFrame, value: Column, name: str, by: str = "doc_id", order: str = "line_no") -> DataFrame:
    """The last value that is not null, from here upwards."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def around(rows: DataFrame, is_mark: Column, radius: int = 6, by: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """For each marker row, the text of the rows within ``radius``, blank ones and markers aside."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-radius, radius)
    body = F.collect_list(F.when(~is_mark & (trimmed(F.col(line)) != ""), trimmed(F.col(line)))).over(w)
    return rows.withColumn("body", F.array_join(body, "\n")).where(is_mark)


def readable_lines(c: Column, least: float = 0.45) -> Column:
    """Lines without noise: of 6 characters and more, ``least`` must be readable; of up to 3, some letter is needed."""
    ok = lambda x: F.length(F.regexp_replace(x, r"[^0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣÀ-ÿ\s.,:;!?()/%·\-]", ""))
    keep = lambda x: (x != "") & ~((F.length(x) >= 6) & (ok(x) < F.length(x) * least)) & ~((F.length(x) <= 3) & ~x.rlike(r"[A-Za-z가-힣À-ÿ]"))
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), trimmed), keep), "\n")


def marker_chunks(rows: DataFrame, marker: Column, section: Column, parent: Column, *, figure: Column, prefix: Column, confidence: Column, signals: dict[str, str], radius: int = 6, by: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """A chunk for each marker line of a document: the body around it under the section and parent labels that hold there.

    section, parent: the label that a line sets, or null; figure: whether a marker stands for a figure, else for a table;
    prefix: start of the chunk ids. (by, order, chunk_id, section_label, parent_section_label, item_title, kind, has_table,
    ocr_confidence from 0 to 1, body, text, a flag for each pattern of signals). Parts of the text that are blank are left out.
    """
    labelled = fill_down(fill_down(rows, section, "section_label", by, order), parent, "parent_section_label", by, order)
    found = around(labelled, F.coalesce(marker, F.lit(False)), radius, by, order, line)
    found = found.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    own, above = F.coalesce("section_label", F.lit("")), F.coalesce("parent_section_label", F.lit(""))
    kind = F.when(figure, "figure").otherwise("table")
    out = found.select(
        by,
        order,
        F.concat(prefix, F.lit("__mixed_"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("chunk_id"),
        own.alias("section_label"),
        above.alias("parent_section_label"),
        F.when(own != "", own).otherwise(above).alias("item_title"),
        kind.alias("kind"),
        F.when(figure, 0).otherwise(1).alias("has_table"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)), 4).alias("ocr_confidence"),
        F.col("body"),
    )
    part = lambda name, c: F.when(trimmed(c) != "", F.concat(F.lit(f"[{name}] "), c))
    text = F.concat_ws("\n", part("PARENT", F.col("parent_section_label")), part("SECTION", F.col("section_label")), F.concat(F.lit("["), F.upper("kind"), F.lit("_MARKER]")), part("BODY", F.col("body")))
    out = out.withColumn("text", text)
    return out.withColumns({f"has_{k}_signal": F.col("text").rlike(p).cast("int") for k, p in signals.items()})
