"""Readers and writers: metadata CSV, JSON folders, JSON lines, question sets and question banks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import depends_on, safe_double, trimmed

# Encodings tried in this order, and the line forms of a question set.
ENCODINGS = ("UTF-8", "MS949", "EUC-KR")
TYPE_LINE = r"^TYPE\s+(\d+)\s*:\s*(.+)$"
SCENARIO_LINE = r"^---\s*(.*?[^-\s].*?)\s*---$"
QUESTION_LINE = r"^Q(\d+)\s*(?:\[(\d+)턴\])?\s*$"
FIELD_LINE = r"^\s*([A-Za-z_]+)\s*:\s*(.*)$"
EVAL_TYPES = {"list": "list_set", "number_pair": "slot_pair", "string": "free_string"}


def read_csv(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """A CSV with a header, in the first encoding that gives no replacement characters; a byte-order mark goes."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Korean encodings are Java's, not in Spark's own list
    for e in encodings:
        df = spark.read.csv(path, header=True, encoding=e, multiLine=True, escape='"')
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
        bad = F.lit(False)
        for c in df.columns:
            bad = bad | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False))
        if not any("�" in c for c in df.columns) and df.where(bad).limit(1).isEmpty():
            return df
    return df


def normalize_metadata(df: DataFrame, numbers: Sequence[str] = (), lower: Sequence[str] = ()) -> DataFrame:
    """Trimmed values, empty ones null, numbers as doubles where they can be, some columns in lower case."""
    for c in df.columns:
        v = F.nullif(trimmed(F.col(c)), F.lit(""))
        df = df.withColumn(c, safe_double(v) if c in numbers else F.lower(v) if c in lower else v)
    return df


def load_metadata(spark: SparkSession, csv: str, table: str, *, linked: str = "source_path", force: bool = False, normalize: Callable[[DataFrame], DataFrame] = normalize_metadata) -> bool:
    """Fills a stored metadata table from a CSV, replacing all rows at once; True if it did. A table that has rows, some of them
    with a linked source, is left as it is unless ``force``. The new rows are written beside the table before the old ones
    go, so a CSV that cannot be read changes nothing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, beside = jvm.org.apache.hadoop.fs.Path(table), jvm.org.apache.hadoop.fs.Path(f"{table.rstrip('/')}.new")
    fs = at.getFileSystem(conf)
    if fs.exists(at) and not force:
        old = spark.read.parquet(table)
        if linked in old.columns and not old.where(F.coalesce(linked, F.lit("")) != "").isEmpty():
            return False
    normalize(read_csv(spark, csv)).write.mode("overwrite").parquet(beside.toString())
    fs.delete(at, True)
    fs.rename(beside, at)
    return True


def read_json_folder(spark: SparkSession, path: str) -> DataFrame:
    """A document per file, with the path it came from."""
    return spark.read.json(path, multiLine=True).withColumn("parsed_path", F.input_file_name())


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A row per line; Spark's reader passes over blank lines."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')  # as it is read


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a list file: lines that are not blank and no comments."""
    v = trimmed(F.col("value"))
    return spark.read.text(path).select(v.alias("id")).where((v != "") & ~v.startswith("#")).distinct()


def latest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path that comes last by name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).agg(F.max("path")).first()[0]


def question_set(lines: DataFrame) -> DataFrame:
    """lines: (line_no, value) of one question set. A row per question: type and scenario carry down to later questions, a new
    type ends the scenario, fields belong to the question above. Rules of dashes are no scenario."""
    v = trimmed(F.col("value"))
    at = lambda p, k: F.nullif(F.regexp_extract(v, p, k), F.lit(""))
    rows = lines.select("line_no", F.col("value"), at(TYPE_LINE, 1).alias("t"), trimmed(at(TYPE_LINE, 2)).alias("tl"), at(SCENARIO_LINE, 1).alias("s"), at(QUESTION_LINE, 1).alias("q"), at(QUESTION_LINE, 2).alias("turn"))
    down = Window.partitionBy(F.lit(0)).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # a question set is one small file
    last = lambda c: F.last(c, ignorenulls=True).over(down)
    rows = rows.withColumns({"type_no": last(F.col("t")), "type_label": last(F.col("tl")), "scene": last(F.when(F.col("t").isNotNull(), F.lit("")).otherwise(F.col("s"))), "qno": last(F.col("q").try_cast("int")), "turn_index": last(F.when(F.col("q").isNotNull(), F.coalesce("turn", F.lit("0"))))})
    heads = rows.where("q IS NOT NULL").select(F.col("qno"), F.concat(F.lit("TYPE "), "type_no").alias("type_group"), "type_label", F.coalesce("scene", F.lit("")).alias("scenario_label"), F.nullif(F.col("turn_index").try_cast("int"), F.lit(0)).alias("turn_index"))
    is_field = F.col("q").isNull() & F.col("t").isNull() & F.col("s").isNull() & F.col("value").rlike(FIELD_LINE) & F.col("qno").isNotNull()
    fields = rows.where(is_field).select("qno", "line_no", F.regexp_extract("value", FIELD_LINE, 1).alias("k"), trimmed(F.regexp_extract("value", FIELD_LINE, 2)).alias("v"))
    wide = fields.groupBy("qno").agg(*[F.max_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.col("line_no"))).alias(k) for k in ("question", "answer_type", "ground_truth_doc", "ground_truth_docs", "ground_truth_hint", "eval_focus", "depends_on", "expected")])
    out = heads.join(wide, "qno", "left").na.fill("", ["question", "answer_type", "ground_truth_doc", "ground_truth_docs", "ground_truth_hint", "eval_focus", "depends_on", "expected"])
    kind = F.when((F.col("answer_type") == "") & ((F.col("type_group") == "TYPE 4") | (F.col("expected") != "")), "rejection").otherwise(F.col("answer_type"))
    return out.select(F.format_string("Q%02d", "qno").alias("question_id"), F.col("qno").alias("question_index"), "turn_index", "type_group", "type_label", "scenario_label", "question", kind.alias("answer_type"), *[c for c in ("ground_truth_doc", "ground_truth_docs", "ground_truth_hint", "eval_focus", "depends_on", "expected")], depends_on(F.col("depends_on")).alias("depends_on_list"))


def question_bank(bank: DataFrame) -> DataFrame:
    """bank: (items array<struct>). Typed rows: names of types made one, an answer for a missing canonical one, bad choice indices
    null."""
    i = bank.select(F.explode("items").alias("i")).select("i.*")
    kind = F.col("answer_eval_type")
    for a, b in EVAL_TYPES.items():
        kind = F.when(F.col("answer_eval_type") == a, F.lit(b)).otherwise(kind)
    return i.select(F.col("id").alias("item_id"), "document_id", "question", "question_type", kind.alias("answer_eval_type"), F.coalesce(F.nullif("canonical_answer", F.lit("")), "answer").alias("canonical_answer"), "answer_aliases", safe_double(F.col("choice_index")).try_cast("int").alias("choice_index"), "choices", "difficulty", "category")


def bank_problems(items: DataFrame) -> DataFrame:
    """(item_id, problem): multiple choice without choices, an answer that is no choice, an id without its document's prefix."""
    mc = F.col("question_type") == "multiple_choice"
    none = F.coalesce(F.size("choices"), F.lit(0)) <= 0
    rules = {"no_choices": mc & none, "answer_not_in_choices": mc & ~none & ~F.array_contains("choices", F.col("canonical_answer")), "id_prefix": ~F.col("item_id").startswith(F.col("document_id"))}
    return items.select("item_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("problem"))


QUESTION_COLUMNS = ("type_group", "type_label", "scenario_label", "question", "answer_type", "ground_truth_doc", "ground_truth_docs", "ground_truth_hint", "eval_focus", "expected")


def question_rows(rows: DataFrame, place: str = "line_no") -> DataFrame:
    """Questions of a CSV, with the number of each row in ``place`` (from 1): a blank id becomes CSVQ and the number in three
    digits, a missing index the number; columns that the file lacks are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    own, n = trimmed(text("question_id")), F.col(place).cast("int")
    index = F.coalesce(F.nullif(text("question_index"), F.lit("")).try_cast("int"), n)
    return rows.select(
        F.when(own == "", F.format_string("CSVQ%03d", n)).otherwise(own).alias("question_id"),
        index.alias("question_index"),
        safe_double(text("turn_index")).alias("turn_index"),
        *[text(c).alias(c) for c in QUESTION_COLUMNS],
        trimmed(text("depends_on")).alias("depends_on"),
        F.filter(F.transform(F.split(text("depends_on"), ","), lambda x: trimmed(x)), lambda x: ~x.isin("", "-")).alias("depends_on_list"),
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question CSV. Rows are numbered in the order of the file, one small file in one task."""
    rows = read_csv(spark, path, ("UTF-8",))
    return question_rows(rows.coalesce(1).withColumn("line_no", F.monotonically_increasing_id() + 1)).orderBy("question_index", "question_id")


# Formats that have a parser.
FORMATS = ("hwp", "pdf", "docx")


def dispatch(files: DataFrame, path: str = "path", formats: Sequence[str] = FORMATS) -> DataFrame:
    """Adds format and error: the parser of a file by its ending in lower case; files of other formats carry an error instead of ending
    the run."""
    suffix = F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"^.+(\.[^.]*)$", 1))
    known = suffix.isin(*[f".{f}" for f in formats])
    error = F.when(~known, F.concat(F.lit("Unsupported file format: "), F.coalesce(F.nullif(suffix, F.lit("")), F.lit("unknown"))))
    return files.withColumns({"format": F.when(known, F.substring(suffix, 2, 10)), "error": error})


def parse_each(files: DataFrame, parse: Callable[[str, bytes], str], path: str = "path", content: str = "content") -> DataFrame:
    """files with format, error, text: ``parse`` (path, bytes) run for each file that has a parser. What it raises for one file
    is that file's error and ends nothing else; so is a text that is blank."""
    known = dispatch(files, path)

    @F.pandas_udf("struct<text:string,error:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def one(name: str, data: bytes | None, error: str | None) -> tuple[str | None, str | None]:
            if error:
                return None, error
            try:
                text = parse(name, data or b"")
            except Exception as e:  # one file must not end the run
                return None, f"{type(e).__name__}: {e}"[:500]
            return (text, None) if text and text.strip() else (None, "empty text")

        for names, data, errors in batches:
            yield pd.DataFrame([one(*r) for r in zip(names, data, errors, strict=True)], columns=["text", "error"])

    parsed = known.withColumn("__p", run(F.col(path), F.col(content), F.col("error")))
    return parsed.withColumn("error", F.col("__p.error")).withColumn("text", F.col("__p.text")).drop("__p")


def write_preprocessed(documents: DataFrame, path: str, by: str = "format") -> dict[str, int]:
    """Writes parsed documents as JSON lines in one job: a folder for status ok and failed, and in each one for each format (none for
    files without). Returns how many of each were written, counted in the pass that writes them; a second run replaces all."""
    status = F.when(F.col("error").isNull(), "ok").otherwise("failed")
    seen = Observation("written")
    rows = documents.withColumn("status", status).withColumn(by, F.coalesce(by, F.lit("none")))
    counted = rows.observe(seen, F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    counted.write.mode("overwrite").partitionBy("status", by).json(path)
    return dict(seen.get)


class JsonFolder:
    """A scan of a folder of JSON documents that is kept until ``refresh``: files that come, change or go are not seen before,
    ``changed`` tells whether there are any."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._kept: DataFrame | None = None
        self._listing: int | None = None

    def listing(self) -> int:
        """A digest of the names, sizes and times of the folder's files; no file is opened."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(self.path).select("path", "length", "modificationTime")
        found = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", F.col("modificationTime").cast("long")).cast("decimal(38,0)")).alias("d")).first()
        return hash((found.n, found.d))

    def documents(self) -> DataFrame:
        if self._kept is None:
            self._listing = self.listing()
            self._kept = read_json_folder(self.spark, f"{self.path.rstrip('/')}/*.json").orderBy("parsed_path").persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.count()  # all files are read now, not when a part is first asked for
        return self._kept

    def document(self, column: Column, value) -> DataFrame:
        """The first document, by path, whose column has the value."""
        return self.documents().where(column == value).orderBy("parsed_path").limit(1)

    def changed(self) -> bool:
        return self._listing is not None and self.listing() != self._listing

    def refresh(self) -> None:
        """Forgets the scan and gives its memory back."""
        if self._kept is not None:
            self._kept.unpersist(blocking=True)
        self._kept = self._listing = None


class VectorIndex:
    """A stored table of chunks (id, text, metadata map, embedding). Every change writes a whole new version beside the old one
    and then moves one small file that names it, so a change that fails leaves the old version as it was; readers keep the
    version that they opened."""

    SCHEMA = "chunk_id string, text string, metadata map<string,string>, embedding array<double>"

    def __init__(self, spark: SparkSession, path: str, dim: int = 1536):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self._jvm = spark.sparkContext._jvm

    def _fs(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self) -> str | None:
        fs, at = self._fs(f"{self.path}/CURRENT")
        return self.spark.read.text(f"{self.path}/CURRENT").first().value if fs.exists(at) else None

    def read(self) -> DataFrame:
        now = self.version()
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{now}") if now else self.spark.createDataFrame([], self.SCHEMA)

    def _commit(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows.select("chunk_id", "text", "metadata", "embedding").write.parquet(f"{self.path}/{version}")
        fs, made = self._fs(f"{self.path}/.{version}")
        out = fs.create(made, True)
        out.write(bytearray(version.encode()))
        out.close()
        option = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(made, self._fs(f"{self.path}/CURRENT")[1], options)

    def upsert(self, rows: DataFrame) -> None:
        """rows: (chunk_id, text, metadata, embedding or none of that name). Rows replace those with their id; of rows that share one the
        last by text counts. A missing or null vector is one of zeros, as long as the index asks for; rows without id go."""
        zero = F.array_repeat(F.lit(0.0), self.dim)
        vector = F.coalesce(F.col("embedding").cast("array<double>"), zero) if "embedding" in rows.columns else zero
        new = rows.where(F.col("chunk_id").isNotNull()).select(F.col("chunk_id").cast("string").alias("chunk_id"), "text", F.col("metadata").cast("map<string,string>").alias("metadata"), vector.alias("embedding"))
        new = new.groupBy("chunk_id").agg(F.max_by(F.struct("text", "metadata", "embedding"), F.struct(F.coalesce("text", F.lit("")), "embedding")).alias("r")).select("chunk_id", "r.*")
        wrong = F.size("embedding") != self.dim
        new = new.withColumn("embedding", F.when(wrong, F.raise_error(F.concat(F.lit("a vector of another length: "), "chunk_id")).cast("array<double>")).otherwise(F.col("embedding")))
        self._commit(self.read().join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new))

    def delete(self, ids: DataFrame, key: str = "chunk_id") -> None:
        self._commit(self.read().join(ids.select(F.col(key).cast("string").alias("chunk_id")).distinct(), "chunk_id", "left_anti"))

    def ids(self) -> DataFrame:
        return self.read().select("chunk_id")

    def count(self) -> int:
        return self.read().count()

    def reset(self) -> None:
        """Removes the index with all its versions, if there is one."""
        fs, at = self._fs(self.path)
        fs.delete(at, True)

    def vacuum(self) -> None:
        """Removes versions that are not the current one; for times without readers of older ones."""
        now = self.version()
        fs, at = self._fs(self.path)
        for f in fs.listStatus(at) if now else ():
            name = f.getPath().getName()
            if name.startswith(("v-", ".v-")) and name != now:
                fs.delete(f.getPath(), True)


def merged_options(defaults: dict, override: dict | None) -> dict:
    """Options of a profile over defaults: nested ones are merged, null ones keep the default, lists and values are replaced."""
    out = dict(defaults)
    for k, v in (override or {}).items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged_options(out[k], v)
        elif v is not None:
            out[k] = v
    return out
