import pytest
from pyspark.sql import functions as F

from lexiquarry import sources as S
from lexiquarry import streaming

TEXT = """TYPE 1 : 단일 문서
------------
Q01
question : 예산은?
answer_type : factual
--- 장면 A ---
Q02 [2턴]
question : 그럼 기간은?
depends_on : Q01, -
TYPE 4 : 거절
Q03
question : 실제 낙찰 업체는?
"""


def test_question_set(spark):
    lines = spark.createDataFrame(list(enumerate(TEXT.splitlines())), "line_no int, value string")
    a, b, c = S.question_set(lines).orderBy("question_index").collect()
    assert (a.question_id, a.type_group, a.scenario_label, a.turn_index, a.depends_on_list) == ("Q01", "TYPE 1", "", None, [])
    assert (b.scenario_label, b.turn_index, b.depends_on_list) == ("장면 A", 2, ["Q01"])
    assert (c.answer_type, c.type_group, c.scenario_label) == ("rejection", "TYPE 4", "")


def test_csv_encodings(spark, tmp_path):
    for e in ("utf-8-sig", "cp949"):
        p = tmp_path / f"{e}.csv"
        p.write_bytes("이름,금액\n 사업 ,1000\n,x\n".encode(e))
        rows = S.normalize_metadata(S.read_csv(spark, str(p)), numbers=["금액"]).collect()
        assert [tuple(r) for r in rows] == [("사업", 1000.0), (None, None)]


def test_jsonl_and_ids(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in S.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]
    (tmp_path / "ids.txt").write_text("# note\nQ1\n\n Q2 \n")
    assert sorted(r.id for r in S.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["Q1", "Q2"]


def test_question_bank(spark):
    schema = "items array<struct<id: string, document_id: string, question: string, question_type: string, answer_eval_type: string, canonical_answer: string, answer: string, answer_aliases: array<string>, choice_index: string, choices: array<string>, difficulty: string, category: string>>"
    bank = spark.createDataFrame([([("D1-1", "D1", "q", "multiple_choice", "list", "", "a", [], "bad", ["b"], "basic", "x"), ("X", "D2", "q", "multiple_choice", "choice", "c", "c", [], "1", [], "basic", "x")],)], schema)
    items = S.question_bank(bank)
    first = items.where("item_id = 'D1-1'").first()
    assert (first.answer_eval_type, first.canonical_answer, first.choice_index) == ("list_set", "a", None)
    assert {tuple(r) for r in S.bank_problems(items).collect()} == {("D1-1", "answer_not_in_choices"), ("X", "no_choices"), ("X", "id_prefix")}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "ck"))
    got = streaming.run_to_end(streaming.windowed_counts(stream), "event_windows").orderBy("window_start", "event_type").collect()
    want = streaming.windowed_counts(events).orderBy("window_start", "event_type").collect()
    assert got == want and len(got) == events.select(F.window("ts", "1 hour"), "event_type").distinct().count()


@pytest.fixture
def index(spark, tmp_path):
    return S.VectorIndex(spark, str(tmp_path / "index"), dim=2)


def entries(spark, *rows):
    return spark.createDataFrame([(i, t, {"k": t}, e) for i, t, e in rows], "chunk_id string, text string, metadata map<string,string>, embedding array<double>")


def held(index):
    return {r.chunk_id: (r.text, r.metadata["k"], r.embedding) for r in index.read().collect()}


def test_upsert_delete_reset(spark, index):
    assert index.count() == 0 and index.version() is None
    index.upsert(entries(spark, ("a", "1", [1.0, 0.0]), ("b", "1", None), (None, "1", None)))
    assert held(index) == {"a": ("1", "1", [1.0, 0.0]), "b": ("1", "1", [0.0, 0.0])}
    before = index.read()
    index.upsert(entries(spark, ("b", "2", [0.5, 0.5]), ("b", "3", [0.5, 1.0]), ("c", "2", None)).drop("embedding"))
    assert held(index) == {"a": ("1", "1", [1.0, 0.0]), "b": ("3", "3", [0.0, 0.0]), "c": ("2", "2", [0.0, 0.0])}
    assert before.count() == 2  # a reader keeps the version that it opened
    index.delete(spark.createDataFrame([("a",), ("nobody",)], "chunk_id string"))
    index.vacuum()
    assert sorted(r.chunk_id for r in index.ids().collect()) == ["b", "c"] and index.count() == 2
    index.reset()
    assert index.count() == 0 and index.version() is None
    index.reset()
    index.upsert(entries(spark, ("z", "1", None)))
    assert index.count() == 1


def test_a_failed_write_leaves_the_old_version(spark, index):
    index.upsert(entries(spark, ("a", "1", [1.0, 0.0])))
    now = index.version()
    with pytest.raises(Exception, match="another length"):
        index.upsert(entries(spark, ("a", "2", [1.0, 0.0, 3.0])))
    bad = entries(spark, ("a", "2", None)).withColumn("text", F.when(F.rand() < 2, F.raise_error(F.lit("gone"))).cast("string"))
    with pytest.raises(Exception, match="gone"):
        index.upsert(bad)
    assert index.version() == now and held(index) == {"a": ("1", "1", [1.0, 0.0])}


def test_a_folder_is_scanned_once(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"metadata": {"file_name": "b"}, "n": 1}')
    (tmp_path / "a.json").write_text('{"metadata": {"file_name": "a"},\n "n": 2}')
    (tmp_path / "note.txt").write_text("no document")
    folder = S.JsonFolder(spark, str(tmp_path))
    numbers = lambda: [r.n for r in folder.documents().collect()]
    assert numbers() == [2, 1] and not folder.changed()
    (tmp_path / "c.json").write_text('{"metadata": {"file_name": "c"}, "n": 3}')
    (tmp_path / "a.json").write_text('{"metadata": {"file_name": "a"}, "n": 20}')
    assert folder.changed() and numbers() == [2, 1]
    assert folder.document(F.col("metadata.file_name"), "a").first().n == 2 and folder.document(F.col("metadata.file_name"), "c").first() is None
    kept = folder.documents()
    assert kept.storageLevel.useMemory
    folder.refresh()
    assert not kept.storageLevel.useMemory and not kept.storageLevel.useDisk
    assert numbers() == [20, 1, 3] and not folder.changed()
    folder.refresh()


def test_one_bad_file_is_one_failure(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def parse(name, data):
        calls.add(1)
        if name.startswith("bad"):
            raise ValueError("not a document")
        return data.decode()

    files = spark.createDataFrame([("a.pdf", b"text"), ("bad.hwp", b"x"), ("c.zip", b"x"), ("d.docx", b" "), ("e.HWP", "가".encode()), ("f.pdf", None)], "path string, content binary")
    at = str(tmp_path / "out")
    counts = S.write_preprocessed(S.parse_each(files, parse).drop("content"), at)
    assert counts == {"ok": 2, "failed": 4} and calls.value == 5  # one pass; files without a parser are not parsed
    rows = {r.path: (r.status, r.format, r.text, r.error) for r in spark.read.json(at).collect()}
    assert rows["a.pdf"][:3] == ("ok", "pdf", "text") and rows["e.HWP"][:3] == ("ok", "hwp", "가")
    assert rows["bad.hwp"][3] == "ValueError: not a document" and rows["c.zip"][:2] == ("failed", "none") and rows["d.docx"][3] == rows["f.pdf"][3] == "empty text"


def test_metadata_is_loaded_once(spark, tmp_path):
    csv, table = str(tmp_path / "m.csv"), str(tmp_path / "table")
    write = lambda text: (tmp_path / "m.csv").write_text(text)
    rows = lambda: sorted(tuple(r) for r in spark.read.parquet(table).collect())
    write("id,source_path\na,\n b ,\n")
    assert S.load_metadata(spark, csv, table) and rows() == [("a", None), ("b", None)]
    write("id,source_path\nc,/x/c\n")
    assert S.load_metadata(spark, csv, table) and rows() == [("c", "/x/c")]  # rows without links are replaced
    write("id,source_path\nd,\n")
    assert not S.load_metadata(spark, csv, table) and rows() == [("c", "/x/c")]
    assert S.load_metadata(spark, csv, table, force=True) and rows() == [("d", None)]
    with pytest.raises(Exception, match="no_such"):
        S.load_metadata(spark, str(tmp_path / "no_such.csv"), table, force=True)
    assert rows() == [("d", None)]


def test_csv_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'x "y"'), ("line\nend", None)], "k string, v string")
    S.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(str, S.read_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(str, df.collect()))
    S.write_csv(df.limit(0), str(tmp_path / "none"))
    assert S.read_csv(spark, str(tmp_path / "none")).count() == 0


def test_latest_and_options(spark, tmp_path):
    for n in ("report_20240102.json", "report_20240201.json", "other_9.json"):
        (tmp_path / n).write_text("{}")
    assert S.latest(spark, str(tmp_path), "report_*.json").endswith("report_20240201.json")
    defaults = {"a": 1, "b": {"c": 2, "d": [1, 2]}, "e": None}
    assert S.merged_options(defaults, {"a": None, "b": {"d": [3], "x": 4}, "f": 5}) == {"a": 1, "b": {"c": 2, "d": [3], "x": 4}, "e": None, "f": 5}
    assert S.merged_options(defaults, None) == defaults and defaults["b"]["d"] == [1, 2]
