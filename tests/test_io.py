"""Sources, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from stenoflow.sinks import writers
from stenoflow.sources import readers
from stenoflow.streaming import jobs


def test_files(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"x" * 10)
    (tmp_path / "b.exe").write_bytes(b"x")
    (tmp_path / "c.wav").write_bytes(b"x" * 99)
    got = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in readers.uploads(spark, str(tmp_path), 50).collect()}
    assert got == {"a.mp3": "accepted", "b.exe": "unsupported", "c.wav": "too large"}


def test_jobs(spark, tmp_path):
    for name in ("j1", "j2"):
        writers.put_json(json.dumps({"id": name, "status": "done"}), str(tmp_path / f"{name}.json"))
    (tmp_path / "j3.json").write_text("{broken")
    assert [r["id"] for r in readers.jobs(spark, str(tmp_path), "id string, status string").where("id is not null").collect()] == ["j2", "j1"]
    assert readers.job(spark, str(tmp_path), "j1", "id string, status string").first()["status"] == "done"
    with pytest.raises(ValueError):
        readers.job(spark, str(tmp_path), "../j1", "id string")
    with pytest.raises(ValueError):
        writers.delete_job("running", lambda: None)


def test_config():
    got = readers.config({"asr": {"beam": 1, "name": "a"}}, {"ASR__BEAM": "5", "ASR__NAME": "b c", "OTHER__X": "1", "PATH": "/"})
    assert got == {"asr": {"beam": 5, "name": "b c"}}


def test_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("casa 5\nmasa\n\nlapte x\n")
    assert sorted(map(tuple, readers.frequency_list(spark, str(tmp_path / "w.txt")).collect())) == [("casa", 5), ("lapte", 1), ("masa", 1)]
    words = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, n long")
    writers.write_frequency_list(words, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["c\t9", "a\t2", "b\t2"]
    (tmp_path / "r.csv").write_text("id,x\n3,c\n1,a\n2,b\n")
    assert [r["id"] for r in readers.csv_rows(spark, str(tmp_path / "r.csv"), "id int, x string", 2, "id").collect()] == [1, 2]


def test_lines_taken_up_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x long")
    writers.append_lines(rows, str(tmp_path / "o"))
    writers.append_lines(rows.where("id = 'b'").withColumn("id", F.lit("c")), str(tmp_path / "o"))
    left = readers.json_lines(spark, str(tmp_path / "o"), "id string, x long", done=rows.where("id = 'a'"))
    assert sorted(r["id"] for r in left.collect()) == ["b", "c"]


def test_spans_and_sentences(spark):
    lines = ["1\tacid\tB-CHEM", "2\tfolic\tI-CHEM", "# text = O  propoziție destul de lungă.", "1\tla\tO", "2\tficat\tI-ANAT", "3\tmare\tI-ANAT", "4\tx\tB-DISO"]
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(lines)], "doc string, line_no int, value string")
    assert sorted((r["text"], r["category"]) for r in readers.annotated_spans(df).collect()) == [("acid folic", "CHEM"), ("ficat mare", "ANAT"), ("x", "DISO")]
    assert [r[0] for r in readers.sentences(df).collect()] == ["O propoziție destul de lungă."]


def test_model_and_delivery(spark):
    from pyspark.sql import types as T

    def call(prompt, temperature):
        return '{"a": 1}' if temperature > 0 or prompt == "good" else "no json"

    prompts = spark.createDataFrame([("1", "good"), ("2", "bad")], "key string, prompt string")
    got = {r["key"]: (r["answer"]["a"], r["attempts"]) for r in readers.model_rows(prompts, call, T.StructType([T.StructField("a", T.IntegerType())])).collect()}
    assert got == {"1": (1, 1), "2": (1, 2)}

    def hook(row):
        if row["id"] != "1":
            raise OSError("down")

    def mail(row):
        if row["id"] == "3":
            raise OSError("also down")

    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    got = {r["id"]: (r["via"], r["fallback_reason"]) for r in writers.deliver(rows, hook, mail).collect()}
    assert got == {"1": ("first", None), "2": ("second", "down"), "3": (None, "down; also down")}


def test_queue_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"id": str(i)}))
    seen = []
    q = jobs.queue(spark, str(tmp_path / "in"), "id string", lambda df, n: seen.append([r["id"] for r in df.collect()]), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(x for s in seen for x in s) == ["0", "1", "2"] and all(len(s) <= 1 for s in seen)


def test_stage_stream(spark, tmp_path):
    events = [("j", "asr", "running", 5.0), ("j", "asr", "done", 9.0), ("j", "asr", "running", 20.0), ("j", "llm", "error", 3.0)]
    spark.createDataFrame(events, "job string, stage string, status string, at double").coalesce(1).write.json(str(tmp_path / "in"))
    stream = jobs.stage_states(spark.readStream.schema("job string, stage string, status string, at double").json(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["stage"]: (r["status"], r["seconds"]) for r in spark.table("stages").collect()}
    assert got == {"asr": ("done", 4.0), "llm": ("error", None)}


def test_docx():
    import io
    import zipfile

    from stenoflow.sinks.office import docx

    made = docx([("Titlu & <altul>", True), ("rând\x00", False)])
    text = zipfile.ZipFile(io.BytesIO(made)).read("word/document.xml").decode()
    assert "Titlu &amp; &lt;altul&gt;" in text and "<w:b/>" in text and "\x00" not in text
    assert made == docx([("Titlu & <altul>", True), ("rând\x00", False)])
