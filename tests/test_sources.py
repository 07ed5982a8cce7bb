import json

from docspan.sources import readers, store


def test_documents_and_limits(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Page x /Type /Pages /Type /Page ")
    (tmp_path / "b.PNG").write_bytes(b"\x89PNG")
    (tmp_path / "c.doc").write_bytes(b"hello")
    got = {r.filename: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.pdf"].page_count == 2 and got["a.pdf"].problem is None and got["b.PNG"].kind == "image"
    assert got["c.doc"].problem == "unsupported"


def test_recognised_lines(spark, tmp_path):
    box = {"BoundingBox": {"Left": 0.1, "Top": 0.2, "Width": 0.3, "Height": 0.05}}
    doc = {"Blocks": [{"Id": "L", "BlockType": "LINE", "Text": "two words", "Confidence": 90.0, "Geometry": box, "Relationships": [{"Type": "CHILD", "Ids": ["w2", "w1"]}]}, {"Id": "w1", "BlockType": "WORD", "Text": "words"}, {"Id": "w2", "BlockType": "WORD", "Text": "two"}, {"Id": "M", "BlockType": "LINE", "Text": "x", "Confidence": 50.0, "Geometry": box}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    got = {r.line_id: r for r in readers.read_recognised(spark, str(tmp_path)).collect()}
    assert got["L"].words == ["two", "words"] and abs(got["L"].confidence - 0.9) < 1e-9 and got["M"].words == []


def test_golden_and_marks(spark, tmp_path):
    case = tmp_path / "case"
    case.mkdir()
    (case / "truth.json").write_text(json.dumps({"sample_id": "s", "questions": [{"qid": "A/1", "marks": 2}, {"qid": "A/2"}], "answers": [{"qid": "A/1", "status": "answered"}]}))
    golden = readers.read_golden(spark, str(tmp_path))
    assert {(r.qid, r.status) for r in readers.marks_from_golden(golden).collect()} == {("A/1", "answered"), ("A/2", "unanswered")}
    readers.write_golden(golden, str(tmp_path / "out"))
    marks = tmp_path / "marks"
    marks.mkdir()
    (marks / "m.json").write_text(json.dumps({"doc_id": "d", "questions": [{"qid": "1", "marks_available": 2.0, "marks_awarded": 3.0, "band_low": 1.0, "band_high": 2.0, "status": "answered"}, {"qid": "2", "status": "unanswered"}]}))
    sets = readers.read_mark_sets(spark, str(marks))
    assert sets.first().total_high == 2.0
    assert {(r.qid, r.problem) for r in readers.mark_set_problems(sets).collect()} == {("1", "above_available"), ("1", "outside_band"), ("2", "null_without_reason")}


def test_snapshots_and_transcriptions(spark, tmp_path):
    (tmp_path / "p.txt").write_text("furniture\tPage 1\nquestion_start\t1. Why?\n")
    assert [(r.ord, r.role, r.text) for r in readers.read_role_snapshots(spark, str(tmp_path)).orderBy("ord").collect()] == [(1, "furniture", "Page 1"), (2, "question_start", "1. Why?")]
    (tmp_path / "t.tsv").write_text("# x\na.png\tb\tp\td\ttext\nshort\n")
    assert [tuple(r) for r in readers.read_transcriptions(spark, str(tmp_path / "t.tsv")).collect()] == [("a", "p", "text")]


def test_versioned_store(spark, tmp_path):
    s = store.VersionedStore(spark, str(tmp_path / "v"))
    row = lambda k, v, b: (k, v, b)
    make = lambda rows: spark.createDataFrame(rows, "key string, expect_version long, body string").selectExpr("key", "expect_version", "timestamp'2024-01-01' as updated_at", "body")
    assert s.save(make([row("a", 0, "1"), row("b", 0, "1")])).count() == 0
    assert {r.key for r in s.save(make([row("a", 1, "2"), row("b", 0, "x")])).collect()} == {"b"}
    assert {(r.key, r.version, r.body) for r in s.latest().collect()} == {("a", 2, "2"), ("b", 1, "1")}


def test_small_sinks(spark, tmp_path):
    docs = spark.sql("select 'pending' as status, timestamp'2024-01-01 00:00:00' as updated_at union all select 'done', timestamp'2024-01-01 00:00:00'")
    assert {r.status for r in store.settle(docs, "2024-01-01 01:00:00").collect()} == {"failed", "done"}
    first = store.first_writers(spark.createDataFrame([("h", 2, "b"), ("h", 1, "a")], "content_hash string, seq long, sub_id string"))
    assert first.first().sub_id == "a"
    pages = spark.createDataFrame([("0123456789abcdef/p0001.png", b"x")], "image_key string, png binary")
    store.write_pages(pages, str(tmp_path / "pages"))
    assert store.missing_pages(pages, spark.read.parquet(str(tmp_path / "pages"))).count() == 0
