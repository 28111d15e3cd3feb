"""The registered file formats: whole files, folders and patterns, and what can't be read."""

import json
from decimal import Decimal

import pytest

from lectern.sources import files


@pytest.fixture(scope="module")
def formats(spark):
    files.register(spark)
    return spark.read.format


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_transcripts_of_a_folder(formats, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("lost words\n===== c_0.wav | 00:00:05 --> 00:01:00 =====\nhello  there\nyou\n=====c_1.wav|00:01:00-->01:00:00=====\n\n===== c_2.wav | 00:99:00 --> 00:00:01 =====\nx\n===== c_3.wav | 01:00:00 --> 01:00:00 =====\nbye\n")
    (tmp_path / "deep" / "b.txt").write_text("")
    (tmp_path / "deep" / "c.txt").write_text("===== é.wav | 00:00:00 --> 00:00:01 =====\nÜber")
    (tmp_path / "other.md").write_text("no transcript")
    got = formats("lectern_transcript").load(str(tmp_path))
    assert rows(got.filter("bad IS NULL"), "block", "name", "start_ts", "end_ts", "text") == [(0, "c_0.wav", 5, 60, "hello  there\nyou"), (0, "é.wav", 0, 1, "Über"), (3, "c_3.wav", 3600, 3600, "bye")]
    assert rows(got.filter("bad IS NOT NULL"), "bad", "name") == [("text before the first header", None), ("times of a header", None)]
    assert got.rdd.getNumPartitions() == 3
    assert formats("lectern_transcript").load(str(tmp_path / "*" / "c.txt")).count() == 1
    assert formats("lectern_transcript").load(f"file://{tmp_path}/a.txt").filter("bad IS NULL").count() == 2


def test_speech_keeps_bad_blocks(formats, tmp_path):
    blocks = [{"index": 1, "start_ts": 5.9, "end_ts": 5, "text": "two"}, {"index": "0", "start_ts": 0, "end_ts": 5, "text": "one"}, {"index": 2, "start_ts": None, "end_ts": 1}, 7, {"index": 3, "start_ts": 9, "end_ts": 11}]
    (tmp_path / "a.json").write_text(json.dumps({"video_id": 4, "blocks": blocks}))
    (tmp_path / "b.json").write_text(json.dumps(blocks[:1]))
    (tmp_path / "c.json").write_text("{nonsense")
    (tmp_path / "d.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "e.json").write_bytes(b"\xff\xfe")
    (tmp_path / "f.json").write_text("")
    got = formats("lectern_speech").load(str(tmp_path))
    assert rows(got.filter("bad IS NULL"), "video_id", "block", "start_ts", "end_ts", "text") == sorted([(4, 0, 0, 5, "one"), (4, 1, 5, 6, "two"), (4, 3, 9, 11, ""), (None, 1, 5, 6, "two")], key=str)
    assert rows(got.filter("bad IS NOT NULL"), "bad") == [("malformed block",)] * 2 + [("no JSON: JSONDecodeError",)] * 2 + [("no JSON: UnicodeDecodeError",), ("no list of blocks",)]
    assert all(r.raw is not None and r.text is None for r in got.filter("bad IS NOT NULL").collect())


def test_essays(formats, tmp_path):
    case = {"case_id": "c1", "answer": "because", "expected_score": "7.5"}
    question = {"question_id": "q1", "question": "why?", "model_answer": "so", "max_points": 10, "student_answers": [case, {"case_id": "c2"}, {**case, "case_id": "c3", "expected_score": "many"}]}
    (tmp_path / "a.json").write_text(json.dumps({"questions": [question, {"question_id": "q2"}, {**question, "question_id": "q3", "student_answers": []}]}))
    got = formats("lectern_essays").load(str(tmp_path / "a.json"))
    assert rows(got.filter("bad IS NULL"), "question_id", "case_id", "max_points", "expected_score", "answer") == [("q1", "c1", Decimal("10.00"), Decimal("7.50"), "because")]
    assert rows(got.filter("bad IS NOT NULL"), "bad") == [("malformed answer",), ("malformed answer",), ("malformed question",)]


def test_missing_files_and_columns(formats, tmp_path):
    with pytest.raises(Exception, match="missing.txt"):
        formats("lectern_transcript").load(str(tmp_path / "missing.txt")).collect()
    assert formats("lectern_transcript").load(str(tmp_path)).columns == ["path", "block", "name", "start_ts", "end_ts", "text", "bad", "raw"]
    assert formats("lectern_transcript").load(str(tmp_path)).count() == 0
