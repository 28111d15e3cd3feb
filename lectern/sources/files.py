"""Files of the learning platform as registered formats: transcripts, recognised speech and graded essays.

`register(spark)` once, then `spark.read.format("lectern_transcript").load(path)`. A path is a file, a folder (read with all
below it) or a pattern, on any file system that Arrow opens by its address; every file is a partition, so files are read side by
side and a lost task reads its own again. Nothing is lost: what can't be read stays as a row with `bad` (why) and `raw` (the
first 2,000 characters), every other field null.

 lectern_transcript  path, block, name, start_ts, end_ts, text    text under headers `===== name | HH:MM:SS --> HH:MM:SS =====`
 lectern_speech      path, video_id, block, start_ts, end_ts, text   JSON: a list of blocks (index, start_ts, end_ts, text), or an
                     object with `blocks` and perhaps `video_id`; an end is at least a second past its start
 lectern_essays      path, question_id, case_id, question, model_answer, max_points, answer, expected_score   JSON: an object with
                     `questions`, each with its `student_answers`; points are texts of decimals

Cases: an empty file has no rows in a transcript and is bad as JSON; blocks without text are left out of transcripts; text before
the first header, and a header whose times make no sense, are bad rows; rows of speech come in the order of their index."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import HEADER

RAW = 2000
_SUFFIX = {"lectern_transcript": (".txt",), "lectern_speech": (".json",), "lectern_essays": (".json",)}


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def opened(path: str):
    """A file system and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The files that a path names, in order; of folders those with one of the suffixes."""
    import fnmatch

    from pyarrow import fs

    system, at = opened(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    wild = re.search(r"[*?\[]", at)
    if wild:
        root = at[: wild.start()].rpartition("/")[0] or "/"
        found = [i.path for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and fnmatch.fnmatch(i.path, at)]
    else:
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        inside = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
        found = [i.path for i in inside if i.is_file and (i.path == at or i.path.endswith(suffixes))]
    return sorted(head + p for p in found)


def read(path: str) -> bytes:
    system, at = opened(path)
    with system.open_input_stream(at) as f:
        return f.read()


def _seconds(stamp: str) -> int | None:
    m = re.fullmatch(r"([0-9]{2}):([0-9]{2}):([0-9]{2})", stamp)
    if not m or int(m[2]) > 59 or int(m[3]) > 59:
        return None
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3])


def transcript(text: str) -> Iterator[tuple]:
    """(block, name, start_ts, end_ts, text, bad, raw) of a transcript."""
    heads = list(re.finditer(HEADER, text))
    lead = text[: heads[0].start()] if heads else text
    if lead.strip():
        yield (*[None] * 5, "text before the first header", lead[:RAW])
    for k, h in enumerate(heads):
        body = text[h.end() : heads[k + 1].start() if k + 1 < len(heads) else len(text)].strip()
        start, end = _seconds(h[2]), _seconds(h[3])
        if start is None or end is None or end < start:
            yield (*[None] * 5, "times of a header", h[0][:RAW])
        elif body:
            yield k, h[1], start, end, body, None, None


def _parsed(raw: bytes):
    """(value, why it can't be read)."""
    try:
        return json.loads(raw.decode("utf-8")), None
    except (UnicodeDecodeError, ValueError) as e:
        return None, f"no JSON: {type(e).__name__}"


def _whole(x) -> int:
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        raise ValueError(x)
    return int(x)


def speech(raw: bytes) -> Iterator[tuple]:
    """(video_id, block, start_ts, end_ts, text, bad, raw) of recognised speech."""
    value, why = _parsed(raw)
    blocks = value.get("blocks") if isinstance(value, dict) else value
    if why is None and not isinstance(blocks, list):
        why = "no list of blocks"
    if why:
        yield (*[None] * 5, why, raw[:RAW].decode("utf-8", "replace"))
        return
    video, good = None, []
    if isinstance(value, dict) and value.get("video_id") is not None:
        try:
            video = _whole(value["video_id"])
        except (ValueError, OverflowError):
            yield (*[None] * 5, "video_id", str(value["video_id"])[:RAW])
    for b in blocks:
        try:
            index, start, end = (_whole(b[k]) for k in ("index", "start_ts", "end_ts"))
            good.append((video, index, start, max(end, start + 1), str(b.get("text") or ""), None, None))
        except (KeyError, TypeError, ValueError, OverflowError):
            yield (*[None] * 5, "malformed block", json.dumps(b, ensure_ascii=False)[:RAW])
    yield from sorted(good, key=lambda r: (r[1:5]))


def _points(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def essays(raw: bytes) -> Iterator[tuple]:
    """(question_id, case_id, question, model_answer, max_points, answer, expected_score, bad, raw) of graded essays."""
    value, why = _parsed(raw)
    questions = value.get("questions") if isinstance(value, dict) else None
    if why is None and not isinstance(questions, list):
        why = "no list of questions"
    if why:
        yield (*[None] * 7, why, raw[:RAW].decode("utf-8", "replace"))
        return
    for q in questions:
        try:
            head = (str(q["question_id"]), str(q["question"]), str(q["model_answer"]), _points(q["max_points"]))
            cases = q["student_answers"]
            if not isinstance(cases, list):
                raise TypeError(cases)
        except (KeyError, TypeError, InvalidOperation):
            yield (*[None] * 7, "malformed question", json.dumps(q, ensure_ascii=False)[:RAW])
            continue
        for c in cases:
            try:
                yield head[0], str(c["case_id"]), head[1], head[2], head[3], str(c["answer"]), _points(c["expected_score"]), None, None
            except (KeyError, TypeError, InvalidOperation):
                yield (*[None] * 7, "malformed answer", json.dumps(c, ensure_ascii=False)[:RAW])


_ROWS = {"lectern_transcript": lambda raw: transcript(raw.decode("utf-8", "replace")), "lectern_speech": speech, "lectern_essays": essays}
_FIELDS = {
    "lectern_transcript": "block int, name string, start_ts bigint, end_ts bigint, text string",
    "lectern_speech": "video_id bigint, block bigint, start_ts bigint, end_ts bigint, text string",
    "lectern_essays": "question_id string, case_id string, question string, model_answer string, max_points decimal(10,2), answer string, expected_score decimal(10,2)",
}


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str):
        self.kind, self.path = kind, path

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in listed(self.path, _SUFFIX[self.kind])]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # a folder without files
            return
        for row in _ROWS[self.kind](read(partition.path)):
            yield (partition.path, *row)


class _Files(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"path string, {_FIELDS[self.kind]}, bad string, raw string"

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError(f"{self.kind} needs a path")
        return _Reader(self.kind, self.options["path"])


class Transcripts(_Files):
    kind = "lectern_transcript"


class Speech(_Files):
    kind = "lectern_speech"


class Essays(_Files):
    kind = "lectern_essays"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    for source in (Transcripts, Speech, Essays):
        spark.dataSource.register(source)
