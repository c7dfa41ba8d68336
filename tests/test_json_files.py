"""JSON read by byte ranges, whatever the ranges, against the parser; and written as streams."""

import json
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from marlspar.schema import strings
from marlspar.sources import json_files, readers, sinks

HARD = ["plain", 'quote " in', "back\\slash", "\\\\\"", "{[", "]}", "a\nb", "é日\U0001f600", "", "ends with \\", '","k":{"x":1}']


def texts(n, seed=1):
    rng = random.Random(seed)
    return [{"k": rng.choice(HARD) + str(i), "v": rng.choice(HARD), "o": {"x": [rng.choice(HARD), {"y": []}]}} for i in range(n)]


def read(spark, path, size, key=None):
    return sorted((r.file.rsplit("/", 1)[1], r.seq, r.sound, r.text) for r in json_files.objects(spark, [str(path)], key, size=size).collect())


@pytest.mark.parametrize("size", [3, 64, 1 << 20])
@pytest.mark.parametrize("indent, ascii_only", [(None, False), (2, True)])
def test_ranges_change_nothing(spark, tmp_path, size, indent, ascii_only):
    rows = texts(4 if size == 3 else 60)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_only))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text("")
    got = read(spark, tmp_path, size)
    assert [(f, n, s) for f, n, s, _ in got] == [("a.json", i, True) for i in range(len(rows))]
    assert [json.loads(t) for *_, t in got] == rows


@pytest.mark.parametrize("size", [37, 1 << 20])
def test_envelopes(spark, tmp_path, size):
    rows = texts(20, 2)
    whole = {"page": 1, "other": [{"k": "no"}], "say \"hi\"": rows, "note": "job_listings: [{}]", "last": [{"z": 0}]}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    (tmp_path / "b.json").write_text(json.dumps({"other": [{"k": "no"}]}))
    assert [json.loads(t) for *_, t in read(spark, tmp_path, size, 'say "hi"')] == rows
    assert [n for _, n, *_ in read(spark, tmp_path, size, "last")] == [0]


@pytest.mark.parametrize("size", [6, 1 << 20])
def test_a_malformed_element_is_one_reject(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(json_files, "RANGE", size)
    (tmp_path / "a.json").write_text('[{"k":"a"},\n{"k":"b"},{oops},{"k":"c", "v": }, 17, [1], {"k":"unclosed},\n{"k":"d"}]')
    df = readers.json_array(spark, str(tmp_path), strings("k", "v"))
    assert [r.k for r in df.filter("_corrupt_record IS NULL").orderBy("seq").collect()] == ["a", "b"]
    bad = [r._corrupt_record for r in df.filter("_corrupt_record IS NOT NULL").orderBy("seq").collect()]
    assert bad[:2] == ["{oops}", '{"k":"c", "v": }'] and bad[-2] == "[1]" and "".join(bad[2:-2]) == "17"
    assert readers.numbered_array(spark, str(tmp_path), strings("k")).count() == 2


def test_a_string_without_end_ends_with_its_line(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"k":"a},\n"v":"x"},\n{"k":"b"}\n]')
    df = readers.json_array(spark, str(tmp_path), strings("k"))
    assert [r.k for r in df.filter("_corrupt_record IS NULL").collect()] == ["b"]
    assert df.filter("_corrupt_record IS NOT NULL").count() == 1


def test_bare_objects_marks_and_other_encodings(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"k":"a"}\n{"k":"b"}\n')
    (tmp_path / "bom.json").write_bytes(b'\xef\xbb\xbf[{"k":"c"}]')
    (tmp_path / "_hidden.json").write_text('[{"k":"no"}]')
    got = readers.json_array(spark, str(tmp_path), strings("k"))
    assert sorted((r.k, r._corrupt_record) for r in got.collect()) == [("a", None), ("b", None), ("c", None)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.json").write_bytes('[{"k":"é"}]'.encode("latin-1"))
    assert readers.json_array(spark, str(tmp_path / "l"), strings("k"), "latin-1").first().k == "é"
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "x.json").write_bytes('[{"k":"é"}]'.encode("utf-16"))
    assert readers.json_array(spark, str(tmp_path / "u"), strings("k"), "UTF-16").first().k == "é"


def test_arrays_are_streamed_and_replace_what_is_there(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = texts(40, 3)
    df = spark.createDataFrame([(x["k"], x["v"]) for x in rows], "k string, v string")
    sinks.json_arrays(df, path, "k", files=3)
    sinks.json_arrays(df.limit(30), path, "k", files=3)
    files = sorted((tmp_path / "out").iterdir())
    assert len([f for f in files if f.name.startswith("part-")]) == 3 and not [f for f in files if "staged" in f.name]
    back = [x for f in files if f.name.startswith("part-") for x in json.loads(f.read_text())]
    assert sorted(map(str, back)) == sorted(str({"k": r.k, "v": r.v}) for r in df.limit(30).collect())
    sinks.json_arrays(df, str(tmp_path / "env"), "k", files=2, envelope="rows")
    assert readers.envelope(spark, str(tmp_path / "env"), strings("k", "v"), "rows").count() == 40
    sinks.json_array(df, str(tmp_path / "one"), ["k"])
    (one,) = [f for f in (tmp_path / "one").iterdir() if f.name.startswith("part-")]
    assert [x["k"] for x in json.loads(one.read_text())] == sorted((x["k"] for x in rows), key=str.encode)


def test_a_failed_write_leaves_what_is_there(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.json_arrays(spark.range(5).selectExpr("id AS k"), path, "k", files=1)
    with pytest.raises(Exception):
        sinks.json_arrays(spark.range(5).selectExpr("id AS k", "assert_true(id < 3) AS v"), path, "k", files=1)
    assert readers.json_array(spark, path, strings("k")).count() == 5
    assert not [f for f in (tmp_path / "out").iterdir() if "staged" in f.name]


def test_what_a_scan_holds_does_not_follow_the_file(tmp_path):
    """A file of many ranges takes the memory of one, and a task gives out texts as it comes to them."""
    (tmp_path / "a.json").write_text("[" + ",\n".join(json.dumps({"k": f"{i:08}" * 20}) for i in range(60000)) + "]")
    size = (tmp_path / "a.json").stat().st_size
    begins = range(0, size, json_files.RANGE)
    ranges = [{"file": str(tmp_path / "a.json"), "begin": b, "end": min(size, b + json_files.RANGE)} for b in begins]
    tracemalloc.start()
    sums = pd.concat([b.to_pandas() for b in json_files._sum_rows(iter([pa.RecordBatch.from_pylist(ranges)]))])
    entered = pa.RecordBatch.from_pandas(json_files._chained(sums))
    n = sum(sum(b.column("sound").to_pylist()) for b in json_files._object_rows(None, "utf-8")(iter([entered])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60000 and peak < 100e6  # workers with ranges of 8 MB grew to 900 MB


def test_an_element_over_many_ranges_that_ends_in_backslashes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_files, "MORE", 4)
    rows = [{"k": "a" * 40 + "\\" * n, "v": "x"} for n in range(1, 12)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    size, text = (tmp_path / "a.json").stat().st_size, (tmp_path / "a.json").read_bytes()
    with open(tmp_path / "a.json", "rb") as file:
        begin = text.index(b"{")
        for cut in range(begin + 45, text.index(b"}") + 1):
            head = text[begin:cut]
            s = json_files.scanned(np.frombuffer(text[:cut], np.uint8), False, 0, 0)
            found, sound = json_files._to_its_end(file, head, cut, size, s.inside_after, int(s.depth[-1]), 1, True) if int(s.depth[-1]) > 1 else (head, True)
            assert sound and json.loads(found) == rows[0]
