import json

from pyspark.sql import functions as F

from marlspar.schema import RAW, strings
from marlspar.sources import readers, sinks, tables
from marlspar.streaming import streams


def test_json_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"job_title": "x", "skills": ["s"]}, {"job_title": None}]))
    (tmp_path / "bad.json").write_text("{not json")
    df = readers.source(spark, "instahyre", [str(tmp_path / "a.json"), str(tmp_path / "bad.json"), str(tmp_path / "gone.json")])
    got = df.select("job_title", "_corrupt_record").collect()
    assert sorted(str(r.job_title) for r in got if r._corrupt_record is None) == ["None", "x"]
    assert sum(r._corrupt_record is not None for r in got) == 1
    assert readers.source(spark, "instahyre", str(tmp_path / "gone.json")).count() == 0
    got = readers.numbered_array(spark, str(tmp_path / "a.json"), RAW["instahyre"]).orderBy("seq").collect()
    assert [(r.seq, r.job_title) for r in got] == [(0, "x"), (1, None)]


def test_envelope(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"job_listings": [{"Job Title": "a", "Skills": ["x"]}, {"Job Title": "b"}]}))
    (tmp_path / "m.json").write_text(json.dumps({"other": []}))
    df = readers.source(spark, "naukri", [str(tmp_path / "n.json"), str(tmp_path / "m.json")])
    assert sorted(r["Job Title"] for r in df.collect()) == ["a", "b"]


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Company Name,Job Title,Location,Skills,Job Type,Salary,Experience,Job Link\n"A, Inc",t,l,"[\'a\', \'b\']",,,2,u\n')
    row = readers.source(spark, "cuvette_csv", str(tmp_path / "c.csv")).first()
    assert row["Company Name"] == "A, Inc" and row["Skills"] == "['a', 'b']" and row["Salary"] is None
    assert readers.csv(spark, str(tmp_path / "none.csv"), RAW["cuvette_csv"]).count() == 0


def test_encodings_and_delimited(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("﻿héllo".encode())
    (tmp_path / "l.txt").write_bytes("héllo".encode("latin-1"))
    got = {r.file.rsplit("/", 1)[1]: (r.text, r.encoding) for r in readers.fallback_text(spark, f"{tmp_path}/*.txt").collect()}
    assert got == {"u.txt": ("héllo", "utf-8"), "l.txt": ("héllo", "latin-1")}
    (tmp_path / "d.cfg").write_text("a:b:c:d\na:b:c\na:b:c:d:e\n")
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "d.cfg"), ["w", "x", "y", "z"]).collect()] == [("a", "b", "c", "d")]


def test_pdf_by_a_given_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"!")

    def pages(data):
        if data == b"!":
            raise ValueError("empty")
        return data.decode().split("|")

    got = {r.file.rsplit("/", 1)[1]: (r.text, r.error) for r in readers.pdf_text(spark, str(tmp_path), pages).collect()}
    assert got == {"a.pdf": ("onetwo", None), "b.pdf": (None, "empty")}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_by_key(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "chat_id long, v string"), path)
    sinks.upsert_by_key(spark.createDataFrame([(1, "z"), (3, "n")], "chat_id long, v string"), path)
    assert sorted((r.chat_id, r.v) for r in tables.read(spark, path).collect()) == [(1, "z"), (2, "c"), (3, "n")]
    df = spark.createDataFrame([("é", 1)], "a string, b int")
    sinks.json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().a == "é"
    nested = spark.sql("SELECT array(named_struct('page_content', 'p', 'metadata', named_struct('id', 'x', 'n', 1))) AS job_recommendation")
    sinks.nested_csv(nested, str(tmp_path / "c"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "c")).first()) == ("x", "1")
    sinks.comparison_csv(spark.createDataFrame([("j", "l", "r")], "a string, b string, c string"), str(tmp_path / "cmp"), "a", "b", "c")
    sinks.load_with_rejects(df, df.limit(0), str(tmp_path / "ok"), str(tmp_path / "no"))
    sinks.append(df, str(tmp_path / "ok"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 2
    ids = sinks.content_id(spark.createDataFrame([("a",), ("a",), ("b",)], "text string"))
    assert ids.select("vector_id").distinct().count() == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = strings("k", "ts")
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps([{"k": f"k{i % 2}", "ts": f"2024-01-01 00:0{i}:00"}]))
    stream = streams.postings(spark, str(tmp_path / "in"), schema)
    seen = streams.to_table(streams.without_repeats(stream, ["k"], "ts"), str(tmp_path / "seen"), str(tmp_path / "cp0"))
    assert sorted(r.k for r in seen.collect()) == ["k0", "k1"]
    streams.accumulate(streams.postings(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "9.json").write_text(json.dumps([{"k": "k9", "ts": "2024-01-01 00:09:00"}]))
    streams.accumulate(streams.postings(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    streams.upsert(streams.postings(spark, str(tmp_path / "in"), schema), str(tmp_path / "up"), str(tmp_path / "cp2"), "k").awaitTermination()
    assert tables.read(spark, str(tmp_path / "up")).select("k").distinct().count() == 3
    assert tables.read(spark, str(tmp_path / "up")).filter(F.col("k") == "k9").count() == 1
