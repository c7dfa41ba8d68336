"""Registered queries that go through files, whole recipes and flows, with their DuckDB counterparts.

Tables of the data folder stand in for captured postings: their columns are put
into the sources' own forms, written by the sinks and read by the readers.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspar.functions import extract, html, text
from marlspar.operators import clean, dedup, merge, profile, recommend, vectors
from marlspar.plans import catalog, flows
from marlspar.plans.catalog import EXP_TEXT
from marlspar.plans.registry import query
from marlspar.schema import RAW
from marlspar.session import scratch, spread, table
from marlspar.sources import captured, json_files, readers, recommended, sinks, tables
from marlspar.streaming import dialogue, streams

#: A part as a posting, in SQL that Spark and DuckDB both read.
POSTING = {
    "Job Title": "concat(p_name, ' *(', p_partkey % 50, ')*')", "Job Link": "concat('https://x/job/', p_partkey)", "Company Name": "concat(p_brand, chr(10), p_size, ' Reviews')",
    "Experience": EXP_TEXT, "Salary": "CASE WHEN p_size % 3 > 0 THEN concat(p_size, ' LPA') END", "Location": "concat('at: ', p_type)",
    "Job Description": "CASE WHEN p_partkey % 5 > 0 THEN concat(p_type, ' needs **', p_name, '**') END",
}

_RAW = "SELECT p_partkey, " + ", ".join(f'{sql} AS "{name}"' for name, sql in POSTING.items()) + ", p_brand, p_type FROM part"


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, the posting's columns, and Skills as a list."""
    skills = F.array("p_brand", F.concat("p_type", F.lit("/b,c")))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.expr(sql).alias(name) for name, sql in POSTING.items()], skills.alias("Skills"))


# Files


@query("SELECT c_custkey AS chat_id, c_name AS full_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def stored_collection(spark, sf_dir):
    """Truncate and load, insert, and read back without the store's ids."""
    path = scratch(spark, "users")
    ids = F.expr("uuid()").alias("_id")
    for _ in range(2):  # the second load replaces the first
        sinks.reload(table(spark, sf_dir, "customer").select(ids, F.col("c_custkey").alias("chat_id"), F.col("c_name").alias("full_name")), path)
    sinks.append(table(spark, sf_dir, "supplier").select(ids, F.col("s_suppkey").alias("chat_id"), F.col("s_name").alias("full_name")), path)
    return readers.documents(spark, path)


@query(
    f"""SELECT "Job Title" AS job_title, "Company Name" AS company_name, "Experience" AS experience, "Job Description" AS job_description, concat(p_brand, '|', p_type, '/b,c') AS skills
FROM ({_RAW})"""
)
def json_array_read(spark, sf_dir):
    """A captured source of several array files; absent keys are null."""
    path = scratch(spark, "instahyre")
    rows = _postings(spark, sf_dir).withColumnsRenamed(clean.RENAMES)
    sinks.json_arrays(rows.select(*[f.name for f in RAW["instahyre"].fields]), path, "job_link")
    rows = readers.source(spark, "instahyre", [path, path + "_gone"]).filter("_corrupt_record IS NULL")
    return rows.select("job_title", "company_name", "experience", "job_description", F.array_join("skills", "|").alias("skills"))


_OTHERS = ("linkedin", "cuvette", "goldman", "ather", "krutrim", "moneyview")


def _other_sql(source: str) -> str:
    values = " || '|' || ".join("'list,of,' || p_size" if n == "skills" else f"'{n}-' || p_partkey" for n in RAW[source].names)
    return f"SELECT '{source}' AS source, {values} AS fields FROM part"


@query(" UNION ALL ".join(map(_other_sql, _OTHERS)))
def captured_sources(spark, sf_dir):
    """The other sources, each with all of its own columns."""
    out = None
    for source in _OTHERS:
        path = scratch(spark, source)
        columns = [F.array(F.lit("list"), F.lit("of"), F.col("p_size").cast("string")).alias(f.name) if f.name == "skills" else F.concat(F.lit(f.name + "-"), "p_partkey").alias(f.name) for f in RAW[source].fields]
        sinks.json_arrays(table(spark, sf_dir, "part").select(*columns), path, RAW[source].fields[0].name)
        rows = readers.source(spark, source, path).filter("_corrupt_record IS NULL")
        fields = [F.array_join("skills", ",") if f.name == "skills" else F.col(f"`{f.name}`") for f in RAW[source].fields]
        rows = rows.select(F.lit(source).alias("source"), F.concat_ws("|", *fields).alias("fields"))
        out = rows if out is None else out.union(rows)
    return out


@query(
    """SELECT p_partkey % 4 AS part, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1 AS seq, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS job_title,
CASE WHEN p_partkey % 7 = 0 THEN concat('{"job_title": ', p_name, ', "part": ', p_partkey % 4, '}') END AS reject FROM part"""
)
def json_rejects(spark, sf_dir):
    """Arrays in which every seventh element is malformed: it is a reject of its own, the others are rows with their places in the file."""
    path = scratch(spark, "broken")
    p = table(spark, sf_dir, "part").withColumn("part", (F.col("p_partkey") % 4).cast("int"))
    sound = F.to_json(F.struct(F.col("p_name").alias("job_title"), F.col("part")))
    broken = F.concat(F.lit('{"job_title": '), "p_name", F.lit(', "part": '), "part", F.lit("}"))
    rows = p.select("part", "p_partkey", F.when(F.col("p_partkey") % 7 > 0, sound).otherwise(broken).alias("value"))
    json_files.write_arrays(rows.repartitionById(4, "part").sortWithinPartitions("p_partkey").select("value"), path)
    back = readers.json_array(spark, path, T.StructType([T.StructField("job_title", T.StringType()), T.StructField("part", T.LongType())]))
    of_reject = F.regexp_extract("_corrupt_record", r'"part": (\d)', 1).try_cast("long")
    bad = F.col("_corrupt_record").isNotNull()
    return back.select(F.coalesce(F.when(~bad, F.col("part")), of_reject).alias("part"), "seq", F.when(~bad, F.col("job_title")).alias("job_title"), F.col("_corrupt_record").alias("reject"))


@query("SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS seq, o_orderkey, o_orderstatus FROM orders")
def json_dump(spark, sf_dir):
    """All results as one array in a stated order, and read back with their places."""
    path = scratch(spark, "dump")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"))
    sinks.json_array(orders, path, ["age", "o_orderkey"])
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())])
    return readers.numbered_array(spark, path, schema)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events")
def json_lines_dump(spark, sf_dir):
    """Results with times as JSON lines."""
    path = scratch(spark, "lines")
    sinks.json(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), path)
    return spark.read.schema("event_id long, ts timestamp").json(path).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("SELECT concat('é', p_partkey) AS line, CASE WHEN p_partkey % 2 = 0 THEN 'utf-8' ELSE 'latin-1' END AS encoding FROM part")
def decoded_files(spark, sf_dir):
    """Files in UTF-8, and those that aren't in Latin-1."""
    path = scratch(spark, "encodings")
    for rest, name in enumerate(("UTF-8", "ISO-8859-1")):
        lines = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 2 == rest).select(F.concat(F.lit("é"), "p_partkey"))
        lines.write.option("encoding", name).csv(f"{path}/{name}")
    files = readers.fallback_text(spark, f"{path}/*/*.csv")
    return files.select(F.explode(F.split(F.rtrim(F.col("text"), F.lit("\n")), "\n")).alias("line"), "encoding").filter("line != ''")


@query(f"""SELECT "Job Title" AS job_title, "Salary" AS salary, "Job Description" AS job_description, 2 AS n_skills FROM ({_RAW})""")
def envelope_read(spark, sf_dir):
    """Files that hold their postings under a key."""
    path = scratch(spark, "naukri")
    sinks.json_arrays(_postings(spark, sf_dir).drop("p_partkey"), path, "Job Link", envelope="job_listings")
    rows = readers.source(spark, "naukri", path)
    return rows.select(F.col("Job Title").alias("job_title"), F.col("Salary").alias("salary"), F.col("Job Description").alias("job_description"), F.size("Skills").alias("n_skills"))


@query("""SELECT concat(p_name, ', "', p_brand, '"', chr(10), 'Inc') AS company, CASE WHEN p_size % 4 > 0 THEN p_type END AS title, concat('[', p_brand, ', x]') AS skills FROM part""")
def csv_read(spark, sf_dir):
    """Quoted fields with commas, quotes and newlines."""
    values = {"Company Name": "concat(p_name, ', \"', p_brand, '\"', chr(10), 'Inc')", "Job Title": "CASE WHEN p_size % 4 > 0 THEN p_type END", "Skills": "concat('[', p_brand, ', x]')"}
    path = scratch(spark, "cuvette")
    rows = table(spark, sf_dir, "part").select(*[F.expr(values.get(f.name, "CAST(p_size AS STRING)")).alias(f.name) for f in RAW["cuvette_csv"].fields])
    sinks.csv(rows, path)
    return readers.source(spark, "cuvette_csv", path).select(F.col("Company Name").alias("company"), F.col("Job Title").alias("title"), F.col("Skills").alias("skills"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS ip, CAST(p_size AS VARCHAR) AS port FROM part WHERE p_partkey % 3 = 0")
def delimited_read(spark, sf_dir):
    """Lines of four fields; lines of three or five are dropped."""
    path = scratch(spark, "config")
    tail = F.expr("CASE p_partkey % 3 WHEN 0 THEN ':user:word' WHEN 1 THEN ':user' ELSE ':user:word:more' END")
    table(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(":"), "p_size", tail).alias("value")).write.text(path)
    return readers.delimited(spark, path, ["ip", "port", "username", "password"]).select("ip", "port")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS job_indx, o_orderstatus AS status FROM orders")
def nested_csv_round_trip(spark, sf_dir):
    """The metadata of all users' recommendations as CSV."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chat_id"), F.col("o_orderkey").alias("job_indx"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("rank"))
    path = scratch(spark, "metadata")
    sinks.nested_csv(recommend.as_documents(rows, "status", ["job_indx", "status"]), path)
    return spark.read.option("header", True).csv(path)


@query("""SELECT p_name AS "Job", CASE WHEN position('red' IN p_name) > 0 THEN 'red' END AS "left", CASE WHEN position('ring' IN p_name) > 0 THEN 'ring' END AS "right" FROM part""")
def comparison_round_trip(spark, sf_dir):
    """Two extractors' results side by side."""
    left, right = (F.array_join(extract.skills(F.col("p_name"), [word]), ",").alias(word) for word in ("red", "ring"))
    path = scratch(spark, "comparison")
    sinks.comparison_csv(table(spark, sf_dir, "part").select("p_name", left, right), path, "p_name", "red", "ring")
    # An empty string is quoted in the file, and no result here.
    rows = spark.read.option("header", True).csv(path)
    return rows.select("Job", F.when(F.col("left") != "", F.col("left")).alias("left"), F.when(F.col("right") != "", F.col("right")).alias("right"))


_DATES = "CASE event_id % 5 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '' WHEN 2 THEN '2023-02-29' WHEN 3 THEN 'soon' END"


@query(
    f"""SELECT event_id, strftime(TRY_CAST(nullif(d, '') AS DATE), '%Y-%m-%d') AS posted, CASE WHEN coalesce(d, '') <> '' AND TRY_CAST(d AS DATE) IS NULL THEN concat('bad date: ', d) END AS error
FROM (SELECT event_id, {_DATES} AS d FROM events)"""
)
def load_with_rejects(spark, sf_dir):
    """Rows with malformed dates go to a table of their own."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_DATES).alias("Posted_date"))
    good, bad = merge.valid_and_rejected(rows)
    paths = scratch(spark, "good"), scratch(spark, "rejects")
    sinks.load_with_rejects(good, bad, *paths)
    back = [spark.read.parquet(p) for p in paths]
    posted = F.date_format(text.posted_date(F.col("Posted_date")), "yyyy-MM-dd").alias("posted")
    return back[0].select("event_id", posted, F.lit(None).cast("string").alias("error")).union(back[1].select("event_id", posted, "error"))


@query(
    "SELECT c_custkey AS chat_id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 > 0"
)
def upsert_sink(spark, sf_dir):
    """Delete by key and insert, in a table on disk; a key without new rows is left with none."""
    path = scratch(spark, "results")
    sinks.upsert_by_key(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat_id"), F.col("c_name").alias("name")), path)
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chat_id"), F.col("s_name").alias("name"))
    sinks.upsert_by_key(new.filter("chat_id % 4 > 0"), path, keys=new)
    return tables.read(spark, path)


@query(
    """SELECT 0 AS version, c_custkey AS chat_id, c_name AS name FROM customer UNION ALL SELECT 1, c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 1, s_suppkey, s_name FROM supplier"""
)
def upsert_versions(spark, sf_dir):
    """Keys of another type, and both versions of the table as they were published."""
    path, out = scratch(spark, "versions"), None
    tables.upsert(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat_id"), F.col("c_name").alias("name")), path)
    tables.upsert(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("chat_id"), F.col("s_name").alias("name")), path)
    for version in tables.versions(spark, path):
        rows = tables.read(spark, path, version).select(F.lit(version).alias("version"), "chat_id", "name")
        out = rows if out is None else out.union(rows)
    return out


_BATCH = "CAST(floor(event_id * 4 / (SELECT max(event_id) + 1 FROM events)) AS INT)"


@query(f"SELECT user_id, event_id FROM (SELECT user_id, event_id, {_BATCH} AS batch, max({_BATCH}) OVER (PARTITION BY user_id) AS last FROM events) WHERE batch = last")
def upserted_stream(spark, sf_dir):
    """Four files, a batch each: a user's rows of a batch replace those of the batches before."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    folder, path = scratch(spark, "batches"), scratch(spark, "latest")
    most = events.agg(F.max("event_id")).first()[0] + 1
    for batch in range(4):
        events.filter(F.floor(F.col("event_id") * 4 / most) == batch).coalesce(1).write.parquet(f"{folder}/{batch}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    streams.upsert(stream, path, scratch(spark, "latest_checkpoint"), "user_id").awaitTermination()
    return tables.read(spark, path)


@query(
    f"""WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
items AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 10 <> 3 UNION ALL SELECT vec_id, q.embedding FROM embeddings, q WHERE vec_id % 10 = 3)
SELECT vec_id, {catalog._D2.format(a="items.embedding", b="q.embedding")} AS d2 FROM items, q ORDER BY d2, vec_id LIMIT 2"""
)
def upsert_then_nearest(spark, sf_dir):
    """Vectors saved and loaded, some replaced by id, and the two nearest of what is there."""
    path = scratch(spark, "vectors")
    sinks.vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    query_vector = catalog._first_vector(spark, sf_dir)
    same = F.array(*[F.lit(float(x)) for x in query_vector]).cast("array<float>").alias("embedding")
    new = table(spark, sf_dir, "embeddings").filter("vec_id % 10 = 3").select("vec_id", same)
    return vectors.upserted_nearest(spark.read.parquet(path), new, query_vector).drop("rank")


@query("SELECT event_id, event_type FROM events")
def accumulated_stream(spark, sf_dir):
    """A table that grows by the files that come; a second run finds none that is new."""
    schema = table(spark, sf_dir, "events").schema
    paths = scratch(spark, "pages"), scratch(spark, "pages_checkpoint")
    for _ in range(2):
        stream = streams.events(spark, sf_dir, schema, "events.parquet").select("event_id", "event_type")
        streams.accumulate(stream, *paths).awaitTermination()
    return spark.read.parquet(paths[0])


# Recipes and flows

_CLEAN = r"trim(regexp_replace({}, '[^a-zA-Z0-9]+', ' ', 'g'))"


def _recipe_sql(source: str, skills: str, bounds: tuple[str, str], needs: bool, from_skills: bool, clean_place: bool, first_line: bool) -> str:
    company = 'split_part("Company Name", chr(10), 1)' if first_line else '"Company Name"'
    place = _CLEAN.format('"Location"') if clean_place else '"Location"'
    return f"""SELECT p_partkey, job_title, company_name, location, job_description, skills, concat(job_title, ' ', company_name, ' ', exp_text, ' ', location) AS id,
concat(job_title, ' ', company_name, ' ', {"skills" if from_skills else "coalesce(job_description, 'None')"}, ' ', location) AS text, '2024-05-06' AS posted, '{source}' AS source, {bounds[0]} AS lo,
CASE WHEN isinf({bounds[1]}) THEN 'inf' ELSE CAST(CAST(trunc({bounds[1]}) AS INTEGER) AS VARCHAR) END AS hi
FROM (SELECT p_partkey, {_CLEAN.format('"Job Title"')} AS job_title, {_CLEAN.format(company)} AS company_name, {place} AS location, {_CLEAN.format('"Job Description"')} AS job_description,
  {skills} AS skills, "Experience" AS exp_text FROM ({_RAW}) {'WHERE "Job Description" IS NOT NULL' if needs else ''})"""


_LIST, _TEXT = "concat(p_brand, ' ', p_type, '/b,c')", "replace(replace(concat(p_brand, ' ', p_type, '/b,c'), '/', ' '), ',', ' ')"
_RECIPES = {
    "cuvette": _recipe_sql("cuvette", _TEXT, catalog._A, True, True, True, False), "linkedin": _recipe_sql("linkedin", _LIST, catalog._A, True, False, True, False),
    "instahyre": _recipe_sql("instahyre", _LIST, catalog._B, True, True, True, False), "naukri": _recipe_sql("naukri", _LIST, catalog._N, False, False, False, True),
}


def _cleaned(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    rows = _postings(spark, sf_dir)
    if source == "cuvette":  # skills are one string there
        rows = rows.withColumn("Skills", F.array_join("Skills", " "))
    rows = clean.cleaned(rows, clean.RECIPES[source], "2024-05-06")
    hi = F.when(F.col("yoe.hi") == float("inf"), "inf").otherwise(F.col("yoe.hi").cast("int").cast("string"))
    return rows.select(
        "p_partkey", "job_title", "company_name", "location", "job_description", "skills", "id", "text",
        F.col("Posted_date").cast("string").alias("posted"), F.col("Source").alias("source"), F.col("yoe.lo").alias("lo"), hi.alias("hi"),
    )


@query(_RECIPES["cuvette"])
def cleaned_cuvette(spark, sf_dir):
    return _cleaned(spark, sf_dir, "cuvette")


@query(_RECIPES["linkedin"])
def cleaned_linkedin(spark, sf_dir):
    return _cleaned(spark, sf_dir, "linkedin")


@query(_RECIPES["instahyre"])
def cleaned_instahyre(spark, sf_dir):
    return _cleaned(spark, sf_dir, "instahyre")


@query(_RECIPES["naukri"])
def cleaned_naukri(spark, sf_dir):
    return _cleaned(spark, sf_dir, "naukri")


_UNION = " UNION ALL ".join(f"SELECT {i} AS file_rank, id, text, source, job_description, p_partkey FROM ({_RECIPES[s]})" for i, s in ((0, "linkedin"), (2, "instahyre"), (3, "naukri")))


def _captured(spark: SparkSession, sf_dir: str) -> dict:
    """Sources of which every row is there twice, with its place in the file; one source is missing."""
    rows = _postings(spark, sf_dir).withColumnRenamed("p_partkey", "seq")
    return {"linkedin": rows.union(rows), "cuvette": None, "instahyre": rows.union(rows), "naukri": rows.union(rows)}


@query(f"SELECT id, text, source, job_description, 'N/A' AS job_type, row_number() OVER (ORDER BY file_rank, p_partkey) - 1 AS job_indx FROM ({_UNION})")
def ingest_flow(spark, sf_dir):
    """Clean, drop equal rows, union, defaults, dense numbers."""
    rows = flows.ingest(_captured(spark, sf_dir), "2024-05-06")
    return rows.select("id", "text", F.col("Source").alias("source"), "job_description", "job_type", "job_indx")


@query(f"SELECT id, 2 * count(*) AS n FROM ({_RECIPES['linkedin']}) GROUP BY id")
def ingest_files(spark, sf_dir):
    """Two files with the same rows, each of them twice: equal rows are dropped within a file and kept across files."""
    rows, path = _postings(spark, sf_dir).drop("p_partkey"), scratch(spark, "files")
    for name in ("one", "two"):
        sinks.json_array(rows.union(rows), f"{path}/{name}")
    captured = readers.json_array(spark, [f"{path}/one", f"{path}/two"], rows.schema).filter("_corrupt_record IS NULL")
    found = flows.ingest({"linkedin": captured.drop("_corrupt_record", "seq")}, "2024-05-06")
    return found.groupBy("id").agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_rank, p_partkey) AS n FROM ({_UNION}))
SELECT id, source, row_number() OVER (ORDER BY file_rank, p_partkey) - 1 AS job_indx FROM r WHERE n = 1"""
)
def ingest_across_sources(spark, sf_dir):
    """The same, and of equal ids of all sources only the first."""
    return flows.ingest(_captured(spark, sf_dir), "2024-05-06", across_sources=True).select("id", F.col("Source").alias("source"), "job_indx")


@query("SELECT DISTINCT role, turn, CAST(length(text) % 7 AS BIGINT) AS part FROM conversations")
def dedup_nested(spark, sf_dir):
    """Equal rows with arrays and structs."""
    rows = table(spark, sf_dir, "conversations").select(F.array("role", F.lit("x")).alias("a"), F.struct("turn", F.array((F.length("text") % 7).cast("long")).alias("n")).alias("s"))
    return dedup.full_row(rows).select(F.col("a")[0].alias("role"), F.col("s.turn").alias("turn"), F.col("s.n")[0].alias("part"))


@query(catalog._RECOMMENDED + "SELECT chat_id, vec_id, d2, rank FROM ranked WHERE rank <= 10 AND chat_id % 3 > 0")
def updated_recommendations(spark, sf_dir):
    """Stored recommendations of all users, then of some for whom nothing fits any more; the first page of what is stored."""
    users, jobs, path = catalog._users(spark, sf_dir), catalog._jobs(spark, sf_dir), scratch(spark, "recommended")
    flows.update(users, jobs, path)
    nobody = jobs.withColumn("yoe", F.struct(F.lit(900.0).alias("lo"), F.lit(999.0).alias("hi")))
    flows.update(users.filter("chat_id % 3 = 0"), nobody, path)
    return recommend.page(recommended.read(spark, path, most=recommend.PAGE), 0).select("chat_id", "vec_id", "d2", F.col("rank").cast("long").alias("rank"))


_PEOPLE = {
    "chat_id": "CAST(c_custkey AS {s})", "email": "CASE WHEN c_custkey % 4 = 0 THEN 'no address' ELSE concat('u', c_custkey, '@example.org') END",
    "years_of_experience": "CASE WHEN c_custkey % 5 = 0 THEN 'many' ELSE CAST(c_nationkey AS {s}) END",
}


@query(
    "SELECT CAST(chat_id AS BIGINT) AS chat_id, TRY_CAST(years_of_experience AS DOUBLE) AS years, email <> 'no address' AND years_of_experience <> 'many' AS stored FROM (SELECT "
    + ", ".join(f"{sql.format(s='VARCHAR')} AS {name}" for name, sql in _PEOPLE.items())
    + " FROM customer)"
)
def register_flow(spark, sf_dir):
    """Valid registrations are stored, the others come back."""
    path = scratch(spark, "registered")
    people = table(spark, sf_dir, "customer").select(*[F.expr(sql.format(s="STRING")).alias(name) for name, sql in _PEOPLE.items()])
    back = flows.register(people, path)
    years = F.col("years_of_experience").alias("years")
    return spark.read.parquet(path).select("chat_id", years, F.lit(True).alias("stored")).union(back.select("chat_id", years, F.lit(False)))


@query(
    """SELECT o_custkey AS chat_id, o_orderkey AS job_indx, concat('Write a cover letter for this posting: {"job_title":"', o_orderpriority, '"}', chr(10), 'Use only facts of this resume, at most 4096 characters: {"Name":"', c_name, '"}') AS prompt
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0"""
)
def mail_flow(spark, sf_dir):
    """The prompts of the requests whose job and user are there."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chat_id"), F.col("o_orderkey").alias("job_indx"), F.col("o_orderpriority").alias("job_title"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat_id"), F.struct(F.col("c_name").alias("Name")).alias("resume_json"))
    return flows.mail(orders.select("chat_id", "job_indx"), orders.filter("job_indx % 2 = 0"), people, "cover_letter")


def _posting_model():
    """Stands in for a language model: an object with noise around it, or words that are none."""

    def answer(prompt: str) -> str:
        name, brand = prompt.split("|")
        return f"No result.\nSorry, {name}" if len(name) % 4 == 0 else f"Sure:\n{json.dumps({'Job Title': name, 'Skills': [brand, 'x'], 'Salary': None})} Done"

    return lambda prompts: [answer(p) for p in prompts]


@query(
    """SELECT p_partkey, CASE WHEN length(p_name) % 4 > 0 THEN p_name END AS job_title, CASE WHEN length(p_name) % 4 > 0 THEN concat(p_brand, ', x') END AS skills, CAST(NULL AS VARCHAR) AS salary,
length(p_name) % 4 = 0 AS failed, CASE WHEN length(p_name) % 4 = 0 THEN concat('No result.', chr(10), 'Sorry, ', p_name) END AS raw_text FROM part"""
)
def structured_postings(spark, sf_dir):
    """Fields from a model's answers; what is no object is an error with the answer's text."""
    prompts = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("|"), "p_brand").alias("prompt"))
    found = extract.structured(prompts, "p_partkey", "prompt", _posting_model)
    return found.select("p_partkey", F.col("Job Title").alias("job_title"), F.col("Skills").alias("skills"), F.col("Salary").alias("salary"), F.col("error").isNotNull().alias("failed"), "raw_text")


def _resume_model():
    def answer(name: str) -> str:
        n = len(name)
        school = {"institution": name, "cgpa/percentage": f"{n}.5"} if n % 2 else {"institution": name, "cgpa": "8"}
        return json.dumps({"Name": name, "Skills": name.split(" "), "Education": [school], "professional_experience": [{"company": "c", "technologies": ["t"] * (n % 3)}]})

    return lambda prompts: [answer(p) for p in prompts]


@query(
    """SELECT p_partkey, p_name AS name, len(string_split(p_name, ' ')) AS n_skills, length(p_name) % 3 AS n_technologies,
CASE WHEN length(p_name) % 2 = 0 THEN '8' WHEN length(p_name) + 0.5 <= 10 THEN concat(length(p_name), '.5') END AS cgpa,
CASE WHEN length(p_name) % 2 = 1 AND length(p_name) + 0.5 > 10 THEN concat(length(p_name), '.5') END AS percentage FROM part"""
)
def resume_entities(spark, sf_dir):
    """Nested resumes from a model's answers."""
    found = extract.resumes(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", _resume_model)
    school = F.col("resume.Education")[0]
    return found.select(
        "p_partkey", F.col("resume.Name").alias("name"), F.size("resume.Skills").cast("long").alias("n_skills"),
        F.size(F.col("resume.professional_experience")[0]["technologies"]).cast("long").alias("n_technologies"), school["cgpa"].alias("cgpa"), school["percentage"].alias("percentage"),
    )


# Pages and small operators

_CARD = """concat('<ul><li class="card big"><h3 class="', CASE WHEN p_size % 2 = 0 THEN 'title' ELSE 'title-old' END, '">', p_brand, ' <b>', p_size, '</b></h3>',
CASE WHEN p_partkey % 5 > 0 THEN concat('<a class="link" href="/job/', p_partkey, '">go</a>') ELSE '' END, '<script>var p = "</p>";</script>',
CASE WHEN p_partkey % 3 > 0 THEN '<span class="place">here</span>' ELSE '' END, '</li><li class="other"><h3 class="title">no card</h3></li></ul>')"""


@query(
    """SELECT p_partkey, 0 AS position, concat(p_brand, chr(10), p_size) AS title, concat('/job/', p_partkey) AS link, CASE WHEN p_partkey % 3 > 0 THEN 'here' END AS place
FROM part WHERE p_partkey % 5 > 0"""
)
def card_parts(spark, sf_dir):
    """Cards of several parts with fallback class names; a card without a link is skipped."""
    pages = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.expr(_CARD).alias("html"))
    parts = {"title": html.Part("h3", ("title-new", "title", "title-old")), "link": html.Part("a", ("link",), "href"), "place": html.Part(None, ("place",))}
    return html.card_rows(pages, "html", ["p_partkey"], html.Part("li", ("card",)), parts, ("title", "link"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'here' ELSE 'Not available' END AS place FROM part")
def text_of_class(spark, sf_dir):
    """The first element of a class, or a sentinel."""
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", html.text_of_class("place")(F.expr(_CARD)).alias("place"))


@query("SELECT p_partkey, p_type AS bare, concat(p_brand, ' ', p_type) AS joined FROM part")
def small_text(spark, sf_dir):
    """Icon glyphs removed, lists joined."""
    glyphs = F.concat(F.lit(" "), "p_type", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_glyphs(glyphs).alias("bare"), text.join_array(F.array("p_brand", "p_type")).alias("joined"))


@query("SELECT p_partkey, concat('*', p_name, '* at *', p_brand, '*', chr(10), 'Location: None', chr(10), 'Experience: ', p_size, chr(10), '[Apply here](https://x/', p_partkey, ')') AS card FROM part")
def markdown_card(spark, sf_dir):
    values = {"job_title": F.col("p_name"), "company_name": F.col("p_brand"), "location": F.lit(None), "experience": F.col("p_size"), "job_link": F.concat(F.lit("https://x/"), "p_partkey")}
    return table(spark, sf_dir, "part").select("p_partkey", text.job_card_markdown(values.get).alias("card"))


@query("SELECT p_partkey, concat('https://x/?q=', p_size, '&start=', n) AS url FROM part, range(0, 110, 25) t(n)")
def offset_pages(spark, sf_dir):
    """Result pages of 25 rows until 110 are there."""
    urls = text.offset_urls(F.concat(F.lit("https://x/?q="), "p_size"), 110)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(urls).alias("url"))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20")
def newest_first(spark, sf_dir):
    """The first rows of a source that is sorted by date."""
    return recommend.newest_first(table(spark, sf_dir, "orders"), 20, "o_orderdate", ("o_orderkey",)).select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) IN ('1-urgent', '5-low')")
def site_slice(spark, sf_dir):
    """The rows that a site's filters leave."""
    return clean.site_slice(table(spark, sf_dir, "orders"), o_orderstatus="f", o_orderpriority=["1-URGENT", "5-Low"]).select("o_orderkey")


@query("SELECT o_orderkey, 'F' AS site FROM orders WHERE o_orderstatus = 'F' AND o_orderkey >= 2500 AND o_orderkey < 7300")
def captured_slice(spark, sf_dir):
    """Captured pages of one site from one offset to another; folders of other sites and offsets are pruned."""
    path = scratch(spark, "captured")
    captured.store(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("site"), F.col("o_orderkey").alias("start"), "o_orderpriority"), path)
    return captured.site_pages(spark, path, "F", 2500, 7300).select(F.col("start").alias("o_orderkey"), "site")


_RESULT_PAGE = """concat('<ul><li><div class="base-card x"><a class="base-card__full-link" href="https://j/', p_partkey, '">go</a><h3 class="base-search-card__title"> ', p_name, '</h3>',
CASE WHEN p_partkey % 9 > 0 THEN concat('<h4 class="base-search-card__subtitle">', p_brand, '</h4>') ELSE '' END, '<span class="job-search-card__location">', p_type, '</span></div></li></ul>')"""


@query(
    """WITH cards AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place FROM part WHERE p_partkey % 9 > 0)
SELECT CAST(p_size AS VARCHAR) AS search, p_name AS title, p_brand AS company, p_type AS location, concat('https://j/', p_partkey) AS link,
CASE p_partkey % 4 WHEN 0 THEN 'Failed to load job description' WHEN 1 THEN 'Job description not found' ELSE concat(p_name, chr(10), 'for ', p_brand) END AS description FROM cards WHERE place <= 3"""
)
def linkedin_recipe(spark, sf_dir):
    """Cards of result pages, the first three of a search, with the texts of their detail pages."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    results = p.select(F.col("p_size").cast("string").alias("search"), F.col("p_partkey").alias("start"), F.expr(_RESULT_PAGE).alias("html"))
    body = F.concat(F.lit('<div class="'), F.when(F.col("p_partkey") % 4 == 1, "other").otherwise(captured.LINKEDIN_DETAIL), F.lit('"><p>'), "p_name", F.lit("</p> for "), "p_brand", F.lit("</div>"))
    details = p.filter("p_partkey % 4 > 0").select(F.concat(F.lit("https://j/"), "p_partkey").alias("url"), body.alias("html"))
    return captured.linkedin(results, details, most=3)


@query("SELECT 'loaded' AS stage, count(*) AS n_rows, count(lang) AS n_lang, true AS took_time FROM documents UNION ALL SELECT 'distinct', count(*), count(lang), true FROM (SELECT DISTINCT * FROM documents)")
def timed_stages(spark, sf_dir):
    """Rows, values and seconds of each stage, noted while it is written; the seconds themselves differ from run to run."""
    run = profile.Run(spark)
    loaded = run.stage("loaded", table(spark, sf_dir, "documents"), F.count("lang").alias("n_lang"))
    run.stage("distinct", dedup.full_row(loaded), F.count("lang").alias("n_lang"))
    return run.report().select("stage", "n_rows", F.col("noted")["n_lang"].cast("long").alias("n_lang"), (F.col("seconds") > 0).alias("took_time"))


_SKILLS = ("the of", "of the", "of", "and the", "by the for", "und der", "der", "de la", "la", "le la de", "and", "and of the")
_ALTERNATIVES = "|".join(s.replace(" ", "  ") for s in sorted(_SKILLS, key=len, reverse=True))


@query(
    rf"""SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(found), lambda x: (list_position(found, x), x))), lambda x: replace(x[2], '  ', ' ')), ',') AS phrases
FROM (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '([^\p{{L}}\p{{N}}])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}])({_ALTERNATIVES})(?:$|[^\p{{L}}\p{{N}}])', 1) AS found FROM documents)"""
)
def phrase_match(spark, sf_dir):
    """Known phrases of one and several words in whole texts, the longest at each place."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(extract.skills(F.col("text"), _SKILLS), ",").alias("phrases"))


# The registration dialogue

_IDLE = 8 * 3600
_MESSAGE_SQL = {
    "chat_id": "user_id", "message_id": "event_id", "ts": "ts",
    "text": "CASE WHEN event_id % 8 = 0 THEN '/start' WHEN event_id % 61 = 1 THEN '/cancel' WHEN event_id % 13 = 2 THEN concat('/edit email e', event_id) ELSE concat('a', event_id) END",
    "mime_type": "CASE WHEN event_id % 8 > 0 AND event_id % 61 <> 1 AND event_id % 13 <> 2 AND event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'application/pdf' ELSE 'image/png' END END",
}


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of their users."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select(*[F.expr(sql).alias(name) for name, sql in _MESSAGE_SQL.items()])


_REGISTRATIONS = f"""WITH m AS (SELECT {", ".join(f"{sql} AS {name}" for name, sql in _MESSAGE_SQL.items())} FROM events),
told AS (SELECT *, string_split(text, ' ')[1] AS command, lead(ts) OVER chat AS next, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER chat) > {_IDLE * 1000000}, false) AS cut
  FROM m WINDOW chat AS (PARTITION BY chat_id ORDER BY ts, message_id)),
numbered AS (SELECT *, sum(CAST(cut OR command = '/start' AS INT)) OVER (PARTITION BY chat_id ORDER BY ts, message_id) AS talk FROM told),
opened AS (SELECT *, first_value(command) OVER w = '/start' AS opened, coalesce(sum(CAST(command NOT IN ('/start', '/cancel', '/edit') AND mime_type IS NULL AS INT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given
  FROM numbered WINDOW w AS (PARTITION BY chat_id, talk ORDER BY ts, message_id)),
ends AS (SELECT *, CASE WHEN command = '/cancel' THEN 'cancelled' WHEN given >= 4 AND mime_type = 'application/pdf' THEN 'registered' END AS ends FROM opened WHERE opened),
live AS (SELECT * FROM ends QUALIFY coalesce(count(ends) OVER (PARTITION BY chat_id, talk ORDER BY ts, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0),
answers AS (SELECT *, CASE WHEN command = '/edit' AND given >= 3 THEN 2 WHEN command NOT IN ('/start', '/cancel', '/edit') AND mime_type IS NULL AND given < 4 THEN given END AS place,
  CASE WHEN command = '/edit' THEN string_split(text, ' ')[3] ELSE text END AS value FROM live),
found AS (SELECT chat_id, talk, {", ".join(f"arg_max(value, (ts, message_id)) FILTER (place = {i}) AS {f}" for i, f in enumerate(dialogue.FIELDS))},
  max(text) FILTER (ends = 'registered') AS resume, max(ends) AS ends, max(ts) AS ts, arg_max(epoch_us(coalesce(next, {{until}})), (ts, message_id)) AS next FROM answers GROUP BY chat_id, talk)
SELECT chat_id, {", ".join(dialogue.FIELDS)}, resume, coalesce(ends, 'given up') AS status, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM found WHERE ends IS NOT NULL OR next - epoch_us(ts) > {_IDLE * 1000000}"""


def _ended(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(_REGISTRATIONS.format(until="NULL"))
def registrations(spark, sf_dir):
    """The dialogues that have ended, in a table of messages."""
    return _ended(dialogue.registrations(_messages(spark, sf_dir), _IDLE))


@query(_REGISTRATIONS.format(until="TIMESTAMP '2100-01-01'"))
def registration_stream(spark, sf_dir):
    """The same from a stream of several files whose messages are out of order within the bound, up to a time at which all open dialogues are given up."""
    messages, folder = _messages(spark, sf_dir), scratch(spark, "messages")
    span = messages.agg(F.min(F.unix_micros("ts")).alias("first"), F.max(F.unix_micros("ts")).alias("last")).first()
    # Every third message comes up to half an hour late, so files overlap in time.
    comes = F.unix_micros("ts") + F.when(F.col("message_id") % 3 == 0, 1_800_000_000).otherwise(0)
    batch = F.floor((comes - span["first"]) * 2 / (span["last"] - span["first"] + 1_800_000_001)).cast("int")
    for i in range(2):
        messages.filter(batch == i).coalesce(1).write.parquet(f"{folder}/{i}")
    end = spark.range(1).select(F.lit(-1).cast("long").alias("chat_id"), F.lit(0).cast("long").alias("message_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit("").alias("text"), F.lit("").alias("mime_type"))
    end.write.parquet(f"{folder}/2")
    stream = spark.readStream.schema(dialogue.MESSAGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    rows = streams.to_table(dialogue.registrations_stream(stream, "1 hour", _IDLE), scratch(spark, "registrations"), scratch(spark, "registrations_checkpoint"))
    return _ended(rows)
