"""Registered queries of the engine and their DuckDB counterparts.

The data folder has no postings, so columns of the tables there stand in for
their fields. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspar.functions import experience, extract, html, text
from marlspar.operators import dedup, merge, profile, ranks, recommend, users, vectors
from marlspar.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from marlspar.session import scratch, table

#: Experience strings that meet every rule, in SQL that Spark and DuckDB both read.
EXP_TEXT = """CASE p_partkey % 16
  WHEN 0 THEN concat(p_size, '-', p_size + 3, ' Years') WHEN 1 THEN concat(p_size, ' - ', p_size + 2, ' Yrs')
  WHEN 2 THEN concat(p_size, '+ years') WHEN 3 THEN concat(p_size, '.5 to ', p_size + 1, '.5 years')
  WHEN 4 THEN concat('less than ', p_size, ' year') WHEN 5 THEN concat('greater than ', p_size, ' years')
  WHEN 6 THEN concat(p_size, ' to ', p_size + 4, ' years') WHEN 7 THEN concat(p_size, ' years')
  WHEN 8 THEN concat('0-', p_size) WHEN 9 THEN concat('', p_size) WHEN 10 THEN concat('0-', p_size, '+ years')
  WHEN 11 THEN concat('1.5-', p_size, '.5 years') WHEN 12 THEN concat('3-', p_size, ' YEARS') WHEN 13 THEN concat(p_size, ' yrs')
  WHEN 14 THEN concat('less than ', p_size, ' Years') ELSE 'Fresher' END"""

_DASHES = {"a": r"\s*-\s*", "b": "-"}


def _oracle_bounds(units: str, short: str, top: str, dash: str, bare: bool, column: str = "exp_text") -> tuple[str, str]:
    """The two bounds as DuckDB expressions."""
    rows = [
        (rf"(\d+){dash}(\d+) ({units})", 1, 2), (rf"(\d+\.\d+) to (\d+\.\d+) ({units})", 1, 2), (rf"(\d+)\+ ({units})", 1, top),
        (rf"less than (\d+) ({short})", "0", 1), (rf"greater than (\d+) ({units})", 1, top), (rf"(\d+) to (\d+) ({units})", 1, 2),
        (rf"(\d+) ({units})", 1, 1),
    ] + ([(r"(\d+)-(\d+)", 1, 2), (r"(\d+)", 1, top)] if bare else [])

    def value(p, b):
        return f"TRY_CAST(regexp_extract({column}, '{p}', {b}) AS DOUBLE)" if isinstance(b, int) else f"CAST('{b}' AS DOUBLE)"

    return tuple(
        "CASE " + " ".join(f"WHEN regexp_matches({column}, '{r[0]}') THEN {value(r[0], r[side])}" for r in rows) + " END" for side in (1, 2)
    )


_A = _oracle_bounds("Years|years|Yrs", "Years|year|years|Yrs", "60", _DASHES["a"], True)
_B = _oracle_bounds("Years|years|Yrs", "Years|year|years|Yrs", "inf", _DASHES["b"], False)
_N = _oracle_bounds("years|Yrs", "year|years|Yrs", "inf", _DASHES["b"], False)


def _experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(EXP_TEXT).alias("exp_text"))


def _bounds(spark: SparkSession, sf_dir: str, family) -> DataFrame:
    rows = _experience(spark, sf_dir).withColumn("yoe", experience.bounds(F.col("exp_text"), family))
    return rows.select("p_partkey", "exp_text", F.col("yoe.lo").alias("lo"), F.when(F.col("yoe.hi") == float("inf"), "inf").otherwise(F.col("yoe.hi").cast("int").cast("string")).alias("hi"))


def _bounds_sql(pair: tuple[str, str]) -> str:
    return f"""WITH e AS (SELECT p_partkey, {EXP_TEXT} AS exp_text FROM part), b AS (SELECT p_partkey, exp_text, {pair[0]} AS lo, {pair[1]} AS hi FROM e)
SELECT p_partkey, exp_text, lo, CASE WHEN isinf(hi) THEN 'inf' ELSE CAST(CAST(trunc(hi) AS INTEGER) AS VARCHAR) END AS hi FROM b"""


# Text


@query("SELECT doc_id, trim(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '[^a-zA-Z0-9]+', ' ', 'g')) AS cleaned FROM documents")
def clean_first_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_first_line(F.col("text")).alias("cleaned"))


@query(r"SELECT doc_id, regexp_replace(text, '\*+', ' ', 'g') AS text, regexp_replace(lang, '\*+', ' ', 'g') AS lang FROM documents")
def strip_asterisks(spark, sf_dir):
    return text.strip_asterisks_everywhere(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("SELECT p_partkey, array_to_string(regexp_split_to_array(concat(p_name, ',', p_brand, '/', p_type), '[/,]'), ' ') AS skills FROM part")
def skills_resplit(spark, sf_dir):
    raw = F.concat("p_name", F.lit(","), "p_brand", F.lit("/"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.resplit_skills(raw).alias("skills"))


@query("SELECT doc_id, CASE WHEN length(text) > 1500 THEN concat(substr(text, 1, 1500), '...') ELSE text END AS shortened FROM documents")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text")).alias("shortened"))


@query(
    """SELECT p_partkey, concat(coalesce(p_name, 'None'), ' ', coalesce(p_brand, 'None'), ' ', coalesce(CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS VARCHAR) END, 'None'), ' ', coalesce(p_type, 'None')) AS id,
concat(p_name, ' ', p_brand, ' ', p_type) AS text FROM part"""
)
def compose_id_text(spark, sf_dir):
    size = F.when(F.col("p_size") % 5 > 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.compose(F.col("p_name"), F.col("p_brand"), size, F.col("p_type")).alias("id"), text.compose(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("text")
    )


@query(r"""SELECT event_id, regexp_extract(replace(concat('answer:', chr(10), props, chr(10), 'done'), chr(10), ' '), '\{.*\}', 0) AS span FROM events""")
def json_repair(spark, sf_dir):
    noisy = F.concat(F.lit("answer:\n"), "props", F.lit("\ndone"))
    return table(spark, sf_dir, "events").select("event_id", text.json_span(noisy).alias("span"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    noisy = F.concat(F.lit("ok "), "props", F.lit(" end"))
    parsed = text.parse_json(noisy, T.StructType([T.StructField("k", T.LongType())]))
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@query(
    """WITH c AS (SELECT event_id, concat(event_type, ':', event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(':', user_id) END) AS c FROM events)
SELECT event_id, split_part(c, ':', 1) AS action, TRY_CAST(split_part(c, ':', 2) AS BIGINT) AS index, TRY_CAST(nullif(split_part(c, ':', 3), '') AS BIGINT) AS chat_id FROM c"""
)
def callback_parts(spark, sf_dir):
    raw = F.concat("event_type", F.lit(":"), "event_id", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit(":"), "user_id")))
    return table(spark, sf_dir, "events").select("event_id", text.callback(raw).alias("c")).select("event_id", "c.*")


@query(
    """SELECT p_partkey, concat('<b>', p_name, '</b>', chr(10), 'Company: ', p_brand, chr(10), 'Experience: ', p_size, chr(10), 'link: <a href=''https://x/', p_partkey,
'''>Apply here</a>', chr(10), 'Location: ', p_type, chr(10), 'Skills: None') AS card FROM part"""
)
def job_card(spark, sf_dir):
    columns = {"job_title": F.col("p_name"), "company_name": F.col("p_brand"), "experience": F.col("p_size"), "job_link": F.concat(F.lit("https://x/"), "p_partkey"), "location": F.col("p_type"), "skills": F.lit(None)}
    return table(spark, sf_dir, "part").select("p_partkey", text.job_card(columns.__getitem__).alias("card"))


@query("SELECT p_partkey, concat(p_name, ' ', p_type, ' ', p_brand, ' Pune') AS query_text FROM part")
def query_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.query_text(F.array("p_name", "p_type"), F.array("p_brand"), "Pune").alias("query_text"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 'About' WHEN i = 2 THEN 'Ideal Candidate' WHEN i = 6 THEN 'Responsibilities: all' ELSE trim(line, ' ') END AS line FROM l)
SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (i IN (3, 4, 5) AND line <> ''), 'Not available') AS section FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id"""
)
def section_between(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, "About").when(i == 1, "Ideal Candidate").when(i == 5, "Responsibilities: all").otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", text.between_markers(lines).alias("section"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
SELECT doc_id, CASE WHEN len(a) > 2 AND trim(a[3], ' ') <> '' THEN trim(a[3], ' ') ELSE 'Not available' END AS section FROM l"""
)
def section_by_heading(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 1, "your responsibilities").otherwise(F.when(i == 0, "-").otherwise(x)))
    first = F.slice(lines, 1, 3)
    return table(spark, sf_dir, "documents").select("doc_id", html.section_text(first, ["RESPONSIBILITIES"]).alias("section"))


# Experience


@query(_bounds_sql(_A))
def yoe_range_a(spark, sf_dir):
    return _bounds(spark, sf_dir, experience.CAPPED)


@query(_bounds_sql(_B))
def yoe_range_b(spark, sf_dir):
    return _bounds(spark, sf_dir, experience.OPEN)


@query(_bounds_sql(_N))
def yoe_range_lower(spark, sf_dir):
    return _bounds(spark, sf_dir, experience.OPEN_LOWER)


@query(
    f"""WITH e AS (SELECT p_partkey, {EXP_TEXT} AS exp_text FROM part), b AS (SELECT p_partkey, {_A[0]} AS lo, {_A[1]} AS hi FROM e)
SELECT p_partkey, coalesce(lo, 0.0::DOUBLE) AS lo, coalesce(hi, 60.0::DOUBLE) AS hi FROM b"""
)
def yoe_text_round_trip(spark, sf_dir):
    rows = _experience(spark, sf_dir).select("p_partkey", experience.with_default(experience.bounds(F.col("exp_text"))).alias("yoe"))
    back = experience.from_text(experience.to_text(F.col("yoe")))
    return rows.select("p_partkey", back["lo"].alias("lo"), back["hi"].alias("hi"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) / 12 AS lo, CASE WHEN p_size > 40 THEN NULL ELSE (p_size + 12) / 12.0::DOUBLE END AS hi FROM part")
def yoe_months(spark, sf_dir):
    literal = F.concat(F.lit("("), "p_size", F.lit(", "), F.when(F.col("p_size") > 40, F.lit(500)).otherwise(F.col("p_size") + 12), F.lit(")"))
    years = experience.months_to_years(text.tuple_of_two(literal))
    return table(spark, sf_dir, "part").select("p_partkey", years["lo"].alias("lo"), F.when(years["hi"] < float("inf"), years["hi"]).alias("hi"))


# Dedup, union, defaults, numbers


@query("SELECT DISTINCT text, lang FROM documents")
def dedup_exact(spark, sf_dir):
    return dedup.full_row(table(spark, sf_dir, "documents").select("text", "lang"))


@query("SELECT doc_id, source, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return dedup.keep_first(docs, ["source", "lang"], ["doc_id"])


@query("SELECT doc_id, copy_no FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS copy_no FROM documents) WHERE copy_no > 1")
def dup_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return dedup.later_copies(docs, ["digest"], ["doc_id"]).select("doc_id", F.col("copy_no").cast("long").alias("copy_no"))


def _three_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    c, s, p = (table(spark, sf_dir, n) for n in ("customer", "supplier", "part"))
    return [
        c.select(F.col("c_custkey").alias("seq"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("job_type"), F.lit("customer").alias("Source")),
        s.select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("company_name"), F.lit("supplier").alias("Source")),
        p.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("job_title"), F.lit(None).cast("string").alias("salary"), F.lit("part").alias("Source")),
    ]


_THREE = """SELECT 0 AS file_rank, c_custkey AS seq, CAST(NULL AS VARCHAR) AS job_title, c_name AS company_name, c_mktsegment AS job_type, 'customer' AS source FROM customer
UNION ALL SELECT 1, s_suppkey, NULL, s_name, NULL, 'supplier' FROM supplier
UNION ALL SELECT 2, p_partkey, p_name, NULL, NULL, 'part' FROM part"""


@query(_THREE)
def union_sources(spark, sf_dir):
    rows = merge.union_sources([_three_sources(spark, sf_dir)[0], *_three_sources(spark, sf_dir)[1:]])
    return rows.select("file_rank", "seq", "job_title", "company_name", "job_type", F.col("Source").alias("source"))


@query(
    """SELECT 'customer' AS source, c_custkey AS seq, 'N/A' AS job_title, c_name AS company_name, c_mktsegment AS job_type, 'N/A' AS salary, 0.0::DOUBLE AS lo, 60.0::DOUBLE AS hi FROM customer
UNION ALL SELECT 'supplier', s_suppkey, 'N/A', s_name, 'N/A', 'N/A', 0.0, 60.0 FROM supplier
UNION ALL SELECT 'part', p_partkey, p_name, 'N/A', 'N/A', NULL, 0.0, 60.0 FROM part"""
)
def default_fill(spark, sf_dir):
    """Defaults stand for columns that a source lacks; its own nulls stay."""
    parts = [merge.with_defaults(df) for df in _three_sources(spark, sf_dir)]
    rows = merge.union_sources(parts)
    return rows.select(F.col("Source").alias("source"), "seq", "job_title", "company_name", "job_type", "salary", F.col("yoe.lo").alias("lo"), F.col("yoe.hi").alias("hi"))


@query(f"SELECT file_rank, seq, row_number() OVER (ORDER BY file_rank, seq) - 1 AS job_indx FROM ({_THREE})")
def job_index(spark, sf_dir):
    return merge.numbered(merge.union_sources(_three_sources(spark, sf_dir))).select("file_rank", "seq", "job_indx")


@query("SELECT count(o_orderkey) AS o_orderkey, count(o_custkey) AS o_custkey, count(o_orderstatus) AS o_orderstatus, count(o_totalprice) AS o_totalprice, count(o_orderdate) AS o_orderdate, count(o_orderpriority) AS o_orderpriority FROM orders")
def column_counts(spark, sf_dir):
    return profile.column_counts(table(spark, sf_dir, "orders"))


@query("SELECT source, count(*) AS n_rows FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    return profile.counts_by(table(spark, sf_dir, "documents"), "source")


@query(r"SELECT max(CASE WHEN regexp_matches(p, '^[0-9]+$') THEN CAST(p AS BIGINT) END) AS max_page FROM (SELECT regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1) AS p FROM pages)")
def max_page(spark, sf_dir):
    parts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"/([^/?#]*)([?#].*)?$", 1).alias("p"))
    return profile.largest_number(parts, "p")


@query("SELECT count(*) AS n_deleted FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def delete_counts(spark, sf_dir):
    return profile.removed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


# Vectors and recommendations


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


_D2 = "round(list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6)"
_KNN = f"""SELECT e.vec_id, {_D2.format(a='e.embedding', b='q.embedding')} AS d2 FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"""


@query(f"SELECT vec_id, d2, row_number() OVER (ORDER BY d2, vec_id) AS rank FROM ({_KNN}) ORDER BY d2, vec_id LIMIT {recommend.K}")
def knn_topk(spark, sf_dir):
    found = vectors.nearest(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), k=recommend.K)
    return found.withColumn("rank", F.col("rank").cast("long"))


_JOBS = f"""jobs AS (SELECT p_partkey AS vec_id, coalesce({_A[0]}, 0) AS lo, coalesce({_A[1]}, 60) AS hi FROM (SELECT p_partkey, {EXP_TEXT} AS exp_text FROM part))"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    yoe = _experience(spark, sf_dir).select(F.col("p_partkey").alias("vec_id"), experience.bounds_or_default(F.col("exp_text")).alias("yoe"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(yoe, "vec_id")


@query(
    f"""WITH {_JOBS}, near AS (SELECT * FROM ({_KNN}) WHERE vec_id IN (SELECT vec_id FROM jobs) ORDER BY d2, vec_id LIMIT {recommend.K})
SELECT vec_id, d2, lo, hi FROM near JOIN jobs USING (vec_id) WHERE 8 BETWEEN lo AND hi"""
)
def knn_then_band(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    near = vectors.nearest(jobs, _first_vector(spark, sf_dir), k=recommend.K).join(jobs.select("vec_id", "yoe"), "vec_id")
    return recommend.band(near, 8.0).select("vec_id", "d2", F.col("yoe.lo").alias("lo"), F.col("yoe.hi").alias("hi"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a user; the vector is that of the embedding with the key modulo the number of embeddings."""
    items = table(spark, sf_dir, "embeddings")
    place = (F.col("c_custkey") % F.lit(items.count())).alias("vec_id")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat_id"), F.col("c_nationkey").cast("double").alias("years"), place)
    return c.join(items.select("vec_id", F.col("embedding").alias("query")), "vec_id").select("chat_id", "years", "query")


_RECOMMENDED = f"""WITH {_JOBS}, items AS (SELECT vec_id, embedding, lo, hi FROM embeddings JOIN jobs USING (vec_id)),
d AS (SELECT u.vec_id AS q, e.vec_id, {_D2.format(a='e.embedding', b='u.embedding')} AS d2 FROM embeddings u, items e WHERE u.vec_id IN (SELECT c_custkey % (SELECT count(*) FROM embeddings) FROM customer)),
near AS (SELECT q, vec_id, d2, row_number() OVER (PARTITION BY q ORDER BY d2, vec_id) AS place FROM d QUALIFY place <= {recommend.K}),
kept AS (SELECT c_custkey AS chat_id, n.vec_id, d2, place FROM customer JOIN near n ON c_custkey % (SELECT count(*) FROM embeddings) = q JOIN jobs j ON j.vec_id = n.vec_id WHERE c_nationkey BETWEEN lo AND hi),
ranked AS (SELECT chat_id, vec_id, d2, row_number() OVER (PARTITION BY chat_id ORDER BY place) AS rank FROM kept)
"""


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recommend.recommend(_users(spark, sf_dir), _jobs(spark, sf_dir), k=recommend.K)
    return found.select("chat_id", "vec_id", "d2", F.col("rank").cast("long").alias("rank"))


@query(_RECOMMENDED + "SELECT chat_id, vec_id, d2, rank FROM ranked")
def recommend_users(spark, sf_dir):
    return _recommended(spark, sf_dir)


@query(_RECOMMENDED + "SELECT chat_id, string_agg(vec_id, ',' ORDER BY rank) AS vec_ids, count(*) AS n FROM ranked GROUP BY chat_id")
def recommend_documents(spark, sf_dir):
    lists = recommend.recommended_lists(_users(spark, sf_dir), _jobs(spark, sf_dir), k=recommend.K)
    docs = recommend.documents_of_lists(lists, lambda x: x["vec_id"].cast("string"), ["vec_id"])
    ids = F.transform("job_recommendation", lambda d: d["page_content"])
    return docs.select("chat_id", F.array_join(ids, ",").alias("vec_ids"), F.size("job_recommendation").cast("long").alias("n"))


@query("SELECT user_id AS chat_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) WHERE rank > 10 AND rank <= 20")
def page_slice(spark, sf_dir):
    return recommend.page(_ranked_events(spark, sf_dir), 10)


@query("SELECT user_id AS chat_id, count(*) AS total, count(*) > 20 AS has_more FROM events GROUP BY user_id")
def has_more(spark, sf_dir):
    return recommend.has_more(_ranked_events(spark, sf_dir), 10)


def _ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("chat_id"), "event_id", "ts")
    return ranks.ranked(events, ["chat_id"], ["ts", "event_id"]).select("chat_id", "event_id", "rank")


@query("SELECT c_custkey AS chat_id, o_orderkey AS job_indx, c_name AS resume, o_orderstatus AS status, l_linenumber FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def mail_context(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    asked = asked.select(F.col("o_custkey").alias("chat_id"), F.col("o_orderkey").alias("job_indx"), "l_linenumber")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chat_id"), F.col("o_orderkey").alias("job_indx"), F.col("o_orderstatus").alias("status"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chat_id"), F.col("c_name").alias("resume"))
    return recommend.mail_context(asked, jobs, people).select("chat_id", "job_indx", "resume", "status", "l_linenumber")


@query("""SELECT p_partkey, concat('Write a short, professional mail to a recruiter about this posting: {"job_title":"', p_name, '"}', chr(10), 'Use only facts of this resume, at most 4096 characters: {"Name":"', p_brand, '"}') AS prompt FROM part""")
def mail_prompt(spark, sf_dir):
    prompt = extract.mail_prompt("cold_mail", F.struct(F.col("p_brand").alias("Name")), F.struct(F.col("p_name").alias("job_title")))
    return table(spark, sf_dir, "part").select("p_partkey", prompt.alias("prompt"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def registered_users(spark, sf_dir):
    return users.registered(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unregistered_users(spark, sf_dir):
    return users.unregistered(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_user(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return users.latest(events, "user_id", [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT c_custkey, c_name AS name, 'old' AS state FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name, 'new' FROM supplier")
def upsert_by_key(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit("old").alias("state"))
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.lit("new").alias("state"))
    return recommend.replaced(old, new, "c_custkey")


# Nested data


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def explode_nested(spark, sf_dir):
    nested = _nested(spark, sf_dir)
    return merge.flattened(nested, "turns", ["conv_id"]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant') AS first_answer, coalesce(bool_or(role = 'assistant'), false) AS answered FROM conversations GROUP BY conv_id")
def filter_nested(spark, sf_dir):
    answer = recommend.first_item("turns", lambda t: t["role"] == "assistant")
    return _nested(spark, sf_dir).select("conv_id", answer["text"].alias("first_answer"), answer.isNotNull().alias("answered"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


@query("SELECT DISTINCT role, turn FROM conversations")
def distinct_items(spark, sf_dir):
    items = _nested(spark, sf_dir).select(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["turn"].alias("turn"))).alias("items"))
    return dedup.distinct_items(items, "items")


# HTML and URLs


@query(r"SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ') END AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ') AS stripped FROM pages"""
)
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.strip(F.col("html")).alias("stripped"))


@query()
def html_cards(spark, sf_dir):
    """Paragraph cards of pages; held against the parser in tests."""
    return html.cards(table(spark, sf_dir, "pages"), "html", ["page_id"], tag="p")


@query(
    r"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query FROM pages"""
)
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.try_parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url(url, F.lit("HOST")).alias("host"), F.try_parse_url(url, F.lit("QUERY")).alias("query")
    )


@query("SELECT page_id, CASE WHEN n > 1 THEN concat(split_part(url, '#', 1), '-', n) ELSE split_part(url, '#', 1) END AS page_url FROM pages, range(1, 11) t(n)")
def url_pages(spark, sf_dir):
    base = F.split("url", "#")[0]
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.page_urls(base, 10)).alias("page_url"))


@query("SELECT p_partkey, concat('https://x/search?keywords=', replace(replace(p_name, '#', '%23'), ' ', '+'), '&location=', replace(p_brand, '#', '%23'), '&f_TPR=r86400') AS url FROM part")
def search_url(spark, sf_dir):
    url = text.url_with("https://x/search?", {"keywords": F.col("p_name"), "location": F.col("p_brand"), "f_TPR": "r86400"})
    return table(spark, sf_dir, "part").select("p_partkey", url.alias("url"))


@query(
    r"""WITH u AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'no address' ELSE concat(lower(replace(c_name, '#', '.')), '@example.org') END AS email,
CASE WHEN c_custkey % 5 = 0 THEN 'many' ELSE CAST(c_nationkey AS VARCHAR) END AS years FROM customer)
SELECT c_custkey AS chat_id, email, TRY_CAST(years AS DOUBLE) AS years_of_experience,
TRY_CAST(years AS DOUBLE) IS NOT NULL AND regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$') AS is_valid FROM u"""
)
def validate_user(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    email = F.when(F.col("c_custkey") % 4 == 0, "no address").otherwise(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org")))
    years = F.when(F.col("c_custkey") % 5 == 0, "many").otherwise(F.col("c_nationkey").cast("string"))
    return users.validated(c.select(F.col("c_custkey").cast("string").alias("chat_id"), email.alias("email"), years.alias("years_of_experience")))


@query("SELECT p_partkey, CASE WHEN position('ring' IN p_name) > 0 AND position('red' IN p_name) > 0 THEN 'red,ring' WHEN position('red' IN p_name) > 0 THEN 'red' WHEN position('ring' IN p_name) > 0 THEN 'ring' ELSE '' END AS skills FROM part")
def skill_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.skills(F.col("p_name"), ["red", "ring"]), ",").alias("skills"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """The streaming dedup run to the end of the table, keys seen once."""
    from marlspar.streaming import streams

    schema = table(spark, sf_dir, "events").schema
    stream = streams.without_repeats(streams.events(spark, sf_dir, schema, "events.parquet"), ["user_id", "event_type"], "ts", "3650 days")
    return streams.to_table(stream.select("user_id", "event_type"), scratch(spark, "seen"), scratch(spark, "seen_checkpoint"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts, event_id LIMIT 1")
def point_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    first = events.agg(F.min("event_type")).first()[0]
    return users.lookup(events, "event_type", first, [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT o_custkey AS chat_id, o_orderkey AS job_indx, o_orderstatus AS status FROM orders QUALIFY o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey)")
def nested_lookup(spark, sf_dir):
    """The recommendation of a job number inside each user's array of documents."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chat_id"), F.col("o_orderkey").alias("job_indx"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("rank"))
    docs = recommend.as_documents(rows, "status", ["job_indx", "status"])
    asked = rows.groupBy("chat_id").agg(F.max("job_indx").alias("asked"))
    found = recommend.recommended_job(docs.join(asked, "chat_id"), F.col("asked"))
    return found.select("chat_id", "document.metadata.*")


@query("SELECT p_partkey, CAST(floor(p_partkey / 10) AS BIGINT) AS batch FROM part")
def batch_slice(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", extract.batch_number(F.col("p_partkey")).cast("long").alias("batch"))


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 20")
def first_n(spark, sf_dir):
    """The first rows in a stated order, as a source's cap takes them."""
    return recommend.first_n(table(spark, sf_dir, "pages").select("page_id", "url"), 20, ["page_id"])


@query("SELECT doc_id, sha256(text) AS vector_id FROM documents")
def content_ids(spark, sf_dir):
    from marlspar.sources import sinks

    return sinks.content_id(table(spark, sf_dir, "documents")).select("doc_id", "vector_id")


@query("SELECT p_partkey, concat('https://x', '/job/', p_partkey) AS link, CASE WHEN p_size % 3 = 0 THEN 'Not specified' ELSE p_type END AS job_type, CASE WHEN trim(p_name, ' ') <> '' AND p_size % 2 = 0 THEN p_name ELSE p_brand END AS title FROM part")
def field_defaults(spark, sf_dir):
    """Missing parts of a card: a sentinel, a fallback, a link with its base."""
    p = table(spark, sf_dir, "part")
    kind = text.default(F.when(F.col("p_size") % 3 != 0, F.col("p_type")))
    title = text.first_present(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" "), F.col("p_brand"))
    return p.select("p_partkey", text.prefixed("https://x", F.concat(F.lit("/job/"), F.col("p_partkey"))).alias("link"), kind.alias("job_type"), title.alias("title"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest postings of every user, the experience band, the first page."""
    return recommend.page(_recommended(spark, sf_dir), 0)
