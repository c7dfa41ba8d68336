import pytest
from pyspark.sql import functions as F

from marlspar.operators import clean, dedup, merge, profile, recommend, users, vectors
from marlspar.plans import flows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_full_row_counts_null_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert rows(dedup.full_row(df)) == [(1, None), (2, "a")]
    assert rows(dedup.full_row(dedup.full_row(df))) == rows(dedup.full_row(df))
    with pytest.raises(ValueError):
        dedup.full_row(df, scope=["file"])


def test_keep_first_is_the_same_however_rows_are_dealt(spark):
    df = spark.createDataFrame([(i % 3, i, f"v{i}") for i in range(60)], "k int, seq int, v string")
    for n in (1, 3, 7):
        assert rows(dedup.keep_first(df.repartition(n), ["k"], ["seq"])) == [(0, 0, "v0"), (1, 1, "v1"), (2, 2, "v2")]
    later = dedup.later_copies(df, ["k"], ["seq"])
    assert later.count() == 57 and later.agg(F.min("copy_no"), F.max("copy_no")).first() == (2, 20)


def test_numbers_are_dense_over_chunks_and_sources(spark):
    a = spark.range(25).select(F.col("id").alias("seq"))
    b = spark.createDataFrame([(5,), (700,), (3,)], "seq long")
    got = merge.numbered(merge.union_sources([a, None, b]), chunk=10).orderBy("file_rank", "seq").collect()
    assert [r.job_indx for r in got] == list(range(28))
    assert [(r.file_rank, r.seq) for r in got[-3:]] == [(2, 3), (2, 5), (2, 700)]


def test_defaults_only_for_missing_columns(spark):
    df = spark.createDataFrame([("t", None, "2024-02-30")], "job_title string, salary string, Posted_date string")
    r = merge.with_defaults(df).first()
    assert (r.job_title, r.salary, r.location, r.Posted_date, tuple(r.yoe)) == ("t", None, "N/A", None, (0.0, 60.0))
    assert merge.with_defaults(df, compat=True).first().yoe is None
    good, bad = merge.valid_and_rejected(df)
    assert good.count() == 0 and bad.first().error == "bad date: 2024-02-30"


def test_ingest(spark):
    naukri = spark.createDataFrame(
        [("Dev*", "Acme\n4.1", "l1", "2-4 Yrs", "Pune, IN", None, ["a", "b"], "f")] * 2,
        "`Job Title` string, `Company Name` string, `Job Link` string, Experience string, Location string, `Job Description` string, Skills array<string>, file string",
    )
    cuvette = spark.createDataFrame(
        [("QA", "B.", "3+ years", "Goa!", "text", "x/y,z"), ("no description", "C", "1", "Goa", None, "")],
        "job_title string, company_name string, years_of_experience string, location string, job_description string, skills string",
    ).withColumn("experience", F.col("years_of_experience"))
    got = flows.ingest({"cuvette": cuvette, "linkedin": None, "naukri": naukri}, "2024-01-02").orderBy("job_indx").collect()
    assert [(r.Source, r.job_title, r.company_name, r.location, r.skills, tuple(r.yoe), r.job_indx) for r in got] == [
        ("cuvette", "QA", "B", "Goa", "x y z", (3.0, 60.0), 0),
        ("naukri", "Dev", "Acme", "Pune, IN", "a b", (2.0, 4.0), 1),
    ]
    assert got[0].id == "QA B 3+ years Goa" and got[0].text == "QA B x y z Goa" and str(got[0].Posted_date) == "2024-01-02"
    assert clean.RECIPES["naukri"].needs_description is False


@pytest.fixture(scope="module")
def jobs(spark):
    data = [(i, [float(i), 0.0], (0.0, float(i % 4))) for i in range(40)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, yoe struct<lo:double,hi:double>")


def test_limit_then_filter(spark, jobs):
    near = vectors.nearest(jobs, [0.0, 0.0], k=8).join(jobs.select("vec_id", "yoe"), "vec_id")
    kept = recommend.band(near, 2.5)
    assert rows(kept.select("vec_id")) == [(3,), (7,)]  # of the 8 nearest, not 8 of all that fit


def test_top_k_is_a_prefix_and_ties_go_by_id(spark, jobs):
    more = [r.vec_id for r in vectors.nearest(jobs, [20.0, 0.0], k=12).orderBy("rank").collect()]
    assert [r.vec_id for r in vectors.nearest(jobs, [20.0, 0.0], k=11).orderBy("rank").collect()] == more[:11]
    assert more[:5] == [20, 19, 21, 18, 22]


def test_many_users_equal_one_by_one(spark, jobs):
    asked = spark.createDataFrame([(1, 2.0, [20.0, 0.0]), (2, 9.0, [0.0, 0.0]), (3, 0.0, [39.0, 1.0])], "chat_id long, years double, query array<float>")
    many = vectors.nearest_to_each(jobs.repartition(3), asked, k=7)
    for chat, query in ((1, [20.0, 0.0]), (2, [0.0, 0.0]), (3, [39.0, 1.0])):
        single = [(r.vec_id, r.d2, r["rank"]) for r in vectors.nearest(jobs, query, k=7).orderBy("rank").collect()]
        assert [(r.vec_id, r.d2, r["rank"]) for r in many.filter(F.col("chat_id") == chat).orderBy("rank").collect()] == single
    found = recommend.recommend(asked, jobs, k=7)
    assert found.filter("chat_id = 2").count() == 0  # an empty result, not an error
    assert recommend.replaced(found.select("chat_id", "vec_id"), spark.createDataFrame([(1, 99)], "chat_id long, vec_id long")).filter("chat_id = 1").count() == 1


@pytest.mark.parametrize("n, sizes, more", [(0, (0, 0), []), (9, (9, 0), [False]), (10, (10, 0), [False]), (11, (10, 1), [True])])
def test_pages(spark, n, sizes, more):
    df = spark.createDataFrame([(1, i + 1) for i in range(n)], "chat_id long, rank int")
    assert (recommend.page(df, 0).count(), recommend.page(df, 10).count()) == sizes
    assert [r.has_more for r in recommend.has_more(df, 0).collect()] == more


def test_documents_and_mail(spark):
    recommended = spark.createDataFrame([(1, 2, "b", 7), (1, 1, "a", 5)], "chat_id long, rank int, text string, job_indx long")
    docs = recommend.as_documents(recommended, "text", ["job_indx"])
    assert [d.page_content for d in docs.first().job_recommendation] == ["a", "b"]
    assert recommend.recommended_job(docs, 7).first().document.page_content == "b"
    assert recommend.recommended_job(docs, 8).first().document is None
    people = spark.createDataFrame([(1, ("x",))], "chat_id long, resume_json struct<Name:string>")
    asked = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "chat_id long, job_indx long")
    got = flows.mail(asked, recommended.withColumn("job_title", F.col("text")), people).collect()
    assert len(got) == 1 and '"job_title":"b"' in got[0].prompt and '"Name":"x"' in got[0].prompt


def test_users(spark):
    df = spark.createDataFrame([("1", "a@b.co", "2.5"), ("x", "a@b.co", "1"), ("2", "a@b", "1"), ("3", None, "y")], "chat_id string, email string, years_of_experience string")
    assert rows(users.validated(df).select("chat_id", "years_of_experience", "is_valid")) == [(1, 2.5, True), (2, 1.0, False), (3, None, False), (None, 1.0, False)]
    df = spark.createDataFrame([(1, 1, "old"), (1, 3, "new"), (2, 1, "only")], "k int, t int, v string")
    assert rows(users.latest(df, "k", [F.col("t")])) == [(1, 3, "new"), (2, 1, "only")]


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "12"), (float("nan"), "x3"), (None, None)], "a double, p string")
    assert tuple(profile.column_counts(df).first()) == (1, 2)
    assert profile.largest_number(df, "p").first().max_page == 12


def test_registration(spark, tmp_path):
    asked = spark.createDataFrame([("1", "a@b.co", "2.5"), ("x", "a@b.co", "1")], "chat_id string, email string, years_of_experience string")
    left = flows.register(asked, str(tmp_path / "users"))
    assert rows(left.select("email", "years_of_experience")) == [("a@b.co", 1.0)]
    stored = spark.read.parquet(str(tmp_path / "users"))
    assert rows(stored.select("chat_id")) == [(1,)]
    assert users.lookup(stored, "chat_id", 1, [F.col("email")]).count() == 1
    assert users.lookup(stored, "chat_id", 2, [F.col("email")]).count() == 0
