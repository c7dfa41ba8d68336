import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspar.functions import extract, html, text
from marlspar.plans import roundtrips  # noqa: F401  registers its queries
from marlspar.plans.registry import QUERIES
from marlspar.session import spread


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_clean(spark):
    assert one(spark, text.clean, "Encora\n3.8\n665 Reviews") == "Encora 3 8 665 Reviews"
    assert one(spark, text.clean_first_line, "Encora\n3.8\n665 Reviews") == "Encora"
    assert one(spark, text.clean, None) is None
    assert one(spark, text.clean, " ** ") == ""


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=30, max_size=60))
def test_clean_is_idempotent_and_plain(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    once = text.clean(F.col("v"))
    rows = df.select("i", once.alias("a"), text.clean(once).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert [r.a for r in rows] == [re.sub("[^a-zA-Z0-9]+", " ", v).strip() for v in values]


@pytest.mark.parametrize(
    "f, value, expected",
    [
        (text.strip_asterisks, "a***b*c", "a b c"),
        (text.resplit_skills, "a/b,c", "a b c"),
        (text.json_span, 'noise {"a":\n1} more', '{"a": 1}'),
        (text.json_span, "none", None),
        (text.strip_glyphs, "  3 years", "3 years"),
        (lambda c: text.truncate(c, 3), "abcd", "abc..."),
        (lambda c: text.truncate(c, 3), "abc", "abc"),
        (lambda c: text.default(c), None, "Not specified"),
        (lambda c: text.posted_date(c).cast("string"), "2024-02-30", None),
        (lambda c: text.posted_date(c).cast("string"), "2024-02-28", "2024-02-28"),
        (html.strip, "<p>a<script>var t='</p>';</script> b<!-- c --></p>", "a b"),
        (html.title, "<TITLE> x </TITLE>", "x"),
        (html.title, "<p>", None),
    ],
)
def test_functions(spark, f, value, expected):
    assert one(spark, f, value) == expected


def test_composed(spark):
    df = spark.createDataFrame([("a", None, 3)], "a string, b string, c int")
    assert df.select(text.compose(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "a None 3"
    assert tuple(df.select(text.callback(F.lit("referral:4:77"))).first()[0]) == ("referral", 4, 77)
    assert tuple(df.select(text.callback(F.lit("x:y"))).first()[0]) == ("x", None, None)
    assert tuple(df.select(text.tuple_of_two(F.lit("( 12, 500 )"))).first()[0]) == (12.0, 500.0)
    url = text.url_with("https://x/?", {"keywords": F.lit("a b&c"), "f_TPR": "r86400"})
    assert df.select(url).first()[0] == "https://x/?keywords=a+b%26c&f_TPR=r86400"
    assert df.select(text.page_urls(F.lit("u"), 3)).first()[0] == ["u", "u-2", "u-3"]
    assert df.select(text.parse_json(F.lit("oops"), T.StructType([T.StructField("k", T.LongType())]))).first()[0] is None
    assert df.select(text.first_present(F.lit(""), F.lit(None), F.lit("z"))).first()[0] == "z"


def test_sections(spark):
    lines = ["x", "Job Description and Mandate Skills", " a ", "", "b", "Responsibilities: no", "c"]
    df = spark.createDataFrame([(lines,), (["x"],)], "l array<string>")
    assert [r[0] for r in df.select(text.between_markers(F.col("l"))).collect()] == ["a\nb", "Not available"]
    lines = ["Our RESPONSIBILITIES", "do it", "skills wanted", "many"]
    df = spark.createDataFrame([(lines,), ([],)], "l array<string>")
    assert [r[0] for r in df.select(html.section_text(F.col("l"), ["responsibilities", "Skills"])).collect()] == ["do it\n\nmany", "Not available"]


def test_html_elements(spark):
    page = '<div class="card x"><h3>Job</h3><a href="/j">go</a></div><div class="card"></div><div class="card">B<br>C</div>'
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    got = sorted(map(tuple, html.cards(df, "html", ["page_id"], name="card").collect()))
    assert got == [(1, 0, "Job\ngo", "/j"), (1, 2, "B\nC", None)]
    assert [r[0] for r in df.select(html.text_of_class("card")("html")).collect()] == ["Job\ngo", "Not available"]


def test_extractors(spark):
    def factory():
        def model(prompts):
            return ["bad" if "x" in p else 'sure: {"Job Title": "T",\n "Skills": ["a", "b"]} done' for p in prompts]

        return model

    df = spark.createDataFrame([(1, "good"), (2, "x"), (3, None)], "id long, t string")
    rows = {r["id"]: r for r in extract.structured(df, "id", "t", factory).collect()}
    assert rows[1]["Job Title"] == "T" and rows[1]["Skills"] == "a, b" and rows[1]["error"] is None
    assert rows[2]["Job Title"] is None and rows[2]["error"]
    assert df.select(extract.skills(F.lit("I know Python, c++ and SQLite"), ["sql", "Python", "go"])).first()[0] == ["python"]
    vec = df.select(extract.hashed_embedding(16)("t").alias("v")).collect()
    assert abs(sum(x * x for x in vec[0].v) - 1) < 1e-6 and sum(vec[2].v) == 0


def test_the_first_element_is_what_all_elements_begin_with():
    """Whatever follows the first element, and however it is closed; parsing ends with it."""
    pages = [
        '<p class="card">a <b class="card">b</b> c</p><p class="card">d</p>', '<div class="card x">a<br>b', '<div><p class="card">a</div>b</p><i>c</i>', '<img class="card"><p class="card">later</p>',
        '<p class="c&#97;rd">e</p>', '<p class="other">card</p>', '<script>var p = "</p>"</script><p class=card>f<script>g</script>&amp;h', "", '<p class="card"', '<p class="card"></p><p class="card">x</p>',
    ]
    for page in pages:
        found = html.elements(page, name="card")
        assert html.first_text(page, "card", "none") == (found[0]["text"] if found else "none"), page
    assert html.first_text('<p class="card">a</p>' + "<i>x</i>" * 300_000, "card", "none") == "a"


def test_short_tables_are_dealt_out_before_parsing(spark, sf_dir):
    for name in ("text_of_class", "card_parts", "linkedin_recipe"):
        assert "RepartitionByExpression" in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString(), name
    assert spread(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() >= 8


def test_cards_are_found_in_batches_and_only_where_they_may_be(spark, monkeypatch):
    """No call a page from the plan, keys of any type, several batches a task; a page without a required class isn't parsed."""
    parts = {"title": html.Part("h3", ("new", "old")), "link": html.Part("a", ("link",), "href"), "any": html.Part("b")}
    card = html.Part("li", ("card",))
    whole = '<ul><li class="card"><h3 class="old">t<b>1</b></h3><a class="link" href="/x">go</a><li class="card big"><h3 class="new">in</h3><a class="l&#105;nk" href="/y"></li></ul>'
    pages = [whole, None, "", whole.replace("li", "p"), whole.replace("link", "other"), whole.replace("l&#105;nk", "q"), '<li class="card"><a class="link" href="/z"><h3 class="old">x</h3>', whole * 3]
    rows = [([str(i)], {"n": i}, p) for i, p in enumerate(pages)] * 3
    df = spark.createDataFrame(rows, "k array<string>, m struct<n long>, html string").coalesce(1)
    expected = [(k, m["n"], n, *found.values()) for k, m, p in rows for n, found in enumerate(html.parted(p, card, parts)) if found["title"] is not None and found["link"] is not None]
    monkeypatch.setattr(html, "GIVEN_ROWS", 2)
    got = html.card_rows(df, "html", ["k", "m"], card, parts, ("title", "link"))
    assert sorted(map(repr, expected)) == sorted(repr((r.k, r.m.n, r.position, r.title, r.link, r.any)) for r in got.collect()) and len(expected) == 33
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "PythonUDTF" not in plan
    assert not html._might_have("<p class='a'>", ("b", "d")) and html._might_have("&#98;", ("b",)) and html._might_have("", ())
