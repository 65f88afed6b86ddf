import hashlib

import pytest
from pyspark.sql import functions as F

from loamwork.functions import privacy, rules, text, urls


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string", list: "array<string>"}
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "one int")
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [
        ("https://A.example/x?utm_source=b&a=1&b=#top", None, "https://A.example/x?a=1&b="), ("../y", "https://a.example/x/z", "https://a.example/y"),
        ("mailto:a@b.c", "https://a.example", None), ("#x", "https://a.example", None), ("MAILTO:a@b.c", None, None), ("", None, None), (None, None, None),
        ("https://a.example/x?gclid=1", None, "https://a.example/x"), ("https:///x", None, None), ("https://a.example:80/", None, "https://a.example:80/"), ("http://[x", None, None),
    ],
)
def test_normalized(url, base, want):
    assert urls.normalized(url, base) == want


def test_native_normal_form_agrees(spark):
    some = ["https://a.example/x?page=2&ref=x#t", "https://a.example/?utm_source=feed", "http://a.example/en/685", "ftp://a.example/", "https://a.example/x?mc_id=1&b=2", "  https://a.example/y ", None]
    rows = spark.createDataFrame([(u,) for u in some], "u string").select("u", urls.normalize_absolute(F.col("u")).alias("a"), urls.normalize_url("u", F.lit(None).cast("string")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_sites_and_pdfs(spark):
    assert one(spark, urls.site_of(F.col("u")), u="https://a.b.example.org/x") == "example.org"
    assert one(spark, urls.site_of(F.col("u")), u="https://host/") == "host"
    assert one(spark, urls.is_pdf_url(F.col("u")), u="https://h.x/a.PDF?b=c") is True
    assert one(spark, urls.is_pdf_url(F.col("u")), u="https://h.x/a?b=.pdf") is False


def test_classified():
    pages, pdfs = urls.classified(["/a", "/a#x", "https://o.example.net/", "f.pdf", "https://z.net/g.pdf", "https://w.example.org/p/"], "https://w.example.org/p/")
    assert pages == ["https://w.example.org/a"]
    assert pdfs == ["https://w.example.org/p/f.pdf", "https://z.net/g.pdf"]


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.clean_text(t), t=" a  b\x1cc\n") == "a b c"
    assert one(spark, text.clean_text(t), t=None) == ""
    assert one(spark, text.tidy(t), t="a\n\n\n\nb\n\n") == "a\n\nb\n"
    assert one(spark, text.tidy(t), t=" \n") == ""
    assert one(spark, text.blocks(t), t="a\n \nb\n\n\n c ") == ["a", "b", "c"]
    assert one(spark, text.sentences(t), t="A. B!  C? d") == ["A.", "B!", "C?", "d"]
    assert one(spark, text.joined_lines(t), t=["a hyphen-", "ated word-", "Upper"]) == "a hyphenated word- Upper"
    assert one(spark, text.joined_lines(t), t=[]) == ""
    assert one(spark, text.options(t), t=" a, ,b") == ["a", "b"]
    assert one(spark, text.content_hash(t, F.lit(None).cast("string")), t="é") == hashlib.sha256("é\n".encode()).hexdigest()
    assert one(spark, text.markdown_table(F.array(F.lit("a ")), F.array(F.array(F.lit("b|c"), F.lit(None).cast("string")))))  == "| a |  |\n| --- | --- |\n| b\\|c |  |"
    assert one(spark, text.api_json(["first_name", "x"]), first_name="a", x=None) == '{"firstName":"a","x":null}'


@pytest.mark.parametrize(("term", "want"), [("evergreen", True), ("Fall 2026", True), ("Spring 2027", True), ("Summer 2026", False), ("Fall 2025", False), ("Autumn 26", None), ("2026 Fall", None), (None, None)])
def test_terms(spark, term, want):
    assert one(spark, rules.is_current(F.col("t"), F.lit("Fall 2026")), t=term) is want


def test_answers(spark):
    rows = [(1, ["c"], False, None), (2, [], True, "d"), (3, [], False, None), (4, [], True, None), (5, ["c"], True, "d"), (6, None, None, None)]
    got = rules.answer_violations(spark.createDataFrame(rows, "id int, citations array<string>, escalated boolean, department string")).collect()
    assert {r.id: r.violation for r in got} == {3: "neither", 4: "escalated_without_department", 5: "both", 6: "neither"}


def test_privacy(spark):
    masked = privacy.redacted(F.col("t"))
    assert one(spark, masked, t="a.b@x.org, (219) 555-0100, 0031234567 no 12") == "[EMAIL], [PHONE], 0031234567 no 12"
    assert one(spark, privacy.pii_remaining(masked), t="0031234567") is True
    assert one(spark, privacy.pii_remaining(masked), t="id 12345678") is False
    assert one(spark, privacy.pii_remaining(masked), t=None) is False


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(rules.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]
