import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from entityfusion.functions import similarity, text, values
from entityfusion.functions.arrays import headed


def value(spark, make, *given, kind="string"):
    schema = ", ".join(f"c{i} {kind}" for i in range(len(given)))
    return spark.createDataFrame([given], schema).select(make(*(F.col(f"c{i}") for i in range(len(given)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "make, given, wanted",
    [
        (text.normalize_whitespace, "  a\t b \n c ", "a b c"),
        (text.normalize_whitespace, None, None),
        (text.split_multivalue, "a; b,a | c\n\n", ["a", "b", "c"]),
        (text.split_multivalue, None, []),
        (text.normalize_merged_words, "RESTApi Python3 fooBar", "REST Api Python 3 foo Bar"),
        (text.repair_ocr_tokens, "Postgre SQL and Io T on the 12 th", "PostgreSQL and IoT on the 12th"),
        (text.repair_ocr_tokens, "REST AP Is", "REST AP Is"),
        (text.repair_ocr_tokens, "back- end “x”…", 'backend "x"...'),
        (text.repair_ocr_tokens, "  ", None),
        (text.normalize_company_name, "GalaxyZ-Space  Ltd", "Galaxy Z Space Ltd"),
        (text.normalize_extracted_text, "Back-\nend\r\nx • y z\n\n\n\nw", "Backend\nx \n y z\n\nw".replace("x \n", "x\n")),
        (values.normalize_email, " A@X.Example.com ", "a@x.example.com"),
        (values.normalize_email, "", None),
        (values.normalize_phone, "+1 (415) 555-0101", "+14155550101"),
        (values.normalize_phone, "+44 (0)20 7946 0000", "+442079460000"),
        (values.normalize_phone, "415 555 0101", "4155550101"),
        (values.normalize_phone, "none", None),
        (values.normalize_url, "WWW.Example.com/A/?q=1#Z", "https://example.com/a?q=1#z"),
        (values.normalize_url, "http://x.example.com///", "http://x.example.com"),
        (values.normalize_url, "  ", None),
        (values.parse_date, "2020-03-09", date(2020, 3, 9)),
        (values.parse_date, "Mar 2020", date(2020, 3, 1)),
        (values.parse_date, "soon", None),
        (values.country_code, " us ", "US"),
        (values.country_code, "France", None),
        (values.parse_year, "since 2014", 2014),
    ],
)
def test_value(spark, make, given, wanted):
    assert value(spark, make, given) == wanted


def test_pairs(spark):
    assert value(spark, text.merge_text, "a | b", "b | c") == "a | b | c"
    assert value(spark, text.prefer_text, "ab", "cd") == "ab" and value(spark, text.prefer_text, "ab", "cde") == "cde"
    assert value(spark, text.stable_id, " A ", "b") == value(spark, text.stable_id, "a", "B ") and value(spark, text.stable_id, " ", None) is None
    assert value(spark, values.location_completeness, "x", " ", None, "FR") == 2
    assert value(spark, values.location_string, "x", None, "y") == "x, y"


def test_skill_tokens(spark):
    df = spark.createDataFrame([(["python", "Python", "C#", "design", "x", "REST API", "Python"],)], "t array<string>")
    assert df.select(text.filter_skill_tokens(F.col("t")).alias("x")).first()["x"] == ["Python", "C#", "REST API"]


@pytest.mark.parametrize("a, b, c, d, wanted", [(1, 5, 4, 9, True), (1, 3, 4, 9, False), (None, None, 4, 9, True), (1, None, 4, 9, True), (5, None, 1, 3, False), (None, 2, 4, None, False)])
def test_periods(spark, a, b, c, d, wanted):
    assert value(spark, values.date_ranges_overlap, a, b, c, d, kind="int") is wanted


def test_similarities():
    assert similarity.sequence_ratio("a  b", "A b") == 1 and similarity.sequence_ratio("", "a") == 0
    assert similarity.indel_ratio("kitten", "sitting") == pytest.approx(61.538, abs=0.01)
    # a term within a longer value is just at the usual threshold
    assert similarity.weighted_ratio("Technical Intern and Web Developer", "Developer") == 90
    assert similarity.weighted_ratio("tensor flow", "flow tensor") == 95
    assert similarity.weighted_ratio("", "a") == 0


def test_links_and_contacts(spark):
    t = "mail a.b@x.example.com, A.b@x.example.com www.x.example.com/q +1 415-555-0101 a.b@x.example.com"
    assert value(spark, values.extract_emails, t) == ["a.b@x.example.com", "A.b@x.example.com"]
    assert value(spark, values.extract_phones, t) == ["+1 415-555-0101"]
    assert value(spark, values.extract_links, t) == ["www.x.example.com/q"]
    assert value(spark, values.extract_emails, None) == []


def test_word_edges(spark):
    """Letters that are not of ASCII belong to words, or don't where the caller says so."""
    told = "am 5433 stä, T Oä, Type  Scriptß, 3 rd"
    assert value(spark, text.repair_ocr_tokens, told) == "am 5433 stä, T Oä, Type Scriptß, 3rd"
    assert value(spark, lambda t: text.repair_ocr_tokens(t, word=text.ASCII_WORD), told) == "am 5433stä, TOä, TypeScriptß, 3rd"


def test_items_are_worked_out_once_a_row(spark):
    """Heads, dates and links refer to what they are made of many times; it stands once in the plan."""
    text_of = lambda made: spark.createDataFrame([("a b a c",)], "t string").select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    split = F.split(F.col("t"), " ")
    assert text_of(headed(split, lambda x: F.when(x == "a", x))).count("split(") == 1
    for use in (values.parse_date, values.normalize_url, text.blank_to_null):
        assert text_of(use(F.concat(F.reverse("t"), F.col("t")))).count("reverse(") == 1, use


def test_texts_that_patterns_leave_alone(spark):
    """Patterns of whole texts begin with what few places have: no look-behind first, and no match that changes nothing."""
    plans = {
        "words": text.normalize_merged_words(F.col("t"), compose=False), "tokens": text.repair_ocr_tokens(F.col("t"), compose=False),
        "extracted": text.normalize_extracted_text(F.col("t"), compose=False), "spaces": text.normalize_whitespace(F.col("t")),
    }
    rows = [("plain words  of\ta line",), ("fooBar USAtoday 3rd9a",), ("Type Script A B C 21 st well- known­ ‘x’…",), ("co-\n op • x \r\n\n\n\ny",), ("　  a  b\u0085",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").coalesce(1).select(*(v.alias(k) for k, v in plans.items())).collect()
    assert [r["spaces"] for r in got] == [None if t is None else re.sub(r"\s+", " ", t).strip(" ") for (t,) in rows]
    assert [r["words"] for r in got][1:3] == ["foo Bar US Atoday 3 rd 9 a", "Type Script A B C 21 st well- known­ ‘x’…"]
    assert [r["tokens"] for r in got][1:4] == ["fooBar USAtoday 3rd9a", "TypeScript ABC 21st wellknown 'x'...", "coop • x \n\n\n\ny"]
    assert [r["extracted"] for r in got][3] == "coop\n x\n\ny"
    for shown in (str(p) for p in plans.values()):
        assert "(?U)(?<=" not in shown and "(?i)(?<!" not in shown and r"(?U)\s+" not in shown
