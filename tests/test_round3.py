"""Cases on which queries differed from their SQL at size."""

import pytest

from postglean.functions import gate, gazetteer, keyword, salary
from postglean.operators import registry, views


@pytest.mark.parametrize("text, meant", [
    ("no place at all. EST!! ÉÇCHQUE!! AU!! LA!!", False), ("worldwide. ET!! LES,!! EST!! DE!! LA!! OURÉ!!", False), ("DANS!! ÉCH!! EST!!", False), ("Must work EST hours", True), ("Our hours: EST, CST, MST or PST", True),
    ("We ship AI and ML for EST teams", True), ("Built WITH JAVA, 9AM-5PM EST", True),
])
def test_codes_among_capitals(spark, text, meant):
    assert gazetteer.known_places().speaks_of_places(text) is meant


@pytest.mark.parametrize("text, labels", [("password=d2e6eda4eef73f", []), ('token = "8eda45dd"', []), ("EDA tools", ["semiconductor/eda"]), ("an eda-tool", ["semiconductor/eda"])])
def test_labels_within_secrets(spark, text, labels):
    made = keyword.keyword_score("title", "text")
    row = spark.createDataFrame([("Developer", text)], "title string, text string").select(made.alias("made")).first()["made"]
    assert row.negative == labels and row.score == -10 * len(labels)


def test_all_related_listings(spark):
    rows = spark.range(1203).selectExpr("CAST(id AS STRING) AS id", "1 AS group_id", "id AS posted", "id AS first_seen")
    got = [r.id for r in views.related(rows, "7").collect()]
    assert got == [str(k) for k in range(1202, -1, -1) if k != 7]


@pytest.mark.parametrize("text, span", [
    ("Series B $5M, salary $70,000\nb foo", "salary $70,000"), ("Series B $5M, salary $70,000\n$ foo", "salary $70,000"), ("שכר עד 50 אלף\n€ x", "שכר עד 50 אלף"), ("salary $70 k\nm x", "salary $70 k"), ("salary 70,000 USD\nx", "salary 70,000 USD"),
])
def test_amounts_end_with_their_line(text, span):
    assert salary.salary_span_of(text) == span


@pytest.mark.parametrize("text, word, held", [("no ALREADY here", "already", True), ("none", "already", False), ("DEGREEſ", "degrees", True), ("YEARİ", "yeari", True), (None, "year", False), ("", "year", False)])
def test_holds_whatever_the_case(spark, text, word, held):
    row = spark.createDataFrame([(text,)], "text string").select(gate.holds("text", word).alias("held")).first()
    assert row.held is held


@pytest.mark.parametrize("text, told", [("8 years\nplain\nmore", "8 years"), ("8 years of experience,\n  or a degree. No", "8 years of experience,\n  or a degree"), ("none", ""), ("a; 9 YEARS", "a; 9 YEARS")])
def test_texts_are_read_up_to_their_years(text, told):
    assert keyword._up_to_years(text) == told


def test_registry_entries_are_checked_once(spark):
    """What follows the checks reads their stored result."""
    rows = spark.range(2, 9).selectExpr("id AS at", "'{}' AS entry")
    plan = registry.registry_report(rows, "2024-06-01")._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "from_json" not in plan.lower() and "JsonToStructs" not in plan
